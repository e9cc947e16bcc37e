"""Cost-balanced packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from menulake.llm.common import Workspace, batch_of, table
from menulake.llm.tokens import default_path, encoded

#: Attention cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n. In a transformer of model
#: width d, a token costs about 12 d units in its layers' matrices and one unit for each token it
#: attends to, so with d = 1024 the quadratic part weighs 1 to 12,288.
LINEAR, QUADRATIC = 12_288.0, 1.0
#: Tokens that are packed together. What doesn't fill a sequence in one pool is packed once more with
#: what is left of LEFT_POOLS others.
POOL_TOKENS, LEFT_POOLS = 4 << 20, 1024
#: Sequence ids of the second packing begin here.
SECOND = 1 << 62

Piece = tuple[int, int, int]


def cost(lengths):
    lengths = np.asarray(lengths, np.float64)
    return LINEAR * lengths + QUADRATIC * lengths * lengths


def pack(lengths: np.ndarray, capacity: int, last: bool = True) -> tuple[list[list[Piece]], list[Piece]]:
    """(sequences, rest): lists of (document, start, length) that hold each token of the documents once.

    Documents longer than a sequence first give whole sequences. What is left goes, longest first,
    into as many sequences as its tokens fill: each piece to the lowest-cost sequence that has room
    for it, or, where none has, cut so that it fills the lowest-cost sequence with any room. Ties go
    to the earlier document and the earlier sequence. The rest, less than a sequence, is one more
    sequence if this packing is the last, and returned otherwise.
    """
    out: list[list[Piece]] = []
    rest: list[Piece] = []
    for d, n in enumerate(lengths.tolist()):
        whole = n // capacity
        out += [[(d, i * capacity, capacity)] for i in range(whole)]
        if n % capacity:
            rest.append((d, whole * capacity, n % capacity))
    tokens = sum(n for *_, n in rest)
    count = -(-tokens // capacity) if last else tokens // capacity
    room = np.full(count, capacity, np.int64)
    costs = np.zeros(count)
    held: list[list[Piece]] = [[] for _ in range(count)]
    left: list[Piece] = []
    free = count * capacity
    for d, start, n in sorted(rest, key=lambda r: -r[2]):
        while n and free:
            fits = room >= n
            if not fits.any():
                fits = room > 0
            s = int(np.argmin(np.where(fits, costs, np.inf)))
            m = min(n, int(room[s]))
            held[s].append((d, start, m))
            room[s] -= m
            free -= m
            costs[s] += float(cost(m))
            start, n = start + m, n - m
        if n:
            left.append((d, start, n))
    return out + held, left


def pools(batches: Iterable[pa.RecordBatch], text_at: int, path: str, end_id: int, pool_tokens: int):
    """(rows, ids per row) of consecutive rows with about pool_tokens tokens, the end id appended."""
    end = end_id.to_bytes(4, "little")
    rows, ids, held = [], [], 0
    for part, encoded_part in encoded(batches, text_at, path):
        rows.append(part)
        ids += [x + end for x in encoded_part]
        held += sum(map(len, encoded_part)) // 4 + part.num_rows
        if held >= pool_tokens:
            yield pa.Table.from_batches(rows), ids
            rows, ids, held = [], [], 0
    if rows:
        yield pa.Table.from_batches(rows), ids


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_NAMES = [x.split()[0] for x in _PIECES.split(", ")]


def packed(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 1, pool_tokens: int = POOL_TOKENS, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    A null or empty text is its end id alone. Repeated rows and ids are packed like any other, rows
    without doc_id too; other columns are ignored; an empty table gives no rows. ids is the piece's
    tokens as little-endian unsigned 32-bit integers (null without with_ids); a sequence is its
    pieces by offset, padded to the capacity.

    Each task packs its rows in pools of bounded size and fills whole sequences only. What remains,
    less than a sequence a pool, is saved with its tokens, and packed again over many pools, so the
    padding doesn't follow the layout of the input. A task that runs again gives the same
    sequences: sequence_id has the partition above bit 40.
    """
    path = path or default_path()
    ws = Workspace(docs.sparkSession, "packing")

    def first(batches):
        part = TaskContext.get().partitionId()
        sequence = part << 40
        for rows, ids in pools(batches, 1, path, end_id, pool_tokens):
            doc_ids = rows.column(0).combine_chunks()
            lengths = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            sequences, rest = pack(lengths, capacity, last=False)
            doc, start, length, seq, offset, left = [], [], [], [], [], []
            for pieces, is_left in [*((s, False) for s in sequences), (rest, True)]:
                at = 0
                for d, s, n in pieces:
                    for column, value in zip((doc, start, length, seq, offset, left), (d, s, n, sequence, at, is_left), strict=True):
                        column.append(value)
                    at += n
                sequence += 1
            for lo in range(0, len(doc), 4096):
                cut = slice(lo, lo + 4096)
                data = [ids[d][4 * s : 4 * (s + n)] for d, s, n in zip(doc[cut], start[cut], length[cut], strict=True)]
                yield batch_of(
                    [*_NAMES, "is_left"],
                    [doc_ids.take(pa.array(doc[cut], pa.int64())), start[cut], length[cut], list(map(zlib.crc32, data)), lengths[doc[cut]], seq[cut], offset[cut], [x if with_ids or y else None for x, y in zip(data, left[cut], strict=True)], left[cut]],
                    [pa.int64()] * 7 + [pa.binary(), pa.bool_()],
                )

    def second(batches):
        sequence = SECOND + (TaskContext.get().partitionId() << 40)
        held = {n: [x for b in parts for x in b.column(i).to_pylist()] for parts in [list(batches)] for i, n in enumerate(_NAMES)}
        for pieces in pack(np.array(held["length"], np.int64), capacity)[0]:
            at, out = 0, []
            for i, s, n in pieces:
                data = held["ids"][i][4 * s : 4 * (s + n)]
                out.append((held["doc_id"][i], held["start"][i] + s, n, zlib.crc32(data), held["doc_tokens"][i], sequence, at, data if with_ids else None))
                at += n
            sequence += 1
            yield batch_of(_NAMES, [list(c) for c in zip(*out, strict=True)], [pa.int64()] * 7 + [pa.binary()])

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    done = ws.save(plain.mapInArrow(first, f"{_PIECES}, is_left boolean"), "first")
    left = done.where("is_left").drop("is_left")
    bins = left.select(F.countDistinct("sequence_id")).first()[0] // LEFT_POOLS + 1  # a pool leaves under a sequence
    again = left.repartition(bins, "sequence_id").sortWithinPartitions("sequence_id", "offset").mapInArrow(second, _PIECES)
    return done.where("not is_left").drop("is_left").unionByName(again)


def op6_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")
