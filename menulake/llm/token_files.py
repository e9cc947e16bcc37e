"""Token ids in Arrow stream files of fixed-size-list batches, with zero-copy random access."""

from __future__ import annotations

import zlib
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from menulake.llm.common import Workspace, batch_of, shuffle_partitions, table
from menulake.llm.tokens import default_path, encoded, encoder

#: Tokens in a sequence, and sequences in a record batch.
SEQUENCE, BATCH_ROWS = 2048, 256


def id_type(vocabulary: int) -> pa.DataType:
    """The smallest unsigned type that holds all ids."""
    return pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()


def file_schema(length: int, kind: pa.DataType) -> pa.Schema:
    """Sequences of ids, and masks that are true where there is a token; a mask takes a bit each."""
    return pa.schema([pa.field("ids", pa.list_(pa.field("id", kind, nullable=False), length), nullable=False), pa.field("mask", pa.list_(pa.field("token", pa.bool_(), nullable=False), length), nullable=False)])


#: Beside each file, the documents in it.
DOCS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


class SequenceWriter:
    """Writes documents' ids one after another as rows of `length` ids and a mask of equal length.
    Only the last row is padded. All batches but the last have equally many rows."""

    def __init__(self, sink, kind: pa.DataType, length: int = SEQUENCE, batch_rows: int = BATCH_ROWS):
        self.schema, self.length, self.size = file_schema(length, kind), length, length * batch_rows
        self.kind = kind.to_pandas_dtype()
        self.writer = pa.ipc.new_stream(sink, self.schema)
        self.ids, self.held = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.ids.append(ids.astype(self.kind))
        self.held += len(ids)
        if self.held >= self.size:
            self._flush(self.held - self.held % self.size)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.ids)
        for at in range(0, n, self.size):
            self._write(ids[at : min(n, at + self.size)], 0)
        self.ids, self.held = [ids[n:]], len(ids) - n

    def _write(self, ids: np.ndarray, pad: int) -> None:
        mask = np.ones(len(ids), bool)
        mask[len(ids) - pad :] = False
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((ids, mask), self.schema, strict=True)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            pad = -self.held % self.length
            self._write(np.concatenate([*self.ids, np.zeros(pad, self.kind)]), pad)
        self.writer.close()


class SequenceFile:
    """Random access to the sequences of one file. source: a path's memory map, or a buffer.

    The arrays returned are views of the mapped bytes; nothing is copied or decoded.
    """

    def __init__(self, source):
        reader = pa.ipc.open_stream(source)
        self.batches = list(reader)
        self.length = reader.schema.field("ids").type.list_size
        self.rows = max((b.num_rows for b in self.batches), default=1)

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids, mask) of sequence i; the mask is Arrow's view of its bits."""
        b, r = self.batches[i // self.rows], i % self.rows
        ids, mask = (b.column(c).values.slice((b.column(c).offset + r) * self.length, self.length) for c in range(2))
        return ids.to_numpy(zero_copy_only=True), mask


class TokenReader:
    """take(n) gives the next n ids of a file's record batches, which are opened one at a time."""

    def __init__(self, batches):
        self.batches, self.ids = iter(batches), np.zeros(0, np.uint32)

    def take(self, n: int) -> np.ndarray:
        parts = []
        while n > len(self.ids):
            parts.append(self.ids)
            n -= len(self.ids)
            b = next(self.batches)
            whole = b.column(0).flatten().to_numpy(zero_copy_only=True)
            self.ids = whole[: int(pa.compute.sum(b.column(1).flatten()).as_py() or 0)]
        parts.append(self.ids[:n])
        self.ids = self.ids[n:]
        return np.concatenate(parts) if len(parts) > 1 else parts[0]


def write_files(docs: DataFrame, folder: str, path: str, end_id: int, length: int = SEQUENCE) -> DataFrame:
    """Writes the documents in ascending doc_id order; one row per file: part, file, docs, tokens.

    A file is written under a name of its own and moved into place when complete, so a task that
    fails or runs twice leaves no partial file.
    """
    end = np.array([end_id], "<u4")

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        part = context.partitionId()
        name, mine = f"part-{part:06d}.arrows", f"{root}/.part-{part:06d}-{context.taskAttemptId()}.tmp"
        n_docs = n_tokens = 0
        with store.open_output_stream(mine) as sink, store.open_output_stream(f"{mine}.docs") as docs_sink:
            out = SequenceWriter(sink, id_type(max(encoder(path).tokenizer.get_vocab_size(), end_id + 1)), length)
            index = pa.ipc.new_stream(docs_sink, DOCS)
            for rows, ids in encoded(batches, 1, path):
                counts = []
                for x in ids:
                    tokens = np.concatenate([np.frombuffer(x, "<u4"), end])
                    out.add(tokens)
                    counts.append(len(tokens))
                n_tokens += sum(counts)
                n_docs += rows.num_rows
                index.write_batch(pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts, pa.int64())], schema=DOCS))
            out.close()
            index.close()
        store.move(mine, f"{root}/{name}")
        store.move(f"{mine}.docs", f"{root}/{name}.docs")
        yield batch_of(["part", "file", "docs", "tokens"], [[part], [name], [n_docs], [n_tokens]], [pa.int32(), pa.string(), pa.int64(), pa.int64()])

    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    crc = F.crc32(F.col("text").cast("binary"))
    ordered = rows.repartitionByRange(n, "doc_id", crc).sortWithinPartitions("doc_id", crc, "text")
    return ordered.mapInArrow(run, "part int, file string, docs long, tokens long")


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """(part, doc_id, at, n_tokens, ids_crc32) of each document, from the files alone; at counts
    the ids before it in its file."""

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for part, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as f, store.open_input_file(f"{root}/{name}.docs") as g:
                    tokens = TokenReader(pa.ipc.open_stream(f))
                    at = 0
                    for names in pa.ipc.open_stream(g):
                        begins, counts, crcs = [], [], []
                        for n in names.column(1).to_pylist():
                            ids = np.ascontiguousarray(tokens.take(n), "<u4")
                            begins.append(at)
                            counts.append(len(ids))
                            crcs.append(zlib.crc32(ids))
                            at += len(ids)
                        yield batch_of(["part", "doc_id", "at", "n_tokens", "ids_crc32"], [[part] * len(begins), names.column(0), begins, counts, crcs], [pa.int32()] + [pa.int64()] * 4)

    return files.select("part", "file").mapInArrow(run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str | None = None, end_id: int = 2, folder: str | None = None, length: int = SEQUENCE) -> DataFrame:
    """Writes docs as token files into folder (by default one of the workspace) and returns, read
    back from them, doc_id, start, n_tokens, ids_crc32 per document.

    A null or empty text is its end id alone. Rows are ordered by doc_id (nulls first), rows that
    repeat an id by the crc32 of their text and the text; other columns are ignored; an empty table gives no rows. Rows of one
    doc_id are spread by their text, so no id can fill a partition unless its rows are equal.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "token-files")
    folder = folder or ws.path("tokens")
    files = ws.save(write_files(docs, folder, path or default_path(), end_id, length), "files")
    starts, total = [], 0
    for part, tokens in sorted(files.select("part", "tokens").collect()):  # a row for each file
        starts.append((part, total))
        total += tokens
    begin = spark.createDataFrame(starts or [(0, 0)], "part int, begin long")
    found = read_files(files.repartition(max(1, len(starts)), "part"), folder)
    return found.join(F.broadcast(begin), "part").select("doc_id", (F.col("begin") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op3_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))
