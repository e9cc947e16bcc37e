"""Removal of bytes that a repeated passage covers, by a logarithmic family of suffix arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from menulake.llm.common import Answers, Workspace, as_bytes, batch_of, table
from menulake.llm.suffix_index import K, LEFT_WORDS, MIN, PLACES, RIGHT_WORDS, Family, Level, anchors_of, kmer_hashes, lanes, mix, places, sides

#: Bytes of text in a batch, anchors for which there is a bucket, bits of the hash that name a bucket
#: at least, and contexts that enter the index family at once.
BATCH_BYTES, BUCKET_ANCHORS, MIN_BITS, ADD_CONTEXTS = 4 << 20, 100_000, 8, 1 << 16
#: Bits of the hash that one hop of an exchange goes by at most, bits of the hops before the last, and
#: members that are packed together between hops.
LAST_BITS, HOP_BITS, PACKET = 10, 8, 256
#: Entries that join at once in a last bucket.
JOINED = 1 << 16
#: A null doc_id counts as larger than any other.
NULL_ID = np.iinfo(np.int64).max
FRONT, BACK = LEFT_WORDS * 8, RIGHT_WORDS * 8 + 64
_STORE = "batch long, ids binary, lens binary, gaps binary, text binary, rows binary, bytes long, anchors long"


def pack(a: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes())


def unpack(b: bytes, kind=np.uint8) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


class Batch:
    """Documents of a batch, one text after another, with their anchors."""

    def __init__(self, ids: np.ndarray, lens: np.ndarray, text: bytes | np.ndarray, pos: np.ndarray | None = None):
        self.ids, self.lens = ids, lens
        self.ends = np.cumsum(lens)
        self.begins = self.ends - lens
        self.n = int(lens.sum())
        self.padded = np.zeros(FRONT + self.n + BACK, np.uint8)
        self.padded[FRONT : FRONT + self.n] = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
        body = self.padded[FRONT:]
        if pos is None:
            pos = anchors_of(body, self.n)
            row = np.searchsorted(self.ends, pos, side="right")
            pos = pos[pos + K <= self.ends[row]]
        row = np.searchsorted(self.ends, pos, side="right")
        words = lanes(body)
        h = kmer_hashes(words, pos, pos + 8)
        first, last = places(pos, h, self.begins[row], self.ends[row])
        used = first <= last
        self.pos, self.h, self.row, self.first, self.last = pos[used], h[used], row[used], first[used], last[used]
        self.doc = ids[self.row]
        # anchors by hash, and the different hashes among them
        self.by_h = np.argsort(self.h, kind="stable")
        hs = self.h[self.by_h]
        self.heads = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]])) if len(hs) else np.zeros(0, np.int64)
        self.keys = hs[self.heads]

    @classmethod
    def read(cls, b: pa.RecordBatch, i: int) -> Batch:
        get = lambda name, kind: unpack(b.column(b.schema.get_field_index(name))[i].as_py(), kind)
        return cls(get("ids", np.int64), get("lens", np.int64), get("text", np.uint8), np.cumsum(get("gaps", np.uint32), dtype=np.int64))


class Contexts:
    """The different contexts of a batch's anchors whose hash also occurs in another document.

    shared: for each of the batch's keys, whether another batch has it."""

    def __init__(self, batch: Batch, shared: np.ndarray):
        docs = batch.doc[batch.by_h]
        if len(batch.heads):
            local = np.minimum.reduceat(docs, batch.heads) != np.maximum.reduceat(docs, batch.heads)
            keep = np.repeat(shared | local, np.diff(np.append(batch.heads, len(docs))))
        else:
            keep = np.zeros(0, bool)
        self.at = at = batch.by_h[keep]
        left, right = sides(batch.padded, FRONT, batch.pos[at], batch.first[at], batch.last[at])
        limits = (batch.first[at] << 8 | batch.last[at]).astype(np.uint64)
        kind = np.lexsort([limits, *left.T[::-1], *right.T[::-1], batch.h[at]]) if len(at) else np.zeros(0, np.int64)
        rows = np.concatenate([batch.h[at][:, None], right, left, limits[:, None]], axis=1)[kind]
        head = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]) if len(at) else np.zeros(0, bool)
        heads = np.flatnonzero(head)
        self.of = np.empty(len(at), np.int64)
        self.of[kind] = np.cumsum(head) - 1
        one = kind[heads]
        self.doc = np.minimum.reduceat(batch.doc[at][kind], heads) if len(heads) else np.zeros(0, np.int64)
        self.left, self.right, self.h = left[one], right[one], batch.h[at][one]
        self.first, self.last = batch.first[at][one], batch.last[at][one]
        # the texts as they stand, from the anchor on and reversed before it
        self.text = np.concatenate([self.right.astype(">u8").view(np.uint8), self.left.astype(">u8").view(np.uint8)], axis=1)


def removed(batch: Batch, found: Contexts, hits: np.ndarray) -> np.ndarray:
    """Which bytes of the batch go. A context's occurrences after its smallest document lose all
    their windows; those in that document lose the windows that smaller documents have too."""
    doc, smallest = batch.doc[found.at], found.doc[found.of]
    first, last, pos = batch.first[found.at], batch.last[found.at], batch.pos[found.at]
    mask = np.where(doc > smallest, ~np.uint64(0), hits[found.of])
    change = np.zeros(batch.n + 1, np.int32)
    for a in range(PLACES):
        rows = (first <= a) & (a <= last) & ((mask >> np.uint64(a)) & np.uint64(1) > 0)
        begin = pos[rows] - a
        np.add.at(change, begin, 1)
        np.add.at(change, begin + MIN, -1)
    return np.cumsum(change[:-1]) > 0


def make_batches(docs: DataFrame, keep_rows: bool) -> DataFrame:
    names = docs.columns
    id_at, text_at, limit = names.index("doc_id"), names.index("text"), BATCH_BYTES

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        parts, texts, held = [], [], 0

        def flush():
            ids = pa.concat_arrays([p.column(id_at).cast(pa.int64()) for p in parts]).fill_null(NULL_ID).to_numpy()
            batch = Batch(ids, np.fromiter((len(t) for t in texts), np.int64, len(texts)), b"".join(texts))
            gaps = np.diff(batch.pos, prepend=0).astype(np.uint32)
            rows = b""
            if keep_rows:
                sink = pa.BufferOutputStream()
                whole = pa.Table.from_batches(parts).combine_chunks().drop_columns(["text"])
                with pa.ipc.new_stream(sink, whole.schema) as w:
                    w.write_table(whole)
                rows = sink.getvalue().to_pybytes()
            return batch_of(
                ["batch", "ids", "lens", "gaps", "text", "rows", "bytes", "anchors"],
                [[part << 32 | number], [pack(ids)], [pack(batch.lens)], [pack(gaps)], [pack(b"".join(texts))], [pack(rows)], [batch.n], [len(batch.pos)]],
                [pa.int64(), *[pa.binary()] * 5, pa.int64(), pa.int64()],
            )

        for b in batches:
            column, begin = as_bytes(b.column(text_at)), 0
            for i, t in enumerate(column):
                texts.append(t or b"")
                held += len(t or b"")
                if held >= limit:
                    parts.append(b.slice(begin, i + 1 - begin))
                    yield flush()
                    parts, texts, held, begin, number = [], [], 0, i + 1, number + 1
            if begin < b.num_rows:
                parts.append(b.slice(begin))
        if texts:
            yield flush()

    return docs.mapInArrow(run, _STORE)


def parts_of(sorted_hashes: np.ndarray, done: int, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, begin, end) of the filled buckets: those of the next `bits` bits of hashes that agree in
    the `done` bits before."""
    if not len(sorted_hashes):
        return
    bucket = (sorted_hashes << np.uint64(done)) >> np.uint64(64 - bits)
    heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist()
    for s, e in zip(heads, [*heads[1:], len(bucket)], strict=True):
        yield int(bucket[s]), s, e


class Exchange:
    """How members (batches, or packets of them) ask buckets of hashes a question, in their order of
    hashes, and get as many answers.

    A hop sends rows (node, member, payload), only where there is anything to send. Where all buckets
    together are more than LAST_BITS can name, a hop goes by HOP_BITS of the hash only; packets of
    about PACKET members of a node then join their payloads into one, in which equal entries are one,
    and ask in turn. So a member sends a bounded number of rows at each hop, however many buckets
    there are, and a hash that many batches have shrinks by the packet at each hop.
    """

    payload: str  # type of the payload in SQL
    arrow = pa.binary()

    def hashes(self, payload) -> np.ndarray:
        """The hashes of a payload's entries, sorted."""
        raise NotImplementedError

    def slice(self, payload, begin: int, end: int):
        raise NotImplementedError

    def join(self, payloads: list) -> tuple[object, object]:
        """(the different entries of several payloads, sorted by hash; what `split` needs)."""
        raise NotImplementedError

    def split(self, kept, answers: bytes) -> list[bytes]:
        """Each payload's answers from those of the joined one."""
        raise NotImplementedError

    def cat(self, answers: list[tuple[int, bytes, int]]) -> bytes:
        """The answers of parts, in order of their buckets, as one."""
        raise NotImplementedError

    def answer(self, payload) -> bytes:
        """The answers of a last bucket to the different entries of all its members."""
        raise NotImplementedError

    def together(self, packed: pa.ChunkedArray, counts: list[int]) -> list[bytes]:
        """The answers of a last bucket to all its members: entries that many have count once. Members
        join in groups of a bounded number of entries, and then the groups with each other."""
        groups, size = [[]], 0
        for i, n in enumerate(counts):
            if size and size + n > JOINED:
                groups.append([])
                size = 0
            groups[-1].append(i)
            size += n
        joined = [self.join([self.unpack(packed[i].as_buffer()) for i in g]) for g in groups]
        if len(joined) == 1:
            whole, kept = joined[0]
            return self.split(kept, self.answer(whole))
        whole, kept = self.join([payload for payload, _ in joined])
        rests = [k for _, k in joined]
        del joined
        return [x for k, got in zip(rests, self.split(kept, self.answer(whole)), strict=True) for x in self.split(k, got)]

    def sent(self, member: int, payload, done: int, bits: int, node: int = 0) -> pa.RecordBatch:
        found = list(parts_of(self.hashes(payload), done, bits))
        return batch_of(["node", "member", "payload", "n"], [[node << bits | b for b, *_ in found], [member] * len(found), [self.pack(self.slice(payload, s, e)) for _, s, e in found], [e - s for _, s, e in found]], [pa.int64(), pa.int64(), pa.binary(), pa.int64()])

    def pack(self, payload) -> bytes:
        raise NotImplementedError

    def unpack(self, data: bytes):
        raise NotImplementedError

    def answers(self, sent: DataFrame, members: int, done: int, rest: int) -> DataFrame:
        """(node, member, answer, n) for the rows of sent, whose nodes are of the first `done` bits, with
        `rest` bits to go."""
        kind = "node long, member long, answer binary, n long"
        if not rest:

            def meet(t: pa.Table) -> pa.Table:
                t = t.sort_by("member")  # the same order whenever a task runs
                data = self.together(t.column("payload"), t.column("n").to_pylist())
                return pa.table({"node": t.column("node"), "member": t.column("member"), "answer": pa.array(data, pa.binary()), "n": t.column("n")})

            return sent.groupBy("node").applyInArrow(meet, kind)
        bits = rest if rest <= LAST_BITS else HOP_BITS
        packets = members // PACKET + 1
        dealt = sent.withColumn("packet", F.pmod(F.xxhash64("member"), F.lit(packets)))

        def joined(t: pa.Table) -> tuple[pa.Table, object, object]:
            t = t.sort_by("member")
            return t, *self.join([self.unpack(x) for x in t.column("payload").to_pylist()])

        def ask(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
            _, payload, _ = joined(t)
            out = self.sent(key[1].as_py(), payload, done, bits, key[0].as_py())
            return pa.Table.from_batches([out])

        def tell(key: tuple[pa.Scalar, ...], t: pa.Table, found: pa.Table) -> pa.Table:
            t, _, kept = joined(t)
            found = found.sort_by("node")
            got = self.cat(list(zip(found.column("node").to_pylist(), found.column("answer").to_pylist(), found.column("n").to_pylist(), strict=True)))
            return pa.table({"node": t.column("node"), "member": t.column("member"), "answer": pa.array(self.split(kept, got), pa.binary()), "n": t.column("n")})

        asked = dealt.groupBy("node", "packet").applyInArrow(ask, "node long, member long, payload binary, n long")
        below = self.answers(asked, packets, done + bits, rest - bits).withColumn("up", F.shiftright("node", bits))
        return dealt.groupBy("node", "packet").cogroup(below.groupBy("up", "member")).applyInArrow(tell, kind)


class SharedKeys(Exchange):
    """Asks for each hash of a member whether another one has it; a bit each."""

    def hashes(self, payload):
        return payload

    def slice(self, payload, begin, end):
        return payload[begin:end]

    def pack(self, payload):
        return payload.tobytes()

    def unpack(self, data):
        return np.frombuffer(data, np.uint64)

    def join(self, payloads):
        keys, at, count = np.unique(np.concatenate(payloads), return_inverse=True, return_counts=True)
        return keys, (at, count > 1, [len(p) for p in payloads])

    def split(self, kept, answers):
        at, here, sizes = kept
        many = (self.bits(answers, len(here)) | here)[at]
        return [np.packbits(x).tobytes() for x in np.split(many, np.cumsum(sizes)[:-1])]

    @staticmethod
    def bits(data: bytes, n: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)

    def cat(self, answers):
        return np.packbits(np.concatenate([np.zeros(0, bool), *(self.bits(data, n) for _, data, n in answers)])).tobytes()

    def answer(self, payload):
        return np.packbits(np.zeros(len(payload), bool)).tobytes()  # nobody else is left to have them


class ContextHits(Exchange):
    """Asks for each context of a member which of its windows begin in a smaller document too; a bit
    for each place of the anchor, in 64 bits. A payload is (text, first, last, doc) of its contexts."""

    FIELDS = (("text", np.uint8), ("first", np.uint8), ("last", np.uint8), ("doc", np.int64))

    def hashes(self, payload):
        return kmer_hashes(np.ascontiguousarray(payload[0][:, :K]).view("<u8"), (slice(None), 0), (slice(None), 1)) if len(payload[3]) else np.zeros(0, np.uint64)

    def slice(self, payload, begin, end):
        return tuple(x[begin:end] for x in payload)

    def pack(self, payload):
        return pack(np.int64(len(payload[3])).tobytes() + b"".join(np.ascontiguousarray(x, kind).tobytes() for x, (_, kind) in zip(payload, self.FIELDS, strict=True)))

    def unpack(self, data):
        raw = unpack(data)
        n, at, out = int(raw[:8].view(np.int64)[0]), 8, []
        for name, kind in self.FIELDS:
            size = n * ((RIGHT_WORDS + LEFT_WORDS) * 8 if name == "text" else np.dtype(kind).itemsize)
            part = np.frombuffer(raw[at : at + size].tobytes(), kind)
            out.append(part.reshape(n, -1) if name == "text" else part)
            at += size
        return tuple(out)

    def join(self, payloads):
        text, first, last, doc = (np.concatenate(x) for x in zip(*payloads, strict=True))
        h = self.hashes((text, first, last, doc))
        words = text.view(np.uint64)  # only compared, so in any byte order
        limits = first.astype(np.uint64) << np.uint64(8) | last
        whole = mix(limits + h)
        for column in range(words.shape[1]):
            whole = mix(whole ^ words[:, column])
        order = np.lexsort([whole, h])
        same = np.zeros(len(order), bool)
        same[1:] = whole[order[1:]] == whole[order[:-1]]
        at = np.flatnonzero(same)  # equal by hash; they must be equal
        same[at] = (words[order[at]] == words[order[at - 1]]).all(axis=1) & (limits[order[at]] == limits[order[at - 1]])
        heads = np.flatnonzero(~same)
        least = np.minimum.reduceat(doc[order], heads) if len(heads) else doc
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(~same) - 1
        one = order[heads]
        return (text[one], first[one], last[one], least), (at, doc > least[at] if len(doc) else np.zeros(0, bool), [len(p[3]) for p in payloads])

    def split(self, kept, answers):
        at, later, sizes = kept
        found = unpack(answers, np.uint64)
        hits = np.where(later, ~np.uint64(0), found[at])  # a smaller document has the whole context
        return [pack(x) for x in np.split(hits, np.cumsum(sizes)[:-1])]

    def cat(self, answers):
        return pack(np.concatenate([np.zeros(0, np.uint64), *(unpack(data, np.uint64) for _, data, _ in answers)]))

    def answer(self, payload):
        """All contexts of the bucket pass through an index family, as many at a time as come together."""
        text, first, last, doc = payload
        family = Family()
        for lo in range(0, len(doc), ADD_CONTEXTS):
            part = slice(lo, lo + ADD_CONTEXTS)
            words = text[part].view(">u8").astype(np.uint64)
            family.add(Level(words[:, RIGHT_WORDS:], words[:, :RIGHT_WORDS], first[part].astype(np.int64), last[part].astype(np.int64), doc[part], np.arange(lo, lo + len(words))))
        level = family.finish()
        hits = np.zeros(len(doc), np.uint64)
        if level is not None:
            hits[level.name] = level.hit
        return pack(hits)


_READ = ("batch", "ids", "lens", "gaps", "text")


def asked(ws: Workspace, store: DataFrame, exchange: Exchange, question: Callable, members: int, bits: int, label: str) -> Answers:
    """The answers to what `question(batch, number)` asks for each batch of the store."""
    first = bits if bits <= LAST_BITS else HOP_BITS

    def send(batches):
        for b in batches:
            for i in range(b.num_rows):
                number = b.column(0)[i].as_py()
                yield exchange.sent(number, question(Batch.read(b, i), number), 0, first)

    sent = store.select(*_READ).mapInArrow(send, "node long, member long, payload binary, n long")
    found = exchange.answers(sent, members, first, bits - first)
    return Answers.write(ws, found.select(F.shiftright("member", 32).alias("part"), "member", "node", "answer", "n"), ["member", "node"], label)


def answer_to(exchange: Exchange, answers: Answers, number: int) -> bytes:
    """The answer to one batch."""
    table = answers.of(number >> 32)
    if table is None:  # no batch there asked anything
        return exchange.cat([])
    lo, hi = np.searchsorted(table.column("member").to_numpy(), [number, number + 1])
    rows = table.slice(int(lo), int(hi - lo))
    return exchange.cat(list(zip(rows.column("node").to_pylist(), rows.column("answer").to_pylist(), rows.column("n").to_pylist(), strict=True)))


def spans_of(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def each_document(docs: DataFrame, finish, schema: str, keep_rows: bool = False) -> DataFrame:
    """finish(batch, removed bytes, other columns) gives the result's record batch of each batch.

    1. Documents are stored in batches with their anchors. 2. Batches ask buckets of hashes which of
    their anchors' hashes other batches have. 3. They ask them with the contexts of such anchors,
    each different one once, and the buckets' index families tell which windows smaller documents
    have. 4. Each batch marks its bytes. Buckets grow in number with the anchors, so that each holds
    a bounded count of different hashes; the texts never move, and answers are read from the shared
    folder, by the partition that asked.
    """
    ws = Workspace(docs.sparkSession, "suffix")
    store = ws.save(make_batches(docs, keep_rows), "batches")
    count, anchors = store.agg(F.count(F.lit(1)), F.sum("anchors")).first()
    bits = max(MIN_BITS, ((anchors or 0) // BUCKET_ANCHORS).bit_length())
    keys, hits = SharedKeys(), ContextHits()
    shared = asked(ws, store, keys, lambda batch, _: batch.keys, count, bits, "shared")

    def contexts(batch: Batch, number: int) -> Contexts:
        return Contexts(batch, keys.bits(answer_to(keys, shared, number), len(batch.keys)))

    def question(batch: Batch, number: int) -> tuple:
        c = contexts(batch, number)
        return c.text, c.first, c.last, c.doc

    found = asked(ws, store, hits, question, count, bits, "hits")

    def apply(batches):
        for b in batches:
            for i in range(b.num_rows):
                batch, number = Batch.read(b, i), b.column(0)[i].as_py()
                c = contexts(batch, number)
                yield from finish(batch, removed(batch, c, unpack(answer_to(hits, found, number), np.uint64)), b.column(5)[i].as_py())

    return store.select(*_READ, "rows").mapInArrow(apply, schema)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start,end>>, kept binary) for each document.

    A byte goes if a 50-byte string that covers it also starts in a document of a smaller doc_id;
    strings are those of the input's UTF-8 bytes and never cross documents. A null text is empty;
    texts under 50 bytes keep all. Rows that repeat a doc_id don't affect each other; a null doc_id
    is larger than any other, and rows with one don't affect each other. Other columns are ignored;
    an empty table gives no rows.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(batch: Batch, gone: np.ndarray, rows: bytes):
        text = batch.padded[FRONT : FRONT + batch.n]
        out = [[], [], [], []]
        for i, (s, e) in enumerate(zip(batch.begins.tolist(), batch.ends.tolist(), strict=True)):
            out[0].append(None if batch.ids[i] == NULL_ID else int(batch.ids[i]))
            out[1].append(e - s)
            out[2].append([{"start": x, "end": y} for x, y in spans_of(gone[s:e])])
            out[3].append(text[s:e][~gone[s:e]].tobytes())
        yield batch_of(["doc_id", "n_bytes", "spans", "kept"], out, [pa.int64(), pa.int64(), kind, pa.binary()])

    return each_document(docs.select("doc_id", F.col("text").cast("string").alias("text")), finish, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def whole_characters(text: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """gone without the parts of characters of which another part stays."""
    inner = (text & 0xC0) == 0x80
    start = np.maximum.accumulate(np.where(inner, 0, np.arange(len(text)))) if len(text) else np.zeros(0, np.int64)
    kept = np.zeros(len(text), bool)
    np.logical_or.at(kept, start, ~gone)
    return ~kept[start]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs without the repeated bytes, but for characters of which a byte stays. Same columns;
    n_chars, if there, follows. A document that had words and keeps none goes."""
    names = docs.columns
    schema = docs.schema

    def finish(batch: Batch, gone: np.ndarray, rows: bytes):
        data = batch.padded[FRONT : FRONT + batch.n]
        other = pa.ipc.open_stream(unpack(rows).tobytes()).read_all()
        texts, keep = [], []
        for s, e in zip(batch.begins.tolist(), batch.ends.tolist(), strict=True):
            t = data[s:e]
            g = whole_characters(t, gone[s:e])
            texts.append(t[~g].tobytes().decode() if g.any() else t.tobytes().decode())
            keep.append(not g.any() or bool(texts[-1].strip()))
        whole = other.append_column("text", pa.array(texts, pa.string())).select(names).filter(pa.array(keep))
        yield from whole.combine_chunks().to_batches()

    out = each_document(docs, finish, schema, True)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)).select(*names) if "n_chars" in names else out


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The same for DuckDB, over all strings of 50 bytes as hexadecimal digits.
ORACLE = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), s AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS g FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM h) u),
    f AS (SELECT g, min(doc_id) AS first_doc FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)), c AS (SELECT s.doc_id, i FROM s JOIN f ON f.g = s.g WHERE first_doc < s.doc_id),
    m AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new_ FROM c), r AS (SELECT doc_id, i, sum(new_) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m),
    e AS (SELECT doc_id, min(i) AS lo, max(i) + 50 AS hi FROM r GROUP BY doc_id, run), k AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM e),
    a AS (SELECT k.doc_id, count(*) AS spans, sum(hi - lo) AS gone, max(hi) AS last, string_agg(substr(x, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS kept FROM k JOIN h ON h.doc_id = k.doc_id GROUP BY k.doc_id)
    SELECT h.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept || substr(x, 2 * last + 1), x))) AS kept_sha256 FROM h LEFT JOIN a ON a.doc_id = h.doc_id"""
