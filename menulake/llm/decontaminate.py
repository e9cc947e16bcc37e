"""Benchmark decontamination: an FM-index per training shard answers the benchmark's windows."""

from __future__ import annotations

import functools
import hashlib
import pickle
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from menulake.llm.common import LOWER, Workspace, as_bytes, batch_of, table

#: Lower-cases A-Z and turns each byte that isn't part of a word into a space.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isascii() and chr(b).isalnum() else 0x20 for b in LOWER)
#: Bytes of text in one training shard, and of benchmark text in one block of phrases.
SHARD_BYTES, BLOCK_BYTES = 16 << 20, 4 << 20


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Phrases:
    """A block of the benchmark: the different windows of its items, in word numbers."""

    def __init__(self, items: list[tuple[str | None, list[int]]], window: int):
        self.items: list[str | None] = []
        windows: dict[tuple[int, ...], list[int]] = {}
        for name, ids in items:
            at = len(self.items)
            self.items.append(name)
            for i in range(max(1, len(ids) - window + 1)):
                owners = windows.setdefault(tuple(ids[i : i + window]), [])
                if not owners or owners[-1] != at:
                    owners.append(at)
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.words = np.zeros((len(windows), window), np.int64)
        for i, w in enumerate(windows):
            self.words[i, : len(w)] = w
        self.owners = list(windows.values())


@dataclass(frozen=True)
class Benchmark:
    """Where the shared folder has the benchmark's words and its phrase blocks, and the fewest words
    that a window has."""

    words: str
    blocks: tuple[str, ...]
    shortest: int


@functools.lru_cache(maxsize=1)
def numbers_of(path: str) -> dict[bytes, int]:
    """The benchmark's words, numbered from 1 in their order; read once in each Python worker."""
    store, root = fs.FileSystem.from_uri(path)
    words = ds.dataset(root, filesystem=store, format="parquet").to_table().column("word").to_pylist()
    return {w: i + 1 for i, w in enumerate(sorted(words))}


@functools.lru_cache(maxsize=1)
def read_block(path: str) -> Phrases:
    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_stream(at) as f:
        return pickle.loads(f.read())


def write_blocks(ws: Workspace, benchmark: DataFrame, window: int) -> Benchmark:
    """The benchmark in the shared folder: its different words, and its windows in blocks of phrases.

    Tasks do both; a path and a number for each block reach the driver."""
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))

    def split(batches):
        for b in batches:
            yield batch_of(["word"], [sorted({w for t in as_bytes(b.column(1)) for w in words_of(t)})], [pa.binary()])

    words = ws.save(rows.mapInArrow(split, "word binary").distinct(), "words")._menulake_path
    folder = ws.path("phrases")

    def number(batches):
        known, context = numbers_of(words), TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        items, held, count = [], 0, 0

        def flush():
            nonlocal items, held, count
            name = f"{context.partitionId()}-{context.taskAttemptId()}-{count}"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(pickle.dumps(Phrases(items, window)))
            shortest = min(min(len(ids), window) for _, ids in items)
            items, held, count = [], 0, count + 1
            return batch_of(["name", "shortest"], [[name], [shortest]], [pa.string(), pa.int64()])

        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                ids = [known[w] for w in words_of(text)]
                if ids:
                    items.append((item, ids))
                    held += len(text)
                    if held >= BLOCK_BYTES:
                        yield flush()
        if items:
            yield flush()

    found = sorted(rows.mapInArrow(number, "name string, shortest long").collect())
    return Benchmark(words, tuple(f"{folder}/{name}" for name, _ in found), min((n for _, n in found), default=0))


class Shard:
    """The FM-index of a training shard's documents, given as lists of words.

    An occurrence consists of the benchmark's words only. So the index holds the documents without
    the other words, and without runs of words between those that are shorter than any window; no
    match crosses what is left out.
    """

    def __init__(self, docs: list[list[bytes]], known: dict[bytes, int], shortest: int):
        from menulake.llm.fm_index import FMIndex

        runs, doc_at, word_at = [], [], []
        for d, words in enumerate(docs):
            if len(words) < shortest:
                continue
            ids = np.fromiter(map(known.get, words, repeat(0)), np.int32, len(words))
            hole = np.concatenate([[-1], np.flatnonzero(ids == 0), [len(ids)]])
            for h in np.flatnonzero(np.diff(hole) > shortest):
                s, e = int(hole[h]) + 1, int(hole[h + 1])
                runs.append(ids[s:e])
                doc_at.append(d)
                word_at.append(s)
        self.doc_at, self.word_at = np.array(doc_at, np.int64), np.array(word_at, np.int64)
        self.begins = np.cumsum([0] + [len(r) + 1 for r in runs])[:-1]
        self.index = None
        if runs:
            self.used, own = np.unique(np.concatenate(runs), return_inverse=True)
            self.index = FMIndex(np.split(own + 1, np.cumsum([len(r) for r in runs])[:-1]), len(self.used) + 1)

    def find(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of the phrases: (document, first word, window number)."""
        if self.index is None or not len(phrases.lengths):
            return (np.zeros(0, np.int64),) * 3
        at = np.minimum(np.searchsorted(self.used, phrases.words), len(self.used) - 1)
        words = np.where(self.used[at] == phrases.words, at + 1, 0)  # 0: a word the shard hasn't, or none
        lo, hi = self.index.search(words, phrases.lengths)
        counts = hi - lo
        window = np.repeat(np.arange(len(lo)), counts)
        rows = np.repeat(lo, counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        at = self.index.locate(rows)
        run = np.searchsorted(self.begins, at, side="right") - 1
        return self.doc_at[run], self.word_at[run] + at - self.begins[run], window


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of intervals as disjoint spans in order; touching ones become one."""
    order = np.argsort(starts, kind="stable")
    out: list[tuple[int, int]] = []
    for s, e in zip(starts[order].tolist(), ends[order].tolist(), strict=True):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def scan_shard(texts: list[bytes | None], benchmark: Benchmark) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each document of a shard: its words, the removal spans in words, and the items found. One
    index answers all blocks of the benchmark."""
    docs = [words_of(t) for t in texts]
    spans: dict[int, list[np.ndarray]] = {}
    items: dict[int, set[str]] = {}
    shard = Shard(docs, numbers_of(benchmark.words), benchmark.shortest) if benchmark.blocks else None
    for path in benchmark.blocks:
        phrases = read_block(path)
        doc, start, window = shard.find(phrases)
        order = np.argsort(doc, kind="stable")
        doc, start, window = doc[order], start[order], window[order]
        for lo, hi in _groups(doc):
            d = int(doc[lo])
            spans.setdefault(d, []).append(np.stack([start[lo:hi], start[lo:hi] + phrases.lengths[window[lo:hi]]]))
            found = items.setdefault(d, set())
            for w in np.unique(window[lo:hi]).tolist():
                found.update(name for o in phrases.owners[w] if (name := phrases.items[o]) is not None)
    return [(len(w), merged(*np.concatenate(spans[d], axis=1)) if d in spans else [], sorted(items.get(d, ()))) for d, w in enumerate(docs)]


def _groups(values: np.ndarray):
    if not len(values):
        return []
    cut = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return zip(cut.tolist(), [*cut[1:].tolist(), len(values)], strict=True)


def shards(batches, text_at: int, limit: int = SHARD_BYTES):
    """(rows, texts) of consecutive rows with about limit bytes of text; a longer text is a shard
    of its own rows."""
    rows, texts, held = [], [], 0
    for b in batches:
        begin = 0
        column = as_bytes(b.column(text_at))
        for i, t in enumerate(column):
            held += len(t or b"")
            if held >= limit:
                rows.append(b.slice(begin, i + 1 - begin))
                yield pa.Table.from_batches(rows), texts + column[begin : i + 1]
                rows, texts, held, begin = [], [], 0, i + 1
        if begin < b.num_rows:
            rows.append(b.slice(begin))
            texts += column[begin:]
    if rows:
        yield pa.Table.from_batches(rows), texts


def benchmark_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, spans array<struct<start,end>> in words, items array<string>) per document.

    A word is a run of A-Z, a-z, 0-9 and non-ASCII characters, A-Z lowered. An item of the benchmark
    gives its windows of `window` words, or all its words if it has fewer; an item without words or
    with a null text gives none. Windows of an item without an id count as any, but no item is
    named for them; an id that repeats is one item. Occurrences are exact. Null and empty texts have
    no words. Repeated rows and repeated ids each give a row; other columns are ignored. An empty
    benchmark leaves every document clean.

    The benchmark lies in the shared folder in blocks of bounded size; each training shard, a run
    of consecutive rows, gets one FM-index, in which all blocks are looked up. Documents aren't
    shuffled.
    """
    ws = Workspace(docs.sparkSession, "decontaminate")
    found_in = write_blocks(ws, benchmark, window)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for rows, texts in shards(batches, 1):
            found = scan_shard(texts, found_in)
            spans = [[{"start": s, "end": e} for s, e in x[1]] for x in found]
            yield batch_of(["doc_id", "n_words", "spans", "items"], [rows.column(0).combine_chunks(), [x[0] for x in found], spans, [x[2] for x in found]], [pa.int64(), pa.int64(), kind, pa.list_(pa.string())])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>")


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the words of the spans and what stands between them; the gap becomes a space."""
    import re

    at = [m.span() for m in re.finditer(rb"\S+", text.translate(WORD_BYTES))]
    out, begin = [], 0
    for s, e in spans:
        out.append(text[begin : at[s][0]].rstrip(b" \t"))
        begin = at[e - 1][1]
    out.append(text[begin:])
    return b" ".join(x for x in out if x).strip()


def remove_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs with the removal spans cut out of each text. Same columns; n_chars, if there, follows.

    Documents that are nothing but benchmark keep an empty text; clean documents keep theirs.
    """
    ws = Workspace(docs.sparkSession, "decontaminate")
    found_in = write_blocks(ws, benchmark, window)
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for rows, texts in shards(batches, at):
            found = scan_shard(texts, found_in)
            new = [t if not x[1] else without_spans(t, x[1]) for t, x in zip(texts, found, strict=True)]
            text = pa.array(new, type=pa.binary()).cast(pa.string())
            yield from rows.set_column(at, "text", text).combine_chunks().to_batches()

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*names) if "n_chars" in names else out


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def digest(items: list[str]) -> str:
    """The lowercase hex SHA-256 of sorted item ids, comma-joined, as the query gives it."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


#: The same for DuckDB, by joining windows of words.
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
    win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0) x),
    lens AS (SELECT DISTINCT n FROM win), at_ AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
    hit AS (SELECT DISTINCT doc_id, i, win.n, item FROM at_ JOIN win ON win.n = at_.n AND win.g = array_to_string(list_slice(w, i, i + at_.n - 1), ' ')),
    p AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS word FROM hit) u GROUP BY doc_id),
    t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) v GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(p.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""
