"""Why an extraction differs: quotes that aren't in the source, and lines that don't match."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from menulake.functions.arrays import path_reason
from menulake.functions.keys import evidence, evidence_key
from menulake.storage import fresh_path

#: Letters of a quote's part that is looked for, characters of a window, and quotes that are compared
#: with a window at once.
FRAGMENT, WINDOW, BLOCK = 3, 240, 2000
#: What a reader may put between parts of a quote.
SEPARATOR = r"\r?\n|\s+[|·•–—-]\s+|\s*[|·•]\s*"
#: Fixed order of the classes of a mismatch.
CLASSES = ("category_path", "price", "name_variant", "not_in_reference", "not_extracted")


def quote_class(quote: Column, source: Column) -> Column:
    """How a quote stands in its source: present, added_separator or merged_lines (its parts are there,
    next to each other or apart), whitespace_only, changed_characters (apart from signs), or
    invented_text. Null or empty quotes are `missing`."""
    q, s = evidence_key(quote), evidence_key(F.coalesce(source, F.lit("")))
    parts = F.filter(F.transform(F.split(quote, SEPARATOR), evidence_key), lambda p: F.length(p) >= FRAGMENT)
    all_there = (F.size(parts) >= 2) & F.forall(parts, lambda p: F.contains(s, p))
    squeezed = lambda c: F.regexp_replace(c, r"\s+", "")
    signless = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")
    return (
        F.when(F.coalesce(F.length(q), F.lit(0)) == 0, "missing")
        .when(F.contains(s, q), "present")
        .when(all_there & F.contains(s, F.array_join(parts, " ")), "added_separator")
        .when(all_there, "merged_lines")
        .when(F.contains(squeezed(s), squeezed(q)), "whitespace_only")
        .when((F.length(signless(q)) > 0) & F.contains(signless(s), signless(q)), "changed_characters")
        .otherwise("invented_text")
    )


def windows(text: str, size: int = WINDOW) -> list[tuple[int, str]]:
    """(offset, part) of overlapping parts; each keeps the last third of the one before."""
    step = size - size // 3
    return [(at, text[at : at + size]) for at in range(0, max(1, len(text) - size // 3), step)]


def pairs_of(text: str) -> Counter:
    return Counter(text[i : i + 2] for i in range(len(text) - 1))


def dice(a: str, b: str) -> float:
    """Similarity of the bags of letter pairs, whatever the case."""
    x, y = pairs_of(a.lower()), pairs_of(b.lower())
    total = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / total if total else 0.0


class QuoteBlock:
    """Bags of letter pairs of some quotes, as one matrix."""

    def __init__(self, ids: list, quotes: list[str | None]):
        bags = [(i, pairs_of(evidence(q))) for i, q in zip(ids, quotes, strict=True)]
        bags = [(i, b) for i, b in bags if b]
        self.ids = [i for i, _ in bags]
        self.number = {p: n for n, p in enumerate(sorted({p for _, b in bags for p in b}))}
        self.counts = np.zeros((len(self.number), len(bags)), np.int32)
        for n, (_, b) in enumerate(bags):
            for p, c in b.items():
                self.counts[self.number[p], n] = c
        self.sizes = self.counts.sum(axis=0)

    def scores(self, text: str) -> np.ndarray:
        """The similarity of a text with each quote."""
        bag = pairs_of(text)
        there = [(self.number[p], c) for p, c in bag.items() if p in self.number]
        if not there:
            return np.zeros(len(self.ids))
        rows, counts = (np.array(x) for x in zip(*there, strict=True))
        return 2 * np.minimum(self.counts[rows], counts[:, None]).sum(axis=0) / (self.sizes + sum(bag.values()))


def best_different(scores: np.ndarray, parts: list[tuple], top: int) -> list[int]:
    """The `top` parts (doc, offset, text) of different texts with the largest scores above 0, ties by doc
    and offset. As many of the best are looked at as that takes, ties whole."""
    positive, look = int((scores > 0).sum()), 4 * top
    while True:
        least = np.partition(scores, len(scores) - look)[len(scores) - look] if look < positive else 0.0
        chosen: dict[str, int] = {}
        for i in sorted(np.flatnonzero((scores >= least) & (scores > 0)).tolist(), key=lambda i: (-scores[i], parts[i][0], parts[i][1])):
            chosen.setdefault(parts[i][2], i)
            if len(chosen) == top:
                break
        if len(chosen) == top or look >= positive:
            return list(chosen.values())
        look *= 4


def quote_nearest(docs: DataFrame, quotes: DataFrame, top: int = 3, block: int = BLOCK) -> DataFrame:
    """(item_id, doc_id, offset, score): the `top` windows of different texts most like each quote, by
    letter pairs of their evidence forms; ties go to the smaller doc_id and offset.

    The quotes are a query set: every window is compared with every quote, a block of quotes at a
    time, which tasks read from the shared folder. A task keeps the best of its own windows.
    """
    path = fresh_path(docs.sparkSession, "quotes")
    quotes.select("item_id", F.col("text").alias("quote")).write.parquet(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(path)
        for pdf in batches:
            parts = [(d, at, evidence(part)) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) if t for at, part in windows(t)]
            for rows in ds.dataset(root, filesystem=store, format="parquet").to_batches(batch_size=block):
                of = QuoteBlock(rows.column("item_id").to_pylist(), rows.column("quote").to_pylist())
                if not of.ids or not parts:
                    continue
                scores = np.array([of.scores(text) for *_, text in parts])
                out = []
                for n, item in enumerate(of.ids):
                    out += [(item, *parts[i][:2], float(scores[i, n]), parts[i][2]) for i in best_different(scores[:, n], parts, top)]
                yield pd.DataFrame(out, columns=["item_id", "doc_id", "offset", "score", "part"])

    near = docs.select("doc_id", "text").mapInPandas(run, "item_id long, doc_id long, offset long, score double, part string")
    order = [F.desc("score"), F.asc("doc_id"), F.asc("offset")]
    first = near.withColumn("k", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where("k = 1")
    return first.withColumn("k", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("k") <= top).select("item_id", "doc_id", "offset", "score")


def quote_contained(docs: DataFrame, quotes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(item_id, doc_id): which quotes stand in which documents, both as evidence, from any place in a
    word on. Quotes that are null or have no sign are in none.

    The quotes are a query set, which tasks read from the shared folder in blocks; an automaton finds
    all quotes of a block in one pass over a text."""
    path = fresh_path(docs.sparkSession, "quotes")
    quotes.select("item_id", F.col("text").alias("quote")).write.parquet(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        store, root = fs.FileSystem.from_uri(path)
        for pdf in batches:
            texts = [(d, evidence(t)) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) if t]
            for rows in ds.dataset(root, filesystem=store, format="parquet").to_batches(batch_size=block):
                items: dict[str, list] = {}
                for item, quote in zip(rows.column("item_id").to_pylist(), rows.column("quote").to_pylist(), strict=True):
                    if key := evidence(quote):
                        items.setdefault(key, []).append(item)
                if not items:
                    continue
                find = ahocorasick.Automaton()
                for key in items:
                    find.add_word(key, key)
                find.make_automaton()
                out = [(item, d) for d, text in texts for key in {k for _, k in find.iter(text)} for item in items[key]]
                yield pd.DataFrame(out, columns=["item_id", "doc_id"]).astype("int64")

    return docs.select("doc_id", "text").mapInPandas(run, "item_id long, doc_id long")


def variant_candidates(left: DataFrame, right: DataFrame, group: str, least: float) -> DataFrame:
    """(group, l, r, score) of all pairs of different names in a group that are as similar as `least`.

    Names meet by letter pairs: of n pairs (the k-th copy of one counts as its own), at least
    n * least / (2 - least) must be shared, so two such names share one of their first
    n - that + 1 in an order that both have; the rarest pairs come first."""

    def grams(df: DataFrame) -> DataFrame:
        text = F.lower("name")
        at = F.when(F.length(text) > 1, F.sequence(F.lit(1), F.length(text) - 1)).otherwise(F.array().cast("array<int>"))
        rows = df.select(group, "name").distinct().select(group, "name", F.explode(F.transform(at, lambda i: F.substring(text, i, F.lit(2)))).alias("pair"))
        return rows.groupBy(group, "name", "pair").agg(F.count(F.lit(1)).alias("n")).select(group, "name", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.concat("pair", F.lit("#"), k))).alias("pair"))

    a, b = grams(left), grams(right)
    seen = a.select(group, "pair").unionByName(b.select(group, "pair")).groupBy(group, "pair").agg(F.count(F.lit(1)).alias("seen"))

    def first(df: DataFrame) -> DataFrame:
        own = Window.partitionBy(group, "name")
        counted = df.join(seen, [group, "pair"]).withColumn("k", F.row_number().over(own.orderBy("seen", "pair"))).withColumn("size", F.count(F.lit(1)).over(own))
        return counted.where(F.col("k") <= F.col("size") - F.ceil(F.col("size") * least / (2 - least) - 1e-9) + 1).select(group, "name", "pair")

    met = first(a).withColumnRenamed("name", "l").join(first(b).withColumnRenamed("name", "r"), [group, "pair"]).where("l <> r").select(group, "l", "r").distinct()
    score = F.pandas_udf(lambda x, y: pd.Series([dice(p, q) for p, q in zip(x, y, strict=True)]), "double")
    return met.withColumn("score", score("l", "r")).where(F.col("score") >= least)


def name_variants(left: DataFrame, right: DataFrame, group: str, least: float = 0.75) -> DataFrame:
    """(group, l, r, score): names paired one to one within a group, most alike first, ties by name.

    Only pairs that are similar enough reach the task that decides a group."""

    def pair(key, pdf):
        used_l, used_r, out = set(), set(), []
        for s, x, y in sorted(zip(-pdf["score"], pdf["l"], pdf["r"], strict=True)):
            if x not in used_l and y not in used_r:
                used_l.add(x)
                used_r.add(y)
                out.append((key[0], x, y, -s))
        return pd.DataFrame(out, columns=[group, "l", "r", "score"])

    found = variant_candidates(left, right, group, least)
    return found.groupBy(group).applyInPandas(pair, found.schema)


def mismatch_rows(category_errors: DataFrame, price_errors: DataFrame, missing: DataFrame, invented: DataFrame, least: float = 0.75) -> DataFrame:
    """(source, classification, reason, expected, actual): one row for each mismatch of a comparison.

    category_errors: source, name, expected_path, actual_path (arrays); price_errors: source, name;
    missing, invented: source, name. A missing and an invented name that are variants of each other
    are one row instead of two. Paths are compared by their comparable labels."""
    label = lambda x: F.lower(F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " ")))
    keyed = category_errors.select("source", "name", F.transform("expected_path", label).alias("e"), F.transform("actual_path", label).alias("a"))
    paths = keyed.select("source", F.lit("category_path").alias("classification"), F.coalesce(path_reason(F.col("e"), F.col("a")), F.lit("other")).alias("reason"), F.col("name").alias("expected"), F.col("name").alias("actual"))
    none = F.lit(None).cast("string")
    cost = price_errors.select("source", F.lit("price").alias("classification"), none.alias("reason"), F.col("name").alias("expected"), F.col("name").alias("actual"))
    variants = name_variants(missing, invented, "source", least).select("source", "l", "r")
    both = variants.select("source", F.lit("name_variant").alias("classification"), none.alias("reason"), F.col("l").alias("expected"), F.col("r").alias("actual"))
    more = invented.join(variants.select("source", F.col("r").alias("name")), ["source", "name"], "left_anti").select("source", F.lit("not_in_reference").alias("classification"), none.alias("reason"), none.alias("expected"), F.col("name").alias("actual"))
    less = missing.join(variants.select("source", F.col("l").alias("name")), ["source", "name"], "left_anti").select("source", F.lit("not_extracted").alias("classification"), none.alias("reason"), F.col("name").alias("expected"), none.alias("actual"))
    return reduce(DataFrame.unionByName, (paths, cost, both, more, less))
