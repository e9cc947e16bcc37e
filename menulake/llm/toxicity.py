"""Toxicity from the nearest labelled examples by exact TF-IDF cosine, over block-max indexes."""

from __future__ import annotations

import functools
import pickle
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from menulake.llm.common import LOWER, Workspace, as_bytes, batch_of, crc_mod, table

#: Labelled examples of each class, bytes of a stem, neighbours that vote, examples in a block,
#: different words a worker remembers, numbers in the sketch that tells copies among the examples,
#: the share of examples that makes a term a frequent one, and queries that are answered together.
SAMPLE, STEM, NEIGHBOURS, BLOCK, CACHE_WORDS, SKETCH, FREQUENT, TOGETHER = 2000, 4, 16, 64, 300_000, 32, 16, 256
THRESHOLD = 0.7
#: A-Z lowered, and ASCII that isn't a letter or digit as a space.
WORDS = bytes(b if b >= 0x80 or chr(b).isascii() and chr(b).isalnum() else 0x20 for b in LOWER)


def terms_of(word: bytes) -> list[bytes]:
    """A word is a term, and so is its stem, its first bytes, marked by a star."""
    return [word, word[:STEM] + b"*"] if len(word) > STEM else [word]


def term_counts(text: bytes | None) -> Counter:
    out: Counter = Counter()
    for word, n in Counter((text or b"").translate(WORDS).split()).items():
        for term in terms_of(word):
            out[term] += n
    return out


class Vocabulary(dict):
    """Numbers of the examples' terms, by word; filled as words are met."""

    def __init__(self, terms: list[bytes]):
        super().__init__()
        self.terms = {t: i for i, t in enumerate(terms)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = tuple(self.terms[t] for t in terms_of(word) if t in self.terms)
        return found

    def __reduce__(self):
        return Vocabulary, (list(self.terms),)

    def counts(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """The text's terms that an example has, in order, and how often each occurs."""
        words = (text or b"").translate(WORDS).split()
        return np.unique(np.fromiter(chain.from_iterable(map(self.__getitem__, words)), np.int64), return_counts=True)


def unit(terms: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, weights): (1 + ln tf) times the term's weight, of length 1; weightless terms are left out."""
    x = (1 + np.log(counts)) * weight[terms]
    terms, x = terms[x > 0], x[x > 0]
    return terms, x / np.sqrt(x @ x) if len(x) else x


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after another."""
    total = int(lengths.sum())
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(total)


class BlockMaxIndex:
    """Postings of all terms of the examples, in blocks of BLOCK examples with the largest weight that
    each term has there. Terms that one in FREQUENT examples has lie as a matrix a block, the others
    as lists by term.

    A block is opened for a query only if the sum of its terms' maxima reaches the query's k-th best
    cosine so far, so the k nearest are exact.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        self.n, self.blocks = len(vectors), -(-len(vectors) // BLOCK)
        sizes = [len(t) for t, _ in vectors]
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vectors)])
        example, weight = np.repeat(np.arange(self.n), sizes), np.concatenate([np.zeros(0), *(w for _, w in vectors)])
        often = np.bincount(term, minlength=terms) * FREQUENT >= max(1, self.n)
        self.column = np.where(often, np.cumsum(often) - 1, -1)
        self.width = int(often.sum())
        part = often[term]
        whole = np.zeros((self.n, self.width))
        whole[example[part], self.column[term[part]]] = weight[part]
        self.frequent = [np.ascontiguousarray(whole[lo : lo + BLOCK].T) for lo in range(0, self.n, BLOCK)]
        self.frequent_most = np.array([m.max(axis=1) for m in self.frequent]).reshape(self.blocks, self.width).T
        order = np.flatnonzero(~part)[np.argsort(term[~part], kind="stable")]  # the examples of a term stay in order
        self.example, self.weight, term = example[order], weight[order], term[order]
        block = self.example // BLOCK
        head = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(block, prepend=-1))
        self.start, self.size, self.block = head, np.diff(np.append(head, len(term))), block[head]
        self.most = np.maximum.reduceat(self.weight, head) if len(head) else np.zeros(0)
        self.of_term = np.searchsorted(term[head], np.arange(terms + 1))

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(cosines, example numbers) of each query's k nearest, best first, ties by number. Only
        cosines above 0 count. without: for each query an example that mustn't be among them."""
        dense, rare = np.zeros((len(queries), self.width)), []
        bound = np.zeros((len(queries), self.blocks))
        for i, (terms, weights) in enumerate(queries):
            column = self.column[terms]
            dense[i, column[column >= 0]] = weights[column >= 0]
            terms, weights = terms[column < 0], weights[column < 0]
            size = self.of_term[terms + 1] - self.of_term[terms]
            at = ranges(self.of_term[terms], size)  # the terms' blocks
            rare.append((at, np.repeat(weights, size)))
            bound[i] = np.bincount(self.block[at], rare[i][1] * self.most[at], self.blocks)
        bound += dense @ self.frequent_most
        cosine = np.zeros((len(queries), self.n))
        first = np.zeros(bound.shape, bool)  # each query's most promising blocks, for a good k-th best
        np.put_along_axis(first, np.argsort(-bound, axis=1, kind="stable")[:, :2], True, axis=1)
        self._open(cosine, first & (bound > 0), dense, rare, without)
        least = np.partition(cosine, self.n - k, axis=1)[:, self.n - k] if self.n > k else np.zeros(len(queries))
        self._open(cosine, ~first & (bound > 0) & (bound * (1 + 1e-9) >= least[:, None]), dense, rare, without)
        out = []
        for row in cosine:
            who = np.flatnonzero(row > 0)
            if len(who) > 4 * k:
                who = who[row[who] >= np.partition(row[who], len(who) - k)[len(who) - k]]
            who = who[np.lexsort((who, -row[who]))[:k]]
            out.append((row[who], who))
        return out

    def _open(self, cosine: np.ndarray, chosen: np.ndarray, dense: np.ndarray, rare: list, without: np.ndarray | None) -> None:
        """Adds the cosines of the chosen (query, block) pairs."""
        for b in np.flatnonzero(chosen.any(axis=0)).tolist():
            rows = np.flatnonzero(chosen[:, b]) if not chosen[:, b].all() else slice(None)
            cosine[rows, b * BLOCK : (b + 1) * BLOCK] = dense[rows] @ self.frequent[b]
        for i, (at, w) in enumerate(rare):
            here = chosen[i, self.block[at]]
            size = self.size[at[here]]
            rows = ranges(self.start[at[here]], size)
            cosine[i] += np.bincount(self.example[rows], self.weight[rows] * np.repeat(w[here], size), self.n)
        if without is not None:
            cosine[np.arange(len(rare)), without] = 0.0


@dataclass
class ToxicityModel:
    """The examples' terms and their weights, the examples' unit vectors, labels and ids."""

    vocabulary: Vocabulary
    weight: np.ndarray
    examples: list[tuple[np.ndarray, np.ndarray]]
    labels: np.ndarray
    example_ids: np.ndarray
    line: tuple[float, float] = (0.0, 0.0)
    blank: float = 0.0
    index: BlockMaxIndex = field(init=False)

    def __post_init__(self):
        self.index = BlockMaxIndex(self.examples, len(self.weight))

    def __reduce__(self):  # the index is built anew where the model is read
        return ToxicityModel, (self.vocabulary, self.weight, self.examples, self.labels, self.example_ids, self.line, self.blank)

    def vote(self, cosines: np.ndarray, who: np.ndarray) -> float:
        """Share of label 1 among the neighbours, by the inverse of their cosine distance."""
        w = cosines / (1.05 - np.minimum(cosines, 1.0))
        return float((w * self.labels[who]).sum() / max(w.sum(), 1e-12))

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for lo in range(0, len(queries), TOGETHER):
            out += self.index.nearest(queries[lo : lo + TOGETHER], NEIGHBOURS, None if without is None else without[lo : lo + TOGETHER])
        return out

    def scored(self, texts: list[bytes | None]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """(score, cosines, example numbers) of each text."""
        a, b = self.line
        found = self.nearest([unit(*self.vocabulary.counts(t), self.weight) for t in texts])
        return [(float(1 / (1 + np.exp(-(a * self.vote(*x) + b)))) if len(x[1]) else self.blank, *x) for x in found]

    def calibrate(self, totals: tuple[int, int]) -> None:
        """A logistic curve from the votes that each example gets of the others to its label; the
        classes count as often as in the labels, of which the examples are a sample."""
        found = self.nearest(self.examples, np.arange(len(self.examples)))
        none = np.array([not len(who) for _, who in found], bool)
        raw, y = np.array([self.vote(*x) for x in found]), self.labels.astype(float)
        w = np.where(y > 0, totals[1] / max(1, (y > 0).sum()), totals[0] / max(1, (y == 0).sum()))
        prior = totals[1] / max(1, sum(totals))
        self.blank = float(((w * y)[none].sum() + prior) / (w[none].sum() + 1))
        x, t, w = raw[~none], y[~none], w[~none]
        smooth = np.where(t > 0, (w[t > 0].sum() + 1) / (w[t > 0].sum() + 2), 1 / (w[t == 0].sum() + 2))
        beta = np.array([1.0, 0.0])
        design = np.stack([x, np.ones_like(x)], axis=1)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
            grad = design.T @ (w * (p - smooth)) + 1e-2 * beta
            hess = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
            step = np.linalg.solve(hess, grad)
            beta = beta - np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break
        self.line = (float(beta[0]), float(beta[1]))


def association(t: np.ndarray, c: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Chi-square of each term with the label: it occurs in t of the toxic examples and c of the clean
    ones. Never negative, and 0 only where the shares are equal."""
    n, seen = toxic + clean, t + c
    below = np.maximum(float(toxic) * clean * seen * (n - seen), 1.0)
    return (t * float(clean) - c * float(toxic)) ** 2 * n / below


def sketch(text: bytes | None) -> np.ndarray:
    """The smallest of a text's word hashes under each of SKETCH mixings; equal ones estimate the
    share of words that two texts have in common."""
    words = {xxhash.xxh64_intdigest(w) for w in (text or b"").translate(WORDS).split()} or {0}
    h = np.fromiter(words, np.uint64, len(words))
    odd = np.random.default_rng(1).integers(1 << 62, size=(SKETCH, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return ((h[None, :] * odd) >> np.uint64(1)).min(axis=1).astype(np.int64)


def different(sketches: np.ndarray, order: np.ndarray) -> list[int]:
    """Rows, taken by order, that share less than half of their sketch with any row before them."""
    kept: list[int] = []
    for i in order.tolist():
        if not kept or ((sketches[kept] == sketches[i]).sum(axis=1) < SKETCH / 2).all():
            kept.append(i)
    return kept


def put(ws: Workspace, what, label: str) -> str:
    """Writes a value into the shared folder; `get` reads it once in each Python worker."""
    url = ws.path(label)
    store, path = fs.FileSystem.from_uri(url)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(pickle.dumps(what))
    return url


@functools.lru_cache(maxsize=1)
def get(url: str):
    store, path = fs.FileSystem.from_uri(url)
    with store.open_input_stream(path) as f:
        return pickle.loads(f.read())


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> str:
    """Where the shared folder has the model. It learns from about `sample` labelled rows of each
    class, drawn by a hash of their ids from those whose id's crc32 doesn't leave 1 by 3. A document
    with several labels is toxic if any says so; labels other than 0 and 1 are ignored; of texts that
    share an id the smallest counts.

    All terms of the examples are indexed. A term weighs its inverse document frequency, over all
    documents, times its chi-square with the labels of the examples."""
    spark = docs.sparkSession
    ws = Workspace(spark, "toxicity")
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & (crc_mod(F.col("doc_id"), 3) != 1))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    totals = dict(known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect())  # two rows
    total = (totals.get(0, 0), totals.get(1, 0))
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, sample / max(1, total[1])))).otherwise(F.lit(min(1.0, sample / max(1, total[0]))))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < share * (1 << 30)).limit(3 * sample)  # the sample's documented bound
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = plain.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # at most 3 * sample rows

    def outline(batches):
        for b in batches:
            texts = as_bytes(b.column(2))
            counts = [term_counts(t) for t in texts]
            yield batch_of(
                ["doc_id", "toxic", "sketch", "terms", "counts"],
                [b.column(0), b.column(1), [sketch(t).tolist() for t in texts], [b" ".join(c) for c in counts], [np.fromiter(c.values(), np.int32, len(c)).tobytes() for c in counts]],
                [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()],
            )

    drawn = sorted(rows.mapInArrow(outline, "doc_id long, toxic int, sketch array<long>, terms binary, counts binary").collect())
    # a copy of an example is no further evidence, neither for a word nor as a neighbour
    drawn = [drawn[i] for i in different(np.array([r[2] for r in drawn]), np.arange(len(drawn)))] if drawn else []
    numbers: dict[bytes, int] = {}
    found = []
    for r in drawn:
        terms = np.array([numbers.setdefault(t, len(numbers)) for t in bytes(r[3]).split()], np.int64)
        order = np.argsort(terms)
        found.append((terms[order], np.frombuffer(r[4], np.int32).astype(np.float64)[order]))
    y, own_ids = (np.array([r[c] for r in drawn], np.int64) for c in (1, 0))
    del drawn
    size, toxic = len(numbers), int(y.sum())
    hits = [np.bincount(np.concatenate([np.zeros(0, np.int64), *(t for (t, _), own in zip(found, y, strict=True) if own == label)]), minlength=size) for label in (1, 0)]
    vocabulary = Vocabulary(list(numbers))
    del numbers
    url = put(ws, vocabulary, "terms")

    def frequencies(batches):
        df, terms = np.zeros(size + 1, np.int64), get(url)
        for b in batches:
            df[size] += b.num_rows
            for t in as_bytes(b.column(0)):
                df[terms.counts(t)[0]] += 1
        some = np.flatnonzero(df)
        yield batch_of(["term", "n"], [some, df[some]], [pa.int32(), pa.int64()])

    each = plain.select("text").mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # two numbers for each term of the examples
    df = np.zeros(size + 1, np.float64)
    df[each.column("term").to_numpy()] = each.column("n").to_numpy()
    weight = (np.log((1 + df[size]) / (1 + df[:size])) + 1) * association(*hits, toxic, len(y) - toxic)
    vectors = [unit(*x, weight) for x in found]
    # examples of one class and one heaviest term share blocks, so that blocks' maxima tell them apart
    heaviest = [int(t[w.argmax()]) if len(t) else -1 for t, w in vectors]
    order = np.lexsort((heaviest, y)) if len(y) else np.zeros(0, np.int64)
    del found
    model = ToxicityModel(vocabulary, weight, [vectors[i] for i in order], y[order], own_ids[order])
    model.calibrate(total)
    return put(ws, model, "model")


def score(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, score, predicted, evidence) by the model that `fit` has written: evidence lists the
    nearest labelled examples that voted as (doc_id, cosine, label), best first. A text without terms
    of the examples, empty or null, gets the calibrated share of toxic ones among such examples, and
    no evidence."""
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int64())]))

    def run(batches):
        m = get(model)
        for b in batches:
            for lo in range(0, b.num_rows, TOGETHER):
                part = b.slice(lo, TOGETHER)
                found = m.scored(as_bytes(part.column(1)))
                score_ = np.array([x[0] for x in found])
                proof = [[{"doc_id": int(m.example_ids[i]), "cosine": float(s), "label": int(m.labels[i])} for s, i in zip(x[1], x[2], strict=True)] for x in found]
                yield batch_of(["doc_id", "score", "predicted", "evidence"], [part.column(0), score_, (score_ >= THRESHOLD).astype(np.int32), proof], [pa.int64(), pa.float64(), pa.int32(), kind])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int, evidence array<struct<doc_id:long,cosine:double,label:long>>")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of each row of docs.

    held_out is true where crc32 of the decimal doc_id leaves 1 by 3 (false for a null id). Only the
    text decides a score. Repeated rows each give a row; other columns are ignored; an empty table
    gives none. Without labels of both classes every score is the share of toxic labels.
    """
    found = score(docs, fit(docs, labels, sample))
    return found.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted", "evidence")


def op7_nearest_labelled_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("evidence")
