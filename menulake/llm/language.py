"""Language identification in two steps: the family, then one-versus-one linear SVMs within it."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from menulake.llm.common import LOWER, as_bytes, batch_of, crc_mod, table

UNKNOWN = "und"

# Families of closely related languages. A language that isn't named is a family.
FAMILIES = {
    "germanic": "en de nl af fy lb sv da nb nn no is fo".split(),
    "romance": "es fr it pt ca gl ro oc".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "uralic": "fi et hu".split(),
    "baltic": "lt lv".split(),
    "turkic": "tr az kk uz".split(),
    "indic": "hi mr ne bn".split(),
    "iranian": "fa ku ps".split(),
    "semitic": "ar he mt".split(),
}

#: Hashed features of a text, and labelled documents that are learned from: for each language, and
#: of all languages together.
DIM, SAMPLE, TOTAL = 4096, 400, 12_000
#: What may be a letter: signs such as fractions are numbers, but match as well.
LETTER = re.compile(r"[^\W\d_]")
#: A-Z lowered, and ASCII that isn't a letter as a space.
TO_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() and b < 0x80 else 0x20 for b in LOWER)


def has_letter(text: bytes) -> bool:
    """Whether a text has a character of Unicode's category L."""
    return any(m[0].isalpha() for m in LETTER.finditer(text.decode()))


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), f"only {lang}")


def features(text: bytes) -> np.ndarray:
    """Counts of hashed byte n-grams of 2 to 4, words delimited by spaces, damped and of length 1."""
    letters = b" " + b" ".join(text.translate(TO_LETTERS).split()) + b" "
    out = np.zeros(DIM)
    step = 1 << 20
    for at in range(0, len(letters), step):  # a long text piece by piece; n-grams overlap the cuts
        a = np.frombuffer(letters[at : at + step + 3], np.uint8).astype(np.uint32)
        two = a[:-1] * np.uint32(257) + a[1:]
        grams = [two[: step], (two[:-1] * np.uint32(263) + a[2:])[: step]]
        grams.append((grams[1][: len(a) - 3] * np.uint32(269) + a[3:])[: step])
        for n, g in enumerate(grams):
            h = (g + np.uint32(n * 0x51ED)) * np.uint32(2654435761)
            out += np.bincount(h >> np.uint32(20), minlength=DIM)
    out = np.sqrt(out)
    norm = np.sqrt(out @ out)
    return out / norm if norm else out


def train_svm(x: np.ndarray, y: np.ndarray, rounds: int = 150, c: float = 10.0) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, classes weighed alike, by accelerated gradient steps."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    y = y.astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    b = look_b = np.float32(0)
    look, t, rate = w.copy(), 1.0, np.float32(1.0 / (1 / c + 4.0))
    for _ in range(rounds):
        pull = weight * y * np.maximum(0, 1 - y * (x @ look + look_b))
        new = look - rate * (look / np.float32(c) - 2 * (pull @ x))
        new_b = look_b - rate * (look_b / np.float32(c) - 2 * pull.sum())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        step = np.float32((t - 1) / t2)
        look, look_b, w, b, t = new + step * (new - w), new_b + step * (new_b - b), new, new_b, t2
    return w.astype(np.float64), float(b)


@dataclass
class LanguageModel:
    """One-versus-rest SVMs for families, one-versus-one SVMs for the languages of each."""

    families: dict[str, list[str]]
    names: list[str]
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, labels: list[str]) -> LanguageModel:
        families: dict[str, list[str]] = {}
        for lang in sorted(set(labels)):
            families.setdefault(family_of(lang), []).append(lang)
        labels_, fams = np.array(labels), np.array([family_of(lang) for lang in labels])
        names, weights, bias = [], [], []

        def add(name: str, rows: np.ndarray, y: np.ndarray) -> None:
            w, b = train_svm(x if len(rows) == len(x) else x[rows], y)
            names.append(name)
            weights.append(w)
            bias.append(b)

        for f in families if len(families) > 1 else ():
            add(f"family {f}", np.arange(len(x)), np.where(fams == f, 1, -1))
        for members in families.values():
            for a, b in combinations(members, 2):
                rows = np.flatnonzero((labels_ == a) | (labels_ == b))
                add(f"{a} {b}", rows, np.where(labels_[rows] == a, 1, -1))
        return cls(families, names, np.array(weights).reshape(len(names), -1), np.array(bias))

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The language, and how sure: the family's share times the language's share of votes."""
        margin = dict(zip(self.names, self.weights @ x + self.bias, strict=True)) if self.names else {}
        sure = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -50, 50)))
        fam = {f: sure(margin.get(f"family {f}", 50.0)) for f in self.families}
        best = max(fam, key=lambda f: fam[f])
        members = self.families[best]
        votes = {lang: 1.0 for lang in members}
        for a, b in combinations(members, 2):
            p = sure(margin[f"{a} {b}"])
            votes[a] *= p
            votes[b] *= 1 - p
        lang = max(votes, key=lambda k: votes[k])
        return lang, float(fam[best] / max(sum(fam.values()), fam[best]) * votes[lang] / (sum(votes.values()) or 1.0))


def fit(docs: DataFrame, sample: int = SAMPLE, total: int = TOTAL) -> LanguageModel | None:
    """Learns from `sample` documents of each language at most, and `total` of all languages together
    (one of each language at least), drawn by a hash of their ids and texts; of the documents with a
    text and a lang and a remainder of the id's crc32 by 4 other than 2. Rows that repeat an id and
    a text count once. None if there is nothing to learn from."""
    learn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), 4) != 2))
    counts = dict(learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each language
    if not counts:
        return None
    each = max(1, min(sample, total // len(counts)))
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 1.5 * each / n)))])
    learn = learn.withColumn("drawn", F.xxhash64("doc_id", "text", F.lit(5)))
    drawn = learn.where(F.pmod("drawn", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    # copies of a row have one hash, which counts once before anything else is read of them
    numbers = sorted(map(tuple, drawn.select("lang", "drawn").distinct().collect()), key=lambda r: (r[0], r[1]))  # about 1.5 * each of two words a language
    seen: Counter = Counter()
    picked = [r for r in numbers if seen.update((r[0],)) or seen[r[0]] <= each]
    spark = docs.sparkSession
    rows = drawn.select("lang", "drawn", "text").join(F.broadcast(spark.createDataFrame(picked or [("", 0)], "lang string, drawn long")), ["lang", "drawn"])  # at most `total` rows or one a language

    def run(batches):
        for b in batches:
            texts = as_bytes(b.column(2))
            ok = [i for i, t in enumerate(texts) if has_letter(t)]
            data = [features(texts[i]).astype(np.float32).tobytes() for i in ok]
            yield batch_of(["lang", "drawn", "x"], [*(b.column(c).take(pa.array(ok, pa.int64())) for c in range(2)), data], [pa.string(), pa.int64(), pa.binary()])

    found = rows.mapInArrow(run, "lang string, drawn long, x binary").groupBy("lang", "drawn").agg(F.first("x").alias("x")).collect()
    if not found:
        return None
    found.sort(key=lambda r: (r[0], r[1]))
    x = np.frombuffer(b"".join(r[2] for r in found), np.float32).reshape(len(found), DIM)
    labels = [r[0] for r in found]
    del found
    return LanguageModel.fit(x, labels)


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """docs with lang_pred and score. A text that is null or has no letter, and any text when there
    was nothing to learn from, is `und` with score 0. Only the text decides."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    plain = docs.select(*names)
    at = names.index("text")

    def run(batches):
        for b in batches:
            pred, score = [], []
            for t in as_bytes(b.column(at)):
                found = model.predict(features(t)) if model and t and has_letter(t) else (UNKNOWN, 0.0)
                pred.append(found[0])
                score.append(min(1.0, max(0.0, found[1])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    schema = plain.limit(0).withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    return plain.mapInArrow(run, schema)


def predict_languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of docs, which needs doc_id, text and lang.

    held_out is true where crc32 of the decimal doc_id leaves 2 by 4 (false for a null id; rows with
    one aren't learned from either). Repeated rows each give a row; an empty table gives none; other
    columns, and columns named like the results, are ignored.
    """
    found = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), fit(docs, sample))
    return found.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_hierarchical_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))
