"""A training corpus in five stages: language, near-duplicates, repeated passages, benchmark, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from menulake.llm.common import Workspace, table
from menulake.llm.decontaminate import remove_benchmark
from menulake.llm.language import UNKNOWN, fit, identify
from menulake.llm.packing import packed
from menulake.llm.simhash import keep_one
from menulake.llm.suffix_dedup import remove_repeats

#: A document goes if its language is unknown or its score is below this.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known; it is learned from the stage's own input.

    Texts that are null, empty or without a letter go. Where no row has a lang to learn from, all
    others stay. Repeated rows and rows with a null doc_id are judged by their text like any other;
    columns named like the stage's own results are kept as they are; an empty table gives none."""
    model = fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    own = {c: f"_own_{c}" for c in ("lang_pred", "score") if c in docs.columns}
    found = identify(docs.withColumnsRenamed(own), model)
    sure = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).drop("lang_pred", "score")
    return sure.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class: five-word shingles, a similarity of 0.8 or more.

    The one with the smallest doc_id stays; of rows that repeat it the one with the smallest text. All
    null and blank texts are one class. Rows with a null doc_id stay; an empty table gives none."""
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 bytes and more that a document with a smaller id has.

    Null and empty texts are empty afterwards; a document that had words and keeps none goes. Rows
    that repeat a doc_id don't affect each other, and a null doc_id counts as the largest; n_chars
    follows the text; an empty table gives none."""
    return remove_repeats(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the benchmark's windows of ten words out of each text.

    A document that is nothing but benchmark keeps an empty text, and a null text stays null; every
    row stays, with its own id and columns, and n_chars follows the text."""
    return remove_benchmark(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences of 2048 tokens. A null or empty text is its end id
    alone; repeated rows and rows with a null doc_id are packed each; an empty table gives none."""
    return packed(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("packing", packing),
]

#: SQL can't express the classifier, the tokenizer or suffix arrays.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
