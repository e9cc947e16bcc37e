"""Reports as files: Markdown tables and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def markdown_lines(df: DataFrame) -> DataFrame:
    """df's rows as rows of a Markdown table, in one column; null is empty, | and line ends are escaped."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|"), r"[\r\n]+", " ")
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, df.columns)), F.lit(" |")).alias("value"))


def write_markdown(df: DataFrame, path: str, title: str, summary: dict[str, object] | None = None) -> None:
    """A folder with one Markdown file: title, summary lines, and df as a table, in df's order.

    A report is one file by its nature, so df should be one that people read: an aggregate or a
    limited list."""
    spark = df.sparkSession
    head = [f"# {title}", "", *[f"- {k}: {v}" for k, v in (summary or {}).items()], *([""] if summary else []), f"| {' | '.join(df.columns)} |", f"| {' | '.join('---' for _ in df.columns)} |"]
    lines = spark.createDataFrame([(x,) for x in head], "value string").coalesce(1)
    lines.unionByName(markdown_lines(df.coalesce(1))).coalesce(1).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, null fields written, in as many files as df has partitions."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
