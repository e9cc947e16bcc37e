"""Reducers over append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order; the caller names enough columns to leave no ties.

    One shuffle on the keys; the group limit below the window keeps one row a key from each task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def changes(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """Rows whose value differs from the one before in their key; nulls are values too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_old", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w))
    return marked.where((F.col("_n") > 1) & ~F.col(value).eqNullSafe(F.col("_old"))).drop("_old", "_n")
