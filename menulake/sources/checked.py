"""Sources that must be what was expected, or fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from menulake.functions.canonical import content_hash


def single_row(df: DataFrame) -> DataFrame:
    """df's only row; an error if there is none, or more than one."""
    names = df.columns
    one = df.agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*names)).alias("row"))
    kind = df.select(F.struct(*names).alias("x")).schema["x"].dataType.simpleString()
    failed = F.raise_error(F.concat(F.lit("expected one row, found "), F.col("n"))).cast(kind)
    return one.select(F.when(F.col("n") == 1, F.col("row")).otherwise(failed).alias("row")).select("row.*")


def with_hash(df: DataFrame, columns: list[str], expected: str) -> DataFrame:
    """df, whose columns must have the expected canonical hash in every row; an error otherwise."""
    own: Column = content_hash(df, columns)
    failed = F.raise_error(F.concat(F.lit("unexpected content "), own)).cast("string")
    return df.withColumn("content_hash", F.when(own == expected, own).otherwise(failed))


def with_missing(df: DataFrame, schema: StructType) -> DataFrame:
    """df's columns in the order of a schema; a column that an older source hasn't is null, one that the
    schema doesn't know is left out."""

    def column(f: StructField) -> Column:
        return (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)

    return df.select(*map(column, schema.fields))
