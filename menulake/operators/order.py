"""Numbers of rows in an order of the whole table, without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from menulake.storage import saved


def global_rank(df: DataFrame, order: list[Column], name: str = "pos", begin: int = 1) -> DataFrame:
    """df with its row number, from `begin`, in an order that should leave no ties.

    Rows are range partitioned by the order, so each task sorts a share; one count for each partition
    reaches the driver, and gives the partitions' first numbers.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = saved(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": at}), "ranked")
    starts, total = [], begin
    for part, count in sorted(rows.groupBy("_part").count().collect()):
        starts.append((part, total))
        total += count
    firsts = spark.createDataFrame(starts or [(0, begin)], "_part int, _start long")
    return rows.join(F.broadcast(firsts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")
