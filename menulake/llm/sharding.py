"""Proportional stratified interleaving: shards that all match the mixture of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from menulake.llm.common import Workspace, ranked, table


def interleaved(docs: DataFrame, shards: int = 16, seed: int = 7, stratum: str = "source") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): law `rows`, counts of rows at most one apart.

    Within each source (null is one of its own) rows are ranked in a seeded shuffle; rank r of n
    becomes the fraction (2 r + 1) / 2 n; all rows are sorted by fraction and cut into shards of
    equal counts, so every shard holds each source's share within one row or so. Equal texts aren't
    kept together: a group of a third of all rows couldn't be in shards of equal counts.

    size is the text's UTF-8 bytes plus 1, text_crc32 their crc32 (null: that of no bytes). Ties in
    the shuffle go by doc_id, then by the text's size and crc32; rows that agree in all of it give
    the same output in either order. Repeated rows are ranked each; other columns are ignored.

    Both sorts are range partitioned by keys that are nearly unique, and move no text; a source of
    any size is spread over all partitions.
    """
    ws = Workspace(docs.sparkSession, "sharding")
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(stratum).cast("string").alias("stratum"),
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
    ).withColumn("shuffled", F.substring(F.md5(F.concat_ws("|", "doc_id", "size", "text_crc32", F.lit(seed))), 1, 16))
    first = ranked(ws, rows, "stratum", "shuffled", "doc_id", "size", "text_crc32", name="row", copies=True)
    starts = ws.save(first.groupBy("stratum").agg(F.min("row").alias("start"), F.count(F.lit(1)).alias("n")), "strata")
    within = first.join(starts, first["stratum"].eqNullSafe(starts["stratum"])).drop(starts["stratum"])
    fraction = (2 * (F.col("row") - F.col("start")) + 1) / (2 * F.col("n"))
    second = ranked(ws, within.select("doc_id", "size", "text_crc32", "stratum", "row", fraction.alias("fraction")), "fraction", "stratum", "row")
    ws.delete(first._menulake_path)
    total = max(1, second._menulake_rows)
    placed = second.withColumn("shard", F.expr(f"cast(rank * {shards}L div {total}L as int)"))
    begin = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - begin).alias("slot"))


def op2_stratified_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = interleaved(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The same for DuckDB, which has no crc32: it is taken byte by byte, by a table that its rule gives.
ORACLE = """WITH tab AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(CAST(x AS BIGINT), range(8)), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END)) AS t),
    h AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS x FROM documents),
    d AS (SELECT doc_id, source, CAST(length(x) // 2 + 1 AS BIGINT) AS size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT)) AS text_crc32 FROM h, tab),
    s AS (SELECT *, substr(md5(concat_ws('|', doc_id, size, text_crc32, 7)), 1, 16) AS shuffled FROM d),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY shuffled, doc_id) - 1 AS at_, count(*) OVER (PARTITION BY source) AS n FROM s),
    o AS (SELECT *, row_number() OVER (ORDER BY CAST(2 * at_ + 1 AS DOUBLE) / (2 * n), source NULLS FIRST, at_) - 1 AS rank, count(*) OVER () AS total FROM r),
    p AS (SELECT *, rank * 16 // total AS shard FROM o)
    SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(rank - (shard * total + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p"""
