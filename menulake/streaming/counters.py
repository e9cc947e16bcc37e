"""Day counters and a throttle over a stream of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from menulake.storage import fresh_path


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """Files that match pattern in a folder, as a stream of their rows."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def day_counters(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(user_id, day, clicks, views) by UTC day; rows later than `late` are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = timed.groupBy("user_id", F.window("ts", "1 day")).agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "view").alias("views"))
    return counts.select("user_id", F.to_date("window.start").cast("string").alias("day"), "clicks", "views")


def throttled(events: DataFrame, gap_us: int = 1_000_000, late: str = "1 hour") -> DataFrame:
    """Accepted events (user_id, event_type, event_id): the last accepted time is a key's state.

    The input of a micro-batch is decided in order of time; its state is one number a key, which goes
    when the watermark has passed the time up to which it matters."""

    def decide(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["us", "event_id"])
        keep = []
        for t in rows["us"]:
            ok = last is None or t - last >= gap_us
            keep.append(ok)
            last = int(t) if ok else last
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max((last + gap_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield rows[keep].assign(user_id=key[0], event_type=key[1])[["user_id", "event_type", "event_id"]]

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = timed.select("user_id", "event_type", "event_id", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id", "event_type").applyInPandasWithState(decide, "user_id long, event_type string, event_id long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def session_firsts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events of each (user_id, k) that weren't seen before within the watermark: one view a session."""
    timed = events.where("event_type = 'view'").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    keyed = timed.withColumn("k", F.get_json_object("props", "$.k"))
    return keyed.dropDuplicatesWithinWatermark(["user_id", "k"]).select("user_id", "k")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now into files in the shared folder, with its checkpoint there
    too, and returns them. In complete mode each micro-batch replaces the table."""
    spark = stream.sparkSession
    out, checkpoint = fresh_path(spark, "stream"), fresh_path(spark, "stream-checkpoint")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "complete":
        writer = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
        writer.start().awaitTermination()
    else:
        writer.format("parquet").option("path", out).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
