"""Intermediate and result tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


@atexit.register
def clean() -> None:
    """Deletes what was written; called when the driver ends, as results read from it until then."""
    while _made:
        with contextlib.suppress(Exception):  # it may never have been written
            store, path = fs.FileSystem.from_uri(_made.pop())
            store.delete_dir(path)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a single-process session without it gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = "file://" + tempfile.mkdtemp(prefix="menulake-")
    spark.conf.set("spark.checkpoint.dir", base)
    atexit.register(shutil.rmtree, base[len("file://") :], ignore_errors=True)
    return base


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder's name in the shared folder; it goes when the driver ends."""
    _made.append(f"{shared_dir(spark)}/menulake-{label}-{uuid.uuid4().hex[:12]}")
    return _made[-1]


#: Bytes that travel to Python at once while a table is saved whose rows are whole texts; they are held
#: several times over, on both sides.
TEXT_BYTES = 4 << 20
_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def saved(df: DataFrame, label: str = "table", batch_bytes: int | None = None) -> DataFrame:
    """df written as Parquet and read again: it survives lost executors, and has no lineage but files.

    batch_bytes: what Python functions of df get at once, at most; the session's own setting is as before
    afterwards."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    own = spark.conf.get(_BYTES_KEY, None)
    try:
        if batch_bytes:
            spark.conf.set(_BYTES_KEY, str(batch_bytes))
        df.write.parquet(path)
    finally:
        if batch_bytes:
            spark.conf.unset(_BYTES_KEY) if own is None else spark.conf.set(_BYTES_KEY, own)
    return spark.read.schema(df.schema).parquet(path)
