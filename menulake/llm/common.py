"""Plumbing shared by the training-data operators: a shared workspace, global ranks, components."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a single-process session (local[...]) without that setting gets a folder of its own.
    """
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


#: Rows that travel to Python at once at most while a table is saved; they are held on both sides,
#: with their whole texts. (Their bytes are bounded by the session's own setting.)
ARROW_ROWS = 2000
_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Workspace:
    """Intermediate tables in the shared folder. A saved table survives the loss of executors.

    Results read from the workspace, so its folder stays while the session lives, and is deleted when
    the driver ends. Settings of the session are as before after each call."""

    open: list[Workspace] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/menulake-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        if not Workspace.open:
            atexit.register(Workspace.clean)
        Workspace.open.append(self)

    @classmethod
    def clean(cls) -> None:
        """Deletes the folders of all workspaces; nothing may read from them any more."""
        while cls.open:
            with contextlib.suppress(Exception):  # it may hold nothing
                store, path = fs.FileSystem.from_uri(cls.open.pop().root)  # the session may have ended before
                store.delete_dir(path)

    def path(self, label: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{label}"

    def save(self, df: DataFrame, label: str = "t") -> DataFrame:
        """Write df as Parquet and read it again; the result has no lineage beyond the files."""
        path = self.path(label)
        rows = int(self.spark.conf.get(_ROWS_KEY))
        try:
            self.spark.conf.set(_ROWS_KEY, str(min(rows, ARROW_ROWS) if rows > 0 else ARROW_ROWS))
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_ROWS_KEY, str(rows))
        out = self.spark.read.schema(df.schema).parquet(path)
        out._menulake_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that nothing reads any more."""
        for t in tables:
            self.delete(t._menulake_path)

    def delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


class Answers:
    """Small rows for tasks that read a saved table again, in a folder for each partition that wrote it,
    so that the table itself isn't shuffled: `write` files them by `part`, and a task that comes upon
    rows of a part reads its answers, sorted by `order`."""

    def __init__(self, path: str, order: list[str]):
        self.path, self.order, self.part = path, order, None

    @classmethod
    def write(cls, ws: Workspace, answers: DataFrame, order: list[str], label: str) -> Answers:
        path = ws.path(label)
        answers.repartition(shuffle_partitions(ws.spark), "part").sortWithinPartitions("part", *order).write.partitionBy("part").parquet(path)
        return cls(path, order)

    def of(self, part: int) -> pa.Table | None:
        """The answers of a part; None if it has none."""
        if self.part != part:
            store, root = fs.FileSystem.from_uri(f"{self.path}/part={part}")
            there = store.get_file_info(root).type != fs.FileType.NotFound
            self.table = ds.dataset(root, filesystem=store, format="parquet").to_table().sort_by([(c, "ascending") for c in self.order]) if there else None
            self.part = part
        return self.table


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(ws: Workspace, df: DataFrame, *keys, name: str = "rank", n: int | None = None, copies: bool = False) -> DataFrame:
    """df with its global row number (from 0) in the order of keys, as a saved table.

    Range partitioning deals rows evenly whatever the keys' skew, as long as the keys together are
    (nearly) unique; one count per partition, not per row, reaches the driver. copies: many rows may
    agree in all keys; they are told apart by their place in the input, which must be read as it is
    stored (a task that runs again must find its rows in the same places).
    """
    spark = ws.spark
    n = n or shuffle_partitions(spark)
    ties = [F.col("_tie")] if copies else []
    out = ws.save(
        (df.withColumn("_tie", F.monotonically_increasing_id()) if copies else df)
        .repartitionByRange(n, *keys, *ties)
        .sortWithinPartitions(*keys, *ties)
        .drop("_tie")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "ranked",
    )
    counts = dict(out.groupBy("_part").agg(F.count(F.lit(1)).alias("c")).collect())
    offsets, total = [], 0
    for p in sorted(counts):
        offsets.append((p, total))
        total += counts[p]
    starts = spark.createDataFrame(offsets or [(0, 0)], "_part int, _start long")
    res = out.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")
    res._menulake_path, res._menulake_rows = out._menulake_path, total
    return res


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, component), the smallest node.

    Each round every node picks one node of its closed neighbourhood and the graph is contracted
    onto the picks: first the smallest node, so that stars vanish at once, then the one with the
    smallest seeded hash, which in expectation removes a constant share of nodes on any graph.
    Rounds are saved tables; nothing but row counts reaches the driver.
    """

    def tidy(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    edges = ws.save(tidy(edges), "edges")
    labels, rnd = None, 0
    while not edges.isEmpty():
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))).alias("x")).select("x.*")
        order = F.col("u") if rnd == 0 else F.xxhash64("u", F.lit(rnd))
        own = F.col("v") if rnd == 0 else F.xxhash64("v", F.lit(rnd))
        best = both.groupBy("v").agg(F.min_by("u", order).alias("u"))
        near = order <= own
        parent = ws.save(best.select("v", F.when(near, F.col("u")).otherwise(F.col("v")).alias("p")), "parent")
        if labels is None:
            old, labels = None, parent.select(F.col("v").alias("node"), F.col("p").alias("label"))
            labels._menulake_path = parent._menulake_path
        else:
            old = labels
            step = parent.withColumnRenamed("v", "label")
            labels = ws.save(old.join(step, "label", "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
        pa_, pb_ = parent.toDF("a", "pa"), parent.toDF("b", "pb")
        nxt = ws.save(tidy(edges.join(pa_, "a").join(pb_, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))), "edges")
        ws.drop(edges)
        if old is not None:
            ws.drop(old, parent)
        edges, rnd = nxt, rnd + 1
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # saved, so that the join deals out the nodes of a large component anew
    least = ws.save(labels.groupBy("label").agg(F.min("node").alias("component")), "least")
    return labels.join(least, "label").select("node", "component")


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def batch_of(names: list[str], columns: list, types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)


LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def crc_mod(doc_id, n: int):
    """crc32 of the decimal doc_id, modulo n, as a Column; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
