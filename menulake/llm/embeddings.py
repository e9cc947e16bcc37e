"""Embedding near-duplicates by sorted projection passes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from menulake.llm.common import Workspace, batch_of, components, ranked, table

#: Rows compared on either side of a row in a sorted pass, rows in a block of a pass, share of pairs
#: at the threshold that the passes must find, bits of a concatenated hash, and classes in a block
#: when links are counted.
WINDOW, BLOCK, TARGET, HASH_BITS, COUNT_BLOCK = 512, 8192, 0.9995, 48, 4096
#: Components of unit vectors as the passes carry them: multiples of the largest one's 32767th part.
STEPS = 32767
#: Vectors that are hashed in one product, and rows of a product of vectors.
HASHED, STRIP = 1024, 512


def passes_for(rows: int, threshold: float, window: int = WINDOW, target: float = TARGET) -> int:
    """Passes that bring a pair at the threshold into a common window with probability target.

    A random hyperplane parts such a pair with probability p = angle / pi. About log2(rows /
    window) leading hashes tell a window from the rest, so a pass succeeds with (1 - p) to that.
    """
    bits = max(1.0, math.log2(max(2.0, rows / window)) + 1)
    one = (1 - math.acos(threshold) / math.pi) ** bits
    return max(4, math.ceil(math.log(1 - target) / math.log(1 - min(one, 0.9))))


def hyperplanes(passes: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, passes, dim]).standard_normal((dim, passes * HASH_BITS))


def unit_rows(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, unit vectors in double) of the rows that can link at all, for each length."""
    column = column.cast(pa.large_list(pa.float64()))
    ends = column.offsets.to_numpy()
    begins, sizes = ends[:-1], np.diff(ends)
    values = column.values.to_numpy(zero_copy_only=False)  # a null component is NaN
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    out = []
    for dim in np.unique(sizes[valid & (sizes > 0)]).tolist():
        at = np.flatnonzero(valid & (sizes == dim))
        x = values[begins[at][:, None] + np.arange(dim)]
        top = np.abs(x).max(axis=1)
        good = np.isfinite(top) & (top > 0)
        x = x[good] / top[good, None]  # so that the squares neither overflow nor vanish
        out.append((at[good], x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]))
    return out


def classes(ws: Workspace, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their vector's key, and one row per different vector: key, id, copies, unit, dim.

    Vectors equal in all components are a class, so copies are never compared with each other."""

    def run(batches):
        for b in batches:
            for at, units in unit_rows(b.column(1)):
                yield batch_of(["vec_id", "unit", "dim"], [b.column(0).take(pa.array(at)), [u.tobytes() for u in units], np.full(len(at), units.shape[1])], [pa.int64(), pa.binary(), pa.int32()])

    usable = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, unit binary, dim int")
    rows = ws.save(usable.withColumn("key", F.sha2("unit", 256)), "vectors")
    return rows.select("vec_id", "key"), ws.save(rows.groupBy("key").agg(F.first("unit").alias("unit"), F.first("dim").alias("dim"), F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")), "classes")


def stacked(rows: pa.Array | list, kind=np.float64) -> np.ndarray:
    """Binary rows of equal length as a matrix."""
    data = rows.to_pylist() if isinstance(rows, pa.Array) else rows
    return np.frombuffer(b"".join(data), kind).reshape(len(data), -1)


def hashes(ws: Workspace, one: DataFrame, passes: int, seed: int) -> DataFrame:
    """(no, dim, pass, code): a concatenated hash of each vector for each pass, without the vector."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        weights = np.int64(1) << np.arange(HASH_BITS - 1, -1, -1, dtype=np.int64)
        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in planes:
                    planes[dim] = hyperplanes(passes, dim, seed)
                of_dim = np.flatnonzero(dims == dim)
                for lo in range(0, len(of_dim), HASHED):
                    at = pa.array(of_dim[lo : lo + HASHED])
                    above = stacked(b.column(1).take(at)) @ planes[dim] > 0
                    codes = above.reshape(len(at), passes, HASH_BITS) @ weights
                    yield batch_of(["no", "dim", "pass", "code"], [np.repeat(b.column(0).take(at).to_numpy(), passes), np.full(codes.size, dim), np.tile(np.arange(passes), len(at)), codes.ravel()], [pa.int64(), pa.int32(), pa.int32(), pa.int64()])

    return one.select("no", "unit", "dim").mapInArrow(run, "no long, dim int, pass int, code long")


def small(one: DataFrame) -> DataFrame:
    """(no, steps, scale, off): each unit vector in 16 bits a component, and its distance from that."""

    def run(batches):
        for b in batches:
            steps, scale, off = [], [], []
            for data in b.column(1).to_pylist():
                x = np.frombuffer(data, np.float64)
                s = np.abs(x).max() / STEPS
                q = np.rint(x / s)
                steps.append(q.astype(np.int16).tobytes())
                scale.append(s)
                off.append(np.linalg.norm(x - s * q))
            yield batch_of(["no", "steps", "scale", "off"], [b.column(0), steps, scale, off], [pa.int64(), pa.binary(), pa.float64(), pa.float64()])

    return one.select("no", "unit").mapInArrow(run, "no long, steps binary, scale double, off double")


def find_root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def forest(units: np.ndarray, off: np.ndarray, first: int, window: int, threshold: float) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(sure, doubtful) pairs (i, j) of rounded unit vectors, each `off` from its true one at most.

    Rows from first on are compared with the `window` rows before them. Of the pairs that surely
    reach the threshold there are enough to connect what all of them would; of those too near to it
    to tell, all that the sure ones don't connect."""
    n = len(units)
    parent = np.arange(n)
    sure, doubtful = [], []
    for lo in range(first, n, STRIP):
        hi, begin = min(n, lo + STRIP), max(0, lo - window)
        cosine = units[lo:hi] @ units[begin:hi].T
        slack = off[lo:hi, None] + off[None, begin:hi] + off[lo:hi, None] * off[None, begin:hi] + 1e-12
        i, j = np.nonzero(cosine + slack >= threshold)
        certain = cosine[i, j] - slack[i, j] >= threshold
        i, j = i + lo, j + begin
        keep = (j < i) & (i - j <= window)
        for a, b in zip(i[keep & certain].tolist(), j[keep & certain].tolist(), strict=True):
            ra, rb = find_root(parent, a), find_root(parent, b)
            if ra != rb:
                parent[ra] = rb
                sure.append((a, b))
        doubtful += zip(i[keep & ~certain].tolist(), j[keep & ~certain].tolist(), strict=True)
    return sure, [(a, b) for a, b in doubtful if find_root(parent, a) != find_root(parent, b)]


def window_edges(ws: Workspace, one: DataFrame, rows: int, threshold: float, window: int, block: int, seed: int) -> DataFrame:
    """Edges (a, b) from all passes: (pass, hash) is sorted without the vectors and cut into blocks of
    equal counts, each with the window before it; then each block fetches its vectors, rounded.
    Pairs too near to the threshold to tell are verified on the whole vectors."""
    order = ranked(ws, hashes(ws, one, passes_for(rows, threshold, window), seed), "dim", "pass", "code", "no", name="row")
    own = F.expr(f"row div {block}L")
    late = F.col("row") % block >= block - window
    dealt = order.select("no", "dim", "pass", "row", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))).alias("block")).join(small(one), "no")

    def compare(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        number = key[0].as_py()
        t = t.sort_by("row")
        row, dim, turn, no = (t.column(c).to_numpy() for c in ("row", "dim", "pass", "no"))
        edges: list[tuple[int, int, bool]] = []
        cuts = np.flatnonzero(np.concatenate([[True], (dim[1:] != dim[:-1]) | (turn[1:] != turn[:-1]), [True]]))
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            first = int(np.searchsorted(row[s:e], number * block))
            if first < e - s:
                units = stacked(t.column("steps").slice(s, e - s).to_pylist(), np.int16) * t.column("scale").slice(s, e - s).to_numpy()[:, None]
                sure, doubtful = forest(units, t.column("off").slice(s, e - s).to_numpy(), first, window, threshold)
                edges += [(no[s + i], no[s + j], certain) for pairs, certain in ((sure, True), (doubtful, False)) for i, j in pairs]
        return pa.table({"a": pa.array([x[0] for x in edges], pa.int64()), "b": pa.array([x[1] for x in edges], pa.int64()), "sure": pa.array([x[2] for x in edges], pa.bool_())})

    found = ws.save(dealt.select("block", "row", "dim", "pass", "no", "steps", "scale", "off").groupBy("block").applyInArrow(compare, "a long, b long, sure boolean"), "pairs")
    ws.delete(order._menulake_path)

    def verify(batches):
        for b in batches:
            keep = [float(np.frombuffer(x, np.float64) @ np.frombuffer(y, np.float64)) >= threshold for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    unit = one.select("no", "unit")
    doubtful = found.where("not sure").select("a", "b").distinct().join(unit.toDF("a", "x"), "a").join(unit.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return found.where("sure").select("a", "b").distinct().unionByName(doubtful.mapInArrow(verify, "a long, b long"))


def degrees(ws: Workspace, members: DataFrame, threshold: float, block: int = COUNT_BLOCK) -> DataFrame:
    """(id, n): rows linked to each class by comparing all classes of each component, in blocks.

    members: id, unit, copies, component. A component of up to `block` classes is one unit of work;
    a larger one is cut into blocks, and each pair of blocks is a unit of its own."""
    order = ranked(ws, members, "component", "id", name="row")
    starts = ws.save(order.groupBy("component").agg(F.min("row").alias("start"), F.count(F.lit(1)).alias("size")), "sizes")
    own = order.join(starts, "component").withColumn("own", F.expr(f"cast((row - start) div {block} as int)")).withColumn("last", F.expr(f"cast((size - 1) div {block} as int)"))
    others = F.transform(F.sequence(F.lit(0), F.col("last")), lambda o: F.struct(F.least(o, F.col("own")).alias("lo"), F.greatest(o, F.col("own")).alias("hi")))
    # small components share a task's group: many of them come to one call, of about `block` rows
    bins = order._menulake_rows // block + 1
    units = own.select("id", "unit", "copies", "component", "own", F.explode(others).alias("pair"), (F.when(F.col("last") == 0, F.pmod(F.xxhash64("component"), F.lit(bins)))).alias("bin"))
    grouped = units.withColumn("unit_of_work", F.when(F.col("bin").isNotNull(), F.concat(F.lit("s"), F.col("bin"))).otherwise(F.concat_ws("-", "component", "pair.lo", "pair.hi")))

    def linked(x: np.ndarray, y: np.ndarray, mine: np.ndarray, theirs: np.ndarray, copies: np.ndarray, back: np.ndarray) -> np.ndarray:
        """For each row of x the copies linked in y; back gets the same the other way."""
        out = np.zeros(len(x), np.int64)
        for lo in range(0, len(x), STRIP):
            near = (x[lo : lo + STRIP] @ y.T >= threshold) | (mine[lo : lo + STRIP, None] == theirs[None, :])
            out[lo : lo + STRIP] = near @ copies[1]
            back += copies[0][lo : lo + STRIP] @ near
        return out

    def count(pdf):
        import pandas as pd

        out = []
        for _, g in pdf.groupby("component", sort=False):
            x = stacked(g["unit"].tolist())
            ids, copies, at = g["id"].to_numpy(), g["copies"].to_numpy(), g["own"].to_numpy()
            lo, hi = int(g["lo"].iloc[0]), int(g["hi"].iloc[0])
            left, right = at == lo, at == hi
            back = np.zeros(int(right.sum()), np.int64)
            n = linked(x[left], x[right], ids[left], ids[right], (copies[left], copies[right]), back)
            out.append(pd.DataFrame({"id": ids[left], "n": n}))
            if lo != hi:
                out.append(pd.DataFrame({"id": ids[right], "n": back}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "n": []}).astype("int64")

    flat = grouped.select("unit_of_work", "id", "unit", "copies", "component", "own", F.col("pair.lo").alias("lo"), F.col("pair.hi").alias("hi"))
    return flat.groupBy("unit_of_work").applyInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def embedding_components(vectors: DataFrame, threshold: float = 0.95, window: int = WINDOW, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id): classes of vectors linked by cosine >= threshold.

    Cosines are taken in double precision; vectors of different lengths are never linked. Null,
    empty and zero vectors and those with null or non-finite components link with nothing. Equal
    vectors are linked; rows that repeat a vec_id each give a row and count as different vectors.
    Rows with a null vec_id give a row and count as links, but name no component. An empty table
    gives no rows; other columns are ignored.

    Passes find components; every link inside a component is then counted, so n_links lacks only
    links between vectors that no chain of found links connects.
    """
    ws = Workspace(vectors.sparkSession, "embeddings")
    rows, found = classes(ws, vectors)
    # a class needs a number of its own where its vec_id is null or repeated
    one = ranked(ws, found, "id", "key", name="no")
    edges = window_edges(ws, one, one._menulake_rows, threshold, window, block, seed)
    comps = ws.save(components(ws, edges).withColumnRenamed("node", "no"), "components")
    members = one.join(comps, "no").select(F.col("no").alias("id"), "unit", "copies", "component")
    counts = ws.save(degrees(ws, members, threshold), "degrees")
    named = one.join(comps, "no", "left").withColumn("component", F.coalesce("component", "no"))
    firsts = named.groupBy("component").agg(F.min("id").alias("component_id"))
    per_class = ws.save(
        named.join(firsts, "component").join(counts.toDF("no", "n"), "no", "left").select("key", (F.coalesce("n", "copies") - 1).alias("n_links"), "component_id"), "per-class"
    )
    linked = rows.select("vec_id", "key").join(per_class, "key").select("vec_id", "n_links", "component_id")
    alone = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e"))
    size = F.size("e")
    bad = F.coalesce(F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | (size < 1) | ~F.exists("e", lambda x: x != 0), F.lit(True))
    return linked.unionByName(alone.where(bad).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_components(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: The same for DuckDB, over all pairs.
ORACLE = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), ok AS (SELECT * FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
    e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95), r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
    n AS (SELECT a, count(*) AS n FROM e GROUP BY a), c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
    SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c.b AS component_id, vec_id = c.b AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""
