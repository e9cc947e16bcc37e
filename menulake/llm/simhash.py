"""SimHash near-duplicates by pigeonhole blocks."""

from __future__ import annotations

import functools
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from menulake.llm.common import LOWER, Workspace, as_bytes, batch_of, components, ranked, table

#: Fingerprints are four blocks of 16 bits. Two that differ in at most 2 bits agree in two blocks
#: at least, so each pair of blocks is a join key of 32 bits.
BLOCKS, BLOCK_BITS, MAX_BITS = 4, 16, 2
PAIRS = list(combinations(range(BLOCKS), BLOCKS - MAX_BITS))
#: Blocks with more different fingerprints than this are resolved by shared one-bit neighbours.
HOT = 1024

#: Wide fingerprints find candidates for a Jaccard similarity: their bits, the share of pairs at the
#: threshold that must share a block, and that of pairs of texts of up to SHORT different shingles.
WIDE_BITS, HIT_RATE, SHORT_HIT_RATE, SHORT = 2048, 0.99, 0.9999, 32
#: Up to so many shingles the chance that a bit differs is computed exactly; above, the angle's
#: formula is used, from which the exact chance is less than this away (0.0016 at 100 to 160).
COUNTED, ANGLE_OFF = 128, 0.002
#: Standard deviations by which a candidate's distance may exceed that of the threshold.
ABOVE = 4.5
#: Classes, and bytes of their sets of shingles, that are verified with each other in one task; rows
#: of fingerprints that are compared with all others at once.
VERIFIED, VERIFIED_BYTES, STRIP = 512, 16 << 20, 64
#: Constants of the SplitMix64 generator.
GOLDEN, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shingle_hashes(text: bytes, words_per_shingle: int, seed: int) -> list[int]:
    """XXH64 of each shingle of a text's words (separated by ASCII white space, A-Z lowered)."""
    words = text.translate(LOWER).split()
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    k = words_per_shingle
    if len(words) <= k:
        return [digest(b" ".join(words), seed)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: -k]])
    return [digest(joined[s:e], seed) for s, e in zip(starts.tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)]


def fingerprint(text: bytes | None, words_per_shingle: int = 3, seed: int = 42) -> int:
    """The 64 majority bits of the shingles' hashes as an unsigned integer; 0 without words."""
    hashes = shingle_hashes(text or b"", words_per_shingle, seed)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a very long text never needs all its bits at once
        part = np.array(hashes[at : at + (1 << 16)], dtype=">u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, words_per_shingle, seed) for t in as_bytes(b.column(1))], dtype=np.uint64)
            yield batch_of(["doc_id", "fp"], [b.column(0), fps.view(np.int64)], [pa.int64(), pa.int64()])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def block_keys(fps: DataFrame) -> DataFrame:
    """(key, fp) for each pair of blocks; key holds the pair's number and both blocks' bits."""

    def block(i: int):
        return F.shiftrightunsigned("fp", BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))

    keys = [F.lit(n << 2 * BLOCK_BITS).bitwiseOR(F.shiftleft(block(i), BLOCK_BITS)).bitwiseOR(block(j)) for n, (i, j) in enumerate(PAIRS)]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def links(ws: Workspace, fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges (a, b) that connect all different fingerprints of at most 2 differing bits.

    Blocks of up to `hot` fingerprints are joined with themselves and each pair is verified. A hot
    block isn't expanded into pairs: each member names itself and its one-bit neighbours outside
    the two blocks. Members that name the same value differ in 2 bits at most, and any two that
    differ in 2 bits or fewer name a common one, so a star per value keeps connectivity exact.
    """
    keys = block_keys(fps)
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = ws.save(keys.join(sizes, "key"), "blocks")
    cold = shared.where(F.col("size") <= hot).select("key", "fp")
    left, right = cold.toDF("key", "a"), cold.toDF("key", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    pairs = left.join(right, (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & near).select("a", "b")
    big = shared.where(F.col("size") > hot)
    if big.isEmpty():
        return pairs
    flips = []
    for i, j in PAIRS:
        bits = [b for b in range(64) if b // BLOCK_BITS not in (i, j)]
        flips.append(F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("long") for b in bits]))
    pair_no = F.shiftrightunsigned("key", 2 * BLOCK_BITS).cast("int")
    named = big.select("key", "fp", F.explode(F.element_at(F.array(*flips), pair_no + 1)).alias("flip")).select("key", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    roots = named.groupBy("key", "z").agg(F.min("fp").alias("root"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = named.join(roots, ["key", "z"]).where("fp <> root").select(F.col("root").alias("a"), F.col("fp").alias("b"))
    return pairs.union(stars)


def simhash_components(docs: DataFrame, words_per_shingle: int = 3, seed: int = 42, hot: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id): near-duplicate classes of all documents.

    docs needs doc_id and text; other columns are ignored. A null or blank text has fingerprint 0
    and is linked like any other. Rows that repeat a doc_id each give a row; rows with a null
    doc_id keep their fingerprint and take part in links, but never name a component unless all
    ids of it are null (component_id is then null). An empty table gives no rows.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    each = ws.save(fingerprints(docs, words_per_shingle, seed), "fingerprints")
    # copies meet here, as one row each
    classes = ws.save(each.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    comps = components(ws, links(ws, classes.select("fp"), hot)).withColumnRenamed("node", "fp")
    grouped = classes.join(comps, "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    # saved, so that the join deals out the classes of a large component anew
    firsts = ws.save(grouped.groupBy("component").agg(F.min("first_id").alias("component_id")), "firsts")
    names = ws.save(grouped.join(firsts, "component").select("fp", "component_id"), "names")
    return each.join(names, "fp").select("doc_id", "fp", "component_id")


def wide_fingerprint(text: bytes | None, words_per_shingle: int = 5, seed: int = 42) -> tuple[bytes, int]:
    """The majority bits of a text's different shingles, and the number of those."""
    hashes = np.unique(np.array(shingle_hashes(text or b"", words_per_shingle, seed), np.uint64))
    total = np.zeros(WIDE_BITS, np.int64)
    steps = np.arange(1, WIDE_BITS // 64 + 1, dtype=np.uint64) * GOLDEN
    for at in range(0, len(hashes), 255):  # so that sums fit a byte
        z = hashes[at : at + 255, None] + steps
        z = (z ^ (z >> np.uint64(30))) * MIX_A
        z = (z ^ (z >> np.uint64(27))) * MIX_B
        z ^= z >> np.uint64(31)
        total += np.unpackbits(z.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(hashes)).tobytes(), len(hashes)


def wide_fingerprints(docs: DataFrame, words_per_shingle: int = 5, seed: int = 42) -> DataFrame:
    """(doc_id, fp, n, key): wide fingerprints, numbers of different shingles, and row_key."""

    def run(batches):
        for b in batches:
            found = [wide_fingerprint(t, words_per_shingle, seed) for t in as_bytes(b.column(1))]
            yield batch_of(["doc_id", "fp", "n", "key"], [b.column(0), [x[0] for x in found], [x[1] for x in found], b.column(2)], [pa.int64(), pa.binary(), pa.int64(), pa.int64()])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key()).mapInArrow(run, "doc_id long, fp binary, n long, key long")


def differing(n_a: int, n_b: int, common: int) -> float:
    """Chance that a majority bit differs between sets of these counts with so many in common.

    A tie gives 0, so that the chance at small counts isn't the angle's."""

    def binomial(n):
        logs = np.array([math.lgamma(i + 1) for i in range(n + 1)])
        return np.exp(logs[n] - logs - logs[::-1] - n * math.log(2))

    def is_set(n):  # by the number of common shingles whose bit is 1
        more = np.append(np.cumsum(binomial(n - common)[::-1])[::-1], 0)
        return more[np.clip(n // 2 + 1 - np.arange(common + 1), 0, n - common + 1)]

    a, b = is_set(n_a), is_set(n_b)
    return float(binomial(common) @ (a * (1 - b) + b * (1 - a)))


@functools.cache
def chances(similarity: float) -> np.ndarray:
    """By two counts up to COUNTED: the chance of a differing bit with the fewest common shingles
    that reach the similarity; -1 where no number reaches it."""
    at = np.full((COUNTED + 1, COUNTED + 1), -1.0)
    for a in range(1, COUNTED + 1):
        for b in range(a, COUNTED + 1):
            least = math.ceil(similarity / (1 + similarity) * (a + b) - 1e-9)
            if least > a:
                break
            at[a, b] = at[b, a] = differing(a, b, least)
    return at


def split_blocks(rows: int, similarity: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit positions of each block, from as many seeded splits of a wide fingerprint as it takes,
    and how many of the blocks a text has by its count of shingles (the last entry: any more).

    Shingle sets of this Jaccard similarity have a cosine of 2s / (1 + s), so a bit differs with
    probability angle / pi; texts of few shingles have the worst of their exact chances. A block has
    4 bits more than would number all rows, so that few rows meet by chance; a pair at the threshold
    shares one of the blocks with probability HIT_RATE.
    """
    bits = math.ceil(math.log2(max(rows, 1 << 12))) + 4

    def blocks(differs: float, rate: float) -> int:
        return math.ceil(math.log(1 - rate) / math.log(1 - (1 - differs) ** bits)) if differs > 0 else 1

    short = [blocks(float(x), SHORT_HIT_RATE if n <= SHORT else HIT_RATE) for n, x in enumerate(chances(similarity).max(axis=1))]
    # the partners of the longest of these are longer still, and not among them
    usual = blocks(math.acos(2 * similarity / (1 + similarity)) / math.pi + ANGLE_OFF, HIT_RATE)
    limits = np.array([max(x, usual) if n > COUNTED * similarity else x for n, x in enumerate(short)] + [usual])
    rng, per_split = np.random.default_rng([seed, bits]), WIDE_BITS // bits
    splits = [rng.permutation(WIDE_BITS)[: per_split * bits].reshape(per_split, bits) for _ in range(math.ceil(limits.max() / per_split))]
    return np.concatenate(splits)[: limits.max()], limits


def most_differing(n_a: np.ndarray, n_b: np.ndarray, similarity: float) -> np.ndarray:
    """Fingerprints of a pair at the similarity differ in at most so many bits, by ABOVE standard
    deviations; -1 if sets of these counts can't be that similar."""
    at = chances(similarity)
    cosine = similarity / (1 + similarity) * (n_a + n_b) / np.sqrt(np.maximum(n_a * n_b, 1.0))
    angle = np.arccos(np.minimum(cosine, 1)) / np.pi
    counted = np.maximum(n_a, n_b) <= COUNTED
    a, b = np.minimum(n_a, COUNTED), np.minimum(n_b, COUNTED)
    reach = np.where(counted, at[a, b], np.where(np.minimum(n_a, n_b) < similarity * np.maximum(n_a, n_b) - 1e-9, -1, angle + ANGLE_OFF))
    spread = np.sqrt(WIDE_BITS * np.maximum(reach, 0) * (1 - reach))
    return np.where(reach < 0, -1, WIDE_BITS * reach + ABOVE * spread)


class Union:
    """Disjoint sets of numbers."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether a and b weren't in one set before."""
        ra, rb = self.root(a), self.root(b)
        self.parent[ra] = rb
        return ra != rb


def stars(pairs: np.ndarray, side: dict[int, int]) -> np.ndarray:
    """Pairs (a, b) that connect what the given ones do: on each side the smallest of a connected set with
    each of its others, and the smallest of both sides. Tasks that see the same members name the same
    pairs, however they came to be connected, so distinct pairs grow with the members and not with the
    tasks or blocks that see them."""
    sets, least = Union(), {}
    for a, b in pairs.tolist():
        sets.join(a, b)
    nodes = sorted(sets.parent)
    for x in nodes:
        least.setdefault((sets.root(x), side[x]), x)
        least.setdefault(sets.root(x), x)
    out = {(least[sets.root(x), side[x]], x) for x in nodes} | {(least[sets.root(x)], least[sets.root(x), side[x]]) for x in nodes}
    return np.array(sorted((a, b) for a, b in out if a != b), np.int64).reshape(-1, 2)


def block_pairs(key: np.ndarray, ids: np.ndarray, fps: np.ndarray, n: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs (rows a, b) of rows with equal keys (sorted by key) that may be similar enough; as many as
    it takes to connect what all such pairs would. Row i is compared with row i + lag, for each lag
    that a key has, until pairs of its own have made the key's rows one set."""
    sets, out = Union(), []
    of = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1 if len(key) else key
    apart = np.bincount(of) - 1 if len(key) else key
    i, lag = np.arange(len(key)), 0
    while True:
        lag += 1
        i = i[i + lag < len(key)]
        i = i[(of[i] == of[i + lag]) & (apart[of[i]] > 0)]
        if not len(i):
            break
        differ = np.bitwise_count(fps[i] ^ fps[i + lag]).sum(axis=1, dtype=np.int64)
        near = i[differ <= most_differing(n[i], n[i + lag], similarity)]
        for k, a, b in zip(of[near].tolist(), ids[near].tolist(), ids[near + lag].tolist(), strict=True):
            if sets.join(a, b):
                out.append((a, b))
                apart[k] -= 1
    return np.array(out, np.int64).reshape(-1, 2)


def wide_links(ws: Workspace, classes: DataFrame, rows: int, similarity: float, seed: int, hot: int = HOT) -> DataFrame:
    """Edges (a, b) that connect all classes (no, fp, n) that share a block and may be similar enough.

    Blocks that several classes share come to a task many at a time, as units of bounded size. A
    block of over `hot` classes is dealt into chunks, and each pair of chunks is a unit.
    """
    at, limits = split_blocks(rows, similarity, seed)
    weights = np.int64(1) << np.arange(at.shape[1], dtype=np.int64)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            bits = np.unpackbits(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1), axis=1)
            no, own = b.column(0).to_numpy(), limits[np.minimum(b.column(2).to_numpy(), len(limits) - 1)]
            for k in range(own.max()):
                has = own > k
                yield batch_of(["no", "block", "value"], [no[has], np.full(has.sum(), k, np.int32), bits[has][:, at[k]] @ weights], [pa.int64(), pa.int32(), pa.int64()])

    # a key is two columns, so that blocks of any width fit; the fingerprints follow where needed
    keys = ws.save(classes.select("no", "fp", "n").mapInArrow(run, "no long, block int, value long"), "keys")
    sizes = keys.groupBy("block", "value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = ws.save(keys.join(sizes, ["block", "value"]), "shared")
    ws.drop(keys)
    bins = shared.count() // (2 * hot) + 1
    chunks = F.ceil(F.col("size") / (hot // 2)).cast("int")
    own = F.pmod(F.xxhash64("no"), chunks).cast("int")
    other = F.filter(F.sequence(F.lit(0), chunks - 1), lambda o: o != own)
    units = F.when(F.col("size") <= hot, F.array(F.concat(F.lit("b"), F.pmod(F.xxhash64("block", "value"), F.lit(bins))))).otherwise(
        F.transform(other, lambda o: F.concat_ws("-", "block", "value", F.least(o, own), F.greatest(o, own)))
    )

    def compare(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["block", "value", "no"])
        key = pdf.groupby(["block", "value"], sort=False).ngroup().to_numpy()
        fps = np.frombuffer(b"".join(pdf["fp"]), np.uint64).reshape(len(pdf), -1)
        pairs = block_pairs(key, pdf["no"].to_numpy(), fps, pdf["n"].to_numpy(), similarity)
        return pd.DataFrame(stars(pairs, dict(zip(pdf["no"].tolist(), pdf["own"].tolist(), strict=True))), columns=["a", "b"])

    side = F.when(F.col("size") <= hot, F.lit(0)).otherwise(own).alias("own")
    dealt = shared.join(classes.select("no", "fp", "n"), "no").select("no", "fp", "n", "block", "value", side, F.explode(units).alias("unit"))
    return dealt.groupBy("unit").applyInPandas(compare, "a long, b long")


def exact_pairs(ids: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], similarity: float, other: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (a, b) whose sets of shingles have this Jaccard similarity or more, as many as connect what
    all such pairs would; nearest fingerprints first, as a pair that is connected needn't be looked
    at. other: marks of two sides; with both, only pairs across are looked at."""
    n = np.array([len(x) for x in sets], np.int64)
    sides = np.unique(other)
    left, right = (np.flatnonzero(other == sides[0]), np.flatnonzero(other == sides[-1]))
    found = []
    for lo in range(0, len(left), STRIP):
        rows = left[lo : lo + STRIP]
        differ = np.bitwise_count(fps[rows][:, None, :] ^ fps[right][None, :, :]).sum(axis=2, dtype=np.int32)
        near = differ <= most_differing(np.broadcast_to(n[rows][:, None], differ.shape), np.broadcast_to(n[right][None, :], differ.shape), similarity)
        i, j = np.nonzero(near & ((rows[:, None] < right[None, :]) if len(sides) == 1 else True))
        found.append(np.stack([differ[i, j], rows[i], right[j]]))
    if not found:
        return []
    differ, a, b = np.concatenate(found, axis=1)
    joined, out = Union(), []
    for i, j in zip(*(x[np.lexsort((b, a, differ))].tolist() for x in (a, b)), strict=True):
        if joined.root(i) != joined.root(j):
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if common >= similarity * (n[i] + n[j] - common) - 1e-9:
                joined.join(i, j)
                out.append((int(ids[i]), int(ids[j])))
                if len(out) == len(ids) - 1:
                    break
    return out


def least_neighbours(ws: Workspace, edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what the given ones do: each node with its smallest smaller neighbour, and
    the others of those with that one, which nodes of a set mostly have in common."""
    known = ws.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    first = known.groupBy("b").agg(F.min("a").alias("m"))
    return known.join(first, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b")).distinct()


def confirmed(ws: Workspace, docs: DataFrame, classes: DataFrame, edges: DataFrame, words_per_shingle: int, similarity: float, seed: int) -> DataFrame:
    """Edges (a, b) between classes whose sets of shingles have this Jaccard similarity or more, as many
    as connect what all such pairs of candidates would.

    Candidate edges first give candidate components. Within each, all pairs of near enough
    fingerprints are verified on the sets, unless links found before connect them. Small components
    come to a task many at a time; a large one is dealt into chunks of bounded size, and each pair of
    chunks is a unit of its own. So rows grow with the classes, and not with the pairs.
    """
    comps = ws.save(components(ws, least_neighbours(ws, edges)).toDF("no", "component"), "candidates")
    members = classes.select("no", "key", "fp").join(comps, "no")

    def sets(batches):
        seen = set()  # a repeated row has its copies in the same task
        for b in batches:
            for begin in range(0, b.num_rows, 200):
                part = b.slice(begin, 200)
                new, at = [], []
                for i, (no, text) in enumerate(zip(part.column(0).to_pylist(), as_bytes(part.column(3)), strict=True)):
                    if no not in seen:
                        seen.add(no)
                        at.append(i)
                        new.append(np.unique(np.array(shingle_hashes(text or b"", words_per_shingle, seed), np.uint64)).tobytes())
                at = pa.array(at, pa.int64())
                yield batch_of(["no", "component", "fp", "hashes"], [*(part.column(c).take(at) for c in range(3)), new], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    # texts stream past the members and are never sorted
    texts = docs.select(row_key().alias("key"), F.col("text").cast("string").alias("text")).join(members.hint("shuffle_hash"), "key").select("no", "component", "fp", "text")
    known = ws.save(texts.mapInArrow(sets, "no long, component long, fp binary, hashes binary").dropDuplicates(["no"]), "sets")
    total = F.sum(F.length("hashes")).alias("bytes")
    sizes = ws.save(known.groupBy("component").agg(F.count(F.lit(1)).alias("size"), total), "sizes")
    whole = known.agg(F.count(F.lit(1)), total).first()
    bins = whole[0] // (2 * VERIFIED) + (whole[1] or 0) // VERIFIED_BYTES + 1
    chunks = F.greatest(F.ceil(F.col("size") / VERIFIED), F.ceil(F.col("bytes") / VERIFIED_BYTES)).cast("int")
    own = F.pmod(F.xxhash64("no"), chunks).cast("int")
    units = F.when(chunks <= 1, F.array(F.concat(F.lit("s"), F.pmod(F.xxhash64("component"), F.lit(bins))))).otherwise(
        F.transform(F.sequence(F.lit(0), chunks - 1), lambda o: F.concat_ws("-", "component", F.least(o, own), F.greatest(o, own)))
    )
    dealt = known.join(sizes, "component").select("no", "component", "fp", "hashes", F.when(chunks <= 1, F.lit(0)).otherwise(own).alias("own"), F.explode(units).alias("unit"))

    def verify(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by([("component", "ascending"), ("no", "ascending")])
        ids, component, own = (t.column(c).to_numpy() for c in ("no", "component", "own"))
        fps = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint64).reshape(len(ids), -1)
        sets = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
        cuts = np.flatnonzero(np.concatenate([[True], component[1:] != component[:-1], [True]]))
        alone = key[0].as_py().split("-")
        if len(alone) == 3 and alone[1] != alone[2] and len(np.unique(own)) < 2:
            cuts = cuts[:1]  # a chunk without rows, and so no pair across
        out = [p for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) for p in exact_pairs(ids[s:e], fps[s:e], sets[s:e], similarity, own[s:e])]
        found = stars(np.array(out, np.int64).reshape(-1, 2), dict(zip(ids.tolist(), own.tolist(), strict=True)))
        return pa.table({"a": pa.array(found[:, 0], pa.int64()), "b": pa.array(found[:, 1], pa.int64())})

    return dealt.select("unit", "no", "component", "fp", "hashes", "own").groupBy("unit").applyInArrow(verify, "a long, b long")


def row_key():
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def near_components(docs: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8, seed: int = 42, hot: int = HOT) -> DataFrame:
    """(doc_id, component_id): classes of documents linked by the Jaccard similarity of their
    different word shingles. Each link is confirmed on the sets of shingles.

    At 0.8 two fingerprints of 64 bits differ in about 10, too many for blocks that tell documents
    apart. So the fingerprint that finds candidates is wider, and split in several ways. Nulls, blank
    texts, repeated rows and empty tables have the results that simhash_components gives them.
    """
    ws = Workspace(docs.sparkSession, "near")
    each = ws.save(wide_fingerprints(docs, words_per_shingle, seed), "fingerprints")
    classes = ranked(ws, each.groupBy("fp", "n").agg(F.min("doc_id").alias("first_id"), F.min("key").alias("key")), "first_id", "fp", "n", name="no")
    edges = wide_links(ws, classes, classes._menulake_rows, similarity, seed, hot)
    comps = components(ws, confirmed(ws, docs, classes, edges, words_per_shingle, similarity, seed)).withColumnRenamed("node", "no")
    grouped = classes.join(comps, "no", "left").select("fp", "n", "first_id", F.coalesce("component", "no").alias("component"))
    # saved, so that the join deals out the classes of a large component anew
    firsts = ws.save(grouped.groupBy("component").agg(F.min("first_id").alias("component_id")), "firsts")
    names = ws.save(grouped.join(firsts, "component").select("fp", "n", "component_id"), "names")
    return each.join(names, ["fp", "n"]).select("doc_id", "component_id")


def keep_one(docs: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """docs with one row of each near-duplicate class: that with the smallest doc_id.

    Same columns as docs. Of rows that repeat the smallest doc_id of a class one stays, that with the
    smallest text (a null text is the largest), and of those that share it any. Rows with a null
    doc_id stay as they are: nothing names them, so nothing can be chosen among them.
    """
    names = docs.columns
    found = near_components(docs, words_per_shingle, similarity, seed)
    keep = found.where("component_id = doc_id").select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi").select(*names)
    repeats = kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    # one aggregate, which each task begins on its own rows, however often an id repeats
    order = F.struct(F.col("text").isNull(), "text")
    again = kept.join(repeats, "doc_id", "left_semi").select(*names).groupBy("doc_id").agg(F.min_by(F.struct(*names), order).alias("row")).select(*[F.col("row").getField(c).alias(c) for c in names])
    return kept.join(repeats, "doc_id", "left_anti").select(*names).unionByName(again).unionByName(docs.where("doc_id is null"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
