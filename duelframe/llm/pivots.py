"""Near-duplicate embeddings from a pivot-permutation index.

Reference points: up to PIVOTS vectors of a bounded sample, no two of which have a cosine of APART or more, so
that copies don't crowd them. A vector is described by its NEAREST nearest pivots, in order of their cosines. Two
vectors with a cosine of 0.93 share 10 of 16 on average, and fewer than SHARED = 4 with a chance below 0.0001;
vectors at right angles share 4 with a chance of 0.0003.

Inverted lists: pivots are ranked by how rarely they describe a vector, and a vector is posted in the lists of its
NEAREST - SHARED + 1 rarest ones. Vectors that share SHARED pivots then meet in the list of the rarest of these, and
the pair counts there only. In a list, shared pivots are counted from packed bits; pairs that share SHARED or more
are verified by their cosine in double precision. Lists are cut into blocks of BLOCK entries, and pairs of
blocks are the units of work, so a list that holds much of the data is not one task's. A unit returns a number of links for a
vector and a spanning forest of its links, never all pairs.

Groups of copies: equal vectors of a label form a class, and one vector with the class's size stands for it. Near copies
of one direction form a core: the largest groups with the same three nearest pivots, CORES of them at most, name
hubs; a vector whose angle to a hub is at most half of the angle that `least` allows belongs to the hub's core.
All members of a core are linked, by the triangle inequality, so they are counted and not compared. Cores only save
work: what belongs to none is compared in blocks.

Cases: vectors that are null, zero, or hold null or non-finite components, and those with a null label, link with nothing;
only vectors of one dimension are compared, and pivots are chosen for each dimension; rows that share a vec_id stay
rows of their own; for a row with a null vec_id component_id is the least other id it reaches, null if there is none,
and kept tells whether the two are the same; vectors of any length and sizes of entries count (norms are taken after scaling);
an empty table gives no rows; other columns, of any name, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, workers_can_import, written
from .near_dedup import components

LEAST = 0.93
PIVOTS = 1024
NEAREST = 16
SHARED = 4
#: Pivots are taken from so many vectors at most; their cosines stay below APART.
SAMPLE, APART = 20_000, 0.8
#: Entries in one side of a unit.
BLOCK = 2048
#: Parts in which a list's entries meet its sizes.
SALTS = 64
#: Hubs at most, and members of the same three nearest pivots from which a group names one.
CORES, CORE_MEMBERS = 256, 64


def directions(x: np.ndarray) -> np.ndarray:
    """Rows of x at length 1, in double precision; scaled first, so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x = x / np.maximum(np.abs(x).max(axis=1, initial=0.0), 5e-324)[:, None]
    return x / np.maximum(np.sqrt((x * x).sum(axis=1)), 5e-324)[:, None]


def choose_pivots(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Rows of the sample of unit vectors, in its order, each below APART with those before; `most` at most."""
    chosen = np.zeros((0, sample.shape[1]))
    for lo in range(0, len(sample), 512):
        part = sample[lo : lo + 512]
        part = part[~((part @ chosen.T) >= APART).any(axis=1)] if len(chosen) else part
        near, keep = part @ part.T >= APART, np.zeros(len(part), bool)
        for i in range(len(part)):
            keep[i] = not near[i, :i][keep[:i]].any()
        chosen = np.concatenate([chosen, part[keep]])
        if len(chosen) >= most:
            break
    return chosen[:most]


def described(x: np.ndarray, pivots: np.ndarray, count: int) -> np.ndarray:
    """The `count` nearest pivots of each unit vector, nearest first; ties to the earlier pivot."""
    out = np.empty((len(x), count), np.int16)
    for lo in range(0, len(x), 4096):
        out[lo : lo + 4096] = np.argsort(-(x[lo : lo + 4096] @ pivots.T), axis=1, kind="stable")[:, :count]
    return out


def _matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _describe_batches(shared, d: int, count: int):
    def run(batches):
        for batch in batches:
            x = directions(_matrix(batch.column("embedding"), d))
            perm = described(x, shared.value, count)
            flat = pa.array(perm.reshape(-1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, count, dtype=np.int32)), flat)], names=[*batch.schema.names, "perm"])

    return run


def _post_batches(shared, d: int, least: float, posted: int):
    """A row for each vector and list: its pivots by rarity rank as packed bits, and its core's number or -1."""

    def run(batches):
        rank, hubs, labels, half = shared.value
        words = -(-len(rank) // 64)
        for batch in batches:
            x = directions(_matrix(batch.column("embedding"), d))
            n, core = len(x), np.full(batch.num_rows, -1, np.int32)
            if len(hubs) and n:
                label = batch.column("label").to_pylist()
                cos = np.where(np.array([[a == b for b in labels] for a in label]), x @ hubs.T, -2.0)
                best = cos.argmax(axis=1)
                core = np.where(cos[np.arange(n), best] >= half, best, -1).astype(np.int32)
            own = np.sort(rank[_matrix(batch.column("perm"), batch.column("perm").flatten().__len__() // n if n else 1)], axis=1)
            bits = np.zeros((n, words), np.uint64)
            for j in range(own.shape[1]):  # a pivot at a time, for all rows
                bits[np.arange(n), own[:, j] >> 6] |= np.uint64(1) << (own[:, j] & 63).astype(np.uint64)
            rows = np.repeat(np.arange(n), posted)
            at = pa.array(rows)
            packed = pa.array([r.tobytes() for r in bits], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("label").take(at), pa.array(own[:, :posted].astype(np.int32).reshape(-1)), pa.array(core[rows]), batch.column("class").take(at), batch.column("copies").take(at), packed.take(at), batch.column("embedding").take(at)], names=["label", "list", "core", "class", "copies", "bits", "embedding"])

    return run


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes of edges a-b, without the least ones themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while True:
        before = least.copy()
        low = np.minimum(least[u], least[v])
        np.minimum.at(least, u, low)
        np.minimum.at(least, v, low)
        least = least[least]
        if (least == before).all():
            break
    on = least != np.arange(len(nodes))
    return nodes[on], nodes[least[on]]


_UNIT = "class long, links long, root long"


def _unit(d: int, shared_least: int, least: float):
    """Links of a unit: of one block's entries among themselves, or of one block's with the other's."""

    def run(key, t):
        rank, i, j = key[1].as_py(), key[2].as_py(), key[3].as_py()
        t = t.combine_chunks()
        x = directions(_matrix(t.column("embedding").combine_chunks(), d))
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(t.num_rows, -1)
        ids, copies, core, block = (t.column(c).to_numpy() for c in ("class", "copies", "core", "block"))
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        below = np.zeros(bits.shape[1], np.uint64)
        below[: rank >> 6] = ~np.uint64(0)
        below[rank >> 6] = (np.uint64(1) << np.uint64(rank & 63)) - np.uint64(1)
        links = np.zeros(t.num_rows, np.int64)
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        other = bits[right]
        step = max(1, 2_000_000 // max(1, other.size))
        for lo in range(0, len(left), step):
            part = left[lo : lo + step]
            both = bits[part][:, None, :] & other[None, :, :]
            able = np.bitwise_count(both).sum(axis=2) >= shared_least
            able &= ~(both & below).any(axis=2)  # the pair counts in the list of its rarest shared pivot only
            able &= ~((core[part][:, None] == core[right][None, :]) & (core[part] >= 0)[:, None])
            if i == j:
                able &= right[None, :] > part[:, None]
            p, q = np.nonzero(able)
            for k in range(0, len(p), 100_000):
                a, b = part[p[k : k + 100_000]], right[q[k : k + 100_000]]
                on = (x[a] * x[b]).sum(axis=1) >= least
                a, b = a[on], b[on]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                # Edges are kept as a forest, so their number stays within that of the entries.
                u, v = forest(np.concatenate([found_a[0], ids[a]]), np.concatenate([found_b[0], ids[b]]))
                found_a, found_b = [u], [v]
        on = links > 0
        return pa.table({
            "class": np.concatenate([ids[on], found_a[0]]), "links": np.concatenate([links[on], np.zeros(len(found_a[0]), np.int64)]),
            "root": pa.array(np.concatenate([ids[on], found_b[0]])),
        })

    return run


def classes(vectors: DataFrame) -> DataFrame:
    """label, embedding, class, copies, least_id, as a written table: a row for each distinct vector of a label."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    kept = vectors.where(F.col("label").isNotNull() & e.isNotNull() & fine)
    by = kept.groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least_id"))
    return written(by.withColumn("class", F.monotonically_increasing_id()), "pivot-classes")


def linked(c: DataFrame, d: int, least: float) -> DataFrame:
    """class, links, root of the classes of one dimension: numbers to add up, and edges to join."""
    spark = c.sparkSession
    kind = dict(c.dtypes)["embedding"]
    fields = f"label {dict(c.dtypes)['label']}, embedding {kind}, class long, copies long"
    c = c.select("label", "embedding", "class", "copies")
    sample = c.orderBy(F.xxhash64("class"), "class").limit(SAMPLE).select("embedding").toArrow()  # of fixed size
    pivots = choose_pivots(directions(_matrix(sample.column(0).combine_chunks(), d)))
    count = min(NEAREST, len(pivots))
    shared_least = min(SHARED, count)
    posted = count - shared_least + 1
    points = spark.sparkContext.broadcast(pivots)
    known = written(c.mapInArrow(_describe_batches(points, d, count), f"{fields}, perm array<smallint>"), "pivot-perms")
    used = {r["p"]: r["n"] for r in known.select(F.explode("perm").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}  # PIVOTS rows at most
    rank = np.empty(len(pivots), np.int64)
    rank[sorted(range(len(pivots)), key=lambda p: (used.get(p, 0), p))] = np.arange(len(pivots))
    # Hubs, of large groups only: a bounded number of vectors.
    group = ["label", F.slice("perm", 1, 3).alias("first")]
    large = known.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min_by("embedding", "class").alias("hub"), F.min("class").alias("at")).where(F.col("n") >= CORE_MEMBERS)
    large = large.orderBy(F.desc("n"), "at").limit(CORES).select("label", "hub").collect()
    half = math.cos(math.acos(least) / 2 - 1e-7)
    hubs = directions(np.array([r["hub"] for r in large], dtype=np.float64).reshape(-1, d))
    shared = spark.sparkContext.broadcast((rank, hubs, [r["label"] for r in large], half))
    entry = f"label {dict(c.dtypes)['label']}, list int, core int, class long, copies long, bits binary, embedding {kind}"
    entries = written(known.mapInArrow(_post_batches(shared, d, least, posted), entry), "pivot-lists")
    # Blocks of a list: those of each core, then those of what is in none. Entries meet their list's sizes by salt, so a long list
    # isn't joined in one task, nor its units made in one.
    salt = F.pmod(F.xxhash64("class"), F.lit(SALTS)).alias("salt")
    counts = entries.groupBy("label", "list", salt, "core").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("label", "list", "core").agg(F.sum("n").alias("n"))
    sizes = sizes.groupBy("label", "list").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("core", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))).alias("cores")).where("n > 1")  # CORES + 1 in a list at most
    sizes = counts.select("label", "list", "salt").distinct().join(sizes, ["label", "list"])
    start = F.aggregate(F.filter("cores", lambda x: x["core"] < F.col("core")), F.lit(0), lambda a, x: a + x["blocks"])
    own = F.aggregate(F.filter("cores", lambda x: x["core"] == F.col("core")), F.lit(0), lambda a, x: a + x["blocks"])
    total = F.aggregate("cores", F.lit(0), lambda a, x: a + x["blocks"])
    short = F.col("n") <= BLOCK  # one block holds the whole list
    x = entries.withColumn("salt", salt).join(sizes, ["label", "list", "salt"]).withColumns({"_start": start, "_own": own, "_total": total})
    x = x.withColumn("block", F.when(short, 0).otherwise(F.col("_start") + F.pmod(F.xxhash64("class"), F.col("_own")).cast("int")))
    x = x.withColumn("other", F.explode(F.when(short, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_total") - 1))))
    one_core = ~short & (F.col("core") >= 0) & F.col("other").between(F.col("_start"), F.col("_start") + F.col("_own") - 1)
    x = x.where(~one_core).select("label", "list", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "core", "class", "copies", "bits", "embedding")
    met = x.groupBy("label", "list", "i", "j").applyInArrow(_unit(d, shared_least, least), _UNIT)
    # Members of a core are linked with each other: each adds the others, and one edge.
    member = entries.where("core >= 0").select("core", "class", "copies").distinct()
    cores = member.groupBy("core").agg(F.sum("copies").alias("all"), F.min("class").alias("root"))  # CORES rows at most
    within = member.join(F.broadcast(cores), "core").select("class", (F.col("all") - F.col("copies")).alias("links"), "root")
    return written(met.unionByName(within), "pivot-links")


def near_vectors(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of vectors(vec_id, embedding, label)."""
    workers_can_import(vectors.sparkSession)
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind), "label")
    c = classes(v)
    dims = [r["d"] for r in c.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy("d").collect()]  # a row for each dimension
    found = v.sparkSession.createDataFrame([], _UNIT)
    for d in dims:
        found = found.unionByName(linked(c.where(F.size("embedding") == d), d, least))
    number = found.groupBy("class").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    placed = c.select("class", "label", "embedding", "copies", "least_id").join(comps.withColumnRenamed("node", "class"), "class", "left")
    placed = placed.join(number, "class", "left").withColumn("component", F.coalesce("component", "class"))
    least_ids = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    placed = placed.join(least_ids, "component").select("label", "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = v.join(placed, ["label", "embedding"], "left")
    alone = F.col("n_links").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op13_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
