"""Approximate nearest neighbours by inner product, from randomly rotated one-bit codes.

Index: centres fitted by k-means on a sample of SAMPLE vectors at most; every vector goes to its
nearest centre and gets a code: the signs of its rotated, normed offset from the centre (one bit a
dimension, packed), the offset's norm, and the inner product of the offset's direction with the
code, which corrects the estimate. Lists are cut into chunks of CHUNK vectors, so a list that holds
much of the data is not one task's.

Search: a query first meets the PROBES lists whose centres have the largest inner products with it (all
lists, if there are fewer), in blocks of queries times chunks of vectors. Its K-th score then is a floor: it
meets each other list too, unless <query, centre> + |query| * (largest offset norm of the list), which
no vector of the list exceeds, is below the floor. So no list is left out that could hold one of the K
nearest. The estimate of <query,
vector> comes from the bits alone; its error is within BOUND standard deviations, and only vectors
whose upper bound reaches the floor and the K-th largest lower bound are reranked by exact inner products of the
original vectors in double precision. The best of each block are merged by query.

Cases: vectors that are null, zero, or hold null or non-finite components take no part; those of each dimension are
searched among themselves; equal scores are ordered by vec_id; fewer candidates than K
give fewer rows; rows that share a vec_id are one candidate with the largest of their scores, and as a query the
least of their vectors counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, workers_can_import, written

K = 20
SAMPLE = 20_000
LIST_SIZE = 4096
MOST_LISTS = 4096
#: Lists that every query meets; how many more is up to the bound.
PROBES = 16
CHUNK = 8192
QUERIES = 1024
#: Standard deviations of an estimate within which its error is taken to lie.
BOUND = 3.0
SEED = 7


def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centres: np.ndarray, lists: np.ndarray, turn: np.ndarray):
    """(packed bits, norm, correction) of each row of x: its offset from the centre of its list."""
    off = (x - centres[lists]) @ turn.T
    norm = np.linalg.norm(off, axis=1)
    bits = off > 0
    code = np.where(bits, 1.0, -1.0) / math.sqrt(x.shape[1])
    unit = off / np.maximum(norm, 1e-300)[:, None]
    return np.packbits(bits, axis=1), norm, np.einsum("ij,ij->i", unit, code)


def estimates(q: np.ndarray, centre: np.ndarray, turn: np.ndarray, packed: np.ndarray, norm: np.ndarray, fix: np.ndarray):
    """(estimate, error bound) of <q, x> for queries by rows and coded vectors by columns."""
    d = q.shape[1]
    signs = np.unpackbits(packed, axis=1, count=d).astype(np.float32) * np.float32(2) - np.float32(1)
    turned = (q @ turn.T).astype(np.float32)
    raw = (turned @ signs.T).astype(np.float64) / math.sqrt(d)
    fix = np.maximum(fix, 1e-3)
    estimate = (q @ centre)[:, None] + raw * (norm / fix)
    spread = norm * np.sqrt(np.maximum(1 - fix * fix, 0)) / fix / math.sqrt(max(d - 1, 1))
    return estimate, BOUND * np.linalg.norm(q, axis=1)[:, None] * spread + 1e-5


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds if k > 1 else 1):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(axis=1)
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def _matrix(column, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _assign_batches(shared):
    def run(batches):
        centres, turn = shared.value
        for batch in batches:
            x = _matrix(batch.column(1), centres.shape[1])
            lists = _nearest(x, centres)
            packed, norm, fix = encode(x, centres, lists, turn)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists.astype(np.int32)), pa.array([r.tobytes() for r in packed], pa.binary()), pa.array(norm), pa.array(fix)], names=["vec_id", "embedding", "list", "code", "norm", "fix"])

    return run


def _probe_batches(shared, probes: int):
    def run(batches):
        centres = shared.value[0]
        for batch in batches:
            x = _matrix(batch.column(1), centres.shape[1])
            n = min(probes, len(centres))
            best = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :n]
            rows = pa.array(np.repeat(np.arange(len(x)), n))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.full(len(rows), -np.inf)), pa.array(best.reshape(-1).astype(np.int32))], names=["query_id", "query", "floor", "list"])

    return run


def _widen_batches(shared, radii: np.ndarray, probes: int):
    """The lists beyond the first `probes` that can hold a vector with a score of the query's floor."""

    def run(batches):
        centres = shared.value[0]
        for batch in batches:
            x, floor = _matrix(batch.column(1), centres.shape[1]), batch.column(2).to_numpy()
            near = x @ centres.T
            reach = near + np.linalg.norm(x, axis=1)[:, None] * radii
            able = (reach >= (floor - 1e-9 * np.abs(np.nan_to_num(floor, neginf=0.0)))[:, None]) if len(x) else reach > 0
            np.put_along_axis(able, np.argsort(-near, axis=1, kind="stable")[:, :probes], False, axis=1)
            rows, lists = np.nonzero(able)
            for lo in range(0, len(rows), 20_000):
                at = pa.array(rows[lo : lo + 20_000])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(lists[lo : lo + 20_000].astype(np.int32))], names=["query_id", "query", "floor", "list"])

    return run


def _search_block(shared, k: int):
    def run(key, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        centres, turn = shared.value
        floors = queries.column("floor").to_numpy()
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not len(queries) or not len(vectors):
            return none
        d = centres.shape[1]
        q, x = _matrix(queries.column("query"), d), _matrix(vectors.column("embedding"), d)
        qid, vid = queries.column("query_id").to_numpy(), vectors.column("vec_id").to_numpy()
        packed = np.frombuffer(b"".join(vectors.column("code").to_pylist()), dtype=np.uint8).reshape(len(x), -1)
        norm, fix = vectors.column("norm").to_numpy(), vectors.column("fix").to_numpy()
        out_q, out_v, out_s = [], [], []
        by_id = np.argsort(vid, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], vid[by_id][1:] != vid[by_id][:-1]]))
        repeated = len(first) < len(vid)
        for lo in range(0, len(q), 128):
            part, ids = q[lo : lo + 128], qid[lo : lo + 128]
            estimate, error = estimates(part, centres[key[0].as_py()], turn, packed, norm, fix)
            own = ids[:, None] == vid[None, :]
            low = np.where(own, -np.inf, estimate - error)
            if repeated:  # several rows of one vec_id must not raise the floor as if they were several
                low = np.stack([np.maximum.reduceat(r[by_id], first) for r in low])
            at_least = np.partition(low, max(low.shape[1] - k, 0), axis=1)[:, max(low.shape[1] - k, 0)]
            at_least = np.maximum(at_least, floors[lo : lo + 128] - 1e-9 * np.abs(np.nan_to_num(floors[lo : lo + 128], neginf=0.0)))
            chosen = ~own & (estimate + error >= at_least[:, None])
            for i in range(len(part)):
                c = np.flatnonzero(chosen[i])
                # Each row is summed by itself, so that equal vectors have equal scores everywhere.
                s = (x[c] * part[i]).sum(axis=1)
                best = np.lexsort((vid[c], -s))
                if repeated:  # the best of each vec_id
                    best = best[np.sort(np.unique(vid[c][best], return_index=True)[1])]
                best = best[:k]
                out_q.append(np.full(len(best), ids[i]))
                out_v.append(vid[c][best])
                out_s.append(s[best])
        return pa.table({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, embedding) that take part; single precision stays single, since it holds the same values."""
    e = F.col("embedding")
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & fine).select(F.col("vec_id").cast("long"), e.cast(kind).alias("embedding"))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each of queries(vec_id, embedding) among
    vectors(vec_id, embedding), without itself. Each dimension of the queries is searched on its own."""
    v, q = usable(vectors), usable(queries)
    size = F.size("embedding")
    several = q.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not several.isEmpty():
        q = q.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    found = [_search_dimension(v.where(size == r["d"]), q.where(size == r["d"]), r["d"], k, probes) for r in q.groupBy(size.alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect()]  # a row for each dimension
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for x in found[1:]:
        found[0] = found[0].unionByName(x)
    return found[0]


def _search_dimension(v: DataFrame, q: DataFrame, d: int, k: int, probes: int) -> DataFrame:
    spark = v.sparkSession
    workers_can_import(spark)
    n, kind = v.count(), dict(v.dtypes)["embedding"]
    lists = max(1, min(MOST_LISTS, n // LIST_SIZE))
    sample = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow() if lists > 1 else None  # of fixed size
    centres = kmeans(_matrix(sample.column(0), d), lists) if sample is not None and len(sample) else np.zeros((1, d))
    lists = len(centres)
    shared = spark.sparkContext.broadcast((centres, rotation(d)))
    index = written(v.select("vec_id", "embedding").mapInArrow(_assign_batches(shared), f"vec_id long, embedding {kind}, list int, code binary, norm double, fix double"), "ann-index")
    asked = f"query_id long, query {kind}, floor double, list int"
    probed = written(q.select("vec_id", "embedding").mapInArrow(_probe_batches(shared, probes), asked), "ann-probes")
    found = _meet(index, probed, shared, k)
    if lists > probes:
        found = written(_best(found, k), "ann-first")
        floors = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
        radii = np.full(lists, -np.inf)  # of empty lists
        for r in index.groupBy("list").agg(F.max("norm").alias("r")).collect():  # MOST_LISTS rows at most
            radii[r["list"]] = r["r"] * (1 + 1e-9) + 1e-9
        wider = q.select("vec_id", "embedding").join(floors, "vec_id", "left").select("vec_id", "embedding", F.coalesce("floor", F.lit(float("-inf"))))
        wider = written(wider.mapInArrow(_widen_batches(shared, radii, probes), asked), "ann-probes")
        found = found.drop("rank").unionByName(_meet(index, wider, shared, k))
    return _best(found, k)


def _best(found: DataFrame, k: int) -> DataFrame:
    # A vec_id of several rows may come more than once; of k rows of each block, all but its best are spare.
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _meet(index: DataFrame, probed: DataFrame, shared, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each block for its queries, of probed(query_id, query, floor, list)."""
    # Blocks: chunks of a list times blocks of the queries that probe it.
    chunks = index.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    blocks = probed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks"))
    sizes = chunks.join(blocks, "list")  # MOST_LISTS rows at most
    deal = lambda id_, n: F.pmod(F.xxhash64(id_), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = probed.join(F.broadcast(sizes), "list").select("list", deal("query_id", F.col("blocks")).alias("b"), upto(F.col("chunks")).alias("c"), "query_id", "query", "floor")
    right = index.join(F.broadcast(sizes), "list").select("list", upto(F.col("blocks")).alias("b"), deal("vec_id", F.col("chunks")).alias("c"), "vec_id", "embedding", "code", "norm", "fix")
    by = ["list", "b", "c"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_search_block(shared, k), "query_id long, vec_id long, score double")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
