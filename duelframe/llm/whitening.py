"""Whitening of embeddings by a tiled covariance.

An entry c becomes the whole number floor(64 * c) + 1000000. Sums by dimension are exact. The covariance is made in tiles:
tasks cut their rows into row-blocks of at most ROW_BLOCK rows and each row-block's centred values into column blocks; column
blocks are shuffled by row-block, those of one row-block meet in pairs (a, b), a <= b, a task multiplies its
pairs and adds up what it has for each tile, and partial tiles are added by (a, b): first by a salt, then all,
so no task gets more than about the square root of their number. The tiles, d * d numbers in all, are assembled on the driver
and decomposed there; the projection (d * WIDTH numbers) is broadcast. Rows never reach the driver.

The projected rows are written once; their own covariance, made in the same way, tells how far it is from the identity.

Cases: rows whose vector is null or holds null or non-finite entries are dropped; empty vectors have no
component, so no row; vectors of each dimension are whitened among themselves (n counts these); rows with a null vec_id and rows that share
one stay; components whose eigenvalue is below SINGULAR of the largest have no direction in the data: their rows have whitened
null and the identity error leaves them out (null where all are so, as with one row, or equal rows);
entries beyond +-2^53 count as +-2^53; a deviation beyond a long is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, table, workers_can_import, written

WIDTH = 32
ROW_BLOCK = 2048
SCALE, SHIFT = 64.0, 1_000_000
SINGULAR = 1e-11
_MOST = 2**53


def tile_width(d: int) -> int:
    """Columns of a tile: about 16 column blocks, of at least 16 columns."""
    return max(16, math.ceil(d / 16))


def whole_numbers(column: pa.Array, d: int) -> np.ndarray:
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return np.clip(np.floor(SCALE * np.clip(c, -_MOST, _MOST)), -_MOST, _MOST).astype(np.int64) + SHIFT


def _sum_batches(d: int):
    """A task's count of rows and sum, exact, for each dimension."""

    def run(batches):
        n, high, low = 0, [0] * d, [0] * d
        for batch in batches:
            x = whole_numbers(batch.column(0), d)
            n += len(x)
            high = [a + int(b) for a, b in zip(high, (x >> 26).sum(axis=0))]
            low = [a + int(b) for a, b in zip(low, (x & (2**26 - 1)).sum(axis=0))]
        if n:
            sums = [Decimal(h * 2**26 + lo) for h, lo in zip(high, low)]
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(sums, pa.decimal128(38, 0))], names=["i", "n", "s"])

    return run


def column_sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """(rows, sums by dimension) of vectors(embedding): d rows reach the driver."""
    by = vectors.select("embedding").mapInArrow(_sum_batches(d), "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    found = {r["i"]: r for r in by}
    return (found[0]["n"], [int(found[i]["s"]) for i in range(d)]) if found else (0, [0] * d)


def differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: whole numbers of 64 bits where they fit, Python's beyond."""
    most = int(np.abs(x).max(initial=0))
    if n * most + max(map(abs, sums), default=0) < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squared_lengths(diff: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row; None beyond a long."""
    if diff.dtype != object:
        most = np.abs(diff).max(axis=1, initial=0)
        small = most < math.isqrt((2**63 - 1) // max(1, diff.shape[1]))
        fast = (np.where(small[:, None], diff, 0) ** 2).sum(axis=1)
        exact = [int(f) if s else sum(int(v) ** 2 for v in r) for f, s, r in zip(fast, small, diff)]
    else:
        exact = [sum(int(v) ** 2 for v in r) for r in diff]
    return [v if v < 2**63 else None for v in exact]


def _column_blocks(width: int, centred):
    """Column blocks of a task's row-blocks; centred: a batch to its matrix of centred values."""

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, ROW_BLOCK):
                y = centred(batch.slice(lo, ROW_BLOCK))
                key, number = task * 2**32 + number, number + 1
                tiles = range(math.ceil(y.shape[1] / width))
                data = [np.ascontiguousarray(y[:, t * width : (t + 1) * width]).tobytes() for t in tiles]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(tiles), pa.int64()), pa.array(tiles, pa.int32()), pa.array([len(y)] * len(tiles), pa.int32()), pa.array(data, pa.binary())], names=["row_block", "tile", "rows", "data"])

    return run


def _multiply(batches):
    """Products of pairs of column blocks, added up by tile over the task."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for a, b, rows, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "rows", "x", "y"))):
            found = np.frombuffer(x).reshape(rows, -1).T @ np.frombuffer(y).reshape(rows, -1)
            sums[a, b] = sums[a, b] + found if (a, b) in sums else found
    task = TaskContext.get().partitionId()
    for (a, b), m in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([task], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=["a", "b", "task", "m"])


def _added(key, t):
    total = np.sum([np.frombuffer(m) for m in t.column("m").to_pylist()], axis=0)
    return pa.table({"a": t.column("a").slice(0, 1), "b": t.column("b").slice(0, 1), "task": pa.array([0], pa.int32()), "m": pa.array([total.tobytes()], pa.binary())})


_TILE = "a int, b int, task int, m binary"


def tiled_covariance(rows: DataFrame, d: int, n: int, centred) -> np.ndarray:
    """The d x d covariance, divisor n, of what `centred` makes of batches of rows."""
    width = tile_width(d)
    blocks = written(rows.mapInArrow(_column_blocks(width, centred), "row_block long, tile int, rows int, data binary"), "column-blocks")
    left = blocks.select("row_block", F.col("tile").alias("a"), "rows", F.col("data").alias("x"))
    right = blocks.select("row_block", F.col("tile").alias("b"), F.col("data").alias("y"))
    pairs = left.join(right.hint("shuffle_hash"), "row_block").where("a <= b").select("a", "b", "rows", "x", "y")
    parts = written(pairs.mapInArrow(_multiply, _TILE), "partial-tiles")
    salt = F.pmod("task", F.lit(math.isqrt(parts.select("task").distinct().count()) + 1))
    tiles = parts.groupBy("a", "b", salt.alias("salt")).applyInArrow(_added, _TILE).groupBy("a", "b").applyInArrow(_added, _TILE).collect()  # d * d numbers
    v = np.zeros((d, d))
    for r in tiles:
        lo_a, lo_b = r["a"] * width, r["b"] * width
        m = np.frombuffer(r["m"]).reshape(min(width, d - lo_a), -1)
        v[lo_a : lo_a + m.shape[0], lo_b : lo_b + m.shape[1]] = m
    drop_written(blocks, parts)
    return (np.triu(v) + np.triu(v, 1).T) / n


def _project(shared):
    def run(batches):
        n, sums, basis = shared.value
        for batch in batches:
            diff = differences(whole_numbers(batch.column(1), len(sums)), n, sums)
            w = (diff / n).astype(np.float64) @ basis
            ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * basis.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(squared_lengths(diff), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(w.reshape(-1)))], names=["vec_id", "deviation", "whitened"])

    return run


def _total_batches(d: int):
    def run(batches):
        total, n = np.zeros(d), 0
        for batch in batches:
            total, n = total + batch.column(0).flatten().to_numpy().reshape(-1, d).sum(axis=0), n + batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total)], names=["i", "s"])

    return run


def whiten(vectors: DataFrame, d: int, width: int = WIDTH) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of vectors(vec_id, embedding) of one dimension."""
    sc = vectors.sparkSession.sparkContext
    n, sums = column_sums(vectors, d)
    v = tiled_covariance(vectors.select("embedding"), d, n, lambda batch: (differences(whole_numbers(batch.column(0), d), n, sums) / n).astype(np.float64))
    values, directions = np.linalg.eigh(v)
    values, directions = values[::-1][:width], directions[:, ::-1][:, :width]
    trace = float(np.trace(v))
    rank = int((values > SINGULAR * max(values[0], 0.0)).sum())
    basis = directions[:, :rank] / np.sqrt(values[:rank])
    rows = written(vectors.mapInArrow(_project(sc.broadcast((n, sums, basis))), "vec_id long, deviation long, whitened array<double>"), "whitened")
    error = None
    if rank:
        means = np.zeros(rank)
        for r in rows.select("whitened").mapInArrow(_total_batches(rank), "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():  # `width` rows
            means[r["i"]] = r["s"] / n
        own = tiled_covariance(rows.select("whitened"), rank, n, lambda batch: batch.column(0).flatten().to_numpy().reshape(-1, rank) - means)
        error = float(np.abs(own - np.eye(rank)).max())
    shares = F.array(*[F.lit(float(e) / trace if trace > 0 else None).cast("double") for e in values])
    x = rows.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.explode(F.sequence(F.lit(1), F.lit(len(values)))).alias("component"))
    return x.select("vec_id", "component", "n", "deviation", F.get("whitened", F.col("component") - 1).alias("whitened"), F.get(shares, F.col("component") - 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def usable(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding")
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(e.isNotNull() & fine & (F.size(e) > 0)).select(F.col("vec_id").cast("long"), e.cast(kind).alias("embedding"))


def whitened(vectors: DataFrame, width: int = WIDTH) -> DataFrame:
    """Each dimension's vectors whitened among themselves; see whiten."""
    workers_can_import(vectors.sparkSession)
    v = usable(vectors)
    dims = [r["d"] for r in v.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect()]  # a row for each dimension
    out = v.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    for d in dims:
        out = out.unionByName(whiten(v.where(F.size("embedding") == d), d, width))
    return out


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
