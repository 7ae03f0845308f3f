"""Venn-Abers intervals on exact scores.

For a score, p0 and p1 are the isotonic fit at it when it joins the calibration scores with the result 0, and with 1. Pooling adjacent
violators gives the same pools in whatever order neighbours merge, so what lies left of the score and what lies right of it
can be pooled by themselves, and the score then absorbs pools from either side.

Calibration scores are counted by value, dealt by ranges and pooled in each range. A range's task pools what the ranges
before it left, and what those after it left, and walks its own scores with the pools to the left and to the right at hand. The
pools of all ranges go to every task: means of pools rise, and n results have fewer than 3 * n^(2/3) different rising
means, so ranges of m results leave fewer than 3 * m^(2/3) pools each; their number is checked.

Scores may be any finite numbers; rows with a null score have null bounds; calibration rows with a null score or result are left out.
Without calibration rows p0 is 0 and p1 is 1.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.session import staged, workers_can_import

#: Different scores in a range, about.
RANGE = 100_000
#: Pools that every task may get (24 bytes each).
MOST_POOLS = 5_000_000


class Pools:
    """A stack of pools with rising means, from the outside towards a place; push() merges, undo() takes the last push back."""

    def __init__(self, rising: bool):
        self.sign = 1.0 if rising else -1.0
        self.ones: list[float] = []
        self.n: list[float] = []
        self.log: list[list[tuple[float, float]]] = []

    def push(self, ones: float, n: float, keep: bool = False) -> None:
        gone = []
        while self.ones and self.sign * (self.ones[-1] * n - ones * self.n[-1]) >= 0:
            a, b = self.ones.pop(), self.n.pop()
            gone.append((a, b))
            ones, n = ones + a, n + b
        self.ones.append(ones)
        self.n.append(n)
        if keep:
            self.log.append(gone)

    def undo(self) -> None:
        self.ones.pop()
        self.n.pop()
        for a, b in reversed(self.log.pop()):
            self.ones.append(a)
            self.n.append(b)


def fit_at(left: Pools, right: Pools, ones: float, n: float) -> float:
    """The isotonic fit of a pool between two stacks, which stay as they are."""
    i, j = len(left.n) - 1, len(right.n) - 1
    while True:
        if i >= 0 and left.ones[i] * n >= ones * left.n[i]:
            ones, n, i = ones + left.ones[i], n + left.n[i], i - 1
        elif j >= 0 and right.ones[j] * n <= ones * right.n[j]:
            ones, n, j = ones + right.ones[j], n + right.n[j], j - 1
        else:
            return ones / n


def _pool(key, t: pd.DataFrame) -> pd.DataFrame:
    t = t.sort_values("s")
    stack = Pools(True)
    for ones, n in zip(t["ones"], t["n"]):
        stack.push(ones, n)
    return pd.DataFrame({"block": t["block"].iloc[0], "at": np.arange(len(stack.n)), "ones": stack.ones, "n": stack.n})


def _bounds(shared):
    def run(key, asked: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        """p0 and p1 of the asked scores of one range."""
        block = int(key[0])
        blocks, ones, n = shared.value
        left, right = Pools(True), Pools(False)
        for i in range(int(np.searchsorted(blocks, block, "left"))):
            left.push(ones[i], n[i])
        for i in range(len(blocks) - 1, int(np.searchsorted(blocks, block, "right")) - 1, -1):
            right.push(ones[i], n[i])
        seen = seen.sort_values("s")
        own = list(zip(seen["s"], seen["ones"], seen["n"]))
        for _, a, b in reversed(own):
            right.push(a, b, keep=True)
        out, i = [], 0
        for s in np.sort(asked["s"].to_numpy()):
            while i < len(own) and own[i][0] < s:
                right.undo()
                left.push(own[i][1], own[i][2])
                i += 1
            a, b = (own[i][1], own[i][2]) if i < len(own) and own[i][0] == s else (0.0, 0.0)
            if b:
                right.undo()
            out.append((s, fit_at(left, right, a, b + 1), fit_at(left, right, a + 1, b + 1)))
            if b:
                right.push(a, b, keep=True)
        return pd.DataFrame(out, columns=["s", "p0", "p1"])

    return run


def intervals(calibration: DataFrame, rows: DataFrame, p: str = "p", label: str = "label", score: str = "p") -> DataFrame:
    """rows with va_low, va_high and va_prob = high / (1 - low + high) for its score p, from calibration(score, label)."""
    spark = rows.sparkSession
    workers_can_import(spark)
    seen = calibration.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy((F.col(score).cast("double") + 0.0).alias("s")).agg(F.sum(F.col(label).cast("double")).alias("ones"), F.count(F.lit(1)).cast("double").alias("n"))
    seen = staged(seen, "scores")
    asked = rows.where(F.col(p).isNotNull()).select((F.col(p).cast("double") + 0.0).alias("s")).distinct()
    blocks = max(1, math.ceil(seen.count() / RANGE))
    at = F.percentile_approx("s", F.array(*[F.lit(i / blocks) for i in range(1, blocks)]), F.lit(100 * blocks)) if blocks > 1 else None
    limits = sorted(set(seen.agg(at.alias("l")).first()["l"] or [])) if blocks > 1 else []  # a number for each range
    block = _block_of(limits)
    seen = seen.withColumn("block", block)
    pools = seen.groupBy("block").applyInPandas(_pool, "block int, at long, ones double, n double")
    pools = staged(pools, "pools")
    if pools.count() > MOST_POOLS:
        raise ValueError(f"more than {MOST_POOLS} pools: raise RANGE")
    found = pools.orderBy("block", "at").toPandas()  # MOST_POOLS at most
    shared = spark.sparkContext.broadcast((found["block"].to_numpy(), found["ones"].tolist(), found["n"].tolist()))
    bounds = asked.withColumn("block", block).groupBy("block").cogroup(seen.groupBy("block")).applyInPandas(_bounds(shared), "s double, p0 double, p1 double")
    bounds = bounds.select(F.col("s").alias("_s"), F.col("p0").alias("va_low"), F.col("p1").alias("va_high"))
    out = rows.join(bounds, (F.col(p).cast("double") + 0.0) == F.col("_s"), "left").drop("_s")
    return out.withColumn("va_prob", F.col("va_high") / (1.0 - F.col("va_low") + F.col("va_high")))


def _block_of(limits: list[float]) -> Column:
    """The range of s: how many limits lie below it."""
    return F.size(F.filter(F.array(*[F.lit(float(v)) for v in limits]), lambda e: e < F.col("s"))) if limits else F.lit(0)
