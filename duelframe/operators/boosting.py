"""Gradient boosting over DataFrames with Newton steps: two or more classes in one model, an L2 term, early stopping,
and exact contributions of features.

A round grows one regression tree for each class (one for two classes) on the gradients of the softmax loss. Trees grow
level by level: a task adds up gradients, second derivatives and rows by class, node, feature and bin, sums of tasks are added
by class and node, and the driver, which gets bins only, picks the splits. Rows keep their bins in a written table; margins are written
with them every WRITTEN rounds, so lineage and the trees that a pass applies anew stay short. A model is a table of nodes.

A missing value goes to the right of every split. Rows with a null label are left out of the fit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.session import staged, workers_can_import

#: Rounds after which margins are written.
WRITTEN = 10
#: Tasks whose sums are added before all are.
SALTS = 16


@dataclass(frozen=True)
class Settings:
    """rate: step; least: rows of a leaf; share: of the features, drawn anew for each node; patience: rounds without a better loss of the
    held-out rows after which fitting ends."""

    rounds: int = 100
    rate: float = 0.1
    depth: int = 3
    least: int = 32
    l2: float = 1.0
    bins: int = 128
    share: float = 1.0
    patience: int = 10
    seed: int = 42


#: Settings of the winner and the method model, but for rounds and step, which the number of jobs depends on.
WINNER = {"depth": 3, "least": 32, "l2": 4.4, "bins": 128, "share": 0.65}
METHOD = {"depth": 4, "least": 40, "l2": 2.0, "bins": 255, "share": 0.8}


@dataclass
class Tree:
    """Nodes in the order they were made; a node without a split has left 0. value: of the margin; n: training rows."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [math.nan])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    n: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, threshold: float) -> tuple[int, int]:
        self.feature[node], self.threshold[node], self.left[node], self.right[node] = feature, threshold, len(self.n), len(self.n) + 1
        for _ in range(2):
            for values, empty in ((self.feature, -1), (self.threshold, math.nan), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.n, 0.0)):
                values.append(empty)
        return self.left[node], self.right[node]

    def places(self, x: np.ndarray) -> np.ndarray:
        """The last node of each row's path."""
        at = np.zeros(len(x), np.int64)
        feature, threshold, left, right = (np.array(v) for v in (self.feature, self.threshold, self.left, self.right))
        rows = np.arange(len(x))
        while True:
            on = left[at] > 0
            if not on.any():
                return at
            r, a = rows[on], at[on]
            at[on] = np.where(x[r, feature[a]] <= threshold[a], left[a], right[a])

    def margins(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.places(x)]


@dataclass
class Forest:
    """base: the margin of each output; trees: (output, tree). Two classes have one output, the log odds of the second."""

    inputs: tuple[str, ...]
    classes: int
    base: list[float]
    trees: list[tuple[int, Tree]] = field(default_factory=list)
    #: Of the held-out rows, before each round.
    losses: list[float] = field(default_factory=list)

    @property
    def outputs(self) -> int:
        return 1 if self.classes == 2 else self.classes

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(np.array(self.base), (len(x), 1))
        for k, tree in self.trees:
            out[:, k] += tree.margins(x)
        return out


def shares(margins: np.ndarray) -> np.ndarray:
    """Probabilities of all classes from margins by output."""
    if margins.shape[1] == 1:
        margins = np.column_stack([np.zeros(len(margins)), margins[:, 0]])
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


# -- fitting


def cuts(rows: DataFrame, inputs: tuple[str, ...], bins: int) -> list[np.ndarray]:
    """Ascending upper limits of each input's bins, from quantiles; the last bin has none. One row of at most bins - 1 numbers an input."""
    at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = rows.agg(*[F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), at, F.lit(100 * bins)).alias(f"c{i}") for i, c in enumerate(inputs)]).first()
    return [np.unique(np.array(found[f"c{i}"] or [], float)) for i in range(len(inputs))]


def _bin_batches(limits: list[np.ndarray]):
    """bins of each input; a value equal to a limit is in its bin, a missing one in the last."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            cols = [np.searchsorted(e, np.nan_to_num(batch.column(i).to_numpy(zero_copy_only=False).astype(float), nan=np.inf), side="left") for i, e in enumerate(limits)]
            flat = pa.array(np.stack(cols, axis=1).astype(np.int16).reshape(-1) if cols else np.zeros(0, np.int16))
            bins = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(limits)), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[len(limits) :], bins], names=["y", "w", "held_out", "margins", "bins"])

    return run


def _arrays(batch: pa.RecordBatch, features: int, outputs: int):
    bins = batch.column("bins").flatten().to_numpy().reshape(-1, features)
    margins = batch.column("margins").flatten().to_numpy().reshape(-1, outputs).copy()
    return bins, margins, batch.column("y").to_numpy(), batch.column("w").to_numpy(), batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)


def _sum_batches(shared, stored: int, features: int, outputs: int, width: int):
    """Sums of a task over the first `features` of the stored bins: a (3, features, width) block of gradients, second derivatives and rows for each output and open node; output -1 has
    the held-out rows' loss and weight. Trees are over bins here, so thresholds are numbers of bins."""

    def run(batches):
        done, growing, open_nodes = shared.value
        sums = {(k, node): np.zeros((3, features, width)) for k in range(outputs) for node in open_nodes[k]}
        loss = np.zeros(2)
        column = np.arange(features) * width
        for batch in batches:
            bins, margins, y, w, held = _arrays(batch, stored, outputs)
            bins = bins[:, :features]
            for k, tree in done:
                margins[:, k] += tree.margins(bins)
            p = shares(margins)
            loss += [-(w * np.log(np.maximum(p[np.arange(len(p)), y], 1e-300)))[held].sum(), w[held].sum()]
            for k in range(outputs):
                q = p[:, 1] if outputs == 1 else p[:, k]
                g, h = w * (q - (y == (1 if outputs == 1 else k))), w * q * (1 - q)
                at = growing[k].places(bins)
                for node in open_nodes[k]:
                    on = (at == node) & ~held
                    cell = (bins[on] + column).reshape(-1)
                    for i, v in enumerate((g[on], h[on], np.ones(int(on.sum())))):
                        sums[k, node][i] += np.bincount(cell, np.repeat(v, features), features * width).reshape(features, width)
        rows = [(-1, 0, loss.tobytes()), *((k, node, m.tobytes()) for (k, node), m in sums.items())]
        salt = TaskContext.get().partitionId() % SALTS
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([salt] * len(rows), pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["k", "node", "salt", "sums"])

    return run


def _added(key, t):
    total = np.sum([np.frombuffer(m) for m in t.column("sums").to_pylist()], axis=0)
    return pa.table({"k": t.column("k").slice(0, 1), "node": t.column("node").slice(0, 1), "salt": pa.array([0], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


_SUMS = "k int, node int, salt int, sums binary"


def best_split(block: np.ndarray, features: np.ndarray, s: Settings) -> tuple[float, int, int] | None:
    """(gain, feature, last bin of the left side) of the largest gain, None if no split gains; block: (3, features, width)."""
    g, h, n = block.cumsum(axis=2)[:, features, :-1]
    total_g, total_h, total_n = block[:, 0, :].sum(axis=1)
    worth = lambda a, b: a * a / (b + s.l2 + 1e-12)
    gain = worth(g, h) + worth(total_g - g, total_h - h) - worth(total_g, total_h)
    gain = np.where((n >= s.least) & (total_n - n >= s.least), gain, -np.inf)
    if not gain.size or not gain.max() > 1e-9:
        return None
    # Equal gains, up to rounding, go to the first feature and bin.
    at = np.flatnonzero(gain.reshape(-1) >= gain.max() * (1 - 1e-9))[0]
    return float(gain.reshape(-1)[at]), int(features[at // gain.shape[1]]), int(at % gain.shape[1])


@dataclass
class Binned:
    """Rows ready to be fitted: inputs, upper limits of their bins, the number of classes, base margins, and the table of bins."""

    inputs: tuple[str, ...]
    limits: list[np.ndarray]
    classes: int
    base: list[float]
    table: DataFrame


def binned(rows: DataFrame, inputs: tuple[str, ...], label: str, classes: int, bins: int, weight: Column | None = None, held_out: Column | None = None) -> Binned:
    """What models of the same rows share, however many are fitted: each takes as many of the first inputs as it likes."""
    workers_can_import(rows.sparkSession)
    held = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    x = rows.where(F.col(label).isNotNull()).select(*inputs, F.col(label).cast("int").alias("y"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("w"), held.alias("held_out"))
    limits = cuts(x.where("NOT held_out"), inputs, bins)
    counts = {r["y"]: r["w"] for r in x.where("NOT held_out").groupBy("y").agg(F.sum("w").alias("w")).collect()}  # a row for each class
    prior = np.maximum(np.array([counts.get(k, 0.0) for k in range(classes)]), 1e-9)
    base = [float(np.log(prior[1] / prior[0]))] if classes == 2 else np.log(prior / prior.sum()).tolist()
    start = x.select(*[F.col(c).cast("double") for c in inputs], "y", "w", "held_out", F.array(*[F.lit(b) for b in base]).alias("margins"))
    table = staged(start.mapInArrow(_bin_batches(limits), "y int, w double, held_out boolean, margins array<double>, bins array<smallint>"), "binned")
    return Binned(tuple(inputs), limits, classes, base, table)


def fit(rows: DataFrame, inputs: tuple[str, ...], label: str, classes: int, settings: Settings = Settings(), weight: Column | None = None, held_out: Column | None = None) -> Forest:
    """A model of label (0 to classes - 1) on inputs. Rows where held_out holds decide when to stop only."""
    return fit_binned(binned(rows, inputs, label, classes, settings.bins, weight, held_out), len(inputs), settings)


def fit_binned(rows: Binned, features: int, settings: Settings) -> Forest:
    """A model on the first `features` inputs; settings.bins is that of the bins."""
    s, classes, table, stored, limits = settings, rows.classes, rows.table, len(rows.inputs), rows.limits[:features]
    inputs, outputs, spark = rows.inputs[:features], 1 if rows.classes == 2 else rows.classes, rows.table.sparkSession
    width = max((len(e) for e in limits), default=0) + 1
    forest = Forest(inputs, classes, rows.base)
    rng = np.random.default_rng(s.seed)
    made: list[list[tuple[int, Tree]]] = []  # by round
    fresh: list[tuple[int, Tree]] = []  # of the rounds that the table's margins lack

    def sums_of(growing: list[Tree], open_nodes: list[list[int]]) -> dict:
        shared = spark.sparkContext.broadcast((fresh, growing, open_nodes))
        by = table.mapInArrow(_sum_batches(shared, stored, features, outputs, width), _SUMS)
        if len(table.inputFiles()) > SALTS:  # of a few files, no sum has more than SALTS parts anyway
            by = by.groupBy("k", "node", "salt").applyInArrow(_added, _SUMS)
        by = by.groupBy("k", "node").applyInArrow(_added, _SUMS)
        found = {(r["k"], r["node"]): np.frombuffer(r["sums"]) for r in by.collect()}  # bins of the open nodes
        loss = found.pop((-1, 0), np.zeros(2))
        if growing[0].n == [0.0] and loss[1]:  # before the round
            forest.losses.append(float(loss[0] / loss[1]))
        return found

    def worn_out() -> bool:
        return bool(forest.losses) and len(forest.losses) - 1 - int(np.argmin(forest.losses)) >= s.patience

    for number in range(s.rounds):
        growing, open_nodes = [Tree() for _ in range(outputs)], [[0] for _ in range(outputs)]
        for _ in range(s.depth):
            found = sums_of(growing, open_nodes)
            if worn_out():
                break
            open_nodes = [[c for node in open_nodes[k] for c in _split(growing[k], node, found.get((k, node)), limits, rng, s, width)] for k in range(outputs)]
            if not any(open_nodes):
                break
        grown = [(k, t) for k, t in enumerate(growing) if t.left[0]]
        if worn_out() or not grown:
            break
        made.append([(k, _with_limits(t, limits)) for k, t in grown])
        fresh = fresh + grown
        if (number + 1) % WRITTEN == 0 and number + 1 < s.rounds:
            table = staged(table.mapInArrow(_margin_batches(spark.sparkContext.broadcast(fresh), stored, outputs), "y int, w double, held_out boolean, margins array<double>, bins array<smallint>"), "binned")
            fresh = []
    if forest.losses and len(forest.losses) == len(made):  # the last round's loss
        sums_of([Tree() for _ in range(outputs)], [[] for _ in range(outputs)])
    kept = int(np.argmin(forest.losses)) if forest.losses else len(made)
    forest.trees = [x for r in made[:kept] for x in r]
    return forest


def _split(tree: Tree, node: int, sums: np.ndarray | None, limits: list[np.ndarray], rng: np.random.Generator, s: Settings, width: int) -> list[int]:
    """The new children of a node, none if no split of the features drawn for it gains."""
    features = len(limits)
    drawn = np.sort(rng.permutation(features)[: max(1, math.ceil(s.share * features))])
    if sums is None or not features:
        return []
    block = sums.reshape(3, features, width)
    if node == 0:
        tree.n[0] = float(block[2, 0].sum())
    split = best_split(block, drawn, s)
    if split is None:
        return []
    _, feature, last = split
    children = tree.split(node, feature, last)
    for child, side in zip(children, (block[:, feature, : last + 1], block[:, feature, last + 1 :])):
        g, h, n = side.sum(axis=1)
        tree.value[child], tree.n[child] = float(-s.rate * g / (h + s.l2 + 1e-12)), float(n)
    return list(children)


def _with_limits(tree: Tree, limits: list[np.ndarray]) -> Tree:
    """The tree over values instead of bins."""
    at = [float(limits[f][int(b)]) if f >= 0 else math.nan for f, b in zip(tree.feature, tree.threshold)]
    return Tree(list(tree.feature), at, list(tree.left), list(tree.right), list(tree.value), list(tree.n))


def _margin_batches(shared, features: int, outputs: int):
    def run(batches):
        for batch in batches:
            bins, margins, *_ = _arrays(batch, features, outputs)
            for k, tree in shared.value:
                margins[:, k] += tree.margins(bins)
            cut = pa.array(np.arange(len(margins) + 1, dtype=np.int32) * outputs)
            at = batch.schema.get_field_index("margins")
            yield batch.set_column(at, "margins", pa.ListArray.from_arrays(cut, pa.array(margins.reshape(-1))))

    return run


# -- scoring


def _score_batches(shared, own: int):
    def run(batches):
        forest = shared.value
        for batch in batches:
            x = np.column_stack([batch.column(own + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(forest.inputs))]) if forest.inputs else np.zeros((batch.num_rows, 0))
            p = shares(forest.margins(x))
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], *[pa.array(p[:, k]) for k in range(p.shape[1])]], names=[*batch.schema.names[:own], *[f"p{k}" for k in range(p.shape[1])]])

    return run


def scored(forest: Forest, rows: DataFrame, keep: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """keep, and the probability of each class under its name."""
    workers_can_import(rows.sparkSession)
    x = rows.select(*keep, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(forest.inputs)])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema] + [f"p{k} double" for k in range(forest.classes)]
    out = x.mapInArrow(_score_batches(rows.sparkSession.sparkContext.broadcast(forest), len(keep)), ", ".join(fields))
    return out.select(*keep, *[F.col(f"p{k}").alias(n) for k, n in enumerate(names)])


def saved(forest: Forest, spark: SparkSession, path: str) -> None:
    """The model as a table: one row for each node; row -1 has the base margins and the inputs."""
    rows = [(-1, k, i, None, None, None, None, b, None, None) for k, b in enumerate(forest.base) for i in (0,)]
    rows = [(t, k, i, tree.feature[i], tree.threshold[i], tree.left[i], tree.right[i], tree.value[i], tree.n[i], None) for t, (k, tree) in enumerate(forest.trees) for i in range(len(tree.n))] + [(*r[:9], list(forest.inputs)) for r in rows]
    spark.createDataFrame(rows, "tree int, output int, node int, feature int, threshold double, `left` int, `right` int, value double, n double, inputs array<string>").coalesce(1).write.mode("overwrite").parquet(path)


def loaded(spark: SparkSession, path: str) -> Forest:
    rows = spark.read.parquet(path).orderBy("tree", "output", "node").collect()  # the nodes of a model
    base = [r for r in rows if r["tree"] < 0]
    trees: list[tuple[int, Tree]] = []
    for r in rows:
        if r["tree"] < 0:
            continue
        if r["node"] == 0:
            trees.append((r["output"], Tree([], [], [], [], [], [])))
        t = trees[-1][1]
        for values, v in ((t.feature, r["feature"]), (t.threshold, r["threshold"]), (t.left, r["left"]), (t.right, r["right"]), (t.value, r["value"]), (t.n, r["n"])):
            values.append(v)
    return Forest(tuple(base[0]["inputs"]), 2 if len(base) == 1 else len(base), [r["value"] for r in base], trees)


# -- exact contributions


def _extended(w: np.ndarray, on: np.ndarray, share: float) -> np.ndarray:
    """The polynomial w (coefficients by column, one row each) times (share + on * y): a feature joins the path."""
    out = np.zeros((w.shape[0], w.shape[1] + 1))
    out[:, :-1] += w * share
    out[:, 1:] += w * on[:, None]
    return out


def _unwound(w: np.ndarray, on: np.ndarray, share: float) -> np.ndarray:
    """w over (share + on * y): a feature leaves the path."""
    out = np.empty((w.shape[0], w.shape[1] - 1))
    above = w[:, -1]
    for k in range(w.shape[1] - 2, -1, -1):
        out[:, k] = np.where(on > 0, above, w[:, k] / share)
        above = w[:, k] - share * out[:, k]
    return out


def shapley(x: np.ndarray, trees: list[Tree]) -> tuple[float, np.ndarray]:
    """(base, by feature): Shapley values of the sum of the trees, where a feature outside of a subset sends a row both ways by the
    training rows of each side. Along a path, the j-th coefficient of a polynomial is the sum over subsets of j of its
    features; a split extends it, a feature that comes again is unwound first, and at a leaf each feature is unwound to
    weigh the subsets without it."""
    base, out = 0.0, np.zeros(x.shape)

    def down(t: Tree, node: int, path: dict[int, tuple[np.ndarray, float]], w: np.ndarray, reached: float) -> None:
        nonlocal base
        if not t.left[node]:
            base += reached * t.value[node]
            m = len(path)
            weights = np.array([math.factorial(j) * math.factorial(m - 1 - j) / math.factorial(m) for j in range(m)])
            for f, (on, share) in path.items():
                out[:, f] += t.value[node] * (on - share) * (_unwound(w, on, share) @ weights)
            return
        f = t.feature[node]
        goes_left = x[:, f] <= t.threshold[node]
        own_on, own_share = path.get(f, (np.ones(len(x)), 1.0))
        rest = _unwound(w, own_on, own_share) if f in path else w
        for child, goes in ((t.left[node], goes_left), (t.right[node], ~goes_left)):
            part = t.n[child] / t.n[node]  # above 0: a leaf has training rows
            on, share = own_on * goes, own_share * part
            down(t, child, path | {f: (on, share)}, _extended(rest, on, share), reached * part)

    for tree in trees:
        down(tree, 0, {}, np.ones((len(x), 1)), 1.0)
    return base, out


def _shapley_batches(shared, output: int):
    def run(batches):
        forest = shared.value
        trees = [t for k, t in forest.trees if k == output]
        names = np.array(forest.inputs)
        for t in batches:
            x = t.iloc[:, 1:].to_numpy(float)
            base, by = shapley(x, trees)
            n = len(names)
            yield pd.DataFrame({"fight_id": np.repeat(t["fight_id"].to_numpy(), n), "feature": np.tile(names, len(t)), "contribution": by.reshape(-1), "value": x.reshape(-1), "base": base + forest.base[output]})

    return run


def contributions(forest: Forest, rows: DataFrame, output: int = 0) -> DataFrame:
    """fight_id, feature, contribution, value, base: base and a bout's contributions add up to the margin of the output."""
    workers_can_import(rows.sparkSession)
    x = rows.select("fight_id", *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(forest.inputs)])
    return x.mapInPandas(_shapley_batches(rows.sparkSession.sparkContext.broadcast(forest), output), "fight_id long, feature string, contribution double, value double, base double")
