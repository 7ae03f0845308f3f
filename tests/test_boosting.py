"""Boosting against a plain version, and contributions against all subsets."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelframe.operators import boosting
from duelframe.operators.boosting import Settings


def plain_fit(x, y, classes, s, w):
    """The same model grown over rows in memory: every limit of every feature is tried at every node."""
    limits = [np.unique(np.percentile(c, [100 * i / s.bins for i in range(1, s.bins)], method="inverted_cdf")) for c in x.T]
    outputs = 1 if classes == 2 else classes
    prior = np.array([w[y == k].sum() for k in range(classes)])
    base = [math.log(prior[1] / prior[0])] if outputs == 1 else np.log(prior / prior.sum()).tolist()
    margins = np.tile(base, (len(x), 1))
    for _ in range(s.rounds):
        p = boosting.shares(margins)
        step = np.zeros_like(margins)
        for k in range(outputs):
            q = p[:, 1] if outputs == 1 else p[:, k]
            g, h = w * (q - (y == (1 if outputs == 1 else k))), w * q * (1 - q)

            def grow(rows, depth, value):
                best = (1e-9, None)
                if depth:
                    for f in range(x.shape[1]):
                        for t in limits[f]:
                            a, b = rows[x[rows, f] <= t], rows[~(x[rows, f] <= t)]
                            if min(len(a), len(b)) >= s.least:
                                worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + s.l2)
                                gain = worth(a) + worth(b) - worth(rows)
                                if gain > best[0] * (1 + 1e-9):
                                    best = (gain, (a, b))
                if best[1] is None:
                    step[rows, k] = value
                    return
                for side in best[1]:
                    grow(side, depth - 1, -s.rate * g[side].sum() / (h[side].sum() + s.l2))

            grow(np.arange(len(x)), s.depth, 0.0)
        margins = margins + step
    return boosting.shares(margins)


def made_rows(classes, n=400, d=3):
    rng = np.random.default_rng(classes)
    x = np.round(rng.standard_normal((n, d)), 2)
    y = np.digitize(x[:, 0] + 0.5 * x[:, 1] * (x[:, 2] > 0) + 0.3 * rng.standard_normal(n), [-0.4, 0.6][: classes - 1])
    return x, y, rng.uniform(0.5, 2, n)


@pytest.mark.parametrize("classes", [2, 3])
def test_equals_a_plain_version(spark, monkeypatch, classes):
    monkeypatch.setattr(boosting, "WRITTEN", 2)  # margins are written in between
    monkeypatch.setattr(boosting, "SALTS", 16 if classes == 2 else 2)  # added at once, and in two steps
    x, y, w = made_rows(classes)
    s = Settings(rounds=4, rate=0.3, depth=3, least=10, l2=2.0, bins=16)
    df = spark.createDataFrame([(i, *map(float, r), int(c), float(v)) for i, (r, c, v) in enumerate(zip(x, y, w))], "id long, a double, b double, c double, y int, w double").repartition(5)
    forest = boosting.fit(df, ("a", "b", "c"), "y", classes, s, F.col("w"))
    assert len(forest.trees) == 4 * forest.outputs
    names = tuple(f"p_{k}" for k in range(classes))
    got = np.array([[r[n] for n in names] for r in boosting.scored(forest, df, ("id",), names).orderBy("id").collect()])
    assert np.allclose(got.sum(axis=1), 1) and np.allclose(got, plain_fit(x, y, classes, s, w), atol=1e-9)


def test_stops_early_and_survives_being_saved(spark, tmp_path):
    x, y, _ = made_rows(3)
    y = np.where(np.random.default_rng(1).random(len(y)) < 0.5, y[::-1], y)  # half of the labels tell nothing
    df = spark.createDataFrame([(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y))], "id long, a double, b double, c double, y int")
    forest = boosting.fit(df, ("a", "b", "c"), "y", 3, Settings(rounds=40, rate=0.5, depth=3, least=5, l2=0.0, bins=32, patience=3), held_out=F.col("id") % 4 == 0)
    best = int(np.argmin(forest.losses))
    assert len(forest.losses) - 1 - best == 3 and len(forest.trees) == 3 * best < 3 * 40
    boosting.saved(forest, spark, str(tmp_path / "m"))
    back = boosting.loaded(spark, str(tmp_path / "m"))
    assert back.inputs == forest.inputs and back.classes == 3 and np.array_equal(back.margins(x), forest.margins(x))


def test_missing_values_and_hard_tables(spark):
    df = spark.createDataFrame([(float(i), None if i % 3 else 1.0, int(i % 2 == 0 or i > 60)) for i in range(100)] + [(float("nan"), None, 0)] * 20 + [(1.0, 1.0, None)], "a double, b double, y int")
    forest = boosting.fit(df, ("a", "b"), "y", 2, Settings(rounds=3, least=5, bins=8))
    assert forest.trees and all(len(t.n) == 2 * sum(v > 0 for v in t.left) + 1 for _, t in forest.trees)
    assert boosting.scored(forest, df, (), ("p0", "p1")).where("p1 >= 0 AND p1 <= 1").count() == 121
    assert boosting.fit(df.limit(0), ("a", "b"), "y", 3, Settings(rounds=2)).trees == []
    one = boosting.fit(df.where("y = 1"), ("a", "b"), "y", 2, Settings(rounds=2, least=5))
    assert boosting.scored(one, df, (), ("p0", "p1")).where("p1 < 0.999").count() == 0


def grown(rng, d, depth):
    """A tree of random splits; features come again on a path."""
    t = boosting.Tree()
    t.n[0] = 1000.0

    def grow(node, depth):
        if not depth or t.n[node] < 2 or rng.random() < 0.15:
            t.value[node] = float(rng.standard_normal())
            return
        a, b = t.split(node, int(rng.integers(0, d)), float(np.round(rng.standard_normal(), 1)))
        t.n[a] = float(np.clip(np.ceil(t.n[node] * rng.uniform(0.1, 0.9)), 1, t.n[node] - 1))
        t.n[b] = t.n[node] - t.n[a]
        grow(a, depth - 1)
        grow(b, depth - 1)

    grow(0, depth)
    return t


def expected(t, x, known, node=0):
    """The tree's value for a row of which only the known features count."""
    if not t.left[node]:
        return t.value[node]
    a, b = t.left[node], t.right[node]
    if t.feature[node] in known:
        return expected(t, x, known, a if x[t.feature[node]] <= t.threshold[node] else b)
    return (t.n[a] * expected(t, x, known, a) + t.n[b] * expected(t, x, known, b)) / t.n[node]


def test_contributions_equal_all_subsets():
    rng, d = np.random.default_rng(2), 5
    trees = [grown(rng, d, 5) for _ in range(4)]
    x = np.round(rng.standard_normal((12, d)), 1)
    base, got = boosting.shapley(x, trees)
    value = lambda row, known: sum(expected(t, row, known) for t in trees)
    assert base == pytest.approx(value(x[0], set()))
    for i, row in enumerate(x):
        for f in range(d):
            rest = [g for g in range(d) if g != f]
            want = sum(
                math.factorial(m) * math.factorial(d - 1 - m) / math.factorial(d) * (value(row, {*sub, f}) - value(row, set(sub)))
                for m in range(d) for sub in itertools.combinations(rest, m)
            )
            assert got[i, f] == pytest.approx(want, abs=1e-9)
        assert base + got[i].sum() == pytest.approx(value(row, set(range(d))), abs=1e-9)


def test_contributions_add_up_to_margins(spark):
    x, y, _ = made_rows(3)
    df = spark.createDataFrame([(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y))], "fight_id long, a double, b double, c double, y int")
    forest = boosting.fit(df, ("a", "b", "c"), "y", 3, Settings(rounds=3, rate=0.3, least=10, bins=16))
    want = forest.margins(x)
    for k in range(3):
        got = boosting.contributions(forest, df, k).groupBy("fight_id").agg((F.sum("contribution") + F.first("base")).alias("m")).orderBy("fight_id").toPandas()
        assert np.allclose(got["m"], want[:, k], atol=1e-9)


def test_winner_model_tells_more_than_chance(spark):
    """On a result that the ratings decide, the model beats the majority on later bouts, and top contributions are its largest."""
    from duelframe.operators import learned, models

    from .conftest import SF

    m = learned.prepared(spark, SF)
    forest = models.winner_forest(m, rounds=3)
    top = models.top_contributions(forest, m.where("part = 2"), top=5).toPandas()
    assert set(top.groupby("fight_id")["rank"].max()) == {5} and forest.inputs == learned.INPUTS
    every = boosting.contributions(forest, m.where("part = 2")).toPandas()
    largest = every.assign(size=every["contribution"].abs()).groupby("fight_id")["size"].max()
    assert np.allclose(top[top["rank"] == 1].set_index("fight_id")["contribution"].abs().sort_index(), largest.sort_index())
    made = m.withColumn("label", (F.col("diff_elo") + F.col("diff_avg_won") > 0).cast("double"))
    scored = boosting.scored(models.winner_forest(made, rounds=8), made.where("part > 0"), ("label",), ("p0", "p1")).toPandas()
    assert ((scored["p1"] >= 0.5) == (scored["label"] == 1)).mean() > 0.9 > max(scored["label"].mean(), 1 - scored["label"].mean())


def test_joint_method_model_loses_no_more_than_one_model_a_class(spark):
    from duelframe.operators import learned, models

    from .conftest import SF

    rows = learned.method_rows(spark, SF)
    joint = boosting.scored(models.method_forest(rows, rounds=12), rows.where("part > 0"), ("fight_id", "part", "method_class"), ("p_ko", "p_sub", "p_dec")).toPandas()
    single = learned.method_scores(spark, SF).toPandas()
    x = joint.merge(single, on=["fight_id", "part", "method_class"])
    assert len(x) == len(single) and np.allclose(x[["p_ko", "p_sub", "p_dec"]].sum(axis=1), 1)
    loss = lambda p: -np.mean([math.log(max(r[f"{p}_{r['method_class']}"], 1e-15)) for _, r in x.iterrows()])
    assert loss("p") <= loss("r") + 1e-9
