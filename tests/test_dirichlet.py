"""Dirichlet calibration against gradient steps in memory."""

import numpy as np
import pytest

from duelframe.operators import dirichlet


def soft(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def plain(p, y, penalty):
    """(W, b) by small steps downhill, each of a size that lowers the loss."""
    k, x = p.shape[1], np.log(np.maximum(p, dirichlet.FLOOR))
    w, b, size = np.eye(k), np.zeros(k), 1.0
    loss = lambda w, b: -np.mean(np.log(soft(x @ w.T + b)[np.arange(len(y)), y])) + penalty * ((w - np.eye(k)) ** 2).sum()
    now = loss(w, b)
    for _ in range(20_000):
        d = soft(x @ w.T + b)
        d[np.arange(len(y)), y] -= 1
        gw, gb = d.T @ x / len(y) + 2 * penalty * (w - np.eye(k)), d.mean(axis=0)
        while (after := loss(w - size * gw, b - size * gb)) > now - 0.25 * size * ((gw**2).sum() + (gb**2).sum()) and size > 1e-12:
            size /= 2
        w, b, now, size = w - size * gw, b - size * gb, after, size * 1.5
        if (gw**2).sum() + (gb**2).sum() < 1e-18:
            break
    return w, b


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    z = rng.standard_normal((400, 3)) * 1.5
    p = soft(z)
    y = np.array([rng.choice(3, p=r) for r in soft(z * 0.5 + [0.4, 0.0, -0.3])])  # the probabilities are too sure, and lean
    df = spark.createDataFrame([(*map(float, r), int(c)) for r, c in zip(p, y)] + [(0.2, 0.3, 0.5, None), (None, 0.5, 0.5, 1)], "a double, b double, c double, y int")
    return df, p, y


@pytest.mark.parametrize("penalty", [0.01, 0.5])
def test_equals_plain_steps(rows, penalty):
    df, p, y = rows
    w, b = dirichlet.fit(df, ["a", "b", "c"], "y", penalty)
    want_w, want_b = plain(p, y, penalty)
    assert np.allclose(w, want_w, atol=1e-5) and np.allclose(b - b.mean(), want_b - want_b.mean(), atol=1e-5)


def test_a_large_penalty_leaves_the_identity(rows):
    w, _ = dirichlet.fit(rows[0], ["a", "b", "c"], "y", 1e6)
    assert np.allclose(w, np.eye(3), atol=1e-5)


def test_loses_no_more_than_the_uncalibrated(rows):
    df, p, y = rows
    out = dirichlet.apply(df, *dirichlet.fit(df, ["a", "b", "c"], "y"), ["a", "b", "c"], ["x", "y1", "z"]).where("y IS NOT NULL AND a IS NOT NULL").toPandas()
    q = out[["x", "y1", "z"]].to_numpy()
    assert np.allclose(q.sum(axis=1), 1)
    assert -np.mean(np.log(q[np.arange(len(y)), out["y"]])) < -np.mean(np.log(p[np.arange(len(y)), y]))


def test_no_rows(rows):
    w, b = dirichlet.fit(rows[0].limit(0), ["a", "b", "c"], "y")
    assert np.array_equal(w, np.eye(3)) and np.array_equal(b, np.zeros(3))
