"""Intervals against two isotonic fits for each score."""

import numpy as np
import pytest

from duelframe.operators import vennabers


def pooled(ones, n):
    """Isotonic means by pooling adjacent violators."""
    out = []
    for a, b in zip(ones, n):
        out.append([a, b, 1])
        while len(out) > 1 and out[-2][0] / out[-2][1] >= out[-1][0] / out[-1][1]:
            s, w, k = out.pop()
            out[-1] = [out[-1][0] + s, out[-1][1] + w, out[-1][2] + k]
    return [s / w for s, w, k in out for _ in range(k)]


def plain(scores, labels, at):
    """(p0, p1): the fit at a score that is added with the result 0, and with 1."""
    found = []
    for y in (0.0, 1.0):
        s, o = np.append(scores, at), np.append(labels, y)
        x = np.unique(s)
        ones, n = np.array([o[s == v].sum() for v in x]), np.array([(s == v).sum() for v in x])
        found.append(pooled(ones, n)[int(np.flatnonzero(x == at)[0])])
    return tuple(found)


@pytest.mark.parametrize("size,asked", [(100_000, 60), (7, 60)])
def test_equals_two_fits(spark, monkeypatch, size, asked):
    """In one range and in many; scores that were seen, others between them and outside."""
    monkeypatch.setattr(vennabers, "RANGE", size)
    rng = np.random.default_rng(size)
    scores = np.round(rng.random(150), 2)
    scores[:40] = rng.random(40)  # some that no other row has
    labels = (rng.random(150) < scores).astype(float)
    at = np.concatenate([[-1.0, 0.0, 2.0], scores[:30], rng.random(asked - 33)])
    cal = spark.createDataFrame([(float(s), float(y)) for s, y in zip(scores, labels)] + [(None, 1.0), (0.5, None)], "p double, label double")
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(at)] + [(-1, None)], "id long, p double")
    got = {r.id: r for r in vennabers.intervals(cal, rows).collect()}
    assert len(got) == asked + 1 and got[-1].va_low is None
    for i, v in enumerate(at):
        low, high = plain(scores, labels, v)
        assert (got[i].va_low, got[i].va_high) == (pytest.approx(low, abs=1e-12), pytest.approx(high, abs=1e-12))
        assert got[i].va_prob == pytest.approx(high / (1 - low + high))


def test_without_calibration(spark):
    rows = spark.createDataFrame([(0.3,)], "p double")
    got = vennabers.intervals(spark.createDataFrame([], "p double, label double"), rows).first()
    assert (got.va_low, got.va_high) == (0.0, 1.0)


def test_undo_brings_pools_back():
    stack = vennabers.Pools(True)
    seen = []
    for a, b in [(1.0, 2.0), (3.0, 3.0), (0.0, 4.0), (5.0, 5.0), (0.0, 1.0)]:
        seen.append((list(stack.ones), list(stack.n)))
        stack.push(a, b, keep=True)
    for want in reversed(seen):
        stack.undo()
        assert (stack.ones, stack.n) == want
