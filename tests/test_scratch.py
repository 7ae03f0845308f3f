"""Tables of one block go with it; features are taken some at a time; trials share their bins."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelframe import session
from duelframe.operators import boosting, information


def _rows(spark):
    return spark.range(600).select("id", (F.col("id") % 2).cast("int").alias("y"), *[(F.rand(i) + F.col("id") % 2 * i / 3).alias(f"x{i}") for i in range(4)]).localCheckpoint()


def test_scratch_tables_go(spark):
    before = spark.conf.get(session.CLEANED, None)
    with pytest.raises(ZeroDivisionError), session.scratch(spark) as stage:
        x = stage(spark.range(10), "scratch")
        at = x.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
        assert x.count() == 10 and os.path.isdir(at)
        raise ZeroDivisionError
    assert not os.path.exists(at) and spark.conf.get(session.CLEANED, None) == before


def test_information_some_features_at_a_time(spark, monkeypatch):
    """The same as at once, and no table of any group is left."""
    x, names = _rows(spark), tuple(f"x{i}" for i in range(4))
    want = {r.feature: r.information for r in information.information(x, names, "y", "id").collect()}
    monkeypatch.setattr(information, "VALUES", 1_300)  # two of 600 values each
    asked = []
    monkeypatch.setattr(information, "_sums", lambda long, k, n, features, stage, f=information._sums: asked.append(features) or f(long, k, n, features, stage))
    monkeypatch.setattr(session, "new_path", lambda s, name, f=session.new_path: made.append(f(s, name)) or made[-1])
    made = []
    got = {r.feature: r.information for r in information.information(x, names, "y", "id").collect()}
    assert [len(f) for f in asked] == [2, 2] and got == pytest.approx(want, rel=1e-9)
    assert made and not any(os.path.exists(p.removeprefix("file://").removeprefix("file:")) for p in made)


def test_models_of_shared_bins_are_those_of_their_own(spark):
    x, names = _rows(spark), ("x3", "x2", "x1", "x0")
    shared = boosting.binned(x, names, "y", 2, 16)
    for n in (1, 3, 4):
        s = boosting.Settings(rounds=12, least=5, bins=16, share=0.7)
        a, b = boosting.fit_binned(shared, n, s), boosting.fit(x, names[:n], "y", 2, s)
        assert a.inputs == names[:n] and a.trees and np.allclose(*[f.margins(np.random.default_rng(1).random((50, n))) for f in (a, b)])
