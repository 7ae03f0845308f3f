"""Properties of the learned models, with few rounds over the smallest tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelframe.operators import learned

from .conftest import SF


@pytest.fixture(scope="module")
def matchups(spark):
    return learned.prepared(spark, SF)


@pytest.fixture(scope="module")
def model(matchups):
    return learned.fit_winner(matchups, rounds=4)


def test_image_twice_is_identity(matchups):
    back = learned.image(learned.image(matchups)).select(*matchups.columns)
    cols = ["fight_id", "label", "diff_elo", "red_elo", "blue_elo", "odds_red_prob", "odds_diff"]
    assert matchups.select(*cols).exceptAll(back.select(*cols)).count() == 0


def test_parts_follow_time(matchups):
    r = matchups.groupBy("part").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("*").alias("n")).orderBy("part").collect()
    assert len(r) == 3 and r[0].hi < r[1].lo and r[1].hi < r[2].lo
    assert 0.75 < r[0].n / sum(x.n for x in r) < 0.85


def test_winner_is_calibrated(matchups, model):
    oof = learned.out_of_fold(matchups, folds=2, rounds=2)
    assert oof.count() == matchups.where("part = 0 AND label IS NOT NULL").count()
    x = learned.calibrated(matchups, model, oof)
    bad = x.where("va_low > va_high OR va_prob < 0 OR va_prob > 1 OR isotonic < 0.01 OR isotonic > 0.99 OR platt < 0 OR platt > 1")
    assert x.count() > 0 and bad.count() == 0
    s = learned.scores_of(x).collect()
    assert {r.method for r in s} == set(learned.METHODS) and sum(r.best for r in s) == 1 and all(0 <= r.accuracy <= 1 and r.brier <= 1 for r in s)


def test_methods_blend_to_distributions(spark):
    y = learned.method_scores(spark, SF)
    for m in "abrcdt":
        assert y.where(F.abs(sum([F.col(f"{m}_{c}") for c in learned.CLASSES[1:]], F.col(f"{m}_{learned.CLASSES[0]}")) - 1) > 1e-6).count() == 0


def test_blend_finds_the_better_side(spark):
    rows = [(c, *[0.9 if c == k else 0.05 for k in learned.CLASSES], *[1 / 3] * 3) for c in learned.CLASSES for _ in range(5)]
    df = spark.createDataFrame(rows, ["method_class", "a_ko", "a_sub", "a_dec", "b_ko", "b_sub", "b_dec"])
    assert tuple(learned.blend_weights(df, step=0.25).first())[:3] == (1.0, 1.0, 1.0)


def test_search_folds_the_same_again(spark):
    best = learned.parameter_search(spark, SF, trials=5, top=2).collect()
    assert len(best) == 2 and all(r.log_loss == r.again for r in best)
