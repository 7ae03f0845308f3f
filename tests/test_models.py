"""The predictions table, and queries over it against their oracles with that table as input."""

import re

import pytest
from pyspark.sql import functions as F

from duelframe.operators import learned, models
from duelframe.plans.registry import ORACLES
from duelframe.sources import adapter

from .conftest import SF
from .test_oracles import close, rows


@pytest.fixture(scope="module")
def path(spark):
    at = models.predictions_path(spark, SF)
    assert models.predictions_path(spark, SF) == at  # made once
    return at


def test_every_bout_is_predicted(spark, path):
    t = spark.read.parquet(path)
    bouts = adapter.bouts(spark, SF)
    last = bouts.agg(F.max("date")).first()[0]
    assert t.count() == t.select("fight_id").distinct().count() == bouts.count()
    assert {r.fight_id for r in t.where("upcoming").collect()} == {r.fight_id for r in bouts.where(F.col("date") == last).collect()}
    bad = t.where("red_prob NOT BETWEEN 0 AND 1 OR confidence NOT BETWEEN 0 AND 0.5 OR va_low > va_high OR predicted_winner <> if(red_prob > 0.5, 'red', 'blue') AND red_prob <> 0.5 OR abs(p_ko + p_sub + p_dec - 1) > 0.001 OR predicted_method NOT IN ('ko', 'sub', 'dec') OR red_prob IS NULL OR predicted_method IS NULL")
    assert bad.count() == 0
    top = spark.read.parquet(f"{path}-contributions").groupBy("fight_id").agg(F.count("*").alias("n"))
    assert top.count() == t.count() and top.where(f"n <> {models.TOP}").count() == 0


def test_upcoming_bouts_have_the_newest_form(spark):
    m = learned.winner_matchups(spark, SF, upcoming=True).where("upcoming")
    last = F.to_date(F.lit(str(adapter.bouts(spark, SF).agg(F.max("date")).first()[0])))
    s = adapter.sides(spark, SF)
    before = s.where(F.col("date") < last).groupBy("fighter_id").agg(F.sum(F.col("won") + F.col("lost")).alias("n"))
    b = adapter.bouts(spark, SF).select("fight_id", "red_id", "blue_id")
    want = m.select("fight_id", "red_career_fights", "blue_career_fights", "label").join(b, "fight_id").join(before.withColumnsRenamed({"fighter_id": "red_id", "n": "r"}), "red_id", "left").join(before.withColumnsRenamed({"fighter_id": "blue_id", "n": "b"}), "blue_id", "left")
    assert m.count() > 0 and want.where("label IS NOT NULL OR red_career_fights > coalesce(r, 0) OR blue_career_fights > coalesce(b, 0)").count() == 0
    assert want.where("red_career_fights > 0").count() > 0


@pytest.mark.parametrize("name", sorted(n for n in models.OVER_PREDICTIONS if n in ORACLES))
def test_queries_read_the_table(spark, duck, path, name):
    """The same oracle, with the written table in the place of the made-up predictions."""
    duck.sql(f"CREATE OR REPLACE VIEW written AS SELECT * FROM '{path.removeprefix('file:')}/*.parquet'")
    made_up = re.compile(r"preds AS \(SELECT fight_id, .*? FROM pr WHERE fight_id % 10 <> 8\)")
    table = "preds AS (SELECT fight_id, red_prob, predicted_method, va_low, va_high, CASE WHEN winner_id IS NOT NULL THEN CAST(winner_id = red_id AS INTEGER) END AS red_won, method, weight_class, finish_round FROM written JOIN pr USING (fight_id))"
    sql, n = made_up.subn(table, ORACLES[name])
    assert n == 1
    sql = re.sub(r"greatest\(red_prob - \(fight_id % 7\).*? AS p0", "va_low AS p0", sql)
    sql = re.sub(r"least\(red_prob \+ \(fight_id % 5\).*? AS p1", "va_high AS p1", sql)
    mine, theirs = models.QUERIES[f"model_{name}"](spark, SF).toPandas(), duck.sql(sql).df()
    a, b = rows(mine), rows(theirs)
    assert sorted(mine.columns) == sorted(theirs.columns) and len(a) == len(b)
    assert all(close(x, y) for r, s in zip(a, b) for x, y in zip(r, s))
    assert spark.conf.get(adapter.PREDICTIONS, None) is None
