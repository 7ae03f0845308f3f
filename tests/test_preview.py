"""Preview documents against the queries that they gather; importance and folds by time."""

import json

import numpy as np
from pyspark.sql import functions as F

from duelframe.operators import boosting, learned, models, preview
from duelframe.sources import adapter

from .conftest import SF


def test_documents_hold_what_their_parts_tell(spark):
    docs = {r.fight_id: json.loads(r.document) for r in preview.preview_documents(spark, SF).collect()}
    up = {r.fight_id: r for r in adapter.upcoming(spark, SF).collect()}
    assert set(docs) == set(up)
    recent = {}
    for r in preview.recent_bouts(spark, SF).collect():
        recent.setdefault((r.fight_id, r.corner), {})[r.place] = r
    quotes = {r.fight_id: r.n for r in adapter.quotes(spark, SF).groupBy("fight_id").agg(F.count("*").alias("n")).collect()}
    table = {r.fight_id: r for r in models.model_predictions(spark, SF).collect()}
    assert any(len(v) == preview.LAST_BOUTS for v in recent.values())
    for i, d in docs.items():
        assert d["red"]["fighter_id"] == up[i].red_id and d["blue"]["fighter_id"] == up[i].blue_id and d["event"]["name"].startswith("Card")
        for c in ("red", "blue"):
            want = recent.get((i, c), {})
            got = d[c].get("recent", [])
            assert [x["recent_id"] for x in got] == [want[k].recent_id for k in sorted(want)] and all(x["result"] in ("Win", "Loss") and "/" in x["sig_str"] and ":" in x["ctrl"] for x in got)
        assert abs(d["prediction"]["red_prob"] - table[i].red_prob) <= 0.0006 and d["method_prediction"]["predicted_method"] == table[i].predicted_method
        assert [x["rank"] for x in d["contributions"]] == list(range(1, preview.TOP + 1)) and len(d.get("odds", [])) == quotes.get(i, 0)


def test_importance_of_the_one_input_that_counts(spark, monkeypatch):
    monkeypatch.setattr(models, "BLOCK", 100)
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, float(a), float(b), float(a > 0)) for i, (a, b) in enumerate(rng.standard_normal((400, 2)))], "fight_id long, a double, b double, label double")
    forest = boosting.fit(df.withColumn("y", F.col("label").cast("int")), ("a", "b"), "y", 2, boosting.Settings(rounds=3, rate=0.5, least=20))
    got = {r.feature: r for r in models.importance(forest, df, repeats=4).collect()}
    again = {r.feature: r for r in models.importance(forest, df.repartition(5), repeats=4).collect()}
    assert got == again
    assert got["a"].accuracy > 0.97 and 0.35 < got["a"].importance < 0.6 and abs(got["b"].importance) < 0.05 and got["a"].deviation > 0


def test_folds_are_units_of_time(spark):
    m = learned.winner_matchups(spark, SF)
    x = models.folds_by(m, "week", 2).select("fight_id", "fold", F.date_trunc("week", F.col("ts").cast("timestamp")).alias("unit")).collect()
    assert len(x) == m.count()
    by = {}
    for r in x:
        by.setdefault(r.fold, set()).add(r.unit)
    assert len(by[1]) == len(by[2]) == 1 and max(by[0]) < min(by[1]) < min(by[2])
