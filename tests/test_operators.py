"""Properties of folds, frames, matchups, streams and the SQL guard."""

import datetime as dt
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from duelframe.operators import form, matchup, ratings, skills
from duelframe.plans import sql
from duelframe.plans.registry import QUERIES
from duelframe.sources import adapter
from duelframe.streaming import windows

from .conftest import SF


def test_elo_conserves_ratings(spark):
    rows = ratings.elo_history(spark, SF).groupBy("fight_id").agg(F.sum(F.col("elo_after") - F.col("elo_before")).alias("d")).collect()
    assert rows and all(abs(r.d) < 1e-5 for r in rows)


def test_elo_equals_plain_loop(spark):
    bouts = sorted(adapter.bouts(spark, SF).select("fight_id", "ts", "red_id", "blue_id", "winner_id", "method").collect(), key=lambda r: (r.ts, r.fight_id))
    elo = defaultdict(lambda: 1500.0)
    for b in bouts:
        m = (b.method or "").lower()
        k = 40 if "ko" in m or "sub" in m else 28 if "dec" in m else 32
        s = 0.5 if b.winner_id is None else float(b.winner_id == b.red_id)
        d = k * (s - 1 / (1 + 10 ** ((elo[b.blue_id] - elo[b.red_id]) / 400)))
        elo[b.red_id] += d
        elo[b.blue_id] -= d
    got = {r.fighter_id: r.elo for r in ratings.elo_final(spark, SF).collect()}
    assert got == pytest.approx(dict(elo), abs=1e-4)


def test_method_elo_moves_one_class(spark):
    rows = ratings.method_elo(spark, SF).collect()
    assert rows and all(r.ko_elo > 0 for r in rows)


def test_ranking_leaves_out_what_is_no_result(spark):
    rows = [(1, 7, "KO/TKO"), (2, None, "Submission"), (3, 7, "DQ"), (4, 7, "Overturned - No Contest"), (5, 7, None), (6, 7, "Draw")]
    df = spark.createDataFrame(rows, "fight_id long, winner_id long, method string")
    assert sorted(r.fight_id for r in ratings.ranked(df).collect()) == [1, 5]


def test_features_of_hand_made_sides(spark):
    """A bout with no attempts at all, one of a single side, and one with counts: rates, shares, flags."""
    from duelframe.operators import features

    s = adapter.sides(spark, SF).limit(1)
    base = {c: 0 for c in (*adapter.COUNTS, *(f"opp_{c}" for c in adapter.COUNTS))}
    make = lambda fight, corner, **more: {**base, "fight_id": fight, "corner": corner, "fighter_id": 1 if corner == "red" else 2, "opponent_id": 3, "ts": None, "date": None, "weight_class": "x", "method": None, "finish_round": 1, "fight_seconds": 600, "won": 1, "lost": 0, "is_ko": 0, "is_sub": 0, "is_dec": 0, **more}
    rows = [make(1, "red"), make(1, "blue"), make(2, "red", sig_attempted=4), make(3, "red", sig_landed=3, sig_attempted=4, kd=1, is_ko=1), make(3, "blue", td_attempted=1, won=0, lost=1)]
    df = spark.createDataFrame([[r.get(c) for c in s.columns] for r in rows], s.schema)
    kept = features.paired(features.contested(df))
    assert {(r.fight_id, r.corner) for r in kept.collect()} == {(3, "red"), (3, "blue")}
    red = features.bout_features(kept).where("corner = 'red'").first()
    assert (red.sig_landed_per5, red.sig_acc, red.td_acc, red.ko_win, red.finished, red.sig_def) == (1.5, 0.75, 0.0, 1, 1, 1.0)
    assert red.striking_composite == pytest.approx(0.30 * 0.5 / 10 + 0.25 * 0.75 + 0.25 * 1.5 / 30 + 0.20)


def test_no_leakage(spark):
    s = adapter.sides(spark, SF)
    last = s.agg(F.max("ts")).first()[0]
    changed = s.withColumn("sig_landed", F.when(F.col("ts") == F.lit(last), 10_000).otherwise(F.col("sig_landed")))
    a = {(r.fight_id, r.fighter_id): r.avg_sig_landed for r in form.rolling(s).collect()}
    b = {(r.fight_id, r.fighter_id): r.avg_sig_landed for r in form.rolling(changed).collect()}
    assert a == b


def test_mirror_twice_is_identity(spark):
    m = matchup.matchups(spark, SF)
    image = matchup.mirrored(m).where("augmented = 1").drop("augmented")
    back = matchup.mirrored(image).where("augmented = 1").drop("augmented").select(*m.columns)
    assert m.exceptAll(back).count() == 0


def test_skill_bounds(spark):
    p = skills.Parameters()
    rows = skills.skill_ratings(spark, SF).agg(F.min("mean_sigma"), F.max("mean_sigma"), F.count("*")).first()
    assert rows[2] > 0 and p.sigma_least <= rows[0] and rows[1] <= p.sigma_start + 1e-9


def test_skills_fade_when_idle(spark):
    mu, sigma = skills.idle(F.col("s"), F.col("m"), F.col("d"))
    rows = spark.createDataFrame([(100.0, 10.0, 89), (100.0, 10.0, 90), (100.0, 10.0, 91)], "s double, m double, d int").select(mu.alias("m"), sigma.alias("s")).collect()
    assert [r.m for r in rows[:2]] == [10.0, 10.0] and rows[2].m < 10.0 and rows[2].s > 100.0


def test_skills_equal_a_plain_account_of_one_bout(spark):
    """The first bout of all, skill by skill, from what its rounds hold."""
    import math

    p = skills.Parameters()
    x = skills.fold_rows(spark, SF).orderBy("ts", "fight_id").first()
    after = {r.fighter_id: r for r in ratings.folded(skills.fold_rows(spark, SF).where(F.col("fight_id") == x.fight_id), skills.fold_skills(final=True), "fighter_id long, last date, mu array<double>, sigma array<double>").collect()}
    at = skills.SKILLS.index("str_vol")
    sigma = p.sigma_start
    for one in x.rounds:  # volume alone: each side against the other, K from all uncertainties of the moment
        total = one.red.sig_landed + one.blue.sig_landed
        if total:
            sigma = max(1 / math.sqrt(1 / sigma**2 + 1 / p.tau**2), p.sigma_least)
    assert math.isclose(after[x.red_id].sigma[at], sigma, rel_tol=1e-9)
    points = p.sigma_start
    for _ in x.rounds:  # points are counted in every round
        points = max(1 / math.sqrt(1 / points**2 + 1 / p.tau**2), p.sigma_least)
    assert all(math.isclose(after[who].sigma[0], points, rel_tol=1e-9) for who in (x.red_id, x.blue_id))


def test_skills_seed_and_fading(spark):
    rows = skills.skills_now(spark, SF).collect()
    assert rows and all(60 - 1e-9 <= r.pts_sigma <= skills.Parameters().sigma_start + 1e-9 for r in rows)
    seeds = spark.createDataFrame([(15, 0), (5, 5), (0, 0)], "w int, l int").select(skills.newcomer_seed(F.col("w"), F.col("l"))).collect()
    assert [round(r[0], 6) for r in seeds] == [22.5, 0.0, 0.0]


def test_ranks_are_dense(spark):
    rows = QUERIES["points_ranking"](spark, SF).groupBy("division").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect()
    assert all(r.r == list(range(1, len(r.r) + 1)) for r in rows)


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    s = windows.read_stream(spark, str(tmp_path / "in"), glob="*.parquet", late="0 seconds")
    q = windows.tumbling(s).writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    assert q.awaitTermination(120)
    got = spark.table("tumbled").agg(F.sum("n")).first()[0]
    assert got == e.count()


def test_upsert_keeps_values_over_nulls(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, n string, v int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", 3)], "id int, n string, v int")
    assert sorted(map(tuple, windows.upsert(old, new, "id").collect())) == [(1, "a", 1), (2, "b", 5), (3, "c", 3)]


@pytest.mark.parametrize("bad", ["DROP TABLE x", "CREATE TABLE t AS SELECT 1", "INSERT INTO t SELECT 1", "SET a = 1"])
def test_guard_refuses_commands(spark, bad):
    with pytest.raises(ValueError):
        sql.query(spark, bad)


def test_guard_allows_words(spark):
    assert sql.query(spark, "SELECT 'update' AS x").first()[0] == "update"


@pytest.mark.parametrize("bad", [f"SELECT * FROM parquet.`{SF}/nation.parquet`", f"SELECT 1 WHERE 1 IN (SELECT n_nationkey FROM parquet.`{SF}/nation.parquet`)"])
def test_guard_refuses_files(spark, bad):
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        sql.query(spark, bad)


def test_days(spark):
    assert dt.date(2024, 1, 1) <= adapter.bouts(spark, SF).agg(F.min("date")).first()[0]


def test_sliding_sessions_and_duplicates_as_streams(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.unionByName(e.limit(100)).repartition(2).write.parquet(str(tmp_path / "in"))
    batch = e.withColumn("ts", F.col("ts").cast("timestamp"))
    read = lambda: windows.read_stream(spark, str(tmp_path / "in"), glob="*.parquet", late="40 days")

    def run(df, name, mode):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        assert q.awaitTermination(200)
        return spark.table(name)

    distinct = run(windows.distinct_events(read()), "distinct_events", "append")
    assert distinct.count() == e.count()
    slid = run(windows.sliding(read()), "slid", "complete")
    assert slid.agg(F.sum("n")).first()[0] == 2 * (e.count() + 100)
    assert windows.sessions(batch).count() > 0


def test_late_results_fill_and_runs_are_resumed(spark, tmp_path):
    from duelframe.streaming import state

    schema = "fight_id long, winner_id long, seen int"
    at, into = str(tmp_path / "in"), str(tmp_path / "bouts")
    for rows in ([(1, None, 1), (2, None, 1)], [(1, 7, 2), (1, 8, 3), (2, None, 2)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)
        state.available_now(spark.readStream.schema(schema).parquet(at), state.late_fill(into, "fight_id", F.col("seen")), str(tmp_path / "c"))
    assert sorted(map(tuple, spark.read.parquet(into).collect())) == [(1, 8, 3), (2, None, 2)]


def test_streamed_ratings_go_on_from_state(spark, tmp_path):
    from duelframe.streaming import state

    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        b = adapter.bouts(spark, SF)
        m = F.lower(F.coalesce("method", F.lit("")))
        k = F.when(m.contains("ko") | m.contains("sub"), 40.0).when(m.contains("dec"), 28.0).otherwise(32.0)
        score = F.when(F.col("winner_id").isNull(), 0.5).otherwise((F.col("winner_id") == F.col("red_id")).cast("double"))
        rows = b.select(F.lit("all").alias("pool"), "fight_id", "ts", "red_id", "blue_id", score.alias("score"), k.alias("k"))
        cut = b.selectExpr("percentile_approx(unix_micros(cast(ts as timestamp)), 0.5)").first()[0]
        early = F.unix_micros(F.col("ts").cast("timestamp")) <= cut
        at, got = str(tmp_path / "in"), []
        for part in (early, ~early):
            rows.where(part).coalesce(1).write.mode("append").parquet(at)
            state.available_now(state.rated(spark.readStream.schema(rows.schema).parquet(at)), lambda df, i: got.extend(df.collect()), str(tmp_path / "c"))
        want = {(r.fight_id, r.fighter_id): r.elo_after for r in ratings.elo_history(spark, SF).collect()}
        assert {(r.fight_id, r.fighter_id): round(r.elo_after, 6) for r in got} == pytest.approx(want, abs=1e-5)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
