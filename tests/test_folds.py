"""Folds read their rows batch by batch, in order of time; skills fold bouts that share no entity together."""

import datetime
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from duelframe.operators import endpoints, ratings, skills

from .conftest import SF


def _sizes(batches):
    """The rows of the largest batch, all rows, and whether they came in order."""
    most, n, last, right = 0, 0, -1, True
    for b in batches:
        most, n = max(most, b.num_rows), n + b.num_rows
        ids = b.column("fight_id").to_pylist()
        right, last = right and all(x < y for x, y in zip([last, *ids], ids)), ids[-1]
    yield [[most], [n], [right]]


@pytest.mark.parametrize("pool", [None, "league"])
def test_a_fold_holds_no_whole_pool(spark, pool):
    n = 60_000
    df = spark.range(n, numPartitions=7).select((n - F.col("id")).alias("fight_id"), (F.lit(n) - F.col("id")).cast("timestamp").alias("ts"), F.lit(1).alias("league"))
    got = ratings.folded(df, _sizes, "most long, n long, right boolean", pool).collect()
    assert len(got) == 1 and got[0].most <= 10_000 and got[0].n == n and got[0].right


def test_pools_are_folded_apart(spark):
    df = spark.range(5_000).select(F.col("id").alias("fight_id"), F.col("id").cast("timestamp").alias("ts"), (F.col("id") % 7).alias("league"))
    got = ratings.folded(df, _sizes, "most long, n long, right boolean", "league").collect()
    assert sorted(r.n for r in got) == [714] * 5 + [715] * 2 and all(r.right for r in got)


def test_waves_keep_the_order_of_time():
    rng = random.Random(5)
    pairs = np.array([rng.sample(range(9), 2) for _ in range(400)])
    wave = skills.waves(pairs[:, 0], pairs[:, 1])
    for i, (r, b) in enumerate(pairs):
        before = [wave[j] for j in range(i) if {r, b} & set(pairs[j])]
        assert wave[i] == max(before, default=-1) + 1


def test_skills_by_waves_equal_bouts_one_by_one(spark, monkeypatch):
    """The fold with a batch for each bout, so that every wave has one, and with many bouts a wave."""
    t = skills.fold_rows(spark, SF, seeded=True).orderBy("ts", "fight_id").drop("ts").toArrow()
    found = []
    for size in (skills.BATCH, 1):
        monkeypatch.setattr(skills, "BATCH", size)
        found.append([np.column_stack(c) for c in skills.fold_skills()(iter(t.to_batches(max_chunksize=size)))])
    assert len(found[0]) == 1 and len(found[1]) == t.num_rows
    assert np.allclose(found[0][0], np.vstack(found[1]), rtol=1e-12, atol=1e-9)


def test_a_round_equals_plain_arithmetic():
    """Volume, knockdowns and points of one round that ends a bout, written out."""
    p = skills.Parameters()
    one = dict.fromkeys(skills.COUNTS, 0)
    red, blue = one | {"sig_landed": 30, "sig_attempted": 60, "kd": 1}, one | {"sig_landed": 10, "sig_attempted": 40}
    day = datetime.date(2024, 1, 5)
    row = {"fight_id": 1, "date": day, "red_id": 7, "blue_id": 9, "winner_id": 7, "method": "KO/TKO", "finish_round": 1, "is_title": False, "is_long": False, "red_age": 0.9, "blue_age": 1.0, "red_seed": 12.0, "blue_seed": 0.0, "kd_rate": 0.2, "sub_rate": 0.1, "td_rate": 0.3, "td15s_cap": 10.0, "ctrl15g_cap": 10.0, "gnp15g_cap": 10.0, "newest": day, "rounds": [{"round_number": 1, "red": red, "blue": blue}]}
    t = pa.table({k: [v] for k, v in row.items()})
    ids, _, mu, sigma = next(skills.fold_skills(final=True)(iter(t.to_batches())))
    mu, sigma = dict(zip(ids, mu)), dict(zip(ids, sigma))
    after = 1 / math.sqrt(1 / p.sigma_start**2 + 1 / p.tau**2)
    e = 1 / (1 + 10 ** (-12 / 400))
    volume = 12 + 0.9 * p.k * (0.75 - e)
    lost = max(-p.k * (0.75 - e), 0.0)
    assert math.isclose(mu[7][skills.AT["str_vol"]], volume + lost * p.transfer * (1 + p.streak_gain) * 0.9, rel_tol=1e-12)
    ko = 12 + 0.9 * 2 * p.k * (1 / 3 - 0.2 * e)
    ko += 0.9 * p.finish_bonus * p.k * (1.5 - 1 / (1 + 10 ** ((0 - 12 * 15) / 400)))
    assert math.isclose(mu[7][skills.AT["ko"]], ko, rel_tol=1e-12)
    assert math.isclose(sigma[7][skills.AT["str_vol"]], after) and math.isclose(sigma[9][skills.AT["td"]], after)
    assert math.isclose(sigma[7][skills.AT["dist"]], p.sigma_start)  # nothing landed: no outcome


def test_a_bank_beyond_all_numbers_is_as_sql_has_it():
    """At favourable prices the bank overflows; after the next loss it is not a number, which SQL orders above all."""
    import duckdb

    rows = [(i, 0.9, 3.0, 1.5, i != 7990) for i in range(8000)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["fight_id", "p", "dr", "db", "w"])
    bank, peak, drawdown, n = (next(iter(c)) for c in next(endpoints.fold_bank(iter([batch]))))
    tail = endpoints.BANKROLL_SQL[endpoints.BANKROLL_SQL.index("f AS (SELECT 0::BIGINT") :]
    want = duckdb.sql(f"WITH RECURSIVE k AS MATERIALIZED (SELECT i + 1 AS n, 0.9::DOUBLE AS p, 3.0::DOUBLE AS dr, 1.5::DOUBLE AS db, i <> 7990 AS w FROM range(8000) t(i)), {tail}").fetchall()[0]
    assert math.isnan(bank) and all(math.isnan(v) for v in (peak, drawdown, *want[:3])) and n == want[3] == 8000
