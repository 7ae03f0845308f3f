"""Form as a stream against the batch's frames."""

import datetime as dt
import math
import os

import pytest
from pyspark.sql import functions as F

from duelframe.operators import form
from duelframe.sources import adapter
from duelframe.streaming import form_state

from .conftest import SF


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


def streamed(spark, tmp_path, parts, delay):
    """Rows of a run over parts, a micro-batch each, and how many came too late."""
    schema = parts[0].schema
    at = tmp_path / "in"
    for i, p in enumerate(parts):
        p.coalesce(1).write.mode("append").parquet(str(at / f"part={i}"))
    # One file a batch, in this order.
    files = sorted(at.glob("part=*/*.parquet"))
    for i, f in enumerate(files):
        f.rename(at / f"{i}.parquet")
        os.utime(at / f"{i}.parquet", (1_700_000_000 + 100 * i,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(at / "*.parquet"))
    got = []
    q = form_state.formed(stream, delay).writeStream.foreachBatch(lambda df, i: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    return got, form_state.late_rows(q)


def test_shuffled_batches_give_the_frames_of_the_batch(rocks, tmp_path):
    spark = rocks
    s = adapter.sides(spark, SF).where("fighter_id % 5 < 2").select(*form_state.INPUT).withColumn("ts", F.col("ts").cast("timestamp")).cache()
    end = s.agg(F.max("ts")).first()[0] + dt.timedelta(days=400)
    flush = spark.createDataFrame([(-1, -1, end, 0, 0, 0, 0, 0)], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in s.schema))
    part = F.pmod(F.xxhash64("fight_id", "fighter_id"), F.lit(3))
    got, late = streamed(spark, tmp_path, [s.where(part == i) for i in range(3)] + [flush], "366 days")
    assert late == 0
    want = {(r.fight_id, r.fighter_id): r for r in form.rolling(adapter.sides(spark, SF).where("fighter_id % 5 < 2")).collect()}
    streak = {(r.fight_id, r.fighter_id): r for r in form.streaks(spark, SF).where("fighter_id % 5 < 2").collect()}
    assert {(r.fight_id, r.fighter_id) for r in got} == set(want) and len(got) == len(want) > 50
    for r in got:
        a, b = want[r.fight_id, r.fighter_id], streak[r.fight_id, r.fighter_id]
        for p in ("avg", "recent", "last3"):
            for c in form.ROLLED:
                x, y = r[f"{p}_{c}"], a[f"{p}_{c}"]
                assert x is None and y is None or x == pytest.approx(y)
        assert (r.career_won, r.streak) == (a.career_won, b.streak)
        days = None if r.days_since_last is None or math.isnan(r.days_since_last) else r.days_since_last
        assert days == b.days_since_last


def test_rows_after_the_watermark_are_counted(rocks, tmp_path):
    spark = rocks
    day = lambda n: dt.datetime(2024, 1, 1, 12) + dt.timedelta(days=n)
    schema = "fight_id long, fighter_id long, ts timestamp, won int, sig_landed long, td_landed long, kd long, ctrl_seconds long"
    rows = lambda *x: spark.createDataFrame([(f, 1, day(d), 1, 10 * f, 0, 0, None) for f, d in x], schema)
    got, late = streamed(spark, tmp_path, [rows((2, 10), (1, 5)), rows((3, 40)), rows((5, 39)), rows((4, 7)), rows((6, 200))], "5 days")
    assert late == 1  # bout 4
    by = {r.fight_id: r for r in got}
    assert sorted(by) == [1, 2, 3, 5]
    assert [(by[f].bouts, by[f].streak, by[f].avg_sig_landed) for f in (1, 2, 5, 3)] == [(0, 0, None), (1, 1, 10.0), (2, 2, 15.0), (3, 3, pytest.approx(80 / 3))]
    assert by[2].days_since_last == 5 and by[3].avg_ctrl_seconds is None
