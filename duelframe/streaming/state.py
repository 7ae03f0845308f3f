"""Jobs that run over what is new: high-water marks, late results, day-keyed caches, and ratings kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from duelframe.operators.ratings import START, expected
from duelframe.session import workers_can_import
from duelframe.sources import adapter, sinks
from duelframe.sources.adapter import oracle


def newer_than(df: DataFrame, at: str, done: DataFrame, done_at: str) -> DataFrame:
    """Rows after the newest of those done; all, if none is."""
    mark = F.broadcast(done.agg(F.max(done_at).alias("_mark")))  # one row
    return df.crossJoin(mark).where(F.col("_mark").isNull() | (F.col(at) > F.col("_mark"))).drop("_mark")


def available_now(stream: DataFrame, each, checkpoint: str) -> None:
    """Run a stream over all that has landed since the last run, in micro-batches each(rows, batch_id), and end;
    an outside scheduler calls it again."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def late_fill(path: str, key: str, *order: Column):
    """A micro-batch's rows over the table's by natural key: of rows of one key the last counts, and nulls don't
    replace values, so a bout lands without its winner and gains it later. A batch that runs twice changes nothing."""

    def each(rows: DataFrame, batch_id: int) -> None:
        sinks.upsert_table(sinks.latest_wins(rows, key, *order), path, key)

    return each


def missing_days(asked: DataFrame, cached: DataFrame, day: str) -> DataFrame:
    """Days that a cache of days has no rows of; each once."""
    return asked.select(day).dropDuplicates([day]).join(cached.select(day).distinct(), day, "left_anti")


class Ratings(StatefulProcessor):
    """Elo ratings of a pool as state: each micro-batch's bouts go on from where the last ended, in order of time."""

    def init(self, handle) -> None:
        self.ratings = handle.getMapState("ratings", "id long", "rating double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        t = pd.concat(list(rows)).sort_values(["ts", "fight_id"], kind="stable")
        now: dict[int, float] = {}

        def rating(who: int) -> float:
            if who not in now:
                now[who] = self.ratings.getValue((who,))[0] if self.ratings.containsKey((who,)) else START
            return now[who]

        out = []
        for fight, red, blue, score, k in zip(t["fight_id"], t["red_id"], t["blue_id"], t["score"], t["k"]):
            a, b = rating(int(red)), rating(int(blue))
            d = k * (score - expected(a, b))
            now[int(red)], now[int(blue)] = a + d, b - d
            out += [(fight, red, a, a + d), (fight, blue, b, b - d)]
        for who, value in now.items():
            self.ratings.updateValue((who,), (value,))
        yield pd.DataFrame(out, columns=["fight_id", "fighter_id", "elo_before", "elo_after"])

    def close(self) -> None:
        pass


def rated(stream: DataFrame, pool: str = "pool") -> DataFrame:
    """A stream of bouts (pool, fight_id, ts, red_id, blue_id, score, k) with ratings before and after. Bouts of one
    pool must land in order of time, batch by batch. Needs the RocksDB state store."""
    workers_can_import(stream.sparkSession)
    return stream.groupBy(pool).transformWithStateInPandas(statefulProcessor=Ratings(), outputStructType="fight_id long, fighter_id long, elo_before double, elo_after double", outputMode="Append", timeMode="None")


def new_bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bouts after the newest of the even ones of the first days: what a recent run would still have to read."""
    b = adapter.bouts(spark, sf_dir).select("fight_id", "ts", "date")
    return newer_than(b, "ts", b.where("fight_id % 2 = 0 AND date < DATE'2024-01-15'"), "ts").select("fight_id", "date")


def uncached_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with bouts that a cache of every third day's quotes lacks."""
    days = adapter.cards(spark, sf_dir).select("date", "card_id")
    return missing_days(days, days.where("card_id % 3 = 0"), "date")


QUERIES = {"new_bouts": new_bouts, "uncached_days": uncached_days}
ORACLES = {
    "new_bouts": oracle("SELECT fight_id, date FROM pr WHERE ts > coalesce((SELECT max(ts) FROM pr WHERE fight_id % 2 = 0 AND date < DATE '2024-01-15'), TIMESTAMP '1900-01-01')"),
    "uncached_days": oracle("SELECT date FROM cards WHERE card_id % 3 <> 0"),
}
