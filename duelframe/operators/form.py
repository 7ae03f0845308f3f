"""Form before each bout: frames that end one row back, so nothing of the bout itself leaks in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelframe.sources import adapter
from duelframe.sources.adapter import oracle

ROLLED = ("sig_landed", "td_landed", "kd", "ctrl_seconds")


def _in_order():
    return Window.partitionBy("fighter_id").orderBy("ts", "fight_id")


#: Frames by prefix: rows from, up to the row before.
FRAMES = {"avg": Window.unboundedPreceding, "recent": -5, "last3": -3}


def rolling(sides: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """All frames of one ordering in one select: one shuffle and one sort. keep: columns to carry along."""
    by = _in_order()
    cols = [F.avg(c).over(by.rowsBetween(start, -1)).alias(f"{p}_{c}") for p, start in FRAMES.items() for c in ROLLED]
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"career_{c}") for c in ("won", "lost")]
    finish = F.col("won") * F.greatest("is_ko", "is_sub")
    return sides.select("fight_id", "fighter_id", *keep, *cols, *sums, F.coalesce(F.sum(finish).over(before), F.lit(0)).alias("career_finishes"))


def pre_bout_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling(adapter.sides(spark, sf_dir))


_W = "(PARTITION BY fighter_id ORDER BY ts, fight_id ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"
_FRAME_SQL = {"avg": "UNBOUNDED", "recent": "5", "last3": "3"}
ROLLING_SQL = oracle(
    "SELECT fight_id, fighter_id, "
    + ", ".join(f"avg({c}) OVER {_W.format(n)} AS {p}_{c}" for p, n in _FRAME_SQL.items() for c in ROLLED)
    + "".join(f", CAST(coalesce(sum({c}) OVER {_W.format('UNBOUNDED')}, 0) AS BIGINT) AS career_{c}" for c in ("won", "lost"))
    + f", CAST(coalesce(sum(won * greatest(is_ko, is_sub)) OVER {_W.format('UNBOUNDED')}, 0) AS BIGINT) AS career_finishes FROM sides"
)


def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed streak before the bout (+n wins in a row, -n others), by gaps and islands, and days off."""
    s, by = adapter.sides(spark, sf_dir), _in_order()
    s = s.withColumn("_new", F.coalesce((F.lag("won").over(by) != F.col("won")).cast("int"), F.lit(1)))
    s = s.withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.row_number().over(Window.partitionBy("fighter_id", "_island").orderBy("ts", "fight_id"))
    s = s.withColumn("_signed", F.when(F.col("won") == 1, run).otherwise(-run))
    return s.select("fight_id", "fighter_id", F.coalesce(F.lag("_signed").over(by), F.lit(0)).alias("streak"), F.datediff("date", F.lag("date").over(by)).alias("days_since_last"))


STREAK_SQL = oracle(
    "SELECT fight_id, fighter_id, CAST(coalesce(lag(signed) OVER w, 0) AS INTEGER) AS streak, CAST(date - lag(date) OVER w AS INTEGER) AS days_since_last FROM c WINDOW w AS (PARTITION BY fighter_id ORDER BY ts, fight_id)",
    "a AS (SELECT *, CASE WHEN lag(won) OVER w IS NULL OR lag(won) OVER w <> won THEN 1 ELSE 0 END AS new FROM sides WINDOW w AS (PARTITION BY fighter_id ORDER BY ts, fight_id))",
    "b AS (SELECT *, sum(new) OVER (PARTITION BY fighter_id ORDER BY ts, fight_id) AS island FROM a)",
    "c AS (SELECT *, row_number() OVER (PARTITION BY fighter_id, island ORDER BY ts, fight_id) * (2 * won - 1) AS signed FROM b)",
)


def order_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames over another entity: customers and their orders."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    avg = lambda n: F.avg("o_totalprice").over(w.rowsBetween(n, -1))
    return o.select("o_orderkey", "o_custkey", avg(Window.unboundedPreceding).alias("avg_price"), avg(-5).alias("recent_price"), F.datediff(F.to_date("o_orderdate"), F.to_date(F.lag("o_orderdate").over(w))).alias("days_since_last"))


ORDER_FORM_SQL = """
SELECT o_orderkey, o_custkey, avg(o_totalprice) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS avg_price, avg(o_totalprice) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS recent_price,
CAST(CAST(o_orderdate AS DATE) - CAST(lag(o_orderdate) OVER w AS DATE) AS INTEGER) AS days_since_last FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
"""

ROUND_SHARES = 3


def round_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity by round: landed counts dealt over rounds 1 to 3, their shares and the trend. One
    conditional aggregation instead of a join for each round; a missing round counts as 0."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    by = li.groupBy("l_orderkey").agg(*[F.coalesce(F.sum(F.when(F.col("l_linenumber") == r, F.col("l_quantity"))), F.lit(0.0)).alias(f"r{r}") for r in (1, 2, 3)])
    total = F.col("r1") + F.col("r2") + F.col("r3")
    return by.select("l_orderkey", *[F.coalesce(F.try_divide(F.col(f"r{r}"), total), F.lit(0.0)).alias(f"share_r{r}") for r in (1, 2, 3)], (F.col("r3") - F.col("r1")).alias("trend"))


ROUND_PROFILE_SQL = "WITH b AS (SELECT l_orderkey, " + ", ".join(f"coalesce(sum(l_quantity) FILTER (l_linenumber = {r}), 0.0) AS r{r}" for r in (1, 2, 3)) + " FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, " + ", ".join(f"coalesce(r{r} / nullif(r1 + r2 + r3, 0), 0.0) AS share_r{r}" for r in (1, 2, 3)) + ", r3 - r1 AS trend FROM b"


def latest_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's last bout, by max_by: one aggregation, no sort."""
    s = adapter.sides(spark, sf_dir)
    return s.groupBy("fighter_id").agg(F.max_by(F.struct("fight_id", "date", "won"), F.struct("ts", "fight_id")).alias("x")).select("fighter_id", "x.fight_id", "x.date", "x.won")


LATEST_SQL = oracle("SELECT fighter_id, fight_id, date, won FROM (SELECT *, row_number() OVER (PARTITION BY fighter_id ORDER BY ts DESC, fight_id DESC) AS rn FROM sides) WHERE rn = 1")

QUERIES = {"pre_bout_rolling": pre_bout_rolling, "signed_streak": streaks, "order_form": order_form, "round_profile": round_profile, "latest_per_entity": latest_per_entity}
ORACLES = {"pre_bout_rolling": ROLLING_SQL, "signed_streak": STREAK_SQL, "order_form": ORDER_FORM_SQL, "round_profile": ROUND_PROFILE_SQL, "latest_per_entity": LATEST_SQL}
