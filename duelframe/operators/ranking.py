"""Rankings: points over the last bouts, opponents' strength, division ranks and pound for pound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelframe.functions.text import division
from duelframe.operators import ratings
from duelframe.session import staged
from duelframe.sources import adapter
from duelframe.sources.adapter import oracle

#: Fixed values.
WIN = {"early_finish": 5.0, "late_finish": 4.0, "ud": 3.0, "majority": 2.5, "split": 2.0, "decision": 2.5}
LOSS = {"early_finish": 1.5, "late_finish": 1.2, "ud": 0.8, "majority": 0.6, "split": 0.4, "decision": 0.7}
RECENCY = (1.0, 0.9, 0.8, 0.7, 0.55, 0.4)
LAST, LEAST, IDLE_DAYS, TOP = 6, 3, 548, 25


def percentiles(values: DataFrame, points: DataFrame) -> DataFrame:
    """points(x) with pct: the share of values(v) that are <= x.

    A range join as a running count: the values and points are tagged, counted by distinct number,
    and summed in order, in buckets of numbers first, so no task orders all of them.
    """
    tagged = values.select(F.col("v").alias("x"), F.lit(1).alias("n")).unionByName(points.select("x", F.lit(0).alias("n"))).groupBy("x").agg(F.sum("n").alias("n"))
    tagged = tagged.withColumn("_bucket", F.floor("x"))
    buckets = tagged.groupBy("_bucket").agg(F.sum("n").alias("_in"))
    before = buckets.select("_bucket", (F.sum("_in").over(Window.orderBy("_bucket")) - F.col("_in")).alias("_before"))
    total = values.agg(F.count(F.lit(1)).alias("_total"))
    inside = F.sum("n").over(Window.partitionBy("_bucket").orderBy("x"))
    ranked = tagged.withColumn("_inside", inside).join(before, "_bucket").crossJoin(F.broadcast(total))  # one row
    return ranked.select("x", F.try_divide((F.col("_before") + F.col("_inside")).cast("double"), "_total").alias("pct"))


def opponent_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' balances among those of suppliers: the share of suppliers at or below."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_acctbal").alias("x"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_acctbal").alias("v"))
    return c.join(percentiles(s, c), "x").select("c_custkey", F.col("x").alias("balance"), "pct")


PERCENTILE_SQL = "SELECT c_custkey, c_acctbal AS balance, (SELECT count(*) FROM supplier WHERE s_acctbal <= c_acctbal) / (SELECT count(*) FROM supplier)::DOUBLE AS pct FROM customer"


def _by_category(values: dict[str, float], c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)


#: Worth of an opponent (least, span, exponent); own percentile's points; days off and fading a day.
WORTH, OWN_POINTS, REST_DAYS, FADE = (0.3, 1.7, 1.3), 35.0, 180, 0.0005


def quality(pct: Column) -> Column:
    least, span, exponent = WORTH
    return least + span * F.pow(pct, F.lit(exponent))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fighter_id, division, points, elo, sos of eligible entities (as of the last bout's date)."""
    h = staged(ratings.points_history(spark, sf_dir), "points-history")
    as_of = F.broadcast(h.agg(F.max("date").alias("as_of")))
    order = F.struct("ts", "fight_id")
    now = h.groupBy("fighter_id").agg(F.count(F.lit(1)).alias("bouts"), F.max("date").alias("last"), F.max_by("division", order).alias("division"), F.max_by("elo_after", order).alias("elo")).crossJoin(as_of)
    now = now.where((F.col("bouts") >= LEAST) & (F.datediff("as_of", "last") <= IDLE_DAYS))
    place = F.row_number().over(Window.partitionBy("fighter_id").orderBy(F.desc("ts"), F.asc("fight_id")))
    recent = h.withColumn("i", place).where(F.col("i") <= LAST).join(now.select("fighter_id"), "fighter_id", "left_semi")
    pct = percentiles(now.select(F.col("elo").alias("v")), recent.select(F.col("opponent_elo_before").alias("x")).unionByName(now.select(F.col("elo").alias("x"))))
    recent = recent.join(pct, recent["opponent_elo_before"] == pct["x"]).withColumn("q", quality(F.col("pct")))
    weight = F.element_at(F.array(*[F.lit(x) for x in RECENCY]), F.col("i"))
    context = F.when(F.lower("weight_class").contains("title"), 1.3).otherwise(1.0)
    win = _by_category(WIN, F.col("category")) * F.col("q")
    loss = -1.5 * _by_category(LOSS, F.col("category")) * F.greatest(2.0 - F.col("q"), F.lit(0.3))
    sums = recent.groupBy("fighter_id").agg(F.sum(F.when(F.col("won"), win).otherwise(loss) * weight * context).alias("raw"), F.avg("pct").alias("sos_pct"))
    own = pct.select(F.col("x").alias("elo"), F.col("pct").alias("own_pct"))
    idle = F.datediff("as_of", "last") - REST_DAYS
    fade = F.when(idle > 0, F.exp(-FADE * idle)).otherwise(1.0)
    out = now.join(sums, "fighter_id").join(own, "elo")
    return out.select("fighter_id", "division", ((F.col("raw") + OWN_POINTS * F.col("own_pct")) * fade).alias("points"), "elo", F.greatest(F.lit(1), F.least(F.lit(99), F.bround(F.col("sos_pct") * 99).cast("int"))).alias("sos"))


def _scaled(x: Column, by: Window) -> Column:
    lo, hi = F.min(x).over(by), F.max(x).over(by)
    return F.round((x - lo) / F.when(hi > lo, hi - lo).otherwise(1.0) * 1000, 6)


def points_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks within divisions of two or more, with scores from 0 to 1000."""
    s = scored(spark, sf_dir)
    by = Window.partitionBy("division")
    s = s.withColumn("n", F.count(F.lit(1)).over(by)).where("n >= 2")
    rank = F.row_number().over(by.orderBy(F.desc("points"), "fighter_id"))
    return s.select("fighter_id", "division", rank.alias("rank"), _scaled(F.col("points"), by).alias("score"), F.round("points", 6).alias("points"), F.round("elo", 6).alias("elo"), "sos")


def p4p_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top 25 by z-score within division (deviation of 0.1 at least), for men and women."""
    s = scored(spark, sf_dir)
    by = Window.partitionBy("division")
    z = F.when(F.count(F.lit(1)).over(by) >= 2, (F.col("points") - F.avg("points").over(by)) / F.greatest(F.stddev_pop("points").over(by), F.lit(0.1))).otherwise(0.0)
    s = s.withColumns({"z": z, "pool": F.when(F.col("division").startswith("w_"), "women").otherwise("men")})
    pool = Window.partitionBy("pool")
    s = s.withColumn("rank", F.row_number().over(pool.orderBy(F.desc("z"), "fighter_id"))).where(F.col("rank") <= TOP)
    return s.select("pool", "rank", "fighter_id", "division", F.round("z", 6).alias("z"), _scaled(F.col("z"), pool).alias("score"))


def profile_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills scaled to 0..99 within division, 50 where all are equal; profile_json() packs them."""
    s = adapter.sides(spark, sf_dir).groupBy("fighter_id", "weight_class").agg(*[F.avg(c).alias(c) for c in PROFILE], F.count(F.lit(1)).alias("n")).where("n >= 3")
    by = Window.partitionBy("weight_class")
    scale = lambda c: F.when(F.max(c).over(by) > F.min(c).over(by), F.round((F.col(c) - F.min(c).over(by)) / (F.max(c).over(by) - F.min(c).over(by)) * 99, 6)).otherwise(50.0)
    return s.select("fighter_id", "weight_class", *[scale(c).alias(c) for c in PROFILE])


PROFILE = ("sig_landed", "td_landed", "kd", "ctrl_seconds")
PROFILE_SQL = oracle(
    "SELECT fighter_id, weight_class, " + ", ".join(f"CASE WHEN max({c}) OVER w > min({c}) OVER w THEN round(({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) * 99, 6) ELSE 50.0 END AS {c}" for c in PROFILE) + " FROM a WINDOW w AS (PARTITION BY weight_class)",
    f"a AS (SELECT fighter_id, weight_class, {', '.join(f'avg({c}) AS {c}' for c in PROFILE)}, count(*) AS n FROM sides GROUP BY ALL HAVING count(*) >= 3)",
)

def profile_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's profile in a division as JSON, merged with what the ranking knows of it (joined by
    entity and division; the ranking's keys win), and read back with an empty map for what is no JSON."""
    p = profile_scale(spark, sf_dir).withColumn("division", division(F.col("weight_class")))
    r = points_ranking(spark, sf_dir).select("fighter_id", "division", "points", F.col("sos").cast("double").alias("sos"))
    packed = p.select("fighter_id", "division", F.when(F.col("fighter_id") % 10 == 0, "not JSON").otherwise(F.to_json(F.struct(*PROFILE))).alias("profile"))
    parsed = F.coalesce(F.from_json("profile", "map<string,double>"), F.create_map().cast("map<string,double>"))
    x = packed.join(r, ["fighter_id", "division"], "left").withColumn("own", parsed)
    more = F.when(F.col("points").isNotNull(), F.create_map(F.lit("points"), F.col("points"), F.lit("sos"), F.col("sos"))).otherwise(F.create_map().cast("map<string,double>"))
    merged = F.map_concat(F.map_filter("own", lambda k, v: ~k.isin("points", "sos")), more)
    return x.select("fighter_id", "division", F.size(merged).alias("n"), merged["kd"].alias("kd"), merged["points"].alias("points"), merged["sos"].alias("sos"))


_DIVISION_SQL = "CASE weight_class WHEN 'Flyweight Bout' THEN 'flyweight' WHEN 'Bantamweight Bout' THEN 'bantamweight' WHEN 'Featherweight Bout' THEN 'featherweight' WHEN 'Lightweight Title Bout' THEN 'lightweight' WHEN 'Welterweight Bout' THEN 'welterweight' WHEN 'Middleweight Bout' THEN 'middleweight' WHEN 'Light Heavyweight Bout' THEN 'light_heavyweight' ELSE 'w_strawweight' END"
_CATEGORY_SQL = "CASE WHEN contains(method, 'KO') OR contains(method, 'Sub') THEN CASE WHEN finish_round <= 2 THEN 'early_finish' ELSE 'late_finish' END WHEN contains(method, 'Split') THEN 'split' WHEN contains(method, 'Majority') THEN 'majority' WHEN contains(method, 'Unanimous') THEN 'ud' ELSE 'decision' END"


def _values_sql(values: dict[str, float], column: str) -> str:
    return f"CASE {column} {' '.join(f'WHEN {k!r} THEN {v}::DOUBLE' for k, v in values.items())} END"


def _scored_tables() -> tuple[str, ...]:
    """Tables up to sc: fighter_id, division, points, elo, sos."""
    return (
        *ratings.POINTS_TABLES,
        f"hh AS (SELECT ph.*, b.ts, b.date, b.weight_class, {_DIVISION_SQL} AS division, {_CATEGORY_SQL} AS category, b.winner_id = ph.fighter_id AS won FROM ph JOIN pr b ON b.fight_id = ph.fight_id)",
        "nw0 AS (SELECT fighter_id, count(*) AS bouts, max(date) AS last, arg_max(division, (ts, fight_id)) AS division, arg_max(elo_after, (ts, fight_id)) AS elo FROM hh GROUP BY fighter_id)",
        f"nw AS (SELECT *, (SELECT max(date) FROM hh) AS as_of FROM nw0 WHERE bouts >= {LEAST} AND (SELECT max(date) FROM hh) - last <= {IDLE_DAYS})",
        f"rc0 AS (SELECT *, row_number() OVER (PARTITION BY fighter_id ORDER BY ts DESC, fight_id) AS i FROM hh QUALIFY i <= {LAST})",
        "rc1 AS (SELECT rc0.*, (SELECT count(*) FROM nw WHERE nw.elo <= rc0.opponent_elo_before)::DOUBLE / (SELECT count(*) FROM nw) AS pct FROM rc0 JOIN (SELECT fighter_id FROM nw) USING (fighter_id))",
        f"rc2 AS (SELECT *, {WORTH[0]}::DOUBLE + {WORTH[1]}::DOUBLE * pow(pct, {WORTH[2]}::DOUBLE) AS q, [{', '.join(f'{x}::DOUBLE' for x in RECENCY)}][i] * CASE WHEN contains(lower(weight_class), 'title') THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END AS w FROM rc1)",
        f"rs AS (SELECT fighter_id, sum(w * CASE WHEN won THEN {_values_sql(WIN, 'category')} * q ELSE -1.5::DOUBLE * {_values_sql(LOSS, 'category')} * greatest(2.0::DOUBLE - q, 0.3::DOUBLE) END) AS raw, avg(pct) AS sos_pct FROM rc2 GROUP BY fighter_id)",
        f"sc AS (SELECT fighter_id, division, (raw + {OWN_POINTS}::DOUBLE * (SELECT count(*) FROM nw y WHERE y.elo <= nw.elo)::DOUBLE / (SELECT count(*) FROM nw)) * CASE WHEN as_of - last > {REST_DAYS} THEN exp(-{FADE}::DOUBLE * (as_of - last - {REST_DAYS})) ELSE 1.0::DOUBLE END AS points, elo, CAST(greatest(1, least(99, round_even(sos_pct * 99, 0))) AS INTEGER) AS sos FROM nw JOIN rs USING (fighter_id))",
    )


def _recursive(select: str, *tables: str) -> str:
    return oracle(select, *tables).replace("WITH ev", "WITH RECURSIVE ev", 1)


_SCALE = "round(({0} - min({0}) OVER w) / CASE WHEN max({0}) OVER w > min({0}) OVER w THEN max({0}) OVER w - min({0}) OVER w ELSE 1.0::DOUBLE END * 1000, 6)"
RANKING_SQL = _recursive(f"SELECT fighter_id, division, CAST(row_number() OVER (PARTITION BY division ORDER BY points DESC, fighter_id) AS INTEGER) AS rank, {_SCALE.format('points')} AS score, round(points, 6) AS points, round(elo, 6) AS elo, sos FROM (SELECT *, count(*) OVER (PARTITION BY division) AS of FROM sc) WHERE of >= 2 WINDOW w AS (PARTITION BY division)", *_scored_tables())
P4P_SQL = _recursive(
    f"SELECT pool, rank, fighter_id, division, round(z, 6) AS z, {_SCALE.format('z')} AS score FROM z1 WINDOW w AS (PARTITION BY pool)",
    *_scored_tables(),
    "z0 AS (SELECT *, CASE WHEN count(*) OVER w >= 2 THEN (points - avg(points) OVER w) / greatest(stddev_pop(points) OVER w, 0.1::DOUBLE) ELSE 0.0::DOUBLE END AS z, CASE WHEN starts_with(division, 'w_') THEN 'women' ELSE 'men' END AS pool FROM sc WINDOW w AS (PARTITION BY division))",
    f"z1 AS (SELECT *, CAST(row_number() OVER (PARTITION BY pool ORDER BY z DESC, fighter_id) AS INTEGER) AS rank FROM z0 QUALIFY rank <= {TOP})",
)
PROFILE_JSON_SQL = _recursive(
    "SELECT a.fighter_id, a.division, CAST(CASE WHEN a.fighter_id % 10 = 0 THEN 0 ELSE 4 END + CASE WHEN r.points IS NULL THEN 0 ELSE 2 END AS INTEGER) AS n, CASE WHEN a.fighter_id % 10 <> 0 THEN a.kd END AS kd, r.points, r.sos FROM pj a LEFT JOIN rk r ON r.fighter_id = a.fighter_id AND r.division = a.division",
    *_scored_tables(),
    "pa AS (SELECT fighter_id, weight_class, avg(kd) AS k, count(*) AS n FROM sides GROUP BY ALL HAVING count(*) >= 3)",
    f"pj AS (SELECT fighter_id, {_DIVISION_SQL} AS division, CASE WHEN max(k) OVER w > min(k) OVER w THEN round((k - min(k) OVER w) / (max(k) OVER w - min(k) OVER w) * 99, 6) ELSE 50.0::DOUBLE END AS kd FROM pa WINDOW w AS (PARTITION BY weight_class))",
    "rk AS (SELECT fighter_id, division, round(points, 6) AS points, CAST(sos AS DOUBLE) AS sos FROM (SELECT *, count(*) OVER (PARTITION BY division) AS of FROM sc) WHERE of >= 2)",
)

#: The order in which divisions are shown.
DIVISION_ORDER = ("flyweight", "bantamweight", "featherweight", "lightweight", "welterweight", "middleweight", "light_heavyweight", "heavyweight", "w_strawweight", "w_flyweight", "w_bantamweight")


def ranking_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking with names, in the order of divisions and ranks."""
    names = adapter.fighters(spark, sf_dir).select("fighter_id", F.concat_ws(" ", "first_name", "last_name").alias("name"))
    order = F.element_at(F.create_map(*[F.lit(x) for i, d in enumerate(DIVISION_ORDER) for x in (d, i)]), F.col("division"))
    x = points_ranking(spark, sf_dir).join(names, "fighter_id").withColumn("place", order)
    return x.orderBy("place", "rank").select("place", "division", "rank", "fighter_id", "name")


RANKING_TABLE_SQL = _recursive(f"SELECT CAST(list_position([{', '.join(repr(d) for d in DIVISION_ORDER)}], division) - 1 AS INTEGER) AS place, division, CAST(row_number() OVER (PARTITION BY division ORDER BY points DESC, fighter_id) AS INTEGER) AS rank, fighter_id, first_name || ' ' || last_name AS name FROM (SELECT *, count(*) OVER (PARTITION BY division) AS of FROM sc) JOIN fighters USING (fighter_id) WHERE of >= 2", *_scored_tables())

QUERIES = {"opponent_percentile": opponent_percentile, "points_ranking": points_ranking, "p4p_ranking": p4p_ranking, "profile_scale": profile_scale, "profile_json": profile_json, "ranking_table": ranking_table}
ORACLES = {"opponent_percentile": PERCENTILE_SQL, "profile_scale": PROFILE_SQL, "points_ranking": RANKING_SQL, "p4p_ranking": P4P_SQL, "profile_json": PROFILE_JSON_SQL, "ranking_table": RANKING_TABLE_SQL}
