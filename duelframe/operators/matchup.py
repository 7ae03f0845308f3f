"""Matchup rows: both sides' features by bout, their mirror images, and splits in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelframe.operators import form
from duelframe.operators.form import FRAMES, ROLLED
from duelframe.sources import adapter
from duelframe.sources.adapter import oracle

FEATURES = tuple(f"{p}_{c}" for p in FRAMES for c in ROLLED)


def matchups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """red_, blue_ and diff_ features, one row for each bout, by one conditional aggregation."""
    rolled = form.rolling(adapter.sides(spark, sf_dir), keep=("corner", "won", "ts"))
    side = lambda corner, c: F.max(F.when(F.col("corner") == corner, F.col(c))).alias(f"{corner}_{c}")
    by = rolled.groupBy("fight_id").agg(*[side(k, c) for k in ("red", "blue") for c in FEATURES], F.max(F.when(F.col("corner") == "red", F.col("won"))).alias("label"), F.max("ts").alias("ts"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return by.select("fight_id", "label", "ts", *[zero(f"{k}_{c}").alias(f"{k}_{c}") for k in ("red", "blue") for c in FEATURES], *[(zero(f"red_{c}") - zero(f"blue_{c}")).alias(f"diff_{c}") for c in FEATURES])


def mirrored(m: DataFrame) -> DataFrame:
    """m with each row's image: sides swapped, differences negated, the label flipped."""
    swap = [F.col(f"{o}_{c}").alias(f"{k}_{c}") for k, o in (("red", "blue"), ("blue", "red")) for c in FEATURES]
    image = m.select("fight_id", (1 - F.col("label")).alias("label"), "ts", *swap, *[(-F.col(f"diff_{c}")).alias(f"diff_{c}") for c in FEATURES])
    return m.withColumn("augmented", F.lit(0)).unionByName(image.withColumn("augmented", F.lit(1)))


SHOWN = ("red_avg_sig_landed", "blue_avg_sig_landed", "diff_avg_sig_landed", "diff_recent_td_landed", "diff_last3_kd")


def matchup_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirrored(matchups(spark, sf_dir)).select("fight_id", "augmented", "label", *SHOWN)


_W = {"avg": "UNBOUNDED", "recent": "5", "last3": "3"}
_R = "r AS (SELECT fight_id, corner, won, " + ", ".join(f"coalesce(avg({c}) OVER (PARTITION BY fighter_id ORDER BY ts, fight_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 0.0) AS {p}_{c}" for p, n in _W.items() for c in ROLLED) + " FROM sides)"
_MM = "mm AS (SELECT a.fight_id, a.won AS label, a.avg_sig_landed AS red_avg_sig_landed, b.avg_sig_landed AS blue_avg_sig_landed, a.avg_sig_landed - b.avg_sig_landed AS diff_avg_sig_landed, a.recent_td_landed - b.recent_td_landed AS diff_recent_td_landed, a.last3_kd - b.last3_kd AS diff_last3_kd FROM r a JOIN r b ON a.fight_id = b.fight_id AND a.corner = 'red' AND b.corner = 'blue')"
MIRROR_SQL = oracle("SELECT fight_id, 0 AS augmented, label, red_avg_sig_landed, blue_avg_sig_landed, diff_avg_sig_landed, diff_recent_td_landed, diff_last3_kd FROM mm UNION ALL SELECT fight_id, 1, 1 - label, blue_avg_sig_landed, red_avg_sig_landed, -diff_avg_sig_landed, -diff_recent_td_landed, -diff_last3_kd FROM mm", _R, _MM)

SPLIT = (0.6, 0.8)


def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bouts in order of time as train (60 %), calibration and test: the position of a day's first
    bout from counts by day, so only rows of one day are ordered together."""
    b = adapter.bouts(spark, sf_dir).select("fight_id", "ts", "date")
    days = b.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("date")  # one row for each day
    first = days.select("date", (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("date").orderBy("ts", "fight_id")) - 1
    x = b.join(first, "date").withColumn("place", place)
    part = F.when(F.col("place") < F.floor(F.col("total") * SPLIT[0]), "train").when(F.col("place") < F.floor(F.col("total") * SPLIT[1]), "calibration").otherwise("test")
    return x.select("fight_id", "place", part.alias("part"))


SPLIT_SQL = oracle("SELECT fight_id, place, CASE WHEN place < floor(total * 0.6::DOUBLE) THEN 'train' WHEN place < floor(total * 0.8::DOUBLE) THEN 'calibration' ELSE 'test' END AS part FROM (SELECT fight_id, row_number() OVER (ORDER BY ts, fight_id) - 1 AS place, count(*) OVER () AS total FROM pr)")


def style_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Win rates of style against style, both orientations counted; draws add to bouts only."""
    s = adapter.sides(spark, sf_dir)
    style = lambda p: F.when(F.col(f"{p}td_landed") * 10 > F.col(f"{p}sig_landed"), "grappler").when(F.col(f"{p}kd") >= 2, "puncher").otherwise("boxer")
    return s.groupBy(style("").alias("style"), style("opp_").alias("opponent_style")).agg(F.count(F.lit(1)).alias("bouts"), F.avg("won").alias("win_rate"))


_STYLE = "CASE WHEN {0}td_landed * 10 > {0}sig_landed THEN 'grappler' WHEN {0}kd >= 2 THEN 'puncher' ELSE 'boxer' END"
STYLE_SQL = oracle(f"SELECT {_STYLE.format('')} AS style, {_STYLE.format('opp_')} AS opponent_style, count(*) AS bouts, avg(won) AS win_rate FROM sides GROUP BY 1, 2")


def bout_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested document for each bout as JSON: sides with their counts, and quotes in order."""
    b = adapter.bouts(spark, sf_dir)
    q = adapter.quotes(spark, sf_dir).groupBy("fight_id").agg(F.array_sort(F.collect_list(F.struct("id", "bookmaker", "red_odds", "blue_odds"))).alias("quotes"))
    x = b.join(q, "fight_id", "left")
    doc = F.struct("fight_id", F.struct(F.col("red_id").alias("id"), F.col("red.kd").alias("kd")).alias("red"), F.struct(F.col("blue_id").alias("id"), F.col("blue.kd").alias("kd")).alias("blue"), "quotes")
    return x.select("fight_id", F.to_json(doc).alias("document"), F.coalesce(F.size("quotes"), F.lit(0)).alias("n_quotes"))


DOCUMENT_SQL = oracle(
    "SELECT p.fight_id, '{\"fight_id\":' || p.fight_id || ',\"red\":{\"id\":' || red_id || ',\"kd\":' || r.kd || '},\"blue\":{\"id\":' || blue_id || ',\"kd\":' || b.kd || '}' || coalesce(',\"quotes\":[' || q.l || ']', '') || '}' AS document, CAST(coalesce(q.n, 0) AS INTEGER) AS n_quotes FROM pr p JOIN sides r ON r.fight_id = p.fight_id AND r.corner = 'red' JOIN sides b ON b.fight_id = p.fight_id AND b.corner = 'blue' LEFT JOIN q ON q.fight_id = p.fight_id",
    "q AS (SELECT fight_id, count(*) AS n, string_agg('{\"id\":' || id || ',\"bookmaker\":\"' || bookmaker || '\",\"red_odds\":' || red_odds || ',\"blue_odds\":' || blue_odds || '}', ',' ORDER BY id) AS l FROM quotes GROUP BY fight_id)",
)

QUERIES = {"matchup_mirror": matchup_mirror, "temporal_split": temporal_split, "style_matrix": style_matrix, "bout_document": bout_document}
ORACLES = {"matchup_mirror": MIRROR_SQL, "temporal_split": SPLIT_SQL, "style_matrix": STYLE_SQL, "bout_document": DOCUMENT_SQL}
