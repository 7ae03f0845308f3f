"""Markets: prices, margins, edges, profit by split, value bets and the bankroll."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.functions.odds import decimal, implied, kelly, vig_free
from duelframe.sources import adapter
from duelframe.sources.adapter import oracle

STAKE = 100.0


def vig_free_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = adapter.quotes(spark, sf_dir)
    r, b = F.col("red_implied"), F.col("blue_implied")
    return q.select("id", "fight_id", "bookmaker", "red_odds", "blue_odds", "red_implied", "blue_implied", vig_free(r, b).alias("red_fair"), vig_free(b, r).alias("blue_fair"), decimal("red_odds").alias("red_decimal"))


VIG_SQL = oracle("SELECT id, fight_id, bookmaker, red_odds, blue_odds, red_implied, blue_implied, red_implied / (red_implied + blue_implied) AS red_fair, blue_implied / (red_implied + blue_implied) AS blue_fair, CASE WHEN red_odds > 0 THEN red_odds / 100.0::DOUBLE + 1 ELSE 100.0::DOUBLE / abs(red_odds) + 1 END AS red_decimal FROM quotes")


def best_prices(quotes: DataFrame) -> DataFrame:
    """By bout: best price of each side with its bookmaker (the first on ties), the first bookmaker's
    prices, mean implied probabilities, and the arbitrage margin."""
    best = lambda side: F.max_by(F.struct(F.col("bookmaker").alias("b"), F.col(f"{side}_odds").alias("o")), F.struct(F.col(f"{side}_odds"), -F.col("id"))).alias(side)
    first = lambda c: F.min_by(c, "id").alias(f"first_{c}")
    x = quotes.groupBy("fight_id").agg(best("red"), best("blue"), first("red_odds"), first("blue_odds"), F.avg("red_implied").alias("red_mean"), F.avg("blue_implied").alias("blue_mean"))
    margin = (1.0 - implied(F.col("red.o")) - implied(F.col("blue.o"))) * 100.0
    return x.select("fight_id", F.col("red.b").alias("red_book"), F.col("red.o").alias("red_best"), F.col("blue.b").alias("blue_book"), F.col("blue.o").alias("blue_best"), "first_red_odds", "first_blue_odds", "red_mean", "blue_mean", margin.alias("arb_margin"), (margin > 0).alias("is_arb"))


def best_price_arb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_prices(adapter.quotes(spark, sf_dir))


_IMP = "CASE WHEN {0} > 0 THEN 100.0::DOUBLE / ({0} + 100) ELSE abs({0})::DOUBLE / (abs({0}) + 100) END"
_DEC = "CASE WHEN {0} > 0 THEN {0} / 100.0::DOUBLE + 1 ELSE 100.0::DOUBLE / abs({0}) + 1 END"
_BEST = (
    "b0 AS (SELECT fight_id, arg_max(bookmaker, red_odds * 1000000 - id) AS red_book, max(red_odds) AS red_best, arg_max(bookmaker, blue_odds * 1000000 - id) AS blue_book, max(blue_odds) AS blue_best, arg_min(red_odds, id) AS first_red_odds, arg_min(blue_odds, id) AS first_blue_odds, avg(red_implied) AS red_mean, avg(blue_implied) AS blue_mean FROM quotes GROUP BY fight_id)",
    f"best AS (SELECT *, (1.0::DOUBLE - {_IMP.format('red_best')} - {_IMP.format('blue_best')}) * 100 AS arb_margin, (1.0::DOUBLE - {_IMP.format('red_best')} - {_IMP.format('blue_best')}) > 0 AS is_arb FROM b0)",
)
BEST_SQL = oracle("SELECT * FROM best", *_BEST)


def edges(preds: DataFrame, best: DataFrame) -> DataFrame:
    """Predictions with prices: the model's side, the side of the larger edge, and profit at a flat stake."""
    x = preds.join(best, "fight_id")
    red_edge, blue_edge = F.col("red_prob") - F.col("red_mean"), (1.0 - F.col("red_prob")) - F.col("blue_mean")
    red = red_edge > blue_edge
    x = x.withColumns({"model_side": F.when(F.col("red_prob") >= 0.5, "red").otherwise("blue"), "confidence": F.greatest(F.col("red_prob"), 1.0 - F.col("red_prob")), "edge_side": F.when(red, "red").otherwise("blue"), "edge": F.when(red, red_edge).otherwise(blue_edge) * 100.0})
    won = lambda side: (F.col("red_won") == 1) == (F.col(side) == "red")
    gain = lambda side, r, b: F.when(won(side), (F.when(F.col(side) == "red", decimal(r)).otherwise(decimal(b)) - 1.0) * STAKE).otherwise(-STAKE)
    return x.withColumns({"model_right": won("model_side").cast("int"), "model_pl": gain("model_side", "first_red_odds", "first_blue_odds"), "edge_right": won("edge_side").cast("int"), "edge_pl": gain("edge_side", "red_best", "blue_best")})


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(adapter.predictions(spark, sf_dir), best_prices(adapter.quotes(spark, sf_dir)))


def picks_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pick table, by edge from above; no edge and an edge of exactly 0 come last."""
    x = _edges(spark, sf_dir)
    key = F.when(F.col("edge").isNull() | (F.col("edge") == 0), -999.0).otherwise(F.col("edge"))
    return x.orderBy(key.desc(), "fight_id").select("fight_id", "red_prob", "model_side", "edge_side", "edge", "red_book", "red_best", "blue_book", "blue_best", "arb_margin", "is_arb")


_EDGE = (
    *_BEST,
    "x0 AS (SELECT p.*, b.* EXCLUDE (fight_id), red_prob - red_mean AS re, (1.0::DOUBLE - red_prob) - blue_mean AS be FROM preds p JOIN best b USING (fight_id))",
    f"x1 AS (SELECT *, CASE WHEN red_prob >= 0.5 THEN 'red' ELSE 'blue' END AS model_side, greatest(red_prob, 1.0::DOUBLE - red_prob) AS confidence, CASE WHEN re > be THEN 'red' ELSE 'blue' END AS edge_side, CASE WHEN re > be THEN re ELSE be END * 100.0 AS edge FROM x0)",
    f"x2 AS (SELECT *, CAST((red_won = 1) = (model_side = 'red') AS INTEGER) AS model_right, CAST((red_won = 1) = (edge_side = 'red') AS INTEGER) AS edge_right, CASE WHEN (red_won = 1) = (model_side = 'red') THEN (CASE WHEN model_side = 'red' THEN {_DEC.format('first_red_odds')} ELSE {_DEC.format('first_blue_odds')} END - 1) * 100 ELSE -100.0 END AS model_pl, CASE WHEN (red_won = 1) = (edge_side = 'red') THEN (CASE WHEN edge_side = 'red' THEN {_DEC.format('red_best')} ELSE {_DEC.format('blue_best')} END - 1) * 100 ELSE -100.0 END AS edge_pl FROM x1)",
)
PICKS_SQL = oracle("SELECT fight_id, red_prob, model_side, edge_side, edge, red_book, red_best, blue_book, blue_best, arb_margin, is_arb FROM x1", *_EDGE)

#: Half-open splits.
CONFIDENCE = ((0.00, 0.05), (0.05, 0.10), (0.10, 0.15), (0.15, 0.20), (0.20, 0.30), (0.30, 0.50))
EDGES = ((-1000, 0), (0, 5), (5, 10), (10, 15), (15, 20), (20, 100))


def _split(x: DataFrame, value: Column, bounds, right: str, pl: str) -> DataFrame:
    bucket = None
    for i, (lo, hi) in enumerate(bounds):
        hit = (value >= lo) & (value < hi)
        bucket = F.when(hit, i) if bucket is None else bucket.when(hit, i)
    by = x.where("red_won IS NOT NULL").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(right).alias("n_right"), F.sum(pl).alias("profit")).where("bucket IS NOT NULL")
    return by.select("bucket", "n", "n_right", (F.col("n_right") / F.col("n")).alias("accuracy"), "profit", (F.col("profit") / (F.col("n") * STAKE) * 100.0).alias("roi"))


def winner_metrics_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(_edges(spark, sf_dir), F.abs(F.col("red_prob") - 0.5), CONFIDENCE, "model_right", "model_pl")


def winner_metrics_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(_edges(spark, sf_dir), F.col("edge"), EDGES, "edge_right", "edge_pl")


def _split_sql(value: str, bounds, right: str, pl: str) -> str:
    case = " ".join(f"WHEN {value} >= {lo} AND {value} < {hi} THEN {i}" for i, (lo, hi) in enumerate(bounds))
    return oracle(f"SELECT bucket, count(*) AS n, CAST(sum({right}) AS BIGINT) AS n_right, sum({right}) / count(*)::DOUBLE AS accuracy, sum({pl}) AS profit, sum({pl}) / (count(*) * 100.0::DOUBLE) * 100 AS roi FROM (SELECT *, CASE {case} END AS bucket FROM x2 WHERE red_won IS NOT NULL) WHERE bucket IS NOT NULL GROUP BY bucket", *_EDGE)


GRID = (0.03, 0.05, 0.08, 0.10, 0.15)


def value_bets_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value bets by threshold: the edge over the fair probability above it and a positive expectation,
    red tried first. The grid of five rows is exploded beside each bout; then one aggregation."""
    x = adapter.predictions(spark, sf_dir).where("red_won IS NOT NULL").join(best_prices(adapter.quotes(spark, sf_dir)), "fight_id")
    fair = vig_free(F.col("red_mean"), F.col("blue_mean"))
    p, dr, db = F.col("red_prob"), decimal("red_best"), decimal("blue_best")
    x = x.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in GRID])))
    red = (p - fair > F.col("threshold")) & (p * dr > 1)
    blue = (fair - p > F.col("threshold")) & ((1.0 - p) * db > 1)
    won = F.col("red_won") == 1
    pl = F.when(red, F.when(won, (dr - 1.0) * STAKE).otherwise(-STAKE)).when(blue, F.when(~won, (db - 1.0) * STAKE).otherwise(-STAKE))
    return x.withColumn("pl", pl).groupBy("threshold").agg(F.count("pl").alias("bets"), F.count_if(F.col("pl") > 0).alias("hits"), F.coalesce(F.sum("pl"), F.lit(0.0)).alias("profit"))


VALUE_SQL = oracle(
    f"SELECT threshold, count(pl) AS bets, count(*) FILTER (pl > 0) AS hits, coalesce(sum(pl), 0.0) AS profit FROM (SELECT threshold, CASE WHEN red_prob - fair > threshold AND red_prob * dr > 1 THEN CASE WHEN red_won = 1 THEN (dr - 1) * 100 ELSE -100.0 END WHEN fair - red_prob > threshold AND (1.0::DOUBLE - red_prob) * db > 1 THEN CASE WHEN red_won = 0 THEN (db - 1) * 100 ELSE -100.0 END END AS pl FROM v, (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in GRID)}]) AS threshold)) GROUP BY threshold",
    *_BEST,
    f"v AS (SELECT red_prob, red_won, red_mean / (red_mean + blue_mean) AS fair, {_DEC.format('red_best')} AS dr, {_DEC.format('blue_best')} AS db FROM preds JOIN best USING (fight_id) WHERE red_won IS NOT NULL)",
)


def kelly_bankroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter-Kelly bankroll by division: bets in order of fight_id, at most 5 % of the bank, if over 1.

    The bank is a recurrence, so each division's bets are folded in order; divisions run apart."""
    x = _edges(spark, sf_dir).where("red_won IS NOT NULL AND red_prob >= 0.5")
    rows = x.groupBy("weight_class").agg(F.array_sort(F.collect_list(F.struct("fight_id", F.col("red_prob").alias("p"), decimal("red_best").alias("d"), (F.col("red_won") == 1).alias("w")))).alias("bets"))

    def step(acc: Column, x: Column) -> Column:
        stake = F.greatest(F.lit(0.0), F.least(kelly(x["p"], x["d"]) * 0.25 * acc["bank"], acc["bank"] * 0.05))
        bank = acc["bank"] + F.when(stake > 1, F.when(x["w"], stake * (x["d"] - 1.0)).otherwise(-stake)).otherwise(0.0)
        peak = F.greatest(acc["peak"], bank)
        return F.struct(bank.alias("bank"), peak.alias("peak"), F.greatest(acc["drawdown"], (peak - bank) / peak).alias("drawdown"), (acc["bets"] + (stake > 1).cast("int")).alias("bets"))

    start = F.struct(F.lit(10000.0).alias("bank"), F.lit(10000.0).alias("peak"), F.lit(0.0).alias("drawdown"), F.lit(0).alias("bets"))
    return rows.select("weight_class", F.aggregate("bets", start, step).alias("r")).select("weight_class", F.round("r.bank", 4).alias("bank"), F.round("r.drawdown", 6).alias("drawdown"), "r.bets")


KELLY_SQL = oracle(
    """SELECT weight_class, round(bank, 4) AS bank, round(drawdown, 6) AS drawdown, CAST(bets AS INTEGER) AS bets FROM f QUALIFY row_number() OVER (PARTITION BY weight_class ORDER BY n DESC) = 1""",
    *_EDGE,
    f"""k0 AS (SELECT weight_class, red_prob AS p, {_DEC.format('red_best')} AS d, red_won = 1 AS w, row_number() OVER (PARTITION BY weight_class ORDER BY fight_id) AS n FROM x2 WHERE red_won IS NOT NULL AND red_prob >= 0.5)""",
    """f0 AS (SELECT DISTINCT weight_class FROM k0)""",
).replace("WITH ev", "WITH RECURSIVE ev").replace(
    "f0 AS (SELECT DISTINCT weight_class FROM k0)",
    """f AS (SELECT DISTINCT weight_class, 0::BIGINT AS n, 10000.0::DOUBLE AS bank, 10000.0::DOUBLE AS peak, 0.0::DOUBLE AS drawdown, 0::BIGINT AS bets FROM k0
  UNION ALL SELECT weight_class, n, nb, greatest(peak, nb), greatest(drawdown, (greatest(peak, nb) - nb) / greatest(peak, nb)), bets + CAST(stake > 1 AS BIGINT) FROM (
    SELECT weight_class, n, peak, drawdown, bets, stake, bank + CASE WHEN stake > 1 THEN CASE WHEN w THEN stake * (d - 1) ELSE -stake END ELSE 0 END AS nb FROM (
      SELECT f.weight_class, k0.n, bank, peak, drawdown, bets, w, d, greatest(0.0::DOUBLE, least((p * (d - 1) - (1 - p)) / (d - 1) * 0.25 * bank, bank * 0.05)) AS stake FROM f JOIN k0 ON f.weight_class = k0.weight_class AND k0.n = f.n + 1)))""",
)

QUERIES = {"implied_vig_free": vig_free_quotes, "best_price_arb": best_price_arb, "picks_edge": picks_edge, "winner_metrics_conf": winner_metrics_conf, "winner_metrics_edge": winner_metrics_edge, "value_bets_grid": value_bets_grid, "kelly_bankroll": kelly_bankroll}
ORACLES = {
    "implied_vig_free": VIG_SQL,
    "best_price_arb": BEST_SQL,
    "picks_edge": PICKS_SQL,
    "winner_metrics_conf": _split_sql("abs(red_prob - 0.5)", CONFIDENCE, "model_right", "model_pl"),
    "winner_metrics_edge": _split_sql("edge", EDGES, "edge_right", "edge_pl"),
    "value_bets_grid": VALUE_SQL,
    "kelly_bankroll": KELLY_SQL,
}
