"""The boosted winner and method models, and what is read off them.

The winner model is fitted on decided bouts of the training part and their mirror images; a bout and its image are held
out together. The method model has one softmax over its three classes. Models are tables of nodes, and every row is scored by a model
that was read back, as an application would.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelframe.functions import text
from duelframe.operators import boosting, endpoints, evaluation, features, learned, market, vennabers
from duelframe.session import new_path, staged, workers_can_import
from duelframe.sources import adapter, sinks

#: Share of the training rows that decide when to stop.
HELD_OUT = 0.15
ROUNDS, RATE, PATIENCE = 24, 0.12, 6
TOP = 20


def held_out(key: str = "fight_id"):
    return F.pmod(F.xxhash64(key, F.lit("held out")), F.lit(1000)) < int(1000 * HELD_OUT)


def winner_forest(m: DataFrame, rounds: int = ROUNDS, inputs: tuple[str, ...] = learned.INPUTS) -> boosting.Forest:
    """The model of label (red won) from the training part of prepared matchups, written and read back."""
    train = m.where("part = 0 AND label IS NOT NULL")
    both = train.unionByName(learned.image(train)).withColumn("y", F.col("label").cast("int"))
    forest = boosting.fit(both, inputs, "y", 2, boosting.Settings(rounds=rounds, rate=RATE, patience=PATIENCE, **boosting.WINNER), held_out=held_out())
    return _kept(forest, m.sparkSession, "winner-model")


def _kept(forest: boosting.Forest, spark: SparkSession, name: str) -> boosting.Forest:
    path = new_path(spark, name)
    boosting.saved(forest, spark, path)
    return boosting.loaded(spark, path)


def top_contributions(forest: boosting.Forest, rows: DataFrame, top: int = TOP) -> DataFrame:
    """The features with the largest contributions to each bout's log odds; ties by name."""
    found = boosting.contributions(forest, rows)
    rank = F.row_number().over(Window.partitionBy("fight_id").orderBy(F.desc(F.abs("contribution")), "feature"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top)


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features that moved each test bout's log odds most: exact Shapley values of the trees."""
    m = learned.prepared(spark, sf_dir)
    return top_contributions(winner_forest(m), m.where("part = 2"))


def method_forest(x: DataFrame, rounds: int = ROUNDS) -> boosting.Forest:
    """The joint model of the three methods; classes weigh by the square root of their rarity."""
    classes = F.array_position(F.array(*[F.lit(c) for c in learned.CLASSES]), F.col("method_class")).cast("int") - 1
    train = x.where("part = 0").withColumn("y", classes)
    by = train.groupBy("y").agg(F.count(F.lit(1)).alias("_own"))
    n = by.agg(F.sum("_own").alias("_n"))  # one row
    weighed = train.join(F.broadcast(by.crossJoin(n).select("y", F.sqrt(F.col("_n") / (len(learned.CLASSES) * F.col("_own"))).alias("_w"))), "y")
    settings = boosting.Settings(rounds=rounds, rate=RATE, patience=PATIENCE, **boosting.METHOD)
    forest = boosting.fit(weighed, learned.METHOD_INPUTS, "y", len(learned.CLASSES), settings, F.col("_w"), held_out())
    return _kept(forest, x.sparkSession, "method-model")


def method_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bouts after the training part with the joint model's three probabilities."""
    x = learned.method_rows(spark, sf_dir)
    names = tuple(f"p_{c}" for c in learned.CLASSES)
    y = boosting.scored(method_forest(x), x.where("part > 0"), ("fight_id", "part", "method_class"), names)
    return y.withColumn("predicted", text.argmax(learned.CLASSES, *[F.col(n) for n in names]))


# -- importance and validation

REPEATS, BLOCK = 10, 20_000


def _permuted(forest: boosting.Forest, names: tuple[str, ...]):
    def run(key, t):
        """Right answers of one block and repeat: as it stands, and with one input's values dealt to other rows at a time."""
        rng = np.random.default_rng([learned.SEED, int(key[0]), int(key[1])])
        t = t.sort_values("fight_id", kind="stable")
        x, y = t[list(names)].to_numpy(float), t["label"].to_numpy(float)
        right = lambda z: int(((forest.margins(z)[:, 0] >= 0) == (y == 1)).sum())
        used = {f for _, tree in forest.trees for f in tree.feature if f >= 0}
        base, out = right(x), []
        for i, name in enumerate(names):
            order = rng.permutation(len(x))  # drawn for all, so one input's draws don't depend on which others are used
            if i in used:
                z = x.copy()
                z[:, i] = x[order, i]
            out.append((name, int(key[1]), len(x), base, right(z) if i in used else base))
        return pd.DataFrame(out, columns=["feature", "repeat", "n", "base", "permuted"])

    return run


def importance(forest: boosting.Forest, rows: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """feature, accuracy, importance, deviation: accuracy lost on rows(fight_id, label) when an input's values are dealt to other rows, as mean and
    population deviation over repeats. Values are dealt within blocks of about BLOCK rows, which go to tasks by block and repeat."""
    workers_can_import(rows.sparkSession)
    names = forest.inputs
    x = rows.where("label IS NOT NULL").select("fight_id", "label", *[F.col(c).cast("double").alias(c) for c in names])
    blocks = max(1, math.ceil(x.count() / BLOCK))
    x = x.withColumn("block", F.pmod(F.xxhash64("fight_id", F.lit("block")), F.lit(blocks))).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    by = x.groupBy("block", "repeat").applyInPandas(_permuted(forest, names), "feature string, repeat int, n long, base long, permuted long")
    each = by.groupBy("feature", "repeat").agg((F.sum("base") / F.sum("n")).alias("base"), ((F.sum("base") - F.sum("permuted")) / F.sum("n")).alias("lost"))
    return each.groupBy("feature").agg(F.max("base").alias("accuracy"), F.avg("lost").alias("importance"), F.stddev_pop("lost").alias("deviation"))


def input_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All inputs of the winner model by the accuracy that later bouts lose."""
    m = learned.prepared(spark, sf_dir)
    return importance(winner_forest(m), m.where("part > 0"))


def folds_by(m: DataFrame, unit: str, folds: int) -> DataFrame:
    """m with fold: its unit of time (year, month, week ...) counted from the first that is scored, the last `folds` units; rows before them
    have fold 0."""
    at = F.date_trunc(unit, F.col("ts").cast("timestamp"))
    units = m.select(at.alias("_unit")).distinct()  # a row for each unit
    back = F.row_number().over(Window.orderBy(F.desc("_unit")))
    units = units.withColumn("_back", back).select("_unit", F.greatest(F.lit(0), F.lit(folds + 1) - F.col("_back")).alias("fold"))
    return m.withColumn("_unit", at).join(F.broadcast(units), "_unit").drop("_unit")


def cv_by_time(spark: SparkSession, sf_dir: str, unit: str = "week", folds: int = 3, rounds: int = 6) -> DataFrame:
    """Folds that grow in time: each of the last `folds` units is scored by a model of all bouts before it. With mean and population deviation over
    folds on each row. The driver's tables hold some weeks; over years, unit is year."""
    m = staged(folds_by(learned.winner_matchups(spark, sf_dir).where("label IS NOT NULL"), unit, folds), "folds")
    out = None
    for i in range(1, folds + 1):
        x = staged(features.imputed(m.where(F.col("fold") <= i), list(learned.INPUTS), F.col("fold") < i), "fold")
        train = x.where(F.col("fold") < i).drop("fold")
        both = train.unionByName(learned.image(train)).withColumn("y", F.col("label").cast("int"))
        forest = boosting.fit(both, learned.INPUTS, "y", 2, boosting.Settings(rounds=rounds, rate=RATE, **boosting.WINNER))
        scored = boosting.scored(forest, x.where(F.col("fold") == i), ("label",), ("p0", "p"))
        one = learned.scores_of(scored, ("p",)).select(F.lit(i).alias("fold"), F.lit(train.count()).alias("trained"), "n", "accuracy", "auc", "log_loss", "brier")
        out = one if out is None else out.unionByName(one)
    w = Window.partitionBy()  # a row for each fold
    return staged(out, "cv").select("*", F.avg("accuracy").over(w).alias("mean_accuracy"), F.stddev_pop("accuracy").over(w).alias("deviation"))


# -- the predictions table


def all_matchups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matchups of past bouts with their parts, and of upcoming ones as part 3; gaps filled by means of the training part."""
    x = staged(learned.winner_matchups(spark, sf_dir, upcoming=True), "matchups")
    parts = learned.with_parts(x.where("NOT upcoming")).unionByName(x.where("upcoming").withColumn("part", F.lit(3)))
    return staged(features.imputed(parts, list(learned.INPUTS), F.col("part") == 0), "matchups")


def write_predictions(spark: SparkSession, sf_dir: str, path: str, contributions_path: str, rounds: int = ROUNDS) -> None:
    """Scores all past and upcoming bouts with both models and replaces the two tables: predictions, and the top contributions.

    red_prob is the winner model's, and va_low and va_high are its Venn-Abers bounds from the calibration part; the method model gets
    red_prob as an input, as the winner's. Numbers are rounded half to even."""
    m = all_matchups(spark, sf_dir)
    forest = winner_forest(m, rounds)
    p = boosting.scored(forest, m, ("fight_id", "part", "label", "upcoming"), ("p_blue", "p"))
    p = staged(p, "winner-scores")
    p = vennabers.intervals(p.where("part = 1 AND label IS NOT NULL"), p)
    four = lambda c: F.bround(c, 4)
    winner = p.select("fight_id", "upcoming", F.when(F.col("p") >= 0.5, "red").otherwise("blue").alias("predicted_winner"), four(F.abs(F.col("p") - 0.5)).alias("confidence"), four(F.col("p")).alias("red_prob"), four(F.col("va_low")).alias("va_low"), four(F.col("va_high")).alias("va_high"))
    winner = staged(winner.withColumn("predicted_method", F.lit(None).cast("string")), "winner-predictions")
    with adapter.reading_predictions(spark, winner_path(winner)):
        rows = learned.method_rows(spark, sf_dir, decided=False)
    known = rows.join(winner.where("NOT upcoming").select("fight_id"), "fight_id")
    methods = boosting.scored(method_forest(known.where("method_class IS NOT NULL"), rounds), rows, ("fight_id",), tuple(f"p_{c}" for c in learned.CLASSES))
    methods = methods.withColumn("predicted_method", text.argmax(learned.CLASSES, *[F.col(f"p_{c}") for c in learned.CLASSES]))
    out = winner.drop("predicted_method").join(methods.select("fight_id", "predicted_method", *[four(F.col(f"p_{c}")).alias(f"p_{c}") for c in learned.CLASSES]), "fight_id", "left")
    sinks.replace_table(out, path)
    top = top_contributions(forest, m)
    sinks.replace_table(top.select("fight_id", "rank", "feature", F.bround("contribution", 6).alias("contribution"), F.bround("value", 4).alias("value")), contributions_path)


def winner_path(df: DataFrame) -> str:
    """The folder of a staged table."""
    return df.inputFiles()[0].rsplit("/", 1)[0]


_made: dict[tuple[str, str], str] = {}


def predictions_path(spark: SparkSession, sf_dir: str) -> str:
    """The tables of an application's run over sf_dir, made once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _made:
        path = new_path(spark, "model-predictions")
        write_predictions(spark, sf_dir, path, f"{path}-contributions")
        _made[key] = path
    return _made[key]


def model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predictions table."""
    return spark.read.parquet(predictions_path(spark, sf_dir))


def model_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contributions table: a bout's top features."""
    return spark.read.parquet(predictions_path(spark, sf_dir) + "-contributions")


def over_predictions(query):
    """The query over the predictions table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with adapter.reading_predictions(spark, predictions_path(spark, sf_dir)):
            return query(spark, sf_dir)

    return run


#: Queries of predictions, over the models' instead of made-up ones.
OVER_PREDICTIONS = {
    f.__name__: f
    for f in (market.picks_edge, market.winner_metrics_conf, market.winner_metrics_edge, market.value_bets_grid, evaluation.method_metrics, evaluation.confusion, evaluation.reliability, evaluation.scores, endpoints.interval_bets, endpoints.upcoming_bouts, endpoints.overall_metrics, endpoints.bankroll)
}

QUERIES = {f.__name__: f for f in (contributions, method_joint, input_importance, cv_by_time, model_predictions, model_contributions)} | {f"model_{n}": over_predictions(f) for n, f in OVER_PREDICTIONS.items()}
ORACLES: dict[str, str] = {}
