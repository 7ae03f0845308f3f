"""Learned models: the winner and method models, their calibration, intervals, contributions and search.

Models are Spark ML's: gradient-boosted trees are binary, without an L2 term, so figures differ from other
libraries' by construction. Three classes are decomposed into binary models or given to one model a class.
Rows are one for each bout and side order; features of a bout are known before it.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelframe.functions import text
from duelframe.operators import dirichlet, endpoints, features, market, ratings, vennabers
from duelframe.session import scratch, staged, workers_can_import
from duelframe.sources import adapter

SEED = 42
#: The boosted trees (rounds are the parameter `rounds`).
TREES = {"maxDepth": 3, "stepSize": 0.037, "featureSubsetStrategy": "0.65", "minInstancesPerNode": 32, "maxBins": 128, "seed": SEED}
ROUNDS = 20
FORM = ("sig_landed_per5", "td_landed_per5", "sig_def", "td_def", "striking_composite", "grappling_composite", "won", "finished")
NUMBERS = tuple(f"{p}_{c}" for p in ("avg", "recent", "last3") for c in FORM) + ("career_fights", "career_win_pct", "finish_rate", "been_finished_rate", "elo", "age", "reach_inches")
SIDED = ("elo", "career_fights", "career_win_pct", "finish_rate")
ODDS = ("odds_red_prob", "odds_blue_prob", "odds_diff", "odds_fav_is_red")
INPUTS = (*(f"diff_{c}" for c in NUMBERS), *(f"{s}_{c}" for s in ("red", "blue") for c in SIDED), *ODDS)


def winner_matchups(spark: SparkSession, sf_dir: str, upcoming: bool = False) -> DataFrame:
    """fight_id, ts, label (red won; null: no winner), and INPUTS of each bout, from one aggregation by bout.

    With `upcoming`, bouts of the last day have no results yet: column upcoming tells them, their label is null, and both sides have
    their newest form, from all bouts before that day."""
    s = adapter.sides(spark, sf_dir)
    f = features.bout_features(features.paired(features.contested(s)))
    elo = ratings.elo_history(spark, sf_dir).select("fight_id", "fighter_id", F.col("elo_before").alias("elo"))
    last = F.broadcast(s.agg(F.max("date").alias("_last")))  # one row
    to_come = F.lit(False)
    if upcoming:
        to_come = F.to_date("ts") == F.col("_last")
        known = f.crossJoin(last).where(~to_come)
        f = known.unionByName(s.select(*features.KEYS).crossJoin(last).where(to_come), allowMissingColumns=True)
    f = features.rolled(f, FORM)
    f = f.select(*features.KEYS, *[c for c in NUMBERS if c.split("_")[0] in ("avg", "recent", "last3")], *[F.expr(features.CAREER[c]).alias(c) for c in ("career_fights", "career_win_pct", "finish_rate", "been_finished_rate")])
    body = features.physical(spark, sf_dir).select("fighter_id", "reach_inches", "dob")
    f = f.join(elo, ["fight_id", "fighter_id"], "left").join(body, "fighter_id", "left").withColumn("age", text.age(F.to_date("ts"), F.col("dob")))
    if upcoming:  # the rating before the day, which the day's first bout has
        day = Window.partitionBy("fighter_id", to_come).orderBy("ts", "fight_id")
        f = f.crossJoin(last).withColumn("elo", F.when(to_come, F.first("elo").over(day)).otherwise(F.col("elo"))).drop("_last")
    side = lambda k, c: F.max(F.when(F.col("corner") == k, F.col(c)))
    by = f.groupBy("fight_id").agg(*[side(k, c).alias(f"{k}_{c}") for k in ("red", "blue") for c in NUMBERS])
    b = adapter.bouts(spark, sf_dir).crossJoin(last)
    if upcoming:
        b = b.withColumn("winner_id", F.when(~to_come, F.col("winner_id")))
    b = b.select("fight_id", "ts", to_come.alias("upcoming"), F.when(F.col("winner_id").isNotNull(), (F.col("winner_id") == F.col("red_id")).cast("double")).alias("label"))
    p = market.best_prices(adapter.quotes(spark, sf_dir)).select("fight_id", F.col("red_mean").alias("odds_red_prob"), F.col("blue_mean").alias("odds_blue_prob"), "red_best", "blue_best")
    x = by.join(b, "fight_id").join(p, "fight_id", "left")
    own = ["upcoming"] if upcoming else []
    return x.select("fight_id", "ts", "label", *own, "red_best", "blue_best", *[(F.col(f"red_{c}") - F.col(f"blue_{c}")).alias(f"diff_{c}") for c in NUMBERS], *[F.col(f"{s}_{c}") for s in ("red", "blue") for c in SIDED], "odds_red_prob", "odds_blue_prob", (F.col("odds_red_prob") - F.col("odds_blue_prob")).alias("odds_diff"), (F.col("odds_red_prob") > 0.5).cast("double").alias("odds_fav_is_red"))


def image(m: DataFrame) -> DataFrame:
    """Each row from the other corner: differences change sign, sides and odds swap, the label flips."""
    swap = {f"red_{c}": f"blue_{c}" for c in SIDED} | {"odds_red_prob": "odds_blue_prob", "red_best": "blue_best"}
    swap |= {v: k for k, v in swap.items()}
    turned = {**{k: F.col(v) for k, v in swap.items()}, **{c: -F.col(c) for c in m.columns if c.startswith("diff_") or c == "odds_diff"}, "label": 1.0 - F.col("label"), "odds_fav_is_red": 1.0 - F.col("odds_fav_is_red")}
    return m.select(*[turned[c].alias(c) if c in turned else F.col(c) for c in m.columns])


def with_parts(m: DataFrame, shares: tuple[float, ...] = (0.8, 0.9)) -> DataFrame:
    """m with part 0, 1, ...: by the order of ts, cut at these shares of the rows (rows of equal ts stay together)."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = F.broadcast(m.agg(F.percentile_approx(at, F.array(*[F.lit(s) for s in shares]), F.lit(10_000)).alias("_cuts")))  # one row
    part = reduce(lambda a, b: a + b, [(at > F.get("_cuts", F.lit(i))).cast("int") for i in range(len(shares))])
    return m.crossJoin(cuts).withColumn("part", part).drop("_cuts")


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matchups with parts (train, calibration, test) and gaps filled by means of the training part."""
    with scratch(spark) as stage:
        m = stage(with_parts(winner_matchups(spark, sf_dir)), "matchups")
        return staged(features.imputed(m, list(INPUTS), F.col("part") == 0), "matchups")


def trees(label: str, inputs: tuple[str, ...] = INPUTS, rounds: int = ROUNDS) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(inputs), outputCol="x"), GBTClassifier(labelCol=label, featuresCol="x", maxIter=rounds, **TREES)])


def probability(model: PipelineModel, rows: DataFrame, name: str) -> DataFrame:
    return model.transform(rows).withColumn(name, vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")


def fit_winner(m: DataFrame, rounds: int = ROUNDS) -> PipelineModel:
    """On decided bouts of the training part, and their images."""
    train = m.where("part = 0 AND label IS NOT NULL")
    return trees("label", rounds=rounds).fit(train.unionByName(image(train)))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def out_of_fold(m: DataFrame, folds: int = 5, rounds: int = 5) -> DataFrame:
    """Scores of training rows from models that have not seen them: folds are runs of rows in order of time
    within each class, so not shuffled."""
    train = m.where("part = 0 AND label IS NOT NULL")
    place = F.percent_rank().over(Window.partitionBy("label").orderBy("ts", "fight_id"))
    train = staged(train.withColumn("fold", F.least(F.floor(place * folds), F.lit(folds - 1)).cast("int")), "folds")
    out = None
    for i in range(folds):
        rest = train.where(F.col("fold") != i)
        one = probability(trees("label", rounds=rounds).fit(rest), train.where(F.col("fold") == i), "p").select("fight_id", "p", "label")
        out = one if out is None else out.unionByName(one)
    return staged(out, "out-of-fold")


def calibrated(m: DataFrame, model: PipelineModel, oof: DataFrame) -> DataFrame:
    """Test rows with the raw score p and those of Platt, isotonic (also on out-of-fold scores) and Venn-Abers."""
    scored = staged(probability(model, m.where("part > 0"), "p").select("fight_id", "ts", "part", "label", "p", "odds_red_prob", "odds_blue_prob", "red_best", "blue_best"), "scored")
    one = VectorAssembler(inputCols=["p"], outputCol="v")
    fit_on = scored.where("part = 1 AND label IS NOT NULL")
    platt = Pipeline(stages=[one, LogisticRegression(featuresCol="v", labelCol="label", regParam=0.0)]).fit(fit_on)
    out = probability(platt, scored.where("part = 2"), "platt").drop("v")
    for name, on in (("isotonic", fit_on), ("isotonic_folds", oof)):
        model_ = IsotonicRegression(featuresCol="p", labelCol="label").fit(on.select("p", "label"))
        out = model_.transform(out).withColumn(name, F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("prediction")))).drop("prediction")
    return vennabers.intervals(oof, out)


METHODS = ("p", "platt", "isotonic", "isotonic_folds", "va_prob")


def scores_of(rows: DataFrame, names: tuple[str, ...] = METHODS) -> DataFrame:
    """By calibration: accuracy, AUC (rank sum; equal scores share their rank), log loss and Brier score."""
    long = rows.where("label IS NOT NULL").select("label", F.explode(F.array(*[F.struct(F.lit(n).alias("method"), F.col(n).alias("q")) for n in names])).alias("x")).select("label", "x.*")
    c = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("q")))
    by = long.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg(((F.col("q") >= 0.5).cast("double") == F.col("label")).cast("double")).alias("accuracy"), F.avg(-F.when(F.col("label") == 1, F.log(c)).otherwise(F.log(1 - c))).alias("log_loss"), F.avg(F.pow(F.col("q") - F.col("label"), 2)).alias("brier"))
    at = long.groupBy("method", "q").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    before = F.coalesce(F.sum("neg").over(Window.partitionBy("method").orderBy("q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    auc = at.withColumn("won", F.col("pos") * (before + F.col("neg") / 2)).groupBy("method").agg(F.try_divide(F.sum("won"), F.sum("pos") * F.sum("neg")).alias("auc"))
    best = F.row_number().over(Window.orderBy("brier", "method")) == 1  # a row for each method
    return by.join(auc, "method").withColumn("best", best)


def _winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = prepared(spark, sf_dir)
    return staged(calibrated(m, fit_winner(m), out_of_fold(m)), "calibrated")


def winner_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last tenth of the bouts with the model's, the calibrated and the interval's probabilities, the
    predicted side, and its confidence."""
    x = _winner(spark, sf_dir)
    return x.select("fight_id", F.col("p").alias("red_prob"), *METHODS[1:], "va_low", "va_high", F.when(F.col("p") >= 0.5, "red").otherwise("blue").alias("predicted"), F.abs(F.col("p") - 0.5).alias("confidence"))


def calibration_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores_of(_winner(spark, sf_dir))


def interval_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and quantiles of the intervals' widths."""
    w = F.col("va_high") - F.col("va_low")
    q = F.percentile(w, F.array(*[F.lit(x) for x in (0.5, 0.75, 0.9)]))
    return _winner(spark, sf_dir).agg(F.avg(w).alias("mean"), q[0].alias("median"), q[1].alias("p75"), q[2].alias("p90"), F.max(w).alias("max"))


# -- importance


def permutation_importance(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = ("diff_elo", "diff_avg_won", "odds_diff", "diff_age")) -> DataFrame:
    """Accuracy lost when one feature's values are dealt to other rows of the test part."""
    m = prepared(spark, sf_dir)
    model = fit_winner(m)
    test = m.where("part > 0 AND label IS NOT NULL")
    n = test.count()
    place = lambda seed: (F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64("fight_id", F.lit(seed)))), F.pmod(F.xxhash64("fight_id", F.lit("b")), F.lit(max(1, n // 20_000))))
    accuracy = lambda df, name: probability(model, df, "p").agg(F.lit(name).alias("feature"), F.avg(((F.col("p") >= 0.5).cast("double") == F.col("label")).cast("double")).alias("accuracy"))
    out = accuracy(test, "none")
    for name in names:
        order, block = place(name)
        own, block = place("own")[0], block
        rows = test.withColumn("_b", block).withColumn("_i", own)
        other = test.select("fight_id", name).withColumn("_b", block).withColumn("_i", order).select("_b", "_i", F.col(name).alias("_v"))
        out = out.unionByName(accuracy(rows.join(other, ["_b", "_i"]).drop("_b", "_i", name).withColumnRenamed("_v", name), name))
    base = F.max(F.when(F.col("feature") == "none", F.col("accuracy"))).over(Window.partitionBy())  # a row for each feature
    return out.select("feature", "accuracy", (base - F.col("accuracy")).alias("importance"))


# -- methods

CLASSES = ("ko", "sub", "dec")
METHOD_INPUTS = ("weight_class_ordinal", "is_5_round", "winner_prob", "ko_tendency", "sub_tendency", "dec_tendency", "favorite_prob", "fav_ko_rate", "fav_sub_rate", "fav_finish_rate", "combined_ko_rate", "combined_sub_rate", "combined_dec_rate", "combined_been_ko_rate", "combined_been_subbed_rate")


def method_rows(spark: SparkSession, sf_dir: str, decided: bool = True) -> DataFrame:
    """Method matchups with parts and filled gaps, and a flag for each class; those without a method too, unless `decided`."""
    ts = adapter.bouts(spark, sf_dir).select("fight_id", "ts")
    x = staged(with_parts(endpoints.method_matchup(spark, sf_dir, decided).join(ts, "fight_id"), (0.7, 0.8)), "method-matchups")
    flags = {f"is_{c}": (F.col("method_class") == c).cast("double") for c in CLASSES} | {"is_finish": (F.col("method_class") != "dec").cast("double")}
    return staged(features.imputed(x, list(METHOD_INPUTS), F.col("part") == 0).withColumns(flags), "method-matchups")


def _binary(x: DataFrame, label: str, where: str = "true", rounds: int = 8):
    """A model for one two-way decision, with square-root weights of its two classes."""
    train = x.where("part = 0").where(where)
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("_own"))
    total = counts.agg(F.sum("_own").alias("_n"))  # one row
    weighed = train.join(F.broadcast(counts.crossJoin(total).select(label, F.sqrt(F.col("_n") / (2.0 * F.col("_own"))).alias("w"))), label)
    gbt = GBTClassifier(labelCol=label, featuresCol="x", weightCol="w", maxIter=rounds, **(TREES | {"minInstancesPerNode": 8}))
    return Pipeline(stages=[VectorAssembler(inputCols=list(METHOD_INPUTS), outputCol="x"), gbt]).fit(weighed)


def _shares(x: DataFrame, parts: dict[str, Column]) -> DataFrame:
    total = reduce(lambda a, b: a + b, parts.values())
    return x.withColumns({k: v / total for k, v in parts.items()})


def method_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bouts after the training part with three-class probabilities: A (finish or not, then KO or submission),
    B (submission or not, then KO or decision), one model a class (R), the blend C of A and B, and C calibrated."""
    x = method_rows(spark, sf_dir)
    models = {"finish": _binary(x, "is_finish"), "ko_of_finish": _binary(x, "is_ko", "is_finish = 1"), "sub": _binary(x, "is_sub"), "ko_of_rest": _binary(x, "is_ko", "is_sub = 0"), "ko": _binary(x, "is_ko"), "dec": _binary(x, "is_dec")}
    y = x.where("part > 0")
    for name, model in models.items():
        y = probability(model, y, f"q_{name}").drop("x")
    q = lambda n: F.col(f"q_{n}")
    y = y.withColumns({"a_ko": q("finish") * q("ko_of_finish"), "a_sub": q("finish") * (1 - q("ko_of_finish")), "a_dec": 1 - q("finish"), "b_sub": q("sub"), "b_ko": (1 - q("sub")) * q("ko_of_rest"), "b_dec": (1 - q("sub")) * (1 - q("ko_of_rest"))})
    y = _shares(y, {f"r_{c}": q(c) for c in CLASSES})
    keep = [f"{m}_{c}" for m in "abr" for c in CLASSES]
    y = staged(y.select("fight_id", "part", "method_class", *keep), "method-scores")
    w = blend_weights(y.where("part = 1")).first()
    y = _shares(y, {f"c_{c}": w[f"w_{c}"] * F.col(f"a_{c}") + (1 - w[f"w_{c}"]) * F.col(f"b_{c}") for c in CLASSES})
    return calibrated_methods(y)


def _log_loss(names: list[str]) -> Column:
    own = reduce(lambda a, cn: a.when(F.col("method_class") == cn[0], F.col(cn[1])), zip(CLASSES[1:], names[1:]), F.when(F.col("method_class") == CLASSES[0], F.col(names[0])))
    return F.avg(-F.log(F.greatest(own, F.lit(1e-15))))


def blend_weights(rows: DataFrame, step: float = 0.1) -> DataFrame:
    """One row: the weights of A for each class, of an 11 x 11 x 11 grid, with the least log loss. Rows are
    exploded beside the grid a column at a time; one aggregation by grid point."""
    n = round(1 / step)
    grid = [F.explode(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.round(i * step, 6))).alias(f"w_{c}") for c in CLASSES]
    x = rows
    for g in grid:
        x = x.select("*", g)
    x = _shares(x, {f"m_{c}": F.col(f"w_{c}") * F.col(f"a_{c}") + (1 - F.col(f"w_{c}")) * F.col(f"b_{c}") for c in CLASSES})
    by = x.groupBy(*[f"w_{c}" for c in CLASSES]).agg(_log_loss([f"m_{c}" for c in CLASSES]).alias("loss"))
    return by.orderBy(F.round("loss", 12), *[f"w_{c}" for c in CLASSES]).limit(1)


#: Temperatures that are tried.
TEMPERATURES = tuple(0.5 + 0.05 * i for i in range(51))


def calibrated_methods(rows: DataFrame, on: str = "part = 1") -> DataFrame:
    """rows with d_<class>, Dirichlet calibration of the blend, and t_<class>, the blend at the temperature of least log loss; both fitted
    where `on` holds."""
    number = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("method_class")).cast("int") - 1
    blend = [f"c_{c}" for c in CLASSES]
    w, b = dirichlet.fit(rows.where(on).withColumn("_y", number), blend, "_y")
    out = dirichlet.apply(rows, w, b, blend, [f"d_{c}" for c in CLASSES])
    logs = [F.log(F.greatest(F.col(c), F.lit(dirichlet.FLOOR))) for c in blend]
    at = lambda t: text.softmax(*[x / t for x in logs])
    loss = lambda t: _log_loss_of(at(F.lit(t)))
    losses = rows.where(on).agg(*[loss(t).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]).first()  # one row
    best = min(range(len(TEMPERATURES)), key=lambda i: (losses[i] if losses[i] is not None else 0.0, TEMPERATURES[i]))
    soft = at(F.lit(TEMPERATURES[best]))
    return out.withColumns({f"t_{c}": soft[i] for i, c in enumerate(CLASSES)})


def _log_loss_of(soft) -> Column:
    own = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("method_class")).cast("int")
    return F.avg(-F.log(F.greatest(F.element_at(F.array(*[soft[i] for i in range(len(CLASSES))]), own), F.lit(1e-15))))


def method_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = method_scores(spark, sf_dir).where("part = 2")
    top = lambda m: text.argmax(CLASSES, *[F.col(f"{m}_{c}") for c in CLASSES])
    return y.select("fight_id", "method_class", *[f"{m}_{c}" for m in ("a", "b", "r", "c", "d", "t") for c in CLASSES], top("d").alias("predicted"))


# -- search and validation


def temporal_cv(spark: SparkSession, sf_dir: str, folds: int = 5) -> DataFrame:
    """Folds that grow in time: each trains on all before its stretch and scores the stretch. With the mean and
    population deviation over folds on each row."""
    m = winner_matchups(spark, sf_dir).where("label IS NOT NULL")
    m = staged(with_parts(m, tuple((i + 1) / (folds + 1) for i in range(folds))), "folds")
    out = None
    for i in range(1, folds + 1):
        x = staged(features.imputed(m.where(F.col("part") <= i), list(INPUTS), F.col("part") < i), "fold")
        test = probability(trees("label", rounds=5).fit(x.where(F.col("part") < i)), x.where(F.col("part") == i), "p")
        one = scores_of(test, ("p",)).select(F.lit(i).alias("fold"), "n", "accuracy", "log_loss", "brier")
        out = one if out is None else out.unionByName(one)
    w = Window.partitionBy()  # a row for each fold
    return staged(out, "cv").select("*", F.avg("accuracy").over(w).alias("mean_accuracy"), F.stddev_pop("accuracy").over(w).alias("deviation"))


_TRIAL = "trial int, base double, finish double, log_loss double"


@ratings.by_rows
def _trial(rows):
    rating: dict[int, float] = {}
    loss, n = 0.0, 0
    for _, red, blue, winner, finished, trial, base, finish in rows:
        a, b = rating.get(red, 1500.0), rating.get(blue, 1500.0)
        p = ratings.expected(a, b)
        won = float(winner == red)
        loss -= math.log(max(p if won else 1 - p, 1e-15))
        n += 1
        d = base * (finish if finished else 1.0) * (won - p)
        rating[red], rating[blue] = a + d, b - d
    yield trial, base, finish, loss / max(n, 1)


def parameter_search(spark: SparkSession, sf_dir: str, trials: int = 24, top: int = 3) -> DataFrame:
    """Seeded random search for the ratings' parameters: each trial folds all decided bouts, trials run in
    parallel; the best few are folded again, and must give the same."""
    workers_can_import(spark)
    rng = np.random.default_rng(SEED)
    drawn = spark.createDataFrame([(i, float(rng.uniform(8, 80)), float(rng.uniform(0.8, 2.0))) for i in range(trials)], "trial int, base double, finish double")
    b = adapter.bouts(spark, sf_dir).where("winner_id IS NOT NULL").select("fight_id", "ts", "red_id", "blue_id", "winner_id", (~F.lower("method").contains("dec")).alias("finished"))
    run = lambda t: ratings.folded(b.crossJoin(F.broadcast(t)), _trial, _TRIAL, "trial")
    first = staged(run(drawn), "trials")
    best = first.orderBy("log_loss", "trial").limit(top)
    again = run(best.select("trial", "base", "finish")).select("trial", F.col("log_loss").alias("again"))
    return best.join(again, "trial").withColumn("rank", F.row_number().over(Window.orderBy("log_loss", "trial")))  # `top` rows


QUERIES = {f.__name__: f for f in (winner_predictions, calibration_scores, interval_widths, permutation_importance, method_probabilities, temporal_cv, parameter_search)}
ORACLES: dict[str, str] = {}
