"""Quality of predictions: by class, by bucket, and against the outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelframe.functions.text import argmax as text_argmax
from duelframe.functions.text import method_class
from duelframe.sources import adapter
from duelframe.sources.adapter import oracle

CLASSES = ("ko", "sub", "dec")


def _methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """actual and predicted class; bouts with an unmapped method are left out."""
    return adapter.predictions(spark, sf_dir).select("fight_id", "predicted_method", method_class(F.col("method")).alias("actual")).where("actual IS NOT NULL")


def method_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of each class."""
    m = _methods(spark, sf_dir)
    one = m.select(F.explode(F.array(*[F.lit(c) for c in CLASSES])).alias("class"), "actual", "predicted_method")
    hit = (F.col("actual") == F.col("class")) & (F.col("predicted_method") == F.col("class"))
    g = one.groupBy("class").agg(F.count_if(hit).alias("hits"), F.count_if(F.col("predicted_method") == F.col("class")).alias("predicted"), F.count_if(F.col("actual") == F.col("class")).alias("support"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), b), F.lit(0.0))
    return g.withColumns({"precision": ratio("hits", "predicted"), "recall": ratio("hits", "support")}).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


_M = "m AS (SELECT fight_id, predicted_method, CASE WHEN method = 'KO/TKO' THEN 'ko' WHEN method = 'Submission' THEN 'sub' WHEN starts_with(method, 'Decision') THEN 'dec' END AS actual FROM preds)"
METHOD_SQL = oracle(
    "SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM g",
    _M,
    "g0 AS (SELECT class, count(*) FILTER (actual = class AND predicted_method = class) AS hits, count(*) FILTER (predicted_method = class) AS predicted, count(*) FILTER (actual = class) AS support FROM m, (SELECT unnest(['ko', 'sub', 'dec']) AS class) WHERE actual IS NOT NULL GROUP BY class)",
    "g AS (SELECT *, coalesce(hits::DOUBLE / nullif(predicted, 0), 0.0) AS precision, coalesce(hits::DOUBLE / nullif(support, 0), 0.0) AS recall FROM g0)",
)


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _methods(spark, sf_dir).groupBy("actual").pivot("predicted_method", list(CLASSES)).count().na.fill(0)


CONFUSION_SQL = oracle("SELECT actual, " + ", ".join(f"count(*) FILTER (predicted_method = '{c}') AS {c}" for c in CLASSES) + " FROM m WHERE actual IS NOT NULL GROUP BY actual", _M)


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.predictions(spark, sf_dir).where("red_won IS NOT NULL").select("weight_class", "finish_round", F.col("red_prob").alias("p"), F.col("red_won").alias("y"))


def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten bins of the prediction: mean prediction against the share of wins."""
    d = _decided(spark, sf_dir)
    return d.groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("share"))


RELIABILITY_SQL = oracle("SELECT least(CAST(floor(red_prob * 10) AS BIGINT), 9) AS bin, count(*) AS n, avg(red_prob) AS mean_p, avg(red_won) AS share FROM preds WHERE red_won IS NOT NULL GROUP BY 1")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, log loss (clipped at 1e-6), Brier score and AUC (as the rank sum), by division."""
    d = _decided(spark, sf_dir)
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("p")))
    by = d.groupBy("weight_class").agg(F.count(F.lit(1)).alias("n"), F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")).alias("accuracy"), F.avg(-F.when(F.col("y") == 1, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))
    # Equal predictions share the mean rank: counts by prediction first, then one running sum each.
    at = d.groupBy("weight_class", "p").agg(F.sum("y").alias("pos"), (F.count(F.lit(1)) - F.sum("y")).alias("neg"))
    before = F.coalesce(F.sum("neg").over(Window.partitionBy("weight_class").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    auc = at.withColumn("won", F.col("pos") * (before + F.col("neg") / 2.0)).groupBy("weight_class").agg(F.try_divide(F.sum("won"), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))
    return by.join(auc, "weight_class")


SCORES_SQL = oracle(
    "SELECT b.*, auc FROM (SELECT weight_class, count(*) AS n, avg(CAST((red_prob >= 0.5) = (red_won = 1) AS INTEGER)) AS accuracy, avg(-CASE WHEN red_won = 1 THEN ln(greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, red_prob))) ELSE ln(1 - greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, red_prob))) END) AS log_loss, avg(pow(red_prob - red_won, 2)) AS brier FROM preds WHERE red_won IS NOT NULL GROUP BY weight_class) b JOIN a USING (weight_class)",
    "a AS (SELECT p.weight_class, sum(CASE WHEN p.red_prob > n.red_prob THEN 1.0::DOUBLE WHEN p.red_prob = n.red_prob THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) / count(*) AS auc FROM preds p JOIN preds n ON p.weight_class = n.weight_class AND p.red_won = 1 AND n.red_won = 0 GROUP BY 1)",
)


def stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by round of the finish and confidence, of strata of ten or more."""
    d = _decided(spark, sf_dir).withColumn("confident", (F.abs(F.col("p") - 0.5) >= 0.25).cast("int"))
    return d.groupBy("finish_round", "confident").agg(F.count(F.lit(1)).alias("n"), F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")).alias("accuracy")).where("n >= 10")


STRATA_SQL = oracle("SELECT finish_round, CAST(abs(red_prob - 0.5) >= 0.25 AS INTEGER) AS confident, count(*) AS n, avg(CAST((red_prob >= 0.5) = (red_won = 1) AS INTEGER)) AS accuracy FROM preds WHERE red_won IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10")


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square-root weights of the classes."""
    g = _methods(spark, sf_dir).groupBy("actual").agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("total"))  # one row
    return g.crossJoin(F.broadcast(total)).select("actual", "n", F.sqrt(F.col("total") / (3.0 * F.col("n"))).alias("weight"))


WEIGHTS_SQL = oracle("SELECT actual, count(*) AS n, sqrt(sum(count(*)) OVER () / (3.0::DOUBLE * count(*))) AS weight FROM m WHERE actual IS NOT NULL GROUP BY actual", _M)


def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Information between each binned count and the result: contingency counts, then one sum.

    Bins of equal width; the values differ from a nearest-neighbour estimate by construction."""
    s = adapter.sides(spark, sf_dir)
    cols = ("sig_landed", "td_landed", "kd", "ctrl_seconds")
    long = s.select("won", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.least(F.floor(F.col(c) / F.lit(w)), F.lit(9)).alias("bin")) for c, w in zip(cols, (6, 1, 1, 24))])).alias("x")).select("won", "x.feature", "x.bin")
    joint = long.groupBy("feature", "bin", "won").agg(F.count(F.lit(1)).alias("n"))
    p = lambda *by: F.sum("n").over(Window.partitionBy(*by)) / F.sum("n").over(Window.partitionBy("feature"))
    terms = joint.select("feature", (p("feature", "bin", "won") * F.log(p("feature", "bin", "won") / (p("feature", "bin") * p("feature", "won")))).alias("t"))
    return terms.groupBy("feature").agg(F.round(F.sum("t"), 9).alias("information"))


MI_SQL = oracle(
    "SELECT feature, round(sum(pj * ln(pj / (pb * pw))), 9) AS information FROM q GROUP BY feature",
    "lo AS (SELECT won, unnest([{'f': 'sig_landed', 'b': least(sig_landed // 6, 9)}, {'f': 'td_landed', 'b': least(td_landed, 9)}, {'f': 'kd', 'b': least(kd, 9)}, {'f': 'ctrl_seconds', 'b': least(ctrl_seconds // 24, 9)}]) AS x FROM sides)",
    "j AS (SELECT x.f AS feature, x.b AS bin, won, count(*) AS n FROM lo GROUP BY ALL)",
    "q AS (SELECT feature, n::DOUBLE / sum(n) OVER (PARTITION BY feature) AS pj, sum(n) OVER (PARTITION BY feature, bin)::DOUBLE / sum(n) OVER (PARTITION BY feature) AS pb, sum(n) OVER (PARTITION BY feature, won)::DOUBLE / sum(n) OVER (PARTITION BY feature) AS pw FROM j)",
)

#: A three-class prediction for want of a model's: shares that depend on the bout and lean to the predicted class.
_P3 = {c: f"(CASE WHEN predicted_method = '{c}' THEN 3 ELSE 1 END + (fight_id % {m}) * CAST(0.1 AS DOUBLE))" for c, m in zip(CLASSES, (3, 5, 7))}
_TOTAL3 = " + ".join(_P3.values())


def _three(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _methods(spark, sf_dir)
    return x.select("fight_id", "actual", *[F.expr(f"{e} / ({_TOTAL3})").alias(f"p_{c}") for c, e in _P3.items()])


def method_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-class log loss and Brier score (by class and their mean), accuracy, the majority's share, and macro
    and weighted F1, from one aggregation by class."""
    x = _three(spark, sf_dir)
    own = F.when(F.col("actual") == "ko", F.col("p_ko")).when(F.col("actual") == "sub", F.col("p_sub")).otherwise(F.col("p_dec"))
    top = text_argmax(CLASSES, *[F.col(f"p_{c}") for c in CLASSES])
    x = x.withColumns({"own": own, "top": top})
    one = x.agg(F.count(F.lit(1)).alias("n"), F.avg(-F.log("own")).alias("log_loss"), F.avg((F.col("top") == F.col("actual")).cast("double")).alias("accuracy"), *[F.avg(F.pow(F.col(f"p_{c}") - (F.col("actual") == c).cast("double"), 2)).alias(f"brier_{c}") for c in CLASSES], *[F.count_if(F.col("actual") == c).alias(f"n_{c}") for c in CLASSES], *[F.count_if(F.col("top") == c).alias(f"t_{c}") for c in CLASSES], *[F.count_if((F.col("top") == c) & (F.col("actual") == c)).alias(f"h_{c}") for c in CLASSES])
    f1 = lambda c: F.coalesce(F.try_divide(2.0 * F.col(f"h_{c}"), F.col(f"n_{c}") + F.col(f"t_{c}")), F.lit(0.0))
    total = lambda xs: sum(xs[1:], xs[0])
    return one.select("n", "log_loss", "accuracy", *[f"brier_{c}" for c in CLASSES], (total([F.col(f"brier_{c}") for c in CLASSES]) / 3).alias("brier"), (F.greatest(*[F.col(f"n_{c}") for c in CLASSES]) / F.col("n")).alias("majority"), (total([f1(c) for c in CLASSES]) / 3).alias("macro_f1"), (total([f1(c) * F.col(f"n_{c}") for c in CLASSES]) / F.col("n")).alias("weighted_f1"))


_F1 = {c: f"coalesce(2.0::DOUBLE * h_{c} / nullif(n_{c} + t_{c}, 0), 0.0)" for c in CLASSES}
QUALITY_SQL = oracle(
    f"SELECT n, log_loss, accuracy, {', '.join(f'brier_{c}' for c in CLASSES)}, ({' + '.join(f'brier_{c}' for c in CLASSES)}) / 3 AS brier, greatest({', '.join(f'n_{c}' for c in CLASSES)}) / n::DOUBLE AS majority, ({' + '.join(_F1.values())}) / 3 AS macro_f1, ({' + '.join(f'{v} * n_{c}' for c, v in _F1.items())}) / n AS weighted_f1 FROM o",
    _M,
    f"p AS (SELECT fight_id, actual, {', '.join(f'{e} / ({_TOTAL3}) AS p_{c}' for c, e in _P3.items())} FROM m WHERE actual IS NOT NULL)",
    "t AS (SELECT *, CASE actual WHEN 'ko' THEN p_ko WHEN 'sub' THEN p_sub ELSE p_dec END AS own, CASE WHEN p_ko >= p_sub AND p_ko >= p_dec THEN 'ko' WHEN p_sub >= p_dec THEN 'sub' ELSE 'dec' END AS top FROM p)",
    f"o AS (SELECT count(*) AS n, avg(-ln(own)) AS log_loss, avg(CASE WHEN top = actual THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy, {', '.join(f'avg(pow(p_{c} - CASE WHEN actual = {c!r} THEN 1 ELSE 0 END, 2)) AS brier_{c}, count(*) FILTER (actual = {c!r}) AS n_{c}, count(*) FILTER (top = {c!r}) AS t_{c}, count(*) FILTER (top = {c!r} AND actual = {c!r}) AS h_{c}' for c in CLASSES)} FROM t)",
)


def method_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the method by confidence of the prediction (tenths) and by division, of strata of five or more."""
    x = _three(spark, sf_dir).join(adapter.predictions(spark, sf_dir).select("fight_id", "weight_class"), "fight_id")
    top = F.greatest(*[F.col(f"p_{c}") for c in CLASSES])
    right = (text_argmax(CLASSES, *[F.col(f"p_{c}") for c in CLASSES]) == F.col("actual")).cast("double")
    keys = F.array(F.struct(F.lit("confidence").alias("kind"), F.floor(top * 10).cast("string").alias("stratum")), F.struct(F.lit("division").alias("kind"), F.col("weight_class").alias("stratum")))
    return x.select(right.alias("r"), F.explode(keys).alias("k")).groupBy("k.kind", "k.stratum").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("accuracy")).where("n >= 5")


METHOD_STRATA_SQL = oracle(
    "SELECT kind, stratum, count(*) AS n, avg(r) AS accuracy FROM (SELECT 'confidence' AS kind, CAST(CAST(floor(greatest(p_ko, p_sub, p_dec) * 10) AS BIGINT) AS VARCHAR) AS stratum, r FROM t UNION ALL SELECT 'division', weight_class, r FROM t) GROUP BY 1, 2 HAVING count(*) >= 5",
    _M,
    f"p AS (SELECT fight_id, actual, {', '.join(f'{e} / ({_TOTAL3}) AS p_{c}' for c, e in _P3.items())} FROM m WHERE actual IS NOT NULL)",
    "t AS (SELECT p.*, weight_class, CASE WHEN CASE WHEN p_ko >= p_sub AND p_ko >= p_dec THEN 'ko' WHEN p_sub >= p_dec THEN 'sub' ELSE 'dec' END = actual THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r FROM p JOIN preds q ON q.fight_id = p.fight_id)",
)


def binary_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square-root weights of finish against decision, and of KO against submission."""
    x = _methods(spark, sf_dir).select(F.explode(F.filter(F.array(F.struct(F.lit("finish").alias("decision"), (F.col("actual") != "dec").cast("int").alias("label")), F.when(F.col("actual") != "dec", F.struct(F.lit("ko").alias("decision"), (F.col("actual") == "ko").cast("int").alias("label")))), lambda s: s.isNotNull())).alias("x")).select("x.*")
    g = x.groupBy("decision", "label").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("decision"))  # two rows each
    return g.select("decision", "label", "n", F.sqrt(total / (2.0 * F.col("n"))).alias("weight"))


BINARY_SQL = oracle("SELECT decision, label, count(*) AS n, sqrt(sum(count(*)) OVER (PARTITION BY decision) / (2.0::DOUBLE * count(*))) AS weight FROM (SELECT 'finish' AS decision, CAST(actual <> 'dec' AS INTEGER) AS label FROM m WHERE actual IS NOT NULL UNION ALL SELECT 'ko', CAST(actual = 'ko' AS INTEGER) FROM m WHERE actual IN ('ko', 'sub')) GROUP BY 1, 2", _M)

#: Features that stay whatever they tell, and how many of the others do.
FORCED, KEPT = ("kd",), 2


def selected_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features that tell most of the result, and those that are kept anyway."""
    mi = mutual_information(spark, sf_dir)
    place = F.row_number().over(Window.orderBy(F.desc("information"), "feature"))  # a row for each feature
    return mi.withColumn("place", place).where((F.col("place") <= KEPT) | F.col("feature").isin(*FORCED)).select("feature", "information", "place")


SELECTED_SQL = f"SELECT feature, information, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (ORDER BY information DESC, feature) AS place FROM ({MI_SQL})) WHERE place <= {KEPT} OR feature IN ('kd')"


def part_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By class: its share, and whether it is the most frequent one (the baseline a model must beat)."""
    g = _methods(spark, sf_dir).groupBy("actual").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()  # three rows
    return g.select("actual", "n", (F.col("n") / F.sum("n").over(w)).alias("share"), (F.col("n") == F.max("n").over(w)).alias("is_majority"))


MAJORITY_SQL = oracle("SELECT actual, count(*) AS n, count(*) / sum(count(*)) OVER () AS share, count(*) = max(count(*)) OVER () AS is_majority FROM m WHERE actual IS NOT NULL GROUP BY actual", _M)

QUERIES = {"method_metrics": method_metrics, "confusion": confusion, "reliability": reliability, "brier": scores, "stratified_accuracy": stratified, "class_weights": class_weights, "mutual_information": mutual_information, "method_quality": method_quality, "method_strata": method_strata, "binary_weights": binary_weights, "selected_features": selected_features, "part_majority": part_majority}
ORACLES = {"method_metrics": METHOD_SQL, "confusion": CONFUSION_SQL, "reliability": RELIABILITY_SQL, "brier": SCORES_SQL, "stratified_accuracy": STRATA_SQL, "class_weights": WEIGHTS_SQL, "mutual_information": MI_SQL, "method_quality": QUALITY_SQL, "method_strata": METHOD_STRATA_SQL, "binary_weights": BINARY_SQL, "selected_features": SELECTED_SQL, "part_majority": MAJORITY_SQL}
