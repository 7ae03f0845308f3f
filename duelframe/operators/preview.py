"""What a preview of an upcoming bout tells: one nested document, from the last five bouts with their counts to the model's reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelframe.functions import text
from duelframe.operators import endpoints, models
from duelframe.sources import adapter
from duelframe.sources.adapter import oracle

#: Bouts and contributions of a document.
LAST_BOUTS, TOP = 5, 10
RECENT = ("recent_id", "day", "opponent", "result", "method", "round", "weight_class", "sig_str", "td", "kd", "sub_att", "ctrl")


def _of(landed: str, attempted: str) -> Column:
    return F.concat(F.col(landed).cast("string"), F.lit("/"), F.col(attempted).cast("string"))


def recent_bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last decided bouts of both sides of each upcoming bout, newest first: the rank is kept in the window, so a long career costs no more
    than its newest rows, and only entities that are asked for are ranked."""
    u = adapter.upcoming(spark, sf_dir)
    side = lambda c: F.struct(F.lit(c).alias("corner"), F.col(f"{c}_id").alias("fighter_id"))
    asked = u.select("fight_id", F.explode(F.array(side("red"), side("blue"))).alias("s")).select("fight_id", "s.*")
    first = F.broadcast(u.agg(F.min("as_of").alias("_from")))  # one row
    s = adapter.sides(spark, sf_dir).join(first, F.col("date") < F.col("_from")).where("won + lost > 0")
    s = s.join(asked.select("fighter_id").distinct(), "fighter_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("fighter_id").orderBy(F.desc("ts"), F.desc("fight_id")))
    s = s.withColumn("place", place).where(F.col("place") <= LAST_BOUTS)
    names = adapter.fighters(spark, sf_dir).select(F.col("fighter_id").alias("opponent_id"), F.concat_ws(" ", "first_name", "last_name").alias("opponent"))
    s = s.join(names, "opponent_id", "left").select(
        "fighter_id", "place", F.col("fight_id").alias("recent_id"), F.date_format("date", "yyyy-MM-dd").alias("day"), "opponent", F.when(F.col("won") == 1, "Win").otherwise("Loss").alias("result"),
        F.coalesce(F.nullif("method", F.lit("")), F.lit("Unknown")).alias("method"), F.col("finish_round").alias("round"), "weight_class", _of("sig_landed", "sig_attempted").alias("sig_str"), _of("td_landed", "td_attempted").alias("td"), "kd", "sub_att", text.clock(F.col("ctrl_seconds")).alias("ctrl"),
    )
    return asked.join(s, "fighter_id").select("fight_id", "corner", "fighter_id", "place", *RECENT)


RECENT_SQL = oracle(
    "SELECT a.fight_id, corner, a.fighter_id, CAST(place AS INTEGER) AS place, recent_id, day, first_name || ' ' || last_name AS opponent, result, method, round, weight_class, sig_str, td, kd, sub_att, ctrl FROM a JOIN s ON s.fighter_id = a.fighter_id LEFT JOIN fighters f ON f.fighter_id = s.opponent_id",
    "a AS (SELECT fight_id, unnest(['red', 'blue']) AS corner, unnest([red_id, blue_id]) AS fighter_id FROM upcoming)",
    "s AS (SELECT fighter_id, opponent_id, row_number() OVER (PARTITION BY fighter_id ORDER BY ts DESC, fight_id DESC) AS place, fight_id AS recent_id, strftime(date, '%Y-%m-%d') AS day, CASE WHEN won = 1 THEN 'Win' ELSE 'Loss' END AS result, coalesce(nullif(method, ''), 'Unknown') AS method, finish_round AS round, weight_class, sig_landed || '/' || sig_attempted AS sig_str, td_landed || '/' || td_attempted AS td, kd, sub_att, (ctrl_seconds // 60) || ':' || lpad(CAST(ctrl_seconds % 60 AS VARCHAR), 2, '0') AS ctrl FROM sides WHERE won + lost > 0 AND date < (SELECT min(date) FROM upcoming) QUALIFY place <= 5)",
)


def preview_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each upcoming bout: card, sides with their context and last bouts, the predictions table's row, its top contributions, and quotes.
    Each list is gathered by bout, with a bounded number of entries but for quotes (one for each bookmaker)."""
    u = adapter.upcoming(spark, sf_dir)
    recent = recent_bouts(spark, sf_dir).groupBy("fight_id", "corner").agg(F.array_sort(F.collect_list(F.struct("place", *RECENT))).alias("recent"))
    f = adapter.fighters(spark, sf_dir).select("fighter_id", F.concat_ws(" ", "first_name", "last_name").alias("name"), "height", "weight", "reach", "stance", "dob")
    own = endpoints.preview_context(spark, sf_dir).drop("recent").join(f, "fighter_id", "left").join(recent, ["fight_id", "corner"], "left")
    own = own.join(u.select("fight_id", "as_of"), "fight_id").withColumn("age", text.calendar_age(F.col("as_of"), F.col("dob")))
    fields = ["fighter_id", "name", "height", "weight", "reach", "stance", "age", "wins", "ko_rate", "sub_rate", "days_off", "debut", "division_change", "previous_division", "recent"]
    side = lambda c: F.max_by(F.struct(*fields), F.when(F.col("corner") == c, 1)).alias(c)
    sides = own.groupBy("fight_id").agg(side("red"), side("blue"))
    p = models.model_predictions(spark, sf_dir).where("upcoming")
    p = p.select("fight_id", F.struct("predicted_winner", F.bround("red_prob", 3).alias("red_prob"), F.bround("confidence", 3).alias("confidence"), "va_low", "va_high").alias("prediction"), F.struct("predicted_method", *[F.bround(f"p_{c}", 3).alias(f"{c}_prob") for c in models.learned.CLASSES]).alias("method_prediction"))
    why = models.model_contributions(spark, sf_dir).where(F.col("rank") <= TOP).join(u.select("fight_id"), "fight_id", "left_semi")
    why = why.groupBy("fight_id").agg(F.array_sort(F.collect_list(F.struct("rank", "feature", F.bround("contribution", 4).alias("contribution"), F.bround("value", 3).alias("feature_value")))).alias("contributions"))
    q = adapter.quotes(spark, sf_dir).join(u.select("fight_id"), "fight_id", "left_semi").groupBy("fight_id").agg(F.array_sort(F.collect_list(F.struct("id", "bookmaker", "red_odds", "blue_odds"))).alias("odds"))
    card = adapter.cards(spark, sf_dir).select("card_id", F.struct("name", F.date_format("date", "yyyy-MM-dd").alias("date"), "location").alias("event"))
    x = u.select("fight_id", "card_id", "weight_class", "time_format").join(card, "card_id", "left").join(sides, "fight_id", "left").join(p, "fight_id", "left").join(why, "fight_id", "left").join(q, "fight_id", "left")
    doc = F.struct("event", "weight_class", text.scheduled_rounds(F.col("time_format")).alias("scheduled_rounds"), "red", "blue", "prediction", "method_prediction", "contributions", "odds")
    return x.select("fight_id", F.to_json(doc).alias("document"))


QUERIES = {"recent_bouts": recent_bouts, "preview_documents": preview_documents}
ORACLES = {"recent_bouts": RECENT_SQL}
