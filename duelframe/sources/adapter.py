"""Contest tables from the driver's event table: bouts, their two sides, quotes and predictions.

Two consecutive events make a bout (red: even event_id, blue: odd), so one aggregation by
`event_id div 2` builds both sides without a self-join. ``SQL`` holds the same tables as DuckDB
common table expressions, for oracles.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.functions import odds

#: Fixed values.
DIVISIONS = ("Flyweight Bout", "Bantamweight Bout", "Featherweight Bout", "Lightweight Title Bout", "Welterweight Bout", "Middleweight Bout", "Light Heavyweight Bout", "Women's Strawweight Bout")
METHODS = {"purchase": "KO/TKO", "click": "Submission", "view": "Decision - Unanimous", "signup": "Decision - Split", "error": "Decision - Majority"}
#: Raw counts of one side of a bout.
COUNTS = ("kd", "sub_att", "rev", "ctrl_seconds", "sig_landed", "sig_attempted", "total_landed", "total_attempted", "td_landed", "td_attempted") + tuple(f"{t}_{s}" for t in ("head", "body", "leg", "distance", "clinch", "ground") for s in ("landed", "attempted"))
RED, BLUE = "red", "blue"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _stats(v: Column, k: Column) -> dict[str, Column]:
    sig_att = v % 60 + 1
    sig = (v * 7 + k) % sig_att_plus(sig_att)
    more = k % 10
    td_att = k % 6
    out = {"kd": (v + k) % 3, "sub_att": k % 3, "rev": v % 2, "ctrl_seconds": v * 3 % 240, "sig_landed": sig, "sig_attempted": sig_att, "total_landed": sig + more, "total_attempted": sig_att + more, "td_landed": v % (td_att + 1), "td_attempted": td_att}
    half = lambda x, n: F.floor(x / n)
    for side, x in (("landed", sig), ("attempted", sig_att)):
        out |= {f"head_{side}": half(x, 2), f"body_{side}": half(x, 4), f"leg_{side}": x - half(x, 2) - half(x, 4)}
        out |= {f"distance_{side}": half(x, 2), f"clinch_{side}": half(x, 3), f"ground_{side}": x - half(x, 2) - half(x, 3)}
    return out


def sig_att_plus(attempted: Column) -> Column:
    return attempted + 1


def bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each bout, with a struct of counts for each side."""
    e = events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    e = e.withColumn("v", F.floor("value").cast("long"))
    row = F.struct("user_id", "ts", "event_type", "value", "v", "k")
    pair = e.groupBy(F.expr("event_id div 2").alias("fight_id")).agg(F.max(F.when(F.col("event_id") % 2 == 0, row)).alias("r"), F.max(F.when(F.col("event_id") % 2 == 1, row)).alias("b"))
    pair = pair.where("r.user_id <> b.user_id")
    red_won, blue_won = F.col("r.value") > F.col("b.value"), F.col("r.value") < F.col("b.value")
    kind = F.when(red_won, F.col("r.event_type")).when(blue_won, F.col("b.event_type"))
    methods = F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv])
    finish_round = F.col("r.k") % 5 + 1
    counts = lambda side: F.struct(*[c.cast("long").alias(n) for n, c in _stats(F.col(f"{side}.v"), F.col(f"{side}.k")).items()])
    return pair.select(
        "fight_id",
        F.col("r.ts").alias("ts"),
        F.to_date("r.ts").alias("date"),
        F.col("r.user_id").alias("red_id"),
        F.col("b.user_id").alias("blue_id"),
        F.when(red_won, F.col("r.user_id")).when(blue_won, F.col("b.user_id")).alias("winner_id"),
        F.when(kind.isNotNull(), F.element_at(methods, kind)).alias("method"),
        F.element_at(F.array(*[F.lit(d) for d in DIVISIONS]), (F.col("fight_id") % len(DIVISIONS) + 1).cast("int")).alias("weight_class"),
        finish_round.alias("finish_round"),
        ((finish_round - 1) * 300 + (F.col("r.v") * 11 + F.col("r.k")) % 300 + 1).alias("fight_seconds"),
        F.when((finish_round > 3) | (F.col("fight_id") % len(DIVISIONS) == 3), "5-5-5-5-5").otherwise("5-5-5").alias("time_format"),
        F.datediff(F.to_date("r.ts"), F.lit("1970-01-01").cast("date")).cast("long").alias("card_id"),
        counts("r").alias("red"),
        counts("b").alias("blue"),
    )


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows for each bout: own counts as named, the opponent's with the prefix opp_."""
    b = bouts(spark, sf_dir)

    def side(me: str, other: str) -> Column:
        return F.struct(F.lit(me).alias("corner"), F.col(f"{me}_id").alias("fighter_id"), F.col(f"{other}_id").alias("opponent_id"), F.col(me).alias("own"), F.col(other).alias("opp"))

    x = b.select("fight_id", "ts", "date", "winner_id", "method", "weight_class", "finish_round", "fight_seconds", F.explode(F.array(side(RED, BLUE), side(BLUE, RED))).alias("s"))
    method = F.coalesce("method", F.lit(""))
    won = F.coalesce(F.col("winner_id") == F.col("s.fighter_id"), F.lit(False))
    return x.select(
        "fight_id", "ts", "date", "weight_class", "method", "finish_round", "fight_seconds", "s.corner", "s.fighter_id", "s.opponent_id",
        won.cast("int").alias("won"), (F.col("winner_id").isNotNull() & ~won).cast("int").alias("lost"),
        method.contains("KO").cast("int").alias("is_ko"), F.lower(method).contains("sub").cast("int").alias("is_sub"), F.lower(method).contains("dec").cast("int").alias("is_dec"),
        *[F.col(f"s.own.{c}").alias(c) for c in COUNTS], *[F.col(f"s.opp.{c}").alias(f"opp_{c}") for c in COUNTS],
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three bookmakers' American odds for each bout that has quotes."""
    f, b = F.col("fight_id"), F.col("bookmaker_no")
    x = bouts(spark, sf_dir).where(f % 10 != 9).select("fight_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("bookmaker_no"))
    favourite = -(110 + (7 * f + 13 * b) % 290)
    underdog = 100 + (5 * f + 17 * b) % 300
    even = f % 2 == 0
    return x.select((f * 3 + b).alias("id"), "fight_id", F.concat(F.lit("book"), b.cast("string")).alias("bookmaker"), F.when(even, favourite).otherwise(underdog).cast("int").alias("red_odds"), F.when(even, underdog).otherwise(favourite).cast("int").alias("blue_odds")).withColumns({"red_implied": odds.implied("red_odds"), "blue_implied": odds.implied("blue_odds")})


#: Names a table of predictions, as models.write_predictions makes it; unset: made up.
PREDICTIONS = "duelframe.predictions"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """red_prob, predicted_method (and bounds where the table has them) of bouts, with their outcome: from the table that PREDICTIONS names, or made
    up."""
    f = F.col("fight_id")
    outcome = (F.when(F.col("winner_id").isNotNull(), (F.col("winner_id") == F.col("red_id")).cast("int")).alias("red_won"), "method", "weight_class", "finish_round")
    at = spark.conf.get(PREDICTIONS, None)
    if at:
        p = spark.read.parquet(at)
        return bouts(spark, sf_dir).select("fight_id", *outcome).join(p.select("fight_id", "red_prob", "predicted_method", "va_low", "va_high"), "fight_id")
    classes = F.array(F.lit("ko"), F.lit("sub"), F.lit("dec"))
    return bouts(spark, sf_dir).where(f % 10 != 8).select("fight_id", ((37 * f) % 1000 / F.lit(1000.0)).alias("red_prob"), F.element_at(classes, (f % 3 + 1).cast("int")).alias("predicted_method"), *outcome)


@contextmanager
def reading_predictions(spark: SparkSession, path: str) -> Iterator[None]:
    """Queries that are made within read the table under `path`."""
    before = spark.conf.get(PREDICTIONS, None)
    spark.conf.set(PREDICTIONS, path)
    try:
        yield
    finally:
        spark.conf.unset(PREDICTIONS) if before is None else spark.conf.set(PREDICTIONS, before)


#: Names, stances and places of the invented entities and cards.
FIRST_NAMES = ("José", "Anna", "Łukasz", "Jiří", "Max", "Zoë", "Carlos", "Ben-Ali")
LAST_NAMES = ("Silva", "Müller", "O'Neill", "Novák", "St. Pierre", "Ortega", "Žižka")
STANCES = ("Orthodox", "Southpaw", "Switch")
PLACES = ("Las Vegas", "London", "Abu Dhabi", "Paris")


def _of(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def fighters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each entity: names, measures as texts, stance and date of birth."""
    u = events(spark, sf_dir).select(F.col("user_id").alias("fighter_id")).distinct()
    n, text = F.col("fighter_id"), lambda c: c.cast("string")
    return u.select(
        "fighter_id", _of(FIRST_NAMES, n).alias("first_name"), F.concat(_of(LAST_NAMES, n), F.lit(" "), text(n)).alias("last_name"),
        F.when(n % 7 == 0, "--").otherwise(F.concat(text(n % 2 + 5), F.lit("' "), text(n % 12), F.lit('"'))).alias("height"),
        F.concat(text(n % 9 * 10 + 125), F.lit(" lbs.")).alias("weight"), F.when(n % 5 == 0, "--").otherwise(F.concat(text(n % 20 + 60), F.lit('"'))).alias("reach"),
        F.when(n % 4 < 3, _of(STANCES, n % 4)).alias("stance"), F.date_add(F.lit("1980-01-01").cast("date"), (n * 37 % 7000).cast("int")).alias("dob"),
    )


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each day with bouts."""
    c = F.col("card_id")
    return bouts(spark, sf_dir).select("card_id", "date").distinct().select("card_id", "date", F.concat(F.lit("Card "), c.cast("string")).alias("name"), _of(PLACES, c).alias("location"))


def upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bouts of the last day, without their results."""
    b = bouts(spark, sf_dir)
    last = F.broadcast(b.agg(F.max("date").alias("as_of")))  # one row
    gone = ("winner_id", "method", "finish_round", "fight_seconds")
    return b.join(last, b["date"] == last["as_of"]).withColumns({c: F.lit(None).cast(b.schema[c].dataType) for c in gone})


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each side and round: a bout's counts dealt evenly, the rest to the last round."""
    x = sides(spark, sf_dir).withColumn("round_number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("finish_round").cast("long"))))
    last = F.col("round_number") == F.col("finish_round")
    dealt = [(F.floor(F.col(c) / F.col("finish_round")) + F.when(last, F.col(c) % F.col("finish_round")).otherwise(0)).cast("long").alias(c) for c in COUNTS]
    return x.select("fight_id", "ts", "fighter_id", "corner", "weight_class", "round_number", *dealt)


_HALF = {"head": "{x} // 2", "body": "{x} // 4", "leg": "{x} - {x} // 2 - {x} // 4", "distance": "{x} // 2", "clinch": "{x} // 3", "ground": "{x} - {x} // 2 - {x} // 3"}


def _split_sql() -> str:
    return ", ".join(f"{_HALF[t].format(x='sig_' + s)} AS {t}_{s}" for s in ("landed", "attempted") for t in _HALF)


def _listed(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


#: The same tables for DuckDB.
SQL = f"""
ev AS (SELECT event_id, event_id // 2 AS fight_id, event_id % 2 AS side, ts, user_id, event_type, value, CAST(floor(value) AS BIGINT) AS v, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events),
st AS (SELECT *, v % 60 + 1 AS sig_attempted, (v * 7 + k) % (v % 60 + 2) AS sig_landed FROM ev),
cn AS (SELECT event_id, fight_id, side, ts, user_id, event_type, value, v, k, (v + k) % 3 AS kd, k % 3 AS sub_att, v % 2 AS rev, v * 3 % 240 AS ctrl_seconds, sig_landed, sig_attempted, sig_landed + k % 10 AS total_landed, sig_attempted + k % 10 AS total_attempted, v % (k % 6 + 1) AS td_landed, k % 6 AS td_attempted, {_split_sql()} FROM st),
pr AS (SELECT r.fight_id, r.ts, CAST(r.ts AS DATE) AS date, r.user_id AS red_id, b.user_id AS blue_id,
  CASE WHEN r.value > b.value THEN r.user_id WHEN r.value < b.value THEN b.user_id END AS winner_id,
  CASE CASE WHEN r.value > b.value THEN r.event_type WHEN r.value < b.value THEN b.event_type END {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in METHODS.items())} END AS method,
  CASE r.fight_id % 8 {' '.join(f"WHEN {i} THEN '{d.replace(chr(39), chr(39) * 2)}'" for i, d in enumerate(DIVISIONS))} END AS weight_class,
  r.k % 5 + 1 AS finish_round, (r.k % 5) * 300 + (r.v * 11 + r.k) % 300 + 1 AS fight_seconds,
  CASE WHEN r.k % 5 + 1 > 3 OR r.fight_id % 8 = 3 THEN '5-5-5-5-5' ELSE '5-5-5' END AS time_format, CAST(CAST(r.ts AS DATE) - DATE '1970-01-01' AS BIGINT) AS card_id
  FROM cn r JOIN cn b ON r.fight_id = b.fight_id AND r.side = 0 AND b.side = 1 WHERE r.user_id <> b.user_id),
sides AS (SELECT p.fight_id, p.ts, p.date, p.weight_class, p.method, p.finish_round, p.fight_seconds, CASE o.side WHEN 0 THEN 'red' ELSE 'blue' END AS corner, o.user_id AS fighter_id, q.user_id AS opponent_id,
  CAST(coalesce(p.winner_id = o.user_id, false) AS INTEGER) AS won, CAST(p.winner_id IS NOT NULL AND p.winner_id <> o.user_id AS INTEGER) AS lost,
  CAST(contains(coalesce(p.method, ''), 'KO') AS INTEGER) AS is_ko, CAST(contains(lower(coalesce(p.method, '')), 'sub') AS INTEGER) AS is_sub, CAST(contains(lower(coalesce(p.method, '')), 'dec') AS INTEGER) AS is_dec,
  {', '.join(f'o.{c}' for c in COUNTS)}, {', '.join(f'q.{c} AS opp_{c}' for c in COUNTS)}
  FROM pr p JOIN cn o ON p.fight_id = o.fight_id JOIN cn q ON p.fight_id = q.fight_id AND o.side <> q.side),
qt0 AS (SELECT p.fight_id, b AS n, -(110 + (7 * p.fight_id + 13 * b) % 290) AS fav, 100 + (5 * p.fight_id + 17 * b) % 300 AS dog FROM pr p, (SELECT unnest([0, 1, 2]) AS b) WHERE p.fight_id % 10 <> 9),
qt1 AS (SELECT fight_id * 3 + n AS id, fight_id, 'book' || n AS bookmaker, CAST(CASE WHEN fight_id % 2 = 0 THEN fav ELSE dog END AS INTEGER) AS red_odds, CAST(CASE WHEN fight_id % 2 = 0 THEN dog ELSE fav END AS INTEGER) AS blue_odds FROM qt0),
quotes AS (SELECT *, CASE WHEN red_odds > 0 THEN 100.0::DOUBLE / (red_odds + 100) ELSE abs(red_odds)::DOUBLE / (abs(red_odds) + 100) END AS red_implied, CASE WHEN blue_odds > 0 THEN 100.0::DOUBLE / (blue_odds + 100) ELSE abs(blue_odds)::DOUBLE / (abs(blue_odds) + 100) END AS blue_implied FROM qt1),
fighters AS (SELECT fighter_id, [{_listed(FIRST_NAMES)}][fighter_id % 8 + 1] AS first_name, [{_listed(LAST_NAMES)}][fighter_id % 7 + 1] || ' ' || fighter_id AS last_name, CASE WHEN fighter_id % 7 = 0 THEN '--' ELSE (fighter_id % 2 + 5) || '''' || ' ' || (fighter_id % 12) || '"' END AS height, (fighter_id % 9 * 10 + 125) || ' lbs.' AS weight, CASE WHEN fighter_id % 5 = 0 THEN '--' ELSE (fighter_id % 20 + 60) || '"' END AS reach, CASE WHEN fighter_id % 4 < 3 THEN [{_listed(STANCES)}][fighter_id % 4 + 1] END AS stance, DATE '1980-01-01' + CAST(fighter_id * 37 % 7000 AS INTEGER) AS dob FROM (SELECT DISTINCT user_id AS fighter_id FROM events)),
cards AS (SELECT card_id, date, 'Card ' || card_id AS name, [{_listed(PLACES)}][card_id % 4 + 1] AS location FROM (SELECT DISTINCT card_id, date FROM pr)),
upcoming AS (SELECT * EXCLUDE (winner_id, method, finish_round, fight_seconds) FROM pr WHERE date = (SELECT max(date) FROM pr)),
rounds AS (SELECT fight_id, ts, fighter_id, corner, weight_class, round_number, {', '.join(f"{c} // finish_round + CASE WHEN round_number = finish_round THEN {c} % finish_round ELSE 0 END AS {c}" for c in COUNTS)} FROM (SELECT *, unnest(range(1, finish_round + 1)) AS round_number FROM sides)),
preds AS (SELECT fight_id, ((37 * fight_id) % 1000) / 1000.0::DOUBLE AS red_prob, CASE fight_id % 3 WHEN 0 THEN 'ko' WHEN 1 THEN 'sub' ELSE 'dec' END AS predicted_method, CASE WHEN winner_id IS NOT NULL THEN CAST(winner_id = red_id AS INTEGER) END AS red_won, method, weight_class, finish_round FROM pr WHERE fight_id % 10 <> 8)
"""


def oracle(select: str, *more: str) -> str:
    """A DuckDB query over the adapted tables: pr (bouts), sides, quotes, preds."""
    return "WITH " + ",\n".join([SQL.strip(), *more]) + "\n" + select
