"""Quotes that name two entities, matched to bouts by both names in either order.

A name matches another if the two are equal once normalized, or have the same last word and first letter; the pair of a quote matches a
bout if one orientation has both its names match. Candidates meet by the unordered pair of last words, so a common
surname alone is no key, and pairs that still are frequent are split by salts: quotes are dealt over them, bouts are
repeated for each salt of their pair. Each quote keeps its best bout: most equal names, then the nearest in time, then the
first orientation, then the least id.

A name without a letter or digit matches nothing; quotes without a bout have nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelframe.functions import text
from duelframe.sources import adapter
from duelframe.sources.adapter import oracle

#: Bouts of one pair of last words in one part.
PART = 1000


def _parsed(name: Column) -> Column:
    n = text.normal_name(name)
    words = F.split(n, " ")
    return F.struct(n.alias("name"), F.element_at(words, -1).alias("last"), F.substring(n, 1, 1).alias("initial"))


def _pair(a: str, b: str) -> Column:
    return F.struct(F.least(f"{a}.last", f"{b}.last").alias("lo"), F.greatest(f"{a}.last", f"{b}.last").alias("hi"))


def _equal(a: str, b: str) -> Column:
    return F.col(f"{a}.name") == F.col(f"{b}.name")


def _matches(a: str, b: str) -> Column:
    return _equal(a, b) | ((F.col(f"{a}.last") == F.col(f"{b}.last")) & (F.col(f"{a}.initial") == F.col(f"{b}.initial")))


def linked(quotes: DataFrame, bouts: DataFrame, part: int = PART) -> DataFrame:
    """quote_id, fight_id, swapped, equal_names of quotes(quote_id, at, first, second) and bouts(fight_id, ts, red, blue): the
    best bout of each quote; swapped: the first name is the blue corner's."""
    q = quotes.select("quote_id", "at", _parsed(F.col("first")).alias("f"), _parsed(F.col("second")).alias("s")).withColumn("pair", _pair("f", "s"))
    b = bouts.select("fight_id", "ts", _parsed(F.col("red")).alias("r"), _parsed(F.col("blue")).alias("b")).withColumn("pair", _pair("r", "b")).where("r.last <> '' AND b.last <> ''")
    # A pair's bouts in parts of about `part`; a quote meets them all, one part at a time.
    parts = b.groupBy("pair").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    b = b.join(parts, "pair").withColumn("part", F.pmod(F.xxhash64("fight_id"), F.col("parts")).cast("int")).drop("parts")
    q = q.join(parts, "pair", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    x = q.join(b, ["pair", "part"])
    straight, crossed = _matches("f", "r") & _matches("s", "b"), _matches("f", "b") & _matches("s", "r")
    x = x.where(straight | crossed)
    number = lambda p, r: _equal(*p).cast("int") + _equal(*r).cast("int")
    as_is, turned = F.when(straight, number(("f", "r"), ("s", "b"))), F.when(crossed, number(("f", "b"), ("s", "r")))
    x = x.withColumn("swapped", F.coalesce(turned > F.coalesce(as_is, F.lit(-1)), F.lit(False)))
    x = x.withColumn("equal_names", F.when(F.col("swapped"), turned).otherwise(as_is))
    # The least of these is the best: one partial minimum for each quote before the shuffle.
    away = F.abs(F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")))
    best = x.groupBy("quote_id").agg(F.min(F.struct((-F.col("equal_names")).alias("less"), away.alias("away"), "swapped", "fight_id")).alias("m"))
    best = best.select("quote_id", "m.fight_id", "m.swapped", (-F.col("m.less")).alias("equal_names"))
    return quotes.select("quote_id").join(best, "quote_id", "left")


#: A quote's names by its number: as they are, swapped, with an initial, swapped with an initial, or of somebody else.
KINDS = 5


def named_quotes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(quotes, bouts) with the names of the adapted entities."""
    f = adapter.fighters(spark, sf_dir).select("fighter_id", "first_name", "last_name")
    b = adapter.bouts(spark, sf_dir).select("fight_id", "ts", "red_id", "blue_id")
    name = lambda c: F.struct(F.col("first_name").alias("first"), F.col("last_name").alias("last")).alias(c)
    b = b.join(f.select(F.col("fighter_id").alias("red_id"), name("r")), "red_id").join(f.select(F.col("fighter_id").alias("blue_id"), name("b")), "blue_id")
    full = lambda c: F.concat_ws(" ", F.col(f"{c}.first"), F.col(f"{c}.last"))
    short = lambda c: F.concat(F.substring(F.col(f"{c}.first"), 1, 1), F.lit(". "), F.upper(F.col(f"{c}.last")))
    kind = F.col("fight_id") % KINDS
    first = F.when(kind == 0, full("r")).when(kind == 1, full("b")).when(kind == 2, short("r")).when(kind == 3, short("b")).otherwise(F.lit("Somebody Else"))
    second = F.when(kind == 0, full("b")).when(kind == 1, full("r")).when(kind == 2, full("b")).when(kind == 3, short("r")).otherwise(full("b"))
    quotes = b.select(F.col("fight_id").alias("quote_id"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("at"), first.alias("first"), second.alias("second"))
    return quotes, b.select("fight_id", "ts", full("r").alias("red"), full("b").alias("blue"))


def quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(*named_quotes(spark, sf_dir))


_NORM = "trim(replace(replace(replace(lower({}), '-', ' '), '.', ''), '''', ''))"
_FULL = "{0}.first_name || ' ' || {0}.last_name"
_SHORT = "{0}.first_name[1] || '. ' || upper({0}.last_name)"
_R, _B, _RS, _BS = _FULL.format("r"), _FULL.format("b"), _SHORT.format("r"), _SHORT.format("b")
_LAST, _M = "list_last(string_split({}, ' '))", "({0} = {1} OR list_last(string_split({0}, ' ')) = list_last(string_split({1}, ' ')) AND {0}[1] = {1}[1])"
LINKS_SQL = oracle(
    "SELECT n.fight_id AS quote_id, z.fight_id, swapped, equal_names FROM n LEFT JOIN z ON z.quote_id = n.fight_id",
    f"n0 AS (SELECT p.fight_id, p.ts, {_R} AS red, {_B} AS blue, CASE p.fight_id % 5 WHEN 0 THEN {_R} WHEN 1 THEN {_B} WHEN 2 THEN {_RS} WHEN 3 THEN {_BS} ELSE 'Somebody Else' END AS first, CASE p.fight_id % 5 WHEN 0 THEN {_B} WHEN 1 THEN {_R} WHEN 2 THEN {_B} WHEN 3 THEN {_RS} ELSE {_B} END AS second FROM pr p JOIN fighters r ON r.fighter_id = red_id JOIN fighters b ON b.fighter_id = blue_id)",
    f"n AS (SELECT fight_id, ts, {_NORM.format('red')} AS red, {_NORM.format('blue')} AS blue, {_NORM.format('first')} AS f, {_NORM.format('second')} AS s FROM n0)",
    f"y AS (SELECT q.fight_id AS quote_id, b.fight_id, abs(epoch_us(q.ts + INTERVAL 1 HOUR) - epoch_us(b.ts)) AS away, CASE WHEN {_M.format('q.f', 'b.red')} AND {_M.format('q.s', 'b.blue')} THEN CAST(q.f = b.red AS INTEGER) + CAST(q.s = b.blue AS INTEGER) END AS as_is, CASE WHEN {_M.format('q.f', 'b.blue')} AND {_M.format('q.s', 'b.red')} THEN CAST(q.f = b.blue AS INTEGER) + CAST(q.s = b.red AS INTEGER) END AS turned FROM n q JOIN n b ON least({_LAST.format('q.f')}, {_LAST.format('q.s')}) = least({_LAST.format('b.red')}, {_LAST.format('b.blue')}) AND greatest({_LAST.format('q.f')}, {_LAST.format('q.s')}) = greatest({_LAST.format('b.red')}, {_LAST.format('b.blue')}))",
    "z AS (SELECT quote_id, fight_id, coalesce(turned > coalesce(as_is, -1), false) AS swapped, greatest(coalesce(as_is, -1), coalesce(turned, -1)) AS equal_names FROM y WHERE as_is IS NOT NULL OR turned IS NOT NULL QUALIFY row_number() OVER (PARTITION BY quote_id ORDER BY greatest(coalesce(as_is, -1), coalesce(turned, -1)) DESC, away, coalesce(turned > coalesce(as_is, -1), false), fight_id) = 1)",
)


def unaccented_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities' names in lower case without accents, of any script."""
    return adapter.fighters(spark, sf_dir).select("fighter_id", text.unaccented(F.concat_ws(" ", "first_name", "last_name")).alias("name"))


QUERIES = {"quote_links": quote_links, "unaccented_names": unaccented_names}
ORACLES = {"quote_links": LINKS_SQL, "unaccented_names": oracle("SELECT fighter_id, lower(strip_accents(first_name || ' ' || last_name)) AS name FROM fighters")}
