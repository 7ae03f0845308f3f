"""Quotes linked to bouts by pairs of names, and names of any script without accents."""

import datetime as dt
import unicodedata

import pytest
from pyspark.sql import functions as F

from duelframe.functions import text
from duelframe.operators import linking


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


@pytest.mark.parametrize("part", [1, 1000])
def test_pairs_in_either_order(spark, part):
    bouts = [(1, day(0), "Ana Silva", "Bo O'Neill"), (2, day(9), "Bo ONeill", "Ana Silva"), (3, day(5), "Al Silva", "Bo O'Neill"), (4, day(5), "Jo Silva", "Jim Silva"), (5, day(5), "", "Bo O'Neill"), (6, day(5), None, "X"), (7, day(0), "Ana Silva", "Bo O'Neill")]
    quotes = [
        (1, day(1), "Ana Silva", "Bo O'Neill"),  # two bouts, the nearer; of two as near, the least id
        (2, day(8), "Ana Silva", "Bo O'Neill"),  # the nearer, corners swapped
        (3, day(5), "A. Silva", "Bo O'Neill"),  # an initial: three candidates, the nearest
        (4, day(0), "A. Silva", "B. ONeill"),
        (5, day(5), "Jim Silva", "Jo Silva"),  # one surname in both corners: equal names decide
        (6, day(5), "J. Silva", "J. Silva"),  # either way: as it stands
        (7, day(5), "Ana Silva", "Cy O'Neill"), (8, day(5), "", ""), (9, day(5), None, "Bo O'Neill"), (10, None, "Jim Silva", "Jo Silva"),
    ]
    b = spark.createDataFrame(bouts, "fight_id long, ts timestamp, red string, blue string")
    q = spark.createDataFrame(quotes, "quote_id long, at timestamp, first string, second string")
    got = {r.quote_id: (r.fight_id, r.swapped, r.equal_names) for r in linking.linked(q, b, part).collect()}
    none = (None, None, None)
    assert got == {1: (1, False, 2), 2: (2, True, 2), 3: (3, False, 1), 4: (1, False, 0), 5: (4, True, 2), 6: (4, False, 0), 7: none, 8: none, 9: none, 10: (4, True, 2)}


def test_a_frequent_pair_is_split(spark):
    b = spark.range(3000).select(F.col("id").alias("fight_id"), F.timestamp_seconds("id").alias("ts"), F.lit("Ana Silva").alias("red"), F.lit("Bo Cruz").alias("blue"))
    q = spark.range(50).select(F.col("id").alias("quote_id"), F.timestamp_seconds(F.col("id") * 60 + 0.25).alias("at"), F.lit("B. Cruz").alias("first"), F.lit("Ana Silva").alias("second"))
    got = {r.quote_id: (r.fight_id, r.swapped, r.equal_names) for r in linking.linked(q, b, 100).collect()}
    assert got == {i: (60 * i, True, 1) for i in range(50)}


def plain(x):
    return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower().strip()


def test_names_of_all_scripts(spark):
    """Every code point below U+3000, between letters and alone, and texts that mix them."""
    points = [chr(i) for i in range(1, 0x3000)] + ["ﬁ", "Å", "가", "𝒜", "ｈａｌｆ"]
    names = [f"A{c}b" for c in points] + [f" {c}" for c in points] + ["Żółć ﬁx", "İstanbul", "É́", "", None, "\tJosé\n", "José  "]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name string")
    got = {r.id: r.x for r in df.select("id", text.unaccented(F.col("name")).alias("x")).collect()}
    wrong = [(n, got[i]) for i, n in enumerate(names) if got[i] != (None if n is None else plain(n))]
    assert not wrong[:20]


def test_plain_names_stay_in_the_engine(spark):
    df = spark.createDataFrame([("José",), ("Ana",), ("Łukasz",)], "name string")
    sent = df.select(F.count(F.when(~F.col("name").rlike(text._FOLDED), 1)).alias("n")).first().n
    assert sent == 1
