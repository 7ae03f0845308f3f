"""Column functions on hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from duelframe.functions import odds, text


def one(spark, schema, rows, col):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_texts(spark):
    x = F.col("x")
    assert one(spark, "x string", [("5' 11\"",), ("--",), ("",), (None,)], text.inches(x)) == [71.0, None, None, None]
    assert one(spark, "x string", [("4:35",), ("4:xx",), ("4",), (None,)], text.seconds(x)) == [275, 0, 0, 0]
    assert one(spark, "x string", [("30 of 92",), ("---",)], text.of_pair(x, 2)) == [92, 0]
    assert one(spark, "x string", [("5-5-5",), ("5-5-5-5-5",)], text.rounds_before(x, F.lit(3))) == [600, 600]
    assert one(spark, "x string", [("  a \n b ",)], text.collapse(x)) == ["a b"]


@pytest.mark.parametrize(
    "name,division",
    [("Women's Featherweight Title Bout", "w_bantamweight"), ("Light Heavyweight Bout", "light_heavyweight"), ("Catch Weight Bout", "unknown"), (None, "unknown"), ("Strawweight Bout", "strawweight")],
)
def test_division(spark, name, division):
    assert one(spark, "x string", [(name,)], text.division(F.col("x"))) == [division]


def test_methods(spark):
    rows = [("KO/TKO",), ("TKO - Doctor's Stoppage",), ("DQ",), ("Decision - Split",), ("Overturned",), (None,)]
    assert one(spark, "x string", rows, text.method_class(F.col("x"))) == ["ko", "ko", None, "dec", None, None]
    assert one(spark, "x string", rows, text.method_category(F.col("x"), F.lit(3)))[:1] == ["late_finish"]


def test_odds(spark):
    x = F.col("x")
    assert one(spark, "x int", [(150,), (-150,)], odds.implied(x)) == pytest.approx([0.4, 0.6])
    assert one(spark, "x int", [(150,), (-200,)], odds.decimal(x)) == pytest.approx([2.5, 1.5])
    assert one(spark, "x string", [("EVEN",), ("+265",), ("-110",), ("x",)], odds.parse(x)) == [100, 265, -110, None]
    assert one(spark, "x double", [(0.6,)], odds.vig_free(x, F.lit(0.6))) == pytest.approx([0.5])


def test_text_cases(spark):
    from pyspark.sql import functions as F

    from duelframe.functions import text

    rows = [("5-5-5", 3, "4:35", "José Müller-Ortega ", "\U0001f1ec\U0001f1ea \U0001f1ea\U0001f1f8"), ("5-5-5-5-5", 1, "4:xx", "Žižka", "\U0001f1fa"), ("", 2, "4", None, ""), (None, 1, None, "a  b", None)]
    df = spark.createDataFrame(rows, "f string, r int, c string, n string, flag string")
    got = df.select(text.elapsed(F.col("f"), F.col("r"), F.col("c")), text.most_seconds(F.col("f")), text.scheduled_rounds(F.col("f")), text.is_long(F.col("f")), text.slug(F.col("n")), text.flag_country(F.col("flag"))).collect()
    assert [tuple(r) for r in got[:2]] == [(875, 900, 3, False, "jose-muller-ortega", "GE"), (0, 1500, 5, True, "zizka", None)]
    assert got[2][2] is None and got[3][3] is False and got[3][4] == "a-b"


def test_package_ships_as_a_zip(tmp_path):
    import zipfile

    from duelframe.session import zipped

    names = zipfile.ZipFile(zipped(str(tmp_path))).namelist()
    assert "duelframe/__init__.py" in names and "duelframe/operators/ratings.py" in names
