"""The SQL guard at any depth, table swaps that fail half-way, and pages parsed by SQL."""

import pytest

from duelframe.plans import sql
from duelframe.sources import records, sinks

from .conftest import SF

REFLECT = "reflect('java.lang.System', 'getProperty', 'user.dir')"
PLACES = (
    "SELECT {}", "SELECT upper(concat({}, 'x'))", "SELECT 1 WHERE {} IS NOT NULL", "SELECT * FROM (SELECT {} AS x) t", "WITH c AS (SELECT {} AS x) SELECT * FROM c",
    "SELECT (SELECT {}) AS x", "SELECT 1 WHERE EXISTS (SELECT 1 WHERE {} = 'a')", "SELECT 1 WHERE 'a' IN (SELECT {})", "SELECT transform(array(1), y -> {}) AS x", "SELECT 1 ORDER BY {}",
    "SELECT n_name, count(*) OVER (PARTITION BY {}) AS n FROM nation", "SELECT a.n_name FROM nation a JOIN nation b ON a.n_name = {}", "SELECT count(*) FROM nation GROUP BY {}", "SELECT count(*) FROM nation GROUP BY n_name HAVING max({}) = 'x'",
    "SELECT * FROM explode(array({})) AS t(x)", "SELECT x FROM nation LATERAL VIEW explode(array({})) t AS x", "SELECT 1 UNION ALL SELECT {}", "SELECT CASE WHEN {} = 'a' THEN 1 END AS x", "VALUES ({})", "SELECT * FROM nation PIVOT (max({}) FOR n_regionkey IN (1, 2))",
)


@pytest.fixture(scope="module")
def tables(spark):
    sql.register(spark, SF, ("nation", "region"))
    return spark


@pytest.mark.parametrize("place", PLACES)
def test_methods_of_classes_are_refused_everywhere(tables, place):
    for call in (REFLECT, REFLECT.replace("reflect", "java_method", 1), REFLECT.replace("reflect", "TRY_REFLECT", 1)):
        assert "reflect" in (why := sql.fault(tables, place.format(call)) or "") or "java_method" in why
        with pytest.raises(ValueError):
            sql.query(tables, place.format(call))


def test_other_functions_are_refused(tables):
    tables.udf.register("mine", lambda x: x)
    for bad in ("SELECT mine(1)", "SELECT input_file_name() FROM nation", "SELECT * FROM read_files('x')", "SELECT a.b.c(1)", "SELECT nothing_of_this_name(1)"):
        with pytest.raises(ValueError):
            sql.query(tables, bad)


def test_queries_run(tables):
    good = {
        "SELECT 'reflect(1)' AS x": 1, "SELECT n_name, row_number() OVER (ORDER BY n_name) AS n FROM nation": 25, "WITH c AS (SELECT * FROM nation) SELECT count(*) AS n FROM c JOIN region ON n_regionkey = r_regionkey": 1,
        "SELECT id FROM range(7)": 7, "SELECT x FROM nation LATERAL VIEW explode(array(1, 2)) t AS x": 50, "SELECT transform(array(1, 2), y -> y + 1) AS x": 1, "SELECT r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey < 3)": None,
    }
    for statement, n in good.items():
        got = sql.query(tables, statement).count()
        assert n is None and got > 0 or got == n


def test_the_session_keeps_its_settings(tables):
    before = tables.conf.get("spark.sql.runSQLOnFiles")
    assert len(sql.query(tables, "SELECT * FROM nation").collect()) == 25
    assert tables.conf.get("spark.sql.runSQLOnFiles") == before == "true"
    assert tables.sql(f"SELECT * FROM parquet.`{SF}/nation.parquet`").count() == 25


@pytest.mark.parametrize("fails_at", [1, 2])
def test_a_swap_that_fails_leaves_the_old_table(spark, tmp_path, monkeypatch, fails_at):
    path = f"file:{tmp_path}/t"
    sinks.replace_table(spark.range(3), path)
    rename, calls = sinks._rename, []

    def failing(fs, a, b):
        calls.append(a)
        return False if len(calls) == fails_at else rename(fs, a, b)

    monkeypatch.setattr(sinks, "_rename", failing)
    with pytest.raises(OSError):
        sinks.replace_table(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    monkeypatch.setattr(sinks, "_rename", rename)
    sinks.replace_table(spark.read.parquet(path).union(spark.range(1)), path)
    assert spark.read.parquet(path).count() == 4


def test_sql_parses_pages_as_the_data_frame_does(spark):
    pages = records.pages_of_bouts(spark, SF).where("url LIKE '%1'").union(spark.createDataFrame([("http://x/none", None), (None, "<p>no bout</p>")], "url string, html string"))
    records.register_bout_rows(spark)
    got = spark.sql("SELECT r.* FROM {p} p, LATERAL bout_rows(p.url, p.html) r", p=pages)
    want = records.parse_bouts(pages)
    assert got.columns == want.columns and want.count() > 50 and got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


def test_pages_are_parsed_in_all_partitions(spark):
    assert records.parse_bouts(records.pages_of_bouts(spark, SF)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_profile_images(spark):
    from pyspark.sql import functions as F

    cases = {
        "<img class=hero-profile__image src=/a.png>": "http://x/a.png", '<IMG SRC="https://y/a.png" class="x hero-profile__image y">': "https://y/a.png", "<img src='/l.png'><img class='hero-profile__image' src='/a.png'><img class='hero-profile__image' src='/b.png'>": "http://x/a.png",
        "<img class='hero-profile__image'><div id='block-mainpagecontent'><img src='/m.png'></div>": None, "<img src='/l.png'><section id=\"block-mainpagecontent\"><p><img src='/m.png?a=1&amp;b=2'></p></section>": "http://x/m.png?a=1&b=2",
        "<img src='/l.png'>": None, "": None, "<div id='block-mainpagecontent-2x'></div>": None,
    }
    got = {r.html: r.x for r in spark.createDataFrame([(h,) for h in cases], "html string").select("html", records.profile_image(F.col("html")).alias("x")).collect()}
    assert got == cases
