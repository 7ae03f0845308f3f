"""Searches, pages, semi and anti joins, set operations, counts and grouping sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelframe.functions import text
from duelframe.sources import adapter
from duelframe.sources.adapter import oracle

PAGE, OFFSET = 50, 100


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def search_ilike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring search over several columns, whatever the case."""
    p = _t(spark, sf_dir, "part")
    return p.where(F.col("p_name").ilike("%re%") | F.col("p_brand").ilike("%12%") | F.col("p_type").ilike("%steel%")).select("p_partkey", "p_name", "p_brand", "p_type")


def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(OFFSET).limit(PAGE).select("o_orderkey", "o_totalprice")


def upcoming_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an order of status O (EXISTS), without one of status F (NOT IN)."""
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    key = o.withColumnRenamed("o_custkey", "c_custkey")
    return c.join(key.where("o_orderstatus = 'O'"), "c_custkey", "left_semi").join(key.where("o_orderstatus = 'F'"), "c_custkey", "left_anti").select("c_custkey", "c_name")


def id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and difference of the entities that were ever red and ever blue."""
    b = adapter.bouts(spark, sf_dir)
    red, blue = b.select(F.col("red_id").alias("id")), b.select(F.col("blue_id").alias("id"))
    tag = lambda df, name: df.select(F.lit(name).alias("kind"), "id")
    return tag(red.union(blue).distinct(), "union").unionByName(tag(red.intersect(blue), "intersect")).unionByName(tag(red.where("id % 3 <> 0").distinct().exceptAll(blue.where("id % 2 = 0").distinct()), "except"))


ID_SETS_SQL = oracle("SELECT 'union' AS kind, id FROM (SELECT red_id AS id FROM pr UNION SELECT blue_id FROM pr) UNION ALL SELECT 'intersect', id FROM (SELECT red_id AS id FROM pr INTERSECT SELECT blue_id FROM pr) UNION ALL SELECT 'except', id FROM (SELECT DISTINCT red_id AS id FROM pr WHERE red_id % 3 <> 0 EXCEPT SELECT blue_id FROM pr WHERE blue_id % 2 = 0)")


def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by rollup of flag and status, with the level of grouping (an addition)."""
    li = _t(spark, sf_dir, "lineitem")
    return li.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.grouping_id().alias("level"))


def cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by every combination of segment and nation (an addition)."""
    return _t(spark, sf_dir, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in TABLES:
        one = _t(spark, sf_dir, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def top_k_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five dearest orders of each customer."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return _t(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("o_custkey", "o_orderkey", "o_totalprice", "rank")


def eager_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders outer joined to customer, nation and region, then grouped."""
    n, c, o = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    r = _t(spark, sf_dir, "region")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def first_non_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By entity, each column's newest value that isn't null."""
    s = adapter.sides(spark, sf_dir).withColumn("big", F.when(F.col("kd") > 1, F.col("kd")))
    w = Window.partitionBy("fighter_id").orderBy(F.desc("ts"), F.desc("fight_id"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return s.select("fighter_id", F.first("big", ignorenulls=True).over(whole).alias("big"), F.first("method", ignorenulls=True).over(whole).alias("method"), F.row_number().over(w).alias("_i")).where("_i = 1").drop("_i")


FIRST_SQL = oracle("SELECT fighter_id, arg_max(CASE WHEN kd > 1 THEN kd END, (ts, fight_id)) FILTER (kd > 1) AS big, arg_max(method, (ts, fight_id)) FILTER (method IS NOT NULL) AS method FROM sides GROUP BY fighter_id")


def text_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts built from the parts' numbers and read back by every parser."""
    p = _t(spark, sf_dir, "part")
    n = F.col("p_partkey") + F.col("p_size")
    height = F.when(n % 7 == 0, "--").otherwise(F.concat((n % 3 + 4).cast("string"), F.lit("' "), (n % 12).cast("string"), F.lit('"')))
    clock = F.when(n % 11 == 0, "4:xx").otherwise(F.concat((n % 5).cast("string"), F.lit(":"), F.lpad((n % 60).cast("string"), 2, "0")))
    pair = F.when(n % 13 == 0, "---").otherwise(F.concat((n % 50).cast("string"), F.lit(" of "), (n % 50 + 7).cast("string")))
    x = p.select("p_partkey", height.alias("h"), clock.alias("c"), pair.alias("o"), F.when(n % 2 == 0, "5-5-5").otherwise("5-5-5-5-5").alias("r"), (n % 6).cast("int").alias("fin"), "p_name", "p_type")
    return x.select(
        "p_partkey", text.inches(F.col("h")).alias("inches"), text.seconds(F.col("c")).alias("seconds"), text.of_pair(F.col("o"), 1).alias("landed"), text.of_pair(F.col("o"), 2).alias("attempted"),
        text.rounds_before(F.col("r"), F.col("fin")).alias("before"), text.clock(text.seconds(F.col("c"))).alias("clock"), text.normal_name(F.col("p_name")).alias("name"), text.last_segment(F.concat(F.lit("http://x/"), F.replace("p_type", F.lit(" "), F.lit("/")), F.lit("/"))).alias("segment"),
    )


TEXT_SQL = """
WITH n AS (SELECT *, p_partkey + p_size AS n FROM part), x AS (SELECT p_partkey, n, p_name, p_type, CASE WHEN n % 11 = 0 THEN 0 ELSE (n % 5) * 60 + n % 60 END AS s FROM n)
SELECT p_partkey, CASE WHEN n % 7 <> 0 THEN ((n % 3 + 4) * 12 + n % 12)::DOUBLE END AS inches, CAST(s AS INTEGER) AS seconds, CAST(CASE WHEN n % 13 = 0 THEN 0 ELSE n % 50 END AS INTEGER) AS landed, CAST(CASE WHEN n % 13 = 0 THEN 0 ELSE n % 50 + 7 END AS INTEGER) AS attempted,
CAST(least(greatest(n % 6 - 1, 0), CASE WHEN n % 2 = 0 THEN 3 ELSE 5 END) * 300 AS INTEGER) AS before, (s // 60) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock, trim(replace(replace(replace(lower(p_name), '-', ' '), '.', ''), '''', '')) AS name, list_last(string_split(p_type, ' ')) AS segment FROM x
"""


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Division, method class and category of each bout."""
    b = adapter.bouts(spark, sf_dir)
    return b.select("fight_id", text.division(F.col("weight_class")).alias("division"), text.method_class(F.col("method")).alias("class"), text.method_category(F.col("method"), F.col("finish_round")).alias("category"))


CLASSES_SQL = oracle(
    """SELECT fight_id, CASE weight_class WHEN 'Flyweight Bout' THEN 'flyweight' WHEN 'Bantamweight Bout' THEN 'bantamweight' WHEN 'Featherweight Bout' THEN 'featherweight' WHEN 'Lightweight Title Bout' THEN 'lightweight' WHEN 'Welterweight Bout' THEN 'welterweight' WHEN 'Middleweight Bout' THEN 'middleweight' WHEN 'Light Heavyweight Bout' THEN 'light_heavyweight' ELSE 'w_strawweight' END AS division,
CASE WHEN method = 'KO/TKO' THEN 'ko' WHEN method = 'Submission' THEN 'sub' WHEN method LIKE 'Decision%' THEN 'dec' END AS class,
CASE WHEN method IN ('KO/TKO', 'Submission') THEN CASE WHEN finish_round <= 2 THEN 'early_finish' ELSE 'late_finish' END WHEN method LIKE '%Split%' THEN 'split' WHEN method LIKE '%Majority%' THEN 'majority' WHEN method LIKE '%Unanimous%' THEN 'ud' ELSE 'decision' END AS category FROM pr"""
)


def _as(df: DataFrame, p: str) -> DataFrame:
    n = text.normal_name(F.col("name"))
    return df.select(F.col("id").alias(f"{p}_id"), n.alias(f"{p}_name"), F.element_at(F.split(n, " "), -1).alias("last"), F.substring(n, 1, 1).alias(f"{p}_initial"))


def fuzzy_name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are equal, or have the same last word and first letter: an equi-join on the last
    word with the rest as its condition; exact matches first, then the least id."""
    a = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("A. "), F.translate("c_name", "#", " "), F.lit("-"), (F.col("c_custkey") % 200).cast("string")).alias("name"))
    b = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.when(F.col("s_suppkey") % 2 == 0, "Al ").otherwise("Bo "), F.translate("s_name", "#", " "), F.lit(" "), F.col("s_suppkey").cast("string")).alias("name"))
    j = _as(a, "a").join(_as(b, "b"), "last").where((F.col("a_name") == F.col("b_name")) | (F.col("a_initial") == F.col("b_initial")))
    best = F.row_number().over(Window.partitionBy("a_id").orderBy((F.col("a_name") == F.col("b_name")).desc(), "b_id"))
    return j.withColumn("_r", best).where("_r = 1").select("a_id", "b_id", "last")


_NN = "trim(replace(replace(replace(lower({}), '-', ' '), '.', ''), '''', ''))"
FUZZY_SQL = f"""
WITH a AS (SELECT c_custkey AS a_id, {_NN.format("'A. ' || replace(c_name, '#', ' ') || '-' || (c_custkey % 200)")} AS an FROM customer), b AS (SELECT s_suppkey AS b_id, {_NN.format("CASE WHEN s_suppkey % 2 = 0 THEN 'Al ' ELSE 'Bo ' END || replace(s_name, '#', ' ') || ' ' || s_suppkey")} AS bn FROM supplier)
SELECT a_id, b_id, list_last(string_split(an, ' ')) AS last FROM a JOIN b ON list_last(string_split(an, ' ')) = list_last(string_split(bn, ' ')) AND (an = bn OR an[1] = bn[1]) QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY an = bn DESC, b_id) = 1
"""

QUERIES = {f.__name__: f for f in (search_ilike, paginate, upcoming_events, id_sets, grouping_sets, cube_counts, table_counts, top_k_per_key, eager_joins, first_non_null, text_parsers, classes, fuzzy_name_join)}
ORACLES = {
    "search_ilike": "SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_name ILIKE '%re%' OR p_brand ILIKE '%12%' OR p_type ILIKE '%steel%'",
    "paginate": f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT {PAGE} OFFSET {OFFSET}",
    "upcoming_events": "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "id_sets": ID_SETS_SQL,
    "grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, grouping(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube_counts": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)",
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES),
    "top_k_per_key": "SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5",
    "eager_joins": "SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
    "first_non_null": FIRST_SQL,
    "text_parsers": TEXT_SQL,
    "classes": CLASSES_SQL,
    "fuzzy_name_join": FUZZY_SQL,
}
