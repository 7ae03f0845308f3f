"""Landed documents: links of pages, and JSON quotes of several bookmakers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.functions.odds import implied, parse, vig_free
from duelframe.sources import adapter
from duelframe.sources.adapter import oracle

H2H = "struct<id:bigint,bookmakers:array<struct<key:string,markets:array<struct<key:string,outcomes:array<struct<name:string,price:int>>>>>>>"
METHODS = "struct<id:bigint,link:string,groups:array<struct<markets:array<struct<description:string,outcomes:array<struct<description:string,american:string>>>>>>>"
PREFERRED = ("book1", "book2")


#: A link's target: in either kind of quotes or in none, wherever the attribute stands.
_ANCHOR, _HREF = r"<[aA]\s[^>]*>", r"""[hH][rR][eE][fF]\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every page with how often each occurs."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    links = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(f"({_ANCHOR})"), F.lit(1))).alias("a"))
    links = links.where(F.col("a").rlike(_HREF)).select("page_id", F.concat(*[F.regexp_extract("a", _HREF, i) for i in (1, 2, 3)]).alias("link"))
    return links.groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


_H = _HREF.replace("'", "''")
LINKS_SQL = f"SELECT page_id, regexp_extract(a, '{_H}', 1) || regexp_extract(a, '{_H}', 2) || regexp_extract(a, '{_H}', 3) AS link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '{_ANCHOR}')) AS a FROM pages) WHERE regexp_matches(a, '{_H}') GROUP BY 1, 2"


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"))


TITLES_SQL = "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host FROM pages"


def h2h_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes as landed JSON documents, one for each bout."""
    q = adapter.quotes(spark, sf_dir)
    outcome = lambda n, c: F.struct(F.lit(n).alias("name"), F.col(c).alias("price"))
    market = F.struct(F.lit("h2h").alias("key"), F.array(outcome("red", "red_odds"), outcome("blue", "blue_odds")).alias("outcomes"))
    docs = q.groupBy("fight_id").agg(F.array_sort(F.collect_list(F.struct(F.col("bookmaker").alias("key"), F.array(market).alias("markets")))).alias("bookmakers"))
    return docs.select(F.to_json(F.struct(F.col("fight_id").alias("id"), "bookmakers")).alias("doc"))


def h2h_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the documents: the first preferred bookmaker's head-to-head market, else the first one's."""
    d = h2h_json(spark, sf_dir).select(F.from_json("doc", H2H).alias("d")).select("d.*")
    chosen = F.coalesce(F.get(F.filter("bookmakers", lambda b: b["key"].isin(*PREFERRED)), F.lit(0)), F.get("bookmakers", F.lit(0)))
    market = F.get(F.filter(F.col("b.markets"), lambda m: m["key"] == "h2h"), F.lit(0))
    price = lambda n: F.get(F.filter(F.col("m.outcomes"), lambda o: o["name"] == n), F.lit(0))["price"]
    x = d.withColumn("b", chosen).withColumn("m", market).select(F.col("id").alias("fight_id"), F.col("b.key").alias("bookmaker"), price("red").alias("red_odds"), price("blue").alias("blue_odds"))
    return x.withColumn("red_fair", vig_free(implied("red_odds"), implied("blue_odds")))


H2H_SQL = oracle("SELECT fight_id, bookmaker, red_odds, blue_odds, red_implied / (red_implied + blue_implied) AS red_fair FROM quotes WHERE bookmaker = 'book1'")


def live_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the documents: every bookmaker's prices, not only the preferred one's."""
    d = h2h_json(spark, sf_dir).select(F.from_json("doc", H2H).alias("d")).select("d.*")
    b = d.select(F.col("id").alias("fight_id"), F.explode("bookmakers").alias("b"))
    m = b.select("fight_id", F.col("b.key").alias("bookmaker"), F.get(F.filter("b.markets", lambda m: m["key"] == "h2h"), F.lit(0)).alias("m")).where("m IS NOT NULL")
    price = lambda n: F.get(F.filter(F.col("m.outcomes"), lambda o: o["name"] == n), F.lit(0))["price"]
    return m.select("fight_id", "bookmaker", price("red").alias("red_odds"), price("blue").alias("blue_odds"))


def fair_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each side's three method prices without the margin: only where all three are there."""
    p = method_prices(spark, sf_dir)
    q = {c: implied(f"red_{c}") for c in ("ko", "sub", "dec")}
    return p.select("fight_id", *[F.round(vig_free(q[c], *[q[o] for o in q if o != c]), 9).alias(f"red_{c}_prob") for c in q])


def method_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested method markets flattened to a price for each side and class: three explodes and one
    conditional aggregation; documents of other leagues and without a KO price are left out."""
    b = adapter.bouts(spark, sf_dir)
    f = F.col("fight_id")
    one = lambda who, how, n: F.struct(F.concat(F.lit(f"{who} by {how}")).alias("description"), F.when((f + n) % 9 == 0, "EVEN").otherwise(F.concat(F.lit("+"), (150 + (f * n) % 400).cast("string"))).alias("american"))
    outcomes = F.array(*[one(w, h, i + 1) for i, (w, h) in enumerate((w, h) for w in ("red", "blue") for h in ("KO", "Submission", "Decision"))])
    doc = F.struct(f.alias("id"), F.when(f % 5 == 0, "/other/x").otherwise("/league/x").alias("link"), F.array(F.struct(F.array(F.struct(F.lit("Method").alias("description"), outcomes.alias("outcomes"))).alias("markets"))).alias("groups"))
    d = b.select(F.to_json(doc).alias("doc")).select(F.from_json("doc", METHODS).alias("d")).select("d.*").where(F.col("link").startswith("/league/"))
    o = d.select("id", F.explode("groups").alias("g")).select("id", F.explode("g.markets").alias("m")).select("id", F.explode("m.outcomes").alias("o")).select("id", "o.description", parse("o.american").alias("price"))
    has = lambda who, how: F.col("description").startswith(who) & F.lower("description").contains(how)
    cols = [F.max(F.when(has(w, h), F.col("price"))).alias(f"{w}_{h[:3]}") for w in ("red", "blue") for h in ("ko", "sub", "dec")]
    return o.groupBy(F.col("id").alias("fight_id")).agg(*cols).where("red_ko IS NOT NULL OR blue_ko IS NOT NULL")


METHOD_SQL = oracle("SELECT fight_id, " + ", ".join(f"CAST(CASE WHEN (fight_id + {i}) % 9 = 0 THEN 100 ELSE 150 + (fight_id * {i}) % 400 END AS INTEGER) AS {w}_{h}" for i, (w, h) in enumerate(((w, h) for w in ("red", "blue") for h in ("ko", "sub", "dec")), 1)) + " FROM pr WHERE fight_id % 5 <> 0")

_IMP = "CASE WHEN red_{0} > 0 THEN 100.0::DOUBLE / (red_{0} + 100) ELSE abs(red_{0})::DOUBLE / (abs(red_{0}) + 100) END"
FAIR_SQL = oracle("SELECT fight_id, " + ", ".join(f"round({_IMP.format(c)} / ({' + '.join(_IMP.format(o) for o in ('ko', 'sub', 'dec'))}), 9) AS red_{c}_prob" for c in ("ko", "sub", "dec")) + " FROM m", "m AS (SELECT fight_id, " + ", ".join(f"CAST(CASE WHEN (fight_id + {i}) % 9 = 0 THEN 100 ELSE 150 + (fight_id * {i}) % 400 END AS INTEGER) AS red_{h}" for i, h in enumerate(("ko", "sub", "dec"), 1)) + " FROM pr WHERE fight_id % 5 <> 0)")
LIVE_SQL = oracle("SELECT fight_id, bookmaker, red_odds, blue_odds FROM quotes")

QUERIES = {f.__name__: f for f in (page_links, page_titles, h2h_quotes, live_quotes, method_prices, fair_methods)}
ORACLES = {"page_links": LINKS_SQL, "page_titles": TITLES_SQL, "h2h_quotes": H2H_SQL, "method_prices": METHOD_SQL, "live_quotes": LIVE_SQL, "fair_methods": FAIR_SQL}
