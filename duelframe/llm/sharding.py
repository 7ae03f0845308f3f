"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within each source and get the fractional rank
(rank + 1/2) / rows of the source; sorted by that rank, every stretch of rows holds the sources in
their overall shares, and cutting the order into equal stretches makes the shards. Law `rows`:
shard sizes differ by one row at most.

No task sorts a whole source or the whole table: rows fall into buckets by the leading bits of
their (uniform) hash or rank, the counts of buckets give each bucket's first rank, and only rows
inside a bucket are sorted.

Cases: a null source is a source of its own; null doc_ids and repeated rows are ordered by a hash that also
covers the columns of `then`, so that they don't meet in one bucket; a null text has size 1; an empty table gives no rows;
columns that have the names of results are replaced, and any other names are free for the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, whole

#: Rows in a bucket, about.
BUCKET_ROWS = 2_000
MOST_BUCKETS = 1_000_000


def _ranked(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """df with the rank from 0 of each row among those with equal keys, in the order of (bucket, *order)."""
    df = df.withColumn("bucket", bucket)
    same = Window.partitionBy(*keys).orderBy("bucket") if keys else Window.orderBy("bucket")  # a row for each bucket
    counts = df.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))
    first = counts.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col("bucket").alias("b"), (F.sum("n").over(same) - F.col("n")).alias("first"))
    inside = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(*order)) - 1
    on = F.col("bucket") == F.col("b")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"k{i}"))
    return df.withColumn("inside", inside).join(first, on).withColumn(name, F.col("first") + F.col("inside")).drop("bucket", "b", "first", "inside", *[f"k{i}" for i in range(len(keys))])


def shard_rows(df: DataFrame, shards: int = 8, source: str = "source", key: str = "doc_id", seed: str = "s1", then: tuple[str, ...] = ()) -> DataFrame:
    """df with shard (int) and slot (long, gapless from 0 in each shard).

    then: further columns that order rows with equal keys. Rows are carried as one column, so that no name
    of theirs is in the way.
    """
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    n = df.count()
    buckets = max(1, min(n // BUCKET_ROWS, MOST_BUCKETS))
    text = lambda c: F.coalesce(df[f"`{c}`"].cast("string"), F.lit(""))
    u = F.md5(F.concat_ws(":", F.lit(seed), *[text(c) for c in (key, *then)]))
    rows = df.select(F.struct(*[df[f"`{c}`"] for c in kept]).alias("row"), df[f"`{source}`"].alias("source"), u.alias("u"))
    spread = F.floor(F.conv(F.substring("u", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32))
    ties = [F.col("u"), *[F.col(f"row.`{x}`") for x in (key, *then)]]
    ranked = _ranked(rows, ["source"], spread, ties, "rank")
    sizes = rows.groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("size"))
    ranked = ranked.join(sizes, F.col("source").eqNullSafe(F.col("s"))).withColumn("part", (F.col("rank") + F.lit(0.5)) / F.col("size")).drop("s", "rank", "size")
    placed = _ranked(ranked, [], F.floor(F.col("part") * buckets).cast("long"), [F.col("part"), F.col("source"), *ties], "at")
    shard = F.floor(F.col("at") * F.lit(shards) / F.lit(max(n, 1))).cast("int")
    # The first place of shard s is the least p with floor(p * shards / n) = s.
    first = F.floor((F.col("shard").cast("long") * F.lit(n) + F.lit(shards - 1)) / F.lit(shards))
    return placed.withColumn("shard", shard).select("row.*", "shard", (F.col("at") - first).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str, shards: int = 8, **how) -> None:
    """The rows of df as Parquet, one folder for each shard, in slot order within each file."""
    placed = shard_rows(df, shards, **how)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = whole("text")
    rows = docs.select("doc_id", "source", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shard_rows(rows, 8, then=("text_crc32",))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _crc_table() -> list[int]:
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


#: A text's crc32 in SQL, byte by byte through its hexadecimal digits.
_CRC = f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, b: xor(c >> 8, ({_crc_table()}::BIGINT[])[(xor(c, b) & 255) + 1])))"""
SHARD_SQL = f"""
WITH c AS (SELECT doc_id, source, text, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size, CAST({_CRC} AS BIGINT) AS crc FROM c),
e AS (SELECT *, md5('s1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || crc) AS u FROM d),
r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY u, doc_id) - 1 + 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS part FROM e),
g AS (SELECT *, row_number() OVER (ORDER BY part, source, u, doc_id) - 1 AS pos, count(*) OVER () AS n FROM r),
s AS (SELECT *, CAST((pos * 8) // n AS INTEGER) AS shard FROM g)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'rows' AS law, shard, CAST(pos - (shard * n + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""
