"""Writing tables: replacing them whole or by partition, upserts, derived columns beside a table, appends.

Plain Parquet has no row-level changes, so a change is a rewrite of what it touches: of a whole small table
through a staged folder that takes the old one's place, of a large one by partition.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelframe.session import new_path
from duelframe.sources import adapter
from duelframe.sources.adapter import oracle
from duelframe.streaming.windows import upsert


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _files(spark, path)
    return fs.exists(at)


def replace_table(df: DataFrame, path: str) -> None:
    """df in place of the table: written beside it first, so a failed job leaves the old table. df may read the table itself.

    The old table is moved aside, then the new one in; if that fails, the old one is moved back. Between the two moves there is no
    table under the path, so readers that may come at any moment should retry, or read a path that is never replaced."""
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    staged, old = f"{path}-staged-{mark}", f"{path}-old-{mark}"
    df.write.parquet(staged)
    at, fs = _files(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    moved = fs.exists(at)
    if moved and not _rename(fs, at, hadoop(old)):
        fs.delete(hadoop(staged), True)
        raise OSError(f"{path} can't be moved")
    try:
        done = _rename(fs, hadoop(staged), at)
    except Exception:
        done = False
    if not done:
        if moved and not _rename(fs, hadoop(old), at):
            raise OSError(f"{path} is under {old}: neither the new table nor the old one can be moved there")
        fs.delete(hadoop(staged), True)
        raise OSError(f"{staged} can't be moved to {path}")
    fs.delete(hadoop(old), True)
    spark.catalog.refreshByPath(path)


def _rename(fs, a, b) -> bool:
    return fs.rename(a, b)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Only the partitions that df has rows of are replaced."""
    df.write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def upsert_table(new: DataFrame, path: str, key: str) -> None:
    """Rows of new by natural key over those of the table; nulls don't replace values. The first call makes it."""
    spark = new.sparkSession
    replace_table(upsert(spark.read.parquet(path), new, key) if exists(spark, path) else new, path)


def append(df: DataFrame, path: str, at: Column) -> None:
    """Rows with the time of their writing."""
    df.withColumn("created_at", at).write.mode("append").parquet(path)


def with_derived(table: DataFrame, derived: DataFrame, keys: list[str]) -> DataFrame:
    """A table with columns that are kept in a table of their own."""
    return table.join(derived, keys, "left")


def latest_wins(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row of each natural key, the last in this order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*[o.desc() for o in order]))).where("_r = 1").drop("_r")


def sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables written in each of the ways and read back, as counts and sums."""
    s = adapter.sides(spark, sf_dir).select("fight_id", "fighter_id", "corner", "weight_class", "won")
    b = adapter.bouts(spark, sf_dir).select("fight_id", "winner_id", "method")
    read = lambda p: spark.read.parquet(p)
    # Staged: the second table takes the first one's place and reads it.
    whole = new_path(spark, "sides")
    replace_table(s.where("corner = 'red'"), whole)
    replace_table(read(whole).unionByName(s.where("corner = 'blue'")), whole)
    # By partition: one division's points are written anew.
    parts = new_path(spark, "points")
    points = s.select("fight_id", "weight_class", F.lit(1).alias("points"))
    replace_partitions(points, parts, "weight_class")
    replace_partitions(points.where("weight_class = 'Flyweight Bout'").withColumn("points", F.lit(5)), parts, "weight_class")
    # Late results: bouts land without a winner, results follow, and a null changes nothing.
    late = new_path(spark, "bouts")
    upsert_table(b.withColumns({"winner_id": F.lit(None).cast("long"), "method": F.lit("to come")}), late, "fight_id")
    upsert_table(b.where("fight_id % 2 = 0"), late, "fight_id")
    # Appends.
    log = new_path(spark, "predictions")
    p = adapter.predictions(spark, sf_dir).select("fight_id", "red_prob")
    for part in ("fight_id % 3 = 0", "fight_id % 3 <> 0"):
        append(p.where(part), log, F.lit("2024-02-01").cast("timestamp"))
    # Derived columns apart.
    extra = new_path(spark, "derived")
    replace_table(s.select("fight_id", "fighter_id", (F.col("won") * 2).alias("double_won")).where("fight_id % 2 = 0"), extra)
    joined = with_derived(read(whole), read(extra), ["fight_id", "fighter_id"])
    row = lambda df, name, key, total: df.groupBy(key.alias("key")).agg(F.lit(name).alias("sink"), F.count(F.lit(1)).alias("n"), F.sum(total).cast("double").alias("total")).select("sink", "key", "n", "total")
    none = F.lit("all")
    out = row(read(whole), "replaced", F.col("corner"), F.col("won")).unionByName(row(read(parts), "partitions", F.col("weight_class"), F.col("points"))).unionByName(row(read(late), "upserted", F.coalesce("method", none), (F.col("winner_id").isNotNull()).cast("int")))
    return out.unionByName(row(read(log), "appended", none, F.col("red_prob"))).unionByName(row(joined, "derived", none, F.col("double_won")))


ROUNDTRIP_SQL = oracle("""SELECT 'replaced' AS sink, corner AS key, count(*) AS n, sum(won)::DOUBLE AS total FROM sides GROUP BY 2
UNION ALL SELECT 'partitions', weight_class, count(*), sum(CASE WHEN weight_class = 'Flyweight Bout' THEN 5 ELSE 1 END)::DOUBLE FROM sides GROUP BY 2
UNION ALL SELECT 'upserted', CASE WHEN fight_id % 2 = 0 THEN coalesce(method, 'to come') ELSE 'to come' END, count(*), sum(CASE WHEN fight_id % 2 = 0 AND winner_id IS NOT NULL THEN 1 ELSE 0 END)::DOUBLE FROM pr GROUP BY 2
UNION ALL SELECT 'appended', 'all', count(*), sum(red_prob)::DOUBLE FROM preds
UNION ALL SELECT 'derived', 'all', count(*), sum(CASE WHEN fight_id % 2 = 0 THEN won * 2 END)::DOUBLE FROM sides""")

QUERIES = {"sink_roundtrip": sink_roundtrip}
ORACLES = {"sink_roundtrip": ROUNDTRIP_SQL}
