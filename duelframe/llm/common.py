"""Helpers that the training-data operators share."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.session import shared_dir, workers_can_import  # noqa: F401

#: A word, everywhere in this subpackage: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table in the shared folder: lineage ends there, so a lost executor
    costs no recomputation, and readers still prune columns."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop_written(*frames: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_written_at", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def partitions_for(spark: SparkSession, total_bytes: float, each: float) -> int:
    """Partitions of about `each` bytes, at least as many as the session shuffles into."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total_bytes / each))


def let(value: Column, use) -> Column:
    """use(value) with value evaluated once: Catalyst may inline a projected column into a lambda,
    which would then evaluate it for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def whole(text: str | Column) -> Column:
    """The text, empty instead of null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def replacing(df: DataFrame, **cols: Column) -> DataFrame:
    """df with these columns at its end; columns that had these names are replaced."""
    return df.select(*[df[c] for c in df.columns if c.lower() not in {k.lower() for k in cols}], *[v.alias(k) for k, v in cols.items()])
