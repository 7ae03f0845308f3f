"""What a session needs before Python workers run code of this library."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


_shipped: set[str] = set()


def workers_can_import(spark: SparkSession) -> None:
    """Let Python workers import the library: functions are pickled by reference, so that caches at module level
    outlive one task.

    Workers of a local master get the library's folder on their path; those of a cluster, which have no such folder, get
    the library itself as a zip file, once for each application. It lies in the shared folder for good, since executors
    fetch it when their first task starts, and new ones later.
    """
    sc = spark.sparkContext
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        have = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
        if ROOT not in have:
            sc.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, have)])
    elif sc.applicationId not in _shipped:
        into = f"{shared_dir(spark)}/code/{sc.applicationId}"
        path, conf = sc._jvm.org.apache.hadoop.fs.Path, sc._jsc.hadoopConfiguration()
        with tempfile.TemporaryDirectory() as at:
            local = path(f"file://{zipped(at)}")
            to = path(f"{into}/duelframe.zip")
            to.getFileSystem(conf).copyFromLocalFile(False, True, local, to)
        sc.addPyFile(f"{into}/duelframe.zip")
        _shipped.add(sc.applicationId)


def zipped(into: str) -> str:
    """The library's modules as a zip file."""
    path = os.path.join(into, "duelframe.zip")
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(Path(ROOT, "duelframe").rglob("*.py")):
            z.write(file, file.relative_to(ROOT))
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where that is unset, on a local
    master as in tests, one of our own is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file:/tmp/checkpoints/duelframe"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: what is read more than once is computed once, and a lost executor
    costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Whether Spark deletes a query's shuffle files when the query has ended, not when the driver happens to collect its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """staged() for tables that nothing reads after the block: they are deleted with it, and the shuffles of each query when it has ended."""
    made: list[str] = []

    def stage(df: DataFrame, name: str) -> DataFrame:
        made.append(new_path(spark, name))
        df.write.parquet(made[-1])
        return spark.read.schema(df.schema).parquet(made[-1])

    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        yield stage
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)
        for p in made:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
