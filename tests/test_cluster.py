"""Workers of a cluster, which have no folder of the library, import it from the shared folder."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.checkpoint.dir", "file://" + {shared!r}).config("spark.ui.enabled", "false").config("spark.executor.memory", "512m").config("spark.driver.host", "127.0.0.1").getOrCreate()
from duelframe import session
from duelframe.operators import boosting
session.workers_can_import(spark)
def run(batches):
    import duelframe
    for b in batches:
        yield b.assign(id=[len(duelframe.__file__)] * len(b), at=[duelframe.__file__] * len(b))
print("AT", spark.range(2).mapInPandas(run, "id long, at string").first()["at"])
df = spark.createDataFrame([(float(i), int(i > 5)) for i in range(20)], "a double, y int")
forest = boosting.fit(df, ("a",), "y", 2, boosting.Settings(rounds=1, least=2))
print("TREES", len(forest.trees))
"""


def test_a_cluster_fetches_the_library(tmp_path):
    home, cwd, shared = tmp_path / "home", tmp_path / "cwd", tmp_path / "shared"
    for p in (home / "work", cwd, shared):
        p.mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():  # executors write their logs to work in Spark's home
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT), shared=str(shared))], cwd=cwd, env=env, capture_output=True, text=True, timeout=300)
    said = dict(x.split(" ", 1) for x in out.stdout.splitlines() if x.startswith(("AT", "TREES")))
    assert "duelframe.zip" in said.get("AT", ""), out.stderr[-2000:]
    assert said["TREES"] == "1"
    assert list(shared.glob("code/*/duelframe.zip"))
