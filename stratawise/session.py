"""Session settings and table loading."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at any size; parallelism comes from the cluster's own configuration.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.parallelPartitionDiscovery.threshold": "64",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with the library's settings; ``master`` only for local runs."""
    builder = SparkSession.builder.appName("stratawise").config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors' Python workers, once per context."""
    context = spark.sparkContext
    if getattr(context, "_stratawise_shipped", False):
        return
    folder = Path(tempfile.mkdtemp(prefix="stratawise-"))
    home = Path(__file__).resolve().parent
    with zipfile.ZipFile(folder / "stratawise_src.zip", "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    context.addPyFile(str(folder / "stratawise_src.zip"))
    context._stratawise_shipped = True
