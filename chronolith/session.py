"""Session settings, lineage cutting and scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_roots: dict[str, str] = {}


def build_session(app: str = "chronolith", cpus: int | None = None) -> SparkSession:
    """A session for local runs; on a cluster the submitted configuration wins."""
    cores = cpus or os.cpu_count() or 4
    # Python workers of a local session import the library from here, whatever the working folder
    home = str(Path(__file__).resolve().parents[1])
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([home, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the one the cluster names, a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if sc.applicationId not in _local_roots:
        _local_roots[sc.applicationId] = tempfile.mkdtemp(prefix="chronolith-")
    return _local_roots[sc.applicationId]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once below the shared checkpoint folder and go on from the written table.

    A lost executor costs no recomputation, and the planner sees the true size of what was written.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def cut_and_count(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut_lineage`` together with the number of rows, counted while writing."""
    seen = Observation()
    table = cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return table, seen.get["rows"]


def drop_scratch(table: DataFrame) -> None:
    """Deletes a table that ``cut_lineage`` wrote and nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/chronolith-{label}-{uuid.uuid4().hex}"
