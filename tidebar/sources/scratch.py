"""Shared scratch location for written tables and checkpoints."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Where it is unset a temporary folder serves a session on one machine; a cluster is refused,
    since each executor would write to its own disk."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/tidebar-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write once to the shared folder and read back: cut lineage that survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.parquet(path).select(*df.columns)


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def drop(*frames: DataFrame) -> None:
    """Remove written tables that no later plan reads."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            fs, p = _file_system(df.sparkSession, folder)
            fs.delete(p, True)
