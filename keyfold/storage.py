"""Tables in the shared folder: cuts of lineage, snapshots, and what resumes from them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's folder of spark.checkpoint.dir. Only on a local master, as in tests, one of the machine's own if it
    is unset."""
    sc = spark.sparkContext
    where = sc.getCheckpointDir()
    if where is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir names no folder that executors share")
            where = tempfile.mkdtemp(prefix="keyfold-")
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder, with no lineage before that."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def save(df: DataFrame, path: str) -> None:
    """A snapshot that load() reads back: Parquet, so partitions, types and nulls stay."""
    df.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers n of the complete snapshots path/cp-n, in order."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n[3:]) for n in names if n.startswith("cp-") and n[3:].isdigit() and exists(spark, f"{path}/{n}"))
