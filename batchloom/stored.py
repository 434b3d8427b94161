"""Frames written to the shared folder, so that a plan reads them again instead of computing them twice."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; without the setting, one below the warehouse, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.checkpoints"


def stored(df: DataFrame) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    a, b = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jvm.org.apache.hadoop.fs.Path(to)
    if not a.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).rename(a, b):
        raise OSError(f"{path} could not be moved to {to}")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, sorted; none where there is no folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(f.getPath().getName() for f in files.listStatus(at)) if files.exists(at) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of the driver's in the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(at, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
