"""Session settings that the engine's semantics rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(app: str = "batchloom", master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; ``more`` uses double underscores for dots (``spark__driver__memory="4g"``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def make_importable(spark: SparkSession, folder: str) -> None:
    """Lets Python workers import the library from ``folder`` when the driver's own path is not theirs."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if folder not in known:
        env["PYTHONPATH"] = os.pathsep.join([folder, *[p for p in known if p]])
