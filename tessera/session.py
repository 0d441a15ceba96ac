"""Sessions, and the folder for checkpoints."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

from .errors import ConfigError


def session(app: str = "tessera", **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; anything else by conf, with dots written as double underscores."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own where spark.checkpoint.dir is unset."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ConfigError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="tessera-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage, in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def cpus() -> int:
    return int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
