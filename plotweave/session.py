"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Joins feed aggregations nearly everywhere here; without this AQE leaves a
    # skewed join alone whenever splitting it would cost one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else built."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and bench.py."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("plotweave")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PLOTWEAVE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    spark = tune(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's spark.checkpoint.dir.

    Only when the cluster names none (tests, local runs) is a temporary folder used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(spark, "_plotweave_folder", None)
    if made is None:
        made = tempfile.mkdtemp(prefix="plotweave-")
        spark._plotweave_folder = made
    return made


def cut(df: DataFrame, rows: int = 0) -> DataFrame:
    """Write a DataFrame to a table in the shared folder and go on from there.

    Used where several branches would repeat an expensive step. Unlike a cache it
    survives lost executors without recomputing, and unlike an RDD checkpoint it stays
    columnar, so each branch reads only the columns it needs. No file gets more than ``rows``:
    fewer small files than large ones go to a task, which then can move its rows from memory.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
