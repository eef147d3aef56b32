"""Partitioning for steps whose cost is not their bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitioning that adaptive execution keeps at the session's partition count.

    Coalescing goes by bytes; a few megabytes of metadata can be minutes of Python.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys)


def in_portions(df: DataFrame, weight: int, per_task: int, *keys: str) -> DataFrame:
    """Hash partitioning of ``df``, of ``weight`` rows or entries, into parts of about ``per_task`` of them.

    Coalescing goes by compressed bytes; rows that shrink well would outgrow a task's memory in
    parts of that size, and its sorts and hash maps would spill. Smaller frames are dealt to the
    cores, and what one task can do at once is left to adaptive execution. Where two such frames
    join, Spark makes no fewer parts than the session's partition count.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-weight // per_task), min(cores, -(-weight * 20 // per_task)))
    return df.repartition(parts, *keys) if parts > 1 else df.repartition(*keys)
