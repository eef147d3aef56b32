"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.session import shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path that nothing uses yet, in the folder that all executors share."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    Cuts the lineage: a lost executor costs nothing upstream, and the optimizer knows the
    size of what was written, so it broadcasts it only when it is small.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, base: str) -> str:
    """``base``, or ``base`` with underscores until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def text_of(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def whole_id(name: str, flag: str = "no_id") -> list[Column]:
    """An id column and whether it is null, for Python.

    A null in a batch would turn its 64-bit ids into doubles, which hold 53 bits.
    """
    held = F.col(name).cast("long")
    return [F.coalesce(held, F.lit(0).cast("long")).alias(name), held.isNull().alias(flag)]


def nullable(ids: Iterable[int], none: Iterable[bool]) -> pd.arrays.IntegerArray:
    """What `whole_id` took apart, for a column of a pandas frame."""
    return pd.arrays.IntegerArray(np.array(ids, np.int64), np.array(none, bool))


def returned(batches: Iterator) -> Iterator:
    """The batches of a task; what was freed since the last one goes back to the system.

    A Python worker serves many tasks. Arrow and the C library would keep freed memory for
    later ones, about as much again as a task needs, while the executor's heap grows.
    """
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        if trim:
            trim(0)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number for each row, so that repeated rows can be told apart; stored.

    How a scan is split, and with it the number, changes when an executor is lost or joins
    between two jobs. So rows are numbered once, and later steps read the stored number;
    a second scan must not be numbered.
    """
    return stored(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def without_places(rows: DataFrame, places: DataFrame, name: str) -> DataFrame:
    """``rows`` (`numbered` by ``name``) less those whose number is in ``places``, a column ``place``; without ``name``."""
    return rows.join(places.select(F.col("place").alias(name)), name, "left_anti").drop(name)
