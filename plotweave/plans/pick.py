"""One row per key, chosen by an order, as a map-side combined aggregate.

``row_number() == 1`` sorts every key in one task; ``max_by`` over a struct keeps a
single candidate per key and task before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _one(df: DataFrame, keys: Sequence[str], order: Sequence[str], chooser) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    chosen = df.groupBy(*keys).agg(chooser(F.struct(*rest), F.struct(*order)).alias("_row"))
    return chosen.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the highest order per key. The order must be total."""
    return _one(df, keys, order, F.max_by)


def earliest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the lowest order per key. The order must be total."""
    return _one(df, keys, order, F.min_by)


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: str, spread_by: str, ways: int = 64
) -> DataFrame:
    """The first ``limit`` rows per key, with their ``rank``; the limit is a column.

    Each key is first ranked in ``ways`` salted parts. A row beyond the limit in its part
    is beyond it overall, so the second ranking sees ``ways * limit`` rows per key at most.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(ways)))
    in_part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    survivors = salted.withColumn("_part_rank", F.row_number().over(in_part)).filter(F.col("_part_rank") <= F.col(limit))
    in_key = Window.partitionBy(*keys).orderBy(*order)
    return (
        survivors.withColumn("rank", F.row_number().over(in_key))
        .filter(F.col("rank") <= F.col(limit))
        .drop("_salt", "_part_rank")
    )
