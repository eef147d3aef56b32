"""Aggregates over prefixes from stored aggregates of aligned blocks.

The positions of a key are cut into aligned blocks of size 1, 2, 4, ... and each block's
aggregate is stored. A prefix is tiled by at most one block of each size, so whoever asks for
one reads as many rows as the position has binary digits, however long the prefix is.
Aggregates have to combine: sums, minima, maxima, the newest by a total order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = ["level", "tile"]


def last_position(rows: DataFrame, at: str) -> Column:
    """The largest position of all keys: a scalar subquery, one number read at run time."""
    return rows.agg(F.coalesce(F.max(at).cast("long"), F.lit(0).cast("long"))).scalar()


_LEVELS = "sequence(0, length(bin(_last)))"


def blocks(rows: DataFrame, keys: Sequence[str], at: str, reduced: dict[str, Column], last: Column) -> DataFrame:
    """The aggregate of each block that holds a row: (keys, level, tile, …). ``at`` is >= 0.

    ``reduced`` maps a name to an aggregate over ``rows``, ``last`` is `last_position`. Each
    position counts in one block per level; the top level's first block holds a whole key.
    """
    return (
        rows.withColumn("_last", last)
        .withColumn("level", F.explode(F.expr(_LEVELS)))
        .withColumn("tile", F.expr(f"shiftright(cast({at} as long), level)"))
        .groupBy(*keys, *BLOCK)
        .agg(*[c.alias(name) for name, c in reduced.items()])
    )


def cover(points: DataFrame, before: str, last: Column) -> DataFrame:
    """One row per point and block: together the blocks tile the positions 0 to ``before`` - 1.

    Block k of the tiling is there exactly when binary digit k of ``before`` is 1. Positions
    behind ``last`` hold nothing, so a longer prefix ends there.
    """
    return (
        points.withColumn("_last", last)
        .withColumn("_end", F.least(F.col(before).cast("long"), F.col("_last") + 1))
        .filter("_end > 0")
        .withColumn("level", F.explode(F.expr(f"filter({_LEVELS}, k -> shiftright(_end, k) % 2 = 1)")))
        .withColumn("tile", F.expr("shiftright(_end, level) - 1"))
        .drop("_last", "_end")
    )


def prefix_aggregate(
    points: DataFrame, stored: DataFrame, keys: Sequence[str], before: str, combined: dict[str, Column], last: Column, groups: Sequence[str] = ()
) -> DataFrame:
    """Aggregates over all positions below ``before``, per distinct point and ``groups``.

    ``stored`` comes from `blocks` with the keys ``keys`` and ``groups`` and the same ``last``; ``combined``
    maps a name to an aggregate over its columns. Points without any row in their prefix are left out.
    """
    asked = points.select(*keys, before).distinct()
    return (
        cover(asked, before, last)
        .join(stored, [*keys, *BLOCK], "inner")
        .groupBy(*keys, before, *groups)
        .agg(*[c.alias(name) for name, c in combined.items()])
    )
