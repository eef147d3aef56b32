"""Nested lists of bounded length.

A response that nests events in a chapter becomes one row per (keys, part); a part
holds at most ``width`` entries because it is cut from an index that is unique
inside the keys. Ordinary groups have part 0 only; nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.plans.scan import SLICE_WIDTH, slice_of


def nested(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    entry: Column,
    name: str,
    first: int = 1,
    width: int = SLICE_WIDTH,
) -> DataFrame:
    """Ordered list of ``entry`` per (keys, part)."""
    return (
        df.withColumn("part", slice_of(F.col(index) - F.lit(first), width))
        .groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("_i"), entry.alias("_e")))).alias("_list"))
        .withColumn(name, F.transform("_list", lambda x: x["_e"]))
        .drop("_list")
    )


def joined(text: Column, separator: str = "|") -> Column:
    """Aggregate over all parts of a key: their texts in order; null if there is none."""
    texts = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(F.col("part"), text.alias("text")))))
    return F.when(F.count(text) > 0, F.array_join(F.transform(texts, lambda p: p["text"]), separator))
