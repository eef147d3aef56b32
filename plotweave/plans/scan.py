"""Ordered scans that never sort one whole key in one task.

A plain ``sum().over(partitionBy(book).orderBy(...))`` puts a whole book into one
task, and one book may hold a third of all rows. Here every key is cut into slices
that follow the order. Rows are scanned inside their slice, slices are scanned
inside their key (one small row per slice), and the two parts are combined.

The caller names the slice columns. They must rise with the order, and should be
cut from a column that is unique inside the key (an event index, a text offset), so
that a slice of width w holds at most w rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_WIDTH = 4096

_AGGREGATE = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def slice_of(position: Column, width: int = SLICE_WIDTH) -> Column:
    """The slice of a position column."""
    return F.floor(position / F.lit(width)).cast("long")


def _combine(kind: str, before: Column, inside: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(before.isNull(), inside).when(inside.isNull(), before).otherwise(before + inside)
    return F.least(before, inside) if kind == "min" else F.greatest(before, inside)


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    slices: Sequence[str],
    order: Sequence[str],
    columns: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    following: dict[str, str] | None = None,
) -> DataFrame:
    """Add running aggregates along ``order`` inside ``keys``.

    ``columns`` maps the new column to (sum | count | min | max, expression). With
    ``inclusive=False`` the row itself is left out, so the first row gets null.
    ``following`` maps a new column to an existing one whose value is taken from the
    next row; that column must rise with the order.

    What earlier slices carry over is null for every key that fits in one slice. Those
    rows are dropped before the join, which leaves a handful of rows for the hot keys.
    """
    keys, slices, following = list(keys), list(slices), following or {}
    ordered = Window.partitionBy(*keys, *slices).orderBy(*order)
    inside = ordered.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    by_slice = Window.partitionBy(*keys).orderBy(*slices)
    before = by_slice.rowsBetween(Window.unboundedPreceding, -1)

    scanned = df.withColumns(
        {
            **{f"_in_{name}": _AGGREGATE[kind](expr).over(inside) for name, (kind, expr) in columns.items()},
            **{f"_in_{name}": F.lead(source).over(ordered) for name, source in following.items()},
        }
    )
    totals = df.groupBy(*keys, *slices).agg(
        *[_AGGREGATE[kind](expr).alias(f"_all_{name}") for name, (kind, expr) in columns.items()],
        *[F.min(source).alias(f"_all_{name}") for name, source in following.items()],
    )
    names = [*columns, *following]
    carried = totals.select(
        *keys,
        *slices,
        *[
            (F.sum if kind == "count" else _AGGREGATE[kind])(f"_all_{name}").over(before).alias(f"_pre_{name}")
            for name, (kind, _) in columns.items()
        ],
        *[F.lead(f"_all_{name}").over(by_slice).alias(f"_pre_{name}") for name in following],
    ).filter(" OR ".join(f"_pre_{name} IS NOT NULL" for name in names))
    joined = scanned.join(carried, keys + slices, "left")
    return joined.select(
        *df.columns,
        *[
            _combine(kind, F.col(f"_pre_{name}"), F.col(f"_in_{name}")).alias(name)
            for name, (kind, _) in columns.items()
        ],
        *[F.coalesce(f"_in_{name}", f"_pre_{name}").alias(name) for name in following],
    )


def ordinal(df: DataFrame, keys: Sequence[str], slices: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """1-based position along ``order`` inside ``keys``."""
    return prefix_scan(df, keys, slices, order, {name: ("count", F.lit(1))})


def as_of(
    points: DataFrame,
    markers: DataFrame,
    keys: Sequence[str],
    at: str,
    value: str,
    reverse: bool = False,
    width: int = SLICE_WIDTH,
) -> DataFrame:
    """For every distinct point, the largest ``value`` among markers at or before it.

    With ``reverse=True``: the smallest ``value`` among markers strictly after it.
    Points and markers are first reduced to one row per (keys, at), so a slice holds
    at most ``width`` rows whatever the number of readers or events at one place.
    """
    pick = F.min if reverse else F.max
    marks = markers.select(*keys, at, F.col(value).alias("_value"), F.lit(False).alias("_asked"))
    asks = points.select(*keys, at).distinct().select(
        *keys, at, F.lit(None).cast(markers.schema[value].dataType).alias("_value"), F.lit(True).alias("_asked")
    )
    merged = (
        marks.unionByName(asks)
        .groupBy(*keys, at)
        .agg(pick("_value").alias("_value"), F.max("_asked").alias("_asked"))
        .withColumn("_step", -F.col(at) if reverse else F.col(at))
        .withColumn("_slice", slice_of(F.col("_step"), width))
    )
    kind = "min" if reverse else "max"
    scanned = prefix_scan(
        merged, keys, ["_slice"], ["_step"], {value: (kind, F.col("_value"))}, inclusive=not reverse
    )
    return scanned.filter("_asked").select(*keys, at, value)
