"""Point-in-interval joins as equi-joins.

A range predicate inside one (book, chapter) compares every position with every
event. Instead, each half-open interval is written as the few aligned blocks of
size 1, 2, 4, ... that tile it, and each point as the aligned blocks that hold it. A
point lies in an interval exactly when the two share one block, and they share at
most one. Both sides grow by the logarithm of the interval length only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# One level more than the last point needs, as a floating logarithm may fall short.
_LEVELS = "sequence(0, cast(floor(log2(_last)) as int) + 1)"


def tiles(start: str, end: str) -> Column:
    """array<struct<level, tile>> that tiles [start, end) exactly; needs the ``_last`` column."""
    low = f"shiftright({start} + shiftleft(1L, k) - 1, k)"
    high = f"shiftright({end}, k)"
    return F.expr(
        f"""filter(flatten(transform({_LEVELS}, k -> array(
              if({low} < {high} and {low} % 2 = 1, named_struct('level', k, 'tile', {low}), null),
              if({low} < {high} and {high} % 2 = 1, named_struct('level', k, 'tile', {high} - 1), null)
            ))), t -> t is not null)"""
    )


def _after_last(points: DataFrame, at: str) -> Column:
    """One past the largest point: a scalar subquery, one number read at run time."""
    return points.agg(F.greatest(F.max(at).cast("long") + 1, F.lit(1).cast("long"))).scalar()


def with_tiles(intervals: DataFrame, start: str, end: str, points: DataFrame, at: str) -> DataFrame:
    """One row per (interval, tile); empty intervals and those without bounds vanish.

    Open-ended intervals are clipped just after the last point, so their tiles stay few.
    """
    return (
        intervals.filter(F.col(start) < F.col(end))
        .withColumn("_last", _after_last(points, at))
        .withColumns(
            {
                "_start": F.greatest(F.col(start).cast("long"), F.lit(0).cast("long")),
                "_end": F.least(F.col(end).cast("long"), F.col("_last")),
            }
        )
        .filter("_start < _end")
        .withColumn("_tile", F.explode(tiles("_start", "_end")))
        .select(*intervals.columns, F.col("_tile.level").alias("_level"), F.col("_tile.tile").alias("_tile"))
    )


def _longest(intervals: DataFrame, start: str, end: str) -> Column:
    """The longest interval, as a scalar subquery."""
    length = (F.col(end).cast("long") - F.col(start).cast("long"))
    return intervals.agg(F.greatest(F.max(length), F.lit(1).cast("long"))).scalar()


def with_levels(points: DataFrame, at: str, longest: Column | None = None) -> DataFrame:
    """One row per (point, level), up to the level of the longest interval.

    Without ``longest``, the last point bounds the levels: clipped intervals never
    outgrow it.
    """
    last = _after_last(points, at)
    return (
        points.filter(F.col(at) >= 0)
        .withColumn("_last", last if longest is None else F.least(last, longest))
        .withColumn("_at", F.col(at).cast("long"))
        .withColumn("_level", F.explode(F.expr(_LEVELS)))
        .withColumn("_tile", F.expr("shiftright(_at, _level)"))
        .select(*points.columns, "_level", "_tile")
    )


def stab(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    at: str,
    start: str = "start",
    end: str = "end",
) -> DataFrame:
    """All (point, interval) pairs with start <= at < end and equal keys; points are >= 0."""
    left = with_levels(points, at)
    right = with_tiles(intervals, start, end, points, at)
    return left.join(right, [*keys, "_level", "_tile"], "inner").drop("_level", "_tile")


def with_blocks(intervals: DataFrame, start: str, end: str, last: Column, bits: int) -> DataFrame:
    """One row per (interval, block it begins or ends in) and per tile of the blocks between.

    ``last`` is the last point. The bounds become ``_since`` and ``_until``.
    """
    clipped = (
        intervals.filter(F.col(start) < F.col(end))
        .withColumn("_after", last + 1)
        .withColumn("_first", F.shiftright(F.greatest(F.col(start).cast("long"), F.lit(0).cast("long")), bits))
        .withColumn("_final", F.shiftright(F.least(F.col(end).cast("long"), F.col("_after")) - 1, bits))
        .filter((F.col(start) < F.col("_after")) & (F.col(end) > 0))
        .withColumns({"_start": F.col("_first") + 1, "_end": F.col("_final"), "_last": F.shiftright(F.col("_after"), bits) + 1})
    )
    ends = "transform(array_distinct(array(_first, _final)), b -> named_struct('level', -1, 'tile', b))"
    between = F.when(F.col("_start") < F.col("_end"), tiles("_start", "_end")).otherwise(F.expr("array()").cast("array<struct<level:int,tile:bigint>>"))
    names = {start: "_since", end: "_until"}
    return clipped.withColumn("_tile", F.explode(F.concat(F.expr(ends), between))).select(
        *[F.col(c).alias(names.get(c, c)) for c in intervals.columns], F.col("_tile.level").alias("_level"), F.col("_tile.tile").alias("_tile")
    )


def stab_blocks(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    at: str,
    start: str = "start",
    end: str = "end",
    bits: int = 8,
    deal: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """`stab` for wide intervals that are as short as their keys: fewer, uncut rows are moved.

    The smallest tiles are blocks of 2 ** ``bits`` places. The blocks an interval begins and ends
    in get the interval itself, compared place by place there; only the blocks between them are
    tiled. So a key of one block moves each row once, and a point is compared with no more
    intervals than hold it or begin or end in its block. ``deal`` partitions the tiled intervals by
    ``keys``, ``_level`` and ``_tile``, where adaptive execution should not choose the parts.
    """
    last = points.agg(F.coalesce(F.max(at).cast("long"), F.lit(0).cast("long"))).scalar()
    left = (
        points.filter(F.col(at) >= 0)
        .withColumn("_last", F.shiftright(last, bits))
        .withColumn("_block", F.shiftright(F.col(at).cast("long"), bits))
        .withColumn("_level", F.explode(F.expr("if(_last < 2, array(-1), sequence(-1, length(bin(_last)) - 1))")))
        .withColumn("_tile", F.expr("shiftright(_block, greatest(_level, 0))"))
        .select(*points.columns, "_level", "_tile")
    )
    right = with_blocks(intervals, start, end, last, bits)
    right = right if deal is None else deal(right)
    joined = left.join(right, [*keys, "_level", "_tile"], "inner").filter((F.col("_since") <= F.col(at)) & (F.col(at) < F.col("_until")))
    return joined.drop("_level", "_tile").withColumnsRenamed({"_since": start, "_until": end})


def stab_min(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    at: str,
    value: str,
    start: str = "start",
    end: str = "end",
) -> DataFrame:
    """Per distinct point, the smallest ``value`` of the intervals that hold it.

    The intervals are measured first (one more scan of two columns): short events then
    cost a point a handful of levels, however long the text is.
    """
    asked = points.select(*keys, at).distinct()
    best = (
        with_tiles(intervals.select(*keys, start, end, value), start, end, points, at)
        .groupBy(*keys, "_level", "_tile")
        .agg(F.min(value).alias(value))
    )
    return (
        with_levels(asked, at, _longest(intervals, start, end))
        .join(best, [*keys, "_level", "_tile"], "inner")
        .groupBy(*keys, at)
        .agg(F.min(value).alias(value))
    )
