"""Coordinates inside a chapter: locators, offsets, paragraph arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotweave.functions.text import is_blank

LOCATOR = "struct<chapterIndex:int,blockIndex:int,offset:int>"


def tags(json: Column) -> Column:
    """Label list; null, blank and malformed JSON all give an empty list."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def read_locator(json: Column) -> Column:
    return F.when(~is_blank(json), F.from_json(json, LOCATOR))


def malformed_locator(json: Column) -> Column:
    """True when a non-blank locator text does not parse."""
    parsed = F.from_json(json, LOCATOR, {"mode": "PERMISSIVE"})
    empty = parsed["chapterIndex"].isNull() & parsed["blockIndex"].isNull() & parsed["offset"].isNull()
    return ~is_blank(json) & (parsed.isNull() | (empty & ~json.rlike(r"^\s*\{")))


def write_locator(chapter: Column, block: Column, offset: Column) -> Column:
    return F.to_json(
        F.struct(
            chapter.cast("int").alias("chapterIndex"),
            block.cast("int").alias("blockIndex"),
            offset.cast("int").alias("offset"),
        ),
        {"ignoreNullFields": "false"},
    )


def locator_or_null(chapter: Column, block: Column, offset: Column) -> Column:
    """Locator struct, null when block or offset is missing."""
    return F.when(
        block.isNotNull() & offset.isNotNull(),
        F.struct(chapter.alias("chapterIndex"), block.alias("blockIndex"), offset.alias("offset")),
    )


def locator_to_offset(starts: Column, lengths: Column, block: Column, offset: Column) -> Column:
    """starts[block] + offset; null when block or offset is out of bounds."""
    inside = (
        block.isNotNull()
        & offset.isNotNull()
        & (block >= 0)
        & (block < F.size(starts))
        & (offset >= 0)
        & (offset <= F.get(lengths, block))
    )
    return F.when(inside, F.get(starts, block) + offset)


def block_of_offset(starts: Column, lengths: Column, at: Column) -> Column:
    """First block that ends after ``at``; the last block at the end of the chapter."""
    ends = F.zip_with(starts, lengths, lambda s, n: s + n)
    hit = F.array_position(F.transform(ends, lambda e: at < e), True) - F.lit(1)
    return F.when(hit >= 0, hit).otherwise(F.size(starts) - F.lit(1)).cast("int")


def offset_to_locator(chapter: Column, starts: Column, lengths: Column, total: Column, at: Column) -> Column:
    """Locator struct; null when ``at`` is outside [0, total]."""
    block = block_of_offset(starts, lengths, at)
    return F.when(
        (at >= 0) & (at <= total),
        F.struct(
            chapter.alias("chapterIndex"),
            block.alias("blockIndex"),
            F.least(at - F.get(starts, block), F.get(lengths, block)).cast("int").alias("offset"),
        ),
    )


def total_code_points(total: Column, starts: Column, lengths: Column) -> Column:
    """Stored total, else the end of the last block; null when the arrays disagree."""
    usable = (F.size(starts) > 0) & (F.size(starts) == F.size(lengths))
    return F.when(usable, F.coalesce(total, F.element_at(starts, -1) + F.element_at(lengths, -1)))
