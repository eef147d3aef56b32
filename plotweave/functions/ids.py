"""Character and event identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotweave.functions.text import optional_text

# Identifiers, with the blanks that are trimmed around them.
EDGE = r"[\x00-\x20]*"
CHARACTER_ID = rf"^{EDGE}(?:[cC]0*)?(\d+){EDGE}$"
EVENT_ID = rf"^{EDGE}ch(\d+)-e(\d+){EDGE}$"
PLAIN_IDX = rf"^{EDGE}([+-]?\d+){EDGE}$"


def character_id(raw: Column) -> Column:
    """Digits, or ``c``-prefixed digits in any case; null means reject."""
    return F.regexp_extract(raw, CHARACTER_ID, 1).try_cast("long")


def event_idx(event_id: Column, chapter_idx: Column) -> Column:
    """Event index from ``ch{c}-e{i}`` of the same chapter, or a plain integer."""
    chapter = F.regexp_extract(event_id, EVENT_ID, 1).try_cast("int")
    named = F.when(chapter == chapter_idx, F.regexp_extract(event_id, EVENT_ID, 2).try_cast("int"))
    return F.coalesce(named, F.regexp_extract(event_id, PLAIN_IDX, 1).try_cast("int"))


def normalized_event_id(event_id: Column, chapter_idx: Column, idx: Column) -> Column:
    clean = optional_text(event_id)
    return F.when(clean.startswith("ch"), clean).otherwise(
        F.concat(F.lit("ch"), chapter_idx.cast("string"), F.lit("-e"), idx.cast("string"))
    )


def strict_event_id(event_id: Column) -> Column:
    """The query form: only ``ch{c}-e{i}`` is accepted; null means reject."""
    clean = optional_text(event_id)
    return F.when(clean.rlike(EVENT_ID), clean)


def direction(from_id: Column, to_id: Column) -> Column:
    return F.concat(from_id.cast("string"), F.lit("->"), to_id.cast("string"))
