"""Validation: rules to reject reasons, then all-or-nothing uploads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions import ids
from plotweave.functions.text import is_blank, optional_text

# Fixed values.
CONTRACT = "relationship-delta-v1"
COLOR = r"^#[0-9A-Fa-f]{6}$"
MEMO_LIMIT = 1000


def reasons(rules: dict[str, Column]) -> Column:
    """Names of the rules that are broken; each column is true when its rule is broken."""
    marks = [F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()]
    return F.filter(F.array(*marks), lambda x: x.isNotNull())


def with_reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return df.withColumn("reasons", reasons(rules))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("times")).filter("times > 1")


def flag_duplicates(df: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Mark rows whose key occurs more than once; a missing key is never a duplicate."""
    marked = duplicates(df.dropna(subset=list(keys)), keys).select(*keys, F.lit(True).alias(flag))
    return df.join(marked, list(keys), "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def flag_repeated(df: DataFrame, near: Sequence[str], keys: Sequence[str], flag: str) -> DataFrame:
    """`flag_duplicates` for rows that are partitioned by ``near`` already: they are counted where they are.

    A key is ``near`` and ``keys`` together; a key with a null in it is never a duplicate.
    """
    whole = [*near, *keys]
    complete = F.lit(True)
    for name in whole:
        complete = complete & F.col(name).isNotNull()
    return df.withColumn(flag, complete & (F.count("*").over(Window.partitionBy(*whole)) > 1))


def flag_unknown(df: DataFrame, known: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Mark rows whose key is not among ``known``."""
    present = known.select(*keys).distinct().withColumn("_known", F.lit(True))
    return df.join(present, list(keys), "left").withColumn(flag, F.col("_known").isNull()).drop("_known")


def split_uploads(rows: DataFrame, upload: Sequence[str] = ("upload_id",)) -> tuple[DataFrame, DataFrame]:
    """(rows of clean uploads, rejected rows): one bad row rejects its whole upload."""
    bad = rows.filter(F.size("reasons") > 0)
    clean = rows.join(bad.select(*upload).distinct(), list(upload), "left_anti")
    return clean.drop("reasons"), bad


# ---------------------------------------------------------------- delta rules


def delta_file_rules() -> dict[str, Column]:
    idx = ids.event_idx(F.col("event_ref"), F.col("chapter_idx"))
    return {
        "DQ-0 malformed": F.col("malformed"),
        "DQ-1 contract": ~F.coalesce(optional_text(F.col("contract_version")) == CONTRACT, F.lit(False)),
        "DQ-10 chapter": F.col("chapter_idx").isNull(),
        "DQ-11 event id": idx.isNull(),
    }


def delta_event_rules() -> dict[str, Column]:
    """Rules of a file that other rows decide: needs event_twice and event_id."""
    return {"DQ-6 event twice": F.col("event_twice"), "DQ-15 event unknown": F.col("event_id").isNull()}


def delta_item_rules(item: Column) -> dict[str, Column]:
    """Rules of one item: a struct of from_id, to_id, labels, positivity and evidence_count."""
    return {
        "DQ-2 positivity": item["positivity"].isNull() | ~item["positivity"].between(-1.0, 1.0),
        "DQ-3 evidence": item["evidence_count"].isNull() | (item["evidence_count"] <= 0),
        "DQ-4 labels": item["labels"].isNull()
        | F.exists(item["labels"], lambda x: F.coalesce(optional_text(x).isNull(), F.lit(True))),
        "DQ-5 same character": item["from_id"] == item["to_id"],
        "character id": item["from_id"].isNull() | item["to_id"].isNull(),
    }


def delta_lookup_rules(unknown: Column) -> dict[str, Column]:
    """Rules of an item that other rows decide: needs edge_twice."""
    return {"DQ-6 edge twice": F.col("edge_twice"), "DQ-15 character unknown": unknown}


def delta_weight_rules(character_id: Column, missing: Column, unknown: Column) -> dict[str, Column]:
    return {
        "DQ-7 weight": missing,
        "character id": character_id.isNull(),
        "DQ-15 character unknown": unknown,
    }


# ------------------------------------------------------------- other payloads


def event_rules(strict: bool = False) -> dict[str, Column]:
    """Needs chapter_known, chapter_ready, has_events, idx, idx_twice, chapter_length, text_blank and text_differs.

    Rules of the file hold without items too; with ``strict`` a chapter has to carry its
    coordinates (starts, lengths, total_code_points) before it takes events.
    """
    item = F.col("item_no").isNotNull()
    start, end = F.col("start_txt"), F.col("end_txt")
    inside = (start >= 0) & (end <= F.col("chapter_length"))
    return {
        "DQ-0 malformed": F.col("malformed"),
        "DQ-10 chapter": F.col("chapter_idx").isNull() | ~F.col("chapter_idx").eqNullSafe(F.coalesce("item_chapter_idx", "chapter_idx")),
        "DQ-15 chapter unknown": ~F.col("chapter_known"),
        **({"FLT-16 not ready": F.col("chapter_known") & ~F.col("chapter_ready")} if strict else {}),
        "DQ-12 has events": F.col("has_events"),
        "DQ-11 event id": item & F.col("idx").isNull(),
        "DQ-11 index twice": F.col("idx_twice"),
        "DQ-8 offsets": item & (start.isNull() | end.isNull() | (start >= end)),
        "text missing": item & F.col("text_blank"),
        "DQ-9 bounds": ~inside,
        "DQ-9 text": inside & (start < end) & F.col("text_differs"),
    }


def roster_rules() -> dict[str, Column]:
    from plotweave.functions.text import description

    return {
        "DQ-14 name": optional_text(F.col("common_name")).isNull(),
        "DQ-14 id": ids.character_id(F.col("character_raw")).isNull(),
        "DQ-14 description": description(F.col("descriptions"), F.col("description_ko")).isNull(),
        "DQ-14 prompt": optional_text(F.col("portrait_prompt")).isNull(),
    }


def summary_rules() -> dict[str, Column]:
    """Needs chapter_known, has_summaries and character_unknown beside the parsed columns."""
    return {
        "DQ-10 chapter": F.col("chapter_idx").isNull(),
        "DQ-13 no items": F.col("item_no").isNull(),
        "DQ-13 id": F.col("item_no").isNotNull() & optional_text(F.col("character_raw")).isNull(),
        "DQ-13 text": F.col("item_no").isNotNull() & optional_text(F.col("summary_text")).isNull(),
        "DQ-15 chapter unknown": ~F.col("chapter_known"),
        "DQ-12 has summaries": F.col("has_summaries"),
        "DQ-15 character unknown": F.col("item_no").isNotNull() & F.col("character_unknown"),
    }


def locator_rules() -> dict[str, Column]:
    """Needs start_txt from ``positions.locator_offsets``."""
    parts = [F.col(c) for c in ("chapter_idx", "block_idx", "offset")]
    some = parts[0].isNotNull() | parts[1].isNotNull() | parts[2].isNotNull()
    whole = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()
    return {"DQ-16 partial": some & ~whole, "DQ-16 bounds": whole & F.col("start_txt").isNull()}


def bookmark_rules() -> dict[str, Column]:
    return {
        "DQ-17 order": F.col("end_txt").isNotNull() & (F.col("start_txt") >= F.col("end_txt")),
        "DQ-17 chapters": F.col("end_chapter_idx").isNotNull() & (F.col("start_chapter_idx") != F.col("end_chapter_idx")),
        "DQ-17 color": F.col("color").isNotNull() & ~F.col("color").rlike(COLOR),
        "DQ-17 memo": F.col("memo").isNotNull() & (F.length("memo") > MEMO_LIMIT),
    }


def slice_rules() -> dict[str, Column]:
    """Needs from_ordinal and to_ordinal beside from_ref and to_ref."""
    one = is_blank(F.col("from_ref")) != is_blank(F.col("to_ref"))
    return {"DQ-18 together": one, "DQ-18 order": F.col("from_ordinal") > F.col("to_ordinal")}
