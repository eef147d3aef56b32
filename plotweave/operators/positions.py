"""From reader positions to events, prefixes and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.functions import coords
from plotweave.operators.graph import chapter_last, edge_facts, node_touches, stat_facts
from plotweave.plans.dyadic import blocks, last_position, prefix_aggregate
from plotweave.plans.intervals import stab, stab_min
from plotweave.plans.scan import as_of
from plotweave.session import cut

CHAPTER = ["book_id", "chapter_idx"]
# Rows of a file: a task reads some tens of them.
TOUCHES = 100_000


def containing_event(positions: DataFrame, events: DataFrame) -> DataFrame:
    """Per distinct position, the lowest-index event with start <= at < end."""
    spans = events.select(*CHAPTER, "start_txt", "end_txt", F.struct("idx", "id").alias("hit"))
    return stab_min(positions, spans, CHAPTER, "at", "hit", "start_txt", "end_txt")


def started_event(positions: DataFrame, events: DataFrame) -> DataFrame:
    """Per distinct position, the highest-index event that starts at or before it."""
    marks = events.select(*CHAPTER, F.col("start_txt").alias("at"), F.struct("idx", "id").alias("hit"))
    return as_of(positions, marks, CHAPTER, "at", "hit")


def event_at(positions: DataFrame, events: DataFrame) -> DataFrame:
    """The event a position belongs to: the one that holds it, else the last one begun."""
    asked = positions.select(*CHAPTER, "at").distinct()
    inside = containing_event(positions, events).withColumnRenamed("hit", "_inside")
    begun = started_event(positions, events).withColumnRenamed("hit", "_begun")
    return (
        asked.join(inside, [*CHAPTER, "at"], "left")
        .join(begun, [*CHAPTER, "at"], "left")
        .withColumn("_hit", F.coalesce("_inside", "_begun"))
        .select(*CHAPTER, "at", F.col("_hit.id").alias("event_row"), F.col("_hit.idx").alias("event_idx"))
    )


def prefix_events(positions: DataFrame, events: DataFrame) -> DataFrame:
    """Events that make up the prefix snapshot of each distinct position.

    The last event of every earlier chapter, plus the highest-index event of the
    current chapter that has begun. Earlier chapters depend on the chapter alone, so
    they are resolved once per (book, chapter) and not once per reader.
    """
    asked = positions.select(*CHAPTER, "at").distinct()
    last = chapter_last(events).select(
        "book_id",
        F.col("id").alias("event_row"),
        (F.col("chapter_idx") + 1).alias("valid_from"),
        F.lit(2**62).alias("valid_until"),
    )
    earlier = stab(
        asked.select(*CHAPTER).distinct(), last, ["book_id"], "chapter_idx", "valid_from", "valid_until"
    ).select(*CHAPTER, "event_row")
    current = started_event(positions, events).select(*CHAPTER, "at", F.col("hit.id").alias("event_row"))
    return asked.join(earlier, CHAPTER, "inner").unionByName(current.filter(F.col("event_row").isNotNull()))


def block_at(offsets: DataFrame, blocks: DataFrame) -> DataFrame:
    """The block of each distinct (chapter, offset) when blocks are rows.

    ``blocks`` has (chapter_id, block_idx, start, length); empty blocks never match.
    At the end of the chapter the last block answers with its own end.
    """
    marks = blocks.filter(F.col("length") > 0).select(
        "chapter_id",
        (F.col("start") + F.col("length")).alias("at"),
        F.struct("block_idx", "start", "length").alias("hit"),
    )
    total = blocks.groupBy("chapter_id").agg(
        F.max(F.struct("block_idx", "start", "length")).alias("_last"),
        F.max(F.col("start") + F.col("length")).alias("_total"),
    )
    asked = offsets.select("chapter_id", "at").distinct()
    found = as_of(asked, marks, ["chapter_id"], "at", "hit", reverse=True)
    block = F.coalesce(F.col("hit"), F.col("_last"))
    return (
        asked.join(found, ["chapter_id", "at"], "left")
        .join(total, "chapter_id", "inner")
        .filter((F.col("at") >= 0) & (F.col("at") <= F.col("_total")))
        .select(
            "chapter_id",
            "at",
            block["block_idx"].alias("block_idx"),
            F.least(F.col("at") - block["start"], block["length"]).alias("offset"),
        )
    )


def locator_offsets(locators: DataFrame, chapters: DataFrame) -> DataFrame:
    """Text offset of each locator row (book_id, chapter_idx, block_idx, offset); null when out of bounds."""
    shape = chapters.select("book_id", F.col("idx").alias("chapter_idx"), "starts", "lengths", "total_code_points")
    return (
        locators.join(shape, CHAPTER, "left")
        .withColumn(
            "start_txt",
            coords.locator_to_offset(F.col("starts"), F.col("lengths"), F.col("block_idx"), F.col("offset")),
        )
        .drop("starts", "lengths", "total_code_points")
    )


def with_meta_fallback(chapters: DataFrame, meta: DataFrame) -> DataFrame:
    """Coordinates from the chapter row, else from the archived metadata."""
    other = meta.select(
        "book_id",
        "idx",
        F.col("starts").alias("_starts"),
        F.col("lengths").alias("_lengths"),
        F.col("total_code_points").alias("_total"),
    )
    own = F.col("starts").isNotNull() & F.col("lengths").isNotNull()
    return (
        chapters.join(other, ["book_id", "idx"], "left")
        .withColumn("total_code_points", F.when(own, F.col("total_code_points")).otherwise(F.col("_total")))
        .withColumn("_own", own)
        .withColumn("starts", F.when(F.col("_own"), F.col("starts")).otherwise(F.col("_starts")))
        .withColumn("lengths", F.when(F.col("_own"), F.col("lengths")).otherwise(F.col("_lengths")))
        .drop("_starts", "_lengths", "_total", "_own")
    )


def event_info(events: DataFrame) -> DataFrame:
    """Event header with start and end locators, null when incomplete."""
    c: Column = F.col("chapter_idx")
    return events.select(
        "id",
        "book_id",
        "chapter_idx",
        F.col("idx").alias("event_idx"),
        "event_id",
        coords.locator_or_null(c, F.col("start_block"), F.col("start_offset")).alias("start_locator"),
        coords.locator_or_null(c, F.col("end_block"), F.col("end_offset")).alias("end_locator"),
        "start_txt",
        "end_txt",
    )


def prefix_blocks(events: DataFrame) -> DataFrame:
    """What the prefix snapshots of a book are put together from: one row per block of chapters.

    Of each chapter only its highest-index event counts. A block holds how many those are,
    the first and last of their ids and the sum of them.
    """
    last = chapter_last(events).select("book_id", "chapter_idx", "id")
    return blocks(
        last,
        ["book_id"],
        "chapter_idx",
        {"events": F.count("id"), "first_id": F.min("id"), "last_id": F.max("id"), "id_sum": F.sum("id")},
        last_position(events, "chapter_idx"),
    )


def prefix_summary(positions: DataFrame, events: DataFrame) -> DataFrame:
    """`prefix_events` of each distinct position, one row each: count, bounds and sum of their ids.

    Earlier chapters come from `prefix_blocks`, as many rows per chapter as its number has
    binary digits; the event begun in the current chapter is added.
    """
    asked = positions.select(*CHAPTER, "at").distinct()
    parts = {"events": F.sum("events"), "first_id": F.min("first_id"), "last_id": F.max("last_id"), "id_sum": F.sum("id_sum")}
    earlier = prefix_aggregate(asked, prefix_blocks(events), ["book_id"], "chapter_idx", parts, last_position(events, "chapter_idx"))
    current = started_event(positions, events).select(*CHAPTER, "at", F.col("hit.id").alias("_id"))
    joined = asked.join(earlier, CHAPTER, "left").join(current, [*CHAPTER, "at"], "left")
    none = F.lit(0).cast("long")
    return joined.select(
        *CHAPTER,
        "at",
        (F.coalesce("events", none) + F.when(F.col("_id").isNotNull(), 1).otherwise(0)).alias("events"),
        F.least("first_id", "_id").alias("first_id"),
        F.greatest("last_id", "_id").alias("last_id"),
        (F.coalesce("id_sum", none) + F.coalesce("_id", none)).alias("id_sum"),
    ).filter("events > 0")


def _chosen(events: DataFrame, begun: DataFrame) -> DataFrame:
    """The events that end a chapter (``closing``) or that a position has begun, each once, with its ``copies``."""
    spot = F.struct("book_id", "chapter_idx", "idx")
    last = chapter_last(events).groupBy("id").agg(F.collect_list(spot).alias("_spots"))
    asked = begun.select(F.col("event_row").alias("id"), F.lit(True).alias("_begun")).distinct()
    once = events.select("id", "book_id", "chapter_idx", "idx", "event_id").repartition("id").groupBy("id", "book_id", "chapter_idx", "idx")
    marked = once.agg(F.min("event_id").alias("event_id"), F.count("*").alias("copies")).join(last, "id", "left").join(asked, "id", "left")
    closing = F.coalesce(F.exists("_spots", lambda s: s.eqNullSafe(spot)), F.lit(False))
    return marked.withColumn("closing", closing).filter("closing OR _begun").drop("_spots", "_begun")


def _merged(first: str, second: str) -> Column:
    """Nodes of two lists, each with a character once: what both name is added up, its weight the newer one."""

    def same(nodes: str, x: Column) -> Column:
        return F.get(F.filter(nodes, lambda y: y["character_id"].eqNullSafe(x["character_id"])), F.lit(0))

    def added(x: Column, y: Column) -> Column:
        return F.struct(
            x["character_id"].alias("character_id"),
            (x["count"] + F.coalesce(y["count"], F.lit(0))).alias("count"),
            F.greatest(x["newest"], y["newest"]).alias("newest"),
        )

    both = F.transform(second, lambda x: added(x, same(first, x)))
    rest = F.filter(first, lambda x: same(second, x).isNull())
    return F.when(F.col(first).isNull(), F.col(second)).when(F.col(second).isNull(), F.col(first)).otherwise(F.concat(both, rest))


def prefix_nodes(positions: DataFrame, events: DataFrame, stats: DataFrame, edges: DataFrame) -> DataFrame:
    """Characters of the graph at each distinct position: newest weight and number of stats.

    The chosen events are those of `prefix_events`. Blocks of chapters hold each character's
    newest weight, so a reader far into a book reads a few rows per character.
    """
    # The chosen events, the prefixes and the answers read this table.
    begun = cut(started_event(positions, events).select(*CHAPTER, "at", F.col("hit.id").alias("event_row")))
    chosen = _chosen(events, begun)
    place = F.struct("chapter_idx", "id")
    weighted = F.col("node_weight").isNotNull()
    # Both the earlier chapters and the current one read this table.
    touches = cut(
        node_touches(stat_facts(stats, chosen), edge_facts(edges, chosen))
        .groupBy("event_id", "book_id", "chapter_idx", "event_idx", "character_id", "closing", "copies")
        .agg(
            F.count("node_weight").alias("count"),
            F.max(F.when(weighted, F.struct(place.alias("place"), "node_weight"))).alias("newest"),
        ),
        TOUCHES,
    )
    combined = {"count": F.sum("count"), "newest": F.max("newest")}
    end = last_position(events, "chapter_idx")
    stored = blocks(touches.filter("closing"), ["book_id", "character_id"], "chapter_idx", combined, end)
    earlier = prefix_aggregate(begun, stored, ["book_id"], "chapter_idx", combined, end, ["character_id"])
    node = F.struct("character_id", "count", "newest")
    of_earlier = earlier.groupBy(*CHAPTER).agg(F.collect_list(node).alias("_earlier"))
    of_event = touches.repartition("event_id").groupBy("event_id", "character_id").agg(
        F.sum(F.col("count") * F.col("copies")).alias("count"), F.max("newest").alias("newest")
    )
    here = of_event.groupBy(F.col("event_id").alias("event_row")).agg(F.collect_list(node).alias("_here"))
    # A position's characters are put together in its row: those of earlier chapters are not moved to it one by one.
    at_once = begun.join(here, "event_row", "left").join(of_earlier, CHAPTER, "left")
    return at_once.select(*CHAPTER, "at", F.explode(_merged("_earlier", "_here")).alias("node")).select(
        *CHAPTER,
        "at",
        "node.character_id",
        F.col("node.newest.node_weight").cast("float").alias("weight"),
        F.nullif(F.col("node.count"), F.lit(0)).cast("int").alias("count"),
    )
