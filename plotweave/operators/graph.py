"""Relationship graphs folded from per-event deltas.

Events carry (id, book_id, chapter_idx, idx, start_txt, event_id); edges carry the
event's id, the two logical character ids, count, sentiment, tags and explanation;
stats carry the event's id, a character id and a weight.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions.coords import tags
from plotweave.functions.ids import EVENT_ID, direction
from plotweave.functions.text import split_names, truncated
from plotweave.plans.intervals import stab
from plotweave.plans.pick import latest
from plotweave.plans.scan import as_of, ordinal, prefix_scan, slice_of

PAIR = ["left_id", "right_id"]
FOREVER = 2**40


# ---------------------------------------------------------------- event order


def story_order(events: DataFrame) -> DataFrame:
    """Ordinal of each event in its book by (chapter, event index)."""
    sliced = events.withColumn("_slice", slice_of(F.col("idx")))
    return ordinal(sliced, ["book_id"], ["chapter_idx", "_slice"], ["idx", "id"], "ordinal").drop("_slice")


def reading_order(events: DataFrame) -> DataFrame:
    """Ordinal of each event in its book by (chapter, start offset)."""
    sliced = events.withColumn("_slice", slice_of(F.col("start_txt")))
    return ordinal(
        sliced, ["book_id"], ["chapter_idx", "_slice"], ["start_txt", "idx", "id"], "ordinal"
    ).drop("_slice")


# ---------------------------------------------------------------------- facts


def edge_facts(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Edges with their event's place in the book."""
    place = events.select(
        F.col("id").alias("event_id"),
        "chapter_idx",
        F.col("idx").alias("event_idx"),
        F.col("event_id").alias("event_ref"),
        *[c for c in ("ordinal", "story", "reading", "closing", "copies") if c in events.columns],
    )
    return edges.join(place, "event_id", "inner")


stat_facts = edge_facts


def with_logical_ids(edges: DataFrame, characters: DataFrame) -> DataFrame:
    """Resolve both ends of an edge to logical character ids and names."""
    frm = characters.select(
        F.col("id").alias("from_char_id"), F.col("character_id").alias("from_id"), F.col("name").alias("from_name")
    )
    to = characters.select(
        F.col("id").alias("to_char_id"), F.col("character_id").alias("to_id"), F.col("name").alias("to_name")
    )
    bare = edges.drop("from_id", "to_id")
    return bare.join(frm, "from_char_id", "inner").join(to, "to_char_id", "inner")


def paired(facts: DataFrame) -> DataFrame:
    """Undirected key of an edge and its count with null as zero."""
    return facts.withColumns(
        {
            "left_id": F.least("from_id", "to_id"),
            "right_id": F.greatest("from_id", "to_id"),
            "evidence": F.coalesce(F.col("interaction_count"), F.lit(0)).cast("long"),
        }
    ).withColumn("weighted", F.coalesce(F.col("sentiment_score").cast("double"), F.lit(0.0)) * F.col("evidence"))


def mean_positivity(weighted: Column, evidence: Column) -> Column:
    return F.when(evidence > 0, weighted / evidence).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- batch folds


def fold_edges(facts: DataFrame, keys: Sequence[str] = ("book_id",)) -> DataFrame:
    """One undirected edge per pair: evidence, mean positivity, newest labels and reason."""
    # Tags stay text until one edge per pair is left to parse.
    newest = F.max_by(F.struct("relation_tags", "explanation", "event_ref"), F.struct("chapter_idx", "event_idx", "id"))
    folded = (
        paired(facts)
        .groupBy(*keys, *PAIR)
        .agg(F.sum("evidence").alias("evidence_count"), F.sum("weighted").alias("_weighted"), newest.alias("_newest"))
    )
    return folded.select(
        *keys,
        *PAIR,
        "evidence_count",
        mean_positivity(F.col("_weighted"), F.col("evidence_count")).alias("positivity"),
        tags(F.col("_newest.relation_tags")).alias("latest_labels"),
        F.col("_newest.explanation").alias("latest_reason"),
        F.col("_newest.event_ref").alias("latest_event_id"),
    )


def label_scores(facts: DataFrame, keys: Sequence[str] = ("book_id",)) -> DataFrame:
    """Evidence per (pair, label); a label listed twice on one edge counts twice."""
    return (
        paired(facts)
        .withColumn("label", F.explode(tags(F.col("relation_tags"))))
        .groupBy(*keys, *PAIR, "label")
        .agg(F.sum("evidence").alias("score"))
    )


def top_labels(scores: DataFrame, keys: Sequence[str] = ("book_id",), limit: int = 3) -> DataFrame:
    """The best labels of each pair: score first, then the label itself.

    The rank filter becomes a group limit, so each task keeps three rows per pair
    before the shuffle.
    """
    by_score = Window.partitionBy(*keys, *PAIR).orderBy(F.desc("score"), F.asc("label"))
    return scores.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= limit)


def top_label_lists(scores: DataFrame, keys: Sequence[str] = ("book_id",)) -> DataFrame:
    ranked = F.array_sort(F.collect_list(F.struct("rank", "label")))
    return (
        top_labels(scores, keys)
        .groupBy(*keys, *PAIR)
        .agg(F.transform(ranked, lambda x: x["label"]).alias("labels"))
    )


def direction_counts(facts: DataFrame, keys: Sequence[str] = ("book_id",)) -> DataFrame:
    """Evidence per direction of a pair."""
    return (
        paired(facts)
        .groupBy(*keys, *PAIR, direction(F.col("from_id"), F.col("to_id")).alias("direction"))
        .agg(F.sum("evidence").alias("count"))
    )


def as_map(rows: DataFrame, keys: Sequence[str], key: str, value: str, name: str) -> DataFrame:
    """Pairs of a key column and a value column as one sorted map per group."""
    entries = F.sort_array(F.collect_list(F.struct(key, value)))
    return rows.groupBy(*keys).agg(F.map_from_entries(entries).alias(name))


def relationship_edges(facts: DataFrame, keys: Sequence[str] = ("book_id",)) -> DataFrame:
    """The whole folded edge: evidence, positivity, top labels, scores, directions, newest.

    Each edge is written once for its direction and once per label. One hash aggregation
    over these narrow rows sums both; the wide newest state stays out of it. Both sides
    end up partitioned by the pair, so joining them moves nothing.
    """
    group = [*keys, *PAIR]
    way, label = (F.lit(kind).cast("tinyint") for kind in (0, 1))
    measures = F.concat(
        F.array(F.struct(way.alias("kind"), direction(F.col("from_id"), F.col("to_id")).alias("key"))),
        F.transform(tags(F.col("relation_tags")), lambda t: F.struct(label.alias("kind"), t.alias("key"))),
    )
    sums = (
        paired(facts)
        .withColumn("_m", F.explode(measures))
        .groupBy(*group, F.col("_m.kind").alias("kind"), F.col("_m.key").alias("key"))
        .agg(F.sum("evidence").alias("n"))
    )

    def entries(kind: Column) -> Column:
        picked = F.when(F.col("kind") == kind, F.struct("key", F.col("n").alias("value")))
        return F.map_from_entries(F.array_sort(F.collect_list(picked)))

    best = F.array_sort(F.collect_list(F.when(F.col("kind") == label, F.struct(-F.col("n"), "key"))))
    gathered = sums.groupBy(*group).agg(
        F.transform(F.slice(best, 1, 3), lambda x: x["key"]).alias("labels"),
        entries(label).alias("label_scores"),
        entries(way).alias("direction_counts"),
    )
    return fold_edges(facts, keys).join(gathered, group, "inner")


def node_touches(stats: DataFrame, edges: DataFrame) -> DataFrame:
    """Every appearance of a character: a stat row, or either end of an edge."""
    from_stats = stats.select(
        "book_id", "character_id", "event_id", "chapter_idx", "event_idx", F.lit(0).alias("kind"), "id", "node_weight",
        *[c for c in ("ordinal", "closing", "copies") if c in stats.columns],
    )
    ends = edges.withColumn(
        "end", F.explode(F.array(F.struct(F.lit(1).alias("kind"), F.col("from_id").alias("c")),
                                 F.struct(F.lit(2).alias("kind"), F.col("to_id").alias("c"))))
    ).select(
        "book_id", F.col("end.c").alias("character_id"), "event_id", "chapter_idx", "event_idx",
        F.col("end.kind").alias("kind"), "id", F.lit(None).cast("double").alias("node_weight"),
        *[c for c in ("ordinal", "closing", "copies") if c in edges.columns],
    )
    return from_stats.unionByName(ends)


def fold_nodes(touches: DataFrame, keys: Sequence[str] = ("book_id",)) -> DataFrame:
    """Summed weight and stat count per character; both null when only edges name it."""
    return touches.groupBy(*keys, "character_id").agg(
        F.sum("node_weight").cast("float").alias("weight"),
        F.nullif(F.count("node_weight"), F.lit(0)).cast("int").alias("count"),
        F.min(F.struct("chapter_idx", "event_idx", F.least("kind", F.lit(1)).alias("after_stats"), "id", "kind")).alias(
            "first_seen"
        ),
    )


def node_set(touches: DataFrame, keys: Sequence[str] = ("book_id",)) -> DataFrame:
    return touches.select(*keys, "character_id").distinct()


def describe_nodes(
    nodes: DataFrame, characters: DataFrame, places: DataFrame | None = None, deal: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Node rows with the character's label, image, shortened description and names.

    With ``places``, their columns are where ``nodes`` are dealt to by ``deal``: the characters of a
    book go to each of its places and meet the nodes there, so node rows are not moved for it.
    Rows of ``nodes`` without a character, as other things dealt with them, come back as they are.
    """
    described = characters.select(
        "book_id",
        "character_id",
        F.col("name").alias("label"),
        "is_main",
        "profile_image",
        truncated(F.col("personality_text"), 200).alias("description"),
        F.col("profile_text").alias("portrait_prompt"),
        split_names(F.col("names"), F.col("name")).alias("names"),
    )
    if places is None:
        return nodes.join(described, ["book_id", "character_id"], "inner")
    shown = F.struct(*[c for c in described.columns if c not in ("book_id", "character_id")])
    told = places.join(described.filter("character_id IS NOT NULL").select("book_id", "character_id", shown.alias("_shown")), "book_id", "inner")
    dealt = deal(nodes.unionByName(told, allowMissingColumns=True))
    # Only rows that name no character stand without one.
    here = Window.partitionBy(*places.columns, "character_id")
    shows = F.when(F.col("character_id").isNull(), F.array(F.lit(None).cast(told.schema["_shown"].dataType))).otherwise(
        F.collect_list("_shown").over(here)
    )
    return (
        dealt.withColumn("_shows", shows)
        .filter("_shown IS NULL")
        .withColumn("_shown", F.explode("_shows"))
        .select(*nodes.columns, "_shown.*")
    )


# -------------------------------------------------------- folds at every event


def running_fold(
    rows: DataFrame,
    keys: Sequence[str],
    sums: dict[str, Column],
    newest: Column | None = None,
    newest_order: Column | None = None,
    at: str = "ordinal",
    few: bool = True,
) -> DataFrame:
    """State of each key after every step at which it changes.

    Rows are first reduced to one per (keys, step). The state holds from its step
    (``valid_from``) up to the next one of the same key (``valid_until``), so all
    prefixes together take one row per change, not one per prefix.

    A step of ``few`` rows, as an event is, goes straight to the task that scans its slice: the
    rows are moved once. Other steps are reduced before they are moved.
    """
    keys = list(keys)
    reduced = [F.sum(expr).alias(name) for name, expr in sums.items()]
    scans = {name + "_so_far": ("sum", F.col(name)) for name in sums}
    if newest is not None:
        order = newest_order if newest_order is not None else F.col(at)
        reduced.append(F.max(F.struct(order.alias("order"), newest.alias("value"))).alias("_newest"))
        scans["_newest_so_far"] = ("max", F.col("_newest"))
    if few:
        sliced = rows.withColumn("_slice", slice_of(F.col(at))).repartition(*keys, "_slice")
        steps = sliced.groupBy(*keys, "_slice", at).agg(*reduced)
    else:
        steps = rows.groupBy(*keys, at).agg(*reduced).withColumn("_slice", slice_of(F.col(at)))
    ended = prefix_scan(steps, keys, ["_slice"], [at], scans, following={"_next": at})
    kept = [F.col(name + "_so_far").alias(name) for name in sums]
    if newest is not None:
        kept.append(F.col("_newest_so_far.value").alias("newest"))
    return ended.select(
        *keys,
        F.col(at).cast("long").alias("valid_from"),
        F.coalesce(F.col("_next"), F.lit(FOREVER)).cast("long").alias("valid_until"),
        *kept,
    )


def running_edges(facts: DataFrame) -> DataFrame:
    """The folded edge of every pair after every event that touches it."""
    states = running_fold(
        paired(facts),
        ["book_id", *PAIR],
        {"evidence_count": F.col("evidence"), "weighted": F.col("weighted")},
        newest=F.struct("relation_tags", "explanation", "event_ref"),
        newest_order=F.struct("chapter_idx", "event_idx", "id"),
    )
    return states.select(
        "book_id",
        *PAIR,
        "valid_from",
        "valid_until",
        "evidence_count",
        mean_positivity(F.col("weighted"), F.col("evidence_count")).alias("positivity"),
        tags(F.col("newest.relation_tags")).alias("latest_labels"),
        F.col("newest.explanation").alias("latest_reason"),
        F.col("newest.event_ref").alias("latest_event_id"),
    )


def running_nodes(touches: DataFrame) -> DataFrame:
    """Weight and count of every character after every event that touches it."""
    states = running_fold(
        touches,
        ["book_id", "character_id"],
        {
            "weight": F.coalesce(F.col("node_weight"), F.lit(0.0)),
            "count": F.when(F.col("node_weight").isNotNull(), 1).otherwise(0),
        },
    )
    has_stat = F.col("count") > 0
    return states.withColumn("weight", F.when(has_stat, F.col("weight").cast("float"))).withColumn(
        "count", F.when(has_stat, F.col("count").cast("int"))
    )


def state_at(states: DataFrame, requests: DataFrame) -> DataFrame:
    """States that hold at each request's ordinal; requests carry (book_id, upto)."""
    return stab(requests, states, ["book_id"], "upto", "valid_from", "valid_until")


# --------------------------------------------------------------------- scopes


CHAPTER_SPAN = 2**32
END_OF_BOOK = 2**62


def _coordinate(chapter: Column, place: Column) -> Column:
    """Chapter and place in it as one number."""
    return chapter.cast("long") * CHAPTER_SPAN + place.cast("long")


def scope_ordinals(scopes: DataFrame, story: DataFrame, reading: DataFrame) -> DataFrame:
    """Turn requested scopes into the ordinal of their last event (0: none).

    ``scopes`` has (scope_id, book_id, scope, chapter_idx, event_ref, at). Every scope ends
    at a coordinate, so an as-of lookup answers it. A locator scope is a prefix of the
    reading order, the others of the story order, so the result says which order its
    ordinal counts in. An event scope must name an existing event.
    """
    chapter = F.col("chapter_idx")
    named = F.struct(
        F.regexp_extract("event_ref", EVENT_ID, 1).try_cast("int").alias("c"),
        F.regexp_extract("event_ref", EVENT_ID, 2).try_cast("int").alias("i"),
    )
    asked = scopes.withColumn("along", F.when(F.col("scope") == "locator", "reading").otherwise("story")).withColumn(
        "_spot",
        F.when(F.col("scope") == "book", F.lit(END_OF_BOOK))
        .when(F.col("scope") == "chapter", _coordinate(chapter + 1, F.lit(-1)))
        .when(F.col("scope") == "event", _coordinate(named["c"], named["i"]))
        .when(F.col("scope") == "locator", _coordinate(chapter, F.col("at"))),
    )
    found = None
    for along, events, place in (("story", story, "idx"), ("reading", reading, "start_txt")):
        marks = events.select(
            "book_id",
            _coordinate(F.col("chapter_idx"), F.col(place)).alias("_spot"),
            F.struct("ordinal", _coordinate(F.col("chapter_idx"), F.col(place)).alias("spot")).alias("_hit"),
        )
        points = asked.filter((F.col("along") == along) & F.col("_spot").isNotNull()).select("book_id", "_spot")
        hits = as_of(points, marks, ["book_id"], "_spot", "_hit").withColumn("along", F.lit(along))
        found = hits if found is None else found.unionByName(hits)
    joined = asked.join(found, ["book_id", "along", "_spot"], "left")
    missing = (F.col("scope") == "event") & (F.col("_hit.spot") != F.col("_spot"))
    return joined.select(
        *scopes.columns,
        F.when(missing, F.lit(0)).otherwise(F.coalesce("_hit.ordinal", F.lit(0))).cast("long").alias("upto"),
        "along",
    )


# ----------------------------------------------------------------- raw deltas


def delta_events(requests: DataFrame, story: DataFrame) -> DataFrame:
    """Events of each raw-delta request: one event, else a slice, else a chapter, else all.

    ``requests`` has (request_id, book_id, event_ref, from_ref, to_ref, chapter_idx). Every
    kind is a span of ordinals, so one interval join serves them all.
    """
    place = story.select("book_id", F.col("event_id").alias("_ref"), F.col("ordinal").alias("_at"))

    def ordinal_of(column: str, name: str, df: DataFrame) -> DataFrame:
        return df.join(
            place.withColumnRenamed("_ref", column).withColumnRenamed("_at", name), ["book_id", column], "left"
        )

    chapters = story.groupBy("book_id", "chapter_idx").agg(F.min("ordinal").alias("_c0"), F.max("ordinal").alias("_c1"))
    books = story.groupBy("book_id").agg(F.max("ordinal").alias("_b1"))
    asked = ordinal_of("to_ref", "_t", ordinal_of("from_ref", "_f", ordinal_of("event_ref", "_e", requests)))
    asked = asked.join(chapters, ["book_id", "chapter_idx"], "left").join(books, "book_id", "left")
    one, span, chapter = F.col("event_ref").isNotNull(), F.col("from_ref").isNotNull(), F.col("chapter_idx").isNotNull()
    spans = asked.withColumns(
        {
            "lo": F.when(one, F.col("_e")).when(span, F.col("_f")).when(chapter, F.col("_c0")).otherwise(F.lit(1)),
            "hi": F.when(one, F.col("_e")).when(span, F.col("_t")).when(chapter, F.col("_c1")).otherwise(F.col("_b1")),
        }
    ).select("request_id", "book_id", "lo", (F.col("hi") + 1).alias("hi"))
    return stab(story, spans, ["book_id"], "ordinal", "lo", "hi")


def delta_items(edges: DataFrame) -> DataFrame:
    """Edges as delta items; a missing sentiment stays missing."""
    return edges.select(
        "event_id",
        "from_id",
        "to_id",
        tags(F.col("relation_tags")).alias("labels"),
        F.col("sentiment_score").cast("double").alias("positivity"),
        F.col("interaction_count").alias("evidence_count"),
        F.col("explanation").alias("reason"),
    )


def plain_edges(edges: DataFrame) -> DataFrame:
    """Edges as they appear in event and prefix graphs: a missing sentiment is 0.0."""
    return edges.select(
        "event_id",
        "book_id",
        "from_id",
        "to_id",
        F.coalesce(F.col("sentiment_score").cast("double"), F.lit(0.0)).alias("sentiment"),
        "interaction_count",
        tags(F.col("relation_tags")).alias("tags"),
    )


def delta_records(events: DataFrame, edges: DataFrame, stats: DataFrame) -> DataFrame:
    """One record per event: its items and its node weights."""
    # Fixed value.
    contract = "relationship-delta-v1"
    items = (
        delta_items(edges)
        .groupBy("event_id")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct("from_id", "to_id", "labels", "positivity", "evidence_count", "reason")
                )
            ).alias("items")
        )
    )
    weights = as_map(
        stats.withColumn("_c", F.col("character_id").cast("string")), ["event_id"], "_c", "node_weight", "node_weights"
    )
    return (
        events.select(F.col("id").alias("event_id"), "book_id", "chapter_idx", F.col("event_id").alias("event_ref"))
        .join(items, "event_id", "left")
        .join(weights, "event_id", "left")
        .withColumn("contract_version", F.lit(contract))
    )


# ------------------------------------------------------------ prefix snapshots


def chapter_last(events: DataFrame) -> DataFrame:
    """The highest-index event of every chapter, without its text.

    The candidate row travels through the aggregation, so it carries places only.
    """
    places = events.select("id", "book_id", "chapter_idx", "idx", "event_id", "start_txt", "end_txt")
    return latest(places, ["book_id", "chapter_idx"], ["idx", "id"])


def snapshot_nodes(events: DataFrame, stats: DataFrame, edges: DataFrame) -> DataFrame:
    """Prefix graph nodes at every chapter: newest weight and stat count.

    Only the last event of each chapter counts. A row holds for all chapters from
    ``valid_from`` up to ``valid_until``.
    """
    last = chapter_last(events)
    touches = node_touches(stat_facts(stats, last), edge_facts(edges, last))
    states = running_fold(
        touches,
        ["book_id", "character_id"],
        {"count": F.when(F.col("node_weight").isNotNull(), 1).otherwise(0)},
        newest=F.col("node_weight"),
        newest_order=F.struct(F.col("node_weight").isNotNull(), F.col("chapter_idx"), F.col("id")),
        at="chapter_idx",
        few=False,
    )
    return states.select(
        "book_id",
        "character_id",
        "valid_from",
        "valid_until",
        F.col("newest").cast("float").alias("weight"),
        F.nullif(F.col("count"), F.lit(0)).cast("int").alias("count"),
    )


def snapshot_edges(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Prefix graph edges: each chapter's last event brings its own, from that chapter on."""
    return plain_edges(edges).join(
        chapter_last(events).select(F.col("id").alias("event_id"), F.col("chapter_idx").alias("valid_from")),
        "event_id",
        "inner",
    )


def chapter_cumulative_edges(facts: DataFrame) -> DataFrame:
    """Cumulative interaction and weighted sentiment per directed pair and chapter."""
    rows = paired(facts)
    states = running_fold(
        rows,
        ["book_id", "from_id", "to_id"],
        {"cumulative_interaction": F.col("evidence"), "sentiment_weighted_sum": F.col("weighted")},
        at="chapter_idx",
        few=False,
    )
    return states.withColumnRenamed("valid_from", "chapter_idx").drop("valid_until")
