"""The whole relationship graph at any prefix of a story.

A prefix is known by its book, the order it counts in (``along``: story or reading) and the
ordinal of its last event (`graph.scope_ordinals`). What changes along an order is written as
one log: an edge's or a node's state holds from the event that made it to the next one that
changes it. A state of an edge carries everything a graph shows of it, the three best labels
included, so a prefix is looked up with one interval join and nothing is folded per prefix.

Both orders are read from one scan: the facts are joined once and written by `session.cut`.
They are dealt out by their key and slice, moved once for both orders, and everything about a
slice is worked out where it lies (`_states`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions.coords import tags
from plotweave.functions.ids import direction
from plotweave.operators import graph
from plotweave.operators.graph import FOREVER, PAIR
from plotweave.plans.intervals import stab_blocks
from plotweave.plans.scan import SLICE_WIDTH, slice_of
from plotweave.plans.spread import in_portions
from plotweave.session import cut

ORDERS = ("story", "reading")
PREFIX = ["book_id", "along"]
WHOLE, DIRECTION, LABEL = 0, 1, 2
# Facts and states of one task: its sorts stay in memory.
FACTS, STATES = 100_000, 200_000
# Prefixes of this many ordinals (as a power of two) are answered in one place.
BLOCK_BITS = 10


def both_orders(story: DataFrame, reading: DataFrame) -> DataFrame:
    """Events with their ordinals in both orders."""
    return story.withColumnRenamed("ordinal", "story").join(
        reading.select("id", F.col("ordinal").alias("reading")), "id", "inner"
    )


def _along(facts: DataFrame) -> DataFrame:
    """Each fact once per order, with ``along`` and its ``ordinal`` there."""
    ways = F.array(*[F.struct(F.lit(o).alias("along"), F.col(o).alias("ordinal")) for o in ORDERS])
    return facts.withColumn("_way", F.explode(ways)).select(*[c for c in facts.columns if c not in ORDERS], "_way.*")


def _part(kind: int, name: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), name.alias("name"))


def _measured(rows: DataFrame, parts: Column) -> DataFrame:
    return rows.withColumn("_part", F.explode(parts)).select(*[c for c in rows.columns if c not in ("kind", "name")], "_part.*")


def _carried(facts: DataFrame, keys: list[str], parts: Column, sums: list[str], newest: list[str]) -> DataFrame:
    """What a slice has to know of the others: the sums before it, as rows without an ordinal, and the next step behind it.

    Only books that reach beyond one slice have such rows. Each holds a slice of events, so they
    are few and are told to all tasks.
    """
    long = facts.filter(" OR ".join(f"{o} >= {SLICE_WIDTH}" for o in ORDERS)).select("book_id").distinct()
    rows = _along(facts.join(F.broadcast(long), "book_id", "left_semi")).withColumn("_at", slice_of(F.col("ordinal")))
    group = [*PREFIX, *keys]
    held = graph.running_fold(
        _measured(rows, parts),
        [*group, "kind", "name"],
        {c: F.col(c) for c in sums},
        *[F.col(c) for c in newest * 2],
        at="_at",
        few=False,
    )
    asked = rows.select(*group, (F.col("_at") - 1).alias("_before")).distinct()
    before = stab_blocks(asked, held, group, "_before", "valid_from", "valid_until").select(
        *group, (F.col("_before") + 1).alias("_slice"), F.lit(None).cast("long").alias("ordinal"), "kind", "name", *sums, *newest
    )
    begun = rows.groupBy(*group, F.col("_at").alias("_slice")).agg(F.min("ordinal").alias("ordinal"))
    following = F.lead("ordinal").over(Window.partitionBy(*group).orderBy("_slice")).cast("long")
    behind = begun.withColumn("ordinal", following).filter("ordinal IS NOT NULL").withColumns(
        {"kind": F.lit(WHOLE), "name": F.lit("")}
    )
    return before.unionByName(behind, allowMissingColumns=True)


def _states(
    facts: DataFrame, keys: list[str], sums: list[str], newest: list[str] = [], parts: Column | None = None
) -> DataFrame:
    """Running sums of every key and part after every step, in the slices the steps lie in.

    ``facts`` has ``sums``, a struct ``newest`` whose largest is kept, and the ordinals of both
    orders. A step counts for the key itself (WHOLE) and for what ``parts`` names. ``until`` is
    the next step of the same part in its slice; a row without an ordinal holds from the slice's
    beginning. Facts are moved once, or twice where their slices differ between the orders;
    all that follows stays in their partition.
    """
    whole = _part(WHOLE, F.lit(""))
    parts = F.array(whole) if parts is None else F.concat(F.array(whole), parts)
    sliced = facts.withColumn("_slice", F.explode(F.array_distinct(F.array(*[slice_of(F.col(o)) for o in ORDERS]))))
    carried = _carried(facts, keys, parts, sums, newest)
    merged = in_portions(sliced.unionByName(carried, allowMissingColumns=True), facts.count(), FACTS, "book_id", *keys, "_slice")
    own = [
        F.when(slice_of(F.col(o)) == F.col("_slice"), F.struct(F.lit(o).alias("along"), F.col(o).cast("long").alias("ordinal")))
        for o in ORDERS
    ]
    ways = F.when(F.col("along").isNull(), F.array(*own)).otherwise(F.array(F.struct("along", "ordinal")))
    ways_of = merged.withColumn("_way", F.explode(ways)).filter("_way IS NOT NULL")
    rows = ways_of.select(*[c for c in merged.columns if c not in ("along", "ordinal", *ORDERS)], "_way.*")
    rows = _measured(rows, F.when(F.col("kind").isNull(), parts).otherwise(F.array(F.struct("kind", "name"))))
    part = [*PREFIX, *keys, "_slice", "kind", "name"]
    steps = rows.groupBy(*part, "ordinal").agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in newest])
    ordered = Window.partitionBy(*part).orderBy("ordinal")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(
        *part,
        "ordinal",
        F.lead("ordinal").over(ordered).alias("until"),
        *[F.sum(c).over(so_far).alias(c) for c in sums],
        *[F.max(c).over(so_far).alias(c) for c in newest],
    )


def _own_step() -> Column:
    """Whether a state begins with a step of its slice, not with what the slice was told."""
    return (F.col("kind") == WHOLE) & (slice_of(F.col("ordinal")) == F.col("_slice"))


def _held() -> list[Column]:
    return [F.col("ordinal").alias("valid_from"), F.coalesce("until", F.lit(FOREVER).cast("long")).alias("valid_until")]


def _pair_columns() -> list[Column]:
    return [
        F.col("evidence").alias("evidence_count"),
        graph.mean_positivity(F.col("weighted"), F.col("evidence")).alias("positivity"),
        tags(F.col("newest.shown.relation_tags")).alias("latest_labels"),
        F.col("newest.shown.explanation").alias("latest_reason"),
        F.col("newest.shown.event_ref").alias("latest_event_id"),
    ]


def pair_facts(edges: DataFrame, places: DataFrame) -> DataFrame:
    """Edges under their undirected key, with both ordinals. ``places`` comes from `both_orders`."""
    facts = graph.paired(graph.edge_facts(edges, places))
    shown = F.struct("relation_tags", "explanation", "event_ref")
    newest = F.struct(F.struct("chapter_idx", "event_idx", "id").alias("at"), shown.alias("shown")).alias("newest")
    return cut(facts.select("book_id", *PAIR, *ORDERS, "from_id", "to_id", "evidence", "weighted", newest), FACTS)


def touch_facts(stats: DataFrame, edges: DataFrame, places: DataFrame) -> DataFrame:
    """Weight and stat count that an event brings to each character a stat or an edge of it names."""
    # Either order serves as the ordinal of a touch; both come back with the event's place.
    touches = graph.node_touches(graph.stat_facts(stats, places), graph.edge_facts(edges, places))
    at = places.select(F.col("id").alias("event_id"), *ORDERS)
    of_event = touches.join(at, "event_id", "inner").groupBy("event_id", "book_id", "character_id", *ORDERS)
    weight = F.coalesce(F.col("node_weight"), F.lit(0.0))
    return cut(of_event.agg(F.sum(weight).alias("weight"), F.count("node_weight").alias("count")).drop("event_id"), FACTS)


def pair_log(facts: DataFrame) -> DataFrame:
    """Every state of every pair, without its label scores and directions.

    ``facts`` comes from `pair_facts`.
    """
    states = _states(facts.drop("from_id", "to_id"), PAIR, ["evidence", "weighted"], ["newest"])
    return states.filter(_own_step()).select(*PREFIX, *PAIR, *_held(), *_pair_columns())


def edge_log(facts: DataFrame) -> DataFrame:
    """Every state of every pair: the whole edge, from ``valid_from`` up to ``valid_until``.

    A state holds one entry for each label and direction that the pair has by then, as the
    graph does. ``facts`` comes from `pair_facts`.
    """
    way = F.array(_part(DIRECTION, direction(F.col("from_id"), F.col("to_id"))))
    labels = F.transform(tags(F.col("newest.shown.relation_tags")), lambda t: _part(LABEL, t))
    states = _states(facts, PAIR, ["evidence", "weighted"], ["newest"], F.concat(way, labels))
    step = F.struct("ordinal", "until", "evidence", "weighted", "newest")
    entry = F.struct("kind", "name", F.coalesce("ordinal", F.lit(-1)).alias("since"), "until", "evidence")
    gathered = states.groupBy(*PREFIX, *PAIR, "_slice").agg(
        F.collect_list(F.when(_own_step(), step)).alias("steps"),
        F.array_sort(F.collect_list(F.when(F.col("kind") != WHOLE, entry))).alias("entries"),
    )
    each = gathered.dropna(subset=PAIR).select(*PREFIX, *PAIR, "entries", F.explode("steps").alias("_step"))
    each = each.select(*PREFIX, *PAIR, "entries", "_step.*")

    def known(kind: int) -> Column:
        return F.filter(
            "entries",
            lambda e: (e["kind"] == kind) & (e["since"] <= F.col("ordinal")) & (e["until"].isNull() | (F.col("ordinal") < e["until"])),
        )

    def scores(of: str) -> Column:
        return F.map_from_entries(F.transform(of, lambda e: F.struct(e["name"].alias("key"), e["evidence"].alias("value"))))

    best = F.array_sort(F.transform("_labels", lambda e: F.struct(-e["evidence"], e["name"].alias("name"))))
    return each.withColumns({"_labels": known(LABEL), "_ways": known(DIRECTION)}).select(
        *PREFIX,
        *PAIR,
        *_held(),
        *_pair_columns(),
        F.transform(F.slice(best, 1, 3), lambda x: x["name"]).alias("labels"),
        scores("_labels").alias("label_scores"),
        scores("_ways").alias("direction_counts"),
    )


def node_log(facts: DataFrame) -> DataFrame:
    """Every state of every character that a stat or an edge names: weight and stat count.

    ``facts`` comes from `touch_facts`.
    """
    states = _states(facts, ["character_id"], ["weight", "count"])
    some = F.col("count") > 0
    return states.filter(_own_step()).select(
        *PREFIX,
        "character_id",
        *_held(),
        F.when(some, F.col("weight").cast("float")).alias("weight"),
        F.when(some, F.col("count").cast("int")).alias("count"),
    )


def at_prefixes(log: DataFrame, resolved: DataFrame, weight: int) -> DataFrame:
    """The states that hold at each distinct prefix among the resolved scopes. ``weight`` is about the number of states."""
    asked = resolved.select(*PREFIX, "upto").distinct()

    # A state holds at several prefixes: half as many as are gathered by block.
    def deal(tiled: DataFrame) -> DataFrame:
        return in_portions(tiled, weight, STATES // 2, *PREFIX, "_level", "_tile")

    return stab_blocks(asked, log, PREFIX, "upto", "valid_from", "valid_until", deal=deal).drop("valid_from", "valid_until")


def _in_blocks(log: DataFrame, asked: DataFrame) -> DataFrame:
    """The states of a log once per block of prefixes (``_block``) that is asked for and that they reach.

    Books whose prefixes lie behind the first block are told to all tasks: one number per block.
    """
    blocks = asked.groupBy(*PREFIX).agg(F.array_sort(F.collect_set("_block")).alias("_blocks")).filter("element_at(_blocks, -1) > 0")
    first, final = F.shiftright("valid_from", BLOCK_BITS), F.shiftright(F.col("valid_until") - 1, BLOCK_BITS)
    reached = F.filter("_blocks", lambda b: (first <= b) & (b <= final))
    only = F.when(first == 0, F.array(F.lit(0).cast("long")))
    joined = log.join(F.broadcast(blocks), PREFIX, "left")
    return joined.withColumn("_block", F.explode(F.when(F.col("_blocks").isNull(), only).otherwise(reached))).drop("_blocks")


def lines_at(
    log: DataFrame, resolved: DataFrame, weight: int, line: Column, characters: DataFrame | None = None
) -> DataFrame:
    """The states of `at_prefixes` as ``lines`` of text in order, one row per distinct prefix that has any.

    A state moves once to a block of prefixes, not to each of them, and its ``line`` is made
    and sorted once. With ``characters``, states are those of nodes, described by
    `graph.describe_nodes` where the block lies. ``weight`` is about the number of states.
    """
    asked = resolved.select(*PREFIX, "upto").distinct().filter("book_id IS NOT NULL AND upto >= 0")
    asked = asked.withColumn("_block", F.shiftright("upto", BLOCK_BITS))
    states = _in_blocks(log, asked)
    place = [*PREFIX, "_block"]
    if characters is None:
        states = states.select(*place, "valid_from", "valid_until", line.alias("line"))
        dealt = in_portions(states.unionByName(asked, allowMissingColumns=True), weight, STATES, *place)
    else:
        met = states.filter("character_id IS NOT NULL").unionByName(asked, allowMissingColumns=True)
        dealt = graph.describe_nodes(met, characters, asked.select(*place).distinct(), lambda df: in_portions(df, weight, STATES, *place))
        dealt = dealt.withColumn("line", F.when(F.col("upto").isNull(), line))
    gathered = dealt.groupBy(*place).agg(
        F.array_sort(F.collect_list(F.when(F.col("upto").isNull(), F.struct("line", "valid_from", "valid_until")))).alias("rows"),
        F.collect_list("upto").alias("asked"),
    )
    each = gathered.select(*PREFIX, "rows", F.explode("asked").alias("upto"))
    held = F.filter("rows", lambda r: (r["valid_from"] <= F.col("upto")) & (F.col("upto") < r["valid_until"]))
    return each.select(*PREFIX, "upto", F.transform(held, lambda r: r["line"]).alias("lines"))


def graph_at(
    resolved: DataFrame, events: DataFrame, edges: DataFrame, stats: DataFrame, characters: DataFrame
) -> dict[str, DataFrame]:
    """Edges and described nodes of every distinct prefix (book_id, along, upto).

    Many readers share a prefix; join by it to get back to their scopes.
    """
    places = both_orders(graph.story_order(events), graph.reading_order(events))
    touches, pairs = touch_facts(stats, edges, places), pair_facts(edges, places)
    nodes = at_prefixes(node_log(touches), resolved, 2 * touches.count())
    return {
        "edges": at_prefixes(edge_log(pairs), resolved, 2 * pairs.count()),
        "nodes": graph.describe_nodes(nodes, characters),
    }
