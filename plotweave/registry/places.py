"""Positions, locators, blocks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from plotweave.functions import coords
from plotweave.operators import corpus, graph, positions
from plotweave.registry.base import query
from plotweave.views import Views

CONTAINED = """SELECT a.book_id, a.chapter_idx, a.at, v.id AS event_row, v.idx AS event_idx FROM asked a
    JOIN story_event v ON v.book_id = a.book_id AND v.chapter_idx = a.chapter_idx AND v.start_txt <= a.at AND a.at < v.end_txt
    QUALIFY row_number() OVER (PARTITION BY a.book_id, a.chapter_idx, a.at ORDER BY v.idx) = 1"""
BEGUN = """SELECT a.book_id, a.chapter_idx, a.at, v.id AS event_row, v.idx AS event_idx FROM asked a
    JOIN story_event v ON v.book_id = a.book_id AND v.chapter_idx = a.chapter_idx AND v.start_txt <= a.at
    QUALIFY row_number() OVER (PARTITION BY a.book_id, a.chapter_idx, a.at ORDER BY v.idx DESC) = 1"""


def flat(hits):
    return hits.select(
        "book_id", "chapter_idx", "at", F.col("hit.id").alias("event_row"), F.col("hit.idx").alias("event_idx")
    )


@query("jn_14_interval_join", CONTAINED)
def _(v: Views):
    return flat(positions.containing_event(v.position, v.event))


@query("jn_15_as_of_fallback", BEGUN)
def _(v: Views):
    return flat(positions.started_event(v.position, v.event)).filter("event_row IS NOT NULL")


@query(
    "fine_event_at_position",
    """SELECT a.*, coalesce(c.event_row, b.event_row) AS event_row, coalesce(c.event_idx, b.event_idx) AS event_idx
       FROM asked a LEFT JOIN contained c USING (book_id, chapter_idx, "at") LEFT JOIN begun b USING (book_id, chapter_idx, "at")""",
    contained=CONTAINED,
    begun=BEGUN,
)
def event_at(v: Views):
    return positions.event_at(v.position, v.event)


@query(
    "jn_16_reading_prefix_selection",
    """SELECT a.book_id, a.chapter_idx, a.at, l.id AS event_row FROM asked a
         JOIN chapter_last l ON l.book_id = a.book_id AND l.chapter_idx < a.chapter_idx
       UNION ALL SELECT book_id, chapter_idx, "at", event_row FROM begun""",
    begun=BEGUN,
)
def _(v: Views):
    return positions.prefix_events(v.position, v.event)


PREFIX = """SELECT a.book_id, a.chapter_idx, a.at, l.id AS event_row FROM asked a
         JOIN chapter_last l ON l.book_id = a.book_id AND l.chapter_idx < a.chapter_idx
       UNION ALL SELECT book_id, chapter_idx, "at", event_row FROM begun"""


@query(
    "jn_16_prefix_summary",
    """SELECT book_id, chapter_idx, "at", count(*) AS events, min(event_row) AS first_id, max(event_row) AS last_id,
         CAST(sum(event_row) AS BIGINT) AS id_sum FROM prefix GROUP BY 1, 2, 3""",
    begun=BEGUN,
    prefix=PREFIX,
)
def _(v: Views):
    return positions.prefix_summary(v.position, v.event)


@query(
    "jn_16_prefix_nodes",
    """SELECT p.book_id, p.chapter_idx, p.at, t.character_id,
         CAST(CAST(arg_max(t.node_weight, struct_pack(a := t.chapter_idx, b := t.id)) AS FLOAT) AS DOUBLE) AS weight,
         CAST(nullif(count(t.node_weight), 0) AS INT) AS count
       FROM prefix p JOIN touch t ON t.event_id = p.event_row GROUP BY 1, 2, 3, 4""",
    begun=BEGUN,
    prefix=PREFIX,
)
def _(v: Views):
    return positions.prefix_nodes(v.position, v.event, v.stat, v.edge).withColumn("weight", F.col("weight").cast("double"))


@query(
    "jn_27_event_by_index",
    """SELECT p.position_id, h.chapter_id IS NULL AS chapter_missing, v.id AS event_row FROM position p
       LEFT JOIN story_chapter h ON h.book_id = p.book_id AND h.idx = p.chapter_idx
       LEFT JOIN story_event v ON v.chapter_id = h.chapter_id AND v.idx = p.at % 20""",
)
def _(v: Views):
    chapters = v.chapter.select("book_id", F.col("idx").alias("chapter_idx"), "chapter_id")
    events = v.event.select("chapter_id", "idx", F.col("id").alias("event_row"))
    return (
        v.position.withColumn("idx", F.col("at") % 20)
        .join(chapters, ["book_id", "chapter_idx"], "left")
        .join(events, ["chapter_id", "idx"], "left")
        .select("position_id", F.col("chapter_id").isNull().alias("chapter_missing"), "event_row")
    )


BLOCK_START = """SELECT chapter_id, block_idx, length, CAST(coalesce(sum(length) OVER (PARTITION BY chapter_id ORDER BY block_idx
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM block"""
# Every chapter is asked along its whole length: near the begin, the middle and the end of its blocks, and past its end.
OFFSETS = """SELECT DISTINCT chapter_id, CAST(length * (block_idx + 1) - part * length // 2 AS BIGINT) AS at FROM block, (VALUES (0), (1), (2)) parts(part)
    WHERE length IS NOT NULL"""


def offsets(v: Views):
    parts = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    return v.block.filter("length IS NOT NULL").withColumn("part", parts).selectExpr(
        "chapter_id", "bigint(length * (block_idx + 1) - part * length div 2) AS at"
    ).distinct()


@query("wn_7_block_start", "SELECT chapter_id, block_idx, length, start FROM block_start", block_start=BLOCK_START)
def _(v: Views):
    return corpus.block_starts(v.block).select("chapter_id", "block_idx", "length", "start")


@query(
    "jn_17_offset_to_block",
    """SELECT o.chapter_id, o.at, b.block_idx, least(o.at - b.start, b.length) AS "offset"
       FROM offsets o JOIN (SELECT chapter_id, sum(length) AS total, max(block_idx) AS last FROM block GROUP BY 1) t USING (chapter_id)
       JOIN block_start b ON b.chapter_id = o.chapter_id
         AND (o.at < b.start + b.length OR (o.at = t.total AND b.block_idx = t.last))
       WHERE o.at <= t.total
       QUALIFY row_number() OVER (PARTITION BY o.chapter_id, o.at ORDER BY b.block_idx) = 1""",
    block_start=BLOCK_START,
    offsets=OFFSETS,
)
def _(v: Views):
    return positions.block_at(offsets(v), corpus.block_starts(v.block))


LOCATOR_SQL = """SELECT p.position_id, p.book_id, p.chapter_idx, p.at % 6 AS block_idx, p.at % 520 AS "offset",
    CASE WHEN h.starts IS NOT NULL AND p.at % 6 < 4 AND p.at % 520 <= h.lengths[p.at % 6 + 1]
         THEN h.starts[p.at % 6 + 1] + p.at % 520 END AS start_txt
    FROM position p LEFT JOIN story_chapter h ON h.book_id = p.book_id AND h.idx = p.chapter_idx"""


@query("sc_14_locator_to_offset", LOCATOR_SQL)
def _(v: Views):
    asked = v.position.selectExpr("position_id", "book_id", "chapter_idx", "at % 6 AS block_idx", "at % 520 AS offset")
    return positions.locator_offsets(asked, v.chapter)


@query(
    "sc_15_offset_to_locator",
    """SELECT p.position_id, CASE WHEN p.at < 400 THEN 0 WHEN p.at < 800 THEN 1 WHEN p.at < 1200 THEN 2 ELSE 3 END AS block_idx,
         CASE WHEN p.at < 400 THEN p.at WHEN p.at < 800 THEN p.at - 400 WHEN p.at < 1200 THEN p.at - 800 ELSE p.at - 1200 END AS "offset"
       FROM position p JOIN story_chapter h ON h.book_id = p.book_id AND h.idx = p.chapter_idx
       WHERE h.starts IS NOT NULL AND p.at <= 1700""",
)
def _(v: Views):
    shape = v.chapter.select("book_id", F.col("idx").alias("chapter_idx"), "starts", "lengths", "total_code_points")
    total = coords.total_code_points(F.col("total_code_points"), F.col("starts"), F.col("lengths"))
    place = coords.offset_to_locator(F.col("chapter_idx"), F.col("starts"), F.col("lengths"), total, F.col("at"))
    return (
        v.position.join(shape, ["book_id", "chapter_idx"], "inner")
        .select("position_id", place.alias("locator"))
        .filter("locator IS NOT NULL")
        .select("position_id", "locator.blockIndex", "locator.offset")
        .withColumnRenamed("blockIndex", "block_idx")
    )


@query(
    "sc_16_total_code_points",
    "SELECT chapter_id, CASE WHEN starts IS NOT NULL THEN coalesce(total_code_points, 1700) END AS total FROM story_chapter",
)
def _(v: Views):
    total = coords.total_code_points(F.col("total_code_points"), F.col("starts"), F.col("lengths"))
    return v.chapter.select("chapter_id", total.alias("total"))


@query(
    "src_7_metadata_fallback",
    """SELECT chapter_id, CASE WHEN starts IS NULL THEN 900 ELSE total_code_points END AS total_code_points,
         CASE WHEN starts IS NULL THEN '0,500' ELSE '0,400,800,1200' END AS starts FROM story_chapter""",
)
def _(v: Views):
    from plotweave.sources.artifacts import chapters_from_meta

    bodies = v.chapter.select(
        "book_id",
        "idx",
        F.struct(
            F.col("idx").alias("chapterIndex"),
            F.array(F.lit(0), F.lit(500)).alias("paragraphStarts"),
            F.array(F.lit(500), F.lit(400)).alias("paragraphLengths"),
            F.lit(900).alias("totalCodePoints"),
        ).alias("chapter"),
    )
    meta = bodies.groupBy("book_id").agg(
        F.to_json(F.struct(F.array_sort(F.collect_list("chapter")).alias("chapters"))).alias("json")
    )
    joined = positions.with_meta_fallback(v.chapter, chapters_from_meta(meta))
    return joined.select("chapter_id", "total_code_points", F.array_join(F.col("starts").cast("array<string>"), ",").alias("starts"))


@query(
    "prj_5_event_info",
    """SELECT id, chapter_idx, idx AS event_idx, event_id,
         CASE WHEN start_block IS NULL OR start_offset IS NULL THEN NULL ELSE chapter_idx || ':' || start_block || ':' || start_offset END AS start_locator,
         CASE WHEN end_block IS NULL OR end_offset IS NULL THEN NULL ELSE chapter_idx || ':' || end_block || ':' || end_offset END AS end_locator,
         start_txt, end_txt FROM story_event""",
)
def _(v: Views):
    def text(c):
        return F.when(
            F.col(c).isNotNull(), F.concat_ws(":", f"{c}.chapterIndex", f"{c}.blockIndex", f"{c}.offset")
        )

    info = positions.event_info(v.event)
    return info.drop("book_id").withColumns({"start_locator": text("start_locator"), "end_locator": text("end_locator")})


@query(
    "fine_graph_nodes",
    """SELECT DISTINCT f.book_id, f.chapter_idx, f.at, t.character_id,
         (SELECT max(CAST(CAST(s.node_weight AS FLOAT) AS DOUBLE)) FROM story_stat s WHERE s.event_id = f.event_row AND s.character_id = t.character_id) AS weight
       FROM (SELECT a.*, coalesce(c.event_row, b.event_row) AS event_row FROM asked a
               LEFT JOIN contained c USING (book_id, chapter_idx, "at") LEFT JOIN begun b USING (book_id, chapter_idx, "at")) f
       JOIN touch t ON t.event_id = f.event_row""",
    contained=CONTAINED,
    begun=BEGUN,
)
def fine_graph(v: Views):
    touches = graph.node_touches(graph.stat_facts(v.stat, v.event), graph.edge_facts(v.edge, v.event))
    nodes = touches.groupBy(F.col("event_id").alias("event_row"), "character_id").agg(
        F.max(F.col("node_weight").cast("float").cast("double")).alias("weight")
    )
    return (
        positions.event_at(v.position, v.event)
        .join(nodes, "event_row", "inner")
        .select("book_id", "chapter_idx", "at", "character_id", "weight")
    )


@query(
    "locator_round_trip",
    """SELECT count(*) AS offsets, count(*) AS restored FROM offsets o
       JOIN (SELECT chapter_id, sum(length) AS total FROM block GROUP BY 1) t USING (chapter_id) WHERE o.at <= t.total""",
    offsets=OFFSETS,
)
def _(v: Views):
    blocks = corpus.block_starts(v.block)
    places = positions.block_at(offsets(v), blocks)
    back = places.join(blocks.select("chapter_id", "block_idx", "start"), ["chapter_id", "block_idx"], "inner")
    return back.agg(
        F.count("*").alias("offsets"),
        F.count_if(F.col("start") + F.col("offset") == F.col("at")).alias("restored"),
    )
