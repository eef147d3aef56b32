"""Payload ingest and validation rules."""

from functools import cached_property

from pyspark.sql import functions as F

from plotweave.operators import graph, ingest, positions, quality
from plotweave.plans.spread import in_portions
from plotweave.registry.base import query
from plotweave.sources import payloads
from plotweave.views import Views

C = F.col

# ------------------------------------------------------------- delta uploads

ITEM = """SELECT e.event_id, e.book_id, from_id, CASE event_id % 17 WHEN 4 THEN from_id WHEN 8 THEN 999 ELSE to_id END AS to_id,
    CASE event_id % 17 WHEN 1 THEN 2.0 ELSE CAST(sentiment_score AS DOUBLE) END AS positivity,
    CASE event_id % 17 WHEN 2 THEN 0 ELSE interaction_count END AS evidence_count, explanation
    FROM story_edge e WHERE event_id % 17 <> 9"""
REASONS = {
    "dq_1_contract": "SELECT id AS upload_id FROM story_event WHERE id % 17 IN (0, 9)",
    "dq_2_positivity": "SELECT DISTINCT event_id AS upload_id FROM item WHERE positivity IS NULL OR positivity > 1 OR positivity < -1",
    "dq_3_evidence": "SELECT DISTINCT event_id AS upload_id FROM item WHERE evidence_count IS NULL OR evidence_count <= 0",
    "dq_4_labels": "SELECT DISTINCT event_id AS upload_id FROM item WHERE event_id % 17 = 3",
    "dq_5_same_character": "SELECT DISTINCT event_id AS upload_id FROM item WHERE from_id = to_id",
    "dq_6_duplicates": """SELECT upload_id FROM (SELECT event_id AS upload_id FROM item WHERE event_id % 17 NOT IN (5, 6) GROUP BY event_id, from_id, to_id
        HAVING count(*) > 1 OR event_id % 17 = 10 UNION SELECT id FROM story_event WHERE id % 17 = 10)""",
    "dq_7_weight_value": "SELECT DISTINCT event_id AS upload_id FROM story_stat WHERE event_id % 17 = 7",
    "dq_10_chapter": "SELECT id AS upload_id FROM story_event WHERE id % 17 IN (5, 9)",
    "dq_11_event_id": "SELECT id AS upload_id FROM story_event WHERE id % 17 IN (5, 6, 9)",
    "dq_15_references": """SELECT id AS upload_id FROM story_event WHERE id % 17 IN (5, 6, 9)
        UNION SELECT DISTINCT event_id FROM item WHERE to_id = 999""",
}
PREFIX = {name: "DQ-" + name.split("_")[1] + " " for name in REASONS}
REJECTED = " UNION ".join(REASONS.values()) + " UNION SELECT id FROM story_event WHERE id % 17 = 9"


#: Lines and orders from which one task makes files.
LINES = 400_000


class EventLines(Views):
    """The views with the lines of an event side by side."""

    @cached_property
    def rows(self) -> int:
        return sum(Views.table(self, name).count() for name in ("lineitem", "orders"))

    def table(self, name: str):
        rows = super().table(name)
        return in_portions(rows, self.rows, LINES, "l_orderkey") if name == "lineitem" else rows

    def by_event(self, lines):
        return lines


def delta_uploads(v: Views):
    """One payload file per event; every kind of defect occurs in one seventeenth of them."""
    kind = C("event_id") % 17
    # Lines move to their event once; pairs, characters and records of an event are gathered there.
    near = EventLines(v.spark, v.folder)
    records = graph.delta_records(v.event, near.edge, near.stat)

    def spoil(x):
        return F.struct(
            x["from_id"].alias("from_id"),
            F.when(kind == 4, x["from_id"]).when(kind == 8, F.lit(999)).otherwise(x["to_id"]).cast("bigint").alias("to_id"),
            F.when(kind != 3, x["labels"]).alias("labels"),
            F.when(kind == 1, F.lit(2.0)).otherwise(x["positivity"]).alias("positivity"),
            F.when(kind == 2, F.lit(0)).otherwise(x["evidence_count"]).alias("evidence_count"),
            x["reason"].alias("reason"),
        )

    spoiled = records.withColumns(
        {
            "contract_version": F.when(kind == 0, F.lit("v0")).otherwise(C("contract_version")),
            "chapter_idx": F.when(kind != 5, C("chapter_idx")),
            "event_ref": F.when(kind == 6, F.lit("chx")).otherwise(C("event_ref")),
            "items": F.transform("items", spoil),
        }
    )
    files = payloads.delta_json(spoiled).withColumn(
        "json",
        F.when(kind == 9, F.lit("{oops"))
        .when(kind == 7, F.regexp_replace("json", r'\{"weight":[0-9.]+\}', "null"))
        .otherwise(C("json")),
    )
    twice = files.withColumn("copy", F.explode(F.when(kind == 10, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    # The records are spread by their event, which is the upload, and stay where they are.
    return twice.select(C("event_id").alias("upload_id"), "book_id", F.concat_ws("-", "event_id", "copy").alias("file"), "json")


def deltas(v: Views):
    return ingest.deltas(delta_uploads(v), v.event, v.character)


def _register_reason(name: str, sql: str) -> None:
    @query(name, sql, item=ITEM)
    def _(v: Views):
        return deltas(v)["rejects"].filter(C("reason").startswith(PREFIX[name])).select("upload_id").distinct()


for _name, _sql in REASONS.items():
    _register_reason(_name, _sql)


@query(
    "src_5_delta_ingest",
    """SELECT event_id, from_id, to_id, evidence_count AS interaction_count, CAST(CAST(positivity AS FLOAT) AS DOUBLE) AS sentiment, explanation
       FROM item WHERE event_id NOT IN (SELECT upload_id FROM rejected)""",
    item=ITEM,
    rejected=REJECTED,
)
def delta_ingest(v: Views):
    return deltas(v)["edges"].select(
        "event_id", "from_id", "to_id", "interaction_count", C("sentiment_score").cast("double").alias("sentiment"), "explanation"
    )


@query(
    "mu_19_all_or_nothing",
    "SELECT upload_id, upload_id // 128 AS book_id FROM rejected",
    item=ITEM,
    rejected=REJECTED,
)
def _(v: Views):
    return deltas(v)["rejected_uploads"]


@query(
    "mu_7_replace_by_event",
    """SELECT event_id, character_id, node_weight, 'new' AS origin FROM story_stat
         WHERE event_id NOT IN (SELECT upload_id FROM rejected)
       UNION ALL SELECT event_id, character_id, 1.5, 'old' FROM story_stat WHERE event_id IN (SELECT upload_id FROM rejected)""",
    item=ITEM,
    rejected=REJECTED,
)
def _(v: Views):
    done = deltas(v)
    old = v.stat.select("event_id", "character_id", F.lit(1.5).alias("node_weight"), F.lit("old").alias("origin"))
    new = done["stats"].select("event_id", "character_id", "node_weight", F.lit("new").alias("origin"))
    return ingest.replace_by_event(old, new, done["replaced_events"])


@query(
    "jn_21_reference_check",
    """SELECT e.id FROM story_edge e LEFT JOIN story_character c ON c.book_id = e.book_id AND c.character_id = e.to_id + 20 WHERE c.id IS NULL""",
)
def _(v: Views):
    rows = v.edge.select("id", "book_id", (C("to_id") + 20).alias("character_id"))
    return quality.flag_unknown(rows, v.character, ["book_id", "character_id"], "unknown").filter("unknown").select("id")


@query("ag_22_duplicate_detection", "SELECT l_orderkey, l_linenumber, count(*) AS times FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(v: Views):
    return quality.duplicates(v.table("lineitem"), ["l_orderkey", "l_linenumber"])


# ------------------------------------------------------------- event uploads

DOC = """SELECT doc_id, doc_id // 8 AS book_id, CAST(doc_id % 8 + 1 AS INT) AS chapter_idx, replace(text, chr(10), '') AS text,
    CAST(length(replace(text, chr(10), '')) AS INT) AS total FROM documents"""
EVENT_ITEM = """SELECT doc_id, book_id, chapter_idx, CAST(i AS INT) AS idx, CAST((i - 1) * 100 AS INT) AS start_txt,
    CAST(least(i * 100, total) AS INT) AS end_txt, substring(text, (i - 1) * 100 + 1, 100) AS raw_text
    FROM (SELECT *, unnest(range(1, (total + 99) // 100 + 1)) AS i FROM doc)"""
# One blank window spoils its whole upload.
EVENT_BAD = """SELECT doc_id FROM doc WHERE total > 0 AND (doc_id % 9 IN (0, 1, 3, 4, 5) OR (doc_id % 9 = 2 AND total > 100))
    UNION SELECT doc_id FROM event_item WHERE regexp_full_match(raw_text, '\\s*')"""


def event_parts(v: Views):
    def chapters_of(rows):
        return rows.select(
            "doc_id",
            F.expr("doc_id div 8").alias("book_id"),
            F.expr("int(doc_id % 8 + 1)").alias("idx"),
            F.replace(C("text"), F.lit("\n"), F.lit("")).alias("text"),
            F.transform(F.split("text", "\n"), lambda x: F.length(x)).alias("lengths"),
        )

    # Only the files are spread before they are made; chapters and texts move when they are looked up.
    docs = chapters_of(v.table("documents"))
    spread_docs = chapters_of(v.table("documents").repartition("doc_id"))
    sums = F.aggregate(
        "lengths",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["starts"], a["at"]).alias("starts")),
        lambda a: a["starts"],
    )
    chapters = docs.select(
        C("doc_id").alias("chapter_id"), "book_id", "idx", sums.alias("starts"), "lengths", F.length("text").alias("total_code_points")
    )
    kind = C("doc_id") % 9
    windows = F.regexp_extract_all("text", F.lit("(?s)(.{1,100})"), F.lit(1))

    def item(window, position):
        i = position + F.lit(1)
        start, end = position * 100, position * 100 + F.length(window)
        first = position == 0
        return F.struct(
            F.when((kind == 3) & first, F.lit(99)).alias("chapterIndex"),
            F.concat(F.lit("ch"), C("idx").cast("string"), F.lit("-e"), F.when((kind == 2) & (i == 2), F.lit(1)).otherwise(i).cast("string")).alias("eventId"),
            F.when((kind == 1) & first, end).otherwise(start).alias("start"),
            F.when((kind == 5) & first, F.length("text") + 5).otherwise(end).alias("endTxtOffset"),
            F.when((kind == 0) & first, F.lit("another text")).otherwise(window).alias("eventText"),
        )

    items = F.when(F.length("text") > 0, F.transform(windows, item))
    uploads = spread_docs.select(
        C("doc_id").alias("upload_id"),
        "book_id",
        C("doc_id").cast("string").alias("file"),
        F.to_json(F.struct(C("idx").alias("chapterIndex"), items.alias("items"))).alias("json"),
    )
    existing = docs.filter(kind == 4).select(C("doc_id").alias("chapter_id"))
    return uploads, chapters, docs.select("book_id", "idx", "text"), existing


def uploaded_events(v: Views):
    uploads, chapters, texts, existing = event_parts(v)
    return ingest.events(uploads, chapters, texts, existing)


@query(
    "src_3_event_ingest",
    """SELECT doc_id AS chapter_id, idx, 'ch' || chapter_idx || '-e' || idx AS event_id, start_txt, end_txt, md5(raw_text) AS digest
       FROM event_item WHERE doc_id NOT IN (SELECT doc_id FROM event_bad)""",
    doc=DOC,
    event_item=EVENT_ITEM,
    event_bad=EVENT_BAD,
)
def event_ingest(v: Views):
    return uploaded_events(v)["events"].select(
        "chapter_id", "idx", "event_id", "start_txt", "end_txt", F.md5("raw_text").alias("digest")
    )


def _register_event_reason(name: str, prefix: str, sql: str) -> None:
    @query(name, sql, doc=DOC, event_item=EVENT_ITEM)
    def _(v: Views):
        return uploaded_events(v)["rejects"].filter(C("reason").startswith(prefix)).select("upload_id").distinct()


_register_event_reason("dq_8_event_offsets", "DQ-8 ", "SELECT doc_id AS upload_id FROM doc WHERE total > 0 AND doc_id % 9 = 1")
_register_event_reason("dq_9_event_text", "DQ-9 ", "SELECT doc_id AS upload_id FROM doc WHERE total > 0 AND doc_id % 9 IN (0, 5)")
_register_event_reason("dq_12_already_there", "DQ-12 ", "SELECT doc_id AS upload_id FROM doc WHERE doc_id % 9 = 4")
_register_event_reason("dq_11_event_index_unique", "DQ-11 ", "SELECT doc_id AS upload_id FROM doc WHERE total > 100 AND doc_id % 9 = 2")


@query(
    "jn_13_chapters_already_filled",
    "SELECT chapter_id FROM story_chapter WHERE chapter_id IN (SELECT chapter_id FROM story_summary)",
)
def _(v: Views):
    return v.chapter.join(v.summary.select("chapter_id"), "chapter_id", "left_semi").select("chapter_id")


@query(
    "snk_3_event_append",
    """SELECT doc_id AS chapter_id, count(*) AS events, CAST(sum(end_txt) AS BIGINT) AS ends FROM event_item
       WHERE doc_id NOT IN (SELECT doc_id FROM event_bad) GROUP BY 1""",
    doc=DOC,
    event_item=EVENT_ITEM,
    event_bad=EVENT_BAD,
)
def _(v: Views):
    import uuid

    from plotweave.session import shared_folder

    path = f"{shared_folder(v.spark)}/events-{uuid.uuid4().hex}"
    uploaded_events(v)["events"].write.mode("append").parquet(path)
    return v.spark.read.parquet(path).groupBy("chapter_id").agg(F.count("*").alias("events"), F.sum("end_txt").alias("ends"))


# ------------------------------------------------------------ roster uploads

ROSTER_BAD = "SELECT DISTINCT c_custkey // 25 AS book_id FROM customer WHERE c_custkey % 130 = 13 OR c_custkey % 190 = 17"


def roster_uploads(v: Views):
    """Twenty-five customers are the cast of one book, so an upload has 25 items."""
    item = F.struct(
        "c_custkey",
        F.expr("if(c_custkey % 130 = 13, 'x1', concat('c00', c_custkey % 25 + 1))").alias("characterId"),
        F.expr("if(c_custkey % 2 = 0, c_name, null)").alias("commonName"),
        F.expr("if(c_custkey % 2 = 1, c_name, null)").alias("common_name"),
        F.expr("array(c_name, ' ', c_mktsegment, c_name)").alias("names"),
        F.expr("c_custkey % 6 = 0").alias("main_character"),
        F.expr("if(c_custkey % 3 = 0, map('ko', c_mktsegment), map('ko', ' '))").alias("descriptions"),
        F.concat(F.lit("about "), "c_name").alias("description_ko"),
        F.expr("if(c_custkey % 190 = 17, ' ', concat(' prompt ', c_custkey))").alias("portrait_prompt"),
    )
    body = F.struct(
        F.concat(F.lit(" style "), C("book_id").cast("string")).alias("book_prompt"),
        F.collect_list(item).alias("characters"),
    )
    return (
        v.table("customer")
        .withColumn("book_id", F.expr("c_custkey div 25"))
        .groupBy("book_id")
        .agg(F.to_json(body).alias("json"))
        .select(C("book_id").alias("upload_id"), "book_id", C("book_id").cast("string").alias("file"), "json")
    )


def rostered(v: Views):
    existing = v.table("customer").selectExpr("c_custkey div 25 AS book_id", "c_custkey % 25 + 1 AS character_id").filter(
        "character_id % 5 = 0"
    )
    return ingest.roster(roster_uploads(v), existing)


@query(
    "src_2_roster_ingest",
    """SELECT c_custkey // 25 AS book_id, c_custkey % 25 + 1 AS character_id, c_name AS name, c_name || ',' || c_mktsegment AS names,
         c_custkey % 6 = 0 AS is_main, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'about ' || c_name END AS personality_text,
         'prompt ' || c_custkey AS profile_text, 1 AS first_chapter_idx, 'PENDING' AS image_status
       FROM customer WHERE (c_custkey % 25 + 1) % 5 <> 0 AND c_custkey // 25 NOT IN (SELECT book_id FROM roster_bad)""",
    roster_bad=ROSTER_BAD,
)
def roster_ingest(v: Views):
    return rostered(v)["characters"]


@query(
    "jn_12_new_characters_only",
    """SELECT c_custkey // 25 AS book_id, count(*) AS fresh FROM customer WHERE (c_custkey % 25 + 1) % 5 <> 0
         AND c_custkey // 25 NOT IN (SELECT book_id FROM roster_bad) GROUP BY 1""",
    roster_bad=ROSTER_BAD,
)
def _(v: Views):
    return rostered(v)["characters"].groupBy("book_id").agg(F.count("*").alias("fresh"))


@query("dq_14_required_fields", "SELECT book_id AS upload_id FROM roster_bad", roster_bad=ROSTER_BAD)
def _(v: Views):
    return rostered(v)["rejects"].filter(C("reason").startswith("DQ-14 ")).select("upload_id").distinct()


# ----------------------------------------------------------- summary uploads

SUMMARY_FILE = """SELECT chapter_id, book_id, count(*) AS items, bool_or(id % 41 = 3) AS blank_text,
    bool_or(id % 37 = 5) AS blank_id FROM story_summary GROUP BY 1, 2"""


def summary_uploads(v: Views):
    """One file per chapter; the customers of one chapter are few by arithmetic."""
    item = F.struct(
        "id",
        F.when(C("id") % 37 == 5, F.lit(" ")).otherwise(F.concat(F.lit("c"), (C("char_id") % 100).cast("string"))).alias("characterId"),
        F.when(C("id") % 41 == 3, F.lit(" ")).otherwise(C("summary_text")).alias("summary"),
    )
    body = F.struct(
        F.expr("int(chapter_id % 8 + 1)").alias("chapterIndex"),
        F.expr("element_at(array('ko', null, 'KO', 'en'), int(chapter_id % 4) + 1)").alias("language"),
        F.array_sort(F.collect_list(item)).alias("items"),
    )
    return (
        v.summary.groupBy("book_id", "chapter_id")
        .agg(F.to_json(body).alias("json"))
        .select(C("chapter_id").alias("upload_id"), "book_id", C("chapter_id").cast("string").alias("file"), "json")
    )


def summarized(v: Views):
    existing = v.chapter.filter("chapter_id % 10 = 9").select("chapter_id")
    return ingest.summaries(summary_uploads(v), v.chapter, v.character, existing)


KNOWN = "EXISTS (SELECT 1 FROM story_chapter h WHERE h.chapter_id = f.chapter_id)"


@query(
    "src_4_summary_ingest",
    f"""SELECT s.chapter_id, s.char_id, s.summary_text FROM story_summary s JOIN summary_file f USING (chapter_id)
        WHERE s.chapter_id % 4 <> 3 AND s.chapter_id % 10 <> 9 AND NOT blank_text AND NOT blank_id AND {KNOWN}""",
    summary_file=SUMMARY_FILE,
)
def summary_ingest(v: Views):
    return summarized(v)["summaries"].select("chapter_id", "char_id", "summary_text")


@query(
    "flt_14_summary_language",
    "SELECT chapter_id AS upload_id, items FROM summary_file WHERE chapter_id % 4 <> 3",
    summary_file=SUMMARY_FILE,
)
def _(v: Views):
    return payloads.parse_summaries(summary_uploads(v)).groupBy("upload_id").agg(F.count("item_no").alias("items"))


@query(
    "dq_13_summary_items",
    "SELECT chapter_id AS upload_id FROM summary_file WHERE chapter_id % 4 <> 3 AND (blank_text OR blank_id)",
    summary_file=SUMMARY_FILE,
)
def _(v: Views):
    return summarized(v)["rejects"].filter(C("reason").startswith("DQ-13 ")).select("upload_id").distinct()


# ------------------------------------------------------------- request rules


@query(
    "dq_16_locators",
    """SELECT p.event_id, CASE WHEN p.event_id % 11 = 0 THEN 'DQ-16 partial'
         WHEN h.starts IS NULL OR p.block_idx >= 4 OR p."offset" > h.lengths[p.block_idx + 1] THEN 'DQ-16 bounds' ELSE '' END AS reasons
       FROM progress p LEFT JOIN story_chapter h ON h.book_id = p.book_id AND h.idx = p.chapter_idx""",
)
def _(v: Views):
    asked = v.progress.withColumn("block_idx", F.when(C("event_id") % 11 != 0, C("block_idx")))
    placed = positions.locator_offsets(asked, v.chapter)
    return quality.with_reasons(placed, quality.locator_rules()).select("event_id", F.array_join("reasons", "|").alias("reasons"))


@query(
    "dq_17_bookmark_fields",
    """SELECT id, concat_ws('|', CASE WHEN id % 7 = 0 AND end_txt IS NOT NULL THEN 'DQ-17 order' END, CASE WHEN id % 5 = 0 THEN 'DQ-17 chapters' END,
         CASE WHEN id % 3 = 0 THEN 'DQ-17 color' END, CASE WHEN id % 13 = 0 AND memo IS NOT NULL THEN 'DQ-17 memo' END) AS reasons FROM bookmark""",
)
def _(v: Views):
    rows = v.bookmark.withColumns(
        {
            "end_txt": F.when((C("id") % 7 == 0) & C("end_txt").isNotNull(), C("start_txt")).otherwise(C("end_txt")),
            "start_chapter_idx": F.lit(1),
            "end_chapter_idx": F.when(C("id") % 5 == 0, F.lit(2)).otherwise(F.lit(1)),
            "color": F.when(C("id") % 3 == 0, F.lit("red")).otherwise(C("color")),
            "memo": F.when(C("id") % 13 == 0, F.repeat(C("memo"), F.lit(200))).otherwise(C("memo")),
        }
    )
    return quality.with_reasons(rows, quality.bookmark_rules()).select("id", F.array_join("reasons", "|").alias("reasons"))


@query(
    "dq_18_slices",
    """SELECT event_id, CASE WHEN k % 3 = 0 THEN 'DQ-18 together' WHEN k % 3 = 1 AND k > 50 THEN 'DQ-18 order' ELSE '' END AS reasons FROM activity""",
)
def _(v: Views):
    rows = v.activity.select(
        "event_id",
        F.lit("ch1-e1").alias("from_ref"),
        F.when(C("k") % 3 != 0, F.lit("ch2-e1")).alias("to_ref"),
        C("k").alias("from_ordinal"),
        F.when(C("k") % 3 == 1, F.lit(50)).otherwise(C("k")).alias("to_ordinal"),
    )
    return quality.with_reasons(rows, quality.slice_rules()).select("event_id", F.array_join("reasons", "|").alias("reasons"))


@query(
    "dq_20_parameter_values",
    """SELECT event_id, (['book', 'chapter', NULL, 'book'])[k % 4 + 1] AS scope, (['time_desc', 'time_asc', NULL])[k % 3 + 1] AS sort FROM activity""",
)
def _(v: Views):
    from plotweave.functions import status

    scope = F.expr("element_at(array(' ', 'CHAPTER', 'page', null), k % 4 + 1)")
    sort = F.expr("element_at(array('', ' Time_Asc ', 'newest'), k % 3 + 1)")
    return v.activity.select("event_id", status.graph_scope(scope).alias("scope"), status.bookmark_sort(sort).alias("sort"))
