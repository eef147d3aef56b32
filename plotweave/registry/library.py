"""Catalog, manifests, sorts, limits, existence checks, sources and sinks."""

from pyspark.sql import functions as F

from plotweave.functions import status
from plotweave.operators import catalog, graph
from plotweave.plans.nest import joined
from plotweave.registry.base import query
from plotweave.sources import artifacts
from plotweave.sources.tables import table_counts
from plotweave.views import CURRENT_LOCATOR, CURRENT_RULE, Views

C = F.col
READER = 7
VERSION = """CASE WHEN normalization_status <> 'READY' THEN 'NOT_READY'
    WHEN rule_version = 'rule-2' AND locator_version = 'loc-2' THEN 'CURRENT' ELSE 'OUTDATED' END"""


def own(v: Views):
    """All readers' favorites; a request passes those of one reader."""
    return v.favorite


@query("src_1_fixed_schema_scan", "SELECT o_orderstatus, count(*) AS row_count, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def _(v: Views):
    declared = "o_orderkey long, o_custkey long, o_orderstatus string"
    rows = v.spark.read.schema(declared).parquet(f"{v.folder}/orders.parquet")
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("row_count"), F.sum("o_custkey").alias("keys"))


@query(
    "prj_1_catalog",
    f"""SELECT b.book_id, title, author, normalization_status, analysis_status, rule_version, locator_version, run_id, artifact_path,
         is_default, summary, updated_at, {VERSION} AS version_status, {VERSION} = 'OUTDATED' AS needs_renormalization,
         f.book_id IS NOT NULL AS is_favorite
       FROM book b LEFT JOIN (SELECT DISTINCT book_id FROM favorite) f ON f.book_id = b.book_id
       WHERE normalization_status = 'READY'""",
)
def catalog_rows(v: Views):
    return catalog.catalog(v.book, own(v), CURRENT_RULE, CURRENT_LOCATOR).drop("language", "uploaded_by")


# Readers open the books of their orders and the ones next to them.
OPENED = """SELECT DISTINCT o_custkey AS user_id, l_partkey - l_partkey % 3 + 1 AS book_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""
READER_ROW = f"""SELECT o.user_id, b.book_id, title, author, language, normalization_status, analysis_status, rule_version, locator_version, run_id,
         artifact_path, is_default, summary, updated_at, {VERSION} AS version_status, {VERSION} = 'OUTDATED' AS needs_renormalization,
         f.user_id IS NOT NULL AS is_favorite
       FROM opened o JOIN book b ON b.book_id = o.book_id AND normalization_status = 'READY'
       LEFT JOIN favorite f ON f.user_id = o.user_id AND f.book_id = o.book_id"""


@query("prj_1_reader_catalog", READER_ROW, opened=OPENED)
def _(v: Views):
    lines = v.table("lineitem").selectExpr("l_orderkey AS o_orderkey", "l_partkey - l_partkey % 3 + 1 AS book_id")
    opened = v.table("orders").selectExpr("o_orderkey", "o_custkey AS user_id").join(lines, "o_orderkey", "inner")
    return catalog.reader_catalog(opened, v.book, v.favorite, CURRENT_RULE, CURRENT_LOCATOR).drop("uploaded_by")


@query(
    "flt_4_favorites_of_each_reader",
    """SELECT f.user_id, b.book_id, title, updated_at FROM favorite f JOIN book b ON b.book_id = f.book_id AND normalization_status = 'READY'""",
)
def _(v: Views):
    rows = catalog.reader_favorite_catalog(v.book, v.favorite, CURRENT_RULE, CURRENT_LOCATOR)
    return rows.filter("is_favorite").select("user_id", "book_id", "title", "updated_at")


@query(
    "prj_6_manifest_chapters",
    """SELECT c.chapter_id, c.title, count(v.id) AS events, string_agg(v.event_id, '|' ORDER BY v.idx) AS event_ids,
         CAST(sum(length(CASE WHEN length(t) <= 300 THEN t ELSE substring(t, 1, 297) || '...' END)) AS BIGINT) AS shown
       FROM story_chapter c JOIN book b ON b.book_id = c.book_id AND b.normalization_status = 'READY'
       LEFT JOIN (SELECT *, trim(regexp_replace(raw_text, '\\s+', ' ', 'g')) AS t FROM story_event) v
         ON v.chapter_id = c.chapter_id AND b.analysis_status = 'READY'
       GROUP BY 1, 2""",
)
def manifest(v: Views):
    rows = catalog.manifest_chapters(v.book, v.chapter, v.event)
    entries = C("events")
    lengths = F.transform(entries, lambda e: F.length(e["rawText"]).cast("bigint"))
    # A long chapter comes in several parts.
    return rows.groupBy("chapter_id", "title").agg(
        F.sum(F.when(entries.isNotNull(), F.size(entries)).otherwise(0)).cast("bigint").alias("events"),
        joined(F.array_join(F.transform(entries, lambda e: e["eventId"]), "|")).alias("event_ids"),
        F.sum(F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("shown"),
    )


@query(
    "prj_7_admin_rows",
    """SELECT c.chapter_id, c.title, c.book_id, b.title AS book_title FROM story_chapter c JOIN book b USING (book_id)
       WHERE NOT c.summarized""",
)
def _(v: Views):
    return catalog.unsummarized_chapters(v.chapter, v.book)


@query("prj_9_admin_characters", "SELECT id, CAST(character_id AS VARCHAR) AS character_id, name, profile_image, image_status FROM story_character")
def _(v: Views):
    return v.character.select("id", C("character_id").cast("string").alias("character_id"), "name", "profile_image", "image_status")


SUMMARY_ROWS = """SELECT s.id, s.book_id, h.idx AS chapter_idx, h.title AS chapter_title, c.character_id, c.name, c.is_main, s.summary_text
       FROM story_summary s JOIN book b ON b.book_id = s.book_id AND b.normalization_status = 'READY' AND b.analysis_status = 'READY'
       JOIN story_character c ON c.id = s.char_id JOIN story_chapter h ON h.chapter_id = s.chapter_id"""


@query("prj_10_summary_rows", SUMMARY_ROWS)
def _(v: Views):
    return catalog.summary_rows(v.summary, v.character, v.chapter, v.book)


@query(
    "jn_4_summary_character_chapter",
    """SELECT s.id, c.name, h.title FROM story_summary s JOIN story_character c ON c.id = s.char_id
       JOIN story_chapter h ON h.chapter_id = s.chapter_id""",
)
def _(v: Views):
    people = v.character.select(C("id").alias("char_id"), "name")
    return v.summary.join(people, "char_id", "inner").join(v.chapter.select("chapter_id", "title"), "chapter_id", "inner").select("id", "name", "title")


@query("flt_1_ready_books", "SELECT book_id FROM book WHERE normalization_status = 'READY'")
def _(v: Views):
    return catalog.ready(v.book).select("book_id")


@query(
    "flt_2_keyword",
    "SELECT book_id FROM book WHERE contains(lower(title), 'ring') OR contains(lower(author), 'ring') OR contains(lower(author), 'brand#1')",
)
def _(v: Views):
    return catalog.matching(v.book, "RING").unionByName(catalog.matching(v.book, "Brand#1")).select("book_id").distinct()


@query("flt_3_language", "SELECT book_id FROM book WHERE lower(language) = 'promo'")
def _(v: Views):
    return catalog.in_language(v.book, "Promo").select("book_id")


@query("flt_4_favorites_only", "SELECT book_id FROM book WHERE book_id IN (SELECT book_id FROM favorite)")
def _(v: Views):
    return catalog.favorites_only(v.book, own(v)).select("book_id")


@query(
    "flt_5_accessible_books",
    "SELECT book_id FROM book WHERE (is_default AND normalization_status = 'READY') OR uploaded_by = 7",
)
def _(v: Views):
    return catalog.accessible(v.book, 7).select("book_id")


@query(
    "flt_6_readable_requests",
    """SELECT p.position_id, coalesce(b.normalization_status = 'READY', false) AS readable FROM position p LEFT JOIN book b USING (book_id)""",
)
def _(v: Views):
    return v.position.join(v.book.select("book_id", "normalization_status"), "book_id", "left").select(
        "position_id", F.coalesce(C("normalization_status") == "READY", F.lit(False)).alias("readable")
    )


@query(
    "flt_7_analysis_gate",
    """SELECT e.id FROM story_edge e JOIN book b USING (book_id) WHERE b.normalization_status = 'READY' AND b.analysis_status = 'READY'""",
)
def _(v: Views):
    return v.edge.join(catalog.analysis_ready(v.book).select("book_id"), "book_id", "left_semi").select("id")


@query("flt_8_unsummarized_books", "SELECT book_id, title FROM book WHERE NOT summary AND normalization_status = 'READY'")
def _(v: Views):
    return catalog.unsummarized_books(v.book).select("book_id", "title")


@query("flt_9_unsummarized_chapters", "SELECT chapter_id FROM story_chapter WHERE NOT summarized")
def _(v: Views):
    return v.chapter.filter(~C("summarized")).select("chapter_id")


@query(
    "flt_10_status_in_list",
    """SELECT id, 'asset' AS kind FROM asset WHERE status IN ('FAILED', 'QA_FAILED', 'REVIEW_REQUIRED')
       UNION ALL SELECT id, 'job' FROM job WHERE status IN ('QUEUED', 'PROCESSING')""",
)
def _(v: Views):
    failed = v.asset.filter(C("status").isin(status.RETRYABLE)).select("id", F.lit("asset").alias("kind"))
    active = v.job.filter(C("status").isin(status.ACTIVE_JOB_STATUSES)).select("id", F.lit("job").alias("kind"))
    return failed.unionByName(active)


@query(
    "flt_16_strict_readiness",
    """SELECT b.book_id, coalesce(trim(b.locator_version), '') <> '' AS version_ready, coalesce(c.ok, true) AS chapters_ready,
         coalesce(v.ok, true) AS events_ready
       FROM book b LEFT JOIN (SELECT book_id, bool_and(starts IS NOT NULL AND total_code_points IS NOT NULL) AS ok FROM story_chapter GROUP BY 1) c USING (book_id)
       LEFT JOIN (SELECT book_id, bool_and(start_block IS NOT NULL AND end_offset IS NOT NULL) AS ok FROM story_event GROUP BY 1) v USING (book_id)""",
)
def _(v: Views):
    return catalog.strict_readiness(v.book, v.chapter, v.event)


@query(
    "flt_17_publishable_assets",
    """SELECT id, status IN ('QA_PASSED', 'APPROVED', 'PUBLISHED') AS publishable, url IS NOT NULL AND trim(url) <> '' AS has_image FROM asset""",
)
def _(v: Views):
    return v.asset.select("id", status.is_publishable(C("status")).alias("publishable"), status.has_image(C("url")).alias("has_image"))


@query(
    "flt_18_bookmark_kind",
    "SELECT id, CASE WHEN end_txt IS NULL THEN 'point' ELSE 'range' END AS kind, user_id = 7 AS own FROM bookmark",
)
def _(v: Views):
    from plotweave.operators.state import bookmark_kind

    return v.bookmark.select("id", bookmark_kind(C("end_txt")).alias("kind"), (C("user_id") == READER).alias("own"))


@query("jn_5_chapter_book", "SELECT c.chapter_id, b.title, b.author FROM story_chapter c JOIN book b USING (book_id)")
def _(v: Views):
    return v.chapter.select("chapter_id", "book_id").join(v.book.select("book_id", "title", "author"), "book_id", "inner").drop("book_id")


LENGTH_SQL = """SELECT c.book_id, c.chapter_id, c.idx, coalesce(c.total_code_points, max(v.end_txt), 0) AS length
    FROM story_chapter c LEFT JOIN story_event v ON v.chapter_id = c.chapter_id GROUP BY 1, 2, 3, c.total_code_points"""


@query("jn_6_chapter_events_left", LENGTH_SQL)
def _(v: Views):
    return catalog.chapter_lengths(v.chapter, v.event)


@query("ag_1_chapter_length", LENGTH_SQL.replace("c.book_id, c.chapter_id, c.idx,", "c.chapter_id,").replace("GROUP BY 1, 2, 3,", "GROUP BY 1,"))
def _(v: Views):
    return catalog.chapter_lengths(v.chapter, v.event).select("chapter_id", "length")


@query("ag_2_max_chapter", "SELECT b.book_id, coalesce(max(c.idx), 0) AS max_chapter FROM book b LEFT JOIN story_chapter c USING (book_id) GROUP BY 1")
def _(v: Views):
    return catalog.book_lengths(v.book, catalog.chapter_lengths(v.chapter, v.event)).select("book_id", "max_chapter")


@query(
    "ag_3_total_length",
    "SELECT b.book_id, CAST(coalesce(sum(l.length), 0) AS BIGINT) AS total_length FROM book b LEFT JOIN len l USING (book_id) GROUP BY 1",
    len=LENGTH_SQL,
)
def _(v: Views):
    return catalog.book_lengths(v.book, catalog.chapter_lengths(v.chapter, v.event)).select("book_id", "total_length")


@query(
    "ag_10_events_per_chapter",
    """SELECT book_id, chapter_idx, count(*) AS events, string_agg(event_id || '@' || start_txt, '|' ORDER BY idx) AS listed FROM story_event GROUP BY 1, 2""",
)
def _(v: Views):
    rows = catalog.nested_events(v.event)
    listed = F.transform("events", lambda e: F.concat(e["eventId"], F.lit("@"), e["startTxtOffset"].cast("string")))
    return rows.groupBy("book_id", "chapter_idx").agg(
        F.sum(F.size("events")).cast("bigint").alias("events"), joined(F.array_join(listed, "|")).alias("listed")
    )


@query("ag_12_favorites_per_user", "SELECT user_id, count(*) AS books, CAST(sum(book_id) AS BIGINT) AS checksum FROM favorite GROUP BY 1")
def _(v: Views):
    return v.favorite.groupBy("user_id").agg(F.count("*").alias("books"), F.sum("book_id").alias("checksum"))


@query("jn_9_catalog_favorites", f"SELECT b.book_id, f.book_id IS NOT NULL AS is_favorite FROM book b LEFT JOIN (SELECT DISTINCT book_id FROM favorite) f USING (book_id)")
def _(v: Views):
    return catalog.favorite_flags(v.book, own(v)).select("book_id", "is_favorite")


@query(
    "jn_11_existence_flags",
    """SELECT c.chapter_id, c.chapter_id IN (SELECT chapter_id FROM story_summary) AS has_summary,
         c.chapter_id IN (SELECT v.chapter_id FROM story_edge e JOIN story_event v ON v.id = e.event_id) AS has_edges FROM story_chapter c""",
)
def _(v: Views):
    summary = v.summary.select("chapter_id").distinct().withColumn("_s", F.lit(True))
    with_edges = v.event.join(v.edge.select(C("event_id").alias("id")), "id", "left_semi").select("chapter_id").distinct().withColumn("_e", F.lit(True))
    return (
        v.chapter.join(summary, "chapter_id", "left")
        .join(with_edges, "chapter_id", "left")
        .select("chapter_id", C("_s").isNotNull().alias("has_summary"), C("_e").isNotNull().alias("has_edges"))
    )


@query(
    "jn_24_character_book_prompt",
    """SELECT c.id, c.name, b.title FROM story_character c JOIN book b USING (book_id)""",
)
def _(v: Views):
    return v.character.select("id", "name", "book_id").join(v.book.select("book_id", "title"), "book_id", "inner").drop("book_id")


@query(
    "jn_26_favorites_readable",
    "SELECT f.user_id, f.book_id, b.title FROM favorite f JOIN book b USING (book_id) WHERE b.normalization_status = 'READY'",
)
def _(v: Views):
    return catalog.reader_favorites(v.favorite, v.book).select("user_id", "book_id", "title")


TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
TABLE_UNION = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, count(*) > 0 AS filled FROM {t}"
    for t in TABLES
)


@query("ag_24_table_counts", TABLE_UNION)
def _(v: Views):
    return table_counts({t: v.table(t) for t in TABLES})


@query("st_1_catalog_sort", "SELECT book_id, lower(title) AS title FROM book ORDER BY lower(title), book_id")
def _(v: Views):
    return catalog.sorted_catalog(v.book, "title").select("book_id", F.lower("title").alias("title"))


@query("st_2_character_sort", "SELECT id, name, is_main FROM story_character ORDER BY book_id, is_main DESC, name, id")
def _(v: Views):
    return catalog.sorted_characters(v.character).select("id", "name", "is_main")


@query("st_3_event_sort", "SELECT id, chapter_idx, idx FROM story_event ORDER BY book_id, chapter_idx, idx, id")
def _(v: Views):
    return catalog.sorted_events(v.event).select("id", "chapter_idx", "idx")


@query("st_4_summary_sort", SUMMARY_ROWS + " ORDER BY s.book_id, h.idx, c.is_main DESC, c.name, s.id")
def _(v: Views):
    rows = catalog.summary_rows(v.summary, v.character, v.chapter, v.book)
    return rows.orderBy("book_id", "chapter_idx", F.desc("is_main"), "name", "id")


@query("st_5_bookmark_sort", "SELECT id, created_at FROM bookmark ORDER BY created_at DESC, id DESC")
def _(v: Views):
    return v.bookmark.select("id", "created_at").orderBy(F.desc("created_at"), F.desc("id"))


@query(
    "st_7_recent_jobs",
    "SELECT id, book_id, status, created_at FROM job WHERE pipeline_type = 'NORMALIZATION' ORDER BY created_at DESC, id DESC LIMIT 20",
)
def _(v: Views):
    return (
        v.job.filter(C("pipeline_type") == "NORMALIZATION")
        .select("id", "book_id", "status", "created_at")
        .orderBy(F.desc("created_at"), F.desc("id"))
        .limit(20)
    )


@query(
    "st_8_recent_logs",
    """SELECT l.id, l.job_id, b.title AS book_title, l.step FROM (SELECT * FROM job_log ORDER BY id DESC LIMIT 40) l
       JOIN job j ON j.id = l.job_id JOIN book b ON b.book_id = j.book_id""",
)
def _(v: Views):
    newest = v.job_log.orderBy(F.desc("id")).limit(40)
    jobs = v.job.select(C("id").alias("job_id"), "book_id")
    return (
        newest.join(jobs, "job_id", "inner")
        .join(v.book.select("book_id", C("title").alias("book_title")), "book_id", "inner")
        .select("id", "job_id", "book_title", "step")
    )


@query("st_9_logs_of_job", "SELECT job_id, id, level FROM job_log ORDER BY job_id, id")
def _(v: Views):
    return v.job_log.select("job_id", "id", "level").orderBy("job_id", "id")


@query("st_12_chapter_sort", "SELECT chapter_id, idx FROM story_chapter ORDER BY book_id, idx")
def _(v: Views):
    return v.chapter.orderBy("book_id", "idx").select("chapter_id", "idx")


@query(
    "prj_12_job_rows",
    """SELECT j.id, j.status, j.pipeline_type, b.title AS book_title FROM job j JOIN book b USING (book_id)""",
)
def _(v: Views):
    return v.job.join(v.book.select("book_id", C("title").alias("book_title")), "book_id", "inner").select(
        "id", "status", "pipeline_type", "book_title"
    )


@query(
    "snk_5_analysis_input",
    """SELECT c.book_id, count(*) AS chapters, string_agg(b.artifact_path || '/text/chapter_' || lpad(CAST(c.idx AS VARCHAR), 3, '0') || '.txt', '|' ORDER BY c.idx) AS paths
       FROM story_chapter c JOIN book b USING (book_id) WHERE b.normalization_status = 'READY' AND b.artifact_path IS NOT NULL AND trim(b.artifact_path) <> ''
       GROUP BY 1""",
)
def _(v: Views):
    rows = artifacts.analysis_input(v.book, v.chapter)
    return rows.groupBy("book_id").agg(
        F.sum(F.size("chapters")).cast("bigint").alias("chapters"),
        joined(F.array_join(F.transform("chapters", lambda c: c["txtPath"]), "|")).alias("paths"),
    )


@query(
    "src_8_chapter_text_scan",
    "SELECT doc_id // 8 AS book_id, CAST(doc_id % 8 + 1 AS INT) AS idx, md5(text) AS digest FROM documents",
)
def _(v: Views):
    """Chapter texts written as a table of an artifact run and read back."""
    from plotweave.session import shared_folder

    rows = v.table("documents").selectExpr("doc_id div 8 AS book_id", "int(doc_id % 8 + 1) AS chapter_idx", "text")
    import uuid

    path = f"{shared_folder(v.spark)}/chapter-texts-{uuid.uuid4().hex}"
    artifacts.chapter_artifacts(rows, "run-1").write.partitionBy("run_id").parquet(path)
    back = v.spark.read.parquet(path)
    return back.select(
        F.regexp_extract("text_path", r"books/(\d+)/", 1).cast("bigint").alias("book_id"),
        F.regexp_extract("text_path", r"chapter_(\d+)\.txt", 1).cast("int").alias("idx"),
        F.md5("text").alias("digest"),
    )


@query("wn_3_latest_asset", "SELECT char_id, id, status FROM asset QUALIFY row_number() OVER (PARTITION BY char_id ORDER BY created_at DESC, id DESC) = 1")
def _(v: Views):
    from plotweave.operators.images import latest_assets

    return latest_assets(v.asset).select("char_id", "id", "status")


@query("snapshot_graph_by_chapter", """SELECT t.book_id, l.chapter_idx AS upto, t.character_id, CAST(sum(n) AS BIGINT) AS stats FROM story_chapter c
       JOIN (SELECT book_id, chapter_idx, id FROM chapter_last) l ON l.book_id = c.book_id AND l.chapter_idx = c.idx
       JOIN (SELECT t.book_id, t.character_id, t.chapter_idx, count(node_weight) AS n FROM touch t JOIN chapter_last k ON k.id = t.event_id GROUP BY 1, 2, 3) t
         ON t.book_id = l.book_id AND t.chapter_idx <= l.chapter_idx GROUP BY 1, 2, 3""")
def _(v: Views):
    states = graph.snapshot_nodes(v.event, v.stat, v.edge)
    asked = v.event.select("book_id", C("chapter_idx").cast("bigint").alias("upto")).distinct()
    return graph.state_at(states, asked).select(
        "book_id", C("upto").cast("int").alias("upto"), "character_id", F.coalesce("count", F.lit(0)).cast("bigint").alias("stats")
    )
