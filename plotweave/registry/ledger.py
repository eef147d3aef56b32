"""Keyed tables: progress, bookmarks, favorites, books, chapters, jobs."""

from pyspark.sql import functions as F

from plotweave.functions import coords
from plotweave.operators import corpus, state
from plotweave.registry.base import query
from plotweave.views import Views

C = F.col

LAST = """SELECT * FROM progress QUALIFY row_number() OVER (PARTITION BY user_id, book_id ORDER BY "at" DESC, event_id DESC) = 1"""


@query("mu_1_progress_upsert", 'SELECT user_id, book_id, chapter_idx, block_idx, "offset", event_id FROM last', last=LAST)
def progress(v: Views):
    older = v.progress.filter(C("event_id") % 2 == 0)
    newer = v.progress.filter(C("event_id") % 2 == 1)
    return state.upsert(older, newer, state.READER, ["at", "event_id"]).select(
        "user_id", "book_id", "chapter_idx", "block_idx", "offset", "event_id"
    )


GONE = "SELECT DISTINCT user_id, CAST(k % 7 AS BIGINT) AS book_id FROM activity WHERE event_type = 'error' AND k < 30"


@query(
    "mu_2_progress_delete",
    """SELECT user_id, book_id, 'kept' AS outcome FROM last ANTI JOIN gone USING (user_id, book_id)
       UNION ALL SELECT user_id, book_id, 'missed' FROM gone ANTI JOIN last USING (user_id, book_id)""",
    last=LAST,
    gone=GONE,
)
def _(v: Views):
    gone = v.activity.filter("event_type = 'error' AND k < 30").selectExpr("user_id", "bigint(k % 7) AS book_id")
    kept, missed = state.delete(state.latest_progress(v.progress), gone, state.READER)
    left = kept.select(*state.READER, F.lit("kept").alias("outcome"))
    return left.unionByName(missed.select(*state.READER, F.lit("missed").alias("outcome")))


@query(
    "jn_25_progress_offsets",
    """SELECT l.user_id, l.book_id, b.locator_version, CASE WHEN h.starts IS NOT NULL AND l.block_idx < 4 AND l."offset" <= h.lengths[l.block_idx + 1]
         THEN h.starts[l.block_idx + 1] + l."offset" END AS start_txt
       FROM last l JOIN book b ON b.book_id = l.book_id AND b.normalization_status = 'READY'
       LEFT JOIN story_chapter h ON h.book_id = l.book_id AND h.idx = l.chapter_idx""",
    last=LAST,
)
def _(v: Views):
    view = state.progress_view(state.latest_progress(v.progress), v.book, v.chapter)
    return view.select("user_id", "book_id", "locator_version", "start_txt")


@query(
    "prj_11_bookmark_rows",
    """SELECT id, book_id, 1 || ':' || start_txt // 400 || ':' || start_txt % 400 AS start_locator, end_txt IS NOT NULL AS is_range, color, memo FROM bookmark""",
)
def _(v: Views):
    stored = coords.write_locator(F.lit(1), F.expr("start_txt div 400"), C("start_txt") % 400)
    read = coords.read_locator(stored)
    return v.bookmark.select(
        "id",
        "book_id",
        F.concat_ws(":", read["chapterIndex"], read["blockIndex"], read["offset"]).alias("start_locator"),
        (state.bookmark_kind(C("end_txt")) == "range").alias("is_range"),
        "color",
        "memo",
    )


@query(
    "jn_18_bookmark_overlap",
    """SELECT n.id FROM bookmark n WHERE n.id % 2 = 1 AND EXISTS (SELECT 1 FROM bookmark o WHERE o.id % 2 = 0 AND o.user_id = n.user_id AND o.book_id = n.book_id
         AND ((o.end_txt IS NULL AND n.end_txt IS NULL AND o.start_txt = n.start_txt) OR (o.start_txt < n.end_txt AND o.end_txt > n.start_txt)))""",
)
def bookmark_overlap(v: Views):
    rows = v.bookmark.select("id", "user_id", "book_id", "start_txt", "end_txt")
    return state.conflicts(rows.filter("id % 2 = 1"), rows.filter("id % 2 = 0")).select("id")


@query(
    "mu_3_bookmark_accept",
    "SELECT id, user_id, book_id, start_txt, end_txt FROM bookmark WHERE id IN (SELECT id FROM walk WHERE id IS NOT NULL)",
    request="SELECT *, row_number() OVER (PARTITION BY user_id, book_id ORDER BY id) AS k FROM bookmark",
    walk="""WITH RECURSIVE step AS (
        SELECT DISTINCT user_id, book_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(s BIGINT, e BIGINT)[]) AS held, CAST(NULL AS BIGINT) AS id FROM bookmark
        UNION ALL
        SELECT user_id, book_id, k, CASE WHEN free THEN list_append(held, {'s': s, 'e': e}) ELSE held END, CASE WHEN free THEN id END FROM (
          SELECT r.user_id, r.book_id, r.k, r.id, CAST(r.start_txt AS BIGINT) AS s, CAST(r.end_txt AS BIGINT) AS e, w.held,
            len(list_filter(w.held, lambda x: CASE WHEN x.e IS NULL OR r.end_txt IS NULL THEN x.e IS NULL AND r.end_txt IS NULL AND x.s = r.start_txt
              ELSE x.s < r.end_txt AND x.e > r.start_txt OR x.s = r.start_txt AND x.e = r.end_txt END)) = 0 AS free
          FROM step w JOIN request r ON r.user_id = w.user_id AND r.book_id = w.book_id AND r.k = w.k + 1))
      SELECT id FROM step""",
)
def accept_bookmarks(v: Views):
    """Arrival order decides; SQL walks the requests of each reader and book one after another."""
    rows = v.bookmark.select("id", "user_id", "book_id", "start_txt", "end_txt")
    return state.accept_bookmarks(rows)


@query(
    "mu_4_bookmark_patch",
    """SELECT b.id, CASE WHEN b.id % 4 = 0 THEN '#000000' ELSE b.color END AS color, CASE WHEN b.id % 4 = 1 THEN 'new' ELSE b.memo END AS memo FROM bookmark b""",
)
def _(v: Views):
    changes = v.bookmark.select(
        "id", F.when(C("id") % 4 == 0, "#000000").alias("color"), F.when(C("id") % 4 == 1, "new").alias("memo")
    ).filter("id % 4 < 2")
    return state.patch(v.bookmark, changes, ["id"], ["color", "memo"]).select("id", "color", "memo")


@query(
    "mu_5_bookmark_delete",
    "SELECT id, user_id FROM bookmark WHERE NOT (color IS NULL AND user_id % 2 = 0)",
)
def _(v: Views):
    asked = v.bookmark.filter("color IS NULL").selectExpr("id", "if(user_id % 2 = 0, user_id, user_id + 1) AS user_id")
    kept, _ = state.delete(v.bookmark, asked, ["id", "user_id"])
    return kept.select("id", "user_id")


@query(
    "mu_6_favorite_changes",
    """SELECT user_id, book_id FROM favorite WHERE book_id >= user_id UNION SELECT c_custkey, 1 FROM customer""",
)
def _(v: Views):
    left = state.remove_favorites(v.favorite, v.favorite.filter("book_id < user_id"))
    return state.add_favorites(left, v.table("customer").selectExpr("c_custkey AS user_id", "bigint(1) AS book_id"))


@query(
    "ag_17_counts_per_key",
    """SELECT 'bookmark' AS kind, user_id AS a, book_id AS b, count(*) AS n FROM bookmark GROUP BY 2, 3
       UNION ALL SELECT 'log', job_id, NULL, count(*) FROM job_log GROUP BY 2""",
)
def _(v: Views):
    marks = v.bookmark.groupBy(F.lit("bookmark").alias("kind"), C("user_id").alias("a"), C("book_id").alias("b")).agg(F.count("*").alias("n"))
    logs = v.job_log.groupBy(C("job_id").alias("a")).agg(F.count("*").alias("n"))
    return marks.unionByName(logs.select(F.lit("log").alias("kind"), "a", F.lit(None).cast("bigint").alias("b"), "n"))


# ---------------------------------------------------------------- book status

CHANGE = """SELECT user_id AS book_id, event_id AS seq,
    CASE event_type WHEN 'purchase' THEN 'READY' WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'PROCESSING' ELSE 'QUEUED' END AS status,
    CASE WHEN k % 3 = 0 THEN NULL ELSE 'run-' || event_id END AS run_id, CASE WHEN k % 4 = 0 THEN ' ' ELSE 'p/' || event_id END AS artifact_path
    FROM activity"""


@query(
    "mu_10_book_status_replay",
    """SELECT b.book_id, CASE
         WHEN coalesce(r.status, b.normalization_status) = 'READY' AND trim(coalesce(CASE WHEN r.seq IS NULL THEN b.run_id ELSE r.run_id END, '')) <> ''
              AND trim(coalesce(CASE WHEN r.seq IS NULL THEN b.artifact_path ELSE r.artifact_path END, '')) <> '' THEN 'READY'
         WHEN l.seq IS NULL THEN b.normalization_status ELSE l.status END AS status,
         CASE WHEN r.seq IS NULL THEN b.run_id ELSE r.run_id END AS run_id
       FROM book b LEFT JOIN last_ready r USING (book_id) LEFT JOIN last_change l USING (book_id)""",
    change=CHANGE,
    last_ready="SELECT * FROM change WHERE status = 'READY' QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY seq DESC) = 1",
    last_change="SELECT * FROM change QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY seq DESC) = 1",
)
def _(v: Views):
    changes = v.activity.selectExpr(
        "user_id AS book_id",
        "event_id AS seq",
        "CASE event_type WHEN 'purchase' THEN 'READY' WHEN 'error' THEN 'FAILED' WHEN 'click' THEN 'PROCESSING' ELSE 'QUEUED' END AS status",
        "if(k % 3 = 0, null, concat('run-', event_id)) AS run_id",
        "if(k % 4 = 0, ' ', concat('p/', event_id)) AS artifact_path",
        "'rule-2' AS rule_version",
        "'loc-2' AS locator_version",
    )
    return state.replay_normalization(v.book, changes).select("book_id", C("normalization_status").alias("status"), "run_id")


COMPLETE = """SELECT b.book_id, coalesce(b.normalization_status = 'READY' AND b.book_id IN (SELECT book_id FROM story_character)
    AND b.book_id IN (SELECT book_id FROM story_event) AND coalesce(h.ok, false)
    AND (b.book_id IN (SELECT book_id FROM story_edge) OR b.book_id IN (SELECT book_id FROM story_stat)), false) AS complete
    FROM book b LEFT JOIN (SELECT book_id, bool_and((book_id % 3 <> 1 OR summarized) AND (chapter_id % 16 >= 8 OR chapter_id IN (SELECT chapter_id FROM story_summary))) AS ok FROM story_chapter GROUP BY 1) h USING (book_id)"""


def completeness(v: Views):
    """Summaries are thin in the tables, so half of the books get one for every chapter.

    One book in three keeps the flags of its chapters; the others count as summarized.
    """
    chapters = v.chapter.withColumn("summarized", (F.col("book_id") % 3 != 1) | F.col("summarized"))
    extra = v.chapter.filter("chapter_id % 16 >= 8").select("book_id", "chapter_id")
    summaries = v.summary.select("book_id", "chapter_id").unionByName(extra)
    return state.analysis_complete(v.book, v.character, v.event, chapters, summaries, v.edge, v.stat)


@query("ag_14_analysis_completeness", COMPLETE)
def _(v: Views):
    return completeness(v)


@query(
    "mu_11_analysis_refresh",
    """SELECT b.book_id, CASE WHEN c.complete THEN 'READY' ELSE 'NONE' END AS analysis_status, c.complete AS summary FROM book b JOIN complete c USING (book_id)""",
    complete=COMPLETE,
)
def _(v: Views):
    return state.refresh_analysis(v.book, completeness(v)).select("book_id", "analysis_status", "summary")


@query(
    "ag_13_all_chapters_summarized",
    """SELECT b.book_id, b.summary OR coalesce(h.ok, true) AS summary FROM book b
       LEFT JOIN (SELECT book_id, bool_and(summarized) AS ok FROM story_chapter GROUP BY 1) h USING (book_id)""",
)
def _(v: Views):
    return state.all_chapters_summarized(v.book, v.chapter)


@query(
    "mu_8_delete_and_reset",
    """SELECT b.book_id, CASE WHEN g.book_id IS NOT NULL THEN 'NONE' ELSE b.analysis_status END AS analysis_status, coalesce(g.events, 0) AS deleted
       FROM book b LEFT JOIN (SELECT book_id, count(*) AS events FROM story_event WHERE chapter_id IN (SELECT chapter_id FROM story_chapter WHERE NOT summarized) GROUP BY 1) g USING (book_id)""",
)
def _(v: Views):
    gone = v.chapter.filter(~C("summarized")).select("chapter_id")
    kept, _ = state.delete(v.event, gone, ["chapter_id"])
    before = v.event.groupBy("book_id").agg(F.count("*").alias("_before"))
    after = kept.groupBy("book_id").agg(F.count("*").alias("_after"))
    counts = before.join(after, "book_id", "left").withColumn("deleted", C("_before") - F.coalesce("_after", F.lit(0)))
    touched = counts.filter("deleted > 0").select("book_id", "deleted")
    books = state.reset_analysis(v.book, touched)
    return books.join(touched, "book_id", "left").select("book_id", "analysis_status", F.coalesce("deleted", F.lit(0)).alias("deleted"))


ERRORS = "SELECT user_id AS book_id, CASE event_type WHEN 'error' THEN 400 + k ELSE 500 END AS http_status FROM activity"


@query(
    "mu_12_reject_marking",
    """SELECT book_id, CASE WHEN analysis_status <> 'READY' AND book_id IN (SELECT book_id FROM errs WHERE http_status BETWEEN 400 AND 499)
         THEN 'REJECTED' ELSE analysis_status END AS analysis_status FROM book""",
    errs=ERRORS,
)
def _(v: Views):
    errors = v.activity.selectExpr("user_id AS book_id", "if(event_type = 'error', 400 + k, 500) AS http_status")
    return state.reject_analysis(v.book, errors).select("book_id", "analysis_status")


@query("mu_18_status_back_fill", "SELECT book_id, CASE WHEN summary THEN 'READY' ELSE 'NONE' END AS analysis_status FROM book")
def _(v: Views):
    return state.backfill_analysis(v.book).select("book_id", "analysis_status")


# ------------------------------------------------------------------- chapters

NEWDOC = """SELECT doc_id, doc_id // 5 AS book_id, CAST(doc_id % 5 * 2 + 1 AS INT) AS chapter_idx, CAST(length(text) AS INT) AS total FROM documents"""


def new_chapters(v: Views):
    rows = v.table("documents").select(
        F.expr("doc_id div 5").alias("book_id"),
        F.expr("int(doc_id % 5 * 2 + 1)").alias("chapter_idx"),
        F.concat(F.lit("New "), "doc_id").alias("title"),
        "text",
        F.length("text").alias("total_code_points"),
    )
    return corpus.book_positions(rows)


def stored_chapters(v: Views):
    none = F.lit(None)
    return v.chapter.select(
        "book_id", "idx", F.lit(3).alias("page_start"), F.lit(4).alias("page_end"), "title", "total_code_points",
        none.cast("int").alias("start_pos"), none.cast("int").alias("end_pos"), none.cast("string").alias("raw_text"),
        F.lit("old").alias("summary_text"), F.lit("u").alias("summary_url"), "summarized",
    )


PROJECTION_SQL = """SELECT coalesce(h.book_id, d.book_id) AS book_id, coalesce(h.idx, d.chapter_idx) AS idx,
    CASE WHEN d.doc_id IS NOT NULL THEN 'New ' || d.doc_id ELSE h.title END AS title,
    CASE WHEN d.doc_id IS NOT NULL THEN d.total ELSE h.total_code_points END AS total_code_points,
    CASE WHEN d.doc_id IS NULL THEN 'old' END AS summary_text,
    CASE WHEN d.doc_id IS NOT NULL THEN false ELSE h.summarized END AS summarized, CASE WHEN h.idx IS NULL THEN 0 ELSE 3 END AS page_start,
    d.doc_id IS NULL AND coalesce(h.book_id, d.book_id) IN (SELECT book_id FROM newdoc) AS stale
    FROM story_chapter h FULL JOIN newdoc d ON h.book_id = d.book_id AND h.idx = d.chapter_idx"""


@query("mu_9_chapter_projection", PROJECTION_SQL, newdoc=NEWDOC)
def chapter_projection(v: Views):
    return state.project_chapters(stored_chapters(v), new_chapters(v)).select(
        "book_id", "idx", "title", "total_code_points", "summary_text", "summarized", "page_start", "stale"
    )


@query(
    "jn_19_artifact_existing_chapter",
    """SELECT d.doc_id, h.chapter_id FROM newdoc d LEFT JOIN story_chapter h ON h.book_id = d.book_id AND h.idx = d.chapter_idx""",
    newdoc=NEWDOC,
)
def _(v: Views):
    known = v.chapter.select("book_id", C("idx").alias("chapter_idx"), "chapter_id")
    rows = v.table("documents").selectExpr("doc_id", "doc_id div 5 AS book_id", "int(doc_id % 5 * 2 + 1) AS chapter_idx")
    return rows.join(known, ["book_id", "chapter_idx"], "left").select("doc_id", "chapter_id")


@query("snk_1_projection_upsert", f"SELECT stale, count(*) AS chapters, CAST(sum(total_code_points) AS BIGINT) AS code_points FROM ({PROJECTION_SQL}) GROUP BY 1", newdoc=NEWDOC)
def _(v: Views):
    """The projected table written and read back."""
    import uuid

    from plotweave.session import shared_folder

    path = f"{shared_folder(v.spark)}/chapters-{uuid.uuid4().hex}"
    state.project_chapters(stored_chapters(v), new_chapters(v)).write.parquet(path)
    return v.spark.read.parquet(path).groupBy("stale").agg(
        F.count("*").alias("chapters"), F.sum("total_code_points").alias("code_points")
    )


@query(
    "mu_21_summary_text_update",
    """SELECT chapter_id, CASE WHEN chapter_id IN (SELECT chapter_id FROM story_summary) THEN 'S' || chapter_id END AS summary_text FROM story_chapter""",
)
def _(v: Views):
    changes = v.summary.select("chapter_id").distinct().withColumn("summary_text", F.concat(F.lit("S"), "chapter_id"))
    current = v.chapter.select("chapter_id", F.lit(None).cast("string").alias("summary_text"))
    return state.patch(current, changes, ["chapter_id"], ["summary_text"])


# ----------------------------------------------------------------------- jobs


@query(
    "wn_4_latest_and_active_jobs",
    """SELECT 'latest' AS kind, book_id, id FROM job QUALIFY row_number() OVER (PARTITION BY book_id, pipeline_type ORDER BY created_at DESC, id DESC) = 1
       UNION ALL SELECT * FROM (SELECT 'active' AS kind, book_id, id FROM job WHERE status IN ('QUEUED', 'PROCESSING') AND pipeline_type = 'NORMALIZATION'
         QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY created_at DESC, id DESC) = 1)""",
)
def _(v: Views):
    newest = state.latest_jobs(v.job).select(F.lit("latest").alias("kind"), "book_id", "id")
    return newest.unionByName(state.active_jobs(v.job).select(F.lit("active").alias("kind"), "book_id", "id"))


@query("wn_6_log_sequence", "SELECT id, job_id, row_number() OVER (PARTITION BY job_id ORDER BY id) + job_id % 3 AS seq FROM job_log")
def _(v: Views):
    stored = v.job_log.select("job_id").distinct().withColumn("n", C("job_id") % 3)
    return state.numbered_logs(v.job_log, stored).select("id", "job_id", "seq")


@query(
    "snk_4_log_append",
    """SELECT id, job_id, row_number() OVER (PARTITION BY job_id ORDER BY id) AS seq, CASE WHEN k % 2 = 1 THEN '{"k":"' || k || '"}' END AS payload FROM job_log""",
)
def _(v: Views):
    import uuid

    from plotweave.session import shared_folder

    payload = F.when(C("k") % 2 == 1, F.create_map(F.lit("k"), C("k").cast("string"))).otherwise(
        F.create_map().cast("map<string,string>")
    )
    rows = state.numbered_logs(v.job_log).withColumn("payload", state.log_payload(payload))
    path = f"{shared_folder(v.spark)}/logs-{uuid.uuid4().hex}"
    rows.select("id", "job_id", "seq", "payload").write.mode("append").parquet(path)
    return v.spark.read.parquet(path)


@query(
    "mu_16_job_transitions",
    """SELECT j.id, coalesce(l.status, j.status) AS status, CASE WHEN l.status = 'FAILED' THEN 'X' || l.seq END AS failure_code FROM job j
       LEFT JOIN (SELECT event_id // 3 AS id, event_id AS seq, CASE k % 3 WHEN 0 THEN 'PROCESSING' WHEN 1 THEN 'READY' ELSE 'FAILED' END AS status FROM activity
         QUALIFY row_number() OVER (PARTITION BY event_id // 3 ORDER BY event_id DESC) = 1) l USING (id)""",
)
def _(v: Views):
    changes = v.activity.selectExpr(
        "event_id div 3 AS id", "event_id AS seq", "element_at(array('PROCESSING', 'READY', 'FAILED'), k % 3 + 1) AS status",
        "'s' AS step", "concat('X', event_id) AS failure_code",
    )
    jobs = v.job.withColumns({"current_step": F.lit("queued"), "failure_code": F.lit(None).cast("string")})
    return state.replay_jobs(jobs, changes).select("id", "status", "failure_code")


QUIET = """SELECT id, book_id, pipeline_type, created_at, CASE WHEN book_id % 4 = 0 AND status IN ('QUEUED', 'PROCESSING') THEN 'READY' ELSE status END AS status
    FROM job"""


@query(
    "mu_16_job_retry",
    """SELECT id, CASE WHEN status <> 'FAILED' THEN 'not failed' WHEN pipeline_type <> 'NORMALIZATION' THEN 'not normalization'
         WHEN book_id IN (SELECT book_id FROM quiet WHERE status IN ('QUEUED', 'PROCESSING') AND pipeline_type = 'NORMALIZATION') THEN 'busy'
         WHEN row_number() OVER (PARTITION BY book_id, status, pipeline_type ORDER BY id) > 1 THEN 'busy' ELSE 'accepted' END AS verdict
         FROM quiet""",
    quiet=QUIET,
)
def _(v: Views):
    """Every fourth book has no running job, so that its failed ones can be retried."""
    active = C("status").isin("QUEUED", "PROCESSING")
    jobs = v.job.withColumn("status", F.when((C("book_id") % 4 == 0) & active, "READY").otherwise(C("status")))
    requests = jobs.select(C("id").alias("request_id"), "id")
    return state.retry_jobs(requests, jobs).select("id", "verdict")
