"""Streaming feeds over the tables, and artifact sinks."""

import uuid

from pyspark.sql import functions as F

from plotweave.operators import corpus
from plotweave.registry.base import query
from plotweave.registry.corpora import DOC_CHAPTER, doc_chapters
from plotweave.registry.ledger import LAST
from plotweave.registry.uploads import ITEM, REJECTED, delta_uploads
from plotweave.session import shared_folder
from plotweave.sources import artifacts, files
from plotweave.streaming import feeds
from plotweave.views import Views

C = F.col


def fresh_folder(v: Views, name: str) -> str:
    return f"{shared_folder(v.spark)}/{name}-{uuid.uuid4().hex}"


@query("str_1_progress_feed", 'SELECT user_id, book_id, chapter_idx, block_idx, "offset", event_id FROM last', last=LAST)
def progress_feed(v: Views):
    path = fresh_folder(v, "progress")
    schema = v.table("events").schema
    raw = v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(v.folder)
    k = "int(get_json_object(props, '$.k'))"
    stream = raw.selectExpr(
        "event_id", "user_id", f"bigint({k} % 5) AS book_id", f"{k} % 8 + 1 AS chapter_idx", "int(event_id % 5) AS block_idx",
        "int(event_id % 520) AS offset", "unix_micros(timestamp(ts)) AS at", "timestamp(ts) AS ts",
    )
    feeds.progress_feed(stream, f"{path}/table", f"{path}/checkpoint")
    return feeds.current_progress(v.spark, f"{path}/table").select(
        "user_id", "book_id", "chapter_idx", "block_idx", "offset", "event_id"
    )


@query(
    "str_2_delta_feed",
    """SELECT book_id, least(from_id, to_id) AS left_id, greatest(from_id, to_id) AS right_id, CAST(sum(evidence_count) AS BIGINT) AS evidence_count,
         round(sum(CAST(CAST(positivity AS FLOAT) AS DOUBLE) * evidence_count) / sum(evidence_count), 6) + 0.0 AS positivity
       FROM item WHERE event_id NOT IN (SELECT upload_id FROM rejected) GROUP BY 1, 2, 3""",
    item=ITEM,
    rejected=REJECTED,
)
def delta_feed(v: Views):
    path = fresh_folder(v, "deltas")
    delta_uploads(v).write.parquet(f"{path}/uploads")
    schema = v.spark.read.parquet(f"{path}/uploads").schema
    stream = v.spark.readStream.schema(schema).parquet(f"{path}/uploads")
    feeds.delta_feed(stream, v.event, v.character, f"{path}/tables", f"{path}/checkpoint")
    return feeds.current_graph(v.spark, f"{path}/tables").select(
        "book_id", "left_id", "right_id", "evidence_count", (F.round("positivity", 6) + 0.0).alias("positivity")
    )


@query(
    "snk_2_artifact_set",
    """SELECT book_id, count(*) AS chapters, CAST(sum(length(replace(text, chr(10), ''))) AS BIGINT) AS code_points, 'PASS' AS status,
         string_agg('books/' || book_id || '/normalizations/run-9/text/chapter_00' || chapter_idx || '.txt', '|' ORDER BY chapter_idx) AS paths
       FROM doc_chapter GROUP BY 1""",
    doc_chapter=DOC_CHAPTER,
)
def artifact_set(v: Views):
    path = fresh_folder(v, "artifacts")
    chapters = doc_chapters(v)
    artifacts.write_artifacts(chapters, corpus.validation_report(chapters), corpus.metadata(chapters), path, "run-9")
    reports = v.spark.read.schema("book_id long, status string").json(f"{path}/reports")
    stored = v.spark.read.parquet(f"{path}/chapters").groupBy("book_id").agg(
        F.count("*").alias("chapters"),
        F.sum("total_code_points").alias("code_points"),
        F.array_join(F.array_sort(F.collect_list("text_path")), "|").alias("paths"),
    )
    return stored.join(reports.select("book_id", "status"), "book_id", "inner")


@query(
    "snk_2_named_files",
    """SELECT root || '/text/chapter_00' || chapter_idx || '.txt' AS path, md5(replace(text, chr(10), '')) AS digest
       FROM (SELECT *, 'private/books/' || book_id || '/normalizations/run-9' AS root FROM doc_chapter)
       UNION ALL SELECT 'private/books/' || book_id || '/normalizations/run-9/normalized/chapter_00' || chapter_idx || '.xhtml',
         md5('<section data-chapter-index="0">') FROM doc_chapter
       UNION ALL SELECT 'public/books/' || book_id || '/normalizations/run-9/combined.xhtml',
         md5('<?xml version="1.0" encoding="UTF-8"?><html xmlns="http://www.w3.org/1999/xhtml"><head><meta charset="UTF-8"/>'
           || '<title>Normalized Reader</title></head><body>' || repeat('<section data-chapter-index="0">', count(*)) || '</body></html>')
       FROM doc_chapter GROUP BY book_id
       UNION ALL SELECT 'private/books/' || book_id || '/normalizations/run-9/meta.json',
         string_agg(chapter_idx || ':' || length(replace(text, chr(10), '')), ',' ORDER BY chapter_idx) FROM doc_chapter GROUP BY book_id
       UNION ALL SELECT 'private/books/' || book_id || '/normalizations/run-9/reports/validation_report.json',
         count(*) || ':' || count(*) FILTER (doc_id % 9 = 0) FROM doc_chapter GROUP BY book_id""",
    doc_chapter=DOC_CHAPTER,
)
def named_files(v: Views):
    """Files by their path; a digest of texts, what JSON documents say of their chapters."""
    path = fresh_folder(v, "files")
    chapters = doc_chapters(v)
    files.write_named(artifacts.artifact_files(chapters, corpus.validation_report(chapters), corpus.metadata(chapters), "run-9"), path)
    body = C("content").cast("string")
    listed = F.transform(
        F.from_json(body, artifacts.META)["chapters"],
        lambda c: F.concat_ws(":", c["chapterIndex"].cast("string"), c["totalCodePoints"].cast("string")),
    )
    report = F.from_json(body, "chapter_count int, invalid_title_count int")
    digest = (
        F.when(C("path").endswith("/meta.json"), F.array_join(listed, ","))
        .when(C("path").endswith("_report.json"), F.concat_ws(":", report["chapter_count"].cast("string"), report["invalid_title_count"].cast("string")))
        .otherwise(F.md5("content"))
    )
    return files.read_named(v.spark, path).select("path", digest.alias("digest"))
