"""Artifacts of a normalization run: layout, writers, readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.functions.text import artifact_root, chapter_file, chapter_text_path, public_url
from plotweave.operators.corpus import combined_document

META = """bookId bigint, runId string, ruleVersion string, locatorVersion string, totalCodePoints int,
  chapters array<struct<chapterIndex:int,title:string,spineHref:string,paragraphCount:int,paragraphStarts:array<int>,
    paragraphLengths:array<int>,totalCodePoints:int,startPos:int,endPos:int>>"""


def chapters_from_meta(metas: DataFrame) -> DataFrame:
    """Chapter coordinates out of metadata documents (book_id, json); 20 chapters each at most."""
    return metas.select("book_id", F.explode(F.from_json("json", META)["chapters"]).alias("c")).select(
        "book_id",
        F.col("c.chapterIndex").alias("idx"),
        F.col("c.paragraphStarts").alias("starts"),
        F.col("c.paragraphLengths").alias("lengths"),
        F.coalesce("c.totalCodePoints", F.lit(0)).alias("total_code_points"),
    )


def read_metas(spark: SparkSession, path: str) -> DataFrame:
    """Metadata documents under ``path`` as (book_id, json)."""
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"books/(\d+)/", 1).cast("bigint").alias("book_id"),
        F.col("value").alias("json"),
    )


def read_chapter_texts(spark: SparkSession, path: str) -> DataFrame:
    """Chapter text files as (book_id, idx, text); both numbers come from the path."""
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"books/(\d+)/", 1).cast("bigint").alias("book_id"),
        F.regexp_extract(F.col("_metadata.file_path"), r"chapter_(\d+)\.txt", 1).cast("int").alias("idx"),
        F.col("value").alias("text"),
    )


def chapter_artifacts(chapters: DataFrame, run_id: str) -> DataFrame:
    """Chapter rows with the paths their files would have."""
    root = artifact_root(F.col("book_id"), F.lit(run_id))
    return chapters.select(
        "*",
        F.lit(run_id).alias("run_id"),
        root.alias("root"),
        chapter_text_path(root, F.col("chapter_idx")).alias("text_path"),
        F.concat(root, F.lit("/normalized/"), chapter_file(F.col("chapter_idx")), F.lit(".xhtml")).alias("markup_path"),
    )


def write_artifacts(chapters: DataFrame, reports: DataFrame, metas: DataFrame, path: str, run_id: str) -> None:
    """Write a run as tables: chapters by book, one report and one metadata row per book.

    Texts and markup stay rows that keep the path of their file in ``text_path`` and
    ``markup_path``; `files.write_named` over `artifact_files` writes the files themselves.
    """
    with_run = F.lit(run_id).alias("run_id")
    chapter_artifacts(chapters, run_id).repartition("book_id", "chapter_idx").write.mode("overwrite").partitionBy(
        "run_id"
    ).parquet(f"{path}/chapters")
    reports.select("*", with_run).write.mode("overwrite").partitionBy("run_id").json(f"{path}/reports")
    metas.select("*", with_run).write.mode("overwrite").partitionBy("run_id").json(f"{path}/meta")


def artifact_files(
    chapters: DataFrame, reports: DataFrame, metas: DataFrame, run_id: str, public: str = "public", private: str = "private"
) -> DataFrame:
    """The files of a run as (path, content): documents, metadata, reports, chapter markup and text.

    ``chapters`` are rendered chapters, ``reports`` and ``metas`` one row per book. Readers get the
    combined document, so it lies under the public prefix.
    """
    root = artifact_root(F.col("book_id"), F.lit(run_id))

    def files(rows: DataFrame, prefix: str, tail: Column, content: Column) -> DataFrame:
        path = F.concat(F.lit(prefix + "/"), root, F.lit("/"), tail)
        return rows.select(path.alias("path"), F.encode(content, "UTF-8").alias("content"))

    entry = F.transform(
        "chapters",
        lambda c: F.struct(
            c["chapter_idx"].alias("chapterIndex"),
            c["title"].alias("title"),
            c["spine_href"].alias("spineHref"),
            c["paragraph_count"].alias("paragraphCount"),
            c["starts"].alias("paragraphStarts"),
            c["lengths"].alias("paragraphLengths"),
            c["total_code_points"].alias("totalCodePoints"),
            c["start_pos"].alias("startPos"),
            c["end_pos"].alias("endPos"),
        ),
    )
    meta = F.struct(F.col("book_id").alias("bookId"), F.lit(run_id).alias("runId"), F.col("total_code_points").alias("totalCodePoints"), entry.alias("chapters"))
    named = chapter_file(F.col("chapter_idx"))
    return (
        files(combined_document(chapters), public, F.lit("combined.xhtml"), F.col("document"))
        .unionByName(files(metas, private, F.lit("meta.json"), F.to_json(meta)))
        .unionByName(files(reports, private, F.lit("reports/validation_report.json"), F.to_json(F.struct(*reports.columns))))
        .unionByName(files(chapters, private, F.concat(F.lit("normalized/"), named, F.lit(".xhtml")), F.col("markup")))
        .unionByName(files(chapters, private, F.concat(F.lit("text/"), named, F.lit(".txt")), F.col("text")))
    )


def combined_document_url(books: DataFrame, base: str, prefix: str) -> DataFrame:
    path = F.concat(F.col("artifact_path"), F.lit("/combined.xhtml"))
    return books.select("book_id", public_url(F.lit(base), F.lit(prefix), path).alias("url"))


def analysis_input(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Ready books with their chapters in order and the path of each chapter text."""
    from plotweave.functions.text import is_blank
    from plotweave.plans.nest import nested

    ready = books.filter((F.col("normalization_status") == "READY") & ~is_blank(F.col("artifact_path")))
    rows = ready.select(
        "book_id", F.col("title").alias("book_title"), "artifact_path", "rule_version", "locator_version"
    ).join(chapters.select("book_id", "idx", F.col("title").alias("chapter_title")), "book_id", "inner")
    entry = F.struct(
        F.col("idx").alias("chapterIndex"),
        F.col("chapter_title").alias("title"),
        chapter_text_path(F.col("artifact_path"), F.col("idx")).alias("txtPath"),
    )
    return nested(
        rows, ["book_id", "book_title", "artifact_path", "rule_version", "locator_version"], "idx", entry, "chapters"
    )
