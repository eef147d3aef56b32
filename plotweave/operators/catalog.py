"""Catalog rows, filters, sorts, manifests and reader lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.functions import coords, status
from plotweave.functions.text import is_blank, truncated
from plotweave.plans.nest import nested

# ----------------------------------------------------------------------- books


def with_version(books: DataFrame, rule: str, locator: str) -> DataFrame:
    state = status.version_status(
        F.col("normalization_status"), F.col("rule_version"), F.col("locator_version"), rule, locator
    )
    return books.withColumn("version_status", state).withColumn(
        "needs_renormalization", F.col("version_status") == "OUTDATED"
    )


def ready(books: DataFrame) -> DataFrame:
    return books.filter(F.col("normalization_status") == "READY")


def accessible(books: DataFrame, user_id: int) -> DataFrame:
    """Default and ready, or uploaded by the user."""
    own = F.col("uploaded_by") == user_id
    return books.filter((F.col("is_default") & (F.col("normalization_status") == "READY")) | own)


def analysis_ready(books: DataFrame) -> DataFrame:
    return ready(books).filter(F.col("analysis_status") == "READY")


def matching(books: DataFrame, keyword: str | None) -> DataFrame:
    """Keyword in title or author, ignoring case; a blank keyword filters nothing."""
    if keyword is None or not keyword.strip():
        return books
    word = keyword.lower()
    return books.filter(F.lower("title").contains(word) | F.lower("author").contains(word))


def in_language(books: DataFrame, language: str | None) -> DataFrame:
    if language is None or not language.strip():
        return books
    return books.filter(F.lower("language") == language.lower())


def favorite_flags(books: DataFrame, favorites: DataFrame) -> DataFrame:
    """Books with whether each is among the given favorites of one user."""
    marks = favorites.select("book_id").distinct().withColumn("is_favorite", F.lit(True))
    return books.join(marks, "book_id", "left").withColumn("is_favorite", F.coalesce("is_favorite", F.lit(False)))


def favorites_only(books: DataFrame, favorites: DataFrame) -> DataFrame:
    return books.join(favorites.select("book_id"), "book_id", "left_semi")


def reader_favorites(favorites: DataFrame, books: DataFrame) -> DataFrame:
    """Favorites of all users, readable books only."""
    return favorites.join(ready(books), "book_id", "inner")


def reader_catalog(asked: DataFrame, books: DataFrame, favorites: DataFrame, rule: str, locator: str) -> DataFrame:
    """Catalog rows of many readers at once: one for each distinct (user_id, book_id) that is ready.

    ``favorites`` are everybody's (user_id, book_id); the flag says whether the book is among the
    reader's own. Each reader's pair meets its own favorite, so no reader sees another's.
    """
    pairs = asked.select("user_id", "book_id").distinct()
    marks = favorites.select("user_id", "book_id").distinct().withColumn("is_favorite", F.lit(True))
    flagged = pairs.join(marks, ["user_id", "book_id"], "left").withColumn("is_favorite", F.coalesce("is_favorite", F.lit(False)))
    return flagged.join(with_version(ready(books), rule, locator), "book_id", "inner")


def reader_favorite_catalog(books: DataFrame, favorites: DataFrame, rule: str, locator: str) -> DataFrame:
    """The catalogs of all readers who ask for their favorites only."""
    return reader_catalog(favorites, books, favorites, rule, locator)


def sorted_catalog(books: DataFrame, sort_by: str | None = None) -> DataFrame:
    """By title ignoring case, else newest update first; the book id breaks ties."""
    if (sort_by or "").lower() == "title":
        return books.orderBy(F.lower("title"), "book_id")
    return books.orderBy(F.desc("updated_at"), "book_id")


def catalog(
    books: DataFrame,
    favorites: DataFrame,
    rule: str,
    locator: str,
    keyword: str | None = None,
    language: str | None = None,
    favorite_only: bool = False,
    sort_by: str | None = None,
) -> DataFrame:
    """The book list a reader sees. ``favorites`` are the reader's own."""
    rows = in_language(matching(ready(books), keyword), language)
    if favorite_only:
        rows = favorites_only(rows, favorites)
    return sorted_catalog(with_version(favorite_flags(rows, favorites), rule, locator), sort_by)


def unsummarized_books(books: DataFrame) -> DataFrame:
    return ready(books).filter(~F.col("summary"))


def unsummarized_chapters(chapters: DataFrame, books: DataFrame) -> DataFrame:
    return chapters.filter(~F.col("summarized")).join(
        books.select("book_id", F.col("title").alias("book_title")), "book_id", "inner"
    ).select("chapter_id", "title", "book_id", "book_title")


# --------------------------------------------------------------------- lengths


def chapter_lengths(chapters: DataFrame, events: DataFrame) -> DataFrame:
    """Stored length, else the highest event end, else zero."""
    ends = events.groupBy("chapter_id").agg(F.max("end_txt").alias("_end"))
    return chapters.join(ends, "chapter_id", "left").select(
        "book_id", "chapter_id", "idx", F.coalesce("total_code_points", "_end", F.lit(0)).alias("length")
    )


def book_lengths(books: DataFrame, lengths: DataFrame) -> DataFrame:
    """Highest chapter and total length per book; zero for a book without chapters."""
    sums = lengths.groupBy("book_id").agg(F.max("idx").alias("_max"), F.sum("length").alias("_total"))
    return books.join(sums, "book_id", "left").select(
        "book_id",
        F.coalesce("_max", F.lit(0)).alias("max_chapter"),
        F.greatest(F.coalesce("_total", F.lit(0)), F.lit(0)).cast("bigint").alias("total_length"),
    )


# -------------------------------------------------------------------- manifest


def event_entries() -> Column:
    place = F.col("chapter_idx")
    return F.struct(
        F.col("idx").alias("idx"),
        F.col("event_id").alias("eventId"),
        coords.locator_or_null(place, F.col("start_block"), F.col("start_offset")).alias("startLocator"),
        coords.locator_or_null(place, F.col("end_block"), F.col("end_offset")).alias("endLocator"),
        F.col("start_txt").alias("startTxtOffset"),
        F.col("end_txt").alias("endTxtOffset"),
        truncated(F.col("raw_text"), 300).alias("rawText"),
    )


def nested_events(events: DataFrame) -> DataFrame:
    """Ordered events per (book, chapter, part); see ``plans.nest`` about parts."""
    return nested(events, ["book_id", "chapter_idx"], "idx", event_entries(), "events")


def manifest_chapters(books: DataFrame, chapters: DataFrame, events: DataFrame) -> DataFrame:
    """Chapters of ready books; events only where the analysis is ready."""
    shown = analysis_ready(books).select("book_id")
    inner = nested_events(events.join(shown, "book_id", "left_semi")).withColumnRenamed("chapter_idx", "idx")
    return (
        chapters.join(ready(books).select("book_id"), "book_id", "left_semi")
        .join(inner, ["book_id", "idx"], "left")
        .withColumn("part", F.coalesce("part", F.lit(0)))
    )


def manifest_characters(books: DataFrame, characters: DataFrame) -> DataFrame:
    return characters.join(analysis_ready(books).select("book_id"), "book_id", "left_semi")


def sorted_characters(characters: DataFrame) -> DataFrame:
    """Main characters first, then by name, within each book."""
    return characters.orderBy("book_id", F.desc("is_main"), "name", "id")


def sorted_events(events: DataFrame) -> DataFrame:
    return events.orderBy("book_id", "chapter_idx", "idx", "id")


def summary_rows(summaries: DataFrame, characters: DataFrame, chapters: DataFrame, books: DataFrame) -> DataFrame:
    """Point-of-view summaries of analysed books with character and chapter names."""
    people = characters.select(F.col("id").alias("char_id"), "character_id", "name", "is_main")
    places = chapters.select("chapter_id", F.col("idx").alias("chapter_idx"), F.col("title").alias("chapter_title"))
    return (
        summaries.join(analysis_ready(books).select("book_id"), "book_id", "left_semi")
        .join(people, "char_id", "inner")
        .join(places, "chapter_id", "inner")
        .select("id", "book_id", "chapter_idx", "chapter_title", "character_id", "name", "is_main", "summary_text")
    )


# ----------------------------------------------------------- strict readiness


def strict_readiness(books: DataFrame, chapters: DataFrame, events: DataFrame) -> DataFrame:
    """Per book: version named, every chapter measured, every event fully placed."""
    measured = chapters.groupBy("book_id").agg(
        F.bool_and(
            F.col("starts").isNotNull() & F.col("lengths").isNotNull() & F.col("total_code_points").isNotNull()
        ).alias("chapters_ready")
    )
    six = [F.col(c).isNotNull() for c in ("start_txt", "end_txt", "start_block", "start_offset", "end_block", "end_offset")]
    placed = events.groupBy("book_id").agg(
        F.bool_and(six[0] & six[1] & six[2] & six[3] & six[4] & six[5]).alias("events_ready")
    )
    return (
        books.select("book_id", (~is_blank(F.col("locator_version"))).alias("version_ready"))
        .join(measured, "book_id", "left")
        .join(placed, "book_id", "left")
        .select(
            "book_id",
            "version_ready",
            F.coalesce("chapters_ready", F.lit(True)).alias("chapters_ready"),
            F.coalesce("events_ready", F.lit(True)).alias("events_ready"),
        )
    )
