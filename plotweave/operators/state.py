"""Keyed tables kept by batches: progress, bookmarks, favorites, books, chapters.

Every function maps (current, changes) to the new table. "Last write wins" is a
map-side combined ``max_by``, so a user with a third of all changes is no hot task.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.functions.text import is_blank, preview
from plotweave.plans.pick import latest
from plotweave.plans.scan import prefix_scan, slice_of
from plotweave.plans.spread import spread

READER = ["user_id", "book_id"]


# -------------------------------------------------------------------- generic


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key over the current table and the changes."""
    return latest(current.unionByName(changes), keys, order)


def delete(current: DataFrame, keys_gone: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(what is left, requests that matched nothing)."""
    asked = keys_gone.select(*keys).distinct()
    left = current.join(asked, list(keys), "left_anti")
    missed = asked.join(current.select(*keys), list(keys), "left_anti")
    return left, missed


def patch(current: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Take the non-null change of each column. ``changes`` has one row per key."""
    renamed = changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = current.join(renamed, list(keys), "left")
    return joined.select(
        *[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in current.columns]
    )


# ------------------------------------------------------------------- progress


def latest_progress(changes: DataFrame) -> DataFrame:
    """Last position per reader and book; the event id breaks ties."""
    return latest(changes, READER, ["at", "event_id"])


def progress_view(progress: DataFrame, books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Read states of readable books with the text offset recomputed from the locator."""
    from plotweave.operators.positions import locator_offsets

    readable = books.filter(F.col("normalization_status") == "READY").select("book_id", "locator_version")
    return locator_offsets(progress.join(readable, "book_id", "inner"), chapters)


# ------------------------------------------------------------------ bookmarks


def bookmark_kind(end: Column) -> Column:
    return F.when(end.isNotNull(), "range").otherwise("point")


def conflicts(new: DataFrame, existing: DataFrame, match_chapter: bool = False) -> DataFrame:
    """New bookmarks that meet an existing one of the same reader and book.

    Same point, same range, or overlapping ranges. A point never meets a range.
    Offsets count from the chapter start but chapters are not compared unless asked.

    One sweep over the places of both tables: up to a place, the last existing point, the
    furthest end of an existing range and how many of them began. A new range is met when the
    furthest end at its start lies behind that start, or when more ranges began before its end
    than up to its start. Equal requests are swept once; the pairs are never listed. Ranges end
    behind their start, as the field rules ask.
    """
    keys = READER + (["chapter_idx"] if match_chapter else [])
    place = [*keys, "start_txt", "end_txt"]
    swept = (
        existing.select(*place, F.lit(True).alias("_held"))
        .unionByName(new.select(*place, F.lit(False).alias("_held")))
        .groupBy(*place)
        .agg(F.bool_or("_held").alias("_held"), F.bool_or(~F.col("_held")).alias("_asked"))
    )
    start, end = F.col("start_txt"), F.col("end_txt")
    # At one place: ends of new ranges, then what exists, then starts of new ones.
    marks = F.array(
        F.when(F.col("_asked") & end.isNotNull(), F.struct(end.alias("at"), F.lit(0).alias("step"))),
        F.when(F.col("_held"), F.struct(start.alias("at"), F.lit(1).alias("step"))),
        F.when(F.col("_asked"), F.struct(start.alias("at"), F.lit(2).alias("step"))),
    )
    rows = swept.select(*place, F.explode(F.array_compact(marks)).alias("_m")).select(*place, "_m.at", "_m.step")
    is_held = F.col("step") == 1
    scanned = prefix_scan(
        rows.withColumn("_slice", slice_of(F.col("at"))),
        keys,
        ["_slice"],
        ["at", "step"],
        {
            "_point": ("max", F.when(is_held & end.isNull(), start)),
            "_reach": ("max", F.when(is_held, end)),
            "_begun": ("sum", F.when(is_held & end.isNotNull(), 1).otherwise(0)),
        },
    )
    met = scanned.filter("step <> 1").groupBy(*place).agg(
        F.max(F.when(F.col("step") == 2, F.when(end.isNull(), F.col("_point") == start).otherwise(F.col("_reach") > start))).alias("_now"),
        (F.max(F.when(F.col("step") == 0, F.col("_begun"))) > F.max(F.when(F.col("step") == 2, F.col("_begun")))).alias("_later"),
    )
    hits = met.filter("_now OR _later").select(*[F.col(c).alias(f"_{c}_") for c in place])
    same = [new[c].eqNullSafe(hits[f"_{c}_"]) if c == "end_txt" else new[c] == hits[f"_{c}_"] for c in place]
    return new.join(hits, reduce(and_, same), "left_semi")


def accept_bookmarks(requests: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Requests accepted in arrival order: an accepted one blocks later ones it meets.

    Equal requests reduce to the earliest one by aggregation; that settles points. Ranges
    are cut into islands that nothing bridges, found by a sliced scan of the furthest
    end so far, and only one island at a time is replayed. An island holds distinct
    ranges of one text, however many requests a reader sends.
    ``requests`` has (id, user_id, book_id, start_txt, end_txt); ids follow arrival.
    """
    rows = requests.withColumn("stored", F.lit(False))
    if existing is not None:
        rows = existing.select(*requests.columns).withColumn("stored", F.lit(True)).unionByName(rows)
    order = F.struct(~F.col("stored"), "id")
    first = rows.groupBy(*READER, "start_txt", "end_txt").agg(F.min(order).alias("_first")).select(
        *READER, "start_txt", "end_txt", (~F.col("_first.col1")).alias("stored"), F.col("_first.id").alias("id")
    )
    points = first.filter("end_txt IS NULL AND NOT stored").select("id")
    ranges = first.filter("end_txt IS NOT NULL").withColumn("_slice", slice_of(F.col("start_txt")))
    reach = prefix_scan(
        ranges, READER, ["_slice"], ["start_txt", "end_txt"], {"_reach": ("max", F.col("end_txt"))}, inclusive=False
    )
    opened = reach.withColumn("_opens", F.coalesce(F.col("start_txt") >= F.col("_reach"), F.lit(True)).cast("int"))
    islands = prefix_scan(opened, READER, ["_slice"], ["start_txt", "end_txt"], {"island": ("sum", F.col("_opens"))})

    order = [F.desc("stored"), F.asc("id")]
    replayed = (
        spread(islands.select(*READER, "island", "id", "start_txt", "end_txt", "stored"), *READER, "island")
        .sortWithinPartitions(*READER, "island", *order)
        .mapInPandas(_replay, "id long")
    )
    return requests.join(points.unionByName(replayed), "id", "left_semi")


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First come, first kept, island after island.

    Rows stream in island order, and only the kept ranges of the current island are
    held; they stay sorted and disjoint, so each newcomer is one bisection.
    """
    current, starts, ends = None, [], []
    for batch in batches:
        kept = []
        for row in batch.itertuples(index=False):
            island = (row.user_id, row.book_id, row.island)
            if island != current:
                current, starts, ends = island, [], []
            at = bisect.bisect_left(starts, row.end_txt)
            if row.stored or at == 0 or ends[at - 1] <= row.start_txt:
                starts.insert(at, row.start_txt)
                ends.insert(at, row.end_txt)
                if not row.stored:
                    kept.append(row.id)
        yield pd.DataFrame({"id": pd.Series(kept, dtype="int64")})


# ------------------------------------------------------------------ favorites


def add_favorites(current: DataFrame, added: DataFrame) -> DataFrame:
    return current.select(*READER).unionByName(added.select(*READER)).distinct()


def remove_favorites(current: DataFrame, removed: DataFrame) -> DataFrame:
    return current.join(removed.select(*READER).distinct(), READER, "left_anti")


# ---------------------------------------------------------------- book status


def active_run(status: Column, run_id: Column, path: Column) -> Column:
    return status.eqNullSafe(F.lit("READY")) & ~is_blank(run_id) & ~is_blank(path)


def replay_normalization(books: DataFrame, changes: DataFrame) -> DataFrame:
    """Book status after ordered changes (book_id, seq, status, run_id, path, versions).

    READY always applies and stores its run. Every other status applies only while no
    run is active. So only the last READY and the last change after it can matter.
    """
    is_ready = F.col("status") == "READY"
    run = F.struct("seq", "run_id", "artifact_path", "rule_version", "locator_version")
    ends = changes.groupBy("book_id").agg(
        F.max_by(run, F.when(is_ready, F.col("seq"))).alias("_ready"),
        F.max(F.struct("seq", "status")).alias("_last"),
        F.max(F.when(is_ready, F.col("seq"))).alias("_ready_seq"),
    )
    joined = books.join(ends, "book_id", "left")
    done = F.col("_ready_seq").isNotNull()
    fields = {
        c: F.when(done, F.col(f"_ready.{c}")).otherwise(F.col(c))
        for c in ("run_id", "artifact_path", "rule_version", "locator_version")
    }
    base = F.when(done, F.lit("READY")).otherwise(F.col("normalization_status"))
    held = active_run(base, fields["run_id"], fields["artifact_path"])
    # Without an active run the last change decides; a READY change that is last is READY.
    after = F.when(held | F.col("_last").isNull(), base).otherwise(F.col("_last.status"))
    return joined.select(
        *[
            after.alias(c) if c == "normalization_status" else fields[c].alias(c) if c in fields else F.col(c)
            for c in books.columns
        ]
    )


def analysis_complete(
    books: DataFrame,
    characters: DataFrame,
    events: DataFrame,
    chapters: DataFrame,
    summaries: DataFrame,
    edges: DataFrame,
    stats: DataFrame,
) -> DataFrame:
    """Whether each book has everything an analysis must bring."""

    def flag(df: DataFrame, name: str) -> DataFrame:
        return df.select("book_id").distinct().withColumn(name, F.lit(True))

    has_summary = summaries.select("chapter_id").distinct().withColumn("_s", F.lit(True))
    per_chapter = (
        chapters.join(has_summary, "chapter_id", "left")
        .groupBy("book_id")
        .agg(F.bool_and(F.col("summarized") & F.coalesce("_s", F.lit(False))).alias("_summarized"))
    )
    joined = books.select("book_id", "normalization_status").join(per_chapter, "book_id", "left")
    for df, name in ((characters, "_c"), (events, "_e"), (edges, "_r"), (stats, "_w")):
        joined = joined.join(flag(df, name), "book_id", "left")
    no = F.lit(False)
    complete = (
        (F.col("normalization_status") == "READY")
        & F.coalesce("_c", no)
        & F.coalesce("_e", no)
        & F.coalesce("_summarized", no)
        & (F.coalesce("_r", no) | F.coalesce("_w", no))
    )
    return joined.select("book_id", F.coalesce(complete, no).alias("complete"))


def all_chapters_summarized(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """True for a book without chapters, and once true it stays."""
    done = chapters.groupBy("book_id").agg(F.bool_and("summarized").alias("_done"))
    return books.join(done, "book_id", "left").select(
        "book_id", (F.col("summary") | F.coalesce("_done", F.lit(True))).alias("summary")
    )


def refresh_analysis(books: DataFrame, completeness: DataFrame) -> DataFrame:
    """READY or NONE from completeness; the summary flag follows."""
    joined = books.join(completeness, "book_id", "left")
    ok = F.coalesce("complete", F.lit(False))
    return joined.select(
        *[
            F.when(ok, "READY").otherwise("NONE").alias(c) if c == "analysis_status" else ok.alias(c) if c == "summary" else F.col(c)
            for c in books.columns
        ]
    )


def reset_analysis(books: DataFrame, touched: DataFrame) -> DataFrame:
    """Books that lost data go back to NONE."""
    marked = books.join(touched.select("book_id").distinct().withColumn("_t", F.lit(True)), "book_id", "left")
    hit = F.col("_t").isNotNull()
    return marked.select(
        *[
            F.when(hit, "NONE").otherwise(F.col(c)).alias(c) if c == "analysis_status"
            else (F.col(c) & ~hit).alias(c) if c == "summary" else F.col(c)
            for c in books.columns
        ]
    )


def reject_analysis(books: DataFrame, errors: DataFrame) -> DataFrame:
    """Books with a client error become REJECTED unless READY; ``errors`` has (book_id, http_status)."""
    client = errors.filter(F.col("http_status").between(400, 499)).select("book_id").distinct().withColumn("_r", F.lit(True))
    marked = books.join(client, "book_id", "left")
    hit = F.col("_r").isNotNull() & ~F.col("analysis_status").eqNullSafe(F.lit("READY"))
    return marked.select(
        *[
            F.when(hit, "REJECTED").otherwise(F.col(c)).alias(c) if c == "analysis_status"
            else (F.col(c) & ~hit).alias(c) if c == "summary" else F.col(c)
            for c in books.columns
        ]
    )


def backfill_analysis(books: DataFrame) -> DataFrame:
    return books.withColumn("analysis_status", F.when(F.col("summary"), "READY").otherwise("NONE"))


# ------------------------------------------------------------------- chapters


def project_chapters(current: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Chapter table after a normalization run.

    Text coordinates are replaced and summaries reset; new chapters start on page 0.
    Chapters beyond the new count stay, as ``stale``. ``current`` is (book_id, idx,
    page_start, page_end, title, total_code_points, start_pos, end_pos, raw_text,
    summary_text, summary_url, summarized); ``artifacts`` are rendered chapters.
    """
    keys = ["book_id", "idx"]
    fresh = artifacts.select(
        "book_id",
        F.col("chapter_idx").alias("idx"),
        F.col("title").alias("_title"),
        F.col("total_code_points").alias("_total_code_points"),
        F.col("start_pos").alias("_start_pos"),
        F.col("end_pos").alias("_end_pos"),
        preview(F.col("text")).alias("_raw_text"),
        F.lit(True).alias("_new"),
    )
    runs = artifacts.select("book_id").distinct().withColumn("_run", F.lit(True))
    joined = current.join(fresh, keys, "full").join(runs, "book_id", "left")
    hit = F.col("_new").isNotNull()

    def column(name: str) -> Column:
        if f"_{name}" in fresh.columns:
            return F.when(hit, F.col(f"_{name}")).otherwise(F.col(name)).alias(name)
        if name in ("page_start", "page_end"):
            return F.coalesce(name, F.lit(0)).alias(name)
        if name in ("summary_text", "summary_url"):
            return F.when(~hit, F.col(name)).alias(name)
        if name == "summarized":
            return F.when(hit, F.lit(False)).otherwise(F.col(name)).alias(name)
        return F.col(name)

    stale = (F.col("_run").isNotNull() & ~hit).alias("stale")
    return joined.select(*[column(c) for c in current.columns], stale)


# ------------------------------------------------------------------------ jobs


def numbered_logs(logs: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Sequence number of each log in its job, after those already stored."""
    numbered = prefix_scan(
        logs.withColumn("_slice", slice_of(F.col("id"))), ["job_id"], ["_slice"], ["id"], {"seq": ("count", F.lit(1))}
    ).drop("_slice")
    if counts is None:
        return numbered
    before = counts.select("job_id", F.col("n").alias("_n"))
    return numbered.join(before, "job_id", "left").withColumn("seq", F.col("seq") + F.coalesce("_n", F.lit(0))).drop("_n")


def log_payload(payload: Column) -> Column:
    """JSON of a payload map; an empty one is null."""
    return F.when(F.size(payload) > 0, F.to_json(payload))


def latest_jobs(jobs: DataFrame) -> DataFrame:
    return latest(jobs, ["book_id", "pipeline_type"], ["created_at", "id"])


def active_jobs(jobs: DataFrame) -> DataFrame:
    """Newest active normalization job per book."""
    active = jobs.filter(F.col("status").isin("QUEUED", "PROCESSING") & (F.col("pipeline_type") == "NORMALIZATION"))
    return latest(active, ["book_id"], ["created_at", "id"])


def replay_jobs(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Job rows after ordered changes; every change sets the status, so the last one decides."""
    last = latest(changes, ["id"], ["seq"]).select(
        "id", F.col("status").alias("_status"), F.col("step").alias("_step"), F.col("failure_code").alias("_code")
    )
    joined = jobs.join(last, "id", "left")
    changed = F.col("_status").isNotNull()
    return joined.select(
        *[
            F.coalesce("_status", c).alias(c) if c == "status"
            else F.when(changed, F.col("_step")).otherwise(F.col(c)).alias(c) if c == "current_step"
            else F.when(changed, F.when(F.col("_status") == "FAILED", F.col("_code"))).otherwise(F.col(c)).alias(c)
            if c == "failure_code" else F.col(c)
            for c in jobs.columns
        ]
    )


def retry_jobs(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Verdict per retry request (request_id, id): accepted, or why not.

    Only failed normalization jobs of a book without an active job may be retried, and
    the first accepted request makes its book busy for the others.
    """
    known = requests.join(jobs.select("id", "book_id", "status", "pipeline_type"), "id", "left")
    busy = active_jobs(jobs).select("book_id").withColumn("_busy", F.lit(True))
    checked = known.join(busy, "book_id", "left").withColumn(
        "verdict",
        F.when(F.col("status").isNull(), "unknown")
        .when(F.col("status") != "FAILED", "not failed")
        .when(F.col("pipeline_type") != "NORMALIZATION", "not normalization")
        .when(F.col("_busy"), "busy")
        .otherwise("accepted"),
    )
    first = checked.filter("verdict = 'accepted'").groupBy("book_id").agg(F.min("request_id").alias("_first"))
    return checked.join(first, "book_id", "left").select(
        "request_id",
        "id",
        "book_id",
        F.when((F.col("verdict") == "accepted") & (F.col("request_id") != F.col("_first")), "busy")
        .otherwise(F.col("verdict"))
        .alias("verdict"),
    )
