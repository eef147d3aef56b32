"""Validated ingest of the four payload kinds.

Each function takes uploads (upload_id, book_id, file, json) and the stored tables,
and returns the rows to write, the rejected rows, and the books touched. An upload is
all or nothing. Payload items are exploded first, so no upload is held by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.functions import ids
from plotweave.functions.coords import offset_to_locator, total_code_points
from plotweave.functions.text import description, is_blank, join_names, newlines, optional_text
from plotweave.operators import quality
from plotweave.plans.spread import in_portions
from plotweave.session import cut
from plotweave.sources import payloads

UPLOAD = ["upload_id", "book_id"]
#: Files, items and weights together that one task brings to their events.
ENTRIES = 1_000_000


def _rejects(*parts: DataFrame) -> DataFrame:
    rows = [p.select(*UPLOAD, F.explode("reasons").alias("reason")) for p in parts]
    out = rows[0]
    for part in rows[1:]:
        out = out.unionByName(part)
    return out


def _any(*marks: Column) -> Column:
    """Whether one of the marks is true; a missing mark is not."""
    out = F.lit(False)
    for mark in marks:
        out = out | F.coalesce(mark, F.lit(False))
    return out


def _broken(x: Column) -> Column:
    return F.size(x["reasons"]) > 0


def _delta_keys(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """One row of keys per parsed file: ids of items and weights, in their order, and what is wrong by itself.

    ``faults`` (reasons of each item) and ``missing`` (of each weight) are null where there is nothing to say.
    """

    def item(i: Column) -> Column:
        said = payloads.delta_item(i)
        ends = {f"{end}_id": ids.character_id(said[f"{end}_raw"]) for end in ("from", "to")}
        seen = {name: said[name] for name in ("labels", "positivity", "evidence_count")}
        return F.struct(*[c.alias(name) for name, c in {**ends, **seen}.items()])

    def weight(entry: Column) -> Column:
        said = payloads.delta_weight(entry)
        return F.struct(ids.character_id(said["character_raw"]).alias("character_id"), said["missing"].alias("missing"))

    read = parsed.select(
        *keep,
        quality.reasons(quality.delta_file_rules()).alias("reasons"),
        F.transform("items", item).alias("_items"),
        F.transform(F.map_entries("node_weights"), weight).alias("_weights"),
    )
    judged = read.withColumns(
        {"_faults": F.transform("_items", lambda i: quality.reasons(quality.delta_item_rules(i))), "_missing": F.col("_weights")["missing"]}
    )
    return judged.select(
        *keep,
        "reasons",
        F.col("_items")["from_id"].alias("from_ids"),
        F.col("_items")["to_id"].alias("to_ids"),
        F.when(F.exists("_faults", lambda x: F.size(x) > 0), F.col("_faults")).alias("faults"),
        F.col("_weights")["character_id"].alias("weight_ids"),
        F.when(F.exists("_missing", lambda x: x), F.col("_missing")).alias("missing"),
    )


def _edges_apart(files: DataFrame, place: list[str]) -> DataFrame:
    """``files`` with ``first_no``, the number of the first of a row's items, and ``edge_twice``.

    Files are partitioned by ``place`` already and stay there. A file that alone names its event
    and has no edge twice keeps one row; of all others each item gets a row and is counted. What
    is said of the file and its weights stays with the first of its rows.
    """
    # Equal edges have equal hashes; a clash only costs the file its single row.
    hashes = F.zip_with("from_ids", "to_ids", lambda a, b: F.xxhash64(a, b))
    apart = _any(F.col("event_twice"), F.size(F.array_distinct(hashes)) < F.size(hashes)) & _any(F.size("from_ids") > 0)
    marked = files.withColumn("_apart", apart)
    numbers = F.when(F.col("_apart"), F.sequence(F.lit(0), F.size("from_ids") - 1)).otherwise(F.array(F.lit(0)))
    rows = marked.withColumn("first_no", F.explode(numbers))
    first = F.col("first_no") == 0

    def part(name: str) -> Column:
        return F.when(F.col("_apart"), F.slice(name, F.col("first_no") + 1, 1)).otherwise(F.col(name))

    rows = rows.withColumns(
        {
            **{name: part(name) for name in ("from_ids", "to_ids", "faults")},
            **{name: F.when(first, F.col(name)) for name in ("weight_ids", "missing")},
            "reasons": F.when(first, F.col("reasons")).otherwise(F.array().cast("array<string>")),
        }
    )
    ends = {f"_{end}": F.when(F.col("_apart"), F.get(f"{end}_ids", F.lit(0))) for end in ("from", "to")}
    counted = quality.flag_repeated(rows.withColumns(ends), place, ["upload_id", "event_id", *ends], "edge_twice")
    return counted.drop("_apart", *ends)


def _rosters(characters: DataFrame) -> DataFrame:
    """One row per book: its characters' rows by character id. A book's cast is a map of keys, without its texts."""
    people = characters.select("book_id", "character_id", F.struct(F.col("id").alias("char_id")).alias("row"))
    return (
        people.dropna(subset=["book_id", "character_id"])
        .repartition("book_id")
        .groupBy("book_id", "character_id")
        .agg(F.collect_list("row").alias("rows"))
        .groupBy("book_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("character_id", "rows"))).alias("roster"))
    )


def _known_people(files: DataFrame, rosters: DataFrame) -> DataFrame:
    """The keys of ``files`` as items and weights with their characters, one for each row found, and all their reasons."""
    nobody = F.array(F.struct(F.lit(None).cast(rosters.schema["roster"].dataType.valueType.elementType["char_id"].dataType).alias("char_id")))

    def found(character: Column) -> Column:
        return F.coalesce(F.try_element_at("roster", character), nobody)

    def item(from_id: Column, n: Column) -> Column:
        to_id = F.get("to_ids", n)
        faults = F.coalesce(F.get("faults", n), F.array().cast("array<string>"))

        def pair(a: Column, b: Column) -> Column:
            unknown = a["char_id"].isNull() | b["char_id"].isNull()
            return F.struct(
                (F.col("first_no") + n).alias("item_no"),
                from_id.alias("from_id"),
                to_id.alias("to_id"),
                a["char_id"].alias("from_char_id"),
                b["char_id"].alias("to_char_id"),
                F.concat(faults, quality.reasons(quality.delta_lookup_rules(unknown))).alias("reasons"),
            )

        return F.flatten(F.transform(found(from_id), lambda a: F.transform(found(to_id), lambda b: pair(a, b))))

    def weight(character_id: Column, n: Column) -> Column:
        missing = F.get("missing", n)

        def one(a: Column) -> Column:
            rules = quality.delta_weight_rules(character_id, missing, a["char_id"].isNull())
            return F.struct(
                n.alias("weight_no"),
                character_id.alias("character_id"),
                a["char_id"].alias("char_id"),
                quality.reasons(rules).alias("reasons"),
            )

        return F.transform(found(character_id), one)

    # Casts are few and small, so files need not be sorted to meet them, whatever a book holds.
    return files.join(rosters.hint("shuffle_hash"), "book_id", "left").withColumns(
        {"items": F.flatten(F.transform("from_ids", item)), "weights": F.flatten(F.transform("weight_ids", weight))}
    ).drop("from_ids", "to_ids", "faults", "weight_ids", "missing", "first_no", "edge_twice", "roster")


def deltas(uploads: DataFrame, events: DataFrame, characters: DataFrame) -> dict[str, DataFrame]:
    """Relationship deltas: edges and stats of clean uploads, and the events they replace.

    Files are parsed and written once, with a number per file. A file moves twice as one row of
    keys and of verdicts found where it was parsed: to its event, in as many parts as there are
    entries for, and to its book's cast. What was found is written once; texts and weights join
    the keys of clean uploads by the file's number.
    """
    place = ["book_id", "chapter_idx", "event_idx"]
    sizes = [F.greatest(F.size(name), F.lit(0)) for name in ("items", "node_weights")]
    parsed = cut(
        payloads.parse_deltas(uploads)
        .withColumn("event_idx", ids.event_idx(F.col("event_ref"), F.col("chapter_idx")))
        .withColumn("_entries", sizes[0] + sizes[1] + 1)
        .withColumn("_file", F.monotonically_increasing_id())
    )
    entries = parsed.agg(F.sum("_entries")).first()[0] or 0

    def near(rows: DataFrame) -> DataFrame:
        return in_portions(rows, entries, ENTRIES, *place)

    known_events = near(events.select("book_id", "chapter_idx", F.col("idx").alias("event_idx"), F.col("id").alias("event_id")))

    files = near(_delta_keys(parsed, ["upload_id", *place, "_file"]))
    placed = quality.flag_repeated(files.join(known_events, place, "left"), place, ["upload_id"], "event_twice")
    placed = placed.withColumn("reasons", F.concat("reasons", quality.reasons(quality.delta_event_rules())))
    apart = _edges_apart(placed, place).drop("chapter_idx", "event_idx", "event_twice")
    checked = cut(
        _known_people(apart, _rosters(characters)).withColumn(
            "bad", _any(F.size("reasons") > 0, F.exists("items", _broken), F.exists("weights", _broken))
        )
    )
    rejected = checked.filter("bad").select(*UPLOAD).distinct()

    # A bad row's upload is among the rejected ones, unless a part of its key is missing.
    open_rows = checked.filter(~F.col("bad") | F.col("upload_id").isNull() | F.col("book_id").isNull())

    def clean(*columns: str) -> DataFrame:
        return open_rows.select(*UPLOAD, "event_id", *columns).join(rejected, UPLOAD, "left_anti")

    def text(i: Column) -> Column:
        said = payloads.delta_item(i)
        return F.struct(
            said["reason"].alias("explanation"),
            F.to_json(said["labels"]).alias("relation_tags"),
            said["evidence_count"].alias("interaction_count"),
            said["positivity"].cast("float").alias("sentiment_score"),
        )

    texts = parsed.select("_file", F.transform("items", text).alias("texts"))
    whole = F.filter("items", lambda i: F.size(i["reasons"]) == 0)
    told = F.transform(whole, lambda i: F.struct(i.alias("keys"), F.get("texts", i["item_no"]).alias("said")))
    edges = clean("_file", "items").join(texts, "_file", "inner").select(*UPLOAD, "event_id", F.explode(told).alias("i")).select(
        "upload_id",
        "event_id",
        "book_id",
        *[F.col(f"i.keys.{c}") for c in ("from_id", "to_id", "from_char_id", "to_char_id")],
        *[F.col(f"i.said.{c}") for c in ("explanation", "relation_tags", "interaction_count", "sentiment_score")],
    )
    values = parsed.select(
        "_file", F.transform(F.map_entries("node_weights"), lambda w: payloads.delta_weight(w)["node_weight"]).alias("values")
    )
    weighed = F.transform("weights", lambda w: F.struct(w.alias("keys"), F.get("values", w["weight_no"]).alias("node_weight")))
    stats = clean("_file", "weights").join(values, "_file", "inner").select(*UPLOAD, "event_id", F.explode(weighed).alias("w")).select(
        "upload_id", "event_id", "book_id", F.col("w.keys.character_id"), F.col("w.keys.char_id"), F.col("w.node_weight")
    )
    said = [F.flatten(F.transform(name, lambda x: x["reasons"])) for name in ("items", "weights")]
    nothing = F.array().cast("array<string>")
    every = checked.select(*UPLOAD, F.concat("reasons", *[F.coalesce(s, nothing) for s in said]).alias("reasons"))
    return {
        "edges": edges,
        "stats": stats,
        "replaced_events": clean().distinct(),
        "rejects": _rejects(every.filter(F.size("reasons") > 0)),
        "rejected_uploads": rejected,
    }


def newest_uploads(done: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """When several uploads replace one event, only the last one counts."""
    last = done["replaced_events"].groupBy("book_id", "event_id").agg(F.max("upload_id").alias("upload_id"))
    keys = ["event_id", "upload_id"]
    kept = {name: done[name].join(last.select(*keys), keys, "left_semi") for name in ("edges", "stats")}
    return {**done, **kept, "replaced_events": last}


def replace_by_event(current: DataFrame, incoming: DataFrame, replaced: DataFrame) -> DataFrame:
    """Rows after a replacement: everything of the replaced events goes, the new rows come in."""
    kept = current.join(replaced.select("event_id"), "event_id", "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


#: Code points of one chunk of a chapter's text.
CHUNK = 4096


def text_chunks(texts: DataFrame) -> DataFrame:
    """Chapter texts (book_id, idx, text) with normalized newlines, cut into chunks of `CHUNK`."""
    body = texts.select("book_id", F.col("idx").alias("chapter_idx"), newlines(F.col("text")).alias("_text"))
    last = F.floor(F.greatest(F.length("_text") - 1, F.lit(0)) / CHUNK)
    return body.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(
        "book_id", "chapter_idx", "chunk", F.expr(f"substring(_text, int(chunk * {CHUNK} + 1), {CHUNK})").alias("chunk_text")
    )


def differing_texts(items: DataFrame, chunks: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of items whose text is not what their chapter says from start_txt to end_txt.

    ``items`` lie inside their chapters. Each is cut at the chunks' borders, so a row holds
    one part of an item and one chunk, never a chapter.
    """
    cut_at = items.select(
        *key, "book_id", "chapter_idx", "start_txt", "end_txt", newlines(F.col("raw_text")).alias("_given"),
        F.explode(F.sequence(F.floor(F.col("start_txt") / CHUNK), F.floor((F.col("end_txt") - 1) / CHUNK))).alias("chunk"),
    )
    begin = F.greatest(F.col("start_txt").cast("long"), F.col("chunk") * CHUNK)
    end = F.least(F.col("end_txt").cast("long"), (F.col("chunk") + 1) * CHUNK)
    # The last part takes all that is left, so that a text too long differs.
    is_last = F.col("chunk") == F.floor((F.col("end_txt") - 1) / CHUNK)
    parts = cut_at.withColumns({"_begin": begin, "_end": end}).select(
        *key, "book_id", "chapter_idx", "chunk", "_begin", "_end",
        F.substring("_given", F.col("_begin") - F.col("start_txt") + 1, F.when(is_last, F.length("_given")).otherwise(F.col("_end") - F.col("_begin"))).alias("_part"),
    )
    said = F.substring("chunk_text", F.col("_begin") - F.col("chunk") * CHUNK + 1, F.col("_end") - F.col("_begin"))
    joined = parts.join(chunks, ["book_id", "chapter_idx", "chunk"], "left")
    return joined.filter(~F.col("_part").eqNullSafe(said)).select(*key).distinct()


def events(uploads: DataFrame, chapters: DataFrame, texts: DataFrame, existing: DataFrame, strict: bool = False) -> dict[str, DataFrame]:
    """Events: offsets checked against the chapter text, locators resolved.

    ``texts`` is (book_id, idx, text). A file without items brings no rows, but has to name a
    known chapter that has no events yet. ``strict``: see `quality.event_rules`.
    """
    # Parsed and written once. Rules see keys, offsets and verdicts; texts move to be compared,
    # and those of clean uploads once more to their places.
    parsed = cut(
        payloads.parse_events(uploads)
        .withColumn("idx", ids.event_idx(F.col("event_raw"), F.col("chapter_idx")))
        .withColumn("_item", F.monotonically_increasing_id())
    )
    held = existing.select("chapter_id").distinct().withColumn("has_events", F.lit(True))
    known = chapters.select(
        "book_id", F.col("idx").alias("chapter_idx"), "chapter_id", "starts", "lengths", "total_code_points"
    ).join(held, "chapter_id", "left")
    sizes = texts.select("book_id", F.col("idx").alias("chapter_idx"), F.length(newlines(F.col("text"))).alias("chapter_length"))
    start, end = F.col("start_txt"), F.col("end_txt")
    long_enough = F.length(newlines(F.col("raw_text"))) == end - start
    items = parsed.withColumns({"text_blank": is_blank(F.col("raw_text")), "text_short": ~long_enough}).drop("raw_text", "event_raw")
    rows = quality.flag_repeated(items, ["upload_id", "file", "chapter_idx", "idx"], [], "idx_twice")
    rows = rows.join(known, ["book_id", "chapter_idx"], "left").join(sizes, ["book_id", "chapter_idx"], "left")
    total = total_code_points(F.col("total_code_points"), F.col("starts"), F.col("lengths"))
    placeable = (start < end) & F.coalesce((start >= 0) & (end <= F.col("chapter_length")), F.lit(True))

    def place(offset: str):
        at = offset_to_locator(F.col("chapter_idx"), F.col("starts"), F.col("lengths"), total, F.col(offset))
        return F.when(placeable, at)

    # Places are found here, beside the chapter, so that no item carries a chapter's arrays on.
    rows = rows.withColumns(
        {
            "chapter_known": F.col("chapter_id").isNotNull(),
            "chapter_ready": F.col("starts").isNotNull() & F.col("lengths").isNotNull() & F.col("total_code_points").isNotNull(),
            "has_events": F.coalesce("has_events", F.lit(False)),
            "start_at": place("start_txt"),
            "end_at": place("end_txt"),
        }
    ).drop("starts", "lengths", "total_code_points")
    # A text of another length differs, so only as many chunks are asked for as the text fills.
    given = parsed.filter((start >= 0) & (start < end) & long_enough)
    wrong = differing_texts(given, text_chunks(texts), ["_item"]).withColumn("_differs", F.lit(True))
    marked = rows.join(wrong, "_item", "left").withColumn(
        "text_differs", F.coalesce("_differs", F.lit(False)) | F.coalesce("text_short", F.lit(False))
    )
    checked = cut(
        quality.with_reasons(marked, quality.event_rules(strict)).select(
            *UPLOAD, "_item", "item_no", "chapter_id", "chapter_idx", "idx", "start_at", "end_at", "start_txt", "end_txt", "reasons"
        )
    )
    good, bad = quality.split_uploads(checked, UPLOAD)
    out = good.filter("item_no IS NOT NULL").join(parsed.select("_item", "event_raw", "raw_text"), "_item", "inner").select(
        "book_id",
        "chapter_id",
        "chapter_idx",
        "idx",
        ids.normalized_event_id(F.col("event_raw"), F.col("chapter_idx"), F.col("idx")).alias("event_id"),
        F.col("start_at.blockIndex").alias("start_block"),
        F.col("start_at.offset").alias("start_offset"),
        F.col("end_at.blockIndex").alias("end_block"),
        F.col("end_at.offset").alias("end_offset"),
        "start_txt",
        "end_txt",
        "raw_text",
    )
    return {"events": out, "rejects": _rejects(bad), "rejected_uploads": bad.select(*UPLOAD).distinct()}


def roster(uploads: DataFrame, existing: DataFrame) -> dict[str, DataFrame]:
    """Characters: new ones only, existing ones are skipped; the book prompt rides along."""
    parsed = payloads.parse_roster(uploads)
    items = parsed.filter("item_no IS NOT NULL")
    good, bad = quality.split_uploads(quality.with_reasons(items, quality.roster_rules()), UPLOAD)
    rows = good.select(
        "book_id",
        ids.character_id(F.col("character_raw")).alias("character_id"),
        optional_text(F.col("common_name")).alias("name"),
        join_names(F.col("names"), optional_text(F.col("common_name"))).alias("names"),
        "is_main",
        F.lit(1).alias("first_chapter_idx"),
        description(F.col("descriptions"), F.col("description_ko")).alias("personality_text"),
        optional_text(F.col("portrait_prompt")).alias("profile_text"),
        F.lit("PENDING").alias("image_status"),
    )
    fresh = rows.join(existing.select("book_id", "character_id"), ["book_id", "character_id"], "left_anti")
    rejected = bad.select(*UPLOAD).distinct()
    prompts = (
        parsed.join(rejected, UPLOAD, "left_anti")
        .select("book_id", optional_text(F.col("book_prompt")).alias("book_prompt"))
        .filter("book_prompt IS NOT NULL")
        .distinct()
    )
    return {"characters": fresh, "prompts": prompts, "rejects": _rejects(bad), "rejected_uploads": rejected}


def summaries(uploads: DataFrame, chapters: DataFrame, characters: DataFrame, existing: DataFrame) -> dict[str, DataFrame]:
    """Point-of-view summaries of chapters that have none yet."""
    parsed = payloads.parse_summaries(uploads).withColumn("character_id", ids.character_id(F.col("character_raw")))
    known = chapters.select("book_id", F.col("idx").alias("chapter_idx"), "chapter_id")
    held = existing.select("chapter_id").distinct().withColumn("has_summaries", F.lit(True))
    people = characters.select("book_id", "character_id", F.col("id").alias("char_id"))
    rows = (
        parsed.join(known, ["book_id", "chapter_idx"], "left")
        .join(held, "chapter_id", "left")
        .join(people, ["book_id", "character_id"], "left")
        .withColumns(
            {
                "chapter_known": F.col("chapter_id").isNotNull(),
                "has_summaries": F.coalesce("has_summaries", F.lit(False)),
                "character_unknown": F.col("char_id").isNull(),
            }
        )
    )
    good, bad = quality.split_uploads(quality.with_reasons(rows, quality.summary_rules()), UPLOAD)
    out = good.select("book_id", "chapter_id", "char_id", optional_text(F.col("summary_text")).alias("summary_text"))
    return {
        "summaries": out,
        "summarized_chapters": good.select("book_id", "chapter_id").distinct(),
        "rejects": _rejects(bad),
        "rejected_uploads": bad.select(*UPLOAD).distinct(),
    }
