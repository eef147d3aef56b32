"""From text blocks to canonical chapters, as DataFrame steps.

All groups here are a book, a document or a chapter of one archive. An archive is one
binary row that a reader task already holds, so these groups are bounded by the size
of a single file and plain windows are safe. ``block_starts`` and
``heading_sections`` also serve block tables of other origin and are sliced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions import titles
from plotweave.functions.text import collapse, is_blank, optional_text, xml_escaped
from plotweave.plans.scan import prefix_scan, slice_of

MAX_CHAPTERS = 20


# --------------------------------------------------------------------- blocks


def block_starts(blocks: DataFrame) -> DataFrame:
    """Offset of each block in its chapter: lengths of the blocks before it."""
    sliced = blocks.withColumn("_slice", slice_of(F.col("block_idx")))
    scanned = prefix_scan(
        sliced, ["chapter_id"], ["_slice"], ["block_idx"], {"start": ("sum", F.col("length").cast("long"))}, inclusive=False
    )
    return scanned.withColumn("start", F.coalesce("start", F.lit(0).cast("long"))).drop("_slice")


def heading_sections(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Cut each document at chapter-like headings.

    Only documents with two such headings or more are cut; blocks before the first
    one are dropped. Other documents keep all blocks in section 0.
    """
    marked = blocks.withColumn(
        "_heading", (F.col("tag").isin("h1", "h2", "h3") & F.col("text").rlike(titles.HEADING)).cast("int")
    ).withColumn("_slice", slice_of(F.col("block_idx")))
    totals = marked.groupBy(*keys).agg(F.sum("_heading").alias("_headings"))
    running = prefix_scan(marked, keys, ["_slice"], ["block_idx"], {"_section": ("sum", F.col("_heading"))})
    cut = F.col("_headings") >= 2
    return (
        running.join(totals, keys, "inner")
        .withColumn("section", F.when(cut, F.col("_section")).otherwise(F.lit(0)).cast("int"))
        .filter(~cut | (F.col("section") >= 1))
        .drop("_heading", "_slice", "_headings", "_section")
    )


def section_titles(sections: DataFrame, doc_titles: DataFrame, keys: list[str]) -> DataFrame:
    """One row per section: the heading, or the document's own title."""
    first = sections.groupBy(*keys, "section").agg(
        F.min_by("text", "block_idx").alias("_first"), F.min("block_idx").alias("first_block"), F.max("block_idx").alias("last_block")
    )
    return first.join(doc_titles, keys, "left").select(
        *keys,
        "section",
        "first_block",
        "last_block",
        F.when(F.col("section") >= 1, F.col("_first"))
        .otherwise(F.coalesce(F.col("doc_title"), F.lit("Untitled Chapter")))
        .alias("title"),
    )


# ------------------------------------------------------------------- toc spans


def anchor_index(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """First block that carries each anchor."""
    return (
        blocks.withColumn("fragment", F.explode("anchors"))
        .groupBy(*keys, "fragment")
        .agg(F.min("block_idx").alias("at"))
    )


def toc_spans(leaves: DataFrame, blocks: DataFrame) -> DataFrame:
    """Block span of every table-of-contents leaf inside its document.

    A leaf starts at its anchor and ends where the next leaf of the document starts.
    Leaves without a usable anchor start where the last kept leaf ended, so each
    document's leaves are walked in order; they come from one archive's contents page.
    A next leaf without any fragment counts as starting at 0, which drops the current
    leaf; empty spans are dropped.
    """
    doc = ["book_id", "doc_href"]
    sizes = blocks.groupBy(*doc).agg((F.max("block_idx") + 1).alias("blocks"))
    placed = leaves.join(anchor_index(blocks, doc), [*doc, "fragment"], "left").join(sizes, doc, "inner")
    has_fragment = ~is_blank(F.col("fragment"))
    in_doc = Window.partitionBy(*doc).orderBy("leaf_no")
    # What this leaf means to the one before it.
    as_end = F.when(~has_fragment, F.lit(0)).otherwise(F.coalesce("at", "blocks"))
    ended = placed.withColumns(
        {
            "_end": F.coalesce(F.lead(as_end).over(in_doc), F.col("blocks")),
            "_at": F.when(has_fragment, F.col("at")),
            "_plain": ~has_fragment,
        }
    )
    walked = ended.groupBy(*doc).agg(
        F.array_sort(F.collect_list(F.struct("leaf_no", "_at", "_end", "_plain", "blocks"))).alias("_leaves")
    )

    def step(state: Column, leaf: Column) -> Column:
        resumed = F.when(leaf["_plain"] & (state["end"] == leaf["blocks"]), F.lit(0)).otherwise(state["end"])
        start = F.coalesce(leaf["_at"], resumed)
        kept = leaf["_end"] > start
        span = F.struct(leaf["leaf_no"].alias("leaf_no"), start.alias("start"), leaf["_end"].alias("end"))
        return F.struct(
            F.when(kept, leaf["_end"]).otherwise(state["end"]).alias("end"),
            F.when(kept, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    zero = F.struct(
        F.lit(0).alias("end"), F.array().cast("array<struct<leaf_no:int,start:int,end:int>>").alias("spans")
    )
    spans = walked.select(*doc, F.explode(F.aggregate("_leaves", zero, step, lambda s: s["spans"])).alias("s"))
    return spans.select(*doc, F.col("s.leaf_no").alias("leaf_no"), F.col("s.start").alias("start"), F.col("s.end").alias("end")).join(
        leaves.select(*doc, "leaf_no", "title", "path", "depth", "fragment"), [*doc, "leaf_no"], "inner"
    )


def document_order(docs: DataFrame, leaves: DataFrame) -> DataFrame:
    """Documents of a book: spine order first, then those only the contents page names; ``doc_order`` sorts as (g, n)."""
    spine = docs.filter("in_spine").select("book_id", "doc_href", F.struct(F.lit(0).alias("g"), F.col("doc_order").alias("n")).alias("o"))
    toc = leaves.select("book_id", "doc_href", F.struct(F.lit(1).alias("g"), F.col("leaf_no").alias("n")).alias("o"))
    return spine.unionByName(toc).groupBy("book_id", "doc_href").agg(F.min("o").alias("o")).select(
        "book_id", "doc_href", F.col("o").alias("doc_order")
    )


def split_units(docs: DataFrame, blocks: DataFrame, leaves: DataFrame) -> DataFrame:
    """Units of every book, in reading order, with the block range each one covers.

    Books whose contents page yields no unit at all are cut by headings only.
    """
    doc = ["book_id", "doc_href"]
    spans = toc_spans(leaves, blocks)
    from_toc = spans.select(
        *doc, "start", "end", F.col("leaf_no").alias("part"), "title", "path", "depth", F.lit("TOC").alias("origin")
    )
    # A section is named by its heading, so other texts stay where they are.
    is_head = F.col("tag").isin("h1", "h2", "h3")
    headed = blocks.select(*doc, "block_idx", "tag", F.when(is_head, F.col("text")).otherwise("").alias("text"))
    sections = section_titles(
        heading_sections(headed, doc), docs.select(*doc, "doc_title"), doc
    ).select(
        *doc,
        F.col("first_block").alias("start"),
        (F.col("last_block") + 1).alias("end"),
        F.col("section").alias("part"),
        "title",
        F.array("title").alias("path"),
        F.lit(1).alias("depth"),
        F.lit("HEADING").alias("origin"),
    )
    spine_docs = docs.filter("in_spine").select(*doc)
    with_leaves = leaves.select(*doc).distinct()
    # Documents without leaves are cut by headings, and so are all spine documents of
    # a book for which the contents page gave nothing.
    sections = sections.join(spine_docs, doc, "left_semi")
    no_leaf = sections.join(with_leaves, doc, "left_anti")
    found = from_toc.unionByName(no_leaf)
    empty_books = sections.join(found.select("book_id").distinct(), ["book_id"], "left_anti")
    everything = found.unionByName(empty_books).join(document_order(docs, leaves), doc, "inner")
    in_book = Window.partitionBy("book_id").orderBy("doc_order", "part")
    return everything.withColumn("unit_no", F.row_number().over(in_book)).drop("doc_order", "part")


def unit_blocks(units: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks of every unit; spans of one document may overlap, so a block can repeat.

    The length is taken before the join: who asks for no text moves none.
    """
    spans = units.select("book_id", "doc_href", "unit_no", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("block_idx"))
    return spans.join(
        blocks.select("book_id", "doc_href", "block_idx", "tag", "text", F.length("text").alias("length")),
        ["book_id", "doc_href", "block_idx"],
        "inner",
    )


def size_and_classify(units: DataFrame, pieces: DataFrame) -> DataFrame:
    """Code points, block count and role of every unit."""
    sizes = pieces.groupBy("book_id", "unit_no").agg(
        F.sum("length").cast("int").alias("size"), F.count("*").cast("int").alias("blocks")
    )
    named = units.withColumn(
        "title", F.when(is_blank(F.col("title")), F.lit("Untitled Section")).otherwise(F.col("title"))
    )
    return named.join(sizes, ["book_id", "unit_no"], "inner").withColumn(
        "role", titles.role(F.col("title"), F.col("path"))
    )


# --------------------------------------------------------------------- planner


def kept_units(units: DataFrame) -> DataFrame:
    """Drop front matter, contents, license, index and notes, unless that drops the book."""
    wanted = ~F.col("role").isin(titles.EXCLUDED_ROLES)
    survivors = units.groupBy("book_id").agg(F.count_if(wanted).alias("_kept"))
    return units.join(survivors, "book_id", "inner").filter(wanted | (F.col("_kept") == 0)).drop("_kept")


def act_groups(units: DataFrame) -> DataFrame:
    """Consecutive scenes under one act become one group; other units stand alone."""
    act = F.when(F.col("role") == "SCENE", titles.ancestor_with_prefix(F.col("path"), "act "))
    in_book = Window.partitionBy("book_id").orderBy("unit_no")
    # Both sides must be named and equal; an unnamed act always opens a group.
    opens = (~F.coalesce(F.col("act") == F.lag("act").over(in_book), F.lit(False))).cast("int")
    return (
        units.withColumn("act", act)
        .withColumn("_opens", opens)
        .withColumn("group_no", F.sum("_opens").over(in_book.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
        .drop("_opens")
    )


def cap_groups(units: DataFrame, limit: int = MAX_CHAPTERS) -> DataFrame:
    """At most ``limit`` groups per book, by joining equally many neighbours.

    Needs (book_id, unit_no, group_no, reason, promoted); adds chapter_idx.
    """
    groups = F.max("group_no").over(Window.partitionBy("book_id"))
    chunk = F.greatest(F.ceil(F.col("_n") / limit), F.lit(1))
    chunked = units.withColumn("_n", groups).withColumn(
        "chapter_idx", (F.floor((F.col("group_no") - 1) / chunk) + 1).cast("int")
    )
    chapter = Window.partitionBy("book_id", "chapter_idx")
    joined = F.min("group_no").over(chapter) < F.max("group_no").over(chapter)
    first_promoted = F.min_by("promoted", F.when(F.col("promoted").isNotNull(), F.col("group_no"))).over(chapter)
    return chunked.withColumns(
        {
            "reason": F.when(joined, F.lit("PROMOTE_TO_PARENT")).otherwise(F.col("reason")),
            "promoted": first_promoted,
        }
    ).drop("_n")


def chapter_plans(units: DataFrame) -> DataFrame:
    """Title, role and source documents of each chapter."""
    parent = titles.meaningful_ancestor(F.col("path"))
    rows = units.withColumn("_parent", parent)
    grouped = rows.groupBy("book_id", "chapter_idx").agg(
        F.min_by("title", "unit_no").alias("_first"),
        F.max_by("title", "unit_no").alias("_last"),
        F.min_by("role", "unit_no").alias("_role"),
        F.bool_or(F.col("role") == "CANTO").alias("_canto"),
        F.min_by("_parent", F.when(F.col("_parent").isNotNull(), F.col("unit_no"))).alias("_parent"),
        F.first("reason").alias("reason"),
        F.first("promoted").alias("promoted"),
        F.count("*").cast("int").alias("units"),
        F.sum("size").cast("int").alias("size"),
        F.array_distinct(
            F.transform(F.array_sort(F.collect_list(F.struct("unit_no", "doc_href"))), lambda x: x["doc_href"])
        ).alias("source_docs"),
    )
    promoted = F.col("reason") == "PROMOTE_SCENE_TO_ACT"
    cantos = titles.range_title(F.col("_parent"), "Cantos", F.col("_first"), F.col("_last"))
    title = (
        F.when(promoted & F.col("promoted").isNotNull(), F.col("promoted"))
        .when(F.col("units") == 1, F.col("_first"))
        .when((F.col("reason") == "GROUP_CANTOS") & cantos.isNotNull(), cantos)
        .when(~is_blank(F.col("_parent")), F.col("_parent"))
        .when(F.col("_first") == F.col("_last"), F.col("_first"))
        .otherwise(F.concat("_first", F.lit(" - "), "_last"))
    )
    role = F.when(promoted, "ACT").when(F.col("_canto"), "CANTO").otherwise(F.col("_role"))
    return grouped.select(
        "book_id", "chapter_idx", title.alias("title"), role.alias("role"), "reason", "units", "size", "source_docs"
    )


# ---------------------------------------------------------------------- render


def chapter_blocks(units: DataFrame, pieces: DataFrame) -> DataFrame:
    """Blocks in chapter order with their index and offset."""
    placed = pieces.join(units.select("book_id", "unit_no", "chapter_idx"), ["book_id", "unit_no"], "inner").withColumn(
        "length", F.length("text")
    )
    order = Window.partitionBy("book_id", "chapter_idx").orderBy("unit_no", "block_idx")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "book_id",
        "chapter_idx",
        "unit_no",
        "doc_href",
        "text",
        "length",
        (F.row_number().over(order) - 1).alias("block_idx"),
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("int").alias("start"),
    )


def paragraph_markup(block_idx: Column, href: Column, unit: Column, text: Column) -> Column:
    return F.concat(
        F.lit('<p data-block-index="'),
        block_idx.cast("string"),
        F.lit('"'),
        F.when(~is_blank(href), F.concat(F.lit(' data-spine-href="'), xml_escaped(href), F.lit('"'))).otherwise(""),
        F.when(~is_blank(unit), F.concat(F.lit(' data-source-unit-id="'), xml_escaped(unit), F.lit('"'))).otherwise(""),
        F.lit(">"),
        xml_escaped(text),
        F.lit("</p>"),
    )


def render_chapters(plans: DataFrame, blocks: DataFrame) -> DataFrame:
    """Chapter rows: paragraph arrays, text, markup and position in the book."""
    # Markup is written where a chapter's blocks are together, so that no text moves twice.
    entry = F.struct("block_idx", "start", "length", "text", "doc_href", "unit_no")

    def markup(b: Column) -> Column:
        unit = F.concat(F.lit("unit-"), b["unit_no"].cast("string"))
        return paragraph_markup(b["block_idx"], b["doc_href"], unit, b["text"])

    gathered = blocks.groupBy("book_id", "chapter_idx").agg(F.sort_array(F.collect_list(entry)).alias("_b"))
    spine = F.get("source_docs", F.lit(0))
    opening = F.concat(
        F.lit('<section data-chapter-index="'),
        F.col("chapter_idx").cast("string"),
        F.lit('"'),
        F.when(
            ~is_blank(F.col("spine_href")),
            F.concat(F.lit(' data-representative-spine-href="'), xml_escaped(F.col("spine_href")), F.lit('"')),
        ).otherwise(""),
        F.lit("><h2>"),
        xml_escaped(F.col("title")),
        F.lit("</h2>"),
    )
    chapters = plans.join(gathered, ["book_id", "chapter_idx"], "inner").select(
        "book_id",
        "chapter_idx",
        "title",
        "role",
        "reason",
        spine.alias("spine_href"),
        F.transform("_b", lambda b: b["start"]).alias("starts"),
        F.transform("_b", lambda b: b["length"]).alias("lengths"),
        F.array_join(F.transform("_b", lambda b: b["text"]), "").alias("text"),
        F.array_join(F.transform("_b", markup), "").alias("_body"),
    )
    sized = chapters.withColumns(
        {
            "paragraph_count": F.size("starts"),
            "total_code_points": F.length("text"),
            "markup": F.concat(opening, F.col("_body"), F.lit("</section>")),
        }
    ).drop("_body")
    return book_positions(sized)


def book_positions(chapters: DataFrame) -> DataFrame:
    """Start and end of each chapter in its book; at most 20 chapters each."""
    before = (
        Window.partitionBy("book_id").orderBy("chapter_idx").rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.coalesce(F.sum("total_code_points").over(before), F.lit(0)).cast("int")
    length = F.col("total_code_points")
    return chapters.withColumn("start_pos", start).withColumn(
        "end_pos", F.when(length == 0, F.col("start_pos")).otherwise(F.col("start_pos") + length - 1)
    )


def combined_document(chapters: DataFrame, title: str = "Normalized Reader") -> DataFrame:
    """One document per book holding the markup of its chapters in order."""
    head = (
        '<?xml version="1.0" encoding="UTF-8"?><html xmlns="http://www.w3.org/1999/xhtml"><head>'
        f'<meta charset="UTF-8"/><title>{title}</title></head><body>'
    )
    ordered = F.array_sort(F.collect_list(F.struct("chapter_idx", "markup")))
    return chapters.groupBy("book_id").agg(
        F.concat(F.lit(head), F.array_join(F.transform(ordered, lambda x: x["markup"]), ""), F.lit("</body></html>")).alias(
            "document"
        )
    )


# ---------------------------------------------------------- metadata and report


def metadata(chapters: DataFrame) -> DataFrame:
    """Total code points and ordered chapter structs per book."""
    entry = F.struct(
        "chapter_idx", "title", "spine_href", "paragraph_count", "starts", "lengths", "total_code_points", "start_pos", "end_pos"
    )
    return chapters.groupBy("book_id").agg(
        F.sum("total_code_points").cast("int").alias("total_code_points"),
        F.array_sort(F.collect_list(entry)).alias("chapters"),
    )


def out_of_bounds(starts: Column, lengths: Column, total: Column) -> Column:
    """How many paragraphs leave the chapter."""
    ends = F.arrays_zip(starts.alias("s"), lengths.alias("n"))
    return F.size(F.filter(ends, lambda p: (p["s"] < 0) | (p["s"] + p["n"] > total) | (p["n"] < 0)))


def validation_report(chapters: DataFrame, limit: int = MAX_CHAPTERS) -> DataFrame:
    """One report row per book."""
    checked = chapters.withColumns(
        {
            "_bad": out_of_bounds(F.col("starts"), F.col("lengths"), F.col("total_code_points")),
            "_invalid": titles.is_invalid_title(F.col("title")),
        }
    )
    entry = F.struct("chapter_idx", "title", "paragraph_count", "total_code_points", F.col("_bad").alias("round_trip_failures"))
    report = checked.groupBy("book_id").agg(
        F.count("*").cast("int").alias("chapter_count"),
        F.array_sort(F.collect_list(F.when(F.col("_invalid"), F.col("chapter_idx")))).alias("invalid_title_chapters"),
        F.sum("_bad").cast("int").alias("round_trip_failures"),
        F.sum(F.regexp_count("markup", F.lit("<section data-chapter-index="))).cast("int").alias("section_count"),
        F.array_sort(F.collect_list(entry)).alias("chapters"),
    )
    return report.withColumns(
        {
            "chapter_count_limit": F.lit(limit),
            "within_limit": F.col("chapter_count") <= limit,
            "sections_match": F.col("section_count") == F.col("chapter_count"),
            "invalid_title_count": F.size("invalid_title_chapters"),
            "status": F.when(F.col("round_trip_failures") == 0, "PASS").otherwise("FAIL"),
        }
    )


def structural_audit(chapters: DataFrame) -> DataFrame:
    """Issues per chapter: empty, counts, positions, paragraph starts, totals."""
    in_book = Window.partitionBy("book_id").orderBy("chapter_idx")
    expected = F.coalesce(F.lag("end_pos").over(in_book) + 1, F.lit(0))
    running = F.aggregate(
        F.arrays_zip(F.col("starts").alias("s"), F.col("lengths").alias("n")),
        F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok")),
        lambda acc, p: F.struct((acc["at"] + p["n"]).alias("at"), (acc["ok"] & (p["s"] == acc["at"]) & (p["n"] >= 0)).alias("ok")),
    )
    staged = chapters.withColumns({"_expected": expected, "_running": running})
    issues = F.array(
        F.when((F.col("paragraph_count") <= 0) | (F.col("total_code_points") <= 0), "empty"),
        F.when(
            (F.col("paragraph_count") != F.size("starts")) | (F.col("paragraph_count") != F.size("lengths")), "paragraph count"
        ),
        F.when(F.col("start_pos") != F.col("_expected"), "start position"),
        F.when(F.col("end_pos") != F.col("start_pos") + F.col("total_code_points") - 1, "end position"),
        F.when(~F.col("_running.ok"), "paragraph start"),
        F.when(F.col("_running.at") != F.col("total_code_points"), "paragraph total"),
    )
    return staged.select("book_id", "chapter_idx", F.filter(issues, lambda x: x.isNotNull()).alias("issues"))


def regression_summary(reports: DataFrame, audit: DataFrame, failures: DataFrame) -> DataFrame:
    """Corpus totals: books seen, normalized, failed, and how many break a rule."""
    broken = audit.groupBy("book_id").agg(F.sum(F.size("issues")).alias("issues"))
    good = reports.join(broken, "book_id", "left").agg(
        F.count("*").alias("success"),
        F.count_if(~F.col("within_limit")).alias("over_limit"),
        F.count_if(~F.col("sections_match")).alias("section_mismatch"),
        F.count_if(F.col("invalid_title_count") > 0).alias("invalid_titles"),
        F.count_if(F.coalesce("issues", F.lit(0)) > 0).alias("structure"),
        F.count_if(F.col("round_trip_failures") > 0).alias("round_trip"),
        F.lit(0).cast("bigint").alias("failure"),
    )
    bad = failures.agg(
        *[F.lit(0).cast("bigint").alias(c) for c in ("success", "over_limit", "section_mismatch", "invalid_titles", "structure", "round_trip")],
        F.count("*").alias("failure"),
    )
    summed = good.unionByName(bad).agg(*[F.sum(c).alias(c) for c in good.columns])
    return summed.withColumn("total", F.col("success") + F.col("failure"))


def book_metadata(metas: DataFrame, fallback_language: str = "und") -> DataFrame:
    """Title, author and language of each archive; title and author are required."""
    title, author = (F.nullif(collapse(F.col(c)), F.lit("")) for c in ("title", "author"))
    return metas.select(
        "book_id",
        title.alias("title"),
        author.alias("author"),
        F.coalesce(optional_text(F.col("language")), F.lit(fallback_language)).alias("language"),
        "cover_href",
        F.when(title.isNull(), "title").when(author.isNull(), "author").alias("missing"),
    )
