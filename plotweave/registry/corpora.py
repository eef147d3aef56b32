"""Corpus normalization: markup, units, planning, rendering, reports."""

from pyspark.sql import functions as F

from plotweave.functions import titles
from plotweave.operators import corpus
from plotweave.operators.planner import plan_chapters, plan_groups
from plotweave.registry import planning
from plotweave.registry.base import query
from plotweave.session import cut
from plotweave.sources import archive
from plotweave.sources.bookmaker import archives_from_documents
from plotweave.views import Views

# Sample titles, their paths above the leaf, and the role each one must get.
SAMPLES = [
    ("Chapter 1", ["Contents", "Part One"], "CHAPTER"),
    ("Scene I", ["PLAY", "ACT I"], "SCENE"),
    ("Scene II", ["PLAY", "ACT I"], "SCENE"),
    ("IV", ["Act 2"], "SCENE"),
    ("Scene 3", ["PLAY", "Act 2"], "SCENE"),
    ("Canto 5", ["Book I"], "CANTO"),
    ("Canto VI", ["Book I"], "CANTO"),
    ("CONTENTS", [], "CONTENTS"),
    ("The Full Project Gutenberg License", [], "LICENSE"),
    ("Index of names", [], "INDEX"),
    ("Preface  to the text", [], "FRONTMATTER"),
    ("Epilogue", ["Part Two"], "APPENDIX"),
    ("Footnotes", [], "NOTES"),
    ("Act 3", ["PLAY"], "ACT"),
    ("Book the Second", [], "BOOK"),
    ("Part 2", [], "PART"),
    ("Sonnet 18", ["Poems"], "POEM"),
    ("Tale of Two", ["Stories"], "STORY"),
    ("Lecture 4", [], "ESSAY"),
    ("Letter 9", ["Part Two"], "CHAPTER"),
    ("XII", ["Part Two"], "CHAPTER"),
    ("  ", [], "UNKNOWN"),
    ("A quiet evening", ["Contents"], "UNKNOWN"),
    ("Booking", ["Index"], "UNKNOWN"),
]
N = len(SAMPLES)


def _sql_list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


UNIT = f"""SELECT doc_id // 40 AS book_id, CAST(doc_id % 40 + 1 AS INT) AS unit_no, CAST(n_chars AS INT) AS size,
    ({_sql_list([t for t, _, _ in SAMPLES])})[doc_id * 7 % 40 % {N} + 1] AS title,
    ({_sql_list([r for _, _, r in SAMPLES])})[doc_id * 7 % 40 % {N} + 1] AS role,
    CAST(doc_id * 7 % 40 % {N} AS INT) AS sample FROM documents"""
UNIT_KEPT = """SELECT * FROM unit WHERE role NOT IN ('FRONTMATTER','CONTENTS','LICENSE','INDEX','NOTES')
    OR book_id NOT IN (SELECT book_id FROM unit WHERE role NOT IN ('FRONTMATTER','CONTENTS','LICENSE','INDEX','NOTES'))"""
ACTS = [next((p for p in reversed(path) if p.lower().startswith("act ")), None) for _, path, _ in SAMPLES]
ACT_LIST = "[" + ", ".join(f"'{a}'" if a else "NULL" for a in ACTS) + "]"
PARENTS = [next((p for p in reversed(path) if p not in ("Contents", "Index")), None) for _, path, _ in SAMPLES]
PARENT_LIST = "[" + ", ".join(f"'{a}'" if a else "NULL" for a in PARENTS) + "]"
ACT_GROUP = f"""SELECT *, CAST(sum(CASE WHEN act = prev THEN 0 ELSE 1 END) OVER (PARTITION BY book_id ORDER BY unit_no) AS INT) AS group_no
    FROM (SELECT *, lag(act) OVER (PARTITION BY book_id ORDER BY unit_no) AS prev FROM
      (SELECT *, CASE WHEN role = 'SCENE' THEN ({ACT_LIST})[sample + 1] END AS act, ({PARENT_LIST})[sample + 1] AS parent FROM unit_kept))"""


def _above(prefix: str) -> str:
    """Per sample, the nearest title above it that starts with ``prefix``."""
    found = [next((p for p in reversed(path) if p.lower().startswith(prefix)), None) for _, path, _ in SAMPLES]
    return "[" + ", ".join(f"'{p}'" if p else "NULL" for p in found) + "]"


PLAN = dict(
    unit=UNIT,
    unit_kept=UNIT_KEPT,
    act_group=ACT_GROUP,
    act_unit=f"""SELECT book_id, unit_no, size, title, role, parent, group_no, act AS promoted,
        CASE WHEN act IS NULL THEN 'KEEP_AS_IS' ELSE 'PROMOTE_SCENE_TO_ACT' END AS reason,
        ({_above("")})[sample + 1] AS direct, ({_above("act ")})[sample + 1] AS act_key, ({_above("book ")})[sample + 1] AS book_key FROM act_group""",
    **planning.steps("act_unit"),
)


def units(v: Views):
    def pick(values):
        return F.get(F.array(*values), F.col("sample"))

    path = [F.array(*[F.lit(p) for p in [*above, title]]) for title, above, _ in SAMPLES]
    return (
        v.table("documents")
        .withColumn("sample", F.expr(f"int(doc_id * 7 % 40 % {N})"))
        .select(
            F.expr("doc_id div 40").alias("book_id"),
            F.expr("int(doc_id % 40 + 1)").alias("unit_no"),
            F.concat(F.lit("d"), "doc_id").alias("doc_href"),
            F.col("n_chars").cast("int").alias("size"),
            pick([F.lit(t) for t, _, _ in SAMPLES]).alias("title"),
            pick(path).alias("path"),
        )
        .withColumn("role", titles.role(F.col("title"), F.col("path")))
    )


@query("sc_18_title_role", "SELECT book_id, unit_no, role FROM unit", unit=UNIT)
def _(v: Views):
    return units(v).select("book_id", "unit_no", "role")


@query("flt_13_body_units", "SELECT book_id, unit_no FROM unit_kept", unit=UNIT, unit_kept=UNIT_KEPT)
def _(v: Views):
    return corpus.kept_units(units(v)).select("book_id", "unit_no")


@query(
    "sc_21_ancestors",
    f"SELECT book_id, unit_no, ({PARENT_LIST})[sample + 1] AS parent, ({ACT_LIST})[sample + 1] AS act FROM unit",
    unit=UNIT,
)
def _(v: Views):
    path = F.col("path")
    return units(v).select(
        "book_id",
        "unit_no",
        titles.meaningful_ancestor(path).alias("parent"),
        titles.ancestor_with_prefix(path, "act ").alias("act"),
    )


@query(
    "sc_22_range_title",
    """SELECT book_id, unit_no, CASE WHEN regexp_extract(trim(title), '(?i)(\\d+|[IVXLCDM]+)$', 1) = '' THEN NULL
         ELSE 'Cantos ' || regexp_extract(trim(title), '(?i)(\\d+|[IVXLCDM]+)$', 1) || '-9' END AS range_title FROM unit""",
    unit=UNIT,
)
def _(v: Views):
    return units(v).select(
        "book_id",
        "unit_no",
        titles.range_title(F.lit(None).cast("string"), "Cantos", F.col("title"), F.lit("Canto 9")).alias("range_title"),
    )


@query(
    "sc_19_invalid_title",
    """SELECT book_id, unit_no, trim(title) = '' OR lower(title) = 'contents' OR lower(title) LIKE '%project gutenberg license%'
         OR lower(title) = 'index' OR lower(title) LIKE 'index %' AS invalid FROM unit""",
    unit=UNIT,
)
def _(v: Views):
    return units(v).select("book_id", "unit_no", titles.is_invalid_title(F.col("title")).alias("invalid"))


@query(
    "sc_20_placeholder_title",
    """SELECT book_id, unit_no, lower(title) = 'contents' OR lower(title) LIKE 'index %'
         OR lower(title) = 'the full project gutenberg license' AS placeholder FROM unit""",
    unit=UNIT,
)
def _(v: Views):
    return units(v).select("book_id", "unit_no", titles.is_placeholder(F.lower("title")).alias("placeholder"))


@query(
    "wn_10_scene_act_islands",
    "SELECT book_id, unit_no, group_no FROM act_group",
    unit=UNIT,
    unit_kept=UNIT_KEPT,
    act_group=ACT_GROUP,
)
def _(v: Views):
    return corpus.act_groups(corpus.kept_units(units(v))).select("book_id", "unit_no", "group_no")


@query(
    "nm_8_initial_groups",
    """SELECT book_id, group_no, count(*) AS units, CAST(sum(size) AS BIGINT) AS size,
         CASE WHEN max(act) IS NULL THEN 'KEEP_AS_IS' ELSE 'PROMOTE_SCENE_TO_ACT' END AS reason
       FROM act_group GROUP BY 1, 2""",
    unit=UNIT,
    unit_kept=UNIT_KEPT,
    act_group=ACT_GROUP,
)
def _(v: Views):
    return (
        plan_groups(units(v), steps=())
        .groupBy("book_id", "group_no")
        .agg(F.count("*").alias("units"), F.sum("size").alias("size"), F.first("reason").alias("reason"))
    )


@query(
    "nm_9_merge_short_groups",
    """SELECT book_id, unit_no, CAST(dense_rank() OVER (PARTITION BY book_id ORDER BY leader) AS INT) AS group_no FROM (
         SELECT a.book_id, a.unit_no, CASE WHEN p.pos IS NOT NULL AND p.pos % 2 = 1 THEN a.group_no
             WHEN q.pos IS NOT NULL AND q.pos % 2 = 1 THEN a.group_no - 1 ELSE a.group_no END AS leader
         FROM act_group a LEFT JOIN run p ON p.book_id = a.book_id AND p.group_no = a.group_no AND p.can
           LEFT JOIN run q ON q.book_id = a.book_id AND q.group_no = a.group_no - 1 AND q.can)""",
    unit=UNIT,
    unit_kept=UNIT_KEPT,
    act_group=ACT_GROUP,
    grp="""SELECT book_id, group_no, sum(size) AS size, arg_min(parent, unit_no) FILTER (parent IS NOT NULL) AS parent,
        bool_or(role IN ('CANTO','POEM','STORY','ESSAY','UNKNOWN','APPENDIX')) AS flexible FROM act_group GROUP BY 1, 2""",
    can="""SELECT *, coalesce(size < 3000 AND size + lead(size) OVER w <= 45000
        AND (coalesce(parent = lead(parent) OVER w, false) OR flexible OR lead(flexible) OVER w), false) AS can
        FROM grp WINDOW w AS (PARTITION BY book_id ORDER BY group_no)""",
    run="""SELECT *, row_number() OVER (PARTITION BY book_id, island ORDER BY group_no) AS pos FROM (
        SELECT *, group_no - row_number() OVER (PARTITION BY book_id, can ORDER BY group_no) + CASE WHEN can THEN 0 ELSE 1000000 END AS island FROM can)""",
)
def _(v: Views):
    return plan_groups(units(v), steps=("pair",)).select("book_id", "unit_no", "group_no")


@query("nm_10_bundled_groups", "SELECT book_id, unit_no, CAST(group_no AS INT) AS group_no, reason FROM bundled", **PLAN)
def _(v: Views):
    return plan_groups(units(v), steps=("pair", "bundle")).select("book_id", "unit_no", "group_no", "reason")


@query("nm_11_split_large_groups", "SELECT book_id, unit_no, CAST(group_no AS INT) AS group_no, reason FROM planned", **PLAN)
def _(v: Views):
    return plan_groups(units(v)).select("book_id", "unit_no", "group_no", "reason")


@query(
    "nm_12_capped_chapters",
    """SELECT book_id, count(*) AS units, CAST(sum(size) AS BIGINT) AS size, true AS within_limit, true AS in_order
       FROM unit_kept GROUP BY 1""",
    unit=UNIT,
    unit_kept=UNIT_KEPT,
)
def _(v: Views):
    return (
        plan_chapters(units(v))
        .groupBy("book_id", "chapter_idx")
        .agg(F.count("*").alias("n"), F.sum("size").alias("s"), (F.max("unit_no") - F.min("unit_no") >= F.count("*") - 1).alias("ok"))
        .groupBy("book_id")
        .agg(
            F.sum("n").alias("units"),
            F.sum("s").alias("size"),
            ((F.count("*") <= 20) & (F.max("chapter_idx") == F.count("*"))).alias("within_limit"),
            F.bool_and("ok").alias("in_order"),
        )
    )


@query(
    "wn_11_chapter_cap",
    """SELECT book_id, unit_no, CAST((unit_no - 1) // CAST(ceil(max(unit_no) OVER (PARTITION BY book_id) / 20.0) AS INT) + 1 AS INT) AS chapter_idx
       FROM unit""",
    unit=UNIT,
)
def _(v: Views):
    grouped = units(v).withColumns(
        {"group_no": F.col("unit_no"), "reason": F.lit("KEEP_AS_IS"), "promoted": F.lit(None).cast("string")}
    )
    return corpus.cap_groups(grouped).select("book_id", "unit_no", "chapter_idx")


@query("nm_13_chapter_titles", "SELECT * FROM chapter_plan", **PLAN, chapter_plan=planning.CHAPTER)
def _(v: Views):
    return corpus.chapter_plans(plan_chapters(units(v))).select(
        "book_id", "chapter_idx", "title", "role", "reason", "units", "size"
    )


@query(
    "ag_21_ordered_distinct",
    """SELECT doc_id, lang || CASE WHEN source = lang THEN '' ELSE '|' || source END AS words FROM documents""",
)
def _(v: Views):
    words = F.split(F.concat_ws(",", "lang", "source", "lang"), ",")
    return v.table("documents").select("doc_id", F.array_join(F.array_distinct(words), "|").alias("words"))


# ------------------------------------------------------------------- markup pages


@query(
    "nm_1_sanitize",
    """SELECT page_id, len(regexp_extract_all(html, '<(script|iframe|object|embed|style|link)[ >]')) AS removed_tags,
         len(regexp_extract_all(html, '<p[ >]|<li[ >]|<blockquote|<h[1-6]')) > 0 AS has_blocks FROM pages""",
)
def _(v: Views):
    return (
        archive.page_blocks(v.table("pages"))
        .groupBy("page_id")
        .agg(F.max("removed_tags").cast("bigint").alias("removed_tags"), (F.count("*") > 0).alias("has_blocks"))
    )


@query("nm_2_block_extraction")
def html_blocks(v: Views):
    return archive.page_blocks(v.table("pages")).select("page_id", "block_idx", "tag", "text")


@query("nm_6_heuristic_units")
def _(v: Views):
    blocks = cut(archive.page_blocks(v.table("pages")))
    names = blocks.select("page_id", "doc_title").distinct()
    sections = corpus.heading_sections(blocks, ["page_id"])
    return corpus.section_titles(sections, names, ["page_id"]).select("page_id", "section", "title", "first_block", "last_block")


HEADED = """SELECT chapter_id, block_idx, CASE WHEN block_idx % 3 = 1 THEN 'h2' ELSE 'p' END AS tag,
    CASE WHEN block_idx % 3 = 1 THEN 'Chapter ' || block_idx ELSE text END AS text FROM line"""


@query(
    "wn_15_heading_sections",
    """SELECT chapter_id, block_idx, CASE WHEN total >= 2 THEN CAST(section AS INT) ELSE 0 END AS section FROM (
         SELECT chapter_id, block_idx, sum(CASE WHEN tag = 'h2' THEN 1 ELSE 0 END) OVER (PARTITION BY chapter_id) AS total,
           sum(CASE WHEN tag = 'h2' THEN 1 ELSE 0 END) OVER (PARTITION BY chapter_id ORDER BY block_idx) AS section FROM headed)
       WHERE total < 2 OR section >= 1""",
    headed=HEADED,
)
def _(v: Views):
    is_heading = F.col("block_idx") % 3 == 1
    headed = v.line.withColumn("tag", F.when(is_heading, "h2").otherwise("p")).withColumn(
        "text", F.when(is_heading, F.concat(F.lit("Chapter "), "block_idx")).otherwise(F.col("text"))
    )
    return corpus.heading_sections(headed, ["chapter_id"]).select("chapter_id", "block_idx", "section")


# ----------------------------------------------------------------------- archives

ARCHIVE_LINE = """SELECT doc_id // 5 AS book_id, doc_id, i - 1 AS n, trim(regexp_replace(replace(replace(replace(lines[i],
      chr(160), ' '), chr(8203), ''), chr(173), ''), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' ') AS text
    FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))"""
ARCHIVE_BLOCK = """SELECT book_id, doc_id, n * 2 AS k, 'Chapter ' || (n // 4 + 1) AS text FROM archive_line WHERE n % 4 = 0
    UNION ALL SELECT book_id, doc_id, n * 2 + 1, text FROM archive_line WHERE text <> ''"""
GOOD = "book_id % 13 NOT IN (7, 9, 10, 11, 12)"


def normalized(v: Views) -> dict:
    return archive.normalize_archives(archives_from_documents(v.table("documents")))


def archive_rows(v: Views):
    return cut(archive.read_archives(archives_from_documents(v.table("documents"))))


def of_normalized(rows, found):
    """What was found in archives that report no failure."""
    return found.join(archive.part(rows, "failure").select("book_id"), "book_id", "left_anti")


@query(
    "src_6_archive_scan",
    f"""SELECT book_id, doc_id, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS code_points FROM archive_block
       WHERE {GOOD} GROUP BY 1, 2""",
    archive_line=ARCHIVE_LINE,
    archive_block=ARCHIVE_BLOCK,
)
def _(v: Views):
    blocks = archive.part(archive.read_archives(archives_from_documents(v.table("documents"))), "block")
    return blocks.groupBy("book_id", F.regexp_extract("doc_href", r"d(\d+)", 1).cast("bigint").alias("doc_id")).agg(
        F.count("*").alias("blocks"), F.sum(F.length("text")).alias("code_points")
    )


@query(
    "nm_3_anchor_attachment",
    f"""SELECT book_id, doc_id, n AS line, CAST(n + n // 4 - (SELECT count(*) FROM archive_line b WHERE b.doc_id = a.doc_id AND b.n < a.n AND b.text = '') AS INT) AS at
       FROM archive_line a WHERE n % 4 = 0 AND {GOOD}""",
    archive_line=ARCHIVE_LINE,
)
def _(v: Views):
    blocks = archive.part(archive_rows(v), "block")
    return corpus.anchor_index(blocks, ["book_id", "doc_href"]).select(
        "book_id",
        F.regexp_extract("doc_href", r"d(\d+)", 1).cast("bigint").alias("doc_id"),
        F.substring("fragment", 2, 9).cast("bigint").alias("line"),
        "at",
    )


@query(
    "nm_4_toc_leaves",
    f"""SELECT book_id, count(*) AS leaves FROM (
         SELECT DISTINCT book_id, doc_id, CASE WHEN book_id % 4 = 1 THEN 0 ELSE n // 4 END AS section
         FROM archive_line WHERE {GOOD} AND book_id % 4 <> 0) GROUP BY 1""",
    archive_line=ARCHIVE_LINE,
)
def _(v: Views):
    rows = archive.read_archives(archives_from_documents(v.table("documents")))
    failed = archive.part(rows, "failure").select("book_id")
    leaves = archive.part(rows, "leaf").join(failed, "book_id", "left_anti")
    return leaves.groupBy("book_id").agg(F.count("*").alias("leaves"))


@query(
    "nm_5_units_from_toc",
    f"""SELECT book_id, count(*) AS units FROM (
         SELECT DISTINCT book_id, doc_id, CASE WHEN book_id % 4 = 1 THEN 0 ELSE n // 4 END AS section
         FROM archive_line WHERE {GOOD}) GROUP BY 1""",
    archive_line=ARCHIVE_LINE,
)
def _(v: Views):
    rows = archive_rows(v)
    found = corpus.split_units(archive.part(rows, "doc"), archive.part(rows, "block"), archive.part(rows, "leaf"))
    return found.groupBy("book_id").agg(F.count("*").alias("units"))


@query(
    "wn_9_leaf_spans",
    f"""SELECT book_id, doc_id, count(*) AS blocks FROM archive_block WHERE {GOOD} AND book_id % 4 <> 0 GROUP BY 1, 2""",
    archive_line=ARCHIVE_LINE,
    archive_block=ARCHIVE_BLOCK,
)
def _(v: Views):
    rows = archive_rows(v)
    spans = corpus.toc_spans(archive.part(rows, "leaf"), archive.part(rows, "block"))
    return spans.groupBy("book_id", F.regexp_extract("doc_href", r"d(\d+)", 1).cast("bigint").alias("doc_id")).agg(
        F.sum(F.col("end") - F.col("start")).alias("blocks")
    )


@query(
    "jn_20_leaf_anchor_block",
    f"""SELECT count(*) AS leaves, count(*) AS resolved FROM (
         SELECT DISTINCT doc_id, n // 4 FROM archive_line WHERE {GOOD} AND book_id % 4 IN (2, 3))""",
    archive_line=ARCHIVE_LINE,
)
def _(v: Views):
    rows = archive_rows(v)
    doc = ["book_id", "doc_href"]
    failed = archive.part(rows, "failure").select("book_id")
    leaves = archive.part(rows, "leaf").join(failed, "book_id", "left_anti").filter("fragment IS NOT NULL")
    found = leaves.join(corpus.anchor_index(archive.part(rows, "block"), doc), [*doc, "fragment"], "left")
    return found.agg(F.count("*").alias("leaves"), F.count("at").alias("resolved"))


@query(
    "jn_22_spine_manifest",
    f"SELECT DISTINCT doc_id // 5 AS book_id, doc_id FROM documents WHERE {GOOD.replace('book_id', '(doc_id // 5)')}",
)
def _(v: Views):
    rows = archive_rows(v)
    docs = of_normalized(rows, archive.part(rows, "doc").filter("in_spine"))
    return docs.select("book_id", F.regexp_extract("doc_href", r"d(\d+)", 1).cast("bigint").alias("doc_id"))


@query(
    "se_2_document_set",
    f"SELECT doc_id // 5 AS book_id, count(*) AS documents FROM documents WHERE {GOOD.replace('book_id', '(doc_id // 5)')} GROUP BY 1",
)
def _(v: Views):
    rows = archive_rows(v)
    ordered = corpus.document_order(archive.part(rows, "doc"), archive.part(rows, "leaf"))
    failed = archive.part(rows, "failure").select("book_id")
    return ordered.join(failed, "book_id", "left_anti").groupBy("book_id").agg(F.count("*").alias("documents"))


@query(
    "se_5_toc_source_priority",
    f"""SELECT doc_id // 5 AS book_id, (['HEADING', 'TOC', 'TOC', 'TOC'])[(doc_id // 5) % 4 + 1] AS origin FROM documents
        WHERE {GOOD.replace('book_id', '(doc_id // 5)')} GROUP BY 1, 2""",
)
def _(v: Views):
    rows = archive_rows(v)
    found = corpus.split_units(archive.part(rows, "doc"), archive.part(rows, "block"), archive.part(rows, "leaf"))
    return found.groupBy("book_id").agg(F.max("origin").alias("origin"))


@query(
    "nm_16_failure_capture",
    """SELECT book_id, CASE book_id % 13 WHEN 7 THEN 'INVALID_EPUB_ARCHIVE' WHEN 9 THEN 'CONTAINER_NOT_FOUND'
         WHEN 10 THEN 'PACKAGE_NOT_FOUND' WHEN 11 THEN 'SPINE_ENTRY_NOT_FOUND' ELSE 'SPINE_RESOLVE_FAILED' END AS code
       FROM (SELECT DISTINCT doc_id // 5 AS book_id FROM documents) WHERE book_id % 13 IN (7, 9, 10, 11, 12)""",
)
def _(v: Views):
    rows = archive.read_archives(archives_from_documents(v.table("documents")))
    return archive.part(rows, "failure").select("book_id", "code")


@query(
    "nm_17_book_metadata",
    f"""SELECT book_id, 'Archive ' || book_id AS title, CASE WHEN book_id % 17 = 4 THEN NULL ELSE 'Author ' || (book_id % 7) END AS author,
         'und' AS language, 'OPS/cover.png' AS cover_href, CASE WHEN book_id % 17 = 4 THEN 'author' END AS missing
       FROM (SELECT DISTINCT doc_id // 5 AS book_id FROM documents) WHERE {GOOD}""",
)
def _(v: Views):
    rows = archive_rows(v)
    return corpus.book_metadata(of_normalized(rows, archive.part(rows, "meta")))


@query(
    "nm_7_unit_sizes",
    f"""SELECT book_id, CAST(sum(length(text)) AS BIGINT) AS size, count(*) AS blocks FROM archive_block WHERE {GOOD} GROUP BY 1""",
    archive_line=ARCHIVE_LINE,
    archive_block=ARCHIVE_BLOCK,
)
def _(v: Views):
    rows = archive_rows(v)
    found = corpus.split_units(archive.part(rows, "doc"), archive.part(rows, "block"), archive.part(rows, "leaf"))
    pieces = corpus.unit_blocks(found, archive.part(rows, "block"))
    sized = corpus.size_and_classify(found, pieces)
    return sized.groupBy("book_id").agg(F.sum("size").alias("size"), F.sum("blocks").alias("blocks"))


BOOK_TEXT_SQL = f"""SELECT book_id, CAST(sum(length(text)) AS BIGINT) AS code_points, md5(string_agg(text, '' ORDER BY doc_id, k)) AS digest
    FROM archive_block WHERE {GOOD} GROUP BY 1"""


@query("nm_14_render_chapters", BOOK_TEXT_SQL, archive_line=ARCHIVE_LINE, archive_block=ARCHIVE_BLOCK)
def book_text(v: Views):
    """At most 20 chapters per book and one archive each, so the book text is one bounded value."""
    chapters = normalized(v)["chapters"]
    texts = F.array_sort(F.collect_list(F.struct("chapter_idx", "text")))
    return chapters.groupBy("book_id").agg(
        F.sum("total_code_points").alias("code_points"),
        F.md5(F.array_join(F.transform(texts, lambda x: x["text"]), "")).alias("digest"),
    )


@query(
    "nm_15_metadata_and_validation",
    f"""SELECT book_id, CAST(sum(length(text)) AS INT) AS total_code_points, 'PASS' AS status, 0 AS failures FROM archive_block
       WHERE {GOOD} GROUP BY 1""",
    archive_line=ARCHIVE_LINE,
    archive_block=ARCHIVE_BLOCK,
)
def _(v: Views):
    done = normalized(v)
    return done["metadata"].join(done["reports"].select("book_id", "status", "round_trip_failures"), "book_id", "inner").select(
        "book_id", "total_code_points", "status", F.col("round_trip_failures").alias("failures")
    )


@query(
    "ag_25_regression_summary",
    f"""SELECT count(*) AS total, count(*) FILTER ({GOOD}) AS success, count(*) FILTER (NOT ({GOOD})) AS failure, 0 AS over_limit,
         0 AS section_mismatch, 0 AS invalid_titles, 0 AS structure, 0 AS round_trip
       FROM (SELECT DISTINCT doc_id // 5 AS book_id FROM documents)""",
)
def _(v: Views):
    done = normalized(v)
    audit = corpus.structural_audit(done["chapters"])
    return corpus.regression_summary(done["reports"], audit, done["failures"])


# ------------------------------------------------- chapters straight from documents

DOC_CHAPTER = """SELECT doc_id // 8 AS book_id, CAST(doc_id % 8 + 1 AS INT) AS chapter_idx, text, lang, source, doc_id FROM documents"""


def doc_chapters(v: Views):
    """One document is one chapter, eight of them a book; lines are paragraphs."""
    lines = F.split("text", "\n")
    lengths = F.transform(lines, lambda x: F.length(x))
    starts = F.transform(lengths, lambda n, i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda a, b: a + b))
    rows = v.table("documents").select(
        F.expr("doc_id div 8").alias("book_id"),
        F.expr("int(doc_id % 8 + 1)").alias("chapter_idx"),
        F.when(F.col("doc_id") % 9 == 0, "Index of " + "things").otherwise(F.concat(F.lit("Chapter "), "doc_id")).alias("title"),
        F.col("source").alias("spine_href"),
        starts.alias("starts"),
        lengths.alias("lengths"),
        F.array_join(lines, "").alias("text"),
        F.lit('<section data-chapter-index="0">').alias("markup"),
    )
    return corpus.book_positions(
        rows.withColumn("paragraph_count", F.size("starts")).withColumn("total_code_points", F.length("text"))
    )


@query(
    "ag_20_chapter_text",
    """SELECT chapter_id, md5(string_agg(text, '' ORDER BY block_idx)) AS digest, CAST(sum(length(text)) AS BIGINT) AS code_points
       FROM line GROUP BY 1""",
)
def _(v: Views):
    """Lines of one document, which was one value to begin with."""
    ordered = F.array_sort(F.collect_list(F.struct("block_idx", "text")))
    text = F.array_join(F.transform(ordered, lambda x: x["text"]), "")
    rows = v.line.groupBy("chapter_id").agg(text.alias("text"))
    return rows.select("chapter_id", F.md5("text").alias("digest"), F.length("text").cast("bigint").alias("code_points"))


@query(
    "wn_8_chapter_positions",
    """SELECT book_id, chapter_idx, CAST(start_pos AS INT) AS start_pos,
         CAST(CASE WHEN n = 0 THEN start_pos ELSE start_pos + n - 1 END AS INT) AS end_pos
       FROM (SELECT book_id, chapter_idx, n, coalesce(sum(n) OVER (PARTITION BY book_id ORDER BY chapter_idx
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_pos
             FROM (SELECT *, length(replace(text, chr(10), '')) AS n FROM doc_chapter))""",
    doc_chapter=DOC_CHAPTER,
)
def _(v: Views):
    return doc_chapters(v).select("book_id", "chapter_idx", "start_pos", "end_pos")


@query(
    "ag_18_validation_report",
    """SELECT book_id, CAST(count(*) AS INT) AS chapter_count, true AS within_limit, true AS sections_match,
         array_to_string(list(chapter_idx ORDER BY chapter_idx) FILTER (doc_id % 9 = 0), ',') AS invalid_titles,
         CAST(count(*) FILTER (doc_id % 9 = 0) AS INT) AS invalid_title_count, 0 AS round_trip_failures, 'PASS' AS status
       FROM doc_chapter GROUP BY 1""",
    doc_chapter=DOC_CHAPTER,
)
def _(v: Views):
    report = corpus.validation_report(doc_chapters(v))
    listed = F.col("invalid_title_chapters")
    return report.select(
        "book_id", "chapter_count", "within_limit", "sections_match",
        F.when(F.size(listed) > 0, F.array_join(listed.cast("array<string>"), ",")).alias("invalid_titles"),
        "invalid_title_count", "round_trip_failures", "status",
    )


@query(
    "ag_19_metadata_roll_up",
    """SELECT book_id, CAST(sum(length(replace(text, chr(10), ''))) AS INT) AS total_code_points,
         string_agg(CAST(len(string_split(text, chr(10))) AS VARCHAR), ',' ORDER BY chapter_idx) AS paragraph_counts
       FROM doc_chapter GROUP BY 1""",
    doc_chapter=DOC_CHAPTER,
)
def _(v: Views):
    counts = F.transform("chapters", lambda c: c["paragraph_count"].cast("string"))
    return corpus.metadata(doc_chapters(v)).select(
        "book_id", "total_code_points", F.array_join(counts, ",").alias("paragraph_counts")
    )


@query(
    "ag_23_structural_audit",
    """SELECT book_id, chapter_idx, CASE WHEN length(replace(text, chr(10), '')) > 0 THEN '' ELSE 'empty|end position' END AS issues
       FROM doc_chapter""",
    doc_chapter=DOC_CHAPTER,
)
def _(v: Views):
    return corpus.structural_audit(doc_chapters(v)).withColumn("issues", F.array_join("issues", "|"))


@query(
    "dq_19_paragraph_arrays",
    """SELECT chapter_id, starts IS NOT NULL AS usable, CASE WHEN starts IS NOT NULL THEN
           CAST(400 > total AS INT) + CAST(800 > total AS INT) + CAST(1200 > total AS INT) + CAST(1700 > total AS INT) END AS out_of_bounds
       FROM (SELECT *, coalesce(total_code_points, 300 + chapter_id * 13 % 1600) AS total FROM story_chapter)""",
)
def _(v: Views):
    shape = v.chapter
    # Chapters without a total are given ones that cut off up to all four paragraphs.
    total = F.coalesce("total_code_points", F.expr("int(300 + chapter_id * 13 % 1600)"))
    usable = F.coalesce((F.size("starts") > 0) & (F.size("starts") == F.size("lengths")), F.lit(False))
    bad = corpus.out_of_bounds(F.col("starts"), F.col("lengths"), total)
    return shape.select("chapter_id", usable.alias("usable"), F.when(F.col("starts").isNotNull(), bad).alias("out_of_bounds"))


@query(
    "sc_24_chapter_markup",
    """SELECT doc_id, md5('<section data-chapter-index="' || (doc_id % 8 + 1) || '" data-representative-spine-href="' || source || '"><h2>' || lang || '</h2>'
         || string_agg('<p data-block-index="' || n || '" data-spine-href="' || source || '" data-source-unit-id="unit-1">' || e || '</p>', '' ORDER BY n)
         || '</section>') AS digest
       FROM (SELECT d.doc_id, d.source, d.lang, l.block_idx AS n, replace(replace(replace(replace(replace(l.text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
               '"', '&quot;'), '''', '&apos;') AS e FROM documents d JOIN line l ON l.chapter_id = d.doc_id)
       GROUP BY doc_id, source, lang""",
)
def _(v: Views):
    docs = v.table("documents")
    place = [F.col("doc_id").alias("book_id"), F.expr("int(doc_id % 8 + 1)").alias("chapter_idx")]
    plans = docs.select(
        *place, F.col("lang").alias("title"), F.lit("UNKNOWN").alias("role"), F.lit("KEEP_AS_IS").alias("reason"),
        F.array("source").alias("source_docs"),
    )
    pieces = docs.select(
        *place, F.lit(1).alias("unit_no"), F.col("source").alias("doc_href"), F.posexplode(F.split("text", "\n")).alias("block_idx", "text")
    ).drop("chapter_idx")
    blocks = corpus.chapter_blocks(docs.select(*place, F.lit(1).alias("unit_no")), pieces)
    return corpus.render_chapters(plans, blocks).select(F.col("book_id").alias("doc_id"), F.md5("markup").alias("digest"))
