"""Column functions, each over a whole table."""

from pyspark.sql import functions as F

from plotweave.functions import coords, ids, prompts, status, text
from plotweave.registry.base import query
from plotweave.views import CURRENT_LOCATOR, CURRENT_RULE, Views

C = F.col
WS = "[ \\t\\n\\x0b\\f\\r]+"
EDGE = "^[\\x00-\\x20]+|[\\x00-\\x20]+$"


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '{EDGE}', '', 'g')"


def sql_collapse(x: str) -> str:
    return sql_trim(f"regexp_replace({x}, '{WS}', ' ', 'g')")


@query("sc_1_collapse_whitespace", f"SELECT doc_id, md5({sql_collapse('text')}) AS digest FROM documents")
def _(v: Views):
    return v.table("documents").select("doc_id", F.md5(text.collapse(C("text"))).alias("digest"))


@query(
    "sc_2_truncate",
    f"""SELECT doc_id, CASE WHEN text = '' THEN NULL WHEN length(t) <= 200 THEN t ELSE substring(t, 1, 197) || '...' END AS short
       FROM (SELECT doc_id, text, {sql_collapse('text')} AS t FROM documents)""",
)
def _(v: Views):
    return v.table("documents").select("doc_id", text.truncated(C("text"), 200).alias("short"))


@query("sc_3_names_list", "SELECT id, array_to_string(name_list, '|') AS names FROM story_character")
def _(v: Views):
    return v.character.select("id", F.array_join(text.split_names(C("names"), C("name")), "|").alias("names"))


@query(
    "sc_4_join_names",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment || CASE WHEN c_custkey % 3 = 1 THEN '' ELSE ',' || c_name END END AS names
       FROM customer""",
)
def _(v: Views):
    names = F.expr(
        """CASE c_custkey % 3 WHEN 0 THEN array('  ', null) WHEN 1 THEN array(c_mktsegment, concat(' ', c_mktsegment, '\\t'))
           ELSE array(c_mktsegment, c_name, null, c_mktsegment) END"""
    )
    return v.table("customer").select("c_custkey", text.join_names(names, C("c_name")).alias("names"))


RAW_ID = """CASE c_custkey % 7 WHEN 0 THEN '0012' WHEN 1 THEN 'c007' WHEN 2 THEN concat('C', c_custkey) WHEN 3 THEN 'x9'
    WHEN 4 THEN ' ' WHEN 5 THEN concat(' c0', c_custkey, ' ') ELSE 'c00' END"""


@query(
    "sc_5_character_id",
    """SELECT c_custkey, CAST(CASE c_custkey % 7 WHEN 0 THEN 12 WHEN 1 THEN 7 WHEN 2 THEN c_custkey WHEN 5 THEN c_custkey WHEN 6 THEN 0 END AS BIGINT) AS character_id
       FROM customer""",
)
def _(v: Views):
    return v.table("customer").select("c_custkey", ids.character_id(F.expr(RAW_ID)).alias("character_id"))


RAW_EVENT = """CASE id % 5 WHEN 0 THEN event_id WHEN 1 THEN concat('', idx) WHEN 2 THEN 'ch99-e1' WHEN 3 THEN 'chx-e1'
    ELSE concat(' ', event_id, ' ') END"""


@query(
    "sc_6_event_index",
    "SELECT id, CASE WHEN id % 5 IN (0, 1, 4) THEN idx END AS event_idx FROM story_event",
)
def _(v: Views):
    return v.event.select("id", ids.event_idx(F.expr(RAW_EVENT), C("chapter_idx")).alias("event_idx"))


@query(
    "sc_7_normalized_event_id",
    """SELECT id, CASE id % 5 WHEN 2 THEN 'ch99-e1' WHEN 3 THEN 'chx-e1' ELSE event_id END AS event_id,
         CASE id % 5 WHEN 1 THEN NULL WHEN 2 THEN 'ch99-e1' WHEN 3 THEN NULL ELSE event_id END AS strict_id FROM story_event""",
)
def _(v: Views):
    raw = F.expr(RAW_EVENT)
    return v.event.select(
        "id", ids.normalized_event_id(raw, C("chapter_idx"), C("idx")).alias("event_id"), ids.strict_event_id(raw).alias("strict_id")
    )


@query(
    "sc_8_newlines",
    """WITH n AS (
         SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) || chr(13) ELSE replace(text, chr(10), chr(13)) END
           || chr(10) || chr(10) AS t FROM documents
       ) SELECT doc_id, md5(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest FROM n""",
)
def _(v: Views):
    docs = v.table("documents")
    mixed = F.concat(F.replace(C("text"), F.lit("\n"), F.lit("\r\n")), F.lit("\r"), F.lit("\n\n"))
    lone = F.concat(F.replace(C("text"), F.lit("\n"), F.lit("\r")), F.lit("\n\n"))
    return docs.select("doc_id", F.md5(text.newlines(F.when(C("doc_id") % 2 == 0, mixed).otherwise(lone))).alias("digest"))


@query(
    "sc_9_code_point_range",
    "SELECT doc_id, CAST(length(text) AS INT) AS code_points, substring(text, CAST(doc_id % 50 + 1 AS INT), 100) AS part FROM documents",
)
def _(v: Views):
    start = (C("doc_id") % 50).cast("int")
    return v.table("documents").select(
        "doc_id", text.code_points(C("text")).alias("code_points"), text.text_range(C("text"), start, start + 100).alias("part")
    )


@query("sc_10_preview", "SELECT doc_id, md5(nullif(substring(text, 1, 2000), '')) AS digest FROM documents")
def _(v: Views):
    return v.table("documents").select("doc_id", F.md5(text.preview(C("text"))).alias("digest"))


@query(
    "sc_11_optional_text",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS clean FROM customer""",
)
def _(v: Views):
    raw = F.expr("if(c_custkey % 3 = 0, ' \\n\\t ', concat('\\t ', c_name, ' \\n'))")
    return v.table("customer").select("c_custkey", text.optional_text(raw).alias("clean"))


@query("sc_12_tag_list", "SELECT id, array_to_string(labels, '|') AS tags FROM story_edge")
def _(v: Views):
    return v.edge.select("id", F.array_join(coords.tags(C("relation_tags")), "|").alias("tags"))


@query(
    "sc_13_locator_json",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN NULL
         ELSE chapter_idx || ':' || block_idx || ':' || "offset" END AS locator, event_id % 4 = 1 AS malformed,
         '{"chapterIndex":' || chapter_idx || ',"blockIndex":' || block_idx || ',"offset":' || "offset" || '}' AS written
       FROM progress""",
)
def _(v: Views):
    written = coords.write_locator(C("chapter_idx"), C("block_idx"), C("offset"))
    stored = F.when(C("event_id") % 4 == 0, F.lit(" ")).when(C("event_id") % 4 == 1, F.lit("oops")).otherwise(written)
    read = coords.read_locator(stored)
    shown = F.concat_ws(":", read["chapterIndex"], read["blockIndex"], read["offset"])
    return v.progress.select(
        "event_id", F.when(shown != "", shown).alias("locator"), coords.malformed_locator(stored).alias("malformed"), written.alias("written")
    )


@query(
    "sc_17_version_status",
    """SELECT book_id, CASE WHEN normalization_status <> 'READY' THEN 'NOT_READY'
         WHEN rule_version = 'rule-2' AND locator_version = 'loc-2' THEN 'CURRENT' ELSE 'OUTDATED' END AS version_status FROM book""",
)
def _(v: Views):
    state = status.version_status(
        C("normalization_status"), C("rule_version"), C("locator_version"), CURRENT_RULE, CURRENT_LOCATOR
    )
    return v.book.select("book_id", state.alias("version_status"))


@query(
    "sc_23_xml_escape",
    """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) AS digest
       FROM pages""",
)
def _(v: Views):
    return v.table("pages").select("page_id", F.md5(text.xml_escaped(C("html"))).alias("digest"))


@query(
    "sc_25_path_helpers",
    """SELECT page_id, CASE WHEN instr(url, '#') > 0 THEN substring(url, instr(url, '#') + 1) END AS fragment,
         CASE WHEN instr(url, '#') > 0 THEN substring(url, 1, instr(url, '#') - 1) ELSE url END AS plain,
         regexp_replace(url, '/[^/]*$', '') AS folder, 'chapter_' || CASE WHEN page_id < 1000 THEN lpad(CAST(page_id AS VARCHAR), 3, '0') ELSE CAST(page_id AS VARCHAR) END AS file FROM pages""",
)
def _(v: Views):
    url = C("url")
    return v.table("pages").select(
        "page_id",
        text.fragment_of(url).alias("fragment"),
        text.without_fragment(url).alias("plain"),
        text.parent_folder(url).alias("folder"),
        text.chapter_file(C("page_id")).alias("file"),
    )


@query(
    "sc_26_remote_reference",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE true END AS remote FROM pages""",
)
def _(v: Views):
    link = F.expr(
        "CASE page_id % 4 WHEN 0 THEN upper(url) WHEN 1 THEN regexp_replace(url, '^https?:', '') WHEN 2 THEN concat('a/', url) ELSE 'DATA:x' END"
    )
    return v.table("pages").select("page_id", text.is_remote(link).alias("remote"))


@query(
    "sc_27_portrait_prompt",
    """SELECT id, 'S, ' || CASE WHEN profile_text IS NULL THEN 'single centered chest-up bust portrait of ' || name
         ELSE lower(name) || ', calm' END AS prompt FROM story_character""",
)
def _(v: Views):
    whole = prompts.portrait_prompt(F.lit("crowd behind; A Diptych"), C("profile_text"), C("name"), F.lit(" S\n"))
    fixed = F.replace(F.replace(whole, F.lit(prompts.PROFILE_FORMAT + ", "), F.lit("")), F.lit(", " + prompts.NEGATIVE_LAYOUT), F.lit(""))
    return v.character.select("id", fixed.alias("prompt"))


@query("sc_28_prompt_hash", "SELECT id, sha256(trim(profile_text)) AS hash FROM story_character")
def _(v: Views):
    return v.character.select("id", prompts.prompt_hash(C("profile_text")).alias("hash"))


@query(
    "sc_29_file_variant",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'EPUB3_IMAGES' WHEN 1 THEN 'EPUB2_IMAGES' ELSE 'EPUB_DEFAULT' END AS variant,
         p_name AS title FROM part""",
)
def _(v: Views):
    name = F.expr("concat(p_name, element_at(array('-images-3.epub', '-images.epub', '.epub'), int(p_partkey % 3) + 1))")
    return v.table("part").select("p_partkey", text.file_variant(name).alias("variant"), text.file_title(name).alias("title"))


@query(
    "sc_30_description_choice",
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment END AS description FROM customer""",
)
def _(v: Views):
    by_language = F.expr("if(c_custkey % 3 = 0, map('ko', concat(' ', c_name), 'en', 'x'), map('ko', ' ', 'en', 'x'))")
    plain = F.expr("if(c_custkey % 3 = 1, c_mktsegment, '')")
    return v.table("customer").select("c_custkey", text.description(by_language, plain).alias("description"))


@query(
    "sc_31_scope_and_policy",
    """SELECT event_id, CASE k % 4 WHEN 0 THEN 'MAIN_ONLY' WHEN 1 THEN 'ALL' WHEN 2 THEN NULL ELSE 'MAIN_ONLY' END AS scope,
         CASE k % 3 WHEN 0 THEN 'MANUAL' WHEN 1 THEN 'AUTO_AFTER_QA' END AS policy FROM activity""",
)
def _(v: Views):
    scope = F.expr("element_at(array(null, ' ALL ', 'all', ' '), k % 4 + 1)")
    policy = F.expr("element_at(array('', 'AUTO_AFTER_QA', 'NOW'), k % 3 + 1)")
    return v.activity.select("event_id", status.fanout_scope(scope).alias("scope"), status.publish_policy(policy).alias("policy"))


@query(
    "sc_32_public_url",
    "SELECT book_id, 'https://cdn.example/pub/' || artifact_path || '/combined.xhtml' AS url FROM book",
)
def _(v: Views):
    from plotweave.sources.artifacts import combined_document_url

    return combined_document_url(v.book, "https://cdn.example/", "pub")


@query(
    "sc_33_image_check",
    """SELECT id, CASE WHEN url IS NULL OR trim(url) = '' THEN 'EMPTY_IMAGE_URL' END AS failure,
         CASE WHEN url IS NULL OR trim(url) = '' THEN '{"passed":false,"reason":"EMPTY_IMAGE_URL"}'
              ELSE '{"passed":true,"mode":"BASIC_URL_CHECK","role":"' || role || '"}' END AS result FROM asset""",
)
def _(v: Views):
    return v.asset.select("id", status.qa_failure(C("url")).alias("failure"), status.qa_result(C("url"), C("role")).alias("result"))
