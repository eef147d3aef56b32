"""Story-shaped views over the given tables, in Spark and in SQL.

Every column is arithmetic over one row or one aggregate, and the number of books
grows with the data: a book is 128 consecutive orders, a chapter 16 of them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CURRENT_RULE = "rule-2"
CURRENT_LOCATOR = "loc-2"


class Views:
    """The given tables of one folder and the story views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def by_event(self, lines: DataFrame) -> DataFrame:
        """Lines hardly shrink when they are grouped: they move once, to where their event's place comes."""
        return lines.repartition("event_id")

    @cached_property
    def event(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey AS id",
            "o_orderkey div 128 AS book_id",
            "o_orderkey div 16 AS chapter_id",
            "int((o_orderkey div 16) % 8 + 1) AS chapter_idx",
            "int(o_orderkey % 16 + 1) AS idx",
            "concat('ch', (o_orderkey div 16) % 8 + 1, '-e', o_orderkey % 16 + 1) AS event_id",
            "int(o_orderkey % 16 * 100) AS start_txt",
            "int(o_orderkey % 16 * 100 + 90 + if(o_orderkey % 5 = 0, 150, 0)) AS end_txt",
            "if(o_orderkey % 13 = 0, null, int(o_orderkey % 16 div 4)) AS start_block",
            "int(o_orderkey % 16 % 4 * 100) AS start_offset",
            "int(o_orderkey % 16 div 4) AS end_block",
            "if(o_orderkey % 17 = 0, null, int(o_orderkey % 16 % 4 * 100 + 90)) AS end_offset",
            "concat(' ', o_orderpriority, '\\t\\n ', repeat(concat(o_orderstatus, '  scene '), int(o_orderkey % 60))) AS raw_text",
        )

    @cached_property
    def chapter(self) -> DataFrame:
        return (
            self.table("orders")
            .select(F.expr("o_orderkey div 16").alias("chapter_id"))
            .distinct()
            .selectExpr(
                "chapter_id",
                "chapter_id div 8 AS book_id",
                "int(chapter_id % 8 + 1) AS idx",
                "concat('Chapter ', chapter_id % 8 + 1) AS title",
                "if(chapter_id % 11 = 0, null, array(0, 400, 800, 1200)) AS starts",
                "if(chapter_id % 11 = 0, null, array(400, 400, 400, 500)) AS lengths",
                "if(chapter_id % 7 = 0, null, 1700) AS total_code_points",
                "chapter_id % 5 <> 4 AS summarized",
            )
        )

    @cached_property
    def edge(self) -> DataFrame:
        return (
            self.table("lineitem")
            .selectExpr(
                "l_orderkey AS event_id",
                "l_suppkey % 25 + 1 AS from_id",
                "l_partkey % 25 + 1 AS to_id",
                "l_quantity",
                "l_discount",
                "l_returnflag",
                "l_linestatus",
                "l_linenumber",
            )
            .filter("from_id <> to_id")
            .transform(self.by_event)
            .groupBy("event_id", "from_id", "to_id")
            .agg(
                F.sum("l_quantity").cast("int").alias("quantity"),
                F.round(F.lit(100) * F.max("l_discount")).cast("int").alias("discount"),
                F.min("l_returnflag").alias("flag"),
                F.min("l_linestatus").alias("status"),
                F.min("l_linenumber").alias("line"),
            )
            .selectExpr(
                "event_id * 1000 + from_id * 30 + to_id AS id",
                "event_id",
                "event_id div 128 AS book_id",
                "from_id",
                "to_id",
                "event_id div 128 * 100 + from_id AS from_char_id",
                "event_id div 128 * 100 + to_id AS to_char_id",
                "if(line = 4, null, concat('r', line)) AS explanation",
                """CASE WHEN event_id % 19 = 0 THEN 'oops' WHEN event_id % 23 = 0 THEN null
                        WHEN event_id % 29 = 0 THEN '  '
                        ELSE concat('["', flag, '","', status, '"]') END AS relation_tags""",
                "if(event_id % 31 = 0, null, quantity) AS interaction_count",
                "if((from_id * 7 + to_id) % 17 = 0, null, float((discount - 5) / 5D)) AS sentiment_score",
            )
        )

    @cached_property
    def stat(self) -> DataFrame:
        return (
            self.table("lineitem")
            .selectExpr("l_orderkey AS event_id", "l_suppkey % 25 + 1 AS character_id", "l_quantity")
            .transform(self.by_event)
            .groupBy("event_id", "character_id")
            .agg(F.sum("l_quantity").alias("quantity"))
            .selectExpr(
                "event_id * 100 + character_id AS id",
                "event_id",
                "event_id div 128 AS book_id",
                "character_id",
                "event_id div 128 * 100 + character_id AS char_id",
                "quantity * 0.25D AS node_weight",
            )
        )

    @cached_property
    def character(self) -> DataFrame:
        nations = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "inner"
        )
        casts = (
            self.table("orders")
            .select(F.expr("o_orderkey div 128").alias("book_id"))
            .distinct()
            .withColumn("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(24))))
        )
        return casts.join(nations, "n_nationkey", "inner").selectExpr(
            "book_id * 100 + n_nationkey + 1 AS id",
            "bigint(n_nationkey + 1) AS character_id",
            "book_id",
            "n_name AS name",
            "if(n_nationkey % 6 = 5, ' , ', concat(n_name, ', , ', r_name)) AS names",
            "n_regionkey = 0 AS is_main",
            "1 AS first_chapter_idx",
            "if(n_nationkey % 9 = 8, null, repeat(concat(r_name, ' \\n ', n_name, '; '), n_nationkey)) AS personality_text",
            "if(n_nationkey % 4 = 3, null, concat(lower(n_name), ', Two  People; calm')) AS profile_text",
            """CASE WHEN (n_nationkey + book_id) % 5 = 0 THEN null WHEN (n_nationkey + book_id) % 5 = 1 THEN ' '
                    ELSE concat('img/', book_id, '/', n_nationkey, '.png') END AS profile_image""",
            "if((n_nationkey + book_id) % 3 = 0, 'COMPLETED', 'PENDING') AS image_status",
        )

    @cached_property
    def book(self) -> DataFrame:
        return self.table("part").selectExpr(
            "p_partkey AS book_id",
            "p_name AS title",
            "p_brand AS author",
            "p_type AS language",
            "p_size % 2 = 0 AS is_default",
            "p_partkey % 3 <> 2 AS summary",
            "element_at(array('READY','READY','READY','FAILED','PROCESSING'), p_size % 5 + 1) AS normalization_status",
            "element_at(array('READY','READY','NONE','REJECTED'), int(p_partkey % 4) + 1) AS analysis_status",
            "element_at(array('rule-1','rule-2',null), int(p_partkey % 3) + 1) AS rule_version",
            "element_at(array('loc-2','loc-2','loc-1',null), int(p_size % 4) + 1) AS locator_version",
            "if(p_partkey % 6 = 0, null, concat('run-', p_partkey)) AS run_id",
            """CASE WHEN p_partkey % 6 = 0 THEN null WHEN p_partkey % 10 = 1 THEN ' '
                    ELSE concat('books/', p_partkey, '/normalizations/run-', p_partkey) END AS artifact_path""",
            "p_partkey % 97 AS uploaded_by",
            "bigint(round(p_retailprice * 10)) AS updated_at",
        )

    @cached_property
    def summary(self) -> DataFrame:
        """Point-of-view summaries: one per customer, spread over chapters."""
        return self.table("customer").selectExpr(
            "c_custkey AS id",
            "c_custkey * 7 div 80 AS book_id",
            "c_custkey * 7 div 80 * 8 + c_custkey % 5 AS chapter_id",
            "c_custkey * 7 div 80 * 100 + c_nationkey + 1 AS char_id",
            "concat(c_mktsegment, ' view of ', c_name) AS summary_text",
        )

    @cached_property
    def position(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id AS position_id",
            "event_id div 85 AS book_id",
            "int(get_json_object(props, '$.k')) % 9 + 1 AS chapter_idx",
            "int(event_id * 37 % 1720) AS at",
        )

    @cached_property
    def block(self) -> DataFrame:
        """Turns as text blocks: one conversation is one chapter."""
        return self.table("conversations").selectExpr(
            "conv_id AS chapter_id", "int(turn) AS block_idx", "text", "length(text) AS length"
        )

    @cached_property
    def line(self) -> DataFrame:
        """Lines of documents: one document is one chapter."""
        return self.table("documents").select(
            F.col("doc_id").alias("chapter_id"),
            F.posexplode(F.split("text", "\n")).alias("block_idx", "text"),
        )

    @cached_property
    def favorite(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
        lines = self.table("lineitem").select(
            F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("book_id")
        )
        return orders.join(lines, "o_orderkey", "inner").select("user_id", "book_id").distinct()

    @cached_property
    def activity(self) -> DataFrame:
        """Events with the numbers the state views are cut from."""
        return self.table("events").selectExpr(
            "event_id", "user_id", "event_type", "int(get_json_object(props, '$.k')) AS k", "unix_micros(timestamp(ts)) AS at"
        )

    @cached_property
    def progress(self) -> DataFrame:
        return self.activity.selectExpr(
            "event_id",
            "user_id",
            "bigint(k % 5) AS book_id",
            "k % 8 + 1 AS chapter_idx",
            "int(event_id % 5) AS block_idx",
            "int(event_id % 520) AS offset",
            "at",
        )

    @cached_property
    def bookmark(self) -> DataFrame:
        return self.activity.selectExpr(
            "event_id AS id",
            "user_id",
            "bigint(k % 5) AS book_id",
            "k * 10 AS start_txt",
            "if(event_type = 'error', null, int(k * 10 + event_id % 50 + 1)) AS end_txt",
            "if(event_type = 'view', null, '#A1B2C3') AS color",
            "if(event_type = 'click', null, concat('memo ', event_id)) AS memo",
            "at AS created_at",
        )

    @cached_property
    def job(self) -> DataFrame:
        return self.activity.selectExpr(
            "event_id AS id",
            "user_id AS book_id",
            """CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'READY'
                    WHEN 'click' THEN 'PROCESSING' ELSE 'QUEUED' END AS status""",
            "if(event_id % 10 = 9, 'AI_ANALYSIS', 'NORMALIZATION') AS pipeline_type",
            "at AS created_at",
        )

    @cached_property
    def job_log(self) -> DataFrame:
        return self.activity.selectExpr(
            "event_id AS id",
            "event_id div 7 AS job_id",
            "if(event_type = 'error', 'ERROR', 'INFO') AS level",
            "event_type AS step",
            "k",
            "at AS created_at",
        )

    @cached_property
    def asset(self) -> DataFrame:
        return self.activity.selectExpr(
            "event_id AS id",
            "user_id div 25 AS book_id",
            "user_id div 25 * 100 + user_id % 25 + 1 AS char_id",
            "element_at(array('REFERENCE_SEED','DERIVED_CHARACTER','STANDALONE_TEXT'), k % 3 + 1) AS role",
            """CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'PUBLISHED'
                    WHEN 'click' THEN 'QA_PASSED' WHEN 'view' THEN 'STALE_REFERENCE' ELSE 'QA_PENDING' END AS status""",
            """CASE WHEN event_type = 'error' THEN null WHEN k % 10 = 0 THEN ' '
                    ELSE concat('img/', event_id, '.png') END AS url""",
            "at AS created_at",
        )


# The same views for the SQL side.
SQL_VIEWS = {
    "story_event": """SELECT o_orderkey AS id, o_orderkey // 128 AS book_id, o_orderkey // 16 AS chapter_id,
        CAST((o_orderkey // 16) % 8 + 1 AS INT) AS chapter_idx, CAST(o_orderkey % 16 + 1 AS INT) AS idx,
        'ch' || ((o_orderkey // 16) % 8 + 1) || '-e' || (o_orderkey % 16 + 1) AS event_id,
        CAST(o_orderkey % 16 * 100 AS INT) AS start_txt,
        CAST(o_orderkey % 16 * 100 + 90 + CASE WHEN o_orderkey % 5 = 0 THEN 150 ELSE 0 END AS INT) AS end_txt,
        CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 16 // 4 AS INT) END AS start_block,
        CAST(o_orderkey % 16 % 4 * 100 AS INT) AS start_offset,
        CAST(o_orderkey % 16 // 4 AS INT) AS end_block,
        CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderkey % 16 % 4 * 100 + 90 AS INT) END AS end_offset,
        ' ' || o_orderpriority || chr(9) || chr(10) || ' ' || repeat(o_orderstatus || '  scene ', o_orderkey % 60) AS raw_text
        FROM orders""",
    "story_chapter": """SELECT chapter_id, chapter_id // 8 AS book_id, CAST(chapter_id % 8 + 1 AS INT) AS idx,
        'Chapter ' || (chapter_id % 8 + 1) AS title,
        CASE WHEN chapter_id % 11 = 0 THEN NULL ELSE [0, 400, 800, 1200] END AS starts,
        CASE WHEN chapter_id % 11 = 0 THEN NULL ELSE [400, 400, 400, 500] END AS lengths,
        CASE WHEN chapter_id % 7 = 0 THEN NULL ELSE 1700 END AS total_code_points,
        chapter_id % 5 <> 4 AS summarized
        FROM (SELECT DISTINCT o_orderkey // 16 AS chapter_id FROM orders)""",
    "story_edge": """SELECT event_id * 1000 + from_id * 30 + to_id AS id, event_id, event_id // 128 AS book_id, from_id, to_id,
        event_id // 128 * 100 + from_id AS from_char_id, event_id // 128 * 100 + to_id AS to_char_id,
        CASE WHEN line = 4 THEN NULL ELSE 'r' || line END AS explanation,
        CASE WHEN event_id % 19 = 0 THEN 'oops' WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 29 = 0 THEN '  '
             ELSE '["' || flag || '","' || status || '"]' END AS relation_tags,
        CASE WHEN event_id % 19 = 0 OR event_id % 23 = 0 OR event_id % 29 = 0 THEN [] ELSE [flag, status] END AS labels,
        CASE WHEN event_id % 31 = 0 THEN NULL ELSE quantity END AS interaction_count,
        CASE WHEN (from_id * 7 + to_id) % 17 = 0 THEN NULL ELSE CAST((discount - 5) / 5.0 AS FLOAT) END AS sentiment_score
        FROM (SELECT l_orderkey AS event_id, l_suppkey % 25 + 1 AS from_id, l_partkey % 25 + 1 AS to_id,
            CAST(sum(l_quantity) AS INT) AS quantity, CAST(round(100 * max(l_discount)) AS INT) AS discount,
            min(l_returnflag) AS flag, min(l_linestatus) AS status, min(l_linenumber) AS line
            FROM lineitem WHERE l_suppkey % 25 <> l_partkey % 25 GROUP BY 1, 2, 3)""",
    "story_stat": """SELECT event_id * 100 + character_id AS id, event_id, event_id // 128 AS book_id, character_id,
        event_id // 128 * 100 + character_id AS char_id, quantity * 0.25::DOUBLE AS node_weight
        FROM (SELECT l_orderkey AS event_id, l_suppkey % 25 + 1 AS character_id, sum(l_quantity) AS quantity
            FROM lineitem GROUP BY 1, 2)""",
    "story_character": """SELECT book_id * 100 + n_nationkey + 1 AS id, CAST(n_nationkey + 1 AS BIGINT) AS character_id, book_id,
        n_name AS name, CASE WHEN n_nationkey % 6 = 5 THEN ' , ' ELSE n_name || ', , ' || r_name END AS names,
        CASE WHEN n_nationkey % 6 = 5 THEN [n_name] ELSE [n_name, r_name] END AS name_list,
        n_regionkey = 0 AS is_main, 1 AS first_chapter_idx,
        CASE WHEN n_nationkey % 9 = 8 THEN NULL
             ELSE repeat(r_name || ' ' || chr(10) || ' ' || n_name || '; ', n_nationkey) END AS personality_text,
        CASE WHEN n_nationkey % 4 = 3 THEN NULL ELSE lower(n_name) || ', Two  People; calm' END AS profile_text,
        CASE WHEN (n_nationkey + book_id) % 5 = 0 THEN NULL WHEN (n_nationkey + book_id) % 5 = 1 THEN ' '
             ELSE 'img/' || book_id || '/' || n_nationkey || '.png' END AS profile_image,
        CASE WHEN (n_nationkey + book_id) % 3 = 0 THEN 'COMPLETED' ELSE 'PENDING' END AS image_status
        FROM (SELECT DISTINCT o_orderkey // 128 AS book_id FROM orders), nation JOIN region ON n_regionkey = r_regionkey""",
    "book": """SELECT p_partkey AS book_id, p_name AS title, p_brand AS author, p_type AS language, p_size % 2 = 0 AS is_default,
        p_partkey % 3 <> 2 AS summary,
        (['READY','READY','READY','FAILED','PROCESSING'])[p_size % 5 + 1] AS normalization_status,
        (['READY','READY','NONE','REJECTED'])[p_partkey % 4 + 1] AS analysis_status,
        (['rule-1','rule-2',NULL])[p_partkey % 3 + 1] AS rule_version,
        (['loc-2','loc-2','loc-1',NULL])[p_size % 4 + 1] AS locator_version,
        CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 'run-' || p_partkey END AS run_id,
        CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 10 = 1 THEN ' '
             ELSE 'books/' || p_partkey || '/normalizations/run-' || p_partkey END AS artifact_path,
        p_partkey % 97 AS uploaded_by, CAST(round(p_retailprice * 10) AS BIGINT) AS updated_at FROM part""",
    "story_summary": """SELECT c_custkey AS id, c_custkey * 7 // 80 AS book_id, c_custkey * 7 // 80 * 8 + c_custkey % 5 AS chapter_id,
        c_custkey * 7 // 80 * 100 + c_nationkey + 1 AS char_id, c_mktsegment || ' view of ' || c_name AS summary_text
        FROM customer""",
    "activity": """SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k,
        epoch_us(ts) AS "at" FROM events""",
    "position": """SELECT event_id AS position_id, event_id // 85 AS book_id, k % 9 + 1 AS chapter_idx,
        CAST(event_id * 37 % 1720 AS INT) AS "at" FROM activity""",
    "block": """SELECT conv_id AS chapter_id, CAST(turn AS INT) AS block_idx, text, CAST(length(text) AS INT) AS length
        FROM conversations""",
    "line": """SELECT doc_id AS chapter_id, CAST(i - 1 AS INT) AS block_idx, lines[i] AS text
        FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
            FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))""",
    "favorite": """SELECT DISTINCT o_custkey AS user_id, l_partkey AS book_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "progress": """SELECT event_id, user_id, CAST(k % 5 AS BIGINT) AS book_id, k % 8 + 1 AS chapter_idx,
        CAST(event_id % 5 AS INT) AS block_idx, CAST(event_id % 520 AS INT) AS "offset", "at" FROM activity""",
    "bookmark": """SELECT event_id AS id, user_id, CAST(k % 5 AS BIGINT) AS book_id, k * 10 AS start_txt,
        CASE WHEN event_type = 'error' THEN NULL ELSE CAST(k * 10 + event_id % 50 + 1 AS INT) END AS end_txt,
        CASE WHEN event_type = 'view' THEN NULL ELSE '#A1B2C3' END AS color,
        CASE WHEN event_type = 'click' THEN NULL ELSE 'memo ' || event_id END AS memo, "at" AS created_at FROM activity""",
    "job": """SELECT event_id AS id, user_id AS book_id,
        CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'READY' WHEN 'click' THEN 'PROCESSING'
             ELSE 'QUEUED' END AS status,
        CASE WHEN event_id % 10 = 9 THEN 'AI_ANALYSIS' ELSE 'NORMALIZATION' END AS pipeline_type, "at" AS created_at
        FROM activity""",
    "job_log": """SELECT event_id AS id, event_id // 7 AS job_id, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
        event_type AS step, k, "at" AS created_at FROM activity""",
    "asset": """SELECT event_id AS id, user_id // 25 AS book_id, user_id // 25 * 100 + user_id % 25 + 1 AS char_id,
        (['REFERENCE_SEED','DERIVED_CHARACTER','STANDALONE_TEXT'])[k % 3 + 1] AS role,
        CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'PUBLISHED' WHEN 'click' THEN 'QA_PASSED'
             WHEN 'view' THEN 'STALE_REFERENCE' ELSE 'QA_PENDING' END AS status,
        CASE WHEN event_type = 'error' THEN NULL WHEN k % 10 = 0 THEN ' ' ELSE 'img/' || event_id || '.png' END AS url,
        "at" AS created_at FROM activity""",
    "story_order": """SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chapter_idx, idx, id) AS ordinal FROM story_event""",
    "edge_fact": """SELECT e.*, v.chapter_idx, v.idx AS event_idx, v.event_id AS event_ref, v.ordinal,
        least(e.from_id, e.to_id) AS left_id, greatest(e.from_id, e.to_id) AS right_id,
        CAST(coalesce(e.interaction_count, 0) AS BIGINT) AS evidence,
        coalesce(CAST(e.sentiment_score AS DOUBLE), 0.0) * coalesce(e.interaction_count, 0) AS weighted
        FROM story_edge e JOIN story_order v ON e.event_id = v.id""",
    "stat_fact": """SELECT s.*, v.chapter_idx, v.idx AS event_idx, v.event_id AS event_ref, v.ordinal
        FROM story_stat s JOIN story_order v ON s.event_id = v.id""",
    "touch": """SELECT book_id, character_id, event_id, chapter_idx, event_idx, ordinal, 0 AS kind, id, node_weight FROM stat_fact
        UNION ALL SELECT book_id, from_id, event_id, chapter_idx, event_idx, ordinal, 1, id, NULL FROM edge_fact
        UNION ALL SELECT book_id, to_id, event_id, chapter_idx, event_idx, ordinal, 2, id, NULL FROM edge_fact""",
    "chapter_last": """SELECT * FROM story_event QUALIFY row_number() OVER (PARTITION BY book_id, chapter_idx ORDER BY idx DESC, id DESC) = 1""",
    "asked": """SELECT DISTINCT book_id, chapter_idx, "at" FROM position""",
}


def sql_over_views(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` behind the view definitions it mentions, in dependency order."""
    named = {**SQL_VIEWS, **(extra or {})}
    needed: set[str] = set()

    def visit(text: str) -> None:
        words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").replace(".", " ").split())
        for name, definition in named.items():
            if name in words and name not in needed:
                needed.add(name)
                visit(definition)

    visit(body)
    head = ", ".join(f"{name} AS ({definition})" for name, definition in named.items() if name in needed)
    return f"WITH {head} {body}" if head else body
