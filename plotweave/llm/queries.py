"""The registered queries of this subpackage, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm import align, chat, decontaminate, exact, minhash, packing, pages, phrases, quality, rules, token_store, urls, viterbi
from plotweave.llm.common import new_folder, table, text_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file, which every worker has."""
    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def keep(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return keep


@query("op1_bagminhash_near_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.classes(table(spark, folder, "documents")).drop("place")


@query("op2_greedy_tiling_decontamination")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.judged(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op3_typed_chat_format")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(control).alias("text"),
    )
    given = table(spark, folder, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    messages = given.unionByName(extra).withColumn("parts", chat.text_parts(F.col("text")))
    return chat.read_back(chat.format_turns(messages))


@query("op4_simple8b_store")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "token-store")
    token_store.write_store(table(spark, folder, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=2)
    return token_store.read_documents(spark, path)


@query(
    "op5_patricia_dedup",
    r"""
    WITH n AS (
      SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
    ), g AS (
      SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256
    FROM n JOIN g ON n.t = g.t
    """,
)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return exact.groups_of(table(spark, folder, "documents")).drop("place")


@query("op6_compression_quality")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.fit(docs, table(spark, folder, "labels"))
    return docs.select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        quality.score(model)(text_of()).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def _number(text: Column, salt: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(text, F.lit(salt))), 1, 6), 16, 10).cast("long")


def list_changes(captures: DataFrame) -> DataFrame:
    """Changes of four lists that follow from the captures: a third of the names are listed.

    The days of an entry count from 2024-01-01 and follow from a hash of its name, so the
    lists grow with the captures and SQL can say the same.
    """
    address = urls.address_of(F.col("url"))
    named = captures.select(urls.host_of(F.col("url")).alias("host"), address.alias("address")).filter("host <> ''").distinct()
    first = F.concat_ws("/", F.slice(F.split("address", "/"), 1, 2))

    def entry(name: str, verdict: str, kind: str, key: Column) -> Column:
        return F.struct(F.lit(name).alias("list"), F.lit(verdict).alias("verdict"), F.lit(kind).alias("kind"), key.alias("key"))

    kinds = F.array(
        entry("spam", "block", "domain", F.col("host")),
        entry("adult", "block", "prefix", first),
        entry("legal", "block", "url", F.col("address")),
        entry("trusted", "allow", "prefix", first),
    )
    names = named.select(F.explode(kinds).alias("e")).select("e.*").distinct()
    whole = F.concat("list", "key")
    listed = names.withColumns({"x": _number(whole, "x"), "y": _number(whole, "y")}).filter("x % 3 = 0")
    # Added on day a, removed b days later, and some added again c days after that.
    a, b, c = F.col("x") % 300, 20 + F.col("y") % 200, 10 + F.col("x") % 50

    def step(action: str, day: Column) -> Column:
        return F.struct(F.lit(action).alias("action"), day.alias("day"))

    steps = F.array(
        step("add", a), step("remove", F.when(F.col("y") % 2 == 0, a + b)), step("add", F.when(F.col("y") % 4 == 0, a + b + c))
    )
    return (
        listed.withColumn("s", F.explode(steps))
        .filter("s.day is not null")
        .select("list", "verdict", "kind", "key", "s.action", F.timestamp_add("DAY", F.col("s.day"), F.lit("2024-01-01").cast("timestamp")).alias("at"))
    )


@query(
    "op7_temporal_url_filter",
    r"""
    WITH captures AS (
      SELECT page_id, url, page_id * 7919 % 525600 AS minute,
        rtrim(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.') AS host,
        regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path
      FROM pages
    ), c AS (
      SELECT *, rtrim(host || path, '/') AS address FROM captures
    ), p AS (
      SELECT *, array_to_string(string_split(address, '/')[1:2], '/') AS start FROM c
    ), names AS (
      SELECT 'spam' AS list, 'block' AS verdict, 'domain' AS kind, host AS key FROM p WHERE host <> ''
      UNION SELECT 'adult', 'block', 'prefix', start FROM p WHERE host <> ''
      UNION SELECT 'legal', 'block', 'url', address FROM p WHERE host <> ''
      UNION SELECT 'trusted', 'allow', 'prefix', start FROM p WHERE host <> ''
    ), numbered AS (
      SELECT *, ('0x' || substr(md5(list || key || 'x'), 1, 6))::BIGINT AS x, ('0x' || substr(md5(list || key || 'y'), 1, 6))::BIGINT AS y
      FROM names
    ), dated AS (
      SELECT *, x % 300 AS a, 20 + y % 200 AS b, 10 + x % 50 AS c FROM numbered WHERE x % 3 = 0
    ), valid AS (
      SELECT list, verdict, kind, key, a * 1440 AS since, CASE WHEN y % 2 = 0 THEN (a + b) * 1440 END AS until FROM dated
      UNION ALL
      SELECT list, verdict, kind, key, (a + b + c) * 1440, NULL FROM dated WHERE y % 4 = 0
    ), active AS (
      SELECT p.page_id, count(*) AS n_entries, string_agg(DISTINCT list, ',' ORDER BY list) AS lists,
        bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow') AS blocked
      FROM p JOIN valid v ON v.since <= p.minute AND (v.until IS NULL OR p.minute < v.until) AND (
        v.kind = 'domain' AND (p.host = v.key OR ends_with(p.host, '.' || v.key))
        OR v.kind = 'prefix' AND (p.address = v.key OR starts_with(p.address, v.key || '/'))
        OR v.kind = 'url' AND p.address = v.key)
      GROUP BY p.page_id
    )
    SELECT p.page_id, p.url, TIMESTAMP '2024-01-01' + to_minutes(p.minute) AS fetched_at, coalesce(blocked, false) AS blocked,
      coalesce(n_entries, 0) AS n_entries, coalesce(lists, '') AS lists
    FROM p LEFT JOIN active USING (page_id)
    """,
)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "pages").select("page_id", "url")
    minute = F.timestamp_add("MINUTE", F.col("page_id") * 7919 % 525600, F.lit("2024-01-01").cast("timestamp"))
    return urls.judged(found.withColumn("fetched_at", minute), list_changes(found)).withColumn("fetched_at", F.col("fetched_at").cast("timestamp_ntz"))


@query("op8_count_only_viterbi")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    counted = viterbi.counted(vocabulary("piece_bpe_32k.model"))(text_of())
    return table(spark, folder, "documents").withColumn("made", counted).select("doc_id", "made.n_tokens", "made.n_words")


@query("op9_style_tree_text")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extracted(table(spark, folder, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op10_vector_packing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), end_id=1)
    return packing.with_checksums(pieces)


@query(
    "op11_de_bruijn_collocations",
    r"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents
    ), worded AS (
      SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces
    ), grams AS (
      SELECT lang, k AS size, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
      FROM worded, (VALUES (1), (2), (3)) sizes(k)
    ), counts AS (
      SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL
    ), totals AS (
      SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang
    ), candidates AS (
      SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counts WHERE size > 1 AND f >= 10
    ), cuts AS (
      SELECT lang, size, phrase, a, k, array_to_string(ws[1:k], ' ') AS first_part, array_to_string(ws[k + 1:], ' ') AS rest
      FROM candidates, (VALUES (1), (2)) cut(k) WHERE k < size
    ), scored AS (
      SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, k, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = first_part JOIN counts y ON y.lang = c.lang AND y.phrase = rest
    ), best AS (
      SELECT lang, phrase, a, l, r, score FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
    ), longer AS (
      SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(a) AS most
      FROM candidates, (VALUES (1), (2)) place(i) WHERE size = 3 GROUP BY ALL
    ), ranked AS (
      SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score
      FROM best b LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a
    )
    SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


@query("op12_shared_cut_alignment")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return align.alignment_digests(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


@query("op13_boosted_quality_rules")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return rules.judged(docs, rules.fit(docs, table(spark, folder, "labels")))
