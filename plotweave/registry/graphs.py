"""Relationship graphs: folds, running folds, snapshots, scopes."""

from pyspark.sql import functions as F

from plotweave.functions.coords import tags
from plotweave.operators import graph, scoped
from plotweave.registry.base import query
from plotweave.session import cut
from plotweave.views import Views


def facts(v: Views):
    return graph.edge_facts(v.edge, graph.story_order(v.event))


def touches(v: Views):
    story = graph.story_order(v.event)
    return graph.node_touches(graph.stat_facts(v.stat, story), graph.edge_facts(v.edge, story))


def plain_touches(v: Views):
    return graph.node_touches(graph.stat_facts(v.stat, v.event), graph.edge_facts(v.edge, v.event))


def text(labels):
    return F.array_join(labels, "|")


def six(column: str):
    """Rounded to six places; adding zero turns -0.0 into 0.0."""
    return F.round(column, 6) + F.lit(0.0)


@query(
    "jn_1_edge_event_chapter",
    """SELECT e.id, e.book_id, v.chapter_idx, v.idx AS event_idx, c.title, e.from_id, e.to_id
       FROM story_edge e JOIN story_event v ON e.event_id = v.id JOIN story_chapter c ON v.chapter_id = c.chapter_id""",
)
def _(v: Views):
    places = v.event.select(F.col("id").alias("event_id"), "chapter_id", F.col("idx").alias("event_idx"))
    titles = v.chapter.select("chapter_id", F.col("idx").alias("chapter_idx"), "title")
    return (
        v.edge.join(places, "event_id", "inner")
        .join(titles, "chapter_id", "inner")
        .select("id", "book_id", "chapter_idx", "event_idx", "title", "from_id", "to_id")
    )


@query(
    "jn_2_edge_character_twice",
    """SELECT e.id, f.character_id AS from_id, f.name AS from_name, t.character_id AS to_id, t.name AS to_name
       FROM story_edge e JOIN story_character f ON e.from_char_id = f.id JOIN story_character t ON e.to_char_id = t.id""",
)
def _(v: Views):
    return graph.with_logical_ids(v.edge, v.character).select("id", "from_id", "from_name", "to_id", "to_name")


@query(
    "jn_3_stat_event_chapter_character",
    """SELECT s.id, v.chapter_idx, v.idx AS event_idx, h.title, c.name, s.node_weight
       FROM story_stat s JOIN story_event v ON s.event_id = v.id JOIN story_chapter h ON v.chapter_id = h.chapter_id
       JOIN story_character c ON s.char_id = c.id""",
)
def _(v: Views):
    places = v.event.select(F.col("id").alias("event_id"), "chapter_id", "chapter_idx", F.col("idx").alias("event_idx"))
    return (
        v.stat.join(places, "event_id", "inner")
        .join(v.chapter.select("chapter_id", "title"), "chapter_id", "inner")
        .join(v.character.select(F.col("id").alias("char_id"), "name"), "char_id", "inner")
        .select("id", "chapter_idx", "event_idx", "title", "name", "node_weight")
    )


@query(
    "jn_8_node_stat_left",
    """SELECT n.book_id, n.event_id, n.character_id, CAST(s.node_weight AS FLOAT)::DOUBLE AS weight
       FROM (SELECT DISTINCT book_id, event_id, character_id FROM touch) n
       LEFT JOIN story_stat s ON s.event_id = n.event_id AND s.character_id = n.character_id""",
)
def _(v: Views):
    nodes = plain_touches(v).select("book_id", "event_id", "character_id").distinct()
    weights = v.stat.select("event_id", "character_id", F.col("node_weight").cast("float").cast("double").alias("weight"))
    return nodes.join(weights, ["event_id", "character_id"], "left")


@query(
    "jn_10_facts_of_selected_events",
    """SELECT id, event_id FROM story_edge WHERE event_id IN (SELECT id FROM chapter_last)""",
)
def _(v: Views):
    chosen = graph.chapter_last(v.event).select(F.col("id").alias("event_id"))
    return v.edge.join(chosen, "event_id", "left_semi").select("id", "event_id")


@query(
    "ag_4_undirected_edge_fold",
    """SELECT book_id, left_id, right_id, CAST(sum(evidence) AS BIGINT) AS evidence_count,
         round(CASE WHEN sum(evidence) > 0 THEN sum(weighted) / sum(evidence) ELSE 0.0 END, 6) + 0.0 AS positivity
       FROM edge_fact GROUP BY 1, 2, 3""",
)
def _(v: Views):
    return graph.fold_edges(graph.edge_facts(v.edge, v.event)).select(
        "book_id", "left_id", "right_id", "evidence_count", six("positivity").alias("positivity")
    )


@query(
    "ag_5_label_scores",
    """SELECT book_id, left_id, right_id, label, CAST(sum(evidence) AS BIGINT) AS score
       FROM (SELECT *, unnest(labels) AS label FROM edge_fact) GROUP BY 1, 2, 3, 4""",
)
def _(v: Views):
    return graph.label_scores(graph.edge_facts(v.edge, v.event))


@query(
    "ag_6_direction_counts",
    """SELECT book_id, left_id, right_id, from_id || '->' || to_id AS direction, CAST(sum(evidence) AS BIGINT) AS count
       FROM edge_fact GROUP BY 1, 2, 3, 4""",
)
def _(v: Views):
    return graph.direction_counts(graph.edge_facts(v.edge, v.event))


@query(
    "ag_7_latest_edge_state",
    """SELECT book_id, left_id, right_id, array_to_string(labels, '|') AS latest_labels, explanation AS latest_reason,
         event_ref AS latest_event_id
       FROM edge_fact QUALIFY row_number() OVER (PARTITION BY book_id, left_id, right_id
         ORDER BY chapter_idx DESC, event_idx DESC, id DESC) = 1""",
)
def _(v: Views):
    return graph.fold_edges(graph.edge_facts(v.edge, v.event)).select(
        "book_id", "left_id", "right_id", text("latest_labels").alias("latest_labels"), "latest_reason", "latest_event_id"
    )


@query(
    "ag_8_node_fold",
    """SELECT book_id, character_id, CAST(CAST(sum(node_weight) AS FLOAT) AS DOUBLE) AS weight,
         CAST(nullif(count(node_weight), 0) AS INT) AS count FROM touch GROUP BY 1, 2""",
)
def _(v: Views):
    return graph.fold_nodes(plain_touches(v)).select(
        "book_id", "character_id", F.col("weight").cast("double").alias("weight"), "count"
    )


@query(
    "ag_9_stat_rows_per_character",
    """SELECT book_id, character_id, count(*) AS stat_rows FROM story_stat
       WHERE event_id IN (SELECT id FROM chapter_last) GROUP BY 1, 2""",
)
def _(v: Views):
    chosen = graph.chapter_last(v.event).select(F.col("id").alias("event_id"))
    return (
        v.stat.join(chosen, "event_id", "left_semi")
        .groupBy("book_id", "character_id")
        .agg(F.count("*").alias("stat_rows"))
    )


@query(
    "ag_11_delta_records",
    """SELECT v.id AS event_id, v.event_id AS event_ref, 'relationship-delta-v1' AS contract_version,
         coalesce(i.items, 0) AS items, coalesce(i.evidence, 0) AS evidence,
         coalesce(w.weights, 0) AS weights, w.total AS total_weight
       FROM story_event v
       LEFT JOIN (SELECT event_id, count(*) AS items, CAST(sum(interaction_count) AS BIGINT) AS evidence FROM story_edge GROUP BY 1) i
         ON i.event_id = v.id
       LEFT JOIN (SELECT event_id, count(*) AS weights, sum(node_weight) AS total FROM story_stat GROUP BY 1) w ON w.event_id = v.id""",
)
def _(v: Views):
    records = graph.delta_records(v.event, v.edge, v.stat)
    zero = F.lit(0).cast("bigint")
    evidence = F.aggregate(
        F.coalesce("items", F.array().cast(records.schema["items"].dataType)),
        zero,
        lambda acc, x: acc + F.coalesce(x["evidence_count"], F.lit(0)),
    )
    total = F.aggregate(F.map_values("node_weights"), F.lit(0.0), lambda acc, x: acc + x)
    return records.select(
        "event_id",
        "event_ref",
        "contract_version",
        F.when(F.col("items").isNull(), zero).otherwise(F.size("items")).alias("items"),
        evidence.alias("evidence"),
        F.when(F.col("node_weights").isNull(), zero).otherwise(F.size("node_weights")).alias("weights"),
        total.alias("total_weight"),
    )


@query(
    "ag_26_chapter_cumulative_edges",
    """SELECT book_id, from_id, to_id, chapter_idx, CAST(sum(e) OVER w AS BIGINT) AS cumulative_interaction,
         round(sum(s) OVER w, 6) + 0.0 AS sentiment_weighted_sum
       FROM (SELECT book_id, from_id, to_id, CAST(chapter_idx AS BIGINT) AS chapter_idx, sum(evidence) AS e, sum(weighted) AS s
             FROM edge_fact GROUP BY 1, 2, 3, 4)
       WINDOW w AS (PARTITION BY book_id, from_id, to_id ORDER BY chapter_idx)""",
)
def _(v: Views):
    rows = graph.chapter_cumulative_edges(graph.edge_facts(v.edge, v.event))
    return rows.withColumn("sentiment_weighted_sum", six("sentiment_weighted_sum"))


@query(
    "st_6_top_three_labels",
    """SELECT book_id, left_id, right_id, string_agg(label, '|' ORDER BY score DESC, label) AS labels
       FROM (SELECT book_id, left_id, right_id, label, sum(evidence) AS score,
               row_number() OVER (PARTITION BY book_id, left_id, right_id ORDER BY sum(evidence) DESC, label) AS rn
             FROM (SELECT *, unnest(labels) AS label FROM edge_fact) GROUP BY 1, 2, 3, 4)
       WHERE rn <= 3 GROUP BY 1, 2, 3""",
)
def _(v: Views):
    scores = graph.label_scores(graph.edge_facts(v.edge, v.event))
    return graph.top_label_lists(scores).withColumn("labels", text("labels"))


@query(
    "relationship_graph_edges",
    """SELECT f.book_id, f.left_id, f.right_id, f.evidence_count, f.positivity, coalesce(t.labels, '') AS labels,
         d.directions, n.latest_labels, n.latest_reason, n.latest_event_id
       FROM (SELECT book_id, left_id, right_id, CAST(sum(evidence) AS BIGINT) AS evidence_count,
               round(CASE WHEN sum(evidence) > 0 THEN sum(weighted) / sum(evidence) ELSE 0.0 END, 6) + 0.0 AS positivity
             FROM edge_fact GROUP BY 1, 2, 3) f
       LEFT JOIN (SELECT book_id, left_id, right_id, string_agg(label, '|' ORDER BY score DESC, label) AS labels
             FROM (SELECT book_id, left_id, right_id, label, sum(evidence) AS score,
                     row_number() OVER (PARTITION BY book_id, left_id, right_id ORDER BY sum(evidence) DESC, label) AS rn
                   FROM (SELECT *, unnest(labels) AS label FROM edge_fact) GROUP BY 1, 2, 3, 4)
             WHERE rn <= 3 GROUP BY 1, 2, 3) t USING (book_id, left_id, right_id)
       JOIN (SELECT book_id, left_id, right_id, string_agg(direction || '=' || n, '|' ORDER BY direction) AS directions
             FROM (SELECT book_id, left_id, right_id, from_id || '->' || to_id AS direction, CAST(sum(evidence) AS BIGINT) AS n
                   FROM edge_fact GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) d USING (book_id, left_id, right_id)
       JOIN (SELECT book_id, left_id, right_id, array_to_string(labels, '|') AS latest_labels, explanation AS latest_reason,
               event_ref AS latest_event_id
             FROM edge_fact QUALIFY row_number() OVER (PARTITION BY book_id, left_id, right_id
               ORDER BY chapter_idx DESC, event_idx DESC, id DESC) = 1) n USING (book_id, left_id, right_id)""",
)
def relationship_graph(v: Views):
    edges = graph.relationship_edges(graph.edge_facts(v.edge, v.event))
    directions = F.transform(
        F.map_entries("direction_counts"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))
    )
    return edges.select(
        "book_id",
        "left_id",
        "right_id",
        "evidence_count",
        six("positivity").alias("positivity"),
        text("labels").alias("labels"),
        text(directions).alias("directions"),
        text("latest_labels").alias("latest_labels"),
        "latest_reason",
        "latest_event_id",
    )


@query(
    "se_1_node_set",
    "SELECT DISTINCT book_id, character_id FROM touch",
)
def _(v: Views):
    return graph.node_set(plain_touches(v))


@query(
    "wn_1_last_event_of_chapter",
    "SELECT book_id, chapter_idx, id, event_id FROM chapter_last",
)
def _(v: Views):
    return graph.chapter_last(v.event).select("book_id", "chapter_idx", "id", "event_id")


SNAPSHOT_SQL = """SELECT book_id, character_id, CAST(c AS BIGINT) AS valid_from,
         CAST(coalesce(lead(c) OVER w, 1099511627776) AS BIGINT) AS valid_until,
         CAST(CAST(last_value(weight IGNORE NULLS) OVER w AS FLOAT) AS DOUBLE) AS weight,
         CAST(nullif(sum(n) OVER w, 0) AS INT) AS count
       FROM (SELECT t.book_id, t.character_id, t.chapter_idx AS c, max(node_weight) AS weight, count(node_weight) AS n
             FROM touch t JOIN chapter_last l ON t.event_id = l.id GROUP BY 1, 2, 3)
       WINDOW w AS (PARTITION BY book_id, character_id ORDER BY c)"""


@query("wn_2_snapshot_nodes", SNAPSHOT_SQL)
def snapshot(v: Views):
    return graph.snapshot_nodes(v.event, v.stat, v.edge).withColumn("weight", F.col("weight").cast("double"))


@query(
    "prefix_snapshot_edges",
    """SELECT e.id, l.chapter_idx AS valid_from FROM story_edge e JOIN chapter_last l ON e.event_id = l.id""",
)
def _(v: Views):
    edges = graph.snapshot_edges(v.event, v.edge)
    return edges.select((F.col("event_id") * 1000 + F.col("from_id") * 30 + F.col("to_id")).alias("id"), "valid_from")


@query(
    "wn_12_first_appearance",
    """SELECT book_id, character_id, chapter_idx, event_idx, kind FROM touch
       QUALIFY row_number() OVER (PARTITION BY book_id, character_id
         ORDER BY chapter_idx, event_idx, least(kind, 1), id, kind) = 1""",
)
def _(v: Views):
    return graph.fold_nodes(plain_touches(v)).select(
        "book_id", "character_id", "first_seen.chapter_idx", "first_seen.event_idx", "first_seen.kind"
    )


@query("wn_13_event_ordinal", "SELECT id, book_id, ordinal FROM story_order")
def _(v: Views):
    return graph.story_order(v.event).select("id", "book_id", "ordinal")


@query(
    "wn_14_running_edges",
    """SELECT book_id, left_id, right_id, CAST(ordinal AS BIGINT) AS valid_from,
         CAST(coalesce(lead(ordinal) OVER w, 1099511627776) AS BIGINT) AS valid_until,
         CAST(sum(e) OVER w AS BIGINT) AS evidence_count,
         round(CASE WHEN sum(e) OVER w > 0 THEN sum(s) OVER w / sum(e) OVER w ELSE 0.0 END, 6) + 0.0 AS positivity,
         labels AS latest_labels, explanation AS latest_reason, event_ref AS latest_event_id
       FROM (SELECT book_id, left_id, right_id, ordinal, sum(evidence) AS e, sum(weighted) AS s,
               arg_max(array_to_string(labels, '|'), id) AS labels, arg_max(struct_pack(x := explanation), id).x AS explanation,
               max(event_ref) AS event_ref FROM edge_fact GROUP BY 1, 2, 3, 4)
       WINDOW w AS (PARTITION BY book_id, left_id, right_id ORDER BY ordinal)""",
)
def _(v: Views):
    return (
        graph.running_edges(facts(v))
        .withColumn("positivity", six("positivity"))
        .withColumn("latest_labels", text("latest_labels"))
    )


@query(
    "wn_14_running_nodes",
    """SELECT book_id, character_id, CAST(ordinal AS BIGINT) AS valid_from,
         CAST(coalesce(lead(ordinal) OVER w, 1099511627776) AS BIGINT) AS valid_until,
         CASE WHEN sum(n) OVER w > 0 THEN CAST(CAST(sum(x) OVER w AS FLOAT) AS DOUBLE) END AS weight,
         CAST(nullif(sum(n) OVER w, 0) AS INT) AS count
       FROM (SELECT book_id, character_id, ordinal, coalesce(sum(node_weight), 0) AS x, count(node_weight) AS n
             FROM touch GROUP BY 1, 2, 3)
       WINDOW w AS (PARTITION BY book_id, character_id ORDER BY ordinal)""",
)
def _(v: Views):
    return graph.running_nodes(touches(v)).withColumn("weight", F.col("weight").cast("double"))


SCOPE_VIEW = """SELECT event_id AS scope_id, event_id // 85 AS book_id,
    (['book', 'chapter', 'event', 'locator'])[event_id % 4 + 1] AS scope,
    CASE WHEN event_id % 4 IN (1, 3) THEN k % 10 END AS chapter_idx,
    CASE WHEN event_id % 4 = 2 THEN 'ch' || (k % 8 + 1) || '-e' || (event_id % 16 + 1) END AS event_ref,
    CASE WHEN event_id % 4 = 3 THEN CAST(event_id * 37 % 1720 AS INT) END AS at FROM activity"""


def scopes(v: Views):
    return v.activity.selectExpr(
        "event_id AS scope_id",
        "event_id div 85 AS book_id",
        "element_at(array('book', 'chapter', 'event', 'locator'), int(event_id % 4) + 1) AS scope",
        "if(event_id % 4 IN (1, 3), k % 10, null) AS chapter_idx",
        "if(event_id % 4 = 2, concat('ch', k % 8 + 1, '-e', event_id % 16 + 1), null) AS event_ref",
        "if(event_id % 4 = 3, int(event_id * 37 % 1720), null) AS at",
    )


SCOPED_SQL = """SELECT s.scope_id, s.scope, f.* FROM scope s JOIN {facts} f ON f.book_id = s.book_id
    JOIN story_order v ON v.id = f.event_id
    LEFT JOIN story_order t ON t.book_id = s.book_id AND t.event_id = s.event_ref
    WHERE s.scope = 'book' OR (s.scope = 'chapter' AND v.chapter_idx <= s.chapter_idx)
      OR (s.scope = 'event' AND v.ordinal <= t.ordinal)
      OR (s.scope = 'locator' AND (v.chapter_idx < s.chapter_idx OR (v.chapter_idx = s.chapter_idx AND v.start_txt <= s.at)))"""


@query(
    "flt_11_prefix_scopes",
    """SELECT s.scope_id, s.scope, count(v.id) AS upto FROM scope s
       LEFT JOIN story_order t ON t.book_id = s.book_id AND t.event_id = s.event_ref
       LEFT JOIN story_order v ON v.book_id = s.book_id AND (s.scope = 'book'
          OR (s.scope = 'chapter' AND v.chapter_idx <= s.chapter_idx) OR (s.scope = 'event' AND v.ordinal <= t.ordinal)
          OR (s.scope = 'locator' AND (v.chapter_idx < s.chapter_idx OR (v.chapter_idx = s.chapter_idx AND v.start_txt <= s.at))))
       GROUP BY 1, 2""",
    scope=SCOPE_VIEW,
)
def _(v: Views):
    resolved = graph.scope_ordinals(scopes(v), graph.story_order(v.event), graph.reading_order(v.event))
    return resolved.select("scope_id", "scope", "upto")


@query(
    "scoped_relationship_graph",
    """SELECT scope_id, count(*) AS edges, CAST(sum(evidence_count) AS BIGINT) AS evidence,
         CAST(sum(CAST(round(positivity * 1000000) AS BIGINT)) AS BIGINT) AS positivity_millionths,
         min(latest_event_id) AS first_latest, max(latest_event_id) AS last_latest
       FROM (SELECT scope_id, left_id, right_id, CAST(sum(evidence) AS BIGINT) AS evidence_count,
               CASE WHEN sum(evidence) > 0 THEN sum(weighted) / sum(evidence) ELSE 0.0 END AS positivity,
               max(struct_pack(a := chapter_idx, b := event_idx, r := event_ref)).r AS latest_event_id
             FROM scoped GROUP BY 1, 2, 3) GROUP BY 1""",
    scope=SCOPE_VIEW,
    scoped=SCOPED_SQL.format(facts="edge_fact"),
)
def scoped_graph(v: Views):
    resolved, facts = resolved_scopes(v), scoped.pair_facts(v.edge, both_orders(v))
    totals = scoped.at_prefixes(scoped.pair_log(facts), resolved, 2 * facts.count()).groupBy(*PREFIX).agg(
        F.count("*").alias("edges"),
        F.sum("evidence_count").alias("evidence"),
        F.sum(F.round(F.col("positivity") * 1000000).cast("bigint")).alias("positivity_millionths"),
        F.min("latest_event_id").alias("first_latest"),
        F.max("latest_event_id").alias("last_latest"),
    )
    return resolved.select("scope_id", *PREFIX).join(totals, PREFIX, "inner").drop(*PREFIX)


PREFIX = ["book_id", "along", "upto"]


def both_orders(v: Views):
    return scoped.both_orders(graph.story_order(v.event), graph.reading_order(v.event))


def resolved_scopes(v: Views):
    # Both the prefixes and the way back to their scopes read this table.
    resolved = graph.scope_ordinals(scopes(v), graph.story_order(v.event), graph.reading_order(v.event))
    return cut(resolved.select("scope_id", "scope", *PREFIX))


def digests(resolved, log, weight, parts, characters=None):
    """Per scope the number of rows and a digest of all their columns, as text in order."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    line = F.concat_ws("/", *[F.coalesce(c.cast("string"), F.lit("~")) for c in columns])
    lines = scoped.lines_at(log, resolved, weight, line, characters).select(
        *PREFIX, F.size("lines").alias("n"), F.md5(F.array_join("lines", "\n").cast("binary")).alias("digest")
    )
    found = lines.filter("n > 0").withColumn("n", F.col("n").cast("long"))
    return resolved.join(found, PREFIX, "inner").drop(*PREFIX)


def entries(name: str):
    return F.array_join(F.transform(F.map_entries(name), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), "|")


@query(
    "scoped_graph_edges",
    """SELECT scope_id, scope, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY line)) AS digest FROM (
         SELECT scope_id, scope, concat_ws('/', left_id, right_id, evidence, positivity, coalesce(labels, ''), coalesce(scores, ''), directions,
             array_to_string(newest.labels, '|'), coalesce(newest.reason, '~'), newest.ref) AS line
         FROM (SELECT scope_id, scope, left_id, right_id, CAST(sum(evidence) AS BIGINT) AS evidence,
                 CAST(round(1000000 * CASE WHEN sum(evidence) > 0 THEN sum(weighted) / sum(evidence) ELSE 0.0 END) AS BIGINT) AS positivity,
                 arg_max(struct_pack(labels := labels, reason := explanation, ref := event_ref), struct_pack(a := chapter_idx, b := event_idx, c := id)) AS newest
               FROM scoped GROUP BY ALL)
         LEFT JOIN (SELECT scope_id, left_id, right_id, string_agg(label || '=' || score, '|' ORDER BY label) AS scores,
                 array_to_string((list(label ORDER BY score DESC, label))[1:3], '|') AS labels
               FROM (SELECT scope_id, left_id, right_id, label, CAST(sum(evidence) AS BIGINT) AS score
                     FROM (SELECT *, unnest(labels) AS label FROM scoped) GROUP BY ALL) GROUP BY ALL) USING (scope_id, left_id, right_id)
         JOIN (SELECT scope_id, left_id, right_id, string_agg(way || '=' || score, '|' ORDER BY way) AS directions
               FROM (SELECT scope_id, left_id, right_id, from_id || '->' || to_id AS way, CAST(sum(evidence) AS BIGINT) AS score
                     FROM scoped GROUP BY ALL) GROUP BY ALL) USING (scope_id, left_id, right_id))
       GROUP BY ALL""",
    scope=SCOPE_VIEW,
    scoped=SCOPED_SQL.format(facts="edge_fact"),
)
def _(v: Views):
    facts = scoped.pair_facts(v.edge, both_orders(v))
    positivity = F.round(F.col("positivity") * 1000000).cast("bigint")
    parts = ["left_id", "right_id", "evidence_count", positivity, text("labels"), entries("label_scores"), entries("direction_counts"),
             text("latest_labels"), "latest_reason", "latest_event_id"]
    return digests(resolved_scopes(v), scoped.edge_log(facts), 2 * facts.count(), parts)


@query(
    "scoped_graph_nodes",
    """SELECT scope_id, scope, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY line)) AS digest FROM (
         SELECT scope_id, scope, concat_ws('/', character_id, coalesce(weight, '~'), coalesce(n, '~'), c.name, c.is_main, coalesce(c.profile_image, '~'),
             coalesce(CASE WHEN c.personality_text = '' THEN NULL WHEN length(c.t) <= 200 THEN c.t ELSE substring(c.t, 1, 197) || '...' END, '~'),
             coalesce(c.profile_text, '~'), array_to_string(c.name_list, '|')) AS line
         FROM (SELECT scope_id, scope, book_id, character_id, CAST(CAST(1000 * sum(node_weight) AS BIGINT) AS VARCHAR) AS weight,
                 CAST(nullif(count(node_weight), 0) AS VARCHAR) AS n FROM scoped GROUP BY ALL)
         JOIN (SELECT *, trim(regexp_replace(personality_text, '\\s+', ' ', 'g')) AS t FROM story_character) c USING (book_id, character_id))
       GROUP BY ALL""",
    scope=SCOPE_VIEW,
    scoped=SCOPED_SQL.format(facts="touch"),
)
def _(v: Views):
    facts = scoped.touch_facts(v.stat, v.edge, both_orders(v))
    parts = ["character_id", (F.col("weight") * 1000).cast("bigint"), "count", "label", "is_main", "profile_image", "description", "portrait_prompt",
             text("names")]
    return digests(resolved_scopes(v), scoped.node_log(facts), 2 * facts.count(), parts, v.character)


REQUEST_VIEW = """SELECT event_id AS request_id, event_id // 85 AS book_id,
    CASE WHEN event_id % 4 = 0 THEN 'ch' || (k % 8 + 1) || '-e' || (event_id % 16 + 1) END AS event_ref,
    CASE WHEN event_id % 4 = 1 THEN 'ch' || (k % 4 + 1) || '-e' || (event_id % 16 + 1) END AS from_ref,
    CASE WHEN event_id % 4 = 1 THEN 'ch' || (k % 4 + 4) || '-e' || (event_id % 16 + 1) END AS to_ref,
    CASE WHEN event_id % 4 IN (0, 2) THEN k % 9 + 1 END AS chapter_idx FROM activity"""


@query(
    "flt_12_raw_delta_selection",
    """SELECT r.request_id, count(*) AS events, min(v.id) AS first_id, max(v.id) AS last_id FROM request r JOIN story_order v ON v.book_id = r.book_id
       LEFT JOIN story_order f ON f.book_id = r.book_id AND f.event_id = r.from_ref
       LEFT JOIN story_order t ON t.book_id = r.book_id AND t.event_id = r.to_ref
       WHERE CASE WHEN r.event_ref IS NOT NULL THEN v.event_id = r.event_ref
                  WHEN r.from_ref IS NOT NULL THEN v.ordinal BETWEEN f.ordinal AND t.ordinal
                  WHEN r.chapter_idx IS NOT NULL THEN v.chapter_idx = r.chapter_idx ELSE true END GROUP BY 1""",
    request=REQUEST_VIEW,
)
def _(v: Views):
    asked = v.activity.selectExpr(
        "event_id AS request_id",
        "event_id div 85 AS book_id",
        "if(event_id % 4 = 0, concat('ch', k % 8 + 1, '-e', event_id % 16 + 1), null) AS event_ref",
        "if(event_id % 4 = 1, concat('ch', k % 4 + 1, '-e', event_id % 16 + 1), null) AS from_ref",
        "if(event_id % 4 = 1, concat('ch', k % 4 + 4, '-e', event_id % 16 + 1), null) AS to_ref",
        "if(event_id % 4 IN (0, 2), k % 9 + 1, null) AS chapter_idx",
    )
    chosen = graph.delta_events(asked, graph.story_order(v.event))
    return chosen.groupBy("request_id").agg(
        F.count("*").alias("events"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


@query(
    "prj_2_graph_nodes",
    """SELECT n.book_id, n.character_id, c.name AS label, c.is_main, c.profile_image,
         CASE WHEN c.personality_text IS NULL OR c.personality_text = '' THEN NULL
              WHEN length(t) <= 200 THEN t ELSE substring(t, 1, 197) || '...' END AS description,
         c.profile_text AS portrait_prompt, array_to_string(c.name_list, '|') AS names, n.weight, n.count
       FROM (SELECT book_id, character_id, CAST(CAST(sum(node_weight) AS FLOAT) AS DOUBLE) AS weight,
               CAST(nullif(count(node_weight), 0) AS INT) AS count FROM touch GROUP BY 1, 2) n
       JOIN (SELECT *, trim(regexp_replace(personality_text, '\\s+', ' ', 'g')) AS t FROM story_character) c
         USING (book_id, character_id)""",
)
def _(v: Views):
    nodes = graph.fold_nodes(plain_touches(v)).drop("first_seen")
    return (
        graph.describe_nodes(nodes, v.character)
        .withColumn("names", text("names"))
        .withColumn("weight", F.col("weight").cast("double"))
    )


@query(
    "prj_3_plain_edges",
    """SELECT event_id, from_id, to_id, coalesce(CAST(sentiment_score AS DOUBLE), 0.0) AS sentiment, interaction_count,
         array_to_string(labels, '|') AS tags FROM story_edge""",
)
def _(v: Views):
    return graph.plain_edges(v.edge).drop("book_id").withColumn("tags", text("tags"))


@query(
    "prj_4_delta_items",
    """SELECT event_id, from_id, to_id, array_to_string(labels, '|') AS labels, CAST(sentiment_score AS DOUBLE) AS positivity,
         interaction_count AS evidence_count, explanation AS reason FROM story_edge""",
)
def _(v: Views):
    return graph.delta_items(v.edge).withColumn("labels", text("labels"))


@query(
    "snk_6_graph_payload",
    """SELECT book_id, left_id AS id1, right_id AS id2, CAST(sum(evidence) AS BIGINT) AS count,
         array_to_string(arg_max(labels, struct_pack(a := chapter_idx, b := event_idx, c := id)), '|') AS relation
       FROM edge_fact GROUP BY 1, 2, 3""",
)
def _(v: Views):
    from plotweave.sources.payloads import graph_edge_json

    edges = graph.relationship_edges(graph.edge_facts(v.edge, v.event))
    parsed = F.from_json(
        "payload", "id1 bigint, id2 bigint, count bigint, latestLabels array<string>"
    )
    return graph_edge_json(edges).select("book_id", parsed.alias("p")).select(
        "book_id", "p.id1", "p.id2", "p.count", text("p.latestLabels").alias("relation")
    )
