"""Small inputs with known results."""

import pytest
from pyspark.sql import functions as F

from plotweave.functions import coords, ids, text, titles
from plotweave.operators import catalog, corpus, graph, positions, scoped
from plotweave.operators.planner import Limits, plan_chapters, plan_groups

EVENT = """id long, book_id long, chapter_id long, chapter_idx int, idx int, event_id string, start_block int, start_offset int,
  end_block int, end_offset int, start_txt int, end_txt int, raw_text string"""
EDGE = """id long, event_id long, book_id long, from_id long, to_id long, explanation string, relation_tags string,
  interaction_count int, sentiment_score float"""
STAT = "id long, event_id long, book_id long, character_id long, node_weight double"


def events(spark, *rows):
    return spark.createDataFrame(
        [(i, 1, c, c, idx, f"ch{c}-e{idx}", 0, 0, 0, 0, s, e, "t") for i, c, idx, s, e in rows], EVENT
    )


def test_fold_joins_both_directions(spark):
    ev = events(spark, (10, 1, 1, 0, 50), (11, 1, 2, 50, 90))
    edges = spark.createDataFrame(
        [(1, 10, 1, 1, 2, "first", '["trust"]', 1, 1.0), (2, 11, 1, 2, 1, "second", '["conflict"]', 3, -0.5)], EDGE
    )
    row = graph.relationship_edges(graph.edge_facts(edges, ev)).first()
    assert (row.left_id, row.right_id, row.evidence_count, row.positivity) == (1, 2, 4, -0.125)
    assert row.labels == ["conflict", "trust"]
    assert row.label_scores == {"trust": 1, "conflict": 3}
    assert row.direction_counts == {"1->2": 1, "2->1": 3}
    assert (row.latest_labels, row.latest_reason, row.latest_event_id) == (["conflict"], "second", "ch1-e2")


def test_fold_keeps_null_and_empty_newest_values(spark):
    ev = events(spark, (10, 1, 1, 0, 50), (11, 1, 2, 50, 90))
    edges = spark.createDataFrame(
        [(1, 10, 1, 1, 2, "first", '["a","a"]', 2, None), (2, 11, 1, 1, 2, None, "oops", None, 0.5)], EDGE
    )
    row = graph.relationship_edges(graph.edge_facts(edges, ev)).first()
    assert (row.evidence_count, row.positivity) == (2, 0.0)
    assert row.label_scores == {"a": 4}
    assert (row.latest_labels, row.latest_reason, row.latest_event_id) == ([], None, "ch1-e2")


def test_prefix_snapshot_takes_the_event_that_has_begun(spark):
    ev = events(spark, (10, 1, 1, 0, 40), (11, 1, 2, 50, 100))
    at = spark.createDataFrame([(1, 1, 45)], "book_id long, chapter_idx int, at int")
    assert [r.event_row for r in positions.prefix_events(at, ev).collect()] == [10]
    stats = spark.createDataFrame([(1, 10, 1, 7, 0.9)], STAT)
    none = spark.createDataFrame([], EDGE)
    node = graph.snapshot_nodes(ev.filter("id = 10"), stats, none).first()
    assert round(node.weight, 6) == 0.9 and node["count"] == 1


def test_event_at_position(spark):
    ev = events(spark, (10, 2, 1, 0, 50), (11, 2, 2, 50, 100))
    at = spark.createDataFrame([(1, 2, 60), (1, 2, 49), (1, 2, 500)], "book_id long, chapter_idx int, at int")
    found = {r["at"]: r.event_row for r in positions.event_at(at, ev).collect()}
    assert found == {60: 11, 49: 10, 500: 11}


def test_overlapping_events_go_to_the_lowest_index(spark):
    ev = events(spark, (10, 1, 1, 100, 400), (11, 1, 2, 0, 150), (12, 1, 3, 120, 130))
    at = spark.createDataFrame([(1, 1, x) for x in (0, 99, 100, 125, 160, 400)], "book_id long, chapter_idx int, at int")
    found = {r["at"]: r.event_row for r in positions.event_at(at, ev).collect()}
    assert found == {0: 11, 99: 11, 100: 10, 125: 10, 160: 10, 400: 12}


@pytest.mark.parametrize(
    "starts,lengths,total,at,expected",
    [
        ([0, 5, 9], [5, 4, 3], 12, 7, (1, 2)),
        ([0, 3], [3, 2], None, 5, (1, 2)),
        ([0, 4], [4, 3], 7, 5, (1, 1)),
        ([0, 3, 3], [3, 0, 2], 5, 3, (2, 0)),
        ([0, 3], [3, 2], 5, 6, None),
        ([0, 3], [3, 2], 5, -1, None),
    ],
)
def test_offset_to_locator(spark, starts, lengths, total, at, expected):
    df = spark.createDataFrame([(starts, lengths, total, at)], "s array<int>, n array<int>, total int, at int")
    size = coords.total_code_points(F.col("total"), F.col("s"), F.col("n"))
    place = coords.offset_to_locator(F.lit(1), F.col("s"), F.col("n"), size, F.col("at"))
    got = df.select(place.alias("p")).first().p
    assert (got and (got.blockIndex, got.offset)) == expected


def test_locator_to_offset_bounds(spark):
    df = spark.createDataFrame(
        [(1, 2), (0, 5), (0, 6), (3, 0), (-1, 0), (None, 1)], "b int, o int"
    ).withColumns({"s": F.expr("array(0, 5, 9)"), "n": F.expr("array(5, 4, 3)")})
    got = [r.x for r in df.select(coords.locator_to_offset(F.col("s"), F.col("n"), F.col("b"), F.col("o")).alias("x")).collect()]
    assert got == [7, 5, None, None, None, None]


def test_text_columns(spark):
    df = spark.createDataFrame([("  a\t\n b\x01 ", "x" * 250, " , a,,b ")], "a string, b string, c string")
    row = df.select(
        text.collapse(F.col("a")).alias("a"), text.truncated(F.col("b"), 200).alias("b"),
        text.split_names(F.col("c"), F.lit("z")).alias("c"), text.truncated(F.lit("  "), 9).alias("d"),
    ).first()
    assert row.a == "a b" and row.b == "x" * 197 + "..." and row.c == ["a", "b"] and row.d == ""


def test_ids(spark):
    raw = ["12", "0012", "c007", "C12", " c3\n", "x1", "", None, "c", "1c"]
    df = spark.createDataFrame([(r,) for r in raw], "r string")
    assert [r.x for r in df.select(ids.character_id(F.col("r")).alias("x")).collect()] == [12, 12, 7, 12, 3, None, None, None, None, None]
    raw = ["ch2-e5", "ch3-e5", "7", "e7", " ch2-e1 ", "ch2-e1x"]
    df = spark.createDataFrame([(r,) for r in raw], "r string")
    assert [r.x for r in df.select(ids.event_idx(F.col("r"), F.lit(2)).alias("x")).collect()] == [5, None, 7, None, 1, None]


def test_roles_follow_rule_order(spark):
    cases = [("Epilogue", "APPENDIX"), ("Prologue", "CHAPTER"), ("Table of Contents", "CONTENTS"), ("xiv", "CHAPTER"), ("Actors", "UNKNOWN")]
    df = spark.createDataFrame(cases, "t string, r string")
    assert df.filter(titles.role(F.col("t"), F.array("t")) != F.col("r")).count() == 0


def units(spark, *rows):
    return spark.createDataFrame(
        [(1, n, title, role, path, size, "book.xhtml") for n, (title, role, path, size) in enumerate(rows, 1)],
        "book_id long, unit_no int, title string, role string, path array<string>, size int, doc_href string",
    )


def chapters_of(df, limits=Limits()):
    return corpus.chapter_plans(plan_chapters(df, limits)).orderBy("chapter_idx").collect()


def test_scenes_become_acts(spark):
    df = units(
        spark,
        ("SCENE I", "SCENE", ["PLAY", "ACT I", "SCENE I"], 5000),
        ("SCENE II", "SCENE", ["PLAY", "ACT I", "SCENE II"], 4000),
        ("SCENE I", "SCENE", ["PLAY", "ACT II", "SCENE I"], 4500),
    )
    assert [c.title for c in chapters_of(df)] == ["ACT I", "ACT II"]


def test_cantos_are_grouped(spark):
    sizes = [1200, 1100, 1300, 1250, 1280]
    df = units(spark, *[(f"Canto {n}", "CANTO", ["Book I", f"Canto {n}"], s) for n, s in enumerate(sizes, 1)])
    plans = chapters_of(df, Limits(3000, 3000, 6000, 8000, 2))
    assert len(plans) < 5 and "Book I" in plans[0].title


def test_chapter_cap(spark):
    df = units(spark, *[(f"Chapter {n}", "CHAPTER", ["Novel", f"Chapter {n}"], 2500) for n in range(1, 76)])
    plans = chapters_of(df)
    assert len(plans) <= 20 and sum(c.units for c in plans) == 75 and plans[0].title == "Novel"


def test_placeholder_is_no_title(spark):
    df = units(spark, *[(t, "ACT", ["Contents", "PLAY", t], 2500) for t in ("ACT I", "ACT II")])
    assert [c.title for c in chapters_of(df, Limits(3000, 3000, 6000, 8000, 1))] == ["PLAY"]


def test_large_groups_are_split_when_full(spark):
    df = units(spark, *[(f"SCENE {n}", "SCENE", ["ACT I", f"SCENE {n}"], 14000) for n in range(1, 8)])
    groups = plan_groups(df).orderBy("unit_no").collect()
    assert [r.group_no for r in groups] == [1, 1, 1, 2, 2, 2, 3]
    assert {r.reason for r in groups} == {"GROUP_SMALL_UNITS"}


def test_only_excluded_units_keep_the_book(spark):
    df = units(spark, ("Contents", "CONTENTS", ["Contents"], 10), ("Index", "INDEX", ["Index"], 10))
    assert corpus.kept_units(df).count() == 2


def test_catalog_filters(spark):
    df = spark.createDataFrame(
        [(1, "Moby Dick", "Melville", "en", "READY"), (2, "Emma", "Austen", "EN", "READY"), (3, "Emma", "X", "ko", "FAILED")],
        "book_id long, title string, author string, language string, normalization_status string",
    )
    assert [r.book_id for r in catalog.matching(catalog.ready(df), "AUST").collect()] == [2]
    assert catalog.in_language(df, "En").count() == 2
    assert catalog.matching(df, "  ").count() == 3


def test_scopes_of_unknown_events_are_empty(spark):
    ev = events(spark, (10, 1, 1, 0, 50), (11, 1, 2, 50, 90), (12, 2, 1, 0, 10))
    story, reading = graph.story_order(ev), graph.reading_order(ev)
    scopes = spark.createDataFrame(
        [(1, 1, "book", None, None, None), (2, 1, "chapter", 1, None, None), (3, 1, "event", None, "ch1-e2", None),
         (4, 1, "event", None, "ch1-e9", None), (5, 1, "locator", 1, None, 49), (6, 1, "locator", 2, None, 0), (7, 9, "book", None, None, None)],
        "scope_id long, book_id long, scope string, chapter_idx int, event_ref string, at int",
    )
    got = {r.scope_id: r.upto for r in graph.scope_ordinals(scopes, story, reading).collect()}
    assert got == {1: 3, 2: 2, 3: 2, 4: 0, 5: 1, 6: 3, 7: 0}


def test_whole_graph_at_every_prefix(spark):
    ev = events(spark, (10, 1, 1, 60, 90), (11, 1, 2, 0, 50), (12, 2, 1, 0, 40))
    edges = spark.createDataFrame(
        [
            (1, 10, 1, 1, 2, "first", '["trust","kin"]', 1, 1.0),
            (2, 11, 1, 2, 1, "second", '["conflict"]', 3, -0.5),
            (3, 12, 1, 2, 1, None, '["kin","rival","kin"]', 2, None),
            (4, 12, 1, 1, 3, "other", "oops", None, 0.5),
        ],
        EDGE,
    )
    stats = spark.createDataFrame([(1, 10, 1, 7, 0.5), (2, 12, 1, 7, 0.25)], STAT)
    cast = spark.createDataFrame(
        [(n, 1, f"N{n}", True, None, None, None, "") for n in (1, 2, 3, 7)],
        "character_id long, book_id long, name string, is_main boolean, profile_image string, personality_text string, profile_text string, names string",
    )
    scopes = spark.createDataFrame(
        [(1, 1, "book", None, None, None), (2, 1, "event", None, "ch1-e1", None), (3, 1, "locator", 1, None, 10), (4, 1, "chapter", 1, None, None), (5, 1, "locator", 0, None, 5)],
        "scope_id long, book_id long, scope string, chapter_idx int, event_ref string, at int",
    )
    resolved = graph.scope_ordinals(scopes, graph.story_order(ev), graph.reading_order(ev))
    made = scoped.graph_at(resolved, ev, edges, stats, cast)
    prefix = ["book_id", "along", "upto"]
    found = {(r.scope_id, r.left_id, r.right_id): r for r in resolved.join(made["edges"], prefix).collect()}
    assert set(found) == {(1, 1, 2), (1, 1, 3), (2, 1, 2), (3, 1, 2), (4, 1, 2)}
    whole = found[1, 1, 2]
    assert (whole.evidence_count, round(whole.positivity, 6)) == (6, -0.083333)
    assert (whole.labels, whole.label_scores) == (["kin", "conflict", "rival"], {"conflict": 3, "kin": 5, "rival": 2, "trust": 1})
    assert (whole.direction_counts, whole.latest_labels, whole.latest_reason) == ({"1->2": 1, "2->1": 5}, ["kin", "rival", "kin"], None)
    assert (found[1, 1, 3].labels, found[1, 1, 3].label_scores, found[1, 1, 3].direction_counts) == ([], {}, {"1->3": 0})
    # The first event by index begins later in the text than the second.
    assert (found[2, 1, 2].labels, found[2, 1, 2].latest_event_id) == (["kin", "trust"], "ch1-e1")
    assert (found[3, 1, 2].labels, found[3, 1, 2].direction_counts) == (["conflict"], {"2->1": 3})
    assert (found[4, 1, 2].label_scores, found[4, 1, 2].latest_event_id) == ({"conflict": 3, "kin": 1, "trust": 1}, "ch1-e2")
    nodes = {(r.scope_id, r.character_id): (r.label, r.weight, r["count"]) for r in resolved.join(made["nodes"], prefix).collect()}
    assert nodes[1, 7] == ("N7", 0.75, 2) and nodes[4, 7] == ("N7", 0.5, 1) and nodes[1, 3] == ("N3", None, None)
    assert {c for s, c in nodes if s == 3} == {1, 2} and not any(s == 5 for s, _ in nodes)
