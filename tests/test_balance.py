"""The skew-safe plans against plain windows and brute force, with tiny slices."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plotweave.operators import corpus, graph, images, ingest, planner, positions, quality, scoped, state
from plotweave.plans.intervals import stab, stab_blocks, stab_min, with_blocks
from plotweave.plans.nest import nested
from plotweave.plans.pick import earliest, latest, top_per_key
from plotweave.plans.scan import as_of, prefix_scan, slice_of
from plotweave.registry import spark_queries, sql_queries, uploads
from plotweave.registry.graphs import both_orders, resolved_scopes
from plotweave.sources import archive, payloads
from plotweave.views import Views
from tools.check import compare


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows share one key."""
    rnd = random.Random(7)
    places = {}
    rows = []
    for n in range(600):
        key = 0 if n % 2 else rnd.randint(1, 9)
        places[key] = places.get(key, 0) + rnd.randint(1, 3)
        rows.append((key, places[key], rnd.randint(-50, 50)))
    return spark.createDataFrame(rows, "k int, at int, x int").cache()


@pytest.mark.parametrize("kind", ["sum", "count", "min", "max"])
@pytest.mark.parametrize("inclusive", [True, False])
def test_prefix_scan_equals_a_window(skewed, kind, inclusive):
    whole = Window.partitionBy("k").orderBy("at").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    plain = skewed.withColumn("y", getattr(F, kind)("x").over(whole))
    if kind == "count" and not inclusive:
        plain = plain.withColumn("y", F.nullif("y", F.lit(0)))
    sliced = prefix_scan(skewed.withColumn("s", slice_of(F.col("at"), 16)), ["k"], ["s"], ["at"], {"y": (kind, F.col("x"))}, inclusive)
    got = sliced.drop("s")
    if kind == "count" and not inclusive:
        got = got.withColumn("y", F.nullif("y", F.lit(0)))
    assert sorted(got.collect(), key=str) == sorted(plain.collect(), key=str)


def test_following_crosses_slices(skewed):
    plain = skewed.withColumn("n", F.lead("at").over(Window.partitionBy("k").orderBy("at"))).drop("x")
    sliced = prefix_scan(
        skewed.withColumn("s", slice_of(F.col("at"), 16)), ["k"], ["s"], ["at"], {"y": ("sum", F.col("x"))}, following={"n": "at"}
    ).select("k", "at", "n")
    assert sorted(sliced.collect(), key=str) == sorted(plain.collect(), key=str)


@pytest.mark.parametrize("reverse", [False, True])
def test_as_of(spark, skewed, reverse):
    rnd = random.Random(3)
    asks = [(rnd.randint(0, 10), rnd.randint(0, 700)) for _ in range(200)]
    points = spark.createDataFrame(asks, "k int, at int")
    marks = skewed.select("k", "at", F.col("at").alias("v"))
    got = {(r.k, r["at"]): r.v for r in as_of(points, marks, ["k"], "at", "v", reverse, width=8).collect()}
    rows = [(r.k, r["at"]) for r in skewed.collect()]
    for k, at in asks:
        side = [a for key, a in rows if key == k and (a > at if reverse else a <= at)]
        assert got[(k, at)] == ((min(side) if reverse else max(side)) if side else None)


def test_stab_equals_brute_force(spark):
    rnd = random.Random(5)
    spans = [(n, n % 3, s, s + rnd.choice([0, 1, 2, 7, 64, 500, 10**9])) for n in range(120) for s in [rnd.randint(0, 300)]]
    asks = sorted({(rnd.randint(0, 2), rnd.randint(0, 400)) for _ in range(150)})
    left = spark.createDataFrame(asks, "k int, at int")
    unbound = [(900, 0, None, 5), (901, 0, 1, None), (902, 0, None, None), (903, 0, 9, 3)]
    right = spark.createDataFrame(spans + unbound, "n int, k int, start long, end long")
    want = sorted((k, at, n) for k, at in asks for n, key, s, e in spans if key == k and s <= at < e)
    got = sorted((r.k, r["at"], r.n) for r in stab(left, right, ["k"], "at").collect())
    assert got == want
    low = {}
    for k, at, n in want:
        low[(k, at)] = min(n, low.get((k, at), n))
    assert {(r.k, r["at"]): r.n for r in stab_min(left, right, ["k"], "at", "n").collect()} == low


@pytest.mark.parametrize("power", [0, 1, 29, 31, 40])
def test_stab_at_powers_of_two(spark, power):
    size = 2**power
    left = spark.createDataFrame([(0, at) for at in sorted({0, size - 1, size})], "k int, at long")
    right = spark.createDataFrame([(0, 1, 0, size), (0, 2, size, size * 2), (0, 3, 0, 2**62)], "k int, n int, start long, end long")
    got = sorted((r["at"], r.n) for r in stab(left, right, ["k"], "at").collect())
    want = sorted((at, n) for at in {0, size - 1, size} for n, s, e in [(1, 0, size), (2, size, size * 2), (3, 0, 2**62)] if s <= at < e)
    assert got == want


@pytest.mark.parametrize("bits", [0, 2, 8, 20])
def test_blocks_find_what_stab_finds(spark, bits):
    rnd = random.Random(bits)
    spans = [(n, n % 3, s, s + rnd.choice([0, 1, 2, 7, 64, 500, 2**40])) for n in range(150) for s in [rnd.randint(-20, 1100)]]
    asks = sorted({(rnd.randint(0, 2), rnd.choice([0, 1, 3, 4, 255, 256, 1023, 1024, rnd.randint(-5, 1100)])) for _ in range(120)})
    left = spark.createDataFrame(asks, "k int, at int")
    right = spark.createDataFrame([*spans, (900, 0, None, 5), (901, 0, 1, None), (902, 0, 9, 3)], "n int, k int, start long, end long")
    found = stab_blocks(left, right, ["k"], "at", bits=bits)
    assert found.columns == stab(left, right, ["k"], "at").columns
    got = sorted((r.k, r["at"], r.n, r.start, r.end) for r in found.collect())
    assert got == sorted((k, at, n, s, e) for k, at in asks if at >= 0 for n, key, s, e in spans if key == k and s <= at < e)


def test_short_keys_move_each_interval_once(spark):
    """A state that held from one event to another of a short book was cut into up to a dozen rows."""
    states = spark.createDataFrame([(0, n, 2**40 if n % 2 else n + 60) for n in range(1, 129)], "k int, start long, end long")
    assert with_blocks(states, "start", "end", F.lit(128).cast("long"), 8).count() == 128
    # In a long book: the blocks at its ends and a few tiles.
    assert with_blocks(states, "start", "end", F.lit(2**20).cast("long"), 8).count() < 64 + 64 * 16


def test_picks(skewed):
    rows = skewed.collect()
    last = {r.k: r["at"] for r in latest(skewed, ["k"], ["at"]).collect()}
    first = {r.k: r["at"] for r in earliest(skewed, ["k"], ["at"]).collect()}
    for k in {r.k for r in rows}:
        mine = [r["at"] for r in rows if r.k == k]
        assert (first[k], last[k]) == (min(mine), max(mine))


def test_top_per_key(skewed):
    limited = skewed.withColumn("m", F.col("k") % 3 + 2)
    got = {}
    for r in top_per_key(limited, ["k"], [F.desc("x"), F.asc("at")], "m", "at", ways=5).collect():
        got.setdefault(r.k, []).append((r["rank"], r.x, r["at"]))
    for k, picked in got.items():
        mine = sorted(((-r.x, r["at"]) for r in skewed.collect() if r.k == k))[: k % 3 + 2]
        assert [(-x, at) for _, x, at in sorted(picked)] == mine


def test_nested_parts_lose_nothing(skewed):
    parts = nested(skewed, ["k"], "at", F.col("x"), "xs", width=10).collect()
    assert all(len(r.xs) <= 10 for r in parts)
    got = {}
    for r in sorted(parts, key=lambda r: (r.k, r.part)):
        got.setdefault(r.k, []).extend(r.xs)
    for k, xs in got.items():
        assert xs == [r.x for r in sorted(skewed.collect(), key=lambda r: r["at"]) if r.k == k]


def test_long_chapters_and_books_are_one_row(spark):
    from types import SimpleNamespace

    from plotweave import registry
    from plotweave.registry.base import ENTRIES

    registry.spark_queries()
    n = 6000
    event = spark.range(n, numPartitions=3).selectExpr(
        "id", "1L AS book_id", "5L AS chapter_id", "1 AS chapter_idx", "int(id + 1) AS idx", "concat('e', id + 1) AS event_id",
        "int(id) AS start_txt", "int(id + 1) AS end_txt", "0 AS start_block", "0 AS start_offset", "0 AS end_block", "1 AS end_offset", "'ab' AS raw_text",
    )
    book = spark.sql("SELECT 1L AS book_id, 't' AS title, 'READY' AS normalization_status, 'READY' AS analysis_status, 'p' AS artifact_path, 'r' AS rule_version, 'l' AS locator_version")
    chapter = spark.range(n).selectExpr("1L AS book_id", "id + 5 AS chapter_id", "int(id + 1) AS idx", "concat('c', id) AS title")
    v = SimpleNamespace(event=event, book=book, chapter=chapter)
    (row,) = ENTRIES["ag_10_events_per_chapter"].build(v).collect()
    assert row.events == n and row.listed == "|".join(f"e{i + 1}@{i}" for i in range(n))
    rows = {r.chapter_id: r for r in ENTRIES["prj_6_manifest_chapters"].build(v).collect()}
    assert len(rows) == n and rows[5].events == n and rows[5].shown == 2 * n
    assert rows[5].event_ids == "|".join(f"e{i + 1}" for i in range(n))
    assert (rows[6].events, rows[6].event_ids, rows[6].shown) == (0, None, None)
    (row,) = ENTRIES["snk_5_analysis_input"].build(v).collect()
    assert row.chapters == n and len(row.paths.split("|")) == n and row.paths.split("|")[0].endswith("chapter_001.txt")


def test_document_order_of_long_books(spark):
    from plotweave.operators.corpus import document_order

    docs = spark.createDataFrame([(1, "late", 1_000_001, True)], "book_id long, doc_href string, doc_order int, in_spine boolean")
    leaves = spark.createDataFrame([(1, "named", 0)], "book_id long, doc_href string, leaf_no int")
    assert [r.doc_href for r in document_order(docs, leaves).orderBy("doc_order").collect()] == ["late", "named"]


def brute_accept(rows, existing=()):
    held, kept = list(existing), []
    for id_, user, book, start, end in rows:
        def meets(o):
            if (o[1], o[2]) != (user, book):
                return False
            if (o[3], o[4]) == (start, end):
                return True
            return end is not None and o[4] is not None and o[3] < end and o[4] > start

        if not any(meets(o) for o in held):
            held.append((id_, user, book, start, end))
            kept.append(id_)
    return kept


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bookmarks_arrive_in_order(spark, seed):
    rnd = random.Random(seed)

    def some(first, count):
        rows = []
        for n in range(first, first + count):
            start = rnd.randint(0, 300) * (17 if rnd.random() < 0.3 else 1)
            end = None if rnd.random() < 0.3 else start + rnd.choice([1, 3, 20, 200])
            rows.append((n, rnd.choice([1, 1, 1, 2]), rnd.randint(1, 2), start, end))
        return rows

    schema = "id long, user_id long, book_id long, start_txt int, end_txt int"
    old = [r for r in some(1, 60)]
    old = [r for r in old if r[0] in set(brute_accept(old))]
    new = some(1000, 250)
    got = state.accept_bookmarks(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema)).collect()
    assert sorted(r.id for r in got) == brute_accept(new, old)
    alone = state.accept_bookmarks(spark.createDataFrame(new, schema)).collect()
    assert sorted(r.id for r in alone) == brute_accept(new)
    hit = {r.id for r in state.conflicts(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema)).collect()}
    assert hit == {r[0] for r in new if not brute_accept([r], old)}


def test_book_status_replay(spark):
    rnd = random.Random(11)
    books, changes = [], []
    for b in range(60):
        ready = rnd.random() < 0.4
        books.append((b, "READY" if ready else "NONE", "r0" if ready and rnd.random() < 0.7 else None, "p0" if ready else None, None, None))
        for s in range(rnd.randint(0, 6)):
            changes.append((b, s, rnd.choice(["QUEUED", "PROCESSING", "FAILED", "READY"]), rnd.choice([None, " ", f"r{s}"]), rnd.choice(["", f"p{s}"]), "a", "b"))
    want = {}
    for b, st, run, path, _, _ in books:
        for _, _, new, r, p, _, _ in sorted((c for c in changes if c[0] == b), key=lambda c: c[1]):
            active = st == "READY" and bool((run or "").strip()) and bool((path or "").strip())
            if new == "READY":
                st, run, path = "READY", r, p
            elif not active:
                st = new
        want[b] = (st, run)
    df = spark.createDataFrame(books, "book_id long, normalization_status string, run_id string, artifact_path string, rule_version string, locator_version string")
    ch = spark.createDataFrame(changes, "book_id long, seq int, status string, run_id string, artifact_path string, rule_version string, locator_version string")
    got = {r.book_id: (r.normalization_status, r.run_id) for r in state.replay_normalization(df, ch).collect()}
    assert got == want


def test_asset_replay(spark):
    rnd = random.Random(13)
    publishable = {"QA_PASSED", "APPROVED", "PUBLISHED"}
    assets = [(i, rnd.choice(["QA_PENDING", "QA_PASSED", "PUBLISHED"]), rnd.choice([None, " ", f"u{i}"]), None) for i in range(60)]
    actions = [(i, s, rnd.choice([*images.ACTION_STATUS, "publish", "publish"]), rnd.choice([None, f"n{s}"]), f"F{s}") for i in range(60) for s in range(rnd.randint(0, 6))]
    want = {}
    for i, st, url, code in assets:
        for _, _, act, u, c in sorted((a for a in actions if a[0] == i), key=lambda a: a[1]):
            if act == "publish":
                if st in publishable and (url or "").strip():
                    st = "PUBLISHED"
                continue
            st = images.ACTION_STATUS[act]
            if act == "generated":
                url = u
            if act in ("qa_fail", "fail"):
                code = c
            if act == "qa_pass":
                code = None
        want[i] = (st, url, code)
    got = images.replay_assets(
        spark.createDataFrame(assets, "id long, status string, url string, failure_code string"),
        spark.createDataFrame(actions, "id long, seq int, action string, url string, failure_code string"),
    )
    assert {r.id: (r.status, r.url, r.failure_code) for r in got.collect()} == want


def test_partition_count_does_not_matter(spark, folder):
    from plotweave.registry import spark_queries

    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for parts in ("1", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            seen.append([sorted(map(tuple, spark_queries()[n](spark, folder).collect()), key=str) for n in ("wn_14_running_edges", "fine_event_at_position")])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_prefixes_from_blocks(spark):
    import random

    from plotweave.plans import dyadic

    rng = random.Random(11)
    rows = [(rng.choice([1, 1, 2]), rng.randint(0, 70), rng.randint(1, 9)) for _ in range(300)] + [(3, 0, 5)]
    points = [(b, n) for b in (1, 2, 3, 4) for n in (0, 1, 2, 31, 32, 33, 63, 64, 65, 71, 200, 2**40)]
    given = spark.createDataFrame(rows, "book long, at int, x long")
    asked = spark.createDataFrame(points + points, "book long, before long")
    last = dyadic.last_position(given, "at")
    stored = dyadic.blocks(given, ["book"], "at", {"total": F.sum("x"), "most": F.max("x")}, last)
    made = dyadic.prefix_aggregate(asked, stored, ["book"], "before", {"total": F.sum("total"), "most": F.max("most")}, last).collect()
    want = {}
    for b, n in points:
        inside = [x for k, a, x in rows if k == b and a < n]
        if inside:
            want[b, n] = (sum(inside), max(inside))
    assert {(r.book, r.before): (r.total, r.most) for r in made} == want and len(made) == len(want)
    # 71 has four binary digits that are 1.
    assert dyadic.cover(asked.filter("before = 71"), "before", last).select("level", "tile").distinct().count() == 4


def test_approvals_in_one_batch(spark):
    seeds = [(n, 1, 100 + n, "REFERENCE_SEED", "QA_PASSED", f"u{n}", None) for n in (1, 2, 3)]
    derived = [(10 + n, 1, 200 + n, "DERIVED_CHARACTER", "PUBLISHED", "d", n) for n in (1, 2, 3)]
    assets = spark.createDataFrame(seeds + derived, "id long, book_id long, char_id long, role string, status string, url string, source_asset_id long")
    held = spark.createDataFrame([(1, 1, "APPROVED", 5, 101)], "book_id long, active_asset_id long, reference_status string, reference_version int, reference_char_id long")

    def approve(*ids):
        asked = spark.createDataFrame([(1, n, i) for n, i in enumerate(ids)], "book_id long, seq int, asset_id long")
        done = images.approve_references(assets, held, asked)
        profile = [tuple(r) for r in done["profiles"].select("active_asset_id", "reference_char_id", "reference_version").collect()]
        verdicts = [r.verdict for r in sorted(done["verdicts"].collect(), key=lambda r: r.seq)]
        return profile, verdicts, {r.id: r.status for r in done["assets"].collect()}

    profile, verdicts, status = approve(1, 2, 2, 3, 1, 2)
    assert profile == [(3, 103, 7)] and verdicts == ["again", "approved", "again", "approved", "status", "status"]
    assert status == {1: "SUPERSEDED", 2: "SUPERSEDED", 3: "PUBLISHED", 11: "STALE_REFERENCE", 12: "STALE_REFERENCE", 13: "PUBLISHED"}
    assert approve(1, 1)[:2] == ([(1, 101, 5)], ["again", "again"])
    assert approve(9, 11)[:2] == ([(1, 101, 5)], ["not in book", "role"])


def test_approving_again_keeps_the_version(spark):
    held = spark.createDataFrame([(1, 4, "APPROVED", 2, 9), (2, 4, "QA_PASSED", 2, 9)], "book_id long, active_asset_id long, reference_status string, reference_version int, reference_char_id long")
    steps = ["approve:4", "approve:4", "approve:5", "reject:5", "approve:5", "approve:5"]
    rows = [(b, n, s.split(":")[0], int(s.split(":")[1]), 9) for b in (1, 2, 3) for n, s in enumerate(steps)]
    actions = spark.createDataFrame(rows, "book_id long, seq long, action string, asset_id long, char_id long")
    found = {r.book_id: (r.reference_version, r.active_asset_id, r.reference_status) for r in images.replay_profiles(held, actions).collect()}
    assert found == {1: (4, 5, "APPROVED"), 2: (5, 5, "APPROVED"), 3: (3, 5, "APPROVED")}


def test_repeated_keys_are_marked_where_they_lie(spark):
    rows = [(1, 1, "a"), (1, 1, "a"), (1, 2, "a"), (2, None, "a"), (2, None, "a"), (3, 1, None), (3, 1, None)]
    df = spark.createDataFrame(rows, "near long, key int, text string")
    marked = quality.flag_repeated(df, ["near"], ["key"], "twice").collect()
    assert sorted((r.near, r.key or 0, r.twice) for r in marked) == [
        (1, 1, True), (1, 1, True), (1, 2, False), (2, 0, False), (2, 0, False), (3, 1, True), (3, 1, True)
    ]


def test_uploads_are_written_as_json_once(spark):
    """A filter on the text of a file moves below its parsing and takes the writing along."""
    files = spark.range(3).select(
        F.col("id").alias("upload_id"), F.lit(1).alias("book_id"),
        F.when(F.col("id") == 2, "").otherwise(F.to_json(F.struct(F.col("id").cast("string").alias("eventId")))).alias("json"),
    )
    parsed = payloads.parse_deltas(files)
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("structstojson") == 1
    assert sorted(r.event_ref for r in parsed.collect()) == ["0", "1"]


def test_lines_of_an_event_move_once_for_its_record(spark, folder):
    """Items and weights are gathered where the lines of an event lie: a move of lines each, one of events."""
    records = uploads.delta_uploads(Views(spark, folder))
    plan = records._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 2
    final = records._jdf.queryExecution().executedPlan().toString()
    assert final.count("Exchange hashpartitioning(event_id") + final.count("Exchange hashpartitioning(l_orderkey") <= 2


def test_books_are_planned_across_batches():
    """A book that lies in several batches is one book; several books in one batch are several."""
    books = [1, 1, 2, 3, 3, 3, 3, 3, 4]
    frame = pd.DataFrame({"book_id": books, "unit_no": [1, 2, 1, 1, 2, 3, 4, 5, 1]})
    for width in (1, 2, 3, 4, 9):
        batches = [frame.iloc[i : i + width] for i in range(0, len(frame), width)]
        parts = list(planner._whole_books(iter(batches)))
        assert pd.concat(parts, ignore_index=True).equals(frame)
        where = [set(p["book_id"]) for p in parts]
        assert sum(map(len, where)) == len(set(books))


def test_pages_leave_in_portions(spark, monkeypatch):
    """Blocks of a batch of pages are not held together."""
    pages = spark.createDataFrame([(n, f"<body><p>one {n}</p><p>two</p></body>") for n in range(50)], "page_id long, html string").coalesce(1)
    assert archive.page_blocks(pages).count() == 100
    assert "MapInArrow" in archive.page_blocks(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert archive.HELD_CHARS <= 1 << 22


def test_unit_sizes_move_no_text(spark):
    blocks = spark.createDataFrame([(1, "a", 0, "p", "four"), (1, "a", 1, "p", "xy")], "book_id long, doc_href string, block_idx int, tag string, text string")
    units = spark.createDataFrame(
        [(1, "a", 1, 0, 2, "Chapter 1", ["Chapter 1"])],
        "book_id long, doc_href string, unit_no int, start int, end int, title string, path array<string>",
    )
    sized = corpus.size_and_classify(units, corpus.unit_blocks(units, blocks))
    assert [(r.size, r.blocks) for r in sized.collect()] == [(6, 2)]
    plan = sized._jdf.queryExecution().optimizedPlan().toString()
    joins = plan[plan.index("explode(sequence") - 400 :]
    assert "length(text" in joins


def test_event_items_move_without_their_texts(spark):
    """The text of an item moves to be compared and to its place, not through every lookup."""
    uploads_ = spark.createDataFrame(
        [(1, 1, "a", '{"chapterIndex": 1, "items": [{"eventId": "ch1-e1", "start": 0, "end": 4, "text": "abcd"}]}'),
         (2, 1, "b", '{"chapterIndex": 1, "items": [{"eventId": "ch1-e2", "start": 0, "end": 4, "text": "abc"}]}'),
         (3, 1, None, '{"chapterIndex": 1, "items": [{"eventId": "ch1-e3", "start": 4, "end": 8, "text": "efgx"}]}')],
        "upload_id long, book_id long, file string, json string",
    )
    chapters = spark.createDataFrame([(9, 1, 1, [0], [8], 8)], "chapter_id long, book_id long, idx int, starts array<int>, lengths array<int>, total_code_points int")
    texts = spark.createDataFrame([(1, 1, "abcdefgh")], "book_id long, idx int, text string")
    none = spark.createDataFrame([], "chapter_id long")
    done = ingest.events(uploads_, chapters, texts, none)
    assert sorted((r.upload_id, r.reason) for r in done["rejects"].collect()) == [(2, "DQ-9 text"), (3, "DQ-9 text")]
    assert [(r.event_id, r.start_block, r.end_offset, r.raw_text) for r in done["events"].collect()] == [("ch1-e1", 0, 4, "abcd")]
    kept = done["rejected_uploads"]._jdf.queryExecution().optimizedPlan().toString()
    assert "raw_text" not in kept and "chapter_length" not in kept


def test_delta_files_move_twice_as_one_row_of_keys(spark, monkeypatch):
    """A file moves to its event and to its book; no item or weight moves to its characters by itself."""
    plans = []
    written = ingest.cut
    monkeypatch.setattr(ingest, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files = spark.createDataFrame([(1, 1, "a", "{}")], "upload_id long, book_id long, file string, json string")
        events = spark.createDataFrame([(11, 1, 1, 1)], "id long, book_id long, chapter_idx int, idx int")
        cast = spark.createDataFrame([(101, 1, 1)], "id long, book_id long, character_id long")
        ingest.deltas(files, events, cast)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moves = [line for line in plans[1].splitlines() if "Exchange hashpartitioning" in line]
    # Of the files to both, of the events and of the cast.
    assert len(moves) == 4
    assert not any(f"{end}_id" in m.split("hashpartitioning")[1].split(")")[0] for m in moves for end in ("from", "to", "character"))


def test_delta_tasks_are_bounded_by_rows(spark, folder, monkeypatch):
    """Adaptive execution would join small parts by their bytes, whatever they hold in rows."""
    monkeypatch.setattr(uploads, "LINES", 500)
    files = uploads.delta_uploads(Views(spark, folder))
    rows = sum(Views(spark, folder).table(name).count() for name in ("lineitem", "orders"))
    plan = files._jdf.queryExecution().sparkPlan().toString()
    assert plan.count(f"{-(-rows // 500)}), REPARTITION_BY_NUM") == 2

    plans = []
    written = ingest.cut
    monkeypatch.setattr(ingest, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df))
    monkeypatch.setattr(ingest, "ENTRIES", 2)
    weights = '{"nodeWeights": {"1": {"weight": 1}, "2": {"weight": 2}}}'
    given = spark.createDataFrame([(n, 1, "a", weights) for n in range(4)], "upload_id long, book_id long, file string, json string")
    events = spark.createDataFrame([(11, 1, 1, 1)], "id long, book_id long, chapter_idx int, idx int")
    cast = spark.createDataFrame([(101, 1, 1)], "id long, book_id long, character_id long")
    done = ingest.deltas(given, events, cast)
    # Four files of two weights are twelve entries, two to a task; files are not sorted to meet their book's cast.
    assert ", 6), REPARTITION_BY_NUM" in plans[1] and "ShuffledHashJoin [book_id" in plans[1]
    assert done["rejected_uploads"].count() == 4


def exchanges(df):
    """The plan's lines, each with whether the line below it moves rows."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [(a, "Exchange" in b) for a, b in zip(lines, lines[1:])]


@pytest.mark.parametrize("name", ["scoped_graph_edges", "scoped_graph_nodes"])
def test_lines_of_a_graph_are_gathered_where_they_lie(spark, folder, name):
    """A state moves to its block of prefixes; the lines of a prefix do not move to their digest."""
    made = spark_queries()[name](spark, folder)
    gathered = [moved for line, moved in exchanges(made) if re.search(r"[\[ ]collect_list\(", line.split("functions=")[-1]) and "Aggregate" in line]
    assert gathered and not any(gathered)


@pytest.mark.parametrize("name", ["scoped_graph_edges", "scoped_graph_nodes", "scoped_relationship_graph"])
def test_long_books_carry_their_graph_along(spark, duck, folder, monkeypatch, name):
    """With slices of eight events and blocks of four prefixes a book of 128 events is a long one."""
    monkeypatch.setattr(slice_of, "__defaults__", (8,))
    monkeypatch.setattr(scoped, "SLICE_WIDTH", 8)
    monkeypatch.setattr(scoped, "BLOCK_BITS", 2)
    problem, _ = compare(duck, spark_queries()[name](spark, folder), sql_queries()[name])
    assert not problem


def test_lines_move_once_to_their_event(spark, folder):
    """Edges and stats lie where their event's place comes: a move of the lines, one of the events."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        v = Views(spark, folder)
        for rows in (v.edge, v.stat):
            assert sum(moved for _, moved in exchanges(graph.edge_facts(rows, v.event))) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_facts_move_once_for_both_orders(spark, folder, monkeypatch):
    """A fact whose slice is the same along the story and along the reading is one row of the move."""
    dealt, moved = [], scoped.in_portions
    monkeypatch.setattr(scoped, "in_portions", lambda df, *rest: dealt.append(df.count()) or moved(df, *rest))
    facts = scoped.pair_facts(Views(spark, folder).edge, both_orders(Views(spark, folder)))
    assert scoped.pair_log(facts).count() > facts.count() == dealt[0]


def test_characters_of_a_position_are_put_together_in_its_row(spark, folder):
    """No row per position and character moves; what a begun event names adds to what earlier chapters name."""
    made = spark_queries()["jn_16_prefix_nodes"](spark, folder)
    moves = [m for m in made._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in m]
    assert moves and not any(" at#" in m and "character_id#" in m for m in moves)

    events = spark.createDataFrame(
        [(11, 1, 1, 1, "ch1-e1", 0, 9), (21, 1, 2, 1, "ch2-e1", 0, 9), (22, 1, 2, 2, "ch2-e2", 10, 19), (22, 1, 2, 2, "ch2-e2", 10, 19)],
        "id long, book_id long, chapter_idx int, idx int, event_id string, start_txt int, end_txt int",
    )
    stats = spark.createDataFrame(
        [(1, 11, 1, 5, 0.5), (2, 11, 1, 6, 0.25), (3, 22, 1, 5, 2.0), (4, 22, 1, 7, 1.0), (5, 21, 1, None, 4.0)],
        "id long, event_id long, book_id long, character_id long, node_weight double",
    )
    edges = spark.createDataFrame([(9, 11, 1, 8, 6)], "id long, event_id long, book_id long, from_id long, to_id long")
    positions_ = spark.createDataFrame([(1, 1, 3), (1, 2, 5), (1, 2, 12), (1, 3, 0), (2, 1, 0)], "book_id long, chapter_idx int, at int")
    got = {}
    for r in positions.prefix_nodes(positions_, events, stats, edges).collect():
        got.setdefault((r.chapter_idx, r["at"]), {})[r.character_id] = (r.weight, r["count"])
    first = {5: (0.5, 1), 6: (0.25, 1), 8: (None, None)}
    # An event that is there twice counts twice while it is the current one, once as the end of its chapter.
    assert got == {
        (1, 3): first,
        (2, 5): first | {None: (4.0, 1)},
        (2, 12): first | {5: (2.0, 3), 7: (1.0, 2)},
        (3, 0): first | {5: (2.0, 2), 7: (1.0, 1)},
    }


def test_touches_of_an_event_are_one_row_of_a_character(spark, folder, monkeypatch):
    """The stat and the edges of an event that name a character move as one row; tasks are bounded by rows."""
    v = Views(spark, folder)
    facts = scoped.touch_facts(v.stat, v.edge, both_orders(v))
    ends = v.edge.select("event_id", F.explode(F.array("from_id", "to_id")).alias("character_id"))
    assert facts.count() == v.stat.select("event_id", "character_id").union(ends).distinct().count()
    assert facts.agg(F.sum("weight"), F.sum("count")).first() == v.stat.agg(F.sum("node_weight"), F.count("*")).first()

    monkeypatch.setattr(scoped, "FACTS", 50)
    monkeypatch.setattr(scoped, "STATES", 200)
    asked = resolved_scopes(v)
    plan = scoped.at_prefixes(scoped.node_log(facts), asked, 2 * facts.count())._jdf.queryExecution().sparkPlan().toString()
    assert f"{-(-facts.count() // 50)}), REPARTITION_BY_NUM" in plan and f"{-(-2 * facts.count() // 100)}), REPARTITION_BY_NUM" in plan
