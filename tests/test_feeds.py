"""Streams in several batches, and ingest corner cases."""

import datetime
import json

from pyspark.sql import functions as F

from plotweave.operators import ingest, state
from plotweave.sources import artifacts, payloads, tables
from plotweave.streaming import feeds

START = datetime.datetime(2024, 1, 1)


def test_progress_across_batches(spark, tmp_path):
    schema = "event_id long, user_id long, book_id long, chapter_idx int, at long, ts timestamp"

    def put(name, rows):
        spark.createDataFrame([(e, u, b, c, t, START + datetime.timedelta(seconds=t)) for e, u, b, c, t in rows], schema).coalesce(1).write.mode(
            "append"
        ).parquet(str(tmp_path / "in"))

    def drain():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        feeds.progress_feed(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
        rows = feeds.current_progress(spark, str(tmp_path / "out")).collect()
        return {(r.user_id, r.book_id): r.chapter_idx for r in rows}

    put("a", [(1, 1, 1, 3, 100), (2, 2, 1, 1, 100)])
    assert drain() == {(1, 1): 3, (2, 1): 1}
    # A late position loses, a newer one wins, a repeated event changes nothing.
    put("b", [(3, 1, 1, 2, 50), (4, 2, 1, 5, 200), (1, 1, 1, 3, 100)])
    assert drain() == {(1, 1): 3, (2, 1): 5}
    current = feeds.current_progress(spark, str(tmp_path / "out"))
    feeds.compact(current, str(tmp_path / "small"))
    assert feeds.current_progress(spark, str(tmp_path / "small")).count() == 2


EVENT = "id long, book_id long, chapter_id long, chapter_idx int, idx int, event_id string, start_txt int, end_txt int"


def story(spark):
    ev = spark.createDataFrame([(10, 1, 1, 1, 1, "ch1-e1", 0, 9), (11, 1, 1, 1, 2, "ch1-e2", 9, 20)], EVENT)
    cast = spark.createDataFrame([(100 + n, 1, n) for n in (1, 2, 3)], "id long, book_id long, character_id long")
    return ev, cast


def delta(event, items, weights=None, **kw):
    body = {"contractVersion": "relationship-delta-v1", "chapterIndex": 1, "eventId": event, "items": items, "nodeWeights": weights}
    return json.dumps({**body, **kw})


def edge(a, b, positivity=0.5, count=1, **kw):
    return {"id1": a, "id2": b, "relation": ["x"], "positivity": positivity, "count": count, "reason": "r", **kw}


UPLOAD = "upload_id long, book_id long, file string, json string"


def test_delta_feed_replaces_events(spark, tmp_path):
    ev, cast = story(spark)

    def send(rows):
        spark.createDataFrame(rows, UPLOAD).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(UPLOAD).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        feeds.delta_feed(stream, ev, cast, str(tmp_path / "t"), str(tmp_path / "cp"))
        return {(r.left_id, r.right_id): r.evidence_count for r in feeds.current_graph(spark, str(tmp_path / "t")).collect()}

    assert send([(1, 1, "a", delta("ch1-e1", [edge("c1", "2", count=4)])), (2, 1, "b", delta("2", [edge("2", "1", count=3)]))]) == {(1, 2): 7}
    assert send([(3, 1, "a", delta("ch1-e1", [edge("1", "3", count=5)]))]) == {(1, 2): 3, (1, 3): 5}
    # Two uploads of one event in one batch: the later one counts. A bad upload changes nothing.
    again = [(4, 1, "a", delta("ch1-e1", [edge("1", "2")])), (5, 1, "a", delta("ch1-e1", [edge("2", "3")])), (6, 1, "b", delta("ch1-e2", [edge("1", "1")]))]
    assert send(again) == {(1, 2): 3, (2, 3): 1}


def test_delta_rejects_name_every_broken_rule(spark):
    ev, cast = story(spark)
    rows = [
        (1, delta("ch1-e1", [edge("1", "2", positivity=1.5)])),
        (2, delta("ch1-e1", [edge("1", "2", count=0)])),
        (3, delta("ch1-e1", [{**edge("1", "2"), "relation": ["a", " "]}])),
        (4, delta("ch1-e1", [edge("1", "2"), edge("1", "2")])),
        (5, delta("ch1-e1", [], {"9": {"weight": 1.0}})),
        (6, delta("ch2-e1", [edge("1", "2")])),
        (7, "[]"),
        (8, delta("ch1-e1", [edge("1", "2")], {"c01": {"weight": 2.5}, "2": {}})),
        (9, delta("ch1-e1", None)),
    ]
    done = ingest.deltas(spark.createDataFrame([(n, 1, str(n), j) for n, j in rows], UPLOAD), ev, cast)
    got = {}
    for r in done["rejects"].collect():
        got.setdefault(r.upload_id, set()).add(r.reason)
    assert got[1] == {"DQ-2 positivity"} and got[2] == {"DQ-3 evidence"} and got[3] == {"DQ-4 labels"}
    assert got[4] == {"DQ-6 edge twice"} and got[5] == {"DQ-15 character unknown"}
    assert got[6] == {"DQ-11 event id", "DQ-15 event unknown"}
    assert 7 in got and 8 not in got and 9 not in got
    assert {(r.character_id, r.node_weight) for r in done["stats"].collect()} == {(1, 2.5), (2, 0.0)}
    assert {r.event_id for r in done["replaced_events"].collect()} == {10}


def test_replacement_removes_all_prior_rows(spark):
    old = spark.createDataFrame([(10, "a"), (10, "b"), (11, "c")], "event_id long, x string")
    new = spark.createDataFrame([(10, "z")], "event_id long, x string")
    gone = spark.createDataFrame([(10,)], "event_id long")
    assert sorted(r.x for r in ingest.replace_by_event(old, new, gone).collect()) == ["c", "z"]


def test_event_upload_resolves_locators(spark):
    chapters = spark.createDataFrame([(5, 1, 1, [0, 3], [3, 4], 7)], "chapter_id long, book_id long, idx int, starts array<int>, lengths array<int>, total_code_points int")
    texts = spark.createDataFrame([(1, 1, "abc\rdef")], "book_id long, idx int, text string")
    none = spark.createDataFrame([], "chapter_id long")
    good = json.dumps({"chapterIndex": 1, "items": [{"event_id": "1", "start": 2, "end": 7, "text": "c\r\ndef"[0:1] + "\ndef"}]})
    bad = json.dumps({"chapterIndex": 1, "items": [{"eventId": "ch1-e1", "start": 0, "endTxtOffset": 3, "eventText": "abx"}]})
    empty = json.dumps({"chapterIndex": 1, "items": []})
    done = ingest.events(spark.createDataFrame([(1, 1, "a", good), (2, 1, "b", bad), (3, 1, "c", empty)], UPLOAD), chapters, texts, none)
    row = done["events"].first()
    assert (row.event_id, row.start_block, row.start_offset, row.end_block, row.end_offset) == ("ch1-e1", 0, 2, 1, 4)
    assert {(r.upload_id, r.reason) for r in done["rejects"].collect()} == {(2, "DQ-9 text")}


def test_payload_aliases(spark):
    body = json.dumps({"book_prompt": "p", "characters": [{"id": "c3", "common_name": "N", "mainCharacter": True, "description_ko": "d", "portrait_prompt": "q"}]})
    row = payloads.parse_roster(spark.createDataFrame([(1, 1, "f", body)], UPLOAD)).first()
    assert (row.book_prompt, row.character_raw, row.common_name, row.is_main, row.portrait_prompt) == ("p", "c3", "N", True, "q")


def test_payload_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n"chapterIndex": 1}')
    assert payloads.read_payloads(spark, str(tmp_path)).count() == 1


def test_projection_keeps_stale_chapters(spark):
    schema = "book_id long, idx int, page_start int, page_end int, title string, total_code_points int, start_pos int, end_pos int, raw_text string, summary_text string, summary_url string, summarized boolean"
    current = spark.createDataFrame([(1, 1, 3, 4, "a", 5, 0, 4, "t", "s", "u", True), (1, 2, 3, 4, "b", 5, 5, 9, "t", "s", "u", True), (2, 1, 3, 4, "c", 5, 0, 4, "t", "s", "u", True)], schema)
    fresh = spark.createDataFrame([(1, 1, "A", 9, 0, 8, "x" * 3000)], "book_id long, chapter_idx int, title string, total_code_points int, start_pos int, end_pos int, text string")
    rows = {(r.book_id, r.idx): r for r in state.project_chapters(current, fresh).collect()}
    assert (rows[1, 1].title, len(rows[1, 1].raw_text), rows[1, 1].summary_text, rows[1, 1].summarized) == ("A", 2000, None, False)
    assert rows[1, 2].stale and rows[1, 2].summary_text == "s" and not rows[2, 1].stale


def test_stored_tables_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 7), (2, 7)], "user_id long, book_id long")
    tables.write_table(rows, str(tmp_path), "favorite")
    assert tables.read_table(spark, str(tmp_path), "favorite").count() == 2
    counts = tables.table_counts({"favorite": rows}).first()
    assert (counts.row_count, counts.filled) == (2, True)


def test_metadata_files(spark, tmp_path):
    folder = tmp_path / "books" / "4" / "normalizations" / "r"
    (folder / "text").mkdir(parents=True)
    (folder / "meta.json").write_text(json.dumps({"chapters": [{"chapterIndex": 1, "paragraphStarts": [0], "paragraphLengths": [4], "totalCodePoints": 4}]}))
    (folder / "text" / "chapter_001.txt").write_text("text")
    meta = artifacts.chapters_from_meta(artifacts.read_metas(spark, str(folder / "meta.json"))).first()
    assert (meta.book_id, meta.idx, meta.starts, meta.lengths) == (4, 1, [0], [4])
    chapter = artifacts.read_chapter_texts(spark, str(folder / "text")).first()
    assert (chapter.book_id, chapter.idx, chapter.text) == (4, 1, "text")


def test_a_batch_touches_only_its_buckets(spark, tmp_path):
    from pathlib import Path

    from plotweave.streaming.versions import Versions

    table = Versions(spark, str(tmp_path / "t"), "book_id", buckets=8)
    want, sizes = {}, []
    for number in range(20):
        book, event = number * 7 % 11, number % 13
        edges = [(event * 100 + book, book, 1, 2, 1, 2, f"r{number}", '["x"]', number + 1, 0.5, 1, event, f"ch1-e{event}")]
        if number % 9 == 8:
            edges = []
        want[book, event] = number + 1 if edges else 0
        replaced = spark.createDataFrame([(event * 100 + book, book)], "event_id long, book_id long")
        feeds.apply_deltas(table, spark.createDataFrame(edges, feeds.EDGES), spark.createDataFrame([], feeds.STATS), replaced, number)
        folder = Path(tmp_path / "t" / "edges" / f"batch={number}")
        sizes.append(len(list(folder.glob("bucket=*"))))
        # A batch that is run again ends where it did.
        if number in (10, 19):
            feeds.apply_deltas(table, spark.createDataFrame(edges, feeds.EDGES), spark.createDataFrame([], feeds.STATS), replaced, number)
    assert max(sizes) == 1
    total = {}
    for (book, _), n in want.items():
        total[book] = total.get(book, 0) + n
    found = {r.book_id: r.evidence_count for r in feeds.current_graph(spark, str(tmp_path / "t")).collect()}
    assert found == {b: n for b, n in total.items() if n}
    kept = {f"{tmp_path}/t/edges/batch={n}/bucket={b}" for (t, b), n in table.newest().items() if t == "edges"}
    old = table.old_versions("edges")
    assert old and not kept & set(old)


CHAPTER = "chapter_id long, book_id long, idx int, starts array<int>, lengths array<int>, total_code_points int"


def test_event_files_without_items_and_empty_files(spark):
    chapters = spark.createDataFrame([(5, 1, 1, [0], [5], 5), (6, 1, 2, None, None, None)], CHAPTER)
    texts = spark.createDataFrame([(1, 1, "abcde"), (1, 2, "fgh")], "book_id long, idx int, text string")
    filled = spark.createDataFrame([(6,)], "chapter_id long")
    none = json.dumps({"chapterIndex": 1, "items": []})
    bodies = [(1, ""), (1, none), (2, json.dumps({"chapterIndex": 2})), (3, json.dumps({"chapterIndex": 7, "items": None})), (4, json.dumps({"items": []})), (5, "{oops"), (6, " "), (7, None)]
    uploads = spark.createDataFrame([(n, 1, f"f{i}", j) for i, (n, j) in enumerate(bodies)], UPLOAD)
    done = ingest.events(uploads, chapters, texts, filled)
    got = {}
    for r in done["rejects"].collect():
        got.setdefault(r.upload_id, set()).add(r.reason)
    assert got[2] == {"DQ-12 has events"} and got[3] == {"DQ-15 chapter unknown"}
    assert "DQ-10 chapter" in got[4] and "DQ-0 malformed" in got[5] and 6 in got
    assert not {1, 7} & set(got) and done["events"].count() == 0
    # In strict mode a chapter without coordinates takes no events.
    item = {"eventId": "ch2-e1", "start": 0, "end": 3, "text": "fgh"}
    one = spark.createDataFrame([(1, 1, "f", json.dumps({"chapterIndex": 2, "items": [item]}))], UPLOAD)
    nothing = filled.limit(0)
    assert ingest.events(one, chapters, texts, nothing)["events"].count() == 1
    strict = ingest.events(one, chapters, texts, nothing, strict=True)
    assert [r.reason for r in strict["rejects"].collect()] == ["FLT-16 not ready"] and strict["events"].count() == 0


def test_event_texts_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(ingest, "CHUNK", 7)
    text = "".join(chr(97 + i * 7 % 26) for i in range(60)) + "é\r\n日本" + "x" * 20
    plain = text.replace("\r\n", "\n")
    chapters = spark.createDataFrame([(5, 1, 1, [0], [len(plain)], len(plain))], CHAPTER)
    texts = spark.createDataFrame([(1, 1, text)], "book_id long, idx int, text string")
    nothing = spark.createDataFrame([], "chapter_id long")
    spans = [(a, b) for a in (0, 3, 7, 50, 60) for b in (1, 7, 8, 14, 61, 62, len(plain)) if a < b]
    cases = [(a, b, plain[a:b], True) for a, b in spans]
    cases += [(a, b, plain[a:b] + "!", False) for a, b in spans] + [(a, b, plain[a : b - 1], False) for a, b in spans if b - a > 1]
    cases += [(a, b, plain[a:b][:-1] + "?", False) for a, b in spans] + [(0, len(plain) + 1, plain + "x", False)]
    rows = []
    for n, (a, b, t, _) in enumerate(cases):
        body = {"chapterIndex": 1, "items": [{"eventId": "ch1-e1", "start": a, "end": b, "text": t}]}
        rows.append((n, 1, "same", json.dumps(body)))
    done = ingest.events(spark.createDataFrame(rows, UPLOAD), chapters, texts, nothing)
    bad = {r.upload_id for r in done["rejected_uploads"].collect()}
    assert bad == {n for n, c in enumerate(cases) if not c[3]}
    assert done["events"].count() == sum(c[3] for c in cases)


def test_summary_files_name_a_chapter_whatever_their_language(spark):
    rows = [(1, json.dumps({"language": "en", "items": []})), (2, json.dumps({"language": "en", "chapterIndex": 1})), (3, "")]
    uploads = spark.createDataFrame([(n, 1, "f", j) for n, j in rows], UPLOAD)
    chapters = spark.createDataFrame([(5, 1, 1)], "chapter_id long, book_id long, idx int")
    cast = spark.createDataFrame([(101, 1, 1)], "id long, book_id long, character_id long")
    done = ingest.summaries(uploads, chapters, cast, spark.createDataFrame([], "chapter_id long"))
    assert {r.upload_id for r in done["rejected_uploads"].collect()} == {1}


def test_delta_items_keep_their_texts_when_files_are_taken_apart(spark):
    """Edges twice in a file or in two files of an upload, characters that stand twice, uploads without a key."""
    ev = spark.createDataFrame([(10, 1, 1, 1), (11, 1, 1, 2)], "id long, book_id long, chapter_idx int, idx int")
    cast = spark.createDataFrame([(101, 1, 1), (102, 1, 2), (103, 1, 3), (104, 1, 3)], "id long, book_id long, character_id long")

    def said(a, b, reason):
        return {**edge(a, b), "reason": reason}

    rows = [
        (1, delta("ch1-e1", [said("1", "2", "p"), said("2", "1", "q"), said("1", "3", "r")], {"3": {"weight": 4.0}})),
        (2, delta("ch1-e1", [said("1", "2", "s"), said("2", "1", "t"), said("1", "2", "u")])),
        (3, delta("ch1-e2", [said("1", "2", "v")], {"1": {"weight": 1.0}})),
        (3, delta("ch1-e2", [said("2", "1", "w"), said("1", "2", "x")])),
        (None, delta("ch1-e1", [said("2", "1", "y"), said("2", "1", "z"), {**said("1", "2", "bad"), "count": 0}])),
    ]
    done = ingest.deltas(spark.createDataFrame([(n, 1, "f", j) for n, j in rows], UPLOAD), ev, cast)
    got = sorted((r.explanation, r.event_id, r.from_char_id, r.to_char_id) for r in done["edges"].collect())
    assert got == [("p", 10, 101, 102), ("q", 10, 102, 101), ("r", 10, 101, 103), ("r", 10, 101, 104), ("y", 10, 102, 101), ("z", 10, 102, 101)]
    assert sorted((r.upload_id, r.char_id, r.node_weight) for r in done["stats"].collect()) == [(1, 103, 4.0), (1, 104, 4.0)]
    reasons = sorted(((r.upload_id or 0), r.reason) for r in done["rejects"].collect())
    assert reasons == [(0, "DQ-3 evidence")] + 2 * [(2, "DQ-6 edge twice")] + 2 * [(3, "DQ-6 edge twice")] + 2 * [(3, "DQ-6 event twice")]
