"""Rows written as single files."""

from pathlib import Path

import pytest

from plotweave.sources import files

FILE = "path string, content binary"


def below(folder):
    """Files in place; a task that is killed late may still leave some under _writing."""
    found = {str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.is_file()}
    return {p for p in found if "_writing/" not in p}


def test_files_stand_at_their_paths(spark, tmp_path):
    rows = [(f"books/{n}/text/chapter_{n:03d}.txt", f"été {n}\n".encode() * n) for n in range(40)]
    folder = str(tmp_path / "out")
    files.write_named(spark.createDataFrame(rows, FILE).repartition(4), folder)
    assert below(folder) == {p for p, _ in rows}
    assert all((Path(folder) / p).read_bytes() == c for p, c in rows)
    # Spark's readers skip empty files.
    assert {(r.path, bytes(r.content)) for r in files.read_named(spark, folder).collect()} == set(rows[1:])
    # Written again, with one file more and one changed.
    files.write_named(spark.createDataFrame([rows[3], ("books/3/meta.json", b"{}"), (rows[4][0], b"new")], FILE), f"file://{folder}")
    assert below(folder) == {p for p, _ in rows} | {"books/3/meta.json"}
    assert (Path(folder) / rows[4][0]).read_bytes() == b"new"


@pytest.mark.parametrize("bad", [("x/none.txt", None), ("../out", b"x"), ("/abs", b"x"), (None, b"x"), ("", b"x"), ("_writing/x", b"x")])
def test_a_failed_job_leaves_nothing(spark, tmp_path, bad):
    folder = tmp_path / "out"
    rows = [(f"books/{n}.txt", b"x") for n in range(30)] + [bad]
    with pytest.raises(Exception, match="no content|not a path"):
        files.write_named(spark.createDataFrame(rows, FILE).repartitionByRange(4, "path"), str(folder))
    assert below(folder) == set()


def test_nothing_to_write(spark, tmp_path):
    files.write_named(spark.createDataFrame([], FILE), str(tmp_path / "out"))
    assert below(tmp_path) == set()


def test_a_broken_commit_is_taken_back(spark, tmp_path):
    folder = str(tmp_path / "out")
    writer = files._Writer(folder)
    messages = [writer.write(iter([{"path": f"a/{n}", "content": b"x"}, {"path": f"b/{n}", "content": b"y"}])) for n in range(3)]
    (Path(folder) / "a").mkdir()
    (Path(folder) / messages[0].folder / "0").rename(Path(folder) / "a" / "0")
    writer.abort([*messages, None])
    assert below(folder) == set() and not list(Path(folder).rglob("paths"))


def test_moves_are_handed_out_in_portions(tmp_path, monkeypatch):
    """All names were given to the threads at once, however many files there were."""
    folder, waiting = tmp_path / "out", []
    writer = files._Writer(str(folder))
    message = writer.write(iter([{"path": f"a/{n}", "content": b"x"} for n in range(600)]))
    listed = writer._listed

    def watched(messages):
        for taken, pair in enumerate(listed(messages)):
            waiting.append(taken - (len(list((folder / "a").iterdir())) if (folder / "a").exists() else 0))
            yield pair

    monkeypatch.setattr(files, "_PORTION", 50)
    monkeypatch.setattr(writer, "_listed", watched)
    writer.commit([message])
    assert len(below(folder)) == 600 and max(waiting) <= 50


def test_files_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """The session's own file index, which lists every file on the driver, takes no part."""
    rows = [(f"b/{n % 5}/run={n % 3}/{n}.txt", b"%d" % n) for n in range(60)] + [("top.txt", b"t")]
    files.write_named(spark.createDataFrame([*rows, ("b/_hidden/x", b"x"), ("b/.dot", b"x")], FILE), str(tmp_path / "out"))
    read = files.read_named(spark, f"file://{tmp_path}/out")
    assert not any("/out/" in f for f in read.inputFiles())
    assert {(r.path, bytes(r.content)) for r in read.collect()} == set(rows)
