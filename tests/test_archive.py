"""The archive reader and the whole normalization on hand-made archives."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from plotweave.operators import corpus
from plotweave.sources import archive

CONTAINER = '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>'


def package(items, spine, meta="<title>T</title><creator>A</creator>"):
    listed = "".join(f'<item id="{i}" href="{h}" media-type="{m}" {extra}/>' for i, h, m, extra in items)
    refs = "".join(f'<itemref idref="{i}"/>' for i in spine)
    return f"<package><metadata>{meta}</metadata><manifest>{listed}</manifest><spine>{refs}</spine></package>"


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


def book(pages, nav=None, ncx=None, **kw):
    items = [(n, f"{n}.xhtml", "application/xhtml+xml", "") for n in pages]
    files = {"META-INF/container.xml": CONTAINER}
    files.update({f"OPS/{n}.xhtml": f"<html><head><title>Doc {n}</title></head><body>{b}</body></html>" for n, b in pages.items()})
    if nav is not None:
        items.append(("nav", "nav.xhtml", "application/xhtml+xml", 'properties="nav"'))
        files["OPS/nav.xhtml"] = f'<html><body><nav epub:type="toc"><ol>{nav}</ol></nav></body></html>'
    if ncx is not None:
        items.append(("ncx", "toc.ncx", "application/x-dtbncx+xml", ""))
        files["OPS/toc.ncx"] = f"<ncx><navMap>{ncx}</navMap></ncx>"
    files["OPS/book.opf"] = package(items, [n for n in pages], **kw)
    return zipped(files)


def link(href, title):
    return f'<li><a href="{href}">{title}</a></li>'


@pytest.fixture(scope="module")
def run(spark):
    def go(*contents):
        rows = [(n, bytearray(c)) for n, c in enumerate(contents, 1)]
        return archive.normalize_archives(spark.createDataFrame(rows, "book_id long, content binary"))

    return go


def titles(done, book_id=1):
    return [r.title for r in done["chapters"].filter(F.col("book_id") == book_id).orderBy("chapter_idx").collect()]


def test_markup_reader_keeps_text_and_drops_the_rest():
    page = archive.read_markup(
        '<html><body><script>var a="x";</script><p onclick="a()" style="b">One<br/>two three</p><ul><li>A <p>B</p></li></ul>'
        '<p> </p><img src="https://evil.example/a.png"/><a id="k" href="x#y">go</a><p id="m">C</p><style>p{}</style></body></html>'
    )
    assert page.blocks([]) == [("p", "One two three", []), ("li", "A B", []), ("p", "B", []), ("p", "C", ["k", "m"])]
    assert (page.removed_tags, page.removed_attributes) == (2, 3)


def test_document_without_blocks_is_one_paragraph():
    page = archive.read_markup("<html><body>plain <b>text</b></body></html>")
    assert page.blocks(["x"]) == [("p", "plain text", ["x"])]


def test_whole_documents(run):
    done = run(book({"a": "<p>First.</p>", "b": "<p>Second.</p><p>Third.</p>"}, nav=link("a.xhtml", "Chapter One") + link("b.xhtml", "Chapter Two")))
    # Both are short, but neither is of a flexible kind nor has a common parent.
    assert titles(done) == ["Chapter One", "Chapter Two"]
    second = done["chapters"].filter("chapter_idx = 2").first()
    assert (second.starts, second.lengths, second.start_pos, second.end_pos) == ([0, 7], [7, 6], 6, 18)
    assert '<p data-block-index="1" data-spine-href="OPS/b.xhtml" data-source-unit-id="unit-2">Third.</p>' in second.markup
    report = done["reports"].first()
    assert (report.status, report.within_limit, report.sections_match, report.invalid_title_count) == ("PASS", True, True, 0)
    assert corpus.structural_audit(done["chapters"]).filter(F.size("issues") > 0).count() == 0


def test_fragments_in_one_document(run):
    body = '<section id="c1"><h2>CHAPTER I</h2><p>Alpha.</p></section><section id="c2"><h2>CHAPTER II</h2><p>Beta.</p></section>'
    done = run(book({"a": body}, nav=link("a.xhtml#c1", "CHAPTER I") + link("a.xhtml#c2", "CHAPTER II")))
    assert titles(done) == ["CHAPTER I", "CHAPTER II"]
    assert [r.text for r in done["chapters"].orderBy("chapter_idx").collect()] == ["CHAPTER IAlpha.", "CHAPTER IIBeta."]


def test_scenes_join_their_act(run):
    body = "".join(f'<div id="s{n}"><h2>SCENE {n}</h2><p>Text {n}.</p></div>' for n in (1, 2, 3))
    nav = f"<li><span>PLAY</span><ol><li><span>ACT I</span><ol>{link('a.xhtml#s1', 'SCENE I')}{link('a.xhtml#s2', 'SCENE II')}</ol></li>"
    nav += f"<li><span>ACT II</span><ol>{link('a.xhtml#s3', 'SCENE I')}</ol></li></ol></li>"
    assert titles(run(book({"a": body}, nav=nav))) == ["ACT I", "ACT II"]


def test_contents_and_license_are_dropped(run):
    pages = {"c": "<p>list</p>", "a": '<h2 id="x">CHAPTER I</h2><p>Text.</p>', "l": "<p>legal</p>"}
    nav = link("c.xhtml", "Contents") + link("a.xhtml#x", "CHAPTER I") + link("l.xhtml", "THE FULL PROJECT GUTENBERG LICENSE")
    assert titles(run(book(pages, nav=nav))) == ["CHAPTER I"]


def test_ncx_is_used_without_a_nav_and_headings_without_either(run):
    ncx = '<navPoint><navLabel><text>Letter 1</text></navLabel><content src="a.xhtml"/></navPoint>'
    plain = "<h1>Top</h1><p>lost</p><h2>Chapter 1</h2><p>a</p><h2>Chapter 2</h2><p>b</p>"
    done = run(book({"a": "<p>x</p>"}, ncx=ncx), book({"a": plain}), book({"a": "<p>only</p>"}))
    assert titles(done, 1) == ["Letter 1"]
    assert titles(done, 2) == ["Chapter 1", "Chapter 2"]
    assert titles(done, 3) == ["Doc a"]
    assert "lost" not in "".join(r.text for r in done["chapters"].collect())


def test_next_leaf_without_fragment_takes_the_document(run):
    pages = {"a": '<h2 id="x">I</h2><p>one</p><h2 id="y">II</h2><p>two</p>'}
    done = run(book(pages, nav=link("a.xhtml#x", "Chapter A") + link("a.xhtml", "Chapter B")))
    assert titles(done) == ["Chapter B"]
    assert done["chapters"].first().text == "IoneIItwo"


def test_missing_anchor_continues_after_the_previous_leaf(run):
    pages = {"a": '<h2 id="x">I</h2><p>one</p><h2 id="y">II</h2><p>two</p>'}
    nav = link("a.xhtml#x", "Chapter A") + link("a.xhtml#y", "Chapter B") + link("a.xhtml#gone", "Chapter C")
    done = run(book(pages, nav=nav))
    assert titles(done) == ["Chapter A", "Chapter B"]


def test_failures_do_not_stop_the_others(run):
    good = book({"a": "<p>x</p>"})
    no_container = zipped({"x": "y"})
    no_package = zipped({"META-INF/container.xml": CONTAINER})
    bad_package = zipped({"META-INF/container.xml": CONTAINER, "OPS/book.opf": "<!DOCTYPE x><package/>"})
    empty_spine = zipped({"META-INF/container.xml": CONTAINER, "OPS/book.opf": package([], [])})
    missing = zipped({"META-INF/container.xml": CONTAINER, "OPS/book.opf": package([("a", "a.xhtml", "text/html", "")], ["a"])})
    blank = book({"a": "<p> </p>"})
    done = run(good, b"no zip", no_container, no_package, bad_package, empty_spine, missing, blank)
    assert {r.book_id: r.code for r in done["failures"].collect()} == {
        2: "INVALID_EPUB_ARCHIVE", 3: "CONTAINER_NOT_FOUND", 4: "PACKAGE_NOT_FOUND", 5: "PACKAGE_PARSE_FAILED",
        6: "SPINE_RESOLVE_FAILED", 7: "SPINE_ENTRY_NOT_FOUND", 8: "NO_TEXT_CHAPTERS",
    }
    assert [r.book_id for r in done["chapters"].collect()] == [1]


def test_cover_and_metadata(run):
    items = '<meta name="cover" content="pic"/><title> A  title </title><creator>B</creator><language>ko</language>'
    done = run(book({"a": "<p>x</p>"}, meta=items))
    row = done["books"].first()
    assert (row.title, row.author, row.language, row.missing) == ("A title", "B", "ko", None)


def test_archive_files_are_scanned(spark, tmp_path):
    (tmp_path / "book-12.epub").write_bytes(book({"a": "<p>x</p>"}))
    (tmp_path / "notes.txt").write_text("no")
    assert [r.book_id for r in archive.archive_files(spark, str(tmp_path)).collect()] == [12]
