"""Book archives to rows: blocks, contents leaves, documents, metadata, failures.

The reader is the only per-file step. It opens one archive at a time with the
standard library and emits small rows; everything after it is DataFrame work. A
broken archive gives one failure row and never stops the job.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
BLOCK_TAGS = {"p", "li", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"}
REMOVED_TAGS = {"script", "iframe", "object", "embed", "style", "link"}
TEXT_MEDIA = {"application/xhtml+xml", "text/html"}
NCX_MEDIA = "application/x-dtbncx+xml"
REMOTE = ("http://", "https://", "//", "data:")
SPACED_TAGS = BLOCK_TAGS | {
    "html", "head", "body", "title", "div", "section", "article", "nav", "aside", "header", "footer", "main",
    "ul", "ol", "dl", "dt", "dd", "table", "tr", "td", "th", "thead", "tbody", "pre", "hr", "br", "figure",
    "figcaption", "address", "form", "fieldset", "noscript", "frameset", "script", "style", "center", "details", "summary",
}

ROWS = """book_id long, kind string, doc_href string, doc_order int, in_spine boolean, seq int, tag string, text string,
  fragment string, path array<string>, depth int, anchors array<string>, title string, author string, language string,
  cover_href string, code string, step string, removed_tags int, removed_attributes int"""
_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(),
          "array<string>": pa.list_(pa.string())}
_SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in (part.split() for part in ROWS.split(","))])


# Rows of archives and characters of pages a task holds before they leave.
HELD_ROWS = 1024
HELD_CHARS = 1 << 21


class ArchiveError(Exception):
    """Why an archive cannot be read, and at which step."""

    def __init__(self, code: str, step: str):
        super().__init__(code)
        self.code, self.step = code, step


_SPACES = re.compile(r"[ \t\n\x0b\f\r]+")
_CONTROLS = "".join(map(chr, range(33)))


def tidy(text: str | None) -> str:
    """ASCII whitespace runs become one space; a no-break space counts as a space in markup."""
    return _SPACES.sub(" ", text or "").strip(_CONTROLS)


class MarkupReader(HTMLParser):
    """Walks one document once; collects blocks with their anchors, and what was removed.

    Tags nest as written, as in XML: an element stays open until its parent closes.
    """

    CDATA_CONTENT_ELEMENTS = ()

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.hidden = 0
        self.in_body = 0
        self.items: list[tuple[str, list[str], list[str] | None]] = []
        self.open_texts: list[tuple[int, list[str]]] = []
        self.body: list[str] = []
        self.named: dict[str, list[str]] = {}
        self.removed_tags = 0
        self.removed_attributes = 0

    def updatepos(self, i, j):
        """Nobody asks for line numbers."""
        return j

    def handle_starttag(self, tag, attrs):
        self._open(tag, attrs)
        self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        self._open(tag, attrs)
        self.stack.append(tag)
        self._close()

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack[-1] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        if not self.hidden:
            self._write(data.replace("\u00a0", " ").replace("\u200b", "").replace("\u00ad", ""))

    def _write(self, data: str) -> None:
        for _, texts in self.open_texts:
            texts.append(data)
        if self.in_body:
            self.body.append(data)

    def _open(self, tag, attrs) -> None:
        if tag in REMOVED_TAGS:
            self.removed_tags += not self.hidden
            self.hidden += 1
            return
        if self.hidden:
            return
        kept = {}
        for key, value in attrs:
            remote = key in ("src", "href") and (value or "").lower().startswith(REMOTE)
            if key.startswith("on") or key == "style" or remote:
                self.removed_attributes += 1
            else:
                kept[key] = value or ""
        if tag in SPACED_TAGS:
            self._write(" ")
        if tag == "body":
            self.in_body += 1
        anchors = list(dict.fromkeys(v for v in (kept.get("id"), kept.get("name")) if v and v.strip()))
        texts: list[str] | None = None
        if tag in BLOCK_TAGS or tag == "title":
            texts = []
            self.open_texts.append((len(self.stack), texts))
            self.named.setdefault(tag, texts)
        if self.in_body:
            self.items.append((tag, anchors, texts if tag in BLOCK_TAGS else None))

    def _close(self) -> None:
        tag = self.stack.pop()
        if tag in REMOVED_TAGS:
            self.hidden -= 1
            return
        if self.hidden:
            return
        if self.open_texts and self.open_texts[-1][0] == len(self.stack):
            self.open_texts.pop()
        if tag == "body":
            self.in_body -= 1
        if tag in SPACED_TAGS:
            self._write(" ")

    def blocks(self, wanted: list[str]) -> list[tuple[str, str, list[str]]]:
        """(tag, text, anchors) in document order.

        Anchors on other elements wait for the next block; a document without blocks is
        one paragraph that carries every wanted anchor.
        """
        found, waiting = [], []
        for tag, anchors, texts in self.items:
            if texts is None:
                waiting += anchors
                continue
            text = tidy("".join(texts))
            if text:
                found.append((tag, text, [*waiting, *anchors]))
                waiting = []
        if found:
            return found
        text = tidy("".join(self.body))
        return [("p", text, list(wanted))] if text else []

    def document_title(self) -> str | None:
        for tag in ("h1", "h2", "title"):
            text = tidy("".join(self.named.get(tag, [])))
            if text:
                return text
        return None


def read_markup(markup: str) -> MarkupReader:
    reader = MarkupReader()
    reader.feed(markup)
    reader.close()
    return reader


# ------------------------------------------------------------- package reading


def _xml(data: bytes) -> ElementTree.Element:
    if b"<!DOCTYPE" in data:
        raise ElementTree.ParseError("a document type is not allowed")
    return ElementTree.fromstring(data)


def _local(element) -> str:
    return element.tag.rsplit("}", 1)[-1].lower() if isinstance(element.tag, str) else ""


def _all(root, name: str):
    return [e for e in root.iter() if _local(e) == name]


def _children(element, name: str):
    return [e for e in element if _local(e) == name]


def _resolve(folder: str, href: str) -> str:
    href = href.replace("\\", "/")
    return posixpath.normpath(posixpath.join(folder, href)) if folder.strip() else href


def _member(archive: zipfile.ZipFile, path: str) -> bytes | None:
    try:
        return archive.read(path.replace("\\", "/"))
    except KeyError:
        return None


def _package_path(archive: zipfile.ZipFile) -> str:
    data = _member(archive, "META-INF/container.xml")
    if data is None:
        raise ArchiveError("CONTAINER_NOT_FOUND", "resolve_container")
    try:
        path = _all(_xml(data), "rootfile")[0].get("full-path") or ""
    except (ElementTree.ParseError, IndexError):
        path = ""
    if not path.strip():
        raise ArchiveError("CONTAINER_PARSE_FAILED", "resolve_container")
    return path


def _package(archive: zipfile.ZipFile, path: str):
    data = _member(archive, path)
    if data is None:
        raise ArchiveError("PACKAGE_NOT_FOUND", "resolve_package")
    try:
        return _xml(data)
    except ElementTree.ParseError:
        raise ArchiveError("PACKAGE_PARSE_FAILED", "resolve_package") from None


def _manifest(package, folder: str) -> dict[str, dict]:
    items = {}
    for item in _all(package, "item"):
        if item.get("id") is not None and item.get("href") is not None:
            items[item.get("id")] = {
                "id": item.get("id"),
                "href": _resolve(folder, item.get("href")),
                "media": (item.get("media-type") or "").lower(),
                "properties": (item.get("properties") or "").lower().split(),
            }
    return items


def _spine(package, manifest: dict[str, dict]) -> list[str]:
    listed = (manifest.get(ref.get("idref")) for ref in _all(package, "itemref"))
    return [i["href"] for i in listed if i and i["media"] in TEXT_MEDIA and "nav" not in i["properties"]]


def _cover(package, manifest: dict[str, dict]) -> str | None:
    named = [m.get("content") for m in _all(package, "meta") if (m.get("name") or "").lower() == "cover"]
    if named and named[0] in manifest:
        return manifest[named[0]]["href"]
    for item in manifest.values():
        if "cover-image" in item["properties"]:
            return item["href"]
    for item in manifest.values():
        if item["media"].startswith("image/") and ("cover" in item["id"].lower() or "cover" in item["href"].lower()):
            return item["href"]
    guide = [r.get("href") for r in _all(package, "reference") if (r.get("type") or "").lower() == "cover"]
    return guide[0] if guide else None


# --------------------------------------------------------------- contents page


class _NavReader(HTMLParser):
    """Nested lists of the contents navigation as (depth, label, href) entries in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.navs: list[tuple[bool, list[dict]]] = []
        self.in_nav = 0
        self.lists = 0
        self.entries: list[dict] = []
        self.open: list[dict] = []
        self.label: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag == "nav" and not self.in_nav:
            kind = values.get("epub:type") or values.get("type") or ""
            self.navs.append(("toc" in kind.lower().split(), []))
            self.in_nav, self.lists, self.open = 1, 0, []
        elif self.in_nav and tag == "ol":
            self.lists += 1
        elif self.in_nav and tag == "li" and self.lists:
            entry = {"depth": self.lists, "label": None, "own": [], "href": None, "children": []}
            if self.lists > 1 and self.open:
                self.open[-1]["children"].append(entry)
            elif self.lists == 1:
                self.navs[-1][1].append(entry)
            self.open.append(entry)
        elif self.in_nav and self.open and tag in ("a", "span") and self.open[-1]["depth"] == self.lists:
            here = self.open[-1]
            if tag == "a" and here["href"] is None:
                here["href"], here["label"], self.label = tidy(values.get("href")), [], None
                self.label = here["label"]
            elif tag == "span" and here["label"] is None:
                here["label"] = self.label = []

    def handle_endtag(self, tag):
        if tag in ("a", "span"):
            self.label = None
        elif tag == "ol" and self.lists:
            self.lists -= 1
        elif tag == "li" and self.open:
            self.open.pop()
        elif tag == "nav":
            self.in_nav = 0

    def handle_data(self, data):
        if self.label is not None:
            self.label.append(data)
        elif self.in_nav and self.open:
            self.open[-1]["own"].append(data)

    def roots(self) -> list[dict]:
        chosen = next((tree for is_toc, tree in self.navs if is_toc), self.navs[0][1] if self.navs else [])

        def clean(entries):
            for e in entries:
                kept = list(clean(e["children"]))
                title = tidy("".join(e["label"] if e["label"] is not None else e["own"]))
                if title or kept:
                    yield {"title": title, "href": e["href"], "children": kept}

        return list(clean(chosen))


def _nav_roots(archive, manifest) -> tuple[list[dict], str]:
    item = next((i for i in manifest.values() if "nav" in i["properties"]), None)
    data = _member(archive, item["href"]) if item else None
    if data is None:
        return [], ""
    reader = _NavReader()
    reader.feed(data.decode("utf-8", "replace"))
    return reader.roots(), posixpath.dirname(item["href"])


def _ncx_roots(archive, manifest) -> tuple[list[dict], str]:
    item = next((i for i in manifest.values() if i["media"] == NCX_MEDIA), None)
    data = _member(archive, item["href"]) if item else None
    if data is None:
        return [], ""
    try:
        maps = _children(_xml(data), "navmap")
    except ElementTree.ParseError:
        return [], ""

    def points(element):
        for point in _children(element, "navpoint"):
            label = [t for n in _children(point, "navlabel")[:1] for t in _children(n, "text")[:1]]
            source = _children(point, "content")[:1]
            yield {
                "title": tidy("".join(label[0].itertext())) if label else "",
                "href": tidy(source[0].get("src")) if source and source[0].get("src") is not None else None,
                "children": list(points(point)),
            }

    return (list(points(maps[0])) if maps else []), posixpath.dirname(item["href"])


def _leaves(roots: list[dict], folder: str) -> list[dict]:
    """Entries with a document that no usable child replaces, in reading order."""

    def place(entry) -> str | None:
        plain = (entry["href"] or "").split("#", 1)[0]
        return _resolve(folder, plain) if plain.strip() else None

    def usable(entry) -> bool:
        return place(entry) is not None or bool(entry["children"])

    def walk(entry, above: list[str], depth: int):
        path = above + [entry["title"]] if entry["title"] else above
        if place(entry) is not None and not any(usable(c) for c in entry["children"]):
            href = entry["href"]
            yield {
                "title": entry["title"], "path": path, "depth": depth, "doc_href": place(entry),
                "fragment": href.split("#", 1)[1] if "#" in href else None,
            }
            return
        for child in entry["children"]:
            yield from walk(child, path, depth + 1)

    return [leaf for root in roots for leaf in walk(root, [], 1)]


# ------------------------------------------------------------------ the reader


def archive_rows(book_id: int, content: bytes) -> Iterator[dict]:
    """All rows of one archive; raises ArchiveError when it cannot be used."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, OSError):
        raise ArchiveError("INVALID_EPUB_ARCHIVE", "open_epub") from None
    with archive:
        path = _package_path(archive)
        package = _package(archive, path)
        manifest = _manifest(package, posixpath.dirname(path))
        first = {
            name: next((tidy("".join(e.itertext())) for e in _all(package, name) if tidy("".join(e.itertext()))), None)
            for name in ("title", "creator", "language")
        }
        yield {
            "kind": "meta", "title": first["title"], "author": first["creator"], "language": first["language"],
            "cover_href": _cover(package, manifest),
        }
        spine = _spine(package, manifest)
        if not spine:
            raise ArchiveError("SPINE_RESOLVE_FAILED", "resolve_spine")
        leaves = _leaves(*_nav_roots(archive, manifest)) or _leaves(*_ncx_roots(archive, manifest))
        for number, leaf in enumerate(leaves):
            yield {"kind": "leaf", "seq": number, **leaf}
        for order, href in enumerate(dict.fromkeys([*spine, *(leaf["doc_href"] for leaf in leaves)])):
            data = _member(archive, href)
            if data is None:
                raise ArchiveError("SPINE_ENTRY_NOT_FOUND", "read_xhtml")
            reader = read_markup(data.decode("utf-8", "replace"))
            wanted = [leaf["fragment"] for leaf in leaves if leaf["doc_href"] == href and leaf["fragment"]]
            yield {
                "kind": "doc", "doc_href": href, "doc_order": order, "in_spine": href in spine,
                "title": reader.document_title(), "removed_tags": reader.removed_tags,
                "removed_attributes": reader.removed_attributes,
            }
            for number, (tag, text, anchors) in enumerate(reader.blocks(wanted)):
                yield {"kind": "block", "doc_href": href, "seq": number, "tag": tag, "text": text, "anchors": anchors}


def _safe_rows(book_id: int, content: bytes) -> list[dict]:
    try:
        rows = list(archive_rows(book_id, content))
        if not any(r["kind"] == "block" for r in rows):
            raise ArchiveError("NO_TEXT_CHAPTERS", "extract_chapters")
    except ArchiveError as error:
        rows = [{"kind": "failure", "code": error.code, "step": error.step}]
    except Exception:  # one unreadable archive must not stop the others
        rows = [{"kind": "failure", "code": "UNEXPECTED_FAILURE", "step": "normalizing_epub"}]
    return [{"book_id": book_id, **row} for row in rows]


def read_archives(archives: DataFrame) -> DataFrame:
    """Rows of all archives; ``archives`` has (book_id, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for book_id, content in zip(batch.column("book_id"), batch.column("content")):
                rows += _safe_rows(book_id.as_py(), content.as_py())
                if len(rows) >= HELD_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return archives.select("book_id", "content").mapInArrow(run, ROWS)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """Archives under ``path``; the book id is the number in the file name."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.epub")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(F.regexp_extract("path", r"(\d+)[^/]*\.epub$", 1).cast("long").alias("book_id"), "content")
    )


def part(rows: DataFrame, kind: str) -> DataFrame:
    """One kind of row with the columns that belong to it."""
    columns = {
        "block": ["book_id", "doc_href", F.col("seq").alias("block_idx"), "tag", "text", "anchors"],
        "leaf": ["book_id", "doc_href", F.col("seq").alias("leaf_no"), "title", "path", "depth", "fragment"],
        "doc": ["book_id", "doc_href", "doc_order", "in_spine", F.col("title").alias("doc_title"),
                "removed_tags", "removed_attributes"],
        "meta": ["book_id", "title", "author", "language", "cover_href"],
        "failure": ["book_id", "code", "step"],
    }
    return rows.filter(F.col("kind") == kind).select(*columns[kind])


PAGE_ROWS = """page_id long, block_idx int, tag string, text string, doc_title string, removed_tags int,
  removed_attributes int"""


def page_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of single markup pages (page_id, html)."""

    names = [part.split()[0] for part in PAGE_ROWS.split(",")]
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in (part.split() for part in PAGE_ROWS.split(","))])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A batch may hold ten thousand pages, so pages are taken one by one and rows leave in portions.
        rows, held = [], 0
        for batch in batches:
            for page_id, html in zip(batch.column("page_id"), batch.column("html")):
                number, markup = page_id.as_py(), html.as_py()
                reader = read_markup(markup)
                about = (reader.document_title(), reader.removed_tags, reader.removed_attributes)
                rows += [(number, n, tag, text, *about) for n, (tag, text, _) in enumerate(reader.blocks([]))]
                held += len(markup)
                if held >= HELD_CHARS and rows:
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)

    return pages.select("page_id", "html").mapInArrow(run, PAGE_ROWS)


def normalize_archives(archives: DataFrame, limits=None) -> dict[str, DataFrame]:
    """Archives to chapters, reports, metadata and failures.

    The parsed rows, the units, the plan and the chapters feed several branches, so each is written
    once instead of opening every archive again for each branch.
    """
    from plotweave.operators import corpus
    from plotweave.operators.planner import Limits, plan_chapters
    from plotweave.session import cut

    rows = cut(read_archives(archives))
    docs, blocks, leaves = part(rows, "doc"), part(rows, "block"), part(rows, "leaf")
    units = corpus.split_units(docs, blocks, leaves)
    pieces = corpus.unit_blocks(units, blocks)
    sized = cut(corpus.size_and_classify(units, pieces))
    pieces = corpus.unit_blocks(sized, blocks)
    planned = cut(plan_chapters(sized, limits or Limits()))
    chapters = cut(corpus.render_chapters(corpus.chapter_plans(planned), corpus.chapter_blocks(planned, pieces)))
    return {
        "rows": rows,
        "units": sized,
        "planned": planned,
        "pieces": pieces,
        "chapters": chapters,
        "reports": corpus.validation_report(chapters),
        "metadata": corpus.metadata(chapters),
        "books": corpus.book_metadata(part(rows, "meta")),
        "failures": part(rows, "failure"),
    }
