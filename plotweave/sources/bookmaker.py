"""Book archives made from the documents table, for queries and tests.

Five consecutive documents become one archive, so a group is five rows by arithmetic.
The kind of contents page and the defects follow from the archive number.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOCS_PER_ARCHIVE = 5
HELD_BYTES = 1 << 20
_CONTAINER = (
    '<?xml version="1.0"?><container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles>'
    '<rootfile full-path="OPS/package.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
)


def _page(doc_id: int, text: str) -> tuple[str, list[int]]:
    """Markup of one document and the line numbers that open a section."""
    parts, sections = [], []
    for number, line in enumerate(text.split("\n")):
        if number % 4 == 0:
            sections.append(number)
            parts.append(f'<h2 id="s{number}">Chapter {number // 4 + 1}</h2>')
        parts.append(f'<p onclick="x()" style="a">{escape(line)}</p>')
    head = f'<head><title>Doc {doc_id}</title><style>p {{}}</style><link rel="x" href="http://x.example"/></head>'
    return f'<html xmlns="http://www.w3.org/1999/xhtml">{head}<body>{"".join(parts)}</body></html>', sections


def _nav(body: str) -> str:
    return (
        '<html xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><h1>Contents</h1>'
        f"<ol>{body}</ol></nav></body></html>"
    )


def build_archive(archive_id: int, docs: list[tuple[int, str]]) -> bytes:
    """One archive; its contents page is absent, flat, NCX or nested."""
    kind, defect = archive_id % 4, archive_id % 13
    pages = [(f"d{doc_id}.xhtml", *_page(doc_id, text)) for doc_id, text in docs]
    manifest = [f'<item id="i{n}" href="{name}" media-type="application/xhtml+xml"/>' for n, (name, _, _) in enumerate(pages)]
    extra: dict[str, str] = {}
    if kind == 1:
        entries = "".join(f'<li><a href="{name}">Letter {n + 1}</a></li>' for n, (name, _, _) in enumerate(pages))
        extra["OPS/nav.xhtml"] = _nav(entries)
    elif kind == 2:
        points, number = [], 0
        for n, (name, _, sections) in enumerate(pages):
            inner = []
            for at in sections:
                number += 1
                inner.append(
                    f"<navPoint><navLabel><text>Canto {number}</text></navLabel><content src=\"{name}#s{at}\"/></navPoint>"
                )
            points.append(f"<navPoint><navLabel><text>Book {n + 1}</text></navLabel>{''.join(inner)}</navPoint>")
        extra["OPS/toc.ncx"] = f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{"".join(points)}</navMap></ncx>'
    elif kind == 3:
        acts = []
        for n, (name, _, sections) in enumerate(pages):
            scenes = "".join(f'<li><a href="{name}#s{at}">Scene {at // 4 + 1}</a></li>' for at in sections)
            acts.append(f"<li><span>Act {n + 1}</span><ol>{scenes}</ol></li>")
        extra["OPS/nav.xhtml"] = _nav("".join(acts))
    if "OPS/nav.xhtml" in extra:
        manifest.append('<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>')
    if "OPS/toc.ncx" in extra:
        manifest.append('<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>')
    manifest.append('<item id="pic" href="cover.png" media-type="image/png"/>')
    spine = "".join(f'<itemref idref="i{n}"/>' for n in range(len(pages)))
    author = "" if archive_id % 17 == 4 else f"<dc:creator>Author {archive_id % 7}</dc:creator>"
    package = (
        '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>'
        f"<dc:title> Archive  {archive_id} </dc:title>{author}</metadata>"
        f"<manifest>{''.join(manifest)}</manifest><spine>{'' if defect == 12 else spine}</spine></package>"
    )
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as out:
        if defect != 9:
            out.writestr("META-INF/container.xml", _CONTAINER)
        if defect != 10:
            out.writestr("OPS/package.opf", package)
        for path, body in extra.items():
            out.writestr(path, body)
        for number, (name, body, _) in enumerate(pages):
            if not (defect == 11 and number == 0):
                out.writestr(f"OPS/{name}", body)
    content = buffer.getvalue()
    return content[:20] if defect == 7 else content


def archives_from_documents(documents: DataFrame) -> DataFrame:
    """(book_id, content) rows."""

    schema = pa.schema([("book_id", pa.int64()), ("content", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for book_id, docs in zip(batch.column("book_id"), batch.column("docs")):
                number = book_id.as_py()
                content = build_archive(number, [(d["doc_id"], d["text"]) for d in docs.as_py()])
                rows.append({"book_id": number, "content": content})
                held += len(content)
                if held >= HELD_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return (
        documents.select(F.expr(f"doc_id div {DOCS_PER_ARCHIVE}").alias("book_id"), "doc_id", "text")
        .groupBy("book_id")
        .agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("docs"))
        .mapInArrow(build, "book_id long, content binary")
    )
