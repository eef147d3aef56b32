"""Text columns: whitespace, truncation, names, lines, escaping, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NAMES_SEPARATOR = ","
PREVIEW_CODE_POINTS = 2000
ELLIPSIS = "..."
CONTROLS = "".join(map(chr, range(33)))


def trim_controls(c: Column) -> Column:
    """Trim space and every control character below it (not only U+0020)."""
    return F.btrim(c, F.lit(CONTROLS))


def collapse(c: Column) -> Column:
    """Runs of ASCII whitespace become one space, ends trimmed; NBSP stays."""
    return trim_controls(F.regexp_replace(c, r"\s+", " "))


def is_blank(c: Column) -> Column:
    return c.isNull() | c.rlike(r"^\p{javaWhitespace}*$")


def optional_text(c: Column) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(trim_controls(c), F.lit(""))


def truncated(c: Column, limit: int) -> Column:
    """Collapsed text of at most ``limit`` code points, the last three being dots."""
    clean = collapse(c)
    cut = F.concat(F.substring(clean, 1, limit - len(ELLIPSIS)), F.lit(ELLIPSIS))
    return F.when(c.isNull() | (c == ""), F.lit(None).cast("string")).when(F.length(clean) <= limit, clean).otherwise(cut)


def split_names(names: Column, fallback: Column) -> Column:
    """Comma list to array; blanks dropped; the plain name when nothing is left."""
    parts = F.filter(
        F.transform(F.split(names, NAMES_SEPARATOR), trim_controls), lambda x: x != ""
    )
    return F.when(names.isNull() | (F.size(parts) == 0), F.array(fallback)).otherwise(parts)


def join_names(names: Column, fallback: Column) -> Column:
    """Array to comma list: trimmed, distinct in first order, or the plain name."""
    kept = F.array_distinct(F.filter(F.transform(names, optional_text), lambda x: x.isNotNull()))
    return F.when(names.isNull() | (F.size(kept) == 0), fallback).otherwise(F.array_join(kept, NAMES_SEPARATOR))


def newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def code_points(c: Column) -> Column:
    return F.length(c)


def text_range(c: Column, start: Column, end: Column) -> Column:
    """Half-open code-point range."""
    return F.substring(c, start + F.lit(1), end - start)


def preview(c: Column) -> Column:
    return F.nullif(F.substring(c, 1, PREVIEW_CODE_POINTS), F.lit(""))


def description(by_language: Column, plain: Column) -> Column:
    """The Korean entry of the description map, else the plain field."""
    return F.coalesce(optional_text(by_language["ko"]), optional_text(plain))


def xml_escaped(c: Column) -> Column:
    """The five XML entities; the ampersand goes first."""
    # Fixed values.
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")]
    for mark, entity in pairs:
        c = F.replace(c, F.lit(mark), F.lit(entity))
    return c


def fragment_of(href: Column) -> Column:
    """The part after the first '#', null when there is none."""
    at = F.instr(href, "#")
    return F.when(at > 0, F.substring(href, at + F.lit(1), F.length(href)))


def without_fragment(href: Column) -> Column:
    return F.substring_index(href, "#", 1)


def parent_folder(path: Column) -> Column:
    """Everything before the last '/', or the empty string."""
    return F.when(F.instr(path, "/") == 0, F.lit("")).otherwise(F.regexp_replace(path, r"/[^/]*$", ""))


def is_remote(reference: Column) -> Column:
    low = F.lower(reference)
    return (
        low.startswith("http://") | low.startswith("https://") | low.startswith("//") | low.startswith("data:")
    )


def artifact_root(book_id: Column, run_id: Column) -> Column:
    return F.concat(F.lit("books/"), book_id.cast("string"), F.lit("/normalizations/"), run_id)


def chapter_file(idx: Column) -> Column:
    return F.format_string("chapter_%03d", idx.cast("int"))


def chapter_text_path(root: Column, idx: Column) -> Column:
    return F.concat(root, F.lit("/text/"), chapter_file(idx), F.lit(".txt"))


def public_url(base: Column, prefix: Column, path: Column) -> Column:
    """Base without one trailing slash, then prefix and path; null without a path."""
    return F.when(path.isNotNull(), F.concat_ws("/", F.regexp_replace(base, r"/$", ""), prefix, path))


def file_variant(name: Column) -> Column:
    """Which flavour of a corpus archive its file name announces."""
    low = F.lower(name)
    # Fixed values.
    return (
        F.when(low.endswith("-images-3.epub"), "EPUB3_IMAGES")
        .when(low.endswith("-images.epub"), "EPUB2_IMAGES")
        .otherwise("EPUB_DEFAULT")
    )


def file_title(name: Column) -> Column:
    """Book title from an archive's file name."""
    return trim_controls(F.regexp_replace(F.regexp_replace(name, r"-images(-3)?\.epub$", ""), r"\.epub", ""))
