"""Unit roles and chapter titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotweave.functions.text import collapse, is_blank

# Fixed values.
PLACEHOLDER_TITLES = ["contents", "table of contents", "index", "the full project gutenberg license"]
HEADING = r"^(?i)(?:(?:chapter|book|part|act|scene|canto|letter)\b.*|[IVXLCDM]+)$"
ROMAN = r"^(?i)[ivxlcdm]+$"
TRAILING_NUMBER = r"(?i)(\d+|[IVXLCDM]+)$"
CONTAINS_RULES = [
    ("CONTENTS", ["contents"]),
    ("LICENSE", ["project gutenberg license", "full project gutenberg"]),
]
FRONT_WORDS = ["preface", "foreword", "introduction"]
PREFIX_RULES = [
    ("APPENDIX", "appendix|appendices|afterword|epilogue|conclusion"),
    ("NOTES", "notes?|footnotes?"),
    ("ACT", "act"),
    ("SCENE", "scene"),
    ("CANTO", "canto"),
    ("BOOK", "book"),
    ("PART", "part"),
    ("POEM", "poem|sonnet"),
    ("STORY", "story|tale"),
    ("ESSAY", "essay|lecture|sermon"),
    ("CHAPTER", "chapter|letter|prologue|epilogue"),
]
EXCLUDED_ROLES = ["FRONTMATTER", "CONTENTS", "LICENSE", "INDEX", "NOTES"]
FLEXIBLE_ROLES = ["CANTO", "POEM", "STORY", "ESSAY", "UNKNOWN", "APPENDIX"]


def _folded(c: Column) -> Column:
    return collapse(F.lower(F.coalesce(c, F.lit(""))))


def _holds_any(c: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | c.contains(word)
    return found


def role(title: Column, path: Column) -> Column:
    """Role of a unit from its title, else from its place in the table of contents."""
    t = _folded(title)
    rules = [(is_blank(t), "UNKNOWN")]
    rules += [(_holds_any(t, words), name) for name, words in CONTAINS_RULES]
    rules.append(((t == "index") | t.startswith("index "), "INDEX"))
    rules.append((_holds_any(t, FRONT_WORDS), "FRONTMATTER"))
    rules += [(t.rlike(rf"^(?:{words})\b"), name) for name, words in PREFIX_RULES]
    where = _folded(F.array_join(path, " / "))
    rules.append((t.rlike(ROMAN) & where.contains("act "), "SCENE"))
    rules.append((t.rlike(ROMAN), "CHAPTER"))
    chain = F
    for condition, name in rules:
        chain = chain.when(condition, name)
    return chain.otherwise("UNKNOWN")


def is_placeholder(folded: Column) -> Column:
    hit = F.lit(False)
    for word in PLACEHOLDER_TITLES:
        hit = hit | (folded == word) | folded.startswith(word + " ")
    return hit


def is_invalid_title(title: Column) -> Column:
    """A chapter title that should not have survived normalization."""
    t = _folded(title)
    return (
        is_blank(title)
        | (t == "contents")
        | t.startswith("contents ")
        | t.contains("project gutenberg license")
        | (t == "index")
        | t.startswith("index ")
    )


def _ancestors(path: Column) -> Column:
    """Titles above the leaf, nearest first."""
    return F.when(F.size(path) >= 2, F.reverse(F.slice(path, 1, F.size(path) - 1))).otherwise(
        F.array().cast("array<string>")
    )


def meaningful_ancestor(path: Column) -> Column:
    """Nearest title above the leaf that is neither blank nor a placeholder."""
    kept = F.filter(_ancestors(path), lambda x: ~is_blank(x) & ~is_placeholder(_folded(x)))
    return F.get(kept, F.lit(0))


def ancestor_with_prefix(path: Column, prefix: str) -> Column:
    """Nearest title above the leaf that starts with ``prefix``."""
    kept = F.filter(
        _ancestors(path), lambda x: F.lower(x).startswith(prefix) & ~is_placeholder(F.lower(x))
    )
    return F.get(kept, F.lit(0))


def direct_parent(path: Column) -> Column:
    return F.get(_ancestors(path), F.lit(0))


def trailing_number(title: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(title), TRAILING_NUMBER, 1), F.lit(""))


def range_title(parent: Column, label: str, first_title: Column, last_title: Column) -> Column:
    """``Parent (Cantos 1-5)``; the parent alone when a number is missing."""
    first, last = trailing_number(first_title), trailing_number(last_title)
    span = F.concat(F.lit(label + " "), first, F.lit("-"), last)
    return (
        F.when(first.isNull() | last.isNull(), parent)
        .when(is_blank(parent), span)
        .otherwise(F.concat(parent, F.lit(" ("), span, F.lit(")")))
    )
