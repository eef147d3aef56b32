"""Main text of web pages by site style trees.

The element trees of all pages of a host are merged into one tree of presentation styles: nodes
are paths of element names with their classes and ids. A node's importance is the entropy,
to the base of the number of its pages, of how it is presented (the sequence of its
children) and of what it says (its own text): a menu that is the same everywhere scores 0, text
that no two pages share scores 1. A branch is worth its most important node, and branches
worth less than ``least`` are cut from each page of the host, as are the elements that HTML
itself sets apart: navigation, headers, footers, asides, forms, scripts, and elements whose class, id or
role says so. The text is that of the article, else of the main element, else of the body.

A class, id or role is only a hint, as wrappers of the whole page have such names too. It does not
count where the element holds the article, the main element or the heading (those that are
found nowhere outside of such elements), or most of the text of the page or article. Text that
is set apart is recorded as such and is the page's text where nothing else is left, first that
of class words; only what is never shown as text (scripts, heads, controls) is not recorded.

Two rules keep articles whole where pages repeat each other: a branch can only be cut at a
container or an element with a class or id, and where the article itself is worth
too little, its host's pages are copies and say nothing about it.

Copies of a page count once: pages of a host that have the same main text before any cut are one
page, so they cannot make a branch look like one that is the same everywhere. A bitmap of fixed
size tells which pages may have copies, and only their rows are kept apart by page before
they are counted; a false positive costs rows, not results.

Hosts are aggregated from one row per page and node, combined before the shuffle, so a host
that holds a third of all pages is no single task. Nodes deeper than `DEEPEST` share
the path of their ancestor at that depth.

Defined results: a null or empty page has an empty text; a null url counts as a host of its
own; tags may be left open, and text after a closing body still counts; repeated pages are
extracted one by one; an empty table gives no rows; other columns are kept as they are.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import stored, text_of, unused


@dataclass(frozen=True)
class Settings:
    """Branches below ``least`` on at least ``pages`` pages are cut."""

    least: float = 0.2
    pages: int = 5


DEEPEST = 64
#: Of the bitmap of pages that have copies.
COPY_BITS = 1 << 23

# Fixed values of HTML: elements without content, with raw text, and those that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
# Fixed values of HTML: what an opening tag closes, up to which element.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "caption"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "caption"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "caption"), ("table",)),
    "option": (("option",), ("select", "optgroup")),
}
# Words of this operator: elements, and words in classes, ids and roles, that are not main text.
APART = frozenset(
    "head title script style noscript template nav header footer aside form button select textarea iframe object svg canvas "
    "audio video dialog menu xmp noembed noframes".split()
)
#: Of those, the elements whose content is not text of the page.
NO_TEXT = frozenset("head title script style template noscript button select textarea iframe object svg canvas audio video xmp noembed noframes".split())
APART_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc "
    "sidebar aside complementary related recommended recommendations widget "
    "footer header masthead topbar contentinfo "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login search "
    "comment comments commentlist reply replies respond disqus discussion discussions "
    "share sharing social".split()
)
#: Where a branch may be cut although it has no class and no id.
CONTAINERS = frozenset("div section ul ol dl table menu center fieldset details".split())
WHOLE = frozenset("html body main article".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


class Element:
    __slots__ = ("name", "path", "silent", "apart", "named_apart", "cut", "article", "main", "block", "children", "said", "styled")

    def __init__(self, name: str):
        self.name = name
        self.children: list[str] = []
        self.said: list[str] = []


@dataclass(frozen=True)
class Block:
    """``apart``: by its elements. ``named_apart``: the innermost element set apart by its name, or -1."""

    text: str
    article: int
    main: bool
    cut: bool
    apart: bool
    named_apart: int


class Page:
    """One pass over a page: its blocks of text, and on request its styles."""

    def __init__(self, source: str, low: frozenset[int] = frozenset(), styles: bool = False):
        self.low = low
        self.styles: dict[int, tuple[list[int], list, list]] | None = {} if styles else None
        self.blocks: list[Block] = []
        # Elements set apart by a class, id or role: the one around it, the article it is in, and
        # whether it is itself an article, main element or heading.
        self.named: list[tuple[int, int, bool]] = []
        # (what, the article it is in, the innermost element of `named` it is or is in).
        self.marks: list[tuple[str, int, int]] = []
        self.articles = 0
        self.stack: list[Element] = []
        self.open: dict[str, list[int]] = {}
        self.run: list[str] = []
        self._read(source)

    # Elements

    def _push(self, name: str, attributes: dict[str, str]) -> None:
        above = self.stack[-1] if self.stack else None
        element = Element(name)
        named = " ".join(attributes.get(k, "") for k in ("class", "id", "role"))
        element.styled = bool(named.strip())
        label = name + ("." + re.sub(r"\d+", "#", " ".join(sorted(set(named.split())))) if element.styled else "")
        if above is None:
            element.path = xxhash.xxh3_64_intdigest(label) - (1 << 63)
        elif len(self.stack) >= DEEPEST:
            element.path = above.path
        else:
            element.path = xxhash.xxh3_64_intdigest(f"{above.path}/{label}") - (1 << 63)
        in_article = above.article if above is not None else 0
        words = {w.lower() for w in _WORDS.findall(named)} & APART_WORDS if element.styled and name not in ("html", "body", "main") else set()
        is_article = name == "article" or attributes.get("role") == "article"
        is_main = name == "main" or attributes.get("role") == "main"
        if in_article:
            # The head of an article holds its title.
            words.discard("header")
        apart = name in APART and not (in_article and name == "header")
        apart = apart or "hidden" in attributes or attributes.get("aria-hidden") == "true"
        apart = apart or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        element.silent = name in NO_TEXT or (above is not None and above.silent)
        element.apart = apart or (above is not None and above.apart)
        element.named_apart = above.named_apart if above is not None else -1
        if words and not element.apart:
            self.named.append((element.named_apart, in_article, is_article or is_main or name == "h1"))
            element.named_apart = len(self.named) - 1
        element.article = in_article
        if is_article and not in_article and not element.apart:
            self.articles += 1
            element.article = self.articles
        element.main = (above is not None and above.main) or (not element.apart and is_main)
        if not element.apart and (is_article or is_main or name == "h1"):
            self.marks.append(("article", 0, element.named_apart) if is_article else ("main", 0, element.named_apart) if is_main else ("h1", in_article, element.named_apart))
        # Where the whole article is low, its host's pages are copies.
        element.block = above.block if above is not None else False
        if element.article and not in_article and element.path in self.low:
            element.block = True
        may_cut = name not in WHOLE and (element.styled or name in CONTAINERS) and not element.block
        element.cut = (above is not None and above.cut) or (may_cut and element.path in self.low)
        if above is not None and self.styles is not None:
            if not above.children or above.children[-1] != label:
                above.children.append(label)
        self.open.setdefault(name, []).append(len(self.stack))
        self.stack.append(element)

    def _pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            element = self.stack.pop()
            self.open[element.name].pop()
            if self.styles is not None:
                path = [e.path for e in self.stack[:DEEPEST]]
                held = self.styles.setdefault(element.path, (path if len(self.stack) < DEEPEST else path[:-1], [], []))
                held[1].append("|".join(element.children))
                held[2].append("\n".join(element.said))

    def _last(self, *names: str) -> int:
        return max((self.open[n][-1] for n in names if self.open.get(n)), default=-1)

    # Text

    def _say(self, text: str) -> None:
        if not text:
            return
        text = html.unescape(text)
        element = self.stack[-1] if self.stack else None
        if self.styles is not None and element is not None and (plain := " ".join(text.split())):
            element.said.append(plain)
        if element is None or not element.silent:
            where = (element.article, element.main, element.cut, element.apart, element.named_apart) if element else (0, False, False, False, -1)
            if self.run and self.run[0] != where:
                self._end_block()
            if self.run:
                self.run.append(text)
            else:
                self.run = [where, text]

    def _end_block(self) -> None:
        if self.run:
            text = " ".join("".join(self.run[1:]).split())
            if text:
                self.blocks.append(Block(text, *self.run[0]))
            self.run = []

    # Tags

    def _read(self, source: str) -> None:
        at = 0
        end = len(source)
        while at < end:
            found = _TAG.search(source, at)
            if found is None:
                self._say(source[at:])
                break
            self._say(source[at : found.start()])
            at = found.end()
            if found[2] is None:
                continue
            name = found[2].lower()
            if found[1]:
                self._close(name)
            else:
                at = self._open(name, found[3], source, at)
        self._end_block()
        self._pop_to(0)

    def _open(self, name: str, attributes: str, source: str, at: int) -> int:
        if name in BLOCK:
            self._end_block()
            # A block closes an open paragraph of the same cell.
            p = self._last("p")
            if p > self._last("td", "th", "button", "caption"):
                self._pop_to(p)
        if name in CLOSES:
            closed, within = CLOSES[name]
            if (last := self._last(*closed)) > self._last(*within):
                first = min(i for n in closed for i in self.open.get(n, [])[-1:] if i > self._last(*within))
                self._pop_to(min(first, last))
        if name == "br":
            self._say(" ")
        if name in VOID:
            return at
        self._push(name, _attributes(attributes) if attributes.strip() else {})
        if name in RAW:
            stop = re.compile(f"</{name}", re.I).search(source, at)
            inside = source[at : stop.start()] if stop else source[at:]
            if self.styles is not None and name not in ("script", "style"):
                self._say(inside)
            self._pop_to(len(self.stack) - 1)
            if not stop:
                return len(source)
            close = source.find(">", stop.end())
            return close + 1 if close >= 0 else len(source)
        return at

    def _close(self, name: str) -> None:
        if name == "p" and not self.open.get("p"):
            self._end_block()
            return
        if name == "br":
            self._say(" ")
            return
        if not self.open.get(name) or name in ("body", "html"):
            return
        depth = self.open[name][-1]
        if depth < self._last("td", "th", "caption") and name not in ("tr", "table", "tbody", "thead", "tfoot", "td", "th"):
            return
        if name in BLOCK:
            self._end_block()
            self._pop_to(depth)
        elif not any(e.name in BLOCK for e in self.stack[depth + 1 :][:8]):
            # An inline element that a block was opened in stays open, as its text goes on.
            self._pop_to(depth)

    def _counted(self) -> list[bool]:
        """For each of `named`, whether its name does not set it apart after all."""
        page, articles, inside = 0, dict.fromkeys(range(self.articles + 1), 0), [0] * len(self.named)
        for b in self.blocks:
            if b.apart or b.cut:
                continue
            page += len(b.text)
            articles[b.article] += len(b.text)
            at = b.named_apart
            while at >= 0:
                inside[at] += len(b.text)
                at = self.named[at][0]
        holds: list[set[tuple[str, int]]] = [set() for _ in self.named]
        directly: list[set[tuple[str, int]]] = [set() for _ in self.named]
        outside = set()
        for what, article, innermost in self.marks:
            (directly[innermost] if innermost >= 0 else outside).add((what, article))
            at = innermost
            while at >= 0:
                holds[at].add((what, article))
                at = self.named[at][0]
        counted = [False] * len(self.named)
        inner: dict[int, list[int]] = {}
        for k, (around, _, _) in enumerate(self.named):
            inner.setdefault(around, []).append(k)
        # From the outside in, as what a wrapper shows may be all that an element in it holds;
        # beside each other, articles come before what only holds some.
        below = inner.get(-1, [])
        while below:
            shown = []
            for marked in (True, False):
                found = []
                for k in below:
                    _, article, itself = self.named[k]
                    most = 2 * inside[k] > (articles[article] if article else page)
                    if itself == marked and (most or holds[k] - outside):
                        counted[k] = True
                        found.append(k)
                for k in found:
                    outside |= directly[k]
                shown += found
            below = [m for k in shown for m in inner.get(k, [])]
        return counted

    def text(self) -> str:
        counted = self._counted()

        def how_apart(b: Block) -> int:
            at, named = b.named_apart, False
            while at >= 0 and not named:
                named, at = not counted[at], self.named[at][0]
            return 2 if b.apart else int(named)

        levels = [how_apart(b) for b in self.blocks]
        for level in range(3):
            here = [b for b, n in zip(self.blocks, levels) if n == level]
            for choice in (
                lambda b: b.article and not b.cut,
                lambda b: b.article,
                lambda b: b.main and not b.cut,
                lambda b: b.main,
                lambda b: not b.cut,
                lambda b: True,
            ):
                if chosen := [b.text for b in here if choice(b)]:
                    return "\n".join(chosen)
        return ""


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _key(host: str, source: str, page: Page) -> int:
    """Names the page among those of its host: by its main text, if it has any."""
    return xxhash.xxh3_64_intdigest(f"{host}\n{page.text() or source}") - (1 << 63)


def copied_pages(pages: DataFrame, url_column: str, html_column: str) -> np.ndarray:
    """A bit for the low bits of the key of each page that is there more than once."""
    rows = pages.select(host_of(F.col(url_column)).alias("host"), text_of(html_column).alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"page": [_key(host, source, Page(source)) for host, source in zip(batch["host"], batch["html"])]}, dtype="int64")

    again = rows.mapInPandas(run, "page long").groupBy("page").agg(F.count("*").alias("n")).filter("n > 1")
    found = (
        again.select(F.shiftright(F.col("page").bitwiseAND(F.lit(COPY_BITS - 1)), 6).alias("at"), F.expr("shiftleft(1L, cast(page & 63 as int))").alias("bit"))
        .groupBy("at")
        .agg(F.bit_or("bit").alias("word"))
        .collect()
    )
    out = np.zeros(COPY_BITS // 64, np.uint64)
    for at, word in found:
        out[at] = np.uint64(word % 2**64)
    return out


def style_rows(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page and node of its host's style tree: host, page, path, above, shown, said.

    ``page`` is null where the page has no copies on its host.
    """
    rows = pages.select(host_of(F.col(url_column)).alias("host"), text_of(html_column).alias("html"))
    copied = copied_pages(pages, url_column, html_column)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for host, source in zip(batch["host"], batch["html"]):
                page = Page(source, styles=True)
                key = _key(host, source, page)
                place = key & (COPY_BITS - 1)
                name = key if int(copied[place >> 6]) >> (place & 63) & 1 else None
                for path, (above, shown, said) in page.styles.items():
                    out.append((host, name, path, above, xxhash.xxh3_64_intdigest("\n".join(shown)) - (1 << 63), xxhash.xxh3_64_intdigest("\n".join(said)) - (1 << 63)))
            made = pd.DataFrame(out, columns=["host", "page", "path", "above", "shown", "said"])
            made["page"] = pd.array([r[1] for r in out], dtype="Int64")
            yield made

    return rows.mapInPandas(run, "host string, page long, path long, above array<long>, shown long, said long")


def importance(rows: DataFrame) -> DataFrame:
    """Importance of each branch: host, path, pages, worth. Rows that name one ``page`` count once."""
    rows = rows if "page" in rows.columns else rows.withColumn("page", F.lit(None).cast("long"))
    values = rows.select(
        "host", "page", "path", "above", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("shown").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("said").alias("value")))).alias("v")
    )
    of_page = values.groupBy("host", "page", "path", "v.kind", "v.value").agg(F.count("*").alias("n"), F.min("above").alias("above"))
    once = F.when(F.col("page").isNull(), F.col("n")).otherwise(1)
    counts = of_page.groupBy("host", "path", "kind", "value").agg(F.sum(once).alias("n"), F.min("above").alias("above"))
    entropy = F.when(F.col("pages") > 1, (F.log("pages") - F.col("n_log_n") / F.col("pages")) / F.log("pages")).otherwise(1.0)
    nodes = (
        counts.groupBy("host", "path", "kind")
        .agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("n_log_n"), F.min("above").alias("above"))
        .withColumn("worth", entropy)
        .groupBy("host", "path")
        .agg(F.max("worth").alias("worth"), F.max("pages").alias("pages"), F.min("above").alias("above"))
    )
    # A branch is worth its most important node, so every node counts for all above it.
    spread = nodes.select(
        "host", F.explode(F.concat("above", F.array("path"))).alias("branch"), "path", "worth", F.col("pages").alias("n")
    )
    return spread.groupBy("host", F.col("branch").alias("path")).agg(
        F.max("worth").alias("worth"), F.max(F.when(F.col("path") == F.col("branch"), F.col("n"))).alias("pages")
    )


def low_branches(pages: DataFrame, settings: Settings, url_column: str, html_column: str) -> DataFrame:
    """host and the paths of its low branches: branches that enough pages of the host share."""
    worth = importance(style_rows(pages, url_column, html_column))
    low = worth.filter((F.col("worth") < settings.least) & (F.col("pages") >= settings.pages))
    return low.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("low"))


def extracted(pages: DataFrame, settings: Settings = Settings(), url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``pages`` with ``text``."""
    low = stored(low_branches(pages, settings, url_column, html_column), "low-branches")
    host, paths, text = unused(pages, "host"), unused(pages, "low"), unused(pages, "text")

    @F.pandas_udf("string")
    def main_text(source: pd.Series, low: pd.Series) -> pd.Series:
        held: dict[bytes, frozenset] = {}
        out = []
        for page, branches in zip(source, low):
            key = b"" if branches is None else branches.tobytes()
            if key not in held:
                held[key] = frozenset(() if branches is None else branches.tolist())
            out.append(Page(page, held[key]).text())
        return pd.Series(out, dtype=object)

    joined = pages.withColumn(host, host_of(F.col(url_column))).join(low.select(F.col("host").alias(host), F.col("low").alias(paths)), host, "left")
    return joined.withColumn(text, main_text(text_of(html_column), F.col(paths))).select(*[f"`{c}`" for c in pages.columns], text)
