"""Page text and URL filters against brute force."""

import datetime
import time

import numpy as np
import pytest

from plotweave.llm import pages, urls
from plotweave.llm.queries import QUERIES, SQL

PAGES = "page_id long, url string, html string, host string, text string, low int"


def texts(frame, rows):
    made = pages.extracted(frame([(i, u, h, "h", "t", 1) for i, (u, h) in enumerate(rows)], PAGES))
    assert made.columns == ["page_id", "url", "html", "host", "text", "low", "text_"]
    return [r.text_ for r in made.orderBy("page_id").collect()]


def test_given_pages(spark, folder):
    import html
    import re

    sources = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = QUERIES["op9_style_tree_text"](spark, folder).collect()
    assert {r.page_id for r in rows} == set(sources)
    for r in rows:
        article = re.search("<article>(.*?)</article>", sources[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>|<br>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_what_is_apart(frame):
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="no-sidebar">
    <header>Site</header><div class="cookie-notice">We use cookies</div><nav><ul><li>Menu</ul></nav>
    <article class="post"><header><h1>A &amp; B&nbsp;&lt;c&gt;</h1></header><p>One<b> two</b>three <a href="x">four</a>.
    <p>Five<br>six<script>var a = "<p>no</p>";</script> seven<!-- <p>no --><div class="advert">Buy</div><ul><li>Item<li>Next</ul>
    <form><p>Name<input></form><table><tr><td>c1<td><p>c2</table>
    <aside>Aside</aside><section id="comments"><p>First!</section><div class="share-bar">Share</div><footer>By me</footer></article>
    <div class="sidebar">Side</div><footer>End</footer></body></html>"""
    assert texts(frame, [("http://a/1", page)]) == ["A & B <c>\nOne twothree four.\nFive six seven\nItem\nNext\nc1\nc2"]


STORY = "<h1>Head</h1><p>A story of some length.</p><p>It goes on.</p>"
WHOLE_STORY = "Head\nA story of some length.\nIt goes on."


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="layout has-sidebar"><article>{STORY}</article><div class="sidebar">Side</div></div>',
        f'<div class="content-sidebar-wrap"><main>{STORY}</main><div class="widget"><h1>Other</h1>Side</div></div>',
        f'<div id="page" class="page with-header"><div class="banner">Buy</div><div class="col-menu-open">{STORY}</div></div>',
        f'<div class="site-nav-open"><div class="layout has-sidebar"><div class="text">{STORY}</div></div></div><div class="footer">Small</div>',
        '<article><div class="article-header"><h1>Head</h1></div><p>A story of some length.</p><p>It goes on.</p><div class="comments"><h1>Said</h1></div></article>',
        '<article><div class="article-header"><h2>Head</h2></div><p>A story of some length.</p><p>It goes on.</p></article>',
        '<article><h1>Head</h1><div class="with-sidebar"><p>A story of some length.</p><p>It goes on.</p></div><div class="share">Share</div></article>',
        f'<article class="post sidebar-right">{STORY}</article><div class="related"><article class="card">Another story</article></div>',
        f'<div class="layout has-sidebar"><article>{STORY}</article><div class="related"><article>Another story</article></div></div>',
        # Nothing is left but what is set apart.
        '<aside>Head<p>A story of some length.</p><p>It goes on.</p></aside>',
        '<form><p>Head</p><div>A story of some length.</div><div>It goes on.</div></form><script>x</script>',
        '<body style="display: none"><p>Head</p><p>A story of some length.</p><p>It goes on.</p></body>',
    ],
)
def test_class_words_of_wrappers_lose_nothing(frame, page):
    assert texts(frame, [("http://w/1", page)]) == [WHOLE_STORY]


def test_odd_pages(frame):
    rows = [
        ("http://b/1", None),
        ("http://b/2", ""),
        (None, "just &eacute; text"),
        ("nonsense", "<p>open<p>another"),
        ("http://b/3", "<main><p>main</main><p>rest"),
        ("http://b/4", "<div><p>a</div></div></div>b</body>c"),
        # Text after the closing body goes on where the body stopped, as in browsers.
        ("http://b/5", "<article><p>in <b>bold<p>still</article>out"),
        ("http://b/6", "<p>a < b && c > d <"),
        ("http://b/7", "<script>never closed <p>x"),
        ("http://b/8", "<!-- never closed <p>x"),
        ("http://b/9", "<a title='>'>q</a>"),
    ]
    assert texts(frame, rows) == ["", "", "just é text", "open\nanother", "main", "a\nbc", "in bold\nstill", "a < b && c > d <", "", "", "q"]
    assert pages.extracted(frame([], PAGES)).count() == 0


def test_low_branches_go_and_articles_stay(frame):
    shell = '<body><div class="x7">Same everywhere <span>all the time</span></div><div class="y">{}</div><div class="x8">Also the same</div></body>'
    rows = [(f"http://c/{i}", shell.format(f"<p>Text number {i}</p><p class='z9'>Printed by a machine</p>")) for i in range(12)]
    # Copies of an article on one host.
    rows += [("http://d/same", "<body><article><h1>One</h1><p>copy</p></article></body>")] * 8
    # Copies that differ in a word.
    rows += [(f"http://e/{i}", f"<body><article><h1>Head</h1><p>copy</p><p>number {i}</p></article></body>") for i in range(8)]
    made = texts(frame, rows)
    assert made[:12] == [f"Text number {i}" for i in range(12)]
    assert made[12:20] == ["One\ncopy"] * 8
    assert made[20:] == [f"Head\ncopy\nnumber {i}" for i in range(8)]


def test_copies_of_a_page_count_once(frame):
    linked = '<head><link rel="canonical" href="/{}"></head>'
    story = "<body><article><h1>Copy</h1><p>Told often</p><ul><li>Only here</ul><div class='story'>And this</div></article></body>"
    other = "<body><article><h1>Head {0}</h1><p>Number {0}</p></article></body>"
    rows = [(f"http://f/c{i}", linked.format(i) + story) for i in range(5)] + [(f"http://f/{i}", other.format(i)) for i in range(10)]
    # No article, and most pages are copies.
    plain = "<body><p>Day {1}</p><div class='content'><p>{0}</p></div></body>"
    rows += [(f"http://g/c{i}", linked.format(i) + plain.format("Told often", 0)) for i in range(200)]
    rows += [(f"http://g/{i}", plain.format(f"Text number {i}", i)) for i in range(10)]
    made = texts(frame, rows)
    assert made[:5] == ["Copy\nTold often\nOnly here\nAnd this"] * 5
    assert made[5:15] == [f"Head {i}\nNumber {i}" for i in range(10)]
    assert made[15:215] == ["Day 0\nTold often"] * 200
    assert made[215:] == [f"Day {i}\nText number {i}" for i in range(10)]


@pytest.mark.parametrize("piece", ["<p>word ", "<div>word ", "<b>word ", "<li>word ", "<td>word ", "</div>word ", "<b><p>word "])
def test_open_tags_cost_no_more_than_the_page(piece):
    def seconds(n):
        begin = time.process_time()
        text = pages.Page(piece * n).text()
        pages.Page(piece * n, styles=True)
        assert text.count("word") == n
        return time.process_time() - begin

    seconds(100)
    assert seconds(16_000) < 12 * max(seconds(4_000), 0.02)


def test_importance(spark):
    rows = [("h", 1, [], 5, 5)] * 4 + [("h", 2, [1], 5, v) for v in (1, 2, 3, 4)] + [("h", 3, [1], 5, v) for v in (1, 1, 2, 2)] + [("h", 4, [1], 5, 9)]
    found = {r.path: (r.worth, r.pages) for r in pages.importance(spark.createDataFrame(rows, "host string, path long, above array<long>, shown long, said long")).collect()}
    assert found[1] == (1.0, 4) and found[2] == (pytest.approx(1.0), 4) and found[3] == (pytest.approx(0.5), 4) and found[4] == (1.0, 1)


CHANGES = "list string, verdict string, kind string, key string, action string, at timestamp"
START = datetime.datetime(2024, 1, 1)


def day(n):
    return START + datetime.timedelta(days=n)


def brute(url, time, changes):
    import re

    if url is None or time is None or not (m := re.match(r"[A-Za-z][\w+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)[^/?#]*([^?#]*)", url)):
        return (False, 0, "")
    host = m[1].lower().rstrip(".")
    address = (host + m[2]).rstrip("/")
    active = {}
    for name, verdict, kind, key, action, at in sorted((c for c in changes if None not in c), key=lambda c: (c[5], c[4])):
        if at <= time and action in ("add", "remove"):
            active[(name, verdict, kind, key)] = action == "add"
    hit = [
        e for e, on in active.items()
        if on and (e[2] == "domain" and (host == e[3] or host.endswith("." + e[3])) or e[2] == "prefix" and (address == e[3] or address.startswith(e[3] + "/")) or e[2] == "url" and address == e[3])
    ]
    kinds = {e[1] for e in hit}
    return ("block" in kinds and "allow" not in kinds, len(hit), ",".join(sorted({e[0] for e in hit})))


def test_url_filter(spark, frame):
    chosen = np.random.default_rng(1)
    hosts = ["a.com", "www.a.com", "x.www.a.com", "b.org", "aa.com"]
    paths = ["", "/", "/p", "/p/q", "/p/q/r", "/pp", "/p/q?x=/z#y"]
    keys = [("domain", h) for h in ["com", *hosts]] + [("prefix", h + p) for h in hosts for p in ("", "/p", "/p/q")] + [("url", h + p) for h in hosts for p in ("", "/p/q")]
    changes = []
    for _ in range(300):
        kind, key = keys[chosen.integers(len(keys))]
        changes.append((f"l{chosen.integers(3)}", "allow" if chosen.random() < 0.2 else "block", kind, key, ["add", "remove"][chosen.integers(2)], day(int(chosen.integers(400)))))
    # Two changes at one time, a change far ahead of all captures, changes with nulls or of another kind.
    changes += [("l9", "block", "domain", "b.org", "add", day(5)), ("l9", "block", "domain", "b.org", "remove", day(5)), ("l8", "block", "domain", "b.org", "add", day(9999))]
    changes += [(None, "block", "domain", "b.org", "add", day(1)), ("l7", "block", "domain", "b.org", "add", None), ("l7", "block", "domain", "b.org", "drop", day(3))]
    captures = [(i, f"HTTP://user@{hosts[chosen.integers(5)]}:80{paths[chosen.integers(7)]}", day(int(chosen.integers(420))) + datetime.timedelta(seconds=int(chosen.integers(2)) * 5)) for i in range(300)]
    captures += [(1000, None, day(5)), (1001, "http://b.org./", day(7)), (1002, "no url", day(7)), (1003, "http://b.org", None), (1004, "http://b.org", day(7)), (1004, "http://b.org", day(7)), (None, "http://b.org", day(7))]
    given = frame([(*c, "blocked", 7) for c in captures], "page_id long, url string, fetched_at timestamp, blocked string, bucket int")
    made = urls.judged(given, frame(changes, CHANGES))
    assert made.columns == ["page_id", "url", "fetched_at", "blocked", "bucket", "blocked_", "n_entries", "lists"]
    rows = made.collect()
    assert len(rows) == len(captures)
    for r in rows:
        assert (r.blocked_, r.n_entries, r.lists) == brute(r.url, r.fetched_at, changes), r
    assert urls.judged(given, frame([], CHANGES)).filter("blocked_").count() == 0
    assert urls.judged(given.filter("page_id = -5"), frame(changes, CHANGES)).count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(name, spark, duck, folder):
    from tools.check import compare

    problem, _ = compare(duck, QUERIES[name](spark, folder), SQL[name])
    assert not problem
