"""Quality rules against plain counting, single walks down the trees and held-out labels."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plotweave.llm import queries, rules

DOCS = "doc_id long, text string, score double, label long, kept string"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab# \n\t\r\x0b\x1cé \U0001f642.", max_size=50), max_size=6))
def test_counts(texts):
    counts, features = rules.statistics(texts)
    assert [tuple(r) for r in counts.tolist()] == [plain(t) for t in texts]
    assert features.shape == (len(texts), len(rules.FEATURES)) and np.isfinite(features).all()
    alone = [rules.statistics([t])[1][0] for t in texts]
    assert np.array_equal(features, np.array(alone).reshape(features.shape))


def some_trees(seed=3, rows=600):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, 4)).round(1)
    y = (x[:, 0] - x[:, 1] + np.sin(3 * x[:, 2]) + rng.normal(size=rows) > 0).astype(float)
    setting = rules.Settings(trees=25, bins=16)
    return x, y, rules.grow_trees(x, y, [1, -1, 0, -1], setting)


def test_flat_trees_are_the_trees():
    x, y, trees = some_trees()

    def walk(node, row):
        while trees.left[node] != node:
            node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
        return trees.value[node]

    want = [trees.bias + sum(walk(r, row) for r in trees.roots) for row in x]
    assert np.allclose(trees.margin(x), want)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.8
    assert trees.margin(np.zeros((0, 4))).shape == (0,)


def test_constraints_hold():
    x, _, trees = some_trees()
    rng = np.random.default_rng(5)
    for feature, sign in ((0, 1), (1, -1), (3, -1)):
        rows = rng.normal(size=(300, 4))
        more = rows.copy()
        more[:, feature] += rng.exponential(size=300)
        assert (sign * (trees.margin(more) - trees.margin(rows)) >= -1e-12).all()
    assert len({*trees.feature[trees.left != np.arange(len(trees.left))]}) > 2


def test_best_split_is_the_best():
    x, y, _ = some_trees(rows=80)
    setting = rules.Settings(bins=16, leaf_rows=1)
    grower = rules._Grower(x, [0, 0, 0, 0], setting)
    gradient, weight = y - 0.5, np.full(len(y), 0.25)

    def loss(rows):
        return gradient[rows].sum() ** 2 / (weight[rows].sum() + setting.ridge)

    gains = {(f, k): loss(x[:, f] <= edge) + loss(x[:, f] > edge) for f, edges in enumerate(grower.edges) for k, edge in enumerate(edges)}
    feature, edge, _, _ = grower._best(np.arange(len(y)), gradient, weight, -np.inf, np.inf)
    assert gains[feature, edge] == pytest.approx(max(gains.values()))


def test_given_documents(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op13_boosted_quality_rules"](spark, folder).collect()
    assert len(rows) == len(texts)
    unseen = []
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.score >= 0.3)
        if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id in labels and not r.base_failed:
            unseen.append((r.kept, labels[r.doc_id]))
    assert np.mean([k for k, y in unseen if y]) > 0.97
    assert np.mean([k == bool(y) for k, y in unseen]) > 0.95


def test_odd_tables(spark, frame):
    good = [(i, f"A calm sentence about place {i}, the weather there and people who live well. " * 5, 0.5, 1, "k") for i in range(60)]
    bad = [(100 + i, f"BUY!! NOW {i} $$$ &&& WIN!! ### %%% CLICK!! " * 9, 0.5, 1, "k") for i in range(60)]
    odd = [(None, None, None, None, None), ((1 << 60) + 1, "", 0.1, 1, "k"), (501, "x" * 400_000, 0.1, 1, "k"), (3, "again " * 99, 0.1, 1, "k"), (3, "again " * 99, 0.1, 1, "k")]
    docs = frame(good + bad + odd, DOCS)
    labels = frame([(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(60)] + [(7, None, None), (8, 5, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    trees = rules.fit(docs, labels)
    rows = rules.judged(docs, trees).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == Counter(
        (d[0], *plain(d[1])) for d in good + bad + odd
    )
    for r in rows:
        assert not (r.base_failed and r.kept)
    free = rules.Settings(least_words=0, repeat_percent=100)
    kept = {r.doc_id for r in rules.judged(docs, trees, free).filter("kept").collect()}
    assert set(range(60)) - {3} <= kept and not kept & set(range(100, 160))
    assert rules.judged(frame([], DOCS), trees).count() == 0
    with pytest.raises(ValueError):
        rules.fit(docs, labels.filter("quality = 1"))
