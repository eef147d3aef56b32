"""Exact and near duplicates against brute force."""

import re
from collections import Counter

import numpy as np
import pytest

from plotweave.llm import decontaminate, exact, minhash
from plotweave.llm.ragged import mixed

DOCS = "doc_id long, text string, place string, text_key string, n_bytes int"


def words(n, seed=0):
    chosen = np.random.default_rng(seed)
    return ["".join(chosen.choice(list("abcdefgh"), 5)) for _ in range(n)]


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


EXACT = [
    (4, "a  b\tc", "p", None, 1),
    (1, "a b c", None, "k", None),
    (9, "a\x0bb\nc", "p", "k", 1),
    (9, "a b c ", "p", "k", 1),
    (3, None, "p", "k", 1),
    (8, "", "p", "k", 1),
    (None, "alone here", "p", "k", 1),
    (None, "alone here", "p", "k", 1),
    (6, "again", "p", "k", 1),
    (6, "again", "p", "k", 1),
    (7, "x" * 300_000, "p", "k", 1),
    (5, "x" * 300_000, "p", "k", 1),
    (2, "x" * 299_999, "p", "k", 1),
]


@pytest.mark.parametrize("most_bytes", [1, 20, 10**9])
def test_owners(frame, most_bytes):
    want = {}
    for doc_id, text, *_ in EXACT:
        want.setdefault(normal(text), []).append(doc_id)
    rows = exact.owners(frame(EXACT, DOCS), most_bytes=most_bytes).collect()
    found = Counter((r.n_bytes, r.keep_id, r.group_size) for r in rows)
    assert found == Counter(
        (len(t.encode()), min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in want.items()
    )


def test_groups_and_rows_that_stay(frame):
    docs = frame(EXACT, DOCS)
    rows = exact.groups_of(docs).collect()
    assert len(rows) == len(EXACT)
    kept = [r for r in rows if r.kept]
    assert len(kept) == len({normal(r[1]) for r in EXACT})
    stays = exact.first_of_each(docs)
    assert stays.columns == docs.columns
    assert sorted(normal(r.text) for r in stays.collect()) == sorted({normal(r[1]) for r in EXACT})
    assert {normal(r.text): r.doc_id for r in stays.collect()}["a b c"] == 1


def test_trie():
    trie = exact.Trie()
    keys = [b"", b"a", b"abc", b"abd", b"ab", b"b", b"abcdef", b"abc", b""]
    for at, key in enumerate(keys):
        trie.insert(key, (False, -at, at))
    found = {k: (o, n) for k, o, n in trie.drain()}
    assert found == {k: ((False, -max(i for i, x in enumerate(keys) if x == k), max(i for i, x in enumerate(keys) if x == k)), keys.count(k)) for k in keys}
    assert trie.size == 0 and list(trie.drain()) == []


def test_spilled_tries_lose_nothing():
    chosen = np.random.default_rng(5)
    keys = [bytes(chosen.integers(97, 99, chosen.integers(0, 8)).astype(np.uint8)) for _ in range(400)]
    trie, out = exact.Trie(), Counter()
    for at, key in enumerate(keys):
        trie.insert(key, (False, at, at))
        if trie.size > 20:
            out.update({k: n for k, _, n in trie.heaviest()})
    out.update({k: n for k, _, n in trie.drain()})
    assert out == Counter(keys)


def test_empty_tables(frame):
    docs = frame([], DOCS)
    assert exact.groups_of(docs).count() == 0 and exact.first_of_each(docs).count() == 0
    assert minhash.classes(docs).count() == 0 and minhash.first_of_each(docs).count() == 0


def test_signatures_are_unbiased():
    chosen = np.random.default_rng(0)
    errors = []
    for _ in range(150):
        runs = mixed(chosen.integers(0, 2**63, 60).astype(np.uint64))
        a = chosen.geometric(0.4, 60)
        b = np.where(chosen.random(60) < chosen.random() * 0.6, chosen.integers(1, 9, 60), a)
        signs = minhash.signatures(np.tile(runs, 2), np.concatenate([a, b]), np.repeat([0, 1], 60), 2, 120)
        # A signature doesn't depend on what is computed beside it.
        assert np.array_equal(signs[0], minhash.signatures(runs, a, np.zeros(60, int), 1, 120)[0])
        errors.append((signs[0] == signs[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.01


def bag(text):
    found = re.findall(r"\w+", (text or "").lower())
    return Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4)) if len(found) >= 5 else Counter([tuple(found)])


def brute_classes(rows):
    bags = [bag(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            least, most = (bags[i] & bags[j]).total(), (bags[i] | bags[j]).total()
            if least >= 0.8 * most:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return label


def near_rows():
    rows, doc_id = [], 100
    for seed in range(12):
        base = words(60 + 30 * seed, seed)
        for edit in range(8):
            text = list(base)
            for at in np.random.default_rng(edit).choice(len(text), edit * len(text) // 80, replace=False):
                text[at] = f"edit{edit}{at}"
            rows.append((doc_id, " ".join(text), None, None, None))
            doc_id -= 1
    # A chain: each is near to the next, the ends are not near to each other.
    base = words(400, 99)
    for step in range(10):
        rows.append((doc_id, " ".join(base[step * 16 : step * 16 + 200]), None, None, None))
        doc_id -= 1
    rows += [(900, "Same, WORDS here", "p", "k", 1), (901, "same words here!", "p", "k", 1), (902, None, "p", "k", 1), (903, "...", "p", "k", 1)]
    rows += [(None, "one two three four five six", "p", "k", 1), (904, "one two three four five six", "p", "k", 1), (904, "one two three four five six", "p", "k", 1)]
    rows += [(905, " ".join(["again"] * 500), "p", "k", 1), (906, " ".join(["again"] * 450), "p", "k", 1), (907, " ".join(["again"] * 200), "p", "k", 1)]
    return rows


def test_near_duplicates(frame):
    rows = near_rows()
    want = {}
    for row, label in zip(rows, brute_classes(rows)):
        want.setdefault(label, []).append(row)
    docs = frame(rows, DOCS)
    found = minhash.classes(docs).collect()
    assert len(found) == len(rows) and sum(r.kept for r in found) == len(want)
    expected = Counter((min((r[0] for r in rs if r[0] is not None), default=None), len(rs)) for rs in want.values() for _ in rs)
    assert Counter((r.class_id, r.class_size) for r in found) == expected
    stays = minhash.first_of_each(docs)
    assert stays.columns == docs.columns and stays.count() == len(want)


def test_links_across_a_band(frame):
    """A large group, and strays that are near to some of it but not to its pivot."""
    base = words(300, 7)
    rows = []
    for i in range(120):
        text = list(base)
        for at in range(0, 3 * (i % 12), 3):
            text[at * 7 % 300] = f"x{at}"
        rows.append((i, " ".join(text), None, None, None))
    want = len(set(brute_classes(rows)))
    assert sum(r.kept for r in minhash.classes(frame(rows, DOCS)).collect()) == want


def test_components(spark):
    links = [(b"a", b"b"), (b"b", b"c"), (b"x", b"y"), (b"d", b"c"), (b"d", b"e")] + [(b"n%03d" % i, b"n%03d" % (i + 1)) for i in range(40)]
    found = {bytes(r.text_key): bytes(r.label) for r in minhash.components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert {k for k, v in found.items() if v == b"a"} == {b"a", b"b", b"c", b"d", b"e"}
    assert found[b"y"] == b"x" and {found[b"n%03d" % i] for i in range(41)} == {b"n000"}


PLACED = {
    "exact": (exact, lambda docs, items: exact.first_of_each(docs)),
    "minhash": (minhash, lambda docs, items: minhash.first_of_each(docs)),
    "decontaminate": (decontaminate, lambda docs, items: decontaminate.clean_documents(docs, items)),
}


@pytest.mark.parametrize("name", sorted(PLACED))
def test_rows_keep_their_number_when_scans_are_split_anew(spark, frame, monkeypatch, name):
    """The split of a scan follows the number of cores, which may change between two jobs."""
    module, build = PLACED[name]
    rows = [(i, " ".join(words(120, i // 2)), "p", "k", i) for i in range(40)]
    docs = frame(rows, DOCS)
    items = frame([(1, rows[6][1]), (2, rows[20][1])], "item_id long, text string")
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    splits = [("128m", "4m"), ("1500b", "1b"), ("700b", "1b")]
    turn = 0

    def resplit(df, label, write=module.stored):
        nonlocal turn
        made = write(df, label)
        turn += 1
        for k, v in zip(keys, splits[turn % 3]):
            spark.conf.set(k, v)
        return made

    monkeypatch.setattr(module, "stored", resplit)
    try:
        made = build(docs, items)
        for k, v in zip(keys, splits[2]):
            spark.conf.set(k, v)
        ids = sorted(r.doc_id for r in made.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert ids == ([i for i in range(40) if i // 2 not in (3, 10)] if name == "decontaminate" else list(range(0, 40, 2)))
