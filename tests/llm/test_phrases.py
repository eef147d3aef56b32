"""Phrase mining against plain counting."""

import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from plotweave.llm import phrases

DOCS = "doc_id long, text string, lang string, phrase string, n long, weight string"


def brute(rows, least, percent, top):
    counts = {}
    for text, lang in rows:
        f = counts.setdefault("und" if lang is None else lang, Counter())
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            f.update(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        kept = []
        for p, a in found.items():
            longer = [c for q, c in found.items() if len(q) > len(p) and p in (q[:2], q[1:])]
            if any(100 * c >= percent * a for c in longer):
                continue
            score, _, left, right = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return out


def mined(docs, setting):
    rows = phrases.collocations(docs, setting).collect()
    made = {(r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows}
    assert len(made) == len(rows)
    return made


def test_against_plain_counting(spark, frame):
    rng = random.Random(7)
    vocabulary = ["a", "B", "b", "été", "c d", "x\x1cy", "É", "#", "long" * 9] + [f"w{i}" for i in range(20)]
    line = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, None, None, "p", 1, "w"), (None, "", "en", None, None, None), (2, " ,;. \n\t", "de", "", 0, "")]
    for i in range(160):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        text = "".join(w + rng.choice([" ", "  ", "\t", ", ", ".\n", " ", " "]) for w in words)
        rows.append((i, text + (f"! {line} end{i % 2}\r" if i % 5 == 0 else ""), rng.choice(["en", "en", None, "und", ""]), "p", 2, "w"))
    rows += [(7, "same row same row same row", "fr", "p", 1, "w")] * 12 + [(8, "loop " * 30_000, "fr", "p", 1, "w")]
    docs = frame(rows, DOCS)
    want = [(r[1], r[2]) for r in rows]
    for setting in (phrases.Settings(), phrases.Settings(least=2, covered_percent=80, top=40, block=300, bitmap_bits=32_768)):
        assert mined(docs, setting) == brute(want, setting.least, setting.covered_percent, setting.top)


def test_tables_without_phrases(spark, frame):
    assert mined(frame([], DOCS), phrases.Settings()) == set()
    assert mined(frame([(1, None, None, None, None, None), (2, "lonely", "en", None, None, None)], DOCS), phrases.Settings(least=1)) == set()


def test_paths_hold_whole_passages(spark, frame):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"
    rows = [(i, f"start{i} {passage} stop{i}", "en", None, None, None) for i in range(12)]
    rows += [(20 + i, "pre gamma delta epsilon", "en", None, None, None) for i in range(12)]
    found = phrases.paths(phrases.counted(frame(rows, DOCS))).collect()
    made = {(" ".join(r.words), r.weight, r.first_count, r.last_count) for r in found}
    assert made == {
        ("alpha beta gamma delta", 12, 12, 24),
        ("pre gamma delta", 12, 12, 24),
        ("gamma delta epsilon", 24, 24, 24),
        ("delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma", 12, 24, 12),
    }


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAb. \n\t,é", max_size=60).map(str.encode), max_size=6), st.integers(1, 50))
def test_flows_are_counts(texts, most):
    total = Counter()
    for block in phrases.blocks(texts, most):
        graph = phrases.LocalGraph(block)
        name = [w.decode() for w in graph.words]
        for w, n in zip(name, graph.word_flow):
            total[(w,)] += int(n)
        for x, y, n in zip(graph.first, graph.second, graph.flow):
            total[(name[x], name[y])] += int(n)
        for h, t, w, n in zip(graph.edge_head, graph.edge_tail, graph.edge_word, graph.weight):
            assert graph.first[t] == graph.second[h] and graph.second[t] == w
            total[(name[graph.first[h]], name[graph.second[h]], name[w])] += int(n)
    want = Counter()
    for text in texts:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text.decode())):
            words = re.findall(r"[^\x20\x09]+", piece)
            want.update(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    assert total == want
