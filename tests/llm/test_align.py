"""Alignment by shared cuts against a plain walk over both token lists."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plotweave.llm import align, queries

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, n_a string, links long, `groups` string"
ROWS = [
    ((1 << 60) + 1, "The cat  sat.\nOn the mat, didn't it? ", "x", 1, None),
    (None, "no id here", None, None, None),
    ((1 << 60) + 3, None, "", None, "z"),
    (4, "", "", None, "z"),
    (5, "holds ▁ itself", "", None, "z"),
    (6, "a <|endoftext|> b </s> <s> <unk> <0x41>", "", None, "z"),
    (7, "same row, same row", "", None, "z"),
    (7, "same row, same row", "", None, "z"),
    (8, " lead %%% 123 été*** ñandú 日本語のテキスト 🙂🙂 \x00 \t\t end   " * 300, "", None, "z"),
    (9, "=" * 5000 + " " * 77 + "-" * 999, "", None, "z"),
    (10, "nfc é Å \xa0 　 wide", "", None, "z"),
]


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(PATHS[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        marks = align.byte_level_alphabet()
        self.of_a = lambda n: bytes(marks[c] for c in self.a.id_to_token(n))
        self.of_b = lambda n: (lambda p: bytes([int(p[1:-1], 16)]) if self.b.is_byte(n) else p.replace("▁", " ").encode())(self.b.id_to_piece(n))

    def groups(self, text):
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        bytes_a, bytes_b = [self.of_a(n) for n in a], [self.of_b(n) for n in b]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            return []
        out, at_a, at_b, i, j, start_i, start_j = [], 0, 0, 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                at_a += len(bytes_a[i])
                i += 1
            else:
                at_b += len(bytes_b[j])
                j += 1
            if at_a == at_b:
                out.append((a[start_i:i], b[start_j:j], at_a))
                start_i, start_j = i, j
        return out


def brute(rows):
    plain = Plain()
    found = [(r[0], plain.groups(r[1])) for r in rows]
    counts = Counter((a[-1], b[-1]) for _, groups in found for a, b, _ in groups)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for doc_id, groups in found:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b, _ in groups)
        n = [counts[a[-1], b[-1]] for a, b, _ in groups]
        out.append(
            (
                doc_id,
                sum(len(a) for a, _, _ in groups),
                sum(len(b) for _, b, _ in groups),
                len(groups),
                len(groups),
                sum(x == best[b[-1]] for x, (_, b, _) in zip(n, groups)),
                sum(n),
                hashlib.sha256(text.encode()).hexdigest() if groups else "",
            )
        )
    return Counter(out)


def test_against_a_plain_walk(spark, frame):
    made = align.alignment_digests(frame(ROWS, DOCS), *PATHS)
    assert Counter(map(tuple, made.collect())) == brute(ROWS)
    assert align.alignment_digests(frame([], DOCS), *PATHS).count() == 0


def test_given_documents(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, queries.QUERIES["op12_shared_cut_alignment"](spark, folder).collect())) == brute(rows)


def test_spans_cover_the_text(spark, frame):
    plain = Plain()
    for row in align.aligned(frame(ROWS, DOCS), *PATHS, spans=True).collect():
        text = next(r[1] for r in ROWS if r[0] == row.doc_id)
        want = plain.groups(text)
        assert [(list(g.a), list(g.b), g.end) for g in row.groups] == want
        assert [g.start for g in row.groups] == [0, *(e for _, _, e in want)][: len(want)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 5), max_size=25), st.lists(st.integers(1, 5), max_size=25)), max_size=6))
def test_groups_are_the_shared_ends(texts):
    ends_a, ends_b, tops_a, tops_b, at, want = [], [], [], [], 0, []
    for a, b in texts:
        size = max(sum(a), sum(b)) + 1 if a or b else 0
        if size:
            a, b = a + [size - sum(a)], b + [size - sum(b)]
        here_a, here_b = at + np.cumsum(a), at + np.cumsum(b)
        want += sorted({*here_a.tolist()} & {*here_b.tolist()})
        ends_a += here_a.tolist()
        ends_b += here_b.tolist()
        tops_a.append(len(ends_a))
        tops_b.append(len(ends_b))
        at += size
    ends_a, ends_b = np.array(ends_a, np.int64), np.array(ends_b, np.int64)
    lasts_a, lasts_b = align.groups_of(ends_a, ends_b, np.array(tops_a, np.int64), np.array(tops_b, np.int64))
    assert ends_a[lasts_a].tolist() == want and ends_b[lasts_b].tolist() == want


def test_linkable_holds_every_suffix():
    a, b = [b"ab", b"b", b"xab", b""], [b"b", b"ab", b"b", b"zxab", b"c"]
    want = {x * 5 + y for x, s in enumerate(a) for y, t in enumerate(b) if s and t and (s.endswith(t) or t.endswith(s))}
    assert set(align.linkable(a, b).tolist()) == want


@pytest.mark.parametrize("path", PATHS[:1])
def test_alphabet(path):
    assert sorted(align.byte_level_alphabet().values()) == list(range(256))
    assert len(align.linkable(align.byte_level_tokens(path), align.piece_tokens(Plain().b))) < 400_000
