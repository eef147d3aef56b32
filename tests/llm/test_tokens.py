"""Encoding, the token store and packing against plain loops over the same tokenizers."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plotweave.llm import encoding, packing, token_store
from plotweave.llm.common import new_folder

DOCS = "doc_id long, text string, place string, ids string"
ROWS = [
    (5, "The cat  sat.\nOn the mat, didn't it? ", "x", None),
    (2, None, None, None),
    (9, "", "", "z"),
    (None, "no id", "y", "z"),
    (7, "same row", "y", "z"),
    (7, "same row", "y", "z"),
    (3, " lead %%% 123 été*** <|endoftext|> ñandú 日本 🙂 " * 700, "y", "z"),
    (6, "a <|endoftext|> b<|startoftext|><|ENDOFTEXT|> <|end of|>", "y", "z"),
    (4, "tail   \t spaces\x1c odd\u0085 ones ", "y", "z"),
]


def plain(name, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_tokenizer(name, monkeypatch):
    monkeypatch.setattr(encoding, "_KNOWN_CHUNKS", 300)
    monkeypatch.setattr(encoding, "_RECENT_CHUNKS", 200)
    made, want = encoding.Encoder(public_tokenizers.path(name), 7), plain(name, 7)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{'%%' * (i % 3)}" for i in range(600)]
    texts = [r[1] or "" for r in ROWS] + [" ".join(words[i:] + words[:i]) for i in range(0, 600, 50)] + [" ", "  a", "a\n b", "'s 's", "ΑΣ ́a", "x" * 3000 + ", y " + "ab" * 900]
    for _ in range(2):
        for part in (texts[:9], texts[9:]):
            ids, lengths = made.encode(part)
            assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [want(t).tolist() for t in part]
    # Between calls the limits hold, and long chunks are not kept.
    for known in (made.heads, made.tails, made.marks):
        assert len(known) <= 500 and all(len(c) <= encoding._KEPT_LENGTH for c in known)


def test_strings_of_added_tokens_become_their_ids():
    word, byte = (encoding.Encoder(public_tokenizers.path(n), 7) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    assert word.encode(["a <|endoftext|> b"])[0].tolist() == [320, 49407, 321, 7]
    assert byte.encode(["a <|endoftext|> b"])[0].tolist() == [64, 220, 50256, 275, 7]
    assert byte.encode(["<|", "<|endoftext|>", "", "a"])[1].tolist() == [2 + (byte.encode(["<|"])[1][0] == 3), 2, 1, 2]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60), st.integers(0, 2**16), st.integers(0, 2**64 - 1)), max_size=300), st.sampled_from([1, 7, 64, 1024]))
def test_simple8b_round_trip(values, block):
    given_values = np.array(values, np.uint64)
    assert np.array_equal(token_store.decode_blocks(*token_store.encode_blocks(given_values, block)), given_values)


def test_words_are_full():
    words, _, _, _ = token_store.encode_blocks(np.ones(120, np.uint64))
    assert len(words) == 2
    words, _, _, escaped = token_store.encode_blocks(np.full(3, 2**61, np.uint64))
    assert len(words) == 6 and escaped.all()


def test_payload_is_checked():
    with pytest.raises(ValueError):
        token_store.from_payload(b"nothing of the kind")


def stored_rows(spark, docs):
    path = new_folder(spark, "test-store")
    token_store.write_store(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_store.read_documents(spark, path, with_ids=True).collect()


def test_store(spark, frame):
    want = plain("word_bpe_49k.json", 2)
    rows = sorted(stored_rows(spark, frame(ROWS, DOCS)), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 2, 3, 4, 5, 6, 7, 7, 9]
    texts = {r[0]: r[1] for r in ROWS}
    at = 0
    for row in rows:
        ids = want(texts[row.doc_id])
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        assert bytes(row.ids) == ids.tobytes()
        at += len(ids)


def test_empty_store(spark, frame):
    assert stored_rows(spark, frame([], DOCS)) == []


def check_packed(rows, texts, limits):
    want = plain("byte_bpe_50k.json", 1)
    by_doc, by_sequence = {}, {}
    for row in rows:
        by_doc.setdefault(row.doc_id, []).append(row)
        by_sequence.setdefault(row.sequence_id, []).append(row)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids, copies = want(texts[doc_id][0]), texts[doc_id][1]
        covered = np.zeros(len(ids), int)
        for p in pieces:
            assert bytes(p.ids) == ids[p.start : p.start + p.length].tobytes() and p.doc_tokens == len(ids) and p.length > 0
            covered[p.start : p.start + p.length] += 1
        assert (covered == copies).all()
    for pieces in by_sequence.values():
        total = sum(p.length for p in pieces)
        assert total <= limits.tokens and len(pieces) <= limits.segments and sum(p.loss_tokens for p in pieces) <= limits.loss
        assert total == limits.tokens or total & (total - 1) == 0
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
    return by_sequence


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 3, 64, 4), packing.Limits(64, 2, 10, 3), packing.Limits(1, 1, 1, 1)])
def test_packing(frame, limits):
    rows = packing.pack(frame(ROWS, DOCS), public_tokenizers.path("byte_bpe_50k.json"), 1, limits).collect()
    texts = {}
    for doc_id, text, _, _ in ROWS:
        texts[doc_id] = (text, texts.get(doc_id, (None, 0))[1] + 1)
    check_packed(rows, texts, limits)


def test_loss_starts_late(frame):
    rows = [(i, "word " * (20 + i), 15) for i in range(30)]
    limits = packing.Limits(64, 8, 30, 8)
    made = packing.pack(frame(rows, "doc_id long, text string, prompt long"), public_tokenizers.path("byte_bpe_50k.json"), 1, limits, loss_from="prompt").collect()
    check_packed(made, {r[0]: (r[1], 1) for r in rows}, limits)
    assert sum(r.loss_tokens for r in made) == sum(max(0, len(plain("byte_bpe_50k.json", 1)(r[1])) - 15) for r in rows)


def bytes_held(packer):
    """Of all arrays that waiting documents keep alive."""
    held = {}
    for item in packer.items:
        if item is not None:
            array = item[0][1]
            while array.base is not None:
                array = array.base
            held[id(array)] = array.nbytes
    return sum(held.values())


@pytest.mark.parametrize("limits", [packing.Limits(64, 4, 64, 8), packing.Limits(64, 4, 10, 8)])
def test_waiting_documents_hold_a_window_of_ids(limits):
    """Long documents, of which only a tail waits once their full runs were given out."""
    packer = packing._Packer(limits)
    given_out = {}

    def count(sequences):
        for pieces in sequences:
            for doc, _, length in pieces:
                given_out[doc[0]] = given_out.get(doc[0], 0) + length

    for doc_id in range(40):
        n = 20_000 + doc_id
        count(packer.add((doc_id, np.arange(n, dtype="<u4"), 0, n, 0)))
        assert bytes_held(packer) <= 2 * limits.window * limits.tokens * 4
    count(packer.finish())
    assert given_out == {i: 20_000 + i for i in range(40)}


def test_the_heaviest_fitting_item_is_taken():
    """Against the heuristic item by item; each limit of all that wait lies in one array of its own."""
    rnd = random.Random(5)
    limits = packing.Limits(50, 3, 40, 16)
    packer = packing._Packer(limits)
    assert all(part.flags.c_contiguous for part in packer.demand) and len(packer.demand) == 3
    for slot in range(16):
        n = rnd.randint(1, 49)
        packer._wait(packer.free.pop(), (slot, np.arange(n, dtype="<u4"), rnd.randint(0, 9), n, 0), 0)
    while waiting := [i for i in packer.items if i]:
        room, want = [limits.tokens, limits.segments, limits.loss], []
        left = {doc[0]: (length, 1, packer._loss(doc, start, length)) for doc, start, length in waiting}
        scale = [1 / x for x in room]
        while left and room[1] > 1:
            fits = [d for d, x in left.items() if all(a <= b for a, b in zip(x, room))]
            if not fits:
                break
            gain = {d: sum(a * b * c * c for a, b, c in zip(left[d], room, scale)) for d in fits}
            # The first of equally heavy items is not told here, so any of them is right.
            best = max(gain.values())
            want.append({d for d in fits if gain[d] > best - 1e-9})
            room = [a - b for a, b in zip(room, left.pop(min(want[-1])))]
            if len(want[-1]) > 1:
                break
        before = set(left).union(*want)
        made = [doc[0] for pieces in packer._fill() for doc, _, _ in pieces]
        taken = list(dict.fromkeys(made))
        assert set(taken) <= before and all(d in ties for d, ties in zip(taken, want))


def test_long_documents_are_packed_whole(frame):
    rows = [(i, "word " * (150 + 7 * i), 40) for i in range(30)]
    texts = {r[0]: (r[1], 1) for r in rows}
    for limits in (packing.Limits(64, 3, 64, 4), packing.Limits(64, 3, 10, 2)):
        made = packing.pack(frame(rows, "doc_id long, text string, prompt long"), public_tokenizers.path("byte_bpe_50k.json"), 1, limits, loss_from="prompt")
        check_packed(made.collect(), texts, limits)


def test_nothing_to_pack(frame):
    assert packing.pack(frame([], DOCS), public_tokenizers.path("byte_bpe_50k.json"), 1).count() == 0
