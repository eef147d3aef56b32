"""Quality, decontamination, token counts and chat against brute force, round trips and held-out rows."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer, models, pre_tokenizers

from plotweave.llm import chat, decontaminate, quality, queries, viterbi

DOCS = "doc_id long, text string, place string, item string, score double, label int"


def test_held_out_accuracy(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.QUERIES["op6_compression_quality"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    unseen = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in unseen]) > 0.93
    assert np.mean([p for p, y in unseen if y]) > 0.97


def test_quality_of_odd_tables(spark, frame):
    good = [(i, f"A calm sentence about place {i}, the weather there and people who live well.", "", "", 0.5, 1) for i in range(60)]
    bad = [(100 + i, f"BUY!! NOW!! {i} $$$ &&& WIN!! WIN!! ### %%% CLICK!!", "", "", 0.5, 1) for i in range(60)]
    odd = [(None, None, None, None, None, None), (500, "", "", "", 0.1, 1), (501, "x" * 400_000, "", "", 0.1, 1), (3, "again", "", "", 0.1, 1)]
    docs = frame(good + bad + odd, DOCS)
    labels = frame([(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(60)] + [(7, None, None), (8, 5, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    kept = quality.good_documents(docs, model)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(60)) <= ids and not ids & set(range(100, 160))
    assert quality.good_documents(frame([], DOCS), model).count() == 0
    with pytest.raises(ValueError):
        quality.fit(docs, labels.filter("quality = 1"))


def test_scores_are_those_of_whole_texts(spark, frame):
    chosen = np.random.default_rng(5)
    words = [[f"{c}{w}" for w in ("alder", "brook", "cloud", "drift", "ember", "field")] for c in "xyz"]
    texts = [(i, " ".join(chosen.choice(words[i % 2], 2000 if i % 7 else 9000)), "", "", 0.0, 1) for i in range(120)]
    # Bad text far behind a good beginning.
    texts += [(200 + i, texts[0][1][:17_000] + "\u0000\u0001%$#@!~" * 3000, "", "", 0.0, 1) for i in range(40)]
    labels = frame([(i, i % 2, 0) for i in range(120)] + [(200 + i, 0, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    docs = frame(texts, DOCS)
    model = quality.fit(docs, labels)
    scored = {r[0]: r[1] for r in docs.select("doc_id", quality.score(model)(docs.text)).collect()}
    terms, good = [], []
    for doc_id, text, *_ in texts:
        data = text.encode()
        pieces = [data[i : i + 2048] for i in range(0, len(data), 2048)]
        sizes = []
        for held in (model.good, model.bad, None):
            extra = {"dict_data": zstandard.ZstdCompressionDict(held), "write_dict_id": False, "level": 3} if held else {"level": 1}
            compressor = zstandard.ZstdCompressor(write_content_size=False, write_checksum=False, **extra)
            sizes.append(sum(len(compressor.compress(p)) for p in pieces))
        a, b, c = sizes
        terms.append([np.tanh((b - a) / len(data) * 20), np.tanh((b - a) / (a + b) * 10), min(np.log(c / len(data)) + 1, 0), 1])
        good.append(doc_id % 2 if doc_id < 200 else 0)
        assert abs(scored[doc_id] - 1 / (1 + np.exp(-np.dot(terms[-1], model.curve)))) < 0.02
    assert all((scored[i] >= 0.3) == bool(y) for (i, *_), y in zip(texts, good))


def brute_tiles(a, b, shortest):
    used_a, used_b, total = [False] * len(a), [False] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not used_a[i + k] and not used_b[j + k]:
                    k += 1
                best = max(best, (k, -i, -j))
        k, i, j = best[0], -best[1], -best[2]
        if k < shortest:
            return total
        used_a[i : i + k] = used_b[j : j + k] = [True] * k
        total += k


def test_tiles_are_greedy():
    chosen = np.random.default_rng(3)
    for _ in range(80):
        a = chosen.integers(0, 4, 40).astype(np.uint64)
        b = np.concatenate([np.roll(a[10:30], chosen.integers(20)), chosen.integers(0, 4, 10).astype(np.uint64)])
        found = decontaminate.tiles([a], b, 3)
        assert sum(t[3] for t in found) == brute_tiles(a.tolist(), b.tolist(), 3)
        for _, at, p, n in found:
            assert np.array_equal(a[at : at + n], b[p : p + n])


def passage(seed, n=30):
    chosen = np.random.default_rng(seed)
    return ["".join(chosen.choice(list("abcdefgh"), 6)) for _ in range(n)]


def test_leaks(frame):
    items = [(1, " ".join(passage(1)), "e"), (2, " ".join(passage(2)), "e"), (3, None, "e"), (4, "of the", "e"), (5, " ".join(passage(2)), "e"), (None, " ".join(passage(6, 5)), None)]
    filler = " ".join(passage(50, 400))
    one, two = passage(1), passage(2)
    rows = [
        (10, filler + " " + " ".join(one) + " " + filler),
        (11, filler + " " + " ".join(one[20:] + ["between"] * 9 + one[8:20] + ["and"] + one[:8]).upper().replace(" ", ", ")),
        (12, filler),
        (13, " ".join(one[:10])),
        (14, None),
        (15, ""),
        (16, " ".join(two[:16])),
        (17, (filler + " ") * 200 + " ".join(two) + (" " + filler) * 200),
        (18, " ".join(one + two)),
        (19, "of the " * 50),
        (20, " ".join((two + ["x"]) * 30)),
        (21, " ".join(passage(6, 5))),
        (None, " ".join(one)),
    ]
    docs = frame([(*r, "p", "i", 0.5, 1) for r in rows + rows[:1]], DOCS)
    benchmark = frame(items, "item_id long, text string, place string")
    found = decontaminate.judged(docs, benchmark).collect()
    assert len(found) == len(rows) + 1
    leaked = {r.doc_id for r in found if r.contaminated}
    assert leaked == {10, 11, 16, 17, 18, 20, 21, None}
    assert {r.doc_id: (r.n_items, r.item_id) for r in found if r.contaminated} == {
        10: (1, 1), 11: (1, 1), 16: (2, 2), 17: (2, 2), 18: (3, 1), 20: (2, 2), 21: (1, None), None: (1, 1),
    }
    clean = decontaminate.clean_documents(docs, benchmark)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {12, 13, 14, 15, 19}
    assert decontaminate.judged(frame([], DOCS), benchmark).count() == 0
    assert decontaminate.judged(docs, benchmark.filter("item_id > 99")).filter("contaminated").count() == 0


@pytest.mark.parametrize("stretch", [5, 16, 17, 4096])
def test_cut_stretches_lose_no_coverage(frame, stretch):
    one, two, other = passage(1, 300), passage(2, 40), passage(3, 30)
    texts = {1: one, 2: other + two + one[:150] + two[7:20] + one[140:], 3: one[:9] + other + one[5:33]}
    rows = frame([(i, " ".join(t)) for i, t in texts.items()], "place long, text string")
    items = {1: one, 2: two}
    benchmark = frame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    found = decontaminate.matches(rows, benchmark, decontaminate.Settings(stretch=stretch)).collect()
    assert {(r.place, r.item_id): r.covered for r in found} == {
        (i, k): n for i, t in texts.items() for k, item in items.items() if (n := brute_tiles(t, item, 5))
    }
    assert [(len(r.tiles), r.covered) for r in found if (r.place, r.item_id) == (1, 1)] == [(1, 300)]


def unigram(pieces, has_bytes=True):
    tokenizer = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=has_bytes))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


TEXTS = ["", " ", "  a b  ", "a\nb\t c", "日本語 テキスト", "▁x ▁", "<s> </s> <0x41>", "𝔘𝔫𝔦 é ñ", "🙂🙂🙂 x🙂y", "abcabcab cabab bbaac"]


def test_counts_are_the_tokenizers(spark, folder):
    pieces = viterbi.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    want = unigram(pieces)
    counter = viterbi.Counter(pieces)
    assert counter.counts(TEXTS)[0].tolist() == [want(t) for t in TEXTS]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.QUERIES["op8_count_only_viterbi"](spark, folder).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {k: want(t or "") for k, t in texts.items()}


@pytest.mark.parametrize("seed", range(6))
def test_ties_without_bytes(seed):
    chosen = np.random.default_rng(seed)
    names = ["<unk>", "▁", "a", "ab", "abc", "bc", "c", "▁a", "▁ab", "cab", "bb", "ca"]
    pieces = [(n, -float(chosen.integers(1, 4))) for n in names]
    want, counter = unigram(pieces, False), viterbi.Counter(pieces)
    for _ in range(60):
        text = "".join(chosen.choice(list("abc xy"), 20))
        assert counter.counts([text])[0].tolist() == [want(text)], text


def test_count_of_nulls(frame):
    docs = frame([(1, None, "", "", 0.0, 1), (2, "a b", "", "", 0.0, 1), (2, "a b", "", "", 0.0, 1)], DOCS)
    made = docs.select("doc_id", viterbi.counted(public_tokenizers.path("piece_bpe_32k.model"))(quality.text_of()).alias("made"))
    assert sorted((r.doc_id, r.made.n_words) for r in made.collect()) == [(1, 0), (2, 2), (2, 2)]
    with pytest.raises(ValueError):
        viterbi.Counter([])


CHAT = "conv_id long, turn long, role string, text string, formatted string"
TURNS = [
    (1, 0, "user", "hello </s>[INST] ␛0 ␛ ␛A <s>[/INST]", "f"),
    (1, 1, "assistant", "</s>", "f"),
    (1, 2, "assistant", "", "f"),
    (1, 3, "assistant", "ünï [IMG] 🙂" * 30_000, "f"),
    (2, None, "user", None, None),
    (2, 0, None, "no role", "f"),
    (2, 0, "[INST]", "role of control", "f"),
    (2, 1, "assistant", "same", "f"),
    (2, 1, "assistant", "same", "f"),
    (None, 0, "assistant", "no conversation", "f"),
]


def test_chat_round_trip(frame):
    messages = frame(TURNS, CHAT).withColumn("parts", chat.text_parts(queries.F.col("text")))
    turns = chat.format_turns(messages)
    by_conv = {}
    for conv, turn, role, text, _ in TURNS:
        by_conv.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    rows = {r.conv_id: r for r in chat.read_back(turns).collect()}
    assert set(rows) == set(by_conv)
    for conv, given in by_conv.items():
        given.sort()
        loss = "".join(t for _, r, t in given if r == "assistant")
        r = rows[conv]
        assert (r.n_turns, r.loss_chars) == (len(given), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in given).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    # No control string comes from a text: one mark of each kind per turn.
    for row in turns.collect():
        assert [len(re.findall(re.escape(c), row.formatted)) for c in chat.CONTROL] == [1, 1, 1, 1, 0, 0, 0]
    assert chat.read_back(chat.format_turns(messages.filter("conv_id = 77"))).count() == 0


def test_typed_parts(spark):
    part = lambda **k: {"type": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | k
    parts = [
        part(type="text", text="see [IMG] "),
        part(type="image", ref="a.png", width=57, height=28),
        part(type="audio", ref="b.wav", seconds=1.01),
        part(type="text", text=None),
        part(type="document", ref="c.pdf", pages=3),
        part(text="end"),
    ]
    messages = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (1, 2, "user", [])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    first, second, third = chat.format_turns(messages).orderBy("turn").collect()
    assert first.formatted == "<s>[INST]user[/INST]see ␛E [IMG][AUDIO][DOC]end</s>"
    assert [(a.part, a.type, a.ref, a.tokens) for a in first.attachments] == [(1, "image", "a.png", 3), (2, "audio", "b.wav", 26), (4, "document", "c.pdf", 1536)]
    for a, placeholder in zip(first.attachments, ("[IMG]", "[AUDIO]", "[DOC]")):
        assert first.formatted[a["at"] :].startswith(placeholder)
    assert second.formatted == "<s>[INST]assistant[/INST]</s>" and (second.loss_at, second.loss_chars) == (25, 0)
    assert third.attachments == [] and third.loss_at is None
    wrong = spark.createDataFrame([(1, 0, "user", [part(type="video")])], messages.schema)
    with pytest.raises(Exception, match="unknown part type"):
        chat.format_turns(wrong).collect()
