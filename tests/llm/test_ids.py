"""Ids of 64 bits beside null ids in one batch."""

from collections import Counter

import public_tokenizers

from plotweave.llm import align, chat, decontaminate, exact, minhash, packing, rules, token_store
from plotweave.llm.common import new_folder

A, B = (1 << 60) + 1, (1 << 60) + 3
PASSAGE = "the quick brown fox jumps over the lazy dog while seven calm herons watch from the river"
ROWS = [(A, PASSAGE), (None, "another short text"), (B, PASSAGE + " today"), (0, "zero is an id"), (None, PASSAGE)]
IDS = Counter({A: 1, B: 1, 0: 1, None: 2})


def ids(rows, name="doc_id"):
    return Counter(r[name] for r in rows)


def test_ids_of_documents(spark, frame):
    docs = frame(ROWS, "doc_id long, text string").coalesce(1)
    bpe = public_tokenizers.path("byte_bpe_50k.json")
    assert ids(packing.pack(docs, bpe, end_id=1).filter("start = 0").collect()) == IDS
    path = new_folder(spark, "test-ids")
    token_store.write_store(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    assert ids(token_store.read_documents(spark, path).collect()) == IDS
    assert ids(minhash.classes(docs).collect()) == IDS
    assert ids(exact.groups_of(docs).collect()) == IDS
    assert ids(align.alignment_digests(docs, bpe, public_tokenizers.path("piece_bpe_32k.model")).collect()) == IDS
    labels = frame([(A, 1), (B, 0)], "doc_id long, quality int")
    trees = rules.fit(docs, labels, rules.Settings(trees=1))
    assert ids(rules.judged(docs, trees).collect()) == IDS


def test_ids_of_items(spark, frame):
    docs = frame([(A, PASSAGE), (None, "nothing of the kind here, only calm prose about rivers")], "doc_id long, text string")
    items = frame([(None, "none of this text stands anywhere else at all"), (B, PASSAGE), (0, "zero stands for an item that nobody holds")], "item_id long, text string")
    rows = {r.doc_id: (r.contaminated, r.item_id) for r in decontaminate.judged(docs, items).collect()}
    assert rows == {A: (True, B), None: (False, None)}


def test_conversations_stay_apart(spark, frame):
    turns = [(c, t, "user", f"{c} {t}") for c in (A, None, B, 0) for t in range(2)]
    given = frame(turns, "conv_id long, turn long, role string, text string")
    messages = given.withColumn("parts", chat.text_parts(given["text"]))
    rows = chat.read_back(chat.format_turns(messages)).collect()
    assert {r.conv_id: r.n_turns for r in rows} == {A: 2, B: 2, 0: 2, None: 2} and len(rows) == 4
