"""Exact duplicates by Patricia tries of whole texts.

Texts are equal when they are the same after each run of the six ASCII white-space
characters has become one space. Every task first inserts the texts of its own split into a
compressed radix trie, whose terminal nodes keep the smallest identifier and a count, so of a
large group of copies one row per task goes on. Those rows are dealt out and sorted by length
and content hash and inserted into tries again; all strings of one length and hash are then in
one trie, which compares them byte by byte, and each terminal owns its group.

A trie holds at most ``most_bytes`` of text in a task: beyond that, its heaviest subtree is
given out (the terminals in it, which later stages merge) and forgotten.

Identifiers are ordered by ``doc_id``, null last, and then by the row's place in the table,
so exactly one row of a group stays even among rows that repeat.

Defined results: a null text is empty; all empty texts are one group; an empty table has no
groups; other columns are kept as they are by `first_of_each` and unread elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import numbered, returned, stored, text_of, unused, without_places

#: Smallest (is null, doc_id, place) first.
Owner = tuple[bool, int, int]
GROUPS = "text binary, no_id boolean, doc_id long, place long, copies long"


class Trie:
    """A compressed radix trie from byte strings to (smallest owner, count)."""

    class Node:
        __slots__ = ("below", "label", "owner", "copies")

        def __init__(self, label: bytes):
            self.label = label
            self.below: dict[int, Trie.Node] = {}
            self.owner: Owner | None = None
            self.copies = 0

    def __init__(self):
        self.root = Trie.Node(b"")
        self.size = 0

    def insert(self, key: bytes, owner: Owner, copies: int = 1) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.below.get(key[at])
            if child is None:
                child = Trie.Node(key[at:])
                node.below[key[at]] = child
                self.size += len(key) - at
                node = child
                break
            if not key.startswith(child.label, at):
                child = self._split(node, child, self._common(child.label, key, at))
            at += len(child.label)
            node = child
        node.copies += copies
        if node.owner is None or owner < node.owner:
            node.owner = owner

    @staticmethod
    def _common(label: bytes, key: bytes, at: int) -> int:
        """Length of the common prefix of the label and what follows in the key."""
        low, high = 0, min(len(label), len(key) - at)
        while low < high:
            middle = (low + high + 1) // 2
            if key.startswith(label[:middle], at):
                low = middle
            else:
                high = middle - 1
        return low

    @staticmethod
    def _split(parent: Trie.Node, child: Trie.Node, at: int) -> Trie.Node:
        upper = Trie.Node(child.label[:at])
        parent.below[child.label[0]] = upper
        child.label = child.label[at:]
        upper.below[child.label[0]] = child
        return upper

    def drain(self, node: Trie.Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, Owner, int]]:
        """The terminals under a node; afterwards it has none."""
        stack = [(node or self.root, prefix)]
        while stack:
            here, before = stack.pop()
            key = before + here.label
            if here.owner is not None:
                yield key, here.owner, here.copies
            self.size -= len(here.label)
            stack += [(below, key) for below in here.below.values()]
            here.below, here.owner, here.copies = {}, None, 0

    def heaviest(self) -> Iterator[tuple[bytes, Owner, int]]:
        """Spill: drain the heaviest subtree below the root."""
        if not self.root.below:
            yield from self.drain()
            return
        first = max(self.root.below, key=lambda k: self._weight(self.root.below[k]))
        node = self.root.below.pop(first)
        yield from self.drain(node)

    @staticmethod
    def _weight(node: Trie.Node) -> int:
        total, stack = 0, [node]
        while stack:
            here = stack.pop()
            total += len(here.label)
            stack += here.below.values()
        return total


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(
        [(key, owner[0], owner[1], owner[2], copies) for key, owner, copies in rows],
        columns=["text", "no_id", "doc_id", "place", "copies"],
    )


def _given_out(rows: Iterator[tuple[bytes, Owner, int]]) -> Iterator[pd.DataFrame]:
    """Frames of a bounded number of bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[0])
        if size > 8_000_000:
            yield _frame(held)
            held, size = [], 0
    if held:
        yield _frame(held)


def _entries(batch: pd.DataFrame) -> Iterator[tuple[bytes, Owner, int]]:
    return zip(
        batch["text"],
        zip(batch["no_id"].tolist(), batch["doc_id"].tolist(), batch["place"].tolist()),
        batch["copies"].tolist(),
    )


def normalised(column: Column) -> Column:
    return F.regexp_replace(column, r"[\x20\x09-\x0D]+", " ")


def keyed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *others: str) -> DataFrame:
    """doc_id, n_bytes, sha256 of every row, its normalised text, and its column ``others``."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.encode(normalised(text_of(text_column)), "UTF-8").alias("text"), *others)
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256"), "text", *others)


def owners(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", most_bytes: int = 48_000_000) -> DataFrame:
    """One row per group of equal texts: n_bytes, sha256, keep_id, keep_place, group_size."""
    return _owners(numbered(keyed(docs, id_column, text_column), "place"), most_bytes)


def _owners(keyed_rows: DataFrame, most_bytes: int = 48_000_000) -> DataFrame:
    """`owners` of stored rows: text, doc_id, place."""
    rows = keyed_rows.select(
        "text",
        F.col("doc_id").isNull().alias("no_id"),
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"),
        "place",
        F.lit(1).cast("long").alias("copies"),
    )

    def locally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie()
        for batch in returned(batches):
            for key, owner, copies in _entries(batch):
                trie.insert(bytes(key), owner, copies)
                if trie.size > most_bytes:
                    yield from _given_out(trie.heaviest())
        yield from _given_out(trie.drain())

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, now = Trie(), None
        done: list = []
        for batch in returned(batches):
            for place, (key, owner, copies) in zip(zip(batch["n_bytes"].tolist(), batch["sha256"]), _entries(batch)):
                if place != now:
                    done += [(place_of_text, *t[1:]) for place_of_text, t in _closed(now, trie)]
                    now = place
                trie.insert(bytes(key), owner, copies)
            if len(done) > 10_000:
                yield _owned(done)
                done = []
        done += [(place_of_text, *t[1:]) for place_of_text, t in _closed(now, trie)]
        if done:
            yield _owned(done)

    partial = rows.mapInPandas(locally, GROUPS).select(
        F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256"), "*"
    )
    dealt = partial.repartition("n_bytes", "sha256").sortWithinPartitions("n_bytes", "sha256")
    found = dealt.mapInPandas(merged, "n_bytes long, sha256 string, no_id boolean, doc_id long, keep_place long, group_size long")
    return found.select("n_bytes", "sha256", F.expr("if(no_id, null, doc_id)").alias("keep_id"), "keep_place", "group_size")


def _closed(place, trie: Trie) -> Iterator[tuple]:
    """The groups of one length and hash; two texts with one SHA-256 would show here."""
    groups = [(place, t) for t in trie.drain()]
    if len(groups) > 1:
        raise ValueError(f"different texts of {place[0]} bytes share the hash {place[1]}")
    yield from groups


def _owned(done: list) -> pd.DataFrame:
    return pd.DataFrame(
        [(place[0], place[1], owner[0], owner[1], owner[2], copies) for place, owner, copies in done],
        columns=["n_bytes", "sha256", "no_id", "doc_id", "keep_place", "group_size"],
    )


def groups_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, place."""
    return _groups(numbered(keyed(docs, id_column, text_column), "place"))


def _groups(rows: DataFrame) -> DataFrame:
    """`groups_of` stored rows: doc_id, n_bytes, sha256, text, place."""
    return (
        rows.drop("text")
        .join(_owners(rows), ["n_bytes", "sha256"])
        .select("doc_id", "keep_id", "group_size", (F.col("place") == F.col("keep_place")).alias("kept"), F.col("sha256").alias("text_sha256"), "place")
    )


def first_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row per group of equal texts, all columns as they were."""
    place = unused(docs, "place")
    given = numbered(docs, place)
    rows = keyed(given, id_column, text_column, place).withColumnRenamed(place, "place")
    gone = stored(_groups(rows).filter("not kept").select("place"), "copies")
    return without_places(given, gone, place)
