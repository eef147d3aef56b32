"""Alignment of the tokens of two tokenizers by shared cuts.

A text is encoded with two vocabularies; the byte offsets where tokens of both end are cuts.
They are found by divide and conquer: the end of the middle token of an interval is looked up
by bisection among the ends of the other side; where it is not shared, the next end of that
side is looked up on this side, and so on, to the right and then to the left, until a shared
end is met. It halves the interval; an interval without one is a group. All intervals of a
batch of texts are worked on together, level by level.

Tokens that end together are linked. Of two tokens that end together one's bytes end with the
other's, so the pairs that can be linked follow from the vocabularies alone: at most one for
each token and each length of its end, some hundred thousand whatever the corpus. Their counts
over the corpus are summed by Spark and are small enough to be sent to every task.

Defined results: a text that is null or empty has no tokens and no groups, and so has one whose
tokens do not spell a space and the text (a text that itself holds U+2581, for instance);
strings of special tokens are plain text; repeated rows count each and come back each; a null
id stays null; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plotweave.llm.common import stored, text_of
from plotweave.llm.encoding import Encoder
from plotweave.llm.ragged import gather, portions, starts_of

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"
SPANS = "groups array<struct<a: array<int>, b: array<int>, start: long, end: long>>"


def byte_level_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, all others, in order, for U+0100 and on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


def byte_level_tokens(path: str) -> list[bytes]:
    alphabet = byte_level_alphabet()
    names = Tokenizer.from_file(path).get_vocab()
    out = [b""] * (max(names.values(), default=-1) + 1)
    for name, at in names.items():
        out[at] = bytes(alphabet[c] for c in name) if alphabet.keys() >= set(name) else name.encode()
    return out


def piece_tokens(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    out = []
    for at in range(model.get_piece_size()):
        name = model.id_to_piece(at)
        out.append(bytes([int(name[3:5], 16)]) if model.is_byte(at) else name.replace("▁", " ").encode())
    return out


def linkable(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sorted codes (a * len(b) + b) of all pairs of which one ends with the other."""

    def by_bytes(tokens: list[bytes]) -> dict[bytes, list[int]]:
        found: dict[bytes, list[int]] = {}
        for at, token in enumerate(tokens):
            if token:
                found.setdefault(token, []).append(at)
        return found

    of_a, of_b = by_bytes(a), by_bytes(b)
    codes = {x * len(b) + y for x, t in enumerate(a) for k in range(len(t)) for y in of_b.get(t[k:], ())}
    codes |= {x * len(b) + y for y, t in enumerate(b) for k in range(len(t)) for x in of_a.get(t[k:], ())}
    return np.array(sorted(codes), np.int64)


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray, tops_a: np.ndarray, tops_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last tokens of each group on both sides.

    ``ends_*`` are increasing offsets over all texts, ``tops_*`` the tokens behind each text's
    last one; the last tokens of a text end together.
    """
    a1, b1 = np.asarray(tops_a, np.int64), np.asarray(tops_b, np.int64)
    some = np.diff(a1, prepend=0) > 0
    a0, b0 = np.concatenate([[0], a1[:-1]])[some], np.concatenate([[0], b1[:-1]])[some]
    a1, b1 = a1[some], b1[some]
    out_a, out_b = [], []
    while len(a0):
        # A single token on one side cannot be parted.
        whole = (a1 - a0 == 1) | (b1 - b0 == 1)
        out_a.append(a1[whole] - 1)
        out_b.append(b1[whole] - 1)
        a0, a1, b0, b1 = (x[~whole] for x in (a0, a1, b0, b1))
        cut_a, cut_b = np.full(len(a0), -1), np.full(len(a0), -1)
        middle = (a0 + a1 - 2) // 2
        # Ends at or behind the middle, then ends before it; the interval's own end is no cut.
        for rightward in (True, False):
            at = np.flatnonzero(cut_a < 0)
            i = middle[at] if rightward else middle[at] - 1
            if not rightward:
                inside = i >= a0[at]
                at, i = at[inside], i[inside]
            while len(at):
                j = np.searchsorted(ends_b, ends_a[i], "left" if rightward else "right") - (not rightward)
                inside = (j < b1[at] - 1) if rightward else (j >= b0[at])
                at, i, j = at[inside], i[inside], j[inside]
                met = ends_b[j] == ends_a[i]
                cut_a[at[met]], cut_b[at[met]] = i[met], j[met]
                at, j = at[~met], j[~met]
                i = np.searchsorted(ends_a, ends_b[j], "left" if rightward else "right") - (not rightward)
                inside = (i < a1[at] - 1) if rightward else (i >= a0[at])
                at, i, j = at[inside], i[inside], j[inside]
                met = ends_b[j] == ends_a[i]
                cut_a[at[met]], cut_b[at[met]] = i[met], j[met]
                at, i = at[~met], i[~met]
        leaf = cut_a < 0
        out_a.append(a1[leaf] - 1)
        out_b.append(b1[leaf] - 1)
        a0, a1, b0, b1, cut_a, cut_b = (x[~leaf] for x in (a0, a1, b0, b1, cut_a, cut_b))
        a0, a1 = np.concatenate([a0, cut_a + 1]), np.concatenate([cut_a + 1, a1])
        b0, b1 = np.concatenate([b0, cut_b + 1]), np.concatenate([cut_b + 1, b1])
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.sort(np.concatenate(out_a)), np.sort(np.concatenate(out_b))


@dataclass(frozen=True)
class Batch:
    """Tokens and groups of some texts, all flat; ``tops_*`` part them by text."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    ends_a: np.ndarray
    tops_a: np.ndarray
    tops_b: np.ndarray
    lasts_a: np.ndarray
    lasts_b: np.ndarray


class Words:
    """Encodes texts with both tokenizers; keeps the ids of short words it has met.

    Neither joins a word and the space behind it: the first by its splitting rule, the second
    where no piece holds its space sign behind another character. So the words between single
    spaces are encoded once each. Texts in which white space follows a space, or which begin or
    end with one, are encoded whole, and so are all texts where a tokenizer has other rules.
    """

    def __init__(self, path_a: str, path_b: str, kept: int = 200_000, longest: int = 64):
        self.encoder = Encoder(path_a, 0, known_chunks=20_000, plain=True)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.kept, self.longest = kept, longest
        names = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        self.by_word = self.encoder.by_chunk and not any("\u2581" in name.lstrip("\u2581") for name in names)
        # Ids as bytes by word, for both tokenizers; words that make a text be encoded whole.
        self.of_a: dict[str, bytes] = {}
        self.of_b: dict[str, bytes] = {}
        self.odd: set[str] = {""}

    def _learn(self, new: set[str]) -> None:
        odd = {w for w in new if w[:1].isspace()}
        self.odd |= odd
        words = list(new - odd)
        # Also keeps a word without the marks behind it.
        self.encoder._learn(self.of_a, set(words), " ")
        found = self.model.encode(words, num_threads=1)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        Encoder._add(self.of_b, words, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths)

    def _forget(self, new: set[str]) -> None:
        for w in new:
            if len(w) > self.longest:
                self.of_a.pop(w, None)
                self.of_b.pop(w, None)
                self.odd.discard(w)
        for known in (self.of_a, self.of_b, self.encoder.marks):
            if len(known) > 2 * self.kept:
                for _ in range(len(known) - self.kept):
                    known.popitem()
        if len(self.odd) > self.kept:
            self.odd = {""}

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of both tokenizers: all ids, and how many belong to each text. An empty text has none."""
        cut = [t.split(" ") if self.by_word and t else [] for t in texts]
        met = set().union(*cut).difference(self.odd)
        new = met.difference(self.of_a) | met.difference(self.of_b)
        self._learn(new)
        plain = [bool(c) and self.odd.isdisjoint(c) for c in cut]
        whole = [t for t, p in zip(texts, plain) if not p]
        flat, lengths = _without_ends(*self.encoder.encode([" " + t if t else "" for t in whole]))
        whole_a = iter(np.split(flat.astype("<u4"), np.cumsum(lengths)[:-1]))
        whole_b = iter(self.model.encode(whole, num_threads=1))
        get_a, get_b = self.of_a.__getitem__, self.of_b.__getitem__
        made_a = [b"".join(map(get_a, c)) if p else next(whole_a).tobytes() for c, p in zip(cut, plain)]
        made_b = [b"".join(map(get_b, c)) if p else np.array(next(whole_b), "<u4").tobytes() for c, p in zip(cut, plain)]
        self._forget(new)
        return [
            (np.frombuffer(b"".join(made), "<u4").astype(np.int64), np.fromiter(map(len, made), np.int64, len(made)) // 4)
            for made in (made_a, made_b)
        ]


def _without_ends(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids without the last of each text."""
    return np.delete(flat, np.cumsum(lengths) - 1), lengths - 1


class Spelling:
    """The bytes of a vocabulary's tokens, one after another."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = starts_of(self.lengths)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def of(self, ids: np.ndarray) -> bytes:
        return gather(self.flat, self.starts[ids], self.lengths[ids]).tobytes()


class Aligner:
    """Both tokenizers of one worker."""

    def __init__(self, path_a: str, path_b: str):
        self.words = Words(path_a, path_b)
        self.bytes_a, self.bytes_b = byte_level_tokens(path_a), piece_tokens(self.words.model)
        self.spell_a, self.spell_b = Spelling(self.bytes_a), Spelling(self.bytes_b)
        self.pairs = linkable(self.bytes_a, self.bytes_b)
        # Each id with what may stand behind it: another of its group, or the group's end.
        self.names_a = [f"{n}," for n in range(len(self.bytes_a))] + [f"{n}|" for n in range(len(self.bytes_a))]
        self.names_b = [f"{n}," for n in range(len(self.bytes_b))] + [f"{n};" for n in range(len(self.bytes_b))]

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and tokens of each text by both; none where they do not spell a space and the text."""
        spaced = [" " + t if t else "" for t in texts]
        (ids_a, count_a), (ids_b, count_b) = self.words.encode(texts)
        want = "".join(spaced).encode()
        if self.spell_a.of(ids_a) != want or self.spell_b.of(ids_b) != want:
            parts = [np.split(ids, np.cumsum(n)[:-1]) for ids, n in ((ids_a, count_a), (ids_b, count_b))]
            same = [self.spell_a.of(a) == t.encode() == self.spell_b.of(b) for t, a, b in zip(spaced, *parts)]
            ids_a, ids_b = ids_a[np.repeat(same, count_a)], ids_b[np.repeat(same, count_b)]
            count_a, count_b = count_a * same, count_b * same
        return ids_a, count_a, ids_b, count_b

    def align(self, texts: list[str]) -> Batch:
        ids_a, count_a, ids_b, count_b = self._encoded(texts)
        tops_a, tops_b = np.cumsum(count_a), np.cumsum(count_b)
        ends_a, ends_b = np.cumsum(self.spell_a.lengths[ids_a]), np.cumsum(self.spell_b.lengths[ids_b])
        return Batch(ids_a, ids_b, ends_a, tops_a, tops_b, *groups_of(ends_a, ends_b, tops_a, tops_b))

    def digests(self, batch: Batch) -> Iterator[tuple]:
        """Of each text: tokens, groups, links, the digest of its groups, its links as numbers of pairs."""
        codes = batch.ids_a[batch.lasts_a] * len(self.bytes_b) + batch.ids_b[batch.lasts_b]
        links = np.searchsorted(self.pairs, codes).astype("<u4")
        # Groups in turn: the ids of one side, then of the other.
        size_a, size_b = np.diff(batch.lasts_a, prepend=-1), np.diff(batch.lasts_b, prepend=-1)
        named_a, named_b = batch.ids_a.copy(), batch.ids_b.copy()
        named_a[batch.lasts_a] += len(self.bytes_a)
        named_b[batch.lasts_b] += len(self.bytes_b)
        both = len(self.names_a)
        place_a = np.arange(len(named_a)) + np.repeat(batch.lasts_b - size_b + 1, size_a)
        place_b = np.arange(len(named_b)) + np.repeat(batch.lasts_a + 1, size_b)
        order = np.empty(len(named_a) + len(named_b), np.int64)
        order[place_a], order[place_b] = named_a, named_b + both
        names = self.names_a + self.names_b
        tops = np.searchsorted(batch.lasts_a, batch.tops_a - 1, "right")
        begin_a = begin_b = begin = 0
        for top_a, top_b, top in zip(batch.tops_a.tolist(), batch.tops_b.tolist(), tops.tolist()):
            n = top - begin
            text = "".join(map(names.__getitem__, order[begin_a + begin_b : top_a + top_b].tolist()))
            digest = hashlib.sha256(text[:-1].encode()).hexdigest() if n else ""
            yield top_a - begin_a, top_b - begin_b, n, n, digest, links[begin:top].tobytes()
            begin_a, begin_b, begin = top_a, top_b, top

    def spans(self, batch: Batch) -> Iterator[list[dict]]:
        """Of each text: its groups with the ids of both sides and the bytes they cover in a space and the text."""
        tops = np.searchsorted(batch.lasts_a, batch.tops_a - 1, "right").tolist()
        begin = 0
        for top in tops:
            base = int(batch.ends_a[batch.lasts_a[begin - 1]]) if begin else 0
            out, start = [], 0
            for k in range(begin, top):
                a0, b0 = (int(x[k - 1]) + 1 if k else 0 for x in (batch.lasts_a, batch.lasts_b))
                a1, b1 = int(batch.lasts_a[k]) + 1, int(batch.lasts_b[k]) + 1
                end = int(batch.ends_a[a1 - 1]) - base
                out.append({"a": batch.ids_a[a0:a1].tolist(), "b": batch.ids_b[b0:b1].tolist(), "start": start, "end": end})
                start = end
            yield out
            begin = top


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of this Python worker."""
    return Aligner(path_a, path_b)


def aligned(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text", spans: bool = False) -> DataFrame:
    """Each document with the counts and digest of its groups and its links; with ``spans`` also the groups.

    ``path_a`` is a byte-level vocabulary for the tokenizers library, ``path_b`` a sentencepiece
    model that sets a space before the text; both on every executor. A link is the number of its
    pair in `linkable`, as little-endian unsigned 32-bit integers.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    names = [c.split()[0] for c in ALIGNED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    span_type = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in portions(map(len, texts), 400_000):
                made = both.align(texts[part])
                ids = batch.column("doc_id").slice(part.start, part.stop - part.start)
                columns = [ids, *zip(*both.digests(made))]
                arrays = [pa.array(c, k) if at else c for at, (c, k) in enumerate(zip(columns, kinds))]
                if spans:
                    arrays.append(pa.array(list(both.spans(made)), span_type))
                yield pa.RecordBatch.from_arrays(arrays, names + ["groups"] * spans)

    return rows.mapInArrow(run, ALIGNED + (", " + SPANS if spans else ""))


def link_counts(rows: DataFrame, n_pairs: int) -> np.ndarray:
    """How many links of the corpus hold each pair; ``rows`` are `aligned`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, np.int64)
        for batch in batches:
            links = b"".join(batch.column("links").to_pylist())
            total += np.bincount(np.frombuffer(links, "<u4"), minlength=n_pairs)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])

    sums = rows.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = np.zeros(n_pairs, np.int64)
    # One row for each pair that can be linked at all: bounded by the vocabularies.
    found = sums.toArrow()
    counts[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return counts


def alignment_digests(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document's groups and links, judged by how often its pairs are linked in the corpus.

    ``n_best``: links whose count is the highest of their token of ``path_b``; ``count_sum``: the
    counts of all links.
    """
    rows = stored(aligned(docs, path_a, path_b, id_column, text_column), "aligned")
    here = aligner(path_a, path_b)
    size_b = len(here.bytes_b)
    counts = link_counts(rows, len(here.pairs))
    best = np.zeros(size_b, np.int64)
    np.maximum.at(best, here.pairs % size_b, counts)
    shared = docs.sparkSession.sparkContext.broadcast((counts, counts == best[here.pairs % size_b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, is_best = shared.value
        for batch in batches:
            links = [np.frombuffer(x, "<u4") for x in batch.column("links").to_pylist()]
            added = [
                pa.array([int(is_best[x].sum()) for x in links], pa.int64()),
                pa.array([int(n[x].sum()) for x in links], pa.int64()),
            ]
            columns = {name: batch.column(name) for name in batch.schema.names if name != "links"}
            columns |= {"n_best": added[0], "count_sum": added[1]}
            yield pa.RecordBatch.from_arrays([columns[c] for c in order], order)

    order = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return rows.mapInArrow(run, ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in order))
