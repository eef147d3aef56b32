"""Token ids of whole texts, with each distinct chunk of text encoded once.

Words repeat, so most of a tokenizer's work is the same again. Where the tokenizer's own
splitting rule never lets a token cross a space that a non-space follows, a text may be cut
there, the chunks looked up, and only new ones encoded. Any other tokenizer encodes whole
texts, and so does every tokenizer where a text holds the string of an added token, which
becomes that token's id by the file's own rules.
"""

from __future__ import annotations

import gc
import json
import os
import re
import sys
import types
from itertools import chain, filterfalse

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

from plotweave.llm.ragged import portions, starts_of, sums

_SPACE_THEN_SPACE = re.compile(r" (?:\s|$)")
_CUT = re.compile(r" (?=\S)")
# Letters of the Latin blocks, then ASCII marks to the end: both kinds of splitting part them.
_WORD_THEN_MARKS = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\[-`{-~]*)")
# Chunks a worker keeps for good, those it keeps for a while besides, and the longest it keeps.
_KNOWN_CHUNKS = 250_000
_RECENT_CHUNKS = 150_000
_KEPT_LENGTH = 64
_TOGETHER = 200


def _cuts_at_spaces(tokenizer: Tokenizer) -> bool:
    """Byte-level splitting by its built-in pattern, or a pattern that removes white space."""
    rules = json.loads(tokenizer.to_str())
    outer = rules.get("pre_tokenizer") or {}
    normal = rules.get("normalizer") or {}
    parts = outer.get("pretokenizers", [outer])
    first = parts[0]
    if first.get("type") == "ByteLevel":
        return not normal and first.get("use_regex", False) and not first.get("add_prefix_space", True)
    if first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert"):
        pattern = first.get("pattern", {}).get("Regex", "")
        kinds = {n.get("type") for n in normal.get("normalizers", [normal] if normal else [])}
        # A match holds no white space when the pattern's parts are letters, digits and "not white space".
        return kinds <= {"NFC", "Replace", "Lowercase"} and not re.search(r"(?<!\^)\\s| \?|\.", pattern)
    return False


def _for_words(path: str) -> Tokenizer | None:
    """The same model for words of letters only, parted at spaces in place of the file's pattern.

    Lower-case Latin letters pass the normalizers that `_cuts_at_spaces` allows unchanged.
    """
    tokenizer = Tokenizer.from_file(path)
    probe = " ab abc \u00e9t\u00e9 zz"
    found = [w.strip("\u0120") for w, _ in tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
    byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    if found != [byte_level.pre_tokenize_str(w)[0][0] for w in probe.split()]:
        return None
    holds_space = json.loads(tokenizer.to_str())["pre_tokenizer"].get("type") == "ByteLevel"
    tokenizer.normalizer = None
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(" ", "merged_with_next" if holds_space else "removed"), byte_level]
    )
    return tokenizer


class Encoder:
    """Encodes texts; keeps the ids of the first chunks it meets, and of the latest.

    With ``plain`` the strings of added tokens are text like any other.
    """

    def __init__(self, path: str, end_id: int, known_chunks: int | None = None, plain: bool = False):
        # One task has one core; the library's own threads would take those of other tasks.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content and not plain]
        # Whatever the case, as some files look for added tokens in the normalized text.
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        # What all of them begin with, up to the first letter: most texts do not hold it.
        self.sign = re.match(r"[!-/:-@\[-`{-~]*", os.path.commonprefix(added))[0]
        self.by_chunk = _cuts_at_spaces(self.tokenizer)
        self.known_chunks = known_chunks or _KNOWN_CHUNKS
        self.for_words = _for_words(path) if self.by_chunk else None
        # Byte-level words begin with a mark for their space, others may end with a suffix.
        names = self.tokenizer.get_vocab()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.bound_first = not suffix
        self.bounds = np.zeros(max(names.values(), default=0) + 1, bool)
        if self.by_chunk:
            self.bounds[[i for n, i in names.items() if (n.endswith(suffix) if suffix else n.startswith("\u0120"))]] = True
        # Ids as little-endian bytes, by chunk: first of a text, behind a space, marks behind a word.
        self.heads: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.end = np.array([end_id], "<u4").tobytes()

    def _ids(self, chunks: list[str], tokenizer: Tokenizer | None = None) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in (tokenizer or self.tokenizer).encode_batch_fast(chunks, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _word_ids(self, words: list[str], lead: str, tokenizer: Tokenizer | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of letters: many in one text, parted where a token is a word's first or last.

        A group in which the parts are not as many as its words is encoded word by word.
        """
        if not lead or not self.bounds.any():
            return self._ids([lead + w for w in words])
        groups = [words[at : at + _TOGETHER] for at in range(0, len(words), _TOGETHER)]
        ids, lengths = self._ids([lead + lead.join(g) for g in groups], tokenizer)
        is_bound = self.bounds[ids]
        size = np.fromiter(map(len, groups), np.int64, len(groups))
        out, counts, begins = [], [], starts_of(lengths)
        if (sums(is_bound, lengths) == size).all():
            at = np.flatnonzero(is_bound) + (not self.bound_first)
            return ids, np.diff(at, append=len(ids)) if self.bound_first else np.diff(at, prepend=0)
        for group, at, n, k in zip(groups, begins, lengths, size):
            part = is_bound[at : at + n]
            if part.sum() == k:
                cuts = np.flatnonzero(part) + (not self.bound_first)
                out.append(ids[at : at + n])
                counts.append(np.diff(cuts, append=n) if self.bound_first else np.diff(cuts, prepend=0))
            else:
                alone = self._ids([lead + w for w in group])
                out.append(alone[0])
                counts.append(alone[1])
        return np.concatenate(out), np.concatenate(counts)

    @staticmethod
    def _add(known: dict[str, bytes], chunks: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        raw = ids.astype("<u4").tobytes()
        ends = np.cumsum(4 * lengths)
        known.update(zip(chunks, [raw[a:b] for a, b in zip((ends - 4 * lengths).tolist(), ends.tolist())]))

    def _learn(self, known: dict[str, bytes], chunks: set[str], lead: str) -> None:
        """Add every chunk with the ids of the lead and the chunk."""
        new = list(chunks)
        split = [_WORD_THEN_MARKS.fullmatch(c) if len(c) <= _KEPT_LENGTH else None for c in new]
        whole = [c for c, m in zip(new, split) if m is None]
        # A word without marks is the whole of its chunk.
        words = {m[1] for m in split if m}.difference(known)
        lower = [w for w in words if w == w.lower()] if self.for_words else []
        others = list(words.difference(lower))
        for part in portions(map(len, whole), 200_000):
            self._add(known, whole[part], *self._ids([lead + c for c in whole[part]]))
        for part in portions(map(len, lower), 200_000):
            self._add(known, lower[part], *self._word_ids(lower[part], lead, self.for_words))
        for part in portions(map(len, others), 200_000):
            self._add(known, others[part], *self._word_ids(others[part], lead))
        joined = [m for m in split if m and m[2]]
        if marks := list({m[2] for m in joined}.difference(self.marks)):
            self._add(self.marks, marks, *self._ids(marks))
        known.update([(m[0], known[m[1]] + self.marks[m[2]]) for m in joined])

    def _forget(self) -> None:
        """Drop the latest chunks when there are many; what came first is mostly frequent."""
        for known in (self.heads, self.tails, self.marks):
            if len(known) > self.known_chunks + _RECENT_CHUNKS:
                for _ in range(len(known) - self.known_chunks):
                    known.popitem()

    def _cut(self, text: str) -> list[str]:
        return _CUT.split(text) if _SPACE_THEN_SPACE.search(text) else text.split(" ")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's closed by the end id, and how many belong to each text."""
        # Nothing here makes cycles, and looking for some would walk all that is kept.
        looking = gc.isenabled()
        gc.disable()
        try:
            made = self._encoded(texts)
        finally:
            if looking:
                gc.enable()
        lengths = np.fromiter(map(len, made), np.int64, len(made)) // 4
        return np.frombuffer(b"".join(made), "<u4").astype(np.uint32, copy=False), lengths

    def _encoded(self, texts: list[str]) -> list[bytes]:
        if self.by_chunk:
            # The first chunk of a text stands alone; all others keep the space before them.
            alone = [i for i, t in enumerate(texts) if self.added and self.sign in t and self.added.search(t)]
            cut = [self._cut(t) for t in texts]
            for i in alone:
                cut[i] = [""]
            heads = [c[0] for c in cut]
            for c in cut:
                del c[0]
            long = []
            for known, chunks, lead in ((self.heads, heads, ""), (self.tails, chain.from_iterable(cut), " ")):
                if new := set(filterfalse(known.__contains__, chunks)):
                    self._learn(known, new, lead)
                    long += [(known, c) for c in new if len(c) > _KEPT_LENGTH]
            first, rest = self.heads.__getitem__, self.tails.__getitem__
            made = [first(h) + b"".join(map(rest, c)) + self.end for h, c in zip(heads, cut)]
            for known, chunk in long:
                del known[chunk]
            for i in alone:
                made[i] = self._whole([texts[i]])[0]
            self._forget()
            return made
        return self._whole(texts)

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() + self.end for e in found]


def encoder(path: str, end_id: int, known_chunks: int | None = None) -> Encoder:
    """The encoder of this Python worker, which serves many tasks and keeps what it has learned."""
    held = sys.modules.setdefault("plotweave_worker_encoders", types.ModuleType("plotweave_worker_encoders"))
    key = f"{path}:{end_id}:{known_chunks}"
    if not hasattr(held, key):
        setattr(held, key, Encoder(path, end_id, known_chunks))
    return getattr(held, key)
