"""Words of texts as 64-bit hashes, and hashes of runs of words."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import xxhash

from plotweave.llm.ragged import mixed, starts_of

_WORD = re.compile(r"\w+")
_KNOWN_WORDS = 300_000


class Words:
    """Hashes the lower-cased words of texts; keeps the hashes of the words it has met."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def hashes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The hash of every word, and how many words each text has."""
        found = [_WORD.findall(t.lower()) for t in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        if len(self.known) > _KNOWN_WORDS:
            self.known.clear()
        known = self.known
        for word in set().union(*found) - known.keys():
            known[word] = xxhash.xxh3_64_intdigest(word)
        flat = np.fromiter(map(known.__getitem__, chain.from_iterable(found)), np.uint64, int(counts.sum()))
        return flat, counts


def run_hashes(words: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every run of ``length`` words, and how many runs each text has.

    A run never passes the end of its text; a text that is shorter has no run.
    """
    if len(words) < length:
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    total = len(words) - length + 1
    out = words[:total].copy()
    for k in range(1, length):
        out = mixed(out) + words[k : k + total]
    runs = np.maximum(counts - length + 1, 0)
    inside = np.ones(len(words), bool)
    # The last words of each text begin no run.
    ends = starts_of(counts) + counts
    for k in range(1, length):
        last = ends - k
        inside[last[(last >= starts_of(counts))]] = False
    return mixed(out[inside[:total]]), runs
