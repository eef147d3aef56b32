"""Token counts of a unigram vocabulary, without building tokens.

An Aho-Corasick automaton lists the vocabulary's pieces that end at each character of a word;
dynamic programming keeps the best score that reaches each character and how many pieces it
took. The rules are those of a unigram tokenizer with word marks and byte fallback: a space becomes the
mark of the word behind it; of equal scores the piece that begins first wins; a character
that no piece of its own stands for may be taken as unknown, at the lowest score of the
vocabulary less 10, and then counts its UTF-8 bytes if the vocabulary has byte pieces, else
one per run of unknown characters.

Defined results: a null or empty text has no pieces; a vocabulary without pieces raises
ValueError; repeated rows are counted one by one; an empty table gives no rows.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from plotweave.llm.ragged import portions, sums

MARK = "▁"
UNKNOWN_PENALTY = 10.0
_KNOWN_WORDS = 300_000


class Counter:
    """Counts pieces; keeps the counts of words it has met."""

    def __init__(self, pieces: list[tuple[str, float]]):
        if not pieces:
            raise ValueError("a vocabulary needs pieces")
        self.automaton = ahocorasick.Automaton()
        # Of equal pieces the last one counts, as in a lookup table.
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        names = {p for p, _ in pieces}
        self.has_bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of the best segmentation of one word."""
        n = len(word)
        score = [0.0] * (n + 1)
        count = [0] * (n + 1)
        # Whether the best way to here ends in an unknown character; a run of them is one piece.
        in_unknown = [False] * (n + 1)
        reached = [True] + [False] * n
        single = False
        done = 0

        def close(end: int) -> None:
            """After all pieces that end here: the unknown character, if it has no piece."""
            if single:
                return
            candidate = self.unknown + score[end - 1]
            if not reached[end] or candidate > score[end]:
                reached[end] = True
                score[end] = candidate
                if self.has_bytes:
                    count[end] = count[end - 1] + len(word[end - 1].encode())
                else:
                    count[end] = count[end - 1] + (not in_unknown[end - 1])
                    in_unknown[end] = True

        for last, (length, value) in self.automaton.iter(word):
            end = last + 1
            while done < end - 1:
                done += 1
                close(done)
                single = False
            begin = end - length
            candidate = value + score[begin]
            # Longer pieces come first and begin first; only a better score replaces them.
            if not reached[end] or candidate > score[end]:
                reached[end] = True
                score[end] = candidate
                count[end] = count[begin] + 1
                in_unknown[end] = False
            single = single or length == 1
        while done < n:
            done += 1
            close(done)
            single = False
        return count[n]

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and words of each text."""
        split = []
        for text in texts:
            parts = text.replace(MARK, " ").split(" ") if text else []
            # A leading space is the mark of the first word; otherwise the first word gets one.
            split.append(parts[1:] if len(parts) > 1 and not parts[0] else parts)
        per_text = np.fromiter(map(len, split), np.int64, len(split))
        if len(self.known) > _KNOWN_WORDS:
            self.known.clear()
        for part in set().union(*split) - self.known.keys():
            self.known[part] = self.word(MARK + part)
        flat = np.fromiter((self.known[p] for parts in split for p in parts), np.int64, int(per_text.sum()))
        return sums(flat, per_text), per_text


def _counter(pieces: Callable[[], list[tuple[str, float]]], name: str) -> Counter:
    """The counter of this Python worker, which serves many tasks."""
    held = sys.modules.setdefault("plotweave_worker_counters", types.ModuleType("plotweave_worker_counters"))
    if not hasattr(held, name):
        setattr(held, name, Counter(pieces()))
    return getattr(held, name)


def pieces_of(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def counted(path: str) -> Callable[[Column], Column]:
    """A column function: struct<n_tokens, n_words> of a text column, for a model file's pieces."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = _counter(lambda: pieces_of(path), path)
        for series in texts:
            held = series.tolist()
            out = [counter.counts(held[part]) for part in portions(map(len, held), 500_000)]
            yield pd.DataFrame(
                {
                    "n_tokens": np.concatenate([o[0] for o in out]) if out else np.zeros(0, np.int64),
                    "n_words": np.concatenate([o[1] for o in out]) if out else np.zeros(0, np.int64),
                }
            )

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "n_tokens long, n_words long")
