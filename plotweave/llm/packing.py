"""Packing of documents into token sequences as vector bin packing.

A sequence has three limits at once: tokens, segments and tokens that bear loss. Each Spark
task packs the documents of its own input split, so nothing is shuffled and no group of rows
has to meet. Whole runs of a document that fill a sequence alone are cut off first. What is
left of each document waits in a window, bounded in documents and in tokens, as a copy of the
ids that are left; from it the dot-product heuristic fills the open sequence: of the waiting items that fit, the one whose demand has the largest dot
product with the room left, each limit scaled to 1. When none fits, the item with the largest
product is cut to what fits. At the end of a task, and whenever a sequence has to be closed
early, its tokens are dealt to sequences whose lengths are powers of two, which need no
padding.

Defined results: a null text is empty, and an empty document is its end id alone; repeated
rows are packed again each, with the same ``doc_id``; a null ``doc_id`` stays null; an empty
table gives no sequences; columns other than the two named ones are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import nullable, returned, text_of, whole_id
from plotweave.llm.encoding import encoder
from plotweave.llm.ragged import portions, starts_of

PIECES = (
    "doc_id long, start long, length long, doc_tokens long, loss_tokens long, "
    "sequence_id long, offset long, sequence_tokens long, ids binary"
)
# Chunks of text whose ids a worker keeps for good; nothing else here holds much.
_KNOWN_CHUNKS = 600_000
#: Sequences of one task are numbered from its partition number times this.
PER_TASK = 1 << 40


@dataclass(frozen=True)
class Limits:
    """Of one sequence; ``window`` bounds the documents that wait for a place in a task, and
    ``window * tokens`` their tokens."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048
    window: int = 2048


class _Packer:
    """Packs (document, start, length) items; gives out lists of pieces.

    A document is (doc_id, ids from token ``base`` on, tokens before those that bear loss,
    tokens, base). One that waits owns its ids; they are cut down as they are given out, so
    all that wait hold at most twice ``window * tokens`` ids.
    """

    def __init__(self, limits: Limits):
        self.limits = limits
        self.scale = np.array([1 / limits.tokens, 1 / limits.segments, 1 / max(1, limits.loss)])
        # Tokens, segments and loss of all waiting items, a row each; all 0 where the slot is free.
        self.demand = np.zeros((3, limits.window))
        self.items: list = [None] * limits.window
        self.free = list(range(limits.window))

    def _loss(self, doc: tuple, start: int, length: int) -> int:
        return max(0, start + length - max(start, doc[2]))

    def _wait(self, slot: int, doc: tuple, start: int) -> None:
        length = doc[3] - start
        if doc[1].base is not None or len(doc[1]) > 2 * length:
            doc = (doc[0], doc[1][start - doc[4] :].copy(), doc[2], doc[3], start)
        self.items[slot] = (doc, start, length)
        self.demand[:, slot] = (length, 1, self._loss(doc, start, length))

    def add(self, doc: tuple) -> Iterator[list]:
        """A whole document; its ids may be part of a larger array."""
        start = 0
        limits = self.limits
        while doc[3] - start >= limits.tokens and self._loss(doc, start, limits.tokens) <= limits.loss:
            yield [(doc, start, limits.tokens)]
            start += limits.tokens
        if start < doc[3]:
            # A sequence may only cut documents, so that no slot becomes free.
            while not self.free:
                yield from self._fill()
            self._wait(self.free.pop(), doc, start)
            # More than that can only wait where a full run has too much loss to be cut off.
            while self.demand[0].sum() > limits.window * limits.tokens:
                yield from self._fill()

    def _fill(self) -> Iterator[list]:
        """Fill one sequence from the window."""
        limits = self.limits
        room = np.array([limits.tokens, limits.segments, limits.loss], float)
        tokens, segments, loss = self.demand
        pieces: list = []
        while room[0] > 0 and room[1] > 0:
            here = segments > 0
            if not here.any():
                break
            worth = room * self.scale * self.scale
            gain = tokens * worth[0] + segments * worth[1] + loss * worth[2]
            # An item is one segment, and one is left.
            fits = here & (tokens <= room[0]) & (loss <= room[2])
            # The last segment goes to an item that fills the sequence, if need be by a cut.
            if fits.any() and (room[1] > 1 or (fits & (tokens == room[0])).any()):
                slot = int(np.argmax(np.where(fits, gain if room[1] > 1 else tokens, -1)))
                take = int(tokens[slot])
            else:
                slot = int(np.argmax(np.where(here, tokens if room[1] == 1 else gain, -1)))
                doc, start, length = self.items[slot]
                # Tokens before the loss are free of it; behind them the loss limit counts.
                before = min(length, max(0, doc[2] - start))
                take = int(min(length, room[0], before + room[2]))
                if not take:
                    break
            doc, start, length = self.items[slot]
            pieces.append((doc, start, take))
            room -= (take, 1, self._loss(doc, start, take))
            if take < length:
                self._wait(slot, doc, start + take)
            else:
                self.items[slot] = None
                self.demand[:, slot] = 0
                self.free.append(slot)
        yield from self._close(pieces)

    def _close(self, pieces: list) -> Iterator[list]:
        total = sum(p[2] for p in pieces)
        if total == self.limits.tokens:
            yield pieces
            return
        # The binary digits of what there is, largest first.
        while total:
            want = 1 << (total.bit_length() - 1)
            total -= want
            out = []
            while want:
                doc, start, length = pieces[0]
                take = min(want, length)
                out.append((doc, start, take))
                want -= take
                pieces[0:1] = [(doc, start + take, length - take)] if take < length else []
            yield out

    def finish(self) -> Iterator[list]:
        while len(self.free) < self.limits.window:
            yield from self._fill()


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    limits: Limits = Limits(),
    id_column: str = "doc_id",
    text_column: str = "text",
    loss_from: str | None = None,
) -> DataFrame:
    """Pieces of packed sequences with their ids (unsigned 32-bit, little-endian).

    ``tokenizer`` is the path of a vocabulary file on the executors. ``loss_from`` names a
    column with the number of leading tokens that bear no loss; without it all tokens do.
    """
    if min(limits.tokens, limits.segments, limits.loss, limits.window) < 1:
        raise ValueError("limits have to be at least 1")
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        text_of(text_column).alias("text"),
        (F.coalesce(F.col(loss_from).cast("long"), F.lit(0)) if loss_from else F.lit(0).cast("long")).alias("loss_from"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer, end_id, _KNOWN_CHUNKS).encode
        packer = _Packer(limits)
        number = TaskContext.get().partitionId() * PER_TASK
        out: list = []

        def keep(sequences: Iterator[list]) -> None:
            nonlocal number
            for pieces in sequences:
                offset = 0
                whole = sum(p[2] for p in pieces)
                for doc, start, length in pieces:
                    ids = doc[1][start - doc[4] : start - doc[4] + length].tobytes()
                    loss = packer._loss(doc, start, length)
                    out.append((doc[0], start, length, doc[3], loss, number, offset, whole, ids))
                    offset += length
                number += 1

        def frame() -> pd.DataFrame:
            names = [c.split()[0] for c in PIECES.split(", ")]
            made = pd.DataFrame([r[1:] for r in out], columns=names[1:])
            made.insert(0, "doc_id", nullable([r[0] or 0 for r in out], [r[0] is None for r in out]))
            out.clear()
            return made

        for batch in returned(batches):
            texts = batch["text"].tolist()
            for part in portions(map(len, texts), 300_000):
                ids, lengths = encode(texts[part])
                begins = starts_of(lengths)
                for doc_id, no_id, lead, at, n in zip(
                    batch["doc_id"].iloc[part], batch["no_id"].iloc[part], batch["loss_from"].iloc[part], begins.tolist(), lengths.tolist()
                ):
                    doc = (None if no_id else int(doc_id), ids[at : at + n], int(lead), n, 0)
                    keep(packer.add(doc))
                if out:
                    yield frame()
        keep(packer.finish())
        if out:
            yield frame()

    given = rows.select(*whole_id("doc_id"), "text", "loss_from")
    return given.mapInPandas(run, PIECES)


def with_checksums(pieces: DataFrame) -> DataFrame:
    """``ids_crc32`` of each piece in place of its ids."""
    columns = [c for c in pieces.columns if c != "ids"]
    return pieces.select(*columns, F.crc32("ids").alias("ids_crc32"))


def checksum(ids: np.ndarray) -> int:
    """What `with_checksums` computes, for one array of ids."""
    return zlib.crc32(ids.astype("<u4").tobytes())
