"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on shared seeds, runs of five words. Each pair that
shares one is tiled: the longest matches of words that no tile covers yet are found by
running Karp-Rabin over windows of a falling length, taken as tiles, and so on down to the
seed length. An item is found in a document when tiles cover at least ``least`` of its words;
as tiles may lie in any order, passages that were cut up and reordered are found as well.

A document's words only leave their task where a window of the document may be a seed, which
a bitmap of all seeds tells; its size is fixed by ``bitmap_bits``, whatever the benchmark
holds, and a false positive only costs a lookup. What leaves are stretches of words around
seeds, so a tiling reads the shared places of one document and one item. A long document
that repeats an item goes through as few stretches as there are runs of seeds.

Defined results: case and marks do not matter; null texts are empty; items of fewer than five
words hold no seed and are never found; of equal items each is reported, the smallest
``item_id`` on ties; an empty table on either side finds nothing; repeated rows of documents are
judged one by one; other columns are kept as they are by `clean_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import nullable, numbered, returned, stored, text_of, unused, whole_id, without_places
from plotweave.llm.ragged import portions, starts_of
from plotweave.llm.words import Words, run_hashes


@dataclass(frozen=True)
class Settings:
    """``stretch`` bounds the words of one stretch as it is stored and joined; longer ones are cut with
    an overlap of a seed less a word, and a tiling puts its neighbours together again."""

    seed: int = 5
    least: float = 0.5
    bitmap_bits: int = 1 << 23
    stretch: int = 4096


def _items(benchmark: DataFrame, settings: Settings, id_column: str, text_column: str) -> DataFrame:
    """item, item_id, words and seeds of every item that has seeds; to be stored, as the number ``item`` is that of one scan."""
    rows = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(id_column).cast("long").alias("item_id"), text_of(text_column).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Words()
        for batch in returned(batches):
            words, counts = reader.hashes(batch["text"].tolist())
            seeds, n = run_hashes(words, counts, settings.seed)
            split = [np.split(x.view(np.int64), np.cumsum(k)[:-1]) for x, k in ((words, counts), (seeds, n))]
            made = pd.DataFrame({"item": batch["item"], "item_id": nullable(batch["item_id"], batch["no_id"]), "item_words": split[0], "seeds": split[1]})
            yield made[n > 0]

    return rows.select("item", *whole_id("item_id"), "text").mapInPandas(run, "item long, item_id long, item_words array<long>, seeds array<long>")


def _bitmap(items: DataFrame, bits: int) -> np.ndarray:
    """A bit for each seed's low bits: at most bits / 64 rows of one word each."""
    slot = F.explode("seeds").alias("seed")
    place = F.col("seed").bitwiseAND(F.lit(bits - 1))
    rows = (
        items.select(slot)
        .select(F.shiftright(place, 6).alias("at"), F.expr("shiftleft(1L, cast(seed & 63 as int))").alias("bit"))
        .groupBy("at")
        .agg(F.bit_or("bit").alias("word"))
        .collect()
    )
    out = np.zeros(bits // 64, np.uint64)
    for at, word in rows:
        out[at] = np.uint64(word % 2**64)
    return out


def _stretches(hit: np.ndarray, counts: np.ndarray, runs: np.ndarray, settings: Settings) -> Iterator[tuple[int, int, int]]:
    """(text, first word, end) of the maximal stretches that runs of hits cover."""
    at = np.flatnonzero(hit)
    if not len(at):
        return
    run_starts = starts_of(runs)
    text = np.searchsorted(run_starts + runs, at, side="right")
    first = at - run_starts[text]
    new = np.ones(len(at), bool)
    new[1:] = (text[1:] != text[:-1]) | (first[1:] > first[:-1] + settings.seed)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    for t, a, b in zip(text[begin].tolist(), first[begin].tolist(), (first[end] + settings.seed).tolist()):
        while b - a > settings.stretch:
            yield t, a, a + settings.stretch
            a += settings.stretch - settings.seed + 1
        yield t, a, b


class _Rolling:
    """Karp-Rabin hashes of the windows of one word sequence, for any length, and its marks."""

    # A fixed odd base for hashes modulo 2^64, and its inverse.
    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, words: np.ndarray):
        self.words = words
        self.used = np.zeros(len(words), bool)
        steps = np.full(len(words) + 1, self.BASE, np.uint64)
        back = np.full(len(words) + 1, self.INVERSE, np.uint64)
        steps[0] = back[0] = 1
        self.back = np.multiply.accumulate(back)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(words * np.multiply.accumulate(steps)[:-1])])

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the windows without marked words, and their hashes."""
        if len(self.words) < length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        marks = np.concatenate([[0], np.cumsum(self.used)])
        at = np.flatnonzero(marks[length:] == marks[:-length])
        # The window's share of the prefix hash, brought back to the power of its first word.
        return at, (self.prefix[at + length] - self.prefix[at]) * self.back[at]

    def mark(self, at: int, length: int) -> None:
        self.used[at : at + length] = True

    def is_free(self, at: int, length: int) -> bool:
        return not self.used[at : at + length].any()


def _common(texts: list[_Rolling], item: _Rolling, length: int) -> list[tuple[int, int, int]]:
    """(which text, its place, the item's place) of the unmarked common windows of one length."""
    places, hashes = item.windows(length)
    order = np.argsort(hashes, kind="stable")
    places, hashes = places[order], hashes[order]
    out = []
    for which, text in enumerate(texts):
        at, found = text.windows(length)
        low, high = np.searchsorted(hashes, found, "left"), np.searchsorted(hashes, found, "right")
        for k in np.flatnonzero(high > low).tolist():
            place = int(at[k])
            for p in places[low[k] : high[k]].tolist():
                if np.array_equal(text.words[place : place + length], item.words[p : p + length]):
                    out.append((which, place, p))
    return out


def tiles(texts: list[np.ndarray], item: np.ndarray, shortest: int) -> list[tuple[int, int, int, int]]:
    """Greedy string tiling: (which text, its place, the item's place, length), longest first.

    The longest length with a common unmarked window is searched by halving, as a match of one
    length holds matches of all shorter ones. All its matches that touch no taken tile are
    taken, and the search goes on below that length.
    """
    rolled, pattern = [_Rolling(t) for t in texts], _Rolling(item)
    out = []
    high = min(len(item), max((len(t) for t in texts), default=0))
    while high >= shortest:
        low, best = shortest, None
        while low <= high:
            middle = (low + high + 1) // 2
            if found := _common(rolled, pattern, middle):
                low, best = middle + 1, (middle, found)
            else:
                high = middle - 1
        if best is None:
            break
        length, found = best
        for which, at, p in found:
            if rolled[which].is_free(at, length) and pattern.is_free(p, length):
                rolled[which].mark(at, length)
                pattern.mark(p, length)
                out.append((which, at, p, length))
        high = length - 1
    return out


def _rejoined(found: list[dict]) -> list[tuple[int, np.ndarray]]:
    """(place, words) of stretches in order, those that were cut from one put together again.

    Only cut stretches overlap. A match over a cut holds a whole seed on both sides or lies
    within one side, so both sides are there whenever a match needs them.
    """
    out: list[tuple[int, list[np.ndarray]]] = []
    end = -1
    for one in found:
        at, words = one["at"], np.asarray(one["stretch"], np.int64).view(np.uint64)
        if at < end:
            out[-1][1].append(words[end - at :])
        else:
            out.append((at, [words]))
        end = at + len(words)
    return [(at, np.concatenate(parts)) for at, parts in out]


def matches(
    rows: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), item_id_column: str = "item_id", item_text_column: str = "text"
) -> DataFrame:
    """One row per document (place, text; stored) and item that share a seed: place, item_id, covered, item_words, tiles."""
    items = stored(_items(benchmark, settings, item_id_column, item_text_column), "items")
    bitmap = _bitmap(items, settings.bitmap_bits)
    mask = np.uint64(settings.bitmap_bits - 1)

    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Words()
        for batch in returned(batches):
            texts = batch["text"].tolist()
            places = batch["place"].to_numpy()
            for part in portions(map(len, texts), 200_000):
                words, counts = reader.hashes(texts[part])
                hashes, runs = run_hashes(words, counts, settings.seed)
                low = hashes & mask
                hit = (bitmap[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1)
                begins, run_begins = starts_of(counts), starts_of(runs)
                here = places[part]
                out = [
                    (
                        here[t],
                        a,
                        words[begins[t] + a : begins[t] + b].view(np.int64),
                        hashes[run_begins[t] + a : run_begins[t] + b - settings.seed + 1].view(np.int64),
                    )
                    for t, a, b in _stretches(hit > 0, counts, runs, settings)
                ]
                if out:
                    yield pd.DataFrame(out, columns=["place", "at", "stretch", "seeds"])

    stretches = stored(rows.select("place", "text").mapInPandas(seeds, "place long, at long, stretch array<long>, seeds array<long>"), "stretches")
    wanted = items.select("item", F.explode("seeds").alias("seed")).distinct()
    pairs = (
        stretches.select("place", "at", F.explode(F.array_distinct("seeds")).alias("seed"))
        .join(wanted, "seed")
        .select("place", "at", "item")
        .distinct()
        .join(stretches.select("place", "at", "stretch"), ["place", "at"])
        .groupBy("place", "item")
        .agg(F.sort_array(F.collect_list(F.struct("at", "stretch"))).alias("stretches"))
        .join(items.select("item", "item_id", "item_words"), "item")
    )

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in returned(batches):
            out = []
            for place, words, found in zip(batch["place"], batch["item_words"], batch["stretches"]):
                texts = _rejoined(found)
                item = np.asarray(words, np.int64).view(np.uint64)
                taken = tiles([t for _, t in texts], item, settings.seed)
                out.append((place, len(item), sum(t[3] for t in taken), [(texts[w][0] + a, p, n) for w, a, p, n in taken]))
            made = pd.DataFrame(out, columns=["place", "item_words", "covered", "tiles"])
            made.insert(1, "item_id", nullable(batch["item_id"], batch["no_id"]))
            made["tiles"] = [[{"at": a, "item_at": p, "words": n} for a, p, n in t] for t in made["tiles"]]
            yield made

    return pairs.select("place", *whole_id("item_id"), "item_words", "stretches").mapInPandas(
        tile, "place long, item_id long, item_words long, covered long, tiles array<struct<at:long,item_at:long,words:long>>"
    )


def leaks(rows: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), **columns: str) -> DataFrame:
    """One row per document (place, text; stored) that holds an item: place, n_items, and the item covered most."""
    found = matches(rows, benchmark, settings, **columns).withColumn("coverage", F.col("covered") / F.col("item_words"))
    return (
        found.filter(F.col("coverage") >= settings.least)
        .groupBy("place")
        .agg(
            F.count("*").alias("n_items"),
            # Of equal coverage the smallest id, and one without an id last.
            F.max(F.struct("coverage", (F.col("item_id").isNotNull()).alias("named"), (-F.col("item_id")).alias("minus"), "item_words", "tiles")).alias("best"),
        )
        .select(
            "place",
            "n_items",
            (-F.col("best.minus")).alias("item_id"),
            F.col("best.coverage").alias("coverage"),
            F.size("best.tiles").cast("long").alias("n_tiles"),
        )
    )


def judged(
    docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text", **columns: str
) -> DataFrame:
    """One row per document: doc_id, contaminated, and what `leaks` found."""
    rows = numbered(docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text")), "place")
    found = stored(leaks(rows, benchmark, settings, **columns), "leaks")
    return rows.select("doc_id", "place").join(found, "place", "left").select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        "item_id",
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("n_tiles", F.lit(0)).alias("n_tiles"),
    )


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), text_column: str = "text", **columns: str
) -> DataFrame:
    """``docs`` that hold no item, all columns as they were."""
    place = unused(docs, "place")
    given = numbered(docs, place)
    rows = given.select(F.col(place).alias("place"), text_of(text_column).alias("text"))
    return without_places(given, stored(leaks(rows, benchmark, settings, **columns).select("place"), "leaks"), place)
