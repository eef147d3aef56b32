"""Near duplicates by BagMinHash.

A document is the bag of its runs of five words; its weighted Jaccard similarity to another
is the sum of the smaller multiplicities over the sum of the larger ones. The signature is a
BagMinHash: every (run, unit of weight) owns a Poisson process whose points each carry a time
and one of the signature's components, and a component keeps its earliest time. Units are
grouped into dyadic blocks [0, 1), [1, 2), [2, 4), [4, 8), ...: one process of the block's
whole rate serves all its units, and each of its points is placed on a unit by the
point's own bits, so a run whose multiplicity ends inside a block keeps exactly the points of
its units. Points come in order of time, and a process is dropped as soon as it is later than
the latest component of its document; that is why a signature costs little more than one
point per run.

Components are banded. Documents that share a band are compared with one pivot of the band,
by the overlap of their whole bags, and linked from ``least`` on. Where the documents of one
band still belong to several classes, blocks of them are compared with each other in tasks
of bounded size, which give out the few links that join classes; so no link of a band is lost,
although no group is expanded into rows of all pairs. Only there the work, not the rows, grows
with the square of a band. Classes are the connected components of the links.

Defined results: equal texts up to case and marks are one class; a text of fewer than five
words is one run; all texts without words are one class; a null text is empty; the class id is
the smallest ``doc_id`` of the class, null only if all are null; repeated rows count as copies;
an empty table has no classes; other columns are kept as they are by `first_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import nullable, numbered, returned, stored, text_of, unused, whole_id, without_places
from plotweave.llm.ragged import mixed, portions, starts_of, sums
from plotweave.llm.words import Words, run_hashes


@dataclass(frozen=True)
class Settings:
    """20 bands of 6: a pair of similarity 0.8 shares a band with probability 0.998."""

    words: int = 5
    bands: int = 20
    rows: int = 6
    least: float = 0.8
    block_texts: int = 512
    block_runs: int = 1_000_000


def _uniform(bits: np.ndarray) -> np.ndarray:
    """From (0, 1]."""
    return ((bits >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def bag_of(runs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of each text: run, multiplicity, text, and how many each text has."""
    text = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((runs, text))
    runs, text = runs[order], text[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return runs[first], np.diff(first, append=len(runs)), text[first], np.bincount(text[first], minlength=len(counts))


def signatures(runs: np.ndarray, weights: np.ndarray, text: np.ndarray, n_texts: int, size: int) -> np.ndarray:
    """BagMinHash signatures: the earliest time of each component, texts x size."""
    earliest = np.full(n_texts * size, np.inf)
    # A process for each run and each block of units that its multiplicity reaches.
    seeds, rates, owners, lows, tops = [], [], [], [], []
    low, block = 0, 0
    while True:
        has = np.flatnonzero(weights > low)
        if not len(has):
            break
        high = 1 if block == 0 else 2 * low
        seeds.append(mixed(runs[has] ^ np.uint64(block * 0x9E3779B97F4A7C15 % 2**64)))
        rates.append(np.full(len(has), float((high - low) * size)))
        owners.append(text[has])
        lows.append(np.full(len(has), low, np.int64))
        tops.append(weights[has])
        low, block = high, block + 1
    if not seeds:
        return earliest.reshape(n_texts, size)
    seed, rate, owner, base, top = map(np.concatenate, (seeds, rates, owners, lows, tops))
    time = np.zeros(len(seed))
    latest = np.full(n_texts, np.inf)
    point = 0
    while len(seed):
        # More points at a time as processes run out; the sums stay in order, so equal
        # processes give equal times whatever is computed together with them.
        ahead = int(max(1, min(64, 20_000 // len(seed))))
        index = np.arange(point, point + ahead, dtype=np.uint64)
        bits = mixed(seed[:, None] + (index * np.uint64(0xD1342543DE82EF95))[None, :])
        steps = -np.log(_uniform(bits)) / rate[:, None]
        steps[:, 0] += time
        times = np.add.accumulate(steps, axis=1)
        more = mixed(bits ^ np.uint64(0x2545F4914F6CDD1D))
        component = (more >> np.uint64(32)).astype(np.int64) % size
        span = np.maximum(base, 1)
        unit = base[:, None] + (more & np.uint64(0xFFFFFFFF)).astype(np.int64) * span[:, None] // 2**32
        kept = unit < top[:, None]
        places = owner[:, None] * size + component
        np.minimum.at(earliest, places[kept], times[kept])
        touched = np.unique(owner)
        latest[touched] = earliest.reshape(n_texts, size)[touched].max(1)
        time = times[:, -1]
        point += ahead
        live = time <= latest[owner]
        seed, rate, owner, base, top, time = (x[live] for x in (seed, rate, owner, base, top, time))
    return earliest.reshape(n_texts, size)


def _runs(words: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``length`` words; a shorter text with words is one run of all of them."""
    runs, n = run_hashes(words, counts, length)
    short = np.flatnonzero((counts > 0) & (counts < length))
    if not len(short):
        return runs, n
    begins = starts_of(counts)
    whole = np.array([xxhash.xxh3_64_intdigest(words[begins[i] : begins[i] + counts[i]].tobytes()) for i in short], np.uint64)
    at = starts_of(n)[short]
    n = n.copy()
    n[short] = 1
    return np.insert(runs, at, whole), n


def _digests(words: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """128 bits that name the word sequence of each text."""
    data = memoryview(words.astype("<u8").tobytes())
    ends = (np.cumsum(counts) * 8).tolist()
    return [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip([0, *ends], ends)]


def fingerprints(rows: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, place, text_key, n_runs, bands of every row (doc_id, text, place)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Words()
        for batch in returned(batches):
            texts = batch["text"].tolist()
            for part in portions(map(len, texts), 200_000):
                words, counts = reader.hashes(texts[part])
                runs, n = _runs(words, counts, settings.words)
                distinct, weights, owner, _ = bag_of(runs, n)
                sign = signatures(distinct, weights, owner, len(counts), settings.bands * settings.rows)
                bits = sign.view(np.uint64).reshape(len(counts), settings.bands, settings.rows)
                band = np.broadcast_to(np.arange(settings.bands, dtype=np.uint64), bits.shape[:2]).copy()
                for k in range(settings.rows):
                    band = mixed(band) ^ bits[:, :, k]
                band = mixed(band).view(np.int64)
                yield pd.DataFrame(
                    {
                        "doc_id": nullable(batch["doc_id"].iloc[part], batch["no_id"].iloc[part]),
                        "place": batch["place"].iloc[part],
                        "text_key": _digests(words, counts),
                        "n_runs": n,
                        "bands": [b if k else [] for b, k in zip(band, n)],
                    }
                )

    return rows.select(*whole_id("doc_id"), "place", "text").mapInPandas(run, "doc_id long, place long, text_key binary, n_runs long, bands array<long>")


def bags(rows: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """text_key and bag of the texts in ``wanted`` (text_key, place): (run, number) hashes."""
    chosen = rows.select("place", "text").join(wanted, "place")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Words()
        for batch in returned(batches):
            texts = batch["text"].tolist()
            for part in portions(map(len, texts), 200_000):
                words, counts = reader.hashes(texts[part])
                runs, n = _runs(words, counts, settings.words)
                distinct, weights, _, per_text = bag_of(runs, n)
                # The k-th occurrence of a run is an element of its own, so bags become sets.
                number = np.arange(int(weights.sum())) - np.repeat(starts_of(weights), weights)
                element = mixed(np.repeat(distinct, weights) + mixed(number.astype(np.uint64))).view(np.int64)
                ends = np.cumsum(sums(weights, per_text))
                yield pd.DataFrame(
                    {"text_key": batch["text_key"].iloc[part], "bag": np.split(element, ends[:-1]) if len(ends) else []}
                )

    return chosen.select("text_key", "text").mapInPandas(run, "text_key binary, bag array<long>")


def _similar(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with the similarity of their whole bags."""
    shared = F.size(F.array_intersect("bag_a", "bag_b"))
    return (
        pairs.join(held.select(F.col("text_key").alias("a"), F.col("bag").alias("bag_a")), "a")
        .join(held.select(F.col("text_key").alias("b"), F.col("bag").alias("bag_b")), "b")
        .withColumn("similarity", shared / (F.size("bag_a") + F.size("bag_b") - shared))
        .drop("bag_a", "bag_b")
    )


def components(links: DataFrame) -> DataFrame:
    """text_key and the smallest key of its connected component, for all ends of links (a, b).

    Every round takes the smallest label among the neighbours and then the label's label.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("text_key"), F.least("a", "least").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("text_key").alias("b"), "label"), "b").groupBy(F.col("a").alias("text_key")).agg(F.min("label").alias("near"))
        once = labels.join(near, "text_key").select("text_key", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("text_key").alias("label"), F.col("label").alias("further"))
        moved = stored(once.join(jump, "label").select("text_key", "before", F.least("label", "further").alias("label")), "labels")
        if moved.filter("label <> before").isEmpty():
            return moved.select("text_key", "label")
        labels = moved.select("text_key", "label")


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members with the class of their text; a text without links is its own."""
    if labels is None:
        return members.withColumn("label", F.col("text_key"))
    return members.join(labels, "text_key", "left").withColumn("label", F.coalesce("label", "text_key"))


def _linked(settings: Settings):
    """For one block: links that join its classes, as few as do."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        keys = [bytes(k) for k in block["text_key"]]
        classes_of, names = pd.factorize(pd.Series([bytes(x) for x in block["label"]]))
        out: list[tuple[bytes, bytes]] = []
        if len(names) > 1:
            sizes = np.array([len(b) for b in block["bag"]])
            owner = np.repeat(np.arange(len(keys)), sizes)
            _, element, often = np.unique(np.concatenate(block["bag"].tolist()), return_inverse=True, return_counts=True)
            # Elements of one text alone are in no overlap.
            column = np.cumsum(often > 1) - 1
            shared_by = often[element] > 1
            owner, element = owner[shared_by], column[element[shared_by]]
            order = np.argsort(element, kind="stable")
            owner, element = owner[order], element[order]
            overlap = np.zeros((len(keys), len(keys)))
            width = 2048
            for first in range(0, int((often > 1).sum()), width):
                low, high = np.searchsorted(element, [first, first + width])
                part = np.zeros((len(keys), width), np.float32)
                part[owner[low:high], element[low:high] - first] = 1
                overlap += part @ part.T
            similar = overlap / (sizes[:, None] + sizes[None, :] - overlap) >= settings.least
            parent = list(range(len(names)))

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for i, j in np.argwhere(np.triu(similar & (classes_of[:, None] != classes_of[None, :]))).tolist():
                a, b = root(classes_of[i]), root(classes_of[j])
                if a != b:
                    parent[a] = b
                    out.append((keys[i], keys[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def _links_across(members: DataFrame, held: DataFrame, settings: Settings) -> DataFrame:
    """Links between the classes of each band (band, text_key, label, blocks).

    The texts of a large band are dealt to blocks, and every two blocks are compared in one
    task: a task holds two blocks, whatever the band holds, and gives out a link only where
    it joins two classes.
    """
    own = F.pmod(F.xxhash64("text_key"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = members.withColumn("own", own).select(
        "band", "text_key", "label", "own", F.explode(every).alias("other")
    ).select("band", "text_key", "label", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))
    return dealt.join(held, "text_key").groupBy("band", "one", "two").applyInPandas(_linked(settings), "a binary, b binary")


def classes(
    docs: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, n_texts, kept, place."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    return _classes(numbered(rows, "place"), settings)


def _classes(rows: DataFrame, settings: Settings) -> DataFrame:
    """`classes` of stored rows: doc_id, text, place."""
    prints = stored(fingerprints(rows, settings), "prints")
    texts = stored(
        prints.groupBy("text_key").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("first"),
            F.count("*").alias("copies"),
            F.first("n_runs").alias("n_runs"),
            F.first("bands").alias("bands"),
        ),
        "texts",
    )
    # Only bands that several texts share matter; each has its smallest text as its pivot.
    spread = texts.select("text_key", "n_runs", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.min("text_key").alias("pivot"), F.max("text_key").alias("last")).filter("pivot <> last")
    members = stored(spread.join(shared.select("band", "pivot"), "band"), "members")
    wanted = members.select("text_key").distinct().join(texts.select("text_key", "first.place"), "text_key")
    held = stored(bags(rows, wanted, settings), "bags")
    first = members.filter("text_key <> pivot").select("text_key", "n_runs", "pivot").distinct()
    measured = stored(_similar(first.select(F.col("text_key").alias("a"), F.col("pivot").alias("b")), held), "measured")
    links = measured.filter(F.col("similarity") >= settings.least).select("a", "b")
    labels = None if links.isEmpty() else components(links)

    # Bands whose members still belong to several classes.
    sorted_out = _labelled(members, labels)
    mixed_bands = (
        sorted_out.groupBy("band")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.sum("n_runs").alias("runs"))
        .filter("low <> high")
        .select("band", F.ceil(F.greatest(F.col("n") / settings.block_texts, F.col("runs") / settings.block_runs)).cast("int").alias("blocks"))
    )
    across = stored(_links_across(sorted_out.join(mixed_bands, "band"), held, settings), "across")
    if not across.isEmpty():
        labels = components(links.union(across))

    named = _labelled(texts.select("text_key", "first", "copies"), labels)
    whole = named.groupBy("label").agg(F.min("first").alias("first"), F.sum("copies").alias("class_size"), F.count("*").alias("n_texts"))
    of_text = named.select("text_key", "label").join(whole, "label").select("text_key", "first", "class_size", "n_texts")
    return prints.select("doc_id", "place", "text_key").join(of_text, "text_key").select(
        "doc_id",
        F.col("first.doc_id").alias("class_id"),
        "class_size",
        "n_texts",
        (F.col("place") == F.col("first.place")).alias("kept"),
        "place",
    )


def first_of_each(docs: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row per class of near duplicates, all columns as they were."""
    place = unused(docs, "place")
    given = numbered(docs, place)
    rows = given.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"), F.col(place).alias("place"))
    gone = stored(_classes(rows, settings).filter("not kept").select("place"), "near-copies")
    return without_places(given, gone, place)
