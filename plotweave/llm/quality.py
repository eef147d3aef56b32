"""Quality of texts by compression against two dictionaries.

Two zstandard dictionaries are trained, one on good and one on bad labelled text. A text that
resembles good text compresses better with the first. Whole texts are compressed piece by
piece with both; the difference of the sizes, once per byte of text and once per byte of
compressed text, and the ratio of compression without a dictionary are calibrated to a score from 0 to 1 by a logistic
curve that is fitted to labelled rows the dictionaries have not seen.

The fit takes at most ``per_class`` labelled documents of each kind for the dictionaries and as
many others for the curve, those whose ids have the smallest hashes. From the former the trainer gets
at most ``samples_per_class`` pieces of ``sample`` bytes, those with the smallest hashes. The curve
is fitted to the whole texts of the latter: tasks compress them, and three numbers a document
reach the driver. Both bounds are parameters and keep the driver's share fixed. A dictionary has
``dictionary`` bytes, or an eighth of its samples where they are fewer, as its trainer advises.
Scoring reads every whole text.

Defined results: a null or empty text gets the score of an empty text, which is the constant
of the curve; labels that are null or neither 0 nor 1 are not used; of several labels of one
document each counts; without labels of both kinds, or with fewer than ``LEAST_SAMPLES`` pieces of
text of a kind, the fit raises ValueError; an empty table has no scores; other columns are kept as they are by `good_documents`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import returned, stored, text_of, unused


@dataclass(frozen=True)
class Settings:
    dictionary: int = 112_640
    level: int = 3
    piece: int = 2048
    per_class: int = 2500
    sample: int = 512
    samples_per_class: int = 10_000


#: The dictionary trainer refuses fewer samples.
LEAST_SAMPLES = 7


@dataclass(frozen=True)
class Model:
    """Both dictionaries (at most 110 KB each) and the curve: all that tasks need."""

    good: bytes
    bad: bytes
    curve: tuple[float, ...]
    settings: Settings


def _pieces(data: bytes, size: int) -> list[bytes]:
    return [data[at : at + size] for at in range(0, len(data), size)]


def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(dictionary)
    held.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


def _features(texts: Iterator[bytes], good: bytes, bad: bytes, settings: Settings) -> np.ndarray:
    with_good, with_bad = _compressor(good, settings.level), _compressor(bad, settings.level)
    alone = zstandard.ZstdCompressor(level=1, write_content_size=False, write_checksum=False)
    out = []
    for data in texts:
        pieces = _pieces(data, settings.piece)
        a = sum(len(with_good.compress(p)) for p in pieces)
        b = sum(len(with_bad.compress(p)) for p in pieces)
        n = len(data)
        out.append(((b - a) / n, (b - a) / (a + b), np.log(sum(len(alone.compress(p)) for p in pieces) / n)) if n else (0.0, 0.0, 0.0))
    return np.array(out, float).reshape(-1, 3)


def _terms(features: np.ndarray) -> np.ndarray:
    """Both differences on a bounded scale, and how far the text compresses beyond prose."""
    per_byte, per_size, ratio = features.T
    return np.column_stack([np.tanh(per_byte * 20), np.tanh(per_size * 10), np.minimum(ratio + 1.0, 0), np.ones(len(features))])


def _fit_curve(terms: np.ndarray, good: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's method, with a small ridge."""
    weights = np.zeros(terms.shape[1])
    ridge = 0.1 * np.eye(len(weights))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(terms @ weights, -35, 35)))
        step = np.linalg.solve((terms * (p * (1 - p))[:, None]).T @ terms + ridge, terms.T @ (good - p) - ridge @ weights)
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, weights))


def held_out(id_column: Column) -> Column:
    """Rows that a fit never sees: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.filter("doc_id is not null and label in (0, 1)").filter(~held_out(F.col("doc_id"))).withColumn("pick", F.xxhash64("doc_id"))
    # Half of the labelled documents make the dictionaries, the other half the curve.
    known = known.withColumn("for_curve", F.pmod("pick", F.lit(2)) == 1)
    chosen = reduce(
        DataFrame.union,
        [
            known.filter((F.col("label") == label) & (F.col("for_curve") == F.lit(curve))).orderBy("pick").limit(settings.per_class)
            for label in (0, 1)
            for curve in (False, True)
        ],
    )
    # At most four times per_class rows of three numbers, so the texts need not move.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(text_of(), "UTF-8").alias("data")).join(F.broadcast(chosen), "doc_id")
    held = stored(rows.select("label", "for_curve", "data"), "labelled")
    last = F.floor((F.octet_length("data") - 1) / settings.sample).cast("int")
    pieces = (
        held.filter(~F.col("for_curve") & (F.octet_length("data") > 0))
        .withColumn("number", F.explode(F.sequence(F.lit(0), last)))
        .select("label", F.substring("data", F.col("number") * settings.sample + 1, F.lit(settings.sample)).alias("data"))
        .withColumn("pick", F.xxhash64("data"))
    )

    def dictionary(label: int) -> bytes:
        found = pieces.filter(F.col("label") == label).orderBy("pick", "data").limit(settings.samples_per_class)
        samples = [bytes(r[0]) for r in found.select("data").collect()]
        if len(samples) < LEAST_SAMPLES:
            raise ValueError("a fit needs labelled texts of both kinds")
        size = max(256, min(settings.dictionary, sum(map(len, samples)) // 8))
        return zstandard.train_dictionary(size, samples, level=settings.level).as_bytes()

    good, bad = dictionary(1), dictionary(0)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in returned(batches):
            made = pd.DataFrame(_features(iter(batch["data"]), good, bad, settings), columns=["a", "b", "c"])
            yield made.assign(label=batch["label"])

    seen = held.filter("for_curve").select("label", "data").mapInPandas(measure, "a double, b double, c double, label int")
    # In one order, so that the sums of the fit do not depend on which task ends first.
    found = np.array(sorted(tuple(r) for r in seen.collect()), float).reshape(-1, 4)
    if len(set(found[:, 3])) < 2:
        raise ValueError("a fit needs labelled texts of both kinds")
    return Model(good, bad, _fit_curve(_terms(found[:, :3]), found[:, 3]), settings)


def score(model: Model) -> Callable[[Column], Column]:
    """A column function: the score of a text column."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in returned(texts):
            features = _features((t.encode() for t in series), model.good, model.bad, model.settings)
            yield pd.Series(1 / (1 + np.exp(-np.clip(_terms(features) @ np.array(model.curve), -35, 35))))

    # Spark reads the kind of the function from its hints.
    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")


def good_documents(docs: DataFrame, model: Model, least: float = 0.3, text_column: str = "text") -> DataFrame:
    """``docs`` that score at least ``least``, all columns as they were."""
    name = unused(docs, "score")
    return docs.withColumn(name, score(model)(text_of(text_column))).filter(F.col(name) >= least).drop(name)
