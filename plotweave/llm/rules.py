"""Quality rules: statistics of whole texts, judged by gradient-boosted trees.

Base rules come first: a text of too few words, or too much of which repeats itself, fails.
The others are scored by trees on the logistic loss, fitted to labelled documents on histograms
of quantile bins. A feature may be constrained: more symbols, repeated lines or repeated words
never raise a score. Splits that would break the order are not taken, and the values below a
split stay on their side of its middle. The trees are flattened into arrays of nodes, so that
all rows of a batch walk down all trees together.

The fit takes at most ``fit_rows`` labelled documents, those whose ids have the smallest
hashes; that bound, a parameter, keeps the driver's share fixed. Their whole texts count.

Defined results: a null or empty text has no words and fails the base rules; rows with a null
id are judged; labels that are null or neither 0 nor 1 are not used; of several labels of one
document each counts; without labels of both kinds the fit raises ValueError; repeated rows
come back each; an empty table gives no rows; labels, languages, sources and ids are no
features; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import stored, text_of
from plotweave.llm.quality import held_out
from plotweave.llm.ragged import portions, sums

#: Features and how a score may follow them: -1 only down, 1 only up, 0 freely.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbols_a_word": -1,
    "repeated_lines": -1,
    "repeated_words": -1,
    "letters": 0,
    "upper_case": 0,
    "digits": 0,
    "marks": 0,
    "words_a_line": 0,
    "ended_lines": 0,
    "distinct_words": 0,
    "long_words": 0,
}
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _class(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


_SPACE = _class(b" \t\n\x0b\x0c\r")
_SYMBOL = _class(b"#*$%&|<>")
_UPPER, _LOWER, _DIGIT = (_class(bytes(range(a, b + 1))) for a, b in ((65, 90), (97, 122), (48, 57)))
# Bytes that begin a code point, and those that only stand in letters and signs beyond ASCII.
_BEGINS = ~_class(bytes(range(0x80, 0xC0)))
_BEYOND = _class(bytes(range(0xC0, 0x100)))
_MARK = _class(b".,;:!?'\"()-")


def statistics(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The counts of `STATISTICS` and the values of `FEATURES`, a row for each text."""
    data = [t.encode() for t in texts]
    n = len(data)
    block = b"\n".join(data)
    raw = np.frombuffer(block, np.uint8)
    # Each text's bytes; line feeds between texts belong to none.
    size = np.fromiter(map(len, data), np.int64, n)
    begin = np.cumsum(size + 1) - size - 1

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[begin + size] - total[begin]

    space = _SPACE[raw]
    starts = ~space
    starts[1:] &= space[:-1]
    found = block.split()
    at = np.flatnonzero(starts)
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    words = count(starts)
    number = {w: k for k, w in enumerate(dict.fromkeys(found))}
    ids = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
    v = max(1, len(number))
    text_of_word = np.repeat(np.arange(n), words)
    # Windows of three words of one text, numbered by their words, counted within their text.
    repeated = np.zeros(len(ids), bool)
    if len(ids) > 2:
        whole = np.flatnonzero(text_of_word[2:] == text_of_word[:-2])
        _, pair = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)
        _, window = np.unique(pair[whole] * v + ids[whole + 2], return_inverse=True)
        _, place, times = np.unique(text_of_word[whole] * (len(whole) + 1) + window, return_inverse=True, return_counts=True)
        again = whole[times[place] > 1]
        for k in range(3):
            repeated[again + k] = True
    distinct = np.bincount(np.unique(text_of_word * v + ids) // v, minlength=n)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in data]
    n_lines = np.fromiter(map(len, lines), np.int64, n)
    dup_lines = n_lines - np.fromiter((len(set(x)) for x in lines), np.int64, n)
    ended = np.fromiter((sum(x.rstrip()[-1] in b".!?\"')" for x in rows) for rows in lines), np.int64, n)
    symbols, beyond = count(_SYMBOL[raw]), count(_BEYOND[raw])
    upper, lower, digits = count(_UPPER[raw]), count(_LOWER[raw]), count(_DIGIT[raw])
    chars = count(_BEGINS[raw] & ~space)
    repeats = sums(repeated, words).astype(np.int64)
    counts = np.column_stack([words, chars, symbols, dup_lines, repeats])
    long_words = sums(ends - at > 16, words)
    per_word, per_char, per_line = np.maximum(words, 1), np.maximum(chars, 1), np.maximum(n_lines, 1)
    features = np.column_stack(
        [
            np.log1p(words),
            chars / per_word,
            symbols / per_word,
            dup_lines / per_line,
            repeats / per_word,
            (upper + lower + beyond) / per_char,
            upper / np.maximum(upper + lower, 1),
            digits / per_char,
            count(_MARK[raw]) / per_word,
            words / per_line,
            ended / per_line,
            distinct / per_word,
            long_words / per_word,
        ]
    )
    return counts.reshape(n, 5), features.reshape(n, len(FEATURES))


@dataclass(frozen=True)
class Settings:
    trees: int = 80
    depth: int = 4
    rate: float = 0.15
    bins: int = 64
    leaf_rows: int = 10
    ridge: float = 1.0
    fit_rows: int = 20_000
    least_words: int = 50
    repeat_percent: int = 50
    least_score: float = 0.3


@dataclass(frozen=True)
class Trees:
    """All trees as flat arrays: a node's feature, threshold and children, or its value.

    A leaf is its own child. ``bias`` is the score without any tree, ``depth`` the longest way down.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float
    depth: int

    def margin(self, rows: np.ndarray) -> np.ndarray:
        """The sum of the values of the leaves that each row reaches."""
        node = np.broadcast_to(self.roots, (len(rows), len(self.roots)))
        at = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            below = rows[at, self.feature[node]] <= self.threshold[node]
            node = np.where(below, self.left[node], self.right[node])
        return self.bias + self.value[node].sum(1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows), -35, 35)))


class _Grower:
    """Grows trees one after another into flat lists."""

    def __init__(self, rows: np.ndarray, signs: list[int], settings: Settings):
        self.settings, self.signs = settings, signs
        quantiles = np.linspace(0, 1, settings.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(column, quantiles, method="lower")) for column in rows.T]
        # A row's bin is how many edges lie below its value, so that "at most the edge" is "at most the bin".
        self.binned = np.column_stack([np.searchsorted(e, column, "left") for e, column in zip(self.edges, rows.T)])
        self.nodes: list[list] = []
        self.roots: list[int] = []

    def _value(self, gradient: float, weight: float, low: float, high: float) -> float:
        return min(max(gradient / (weight + self.settings.ridge), low), high)

    def _best(self, rows: np.ndarray, gradient: np.ndarray, weight: np.ndarray, low: float, high: float) -> tuple | None:
        """The split with the largest gain that keeps the order: feature, bin and both values."""
        g, h = gradient[rows].sum(), weight[rows].sum()
        ridge, best, most = self.settings.ridge, None, 1e-9
        for feature, edges in enumerate(self.edges):
            if not len(edges):
                continue
            bins = self.binned[rows, feature]
            k = len(edges) + 1
            left_g, left_h = (np.cumsum(np.bincount(bins, x[rows], k))[:-1] for x in (gradient, weight))
            left_n = np.cumsum(np.bincount(bins, minlength=k))[:-1]
            values = [np.clip(a / (b + ridge), low, high) for a, b in ((left_g, left_h), (g - left_g, h - left_h))]
            # Gain of the clipped values on the second-order loss.
            gain = sum(2 * a * v - (b + ridge) * v * v for a, b, v in ((left_g, left_h, values[0]), (g - left_g, h - left_h, values[1])))
            own = self._value(g, h, low, high)
            gain = gain - (2 * g * own - (h + ridge) * own * own)
            allowed = (left_n >= self.settings.leaf_rows) & (len(rows) - left_n >= self.settings.leaf_rows)
            allowed &= self.signs[feature] * (values[1] - values[0]) >= 0
            gain = np.where(allowed, gain, -1)
            at = int(np.argmax(gain))
            if gain[at] > most:
                most, best = gain[at], (feature, at, float(values[0][at]), float(values[1][at]))
        return best

    def grow(self, gradient: np.ndarray, weight: np.ndarray, margin: np.ndarray) -> None:
        """One more tree; adds its values to ``margin``."""
        s = self.settings
        every = np.arange(len(margin))
        self.roots.append(len(self.nodes))
        self.nodes.append([0, 0.0, 0, 0, 0.0])
        open_nodes = [(self.roots[-1], every, -np.inf, np.inf, 0)]
        while open_nodes:
            at, rows, low, high, depth = open_nodes.pop()
            split = self._best(rows, gradient, weight, low, high) if depth < s.depth else None
            if split is None:
                value = s.rate * self._value(gradient[rows].sum(), weight[rows].sum(), low, high)
                self.nodes[at] = [0, 0.0, at, at, value]
                margin[rows] += value
                continue
            feature, edge, left_value, right_value = split
            middle = (left_value + right_value) / 2
            below = self.binned[rows, feature] <= edge
            left, right = len(self.nodes), len(self.nodes) + 1
            self.nodes[at] = [feature, float(self.edges[feature][edge]), left, right, 0.0]
            self.nodes += [[0, 0.0, 0, 0, 0.0], [0, 0.0, 0, 0, 0.0]]
            spans = {-1: ((middle, high), (low, middle)), 0: ((low, high), (low, high)), 1: ((low, middle), (middle, high))}
            for child, part, span in zip((left, right), (rows[below], rows[~below]), spans[self.signs[feature]]):
                open_nodes.append((child, part, *span, depth + 1))


def grow_trees(rows: np.ndarray, good: np.ndarray, signs: list[int], settings: Settings = Settings()) -> Trees:
    """Fit trees to rows of features and labels of 0 and 1."""
    grower = _Grower(rows, signs, settings)
    share = np.clip(good.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    margin = np.full(len(rows), bias)
    for _ in range(settings.trees):
        p = 1 / (1 + np.exp(-margin))
        grower.grow(good - p, np.maximum(p * (1 - p), 1e-9), margin)
    columns = list(zip(*grower.nodes))
    ints, floats = (lambda x: np.array(x, np.int32)), (lambda x: np.array(x, np.float64))
    return Trees(ints(columns[0]), floats(columns[1]), ints(columns[2]), ints(columns[3]), floats(columns[4]), ints(grower.roots), bias, settings.depth)


def _measured(rows: DataFrame, kept: str, trees: Trees | None = None) -> DataFrame:
    """Statistics and features of ``text``, with the trees' score, besides a column ``kept``."""
    names = [*STATISTICS, *(FEATURES if trees is None else ["score"])]
    schema = f"{kept} long, " + ", ".join(f"{c} {'long' if c in STATISTICS else 'double'}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in portions(map(len, texts), 2_000_000):
                counts, features = statistics(texts[part])
                values = features if trees is None else trees.score(features)[:, None]
                columns = [pa.array(c) for c in (*counts.T, *values.T)]
                own = batch.column(kept).slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([own, *columns], [kept, *names])

    return rows.select(kept, "text").mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> Trees:
    """Fit to labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("label"))
    known = known.filter("doc_id is not null and label in (0, 1)").filter(~held_out(F.col("doc_id")))
    chosen = known.withColumn("pick", F.xxhash64("doc_id")).orderBy("pick", "label").limit(settings.fit_rows)
    # At most fit_rows rows of three numbers, so the texts need not move.
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text")).join(F.broadcast(chosen), "doc_id")
    measured = stored(_measured(rows, "label"), "rule-features")
    # Documents may share an id, so the bound is set once more.
    order = ["label", *FEATURES]
    found = measured.select(*order).orderBy(F.xxhash64(*order), *order).limit(settings.fit_rows).toPandas()
    good = found["label"].to_numpy(float)
    if not 0 < good.sum() < len(good):
        raise ValueError("a fit needs labelled texts of both kinds")
    return grow_trees(found[list(FEATURES)].to_numpy(float), good, list(FEATURES.values()), settings)


def base_failed(settings: Settings = Settings()) -> Column:
    too_few = F.col("n_words") < settings.least_words
    return too_few | (100 * F.col("n_repeat_words") > settings.repeat_percent * F.col("n_words"))


def judged(docs: DataFrame, trees: Trees, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Statistics and verdict of each document: doc_id, `STATISTICS`, score, base_failed, kept."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    failed = base_failed(settings)
    return _measured(rows, "doc_id", trees).withColumns(
        {"base_failed": failed, "kept": ~failed & (F.col("score") >= settings.least_score)}
    )


def described(trees: Trees) -> dict[str, int]:
    """How often the trees split on each feature."""
    inner = trees.left != np.arange(len(trees.left))
    times = np.bincount(trees.feature[inner], minlength=len(FEATURES))
    return dict(zip(FEATURES, times.tolist()))
