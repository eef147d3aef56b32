"""Phrase mining on a weighted de Bruijn graph of words.

A text is lower-cased (A-Z) and cut at marks and line ends into pieces, pieces at blanks into
words. The graph of a language has the word pairs as nodes and the runs of three words as
edges, each from the pair it begins with to the pair it ends with, weighted by occurrences.
Edges are aggregated; shorter counts follow from them: a pair occurs as often as edges leave
it, plus the pieces that end with it, and a word as often as pairs begin with it, plus the
pieces that end with it.

Nearly all runs of words in a corpus are rare, so they are not written out as strings. A first
pass adds up the flow of nodes and words under hashes. A sum below the least count proves that
nothing under this hash is frequent; what remains is marked in a bitmap of bounded size. The
second pass counts exactly, by the words themselves, the edges between marked nodes. Hashes
that meet, or a full bitmap, mean more rows to count and never other counts.

Frequent edges are compacted: a pair that one edge enters and one leaves, both with the pair's
own count, lies inside a path. Paths are found by pointer doubling and lie within one piece,
so a path is no longer than a text. A path without begin would need a piece without one, so
there are no circles. Candidates are read off the paths and the nodes.

Defined results: a null text is empty and gives nothing; a null language is ``und``; repeated
rows count each; an empty table gives no phrases; other columns are never read. Scores are
exact while 1000000 * a * a has at most 38 digits, beyond that Spark raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.llm.common import stored, text_of
from plotweave.llm.ragged import mixed

_TABLE = bytearray(range(256))
for _letter in range(ord("A"), ord("Z") + 1):
    _TABLE[_letter] = _letter + 32
for _mark in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_mark] = 10
_TABLE[9] = 32
_LOWER = bytes(_TABLE)

#: Bits of one bitmap row of Spark's bitmap functions.
_BITS_A_ROW = 32_768


@dataclass(frozen=True)
class Settings:
    """``block`` bounds the bytes of text behind one local graph, ``bitmap_bits`` the bitmap."""

    least: int = 10
    covered_percent: int = 50
    top: int = 2000
    block: int = 2_000_000
    bitmap_bits: int = 1 << 28


def blocks(texts: list[bytes], most: int) -> Iterator[bytes]:
    """Lower-cased texts with a line feed at each end of a piece, some together, long ones cut there."""
    held, size = [], 0
    for text in texts:
        text = text.translate(_LOWER)
        at = 0
        while len(text) - at > most:
            end = text.rfind(b"\n", at, at + most) + 1
            if end <= at:
                end = text.find(b"\n", at + most) + 1 or len(text)
            yield text[at:end]
            at = end
        if size + len(text) - at > most and held:
            yield b"\n".join(held)
            held, size = [], 0
        held.append(text[at:])
        size += len(text) - at + 1
    if held:
        yield b"\n".join(held)


class LocalGraph:
    """The graph of one block: edges with weights, the flow of its nodes and words."""

    def __init__(self, block: bytes):
        found = block.split()
        self.words = list(set(found))
        number = dict(zip(self.words, range(len(self.words))))
        ids = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
        self.total, v = len(ids), len(self.words)
        marks = np.frombuffer(block, np.uint8)
        ends = marks == 10
        blank = ends | (marks == 32)
        begins = ~blank
        begins[1:] &= blank[:-1]
        piece = np.cumsum(ends, dtype=np.int32)[begins]
        last = np.ones(len(ids), bool)
        last[:-1] = piece[1:] != piece[:-1]
        # Pairs stand at all positions but the last of a piece.
        at = np.flatnonzero(~last)
        codes, node = np.unique(ids[at] * v + ids[at + 1], return_inverse=True)
        self.first, self.second = codes // max(v, 1), codes % max(v, 1)
        # An edge stands where the next pair of the same piece follows; other pairs end a piece.
        ends_piece = last[at + 1]
        tail = np.flatnonzero(~ends_piece)
        edges, where, self.weight = np.unique(node[tail] * v + ids[at[tail] + 2], return_index=True, return_counts=True)
        self.edge_head, self.edge_word = edges // max(v, 1), edges % max(v, 1)
        self.edge_tail = node[tail[where] + 1]
        n = len(codes)
        self.flow = np.bincount(self.edge_head, self.weight, n).astype(np.int64) + np.bincount(node[ends_piece], minlength=n)
        self.word_flow = np.bincount(self.first, self.flow, v).astype(np.int64) + np.bincount(ids[last], minlength=v)

    def hashes(self, lang: str) -> tuple[np.ndarray, np.ndarray]:
        """One of 2^44 for each word and for each node of a language."""
        seed = xxhash.xxh3_64_intdigest(lang)
        single = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))
        double = mixed(mixed(single[self.first]) + single[self.second])
        return (single >> np.uint64(20)).astype(np.int64), (double >> np.uint64(20)).astype(np.int64)


def _graphs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, LocalGraph]]:
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        texts = batch.column("text").to_pylist()
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(langs, texts):
            by_lang.setdefault(lang, []).append(text)
        for lang, group in by_lang.items():
            for block in blocks(group, most):
                yield lang, LocalGraph(block)


def _rows(docs: DataFrame, text_column: str, lang_column: str) -> DataFrame:
    lang = F.coalesce(F.col(lang_column).cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), text_of(text_column).cast("binary").alias("text"))


def possible(rows: DataFrame, settings: Settings) -> tuple[np.ndarray, int]:
    """The bitmap of hashes that may stand for a frequent node or word, and its bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, graph in _graphs(batches, settings.block):
            hashes, counts = np.concatenate(graph.hashes(lang)), np.concatenate([graph.word_flow, graph.flow])
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(counts)], ["hash", "n"])

    sums = rows.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    frequent = stored(sums.filter(F.col("n") >= settings.least).select("hash"), "frequent-hashes")
    # Sixteen bits for each hash, as long as that is no more than the bound.
    bits = min(settings.bitmap_bits, max(_BITS_A_ROW, 1 << (16 * frequent.count()).bit_length()))
    spot = F.col("hash") % bits
    marked = frequent.groupBy((spot / _BITS_A_ROW).cast("int").alias("row")).agg(
        F.bitmap_construct_agg(spot % _BITS_A_ROW).alias("bits")
    )
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in marked.toLocalIterator():
        at = row.row * _BITS_A_ROW // 8
        bitmap[at : at + _BITS_A_ROW // 8] = np.frombuffer(row.bits, np.uint8)
    return bitmap, bits


def counted(docs: DataFrame, settings: Settings = Settings(), text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Exact counts of words, pairs and runs of three that occur often enough; stored.

    Columns lang, size, phrase, n; size 0 holds the number of all words of a language.
    """
    rows = _rows(docs, text_column, lang_column)
    bitmap, bits = possible(rows, settings)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = shared.value

        def is_marked(hashes: np.ndarray) -> np.ndarray:
            spot = hashes % bits
            return (marks[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1

        for lang, graph in _graphs(batches, settings.block):
            words = pa.array(graph.words, pa.binary())
            of_words, of_nodes = (is_marked(h) for h in graph.hashes(lang))
            nodes = np.flatnonzero(of_nodes)
            edges = np.flatnonzero(of_nodes[graph.edge_head] & of_nodes[graph.edge_tail])
            single = np.flatnonzero(of_words)
            pair = pc.binary_join_element_wise(words.take(pa.array(graph.first[nodes])), words.take(pa.array(graph.second[nodes])), b" ")
            head = graph.edge_head[edges]
            triple = pc.binary_join_element_wise(
                *(words.take(pa.array(x)) for x in (graph.first[head], graph.second[head], graph.edge_word[edges])), b" "
            )
            phrases = pa.concat_arrays([pa.array([b""], pa.binary()), words.take(pa.array(single)), pair, triple])
            sizes = np.repeat([0, 1, 2, 3], [1, len(single), len(nodes), len(edges)]).astype(np.int32)
            counts = np.concatenate([[graph.total], graph.word_flow[single], graph.flow[nodes], graph.weight[edges]]).astype(np.int64)
            langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(sizes), np.int32)), pa.array([lang])).dictionary_decode()
            yield pa.RecordBatch.from_arrays([langs, pa.array(sizes), phrases.cast(pa.string()), pa.array(counts)], ["lang", "size", "phrase", "n"])

    made = rows.mapInArrow(run, "lang string, size int, phrase string, n long")
    sums = made.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    return stored(sums.filter((F.col("n") >= settings.least) | (F.col("size") == 0)), "phrase-counts")


def _words(name: str) -> Column:
    return F.split(F.col(name), " ")


def paths(counts: DataFrame) -> DataFrame:
    """Frequent edges compacted to paths: lang, words, weight and the counts of the first and last pair.

    Inside a path all pairs and runs of three occur ``weight`` times.
    """
    nodes = counts.filter("size = 2").select("lang", F.col("phrase").alias("node"), F.col("n").alias("flow"))
    edges = counts.filter("size = 3").select(
        "lang",
        F.col("phrase").alias("edge"),
        F.col("n").alias("weight"),
        F.substring_index("phrase", " ", 2).alias("head"),
        F.substring_index("phrase", " ", -2).alias("tail"),
    )
    # At most one edge has the whole flow of the node it enters.
    entering = edges.select("lang", F.col("tail").alias("node"), F.col("weight").alias("flow"), F.col("edge").alias("root"))
    entered = entering.join(nodes, ["lang", "node", "flow"])
    leaving = edges.select("lang", "edge", F.col("head").alias("node"), F.col("weight").alias("flow"))
    inner = stored(leaving.join(entered, ["lang", "node", "flow"]).select("lang", "edge", "root", F.lit(1).cast("long").alias("steps")), "path-links")
    while True:
        further = inner.select("lang", F.col("edge").alias("root"), F.col("root").alias("root_"), F.col("steps").alias("steps_"))
        jumped = inner.join(further, ["lang", "root"], "left").select(
            "lang",
            "edge",
            F.coalesce("root_", "root").alias("root"),
            (F.col("steps") + F.coalesce("steps_", F.lit(0))).alias("steps"),
            F.col("root_").isNotNull().alias("moved"),
        )
        inner = stored(jumped, "path-links")
        if inner.filter("moved").isEmpty():
            break
        inner = inner.drop("moved")
    placed = edges.join(inner.drop("moved"), ["lang", "edge"], "left").select(
        "lang",
        F.coalesce("root", "edge").alias("root"),
        F.struct(F.coalesce("steps", F.lit(0)).alias("steps"), F.substring_index("edge", " ", -1).alias("word")).alias("step"),
        "weight",
    )
    gathered = placed.groupBy("lang", "root").agg(F.array_sort(F.collect_list("step")).alias("steps"), F.max("weight").alias("weight"))
    made = gathered.select(
        "lang",
        F.concat(F.slice(_words("root"), 1, 2), F.transform("steps", lambda s: s["word"])).alias("words"),
        "weight",
    )
    begins = F.array_join(F.slice("words", 1, 2), " ")
    ends = F.array_join(F.slice("words", -2, 2), " ")
    of = nodes.withColumnRenamed("flow", "first_count")
    first = made.withColumns({"node": begins, "_last": ends}).join(of, ["lang", "node"]).drop("node").withColumnRenamed("_last", "node")
    return first.join(nodes.withColumnRenamed("flow", "last_count"), ["lang", "node"]).drop("node")


def collocations(docs: DataFrame, settings: Settings = Settings(), text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The best phrases of two and three words of each language, with rank, counts and score."""
    counts = counted(docs, settings, text_column, lang_column)
    found = stored(paths(counts), "phrase-paths")
    last = F.size("words") - 2
    at = found.withColumn("i", F.explode(F.sequence(F.lit(1), last)))
    triples = at.select(
        "lang",
        F.array_join(F.slice("words", F.col("i"), 3), " ").alias("phrase"),
        F.col("weight").alias("a"),
        F.when(F.col("i") == 1, F.col("first_count")).otherwise(F.col("weight")).alias("head_count"),
        F.when(F.col("i") == last, F.col("last_count")).otherwise(F.col("weight")).alias("tail_count"),
    )
    # Pairs that a path touches, by the largest count of a path; inside a path it is their own.
    touched = found.withColumn("i", F.explode(F.sequence(F.lit(1), last + 1))).select(
        "lang", F.array_join(F.slice("words", F.col("i"), 2), " ").alias("phrase"), "weight"
    )
    covered = touched.groupBy("lang", "phrase").agg(F.max("weight").alias("most"))
    nothing = F.lit(None).cast("long")
    pairs = (
        counts.filter("size = 2")
        .join(covered, ["lang", "phrase"], "left")
        .filter(F.col("most").isNull() | (100 * F.col("most") < settings.covered_percent * F.col("n")))
        .select("lang", "phrase", F.col("n").alias("a"), nothing.alias("head_count"), nothing.alias("tail_count"))
    )
    single = counts.filter("size = 1")
    first = single.select("lang", F.col("phrase").alias("first"), F.col("n").alias("first_count"))
    final = single.select("lang", F.col("phrase").alias("last"), F.col("n").alias("last_count"))
    candidates = (
        pairs.unionByName(triples)
        .withColumns({"first": F.substring_index("phrase", " ", 1), "last": F.substring_index("phrase", " ", -1)})
        .join(first, ["lang", "first"])
        .join(final, ["lang", "last"])
    )

    def cut(k: int, left: Column, right: Column) -> Column:
        whole = F.col("a").cast("decimal(38,0)")
        score = F.call_function("div", F.lit(1_000_000).cast("decimal(38,0)") * whole * whole, left.cast("decimal(38,0)") * right)
        return F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))

    triple = F.col("head_count").isNotNull()
    best = F.when(
        triple, F.least(cut(1, F.col("first_count"), F.col("tail_count")), cut(2, F.col("head_count"), F.col("last_count")))
    ).otherwise(cut(1, F.col("first_count"), F.col("last_count")))
    scored = candidates.withColumn("best", best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= settings.top)
    totals = counts.filter("size = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
