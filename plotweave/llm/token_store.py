"""Token ids on disk, packed by a Simple-8b code of 64-bit words.

Four bits of each word select how its other sixty are divided: one value of 60 bits, two of
30, and so on to sixty of one bit. A value that needs more than 60 bits is escaped: a word
with selector 0, then the value as a raw word. Ids are coded in blocks of at most `BLOCK`,
each with its word offset, so that blocks decode alone, all values of one at a time.

A store is a folder of Parquet files, written by Spark's committer, whose rows are chunks. A
chunk holds whole documents in one binary value:

    magic "PWS8", documents, blocks, words (4 x uint32)
    per document: tokens (uint64)
    per block: first word (uint64), ids (uint32), 1 if it has escapes (uint32)
    the words (uint64)

All numbers are little-endian. Columns beside it: ``shard`` (in ascending order of documents),
``first`` (ids before it in the shard), ``n_ids``, ``doc_ids``, ``payload``.

Documents are range-partitioned by id and sorted, so a shard is one contiguous range.
Defined results: a null text is empty; a null ``doc_id`` comes first; rows of one ``doc_id``
follow in the order of their text's hash and keep a place each; an empty table gives an empty
store; columns other than the two named ones are never read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotweave.llm.common import nullable, text_of, whole_id
from plotweave.llm.encoding import encoder
from plotweave.llm.ragged import gather, portions, starts_of, sums

# Bits of a value and values of a word, by selector. Selector 0 is the escape.
WIDTHS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
COUNTS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
BLOCK = 1024
CHUNK = 65_536
# About 120 MB of a Python worker; here nothing else waits in its memory.
_KNOWN_CHUNKS = 700_000
_MAGIC = b"PWS8"
CHUNKS = "shard int, first long, n_ids long, doc_ids array<long>, payload binary"


def _selectors(values: np.ndarray, block: int) -> np.ndarray:
    """For each value the selector of the fullest word that can begin there, in rows of blocks."""
    rows = -(-len(values) // block)
    width = np.zeros((rows, block + int(COUNTS[-1])), np.int8)
    # Bits of each value, at least 1; a value next below a power of two over 2^53 may count one more.
    flat = np.zeros(rows * block, np.int8)
    flat[: len(values)] = np.maximum(np.frexp(values.astype(np.float64))[1], 1)
    width[:, :block] = flat.reshape(rows, block)
    # Once no value begins a word of so many, none begins a fuller one.
    # The widest of the next 1, 2, 3, ... values; nothing stands behind the end of a block.
    widest = width[:, :block].copy()
    best = np.zeros((rows, block), np.int8)
    for count in range(1, int(COUNTS[-1]) + 1):
        if count > 1:
            np.maximum(widest, width[:, count - 1 : count - 1 + block], out=widest)
        # What fits a later selector fits all before it, so counting the fits gives the last.
        for selector in np.flatnonzero(COUNTS == count):
            fits = widest <= WIDTHS[selector]
            if not fits.reshape(-1)[: len(values)].any():
                return best.reshape(-1)[: len(values)]
            best += fits
    return best.reshape(-1)[: len(values)]


def encode_blocks(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words, first word of each block, values of each block, whether it has escapes."""
    values = values.astype(np.uint64)
    n = len(values)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(0, bool)
    begins = np.arange(0, n, block)
    sizes = np.minimum(block, n - begins)
    selector = _selectors(values, block)
    # Follow the words of all blocks at once: the next word begins where this one stops.
    at, stop = begins.copy(), begins + sizes
    is_word = np.zeros(n, bool)
    step = np.maximum(COUNTS, 1)
    while len(at):
        is_word[at] = True
        at = at + step[selector[at]]
        more = at < stop
        at, stop = at[more], stop[more]
    heads = np.flatnonzero(is_word)
    chosen, taken = selector[heads].astype(np.int64), np.diff(heads, append=n)
    word = chosen.astype(np.uint64) << np.uint64(60)
    # The k-th values of all words that have so many, for one k after the other.
    width = WIDTHS[chosen].astype(np.uint64)
    which = np.flatnonzero(chosen)
    for k in range(int(COUNTS[-1])):
        which = which[taken[which] > k]
        if not len(which):
            break
        word[which] |= values[heads[which] + k] << (width[which] * np.uint64(k))
    # An escape word is followed by its value.
    length = np.where(chosen == 0, 2, 1)
    words = np.zeros(int(length.sum()), np.uint64)
    places = starts_of(length)
    words[places] = word
    words[places[chosen == 0] + 1] = values[heads[chosen == 0]]
    of_block = heads // block
    per_block = np.bincount(of_block, weights=length, minlength=len(begins)).astype(np.int64)
    escaped = np.bincount(of_block, weights=chosen == 0, minlength=len(begins)) > 0
    return words, starts_of(per_block), sizes, escaped


def _decode_escaped(words: np.ndarray, size: int) -> np.ndarray:
    out, at = [], 0
    while len(out) < size:
        word = int(words[at])
        selector = word >> 60
        if selector == 0:
            at += 1
            out.append(int(words[at]))
        else:
            width = int(WIDTHS[selector])
            take = min(int(COUNTS[selector]), size - len(out))
            out += [(word >> (k * width)) & ((1 << width) - 1) for k in range(take)]
        at += 1
    return np.array(out, np.uint64)


def decode_blocks(words: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    """The values that `encode_blocks` was given."""
    if not len(firsts):
        return np.zeros(0, np.uint64)
    lengths = np.diff(np.append(firsts, len(words)))
    if escaped.any():
        return np.concatenate(
            [
                _decode_escaped(words[f : f + n], int(s)) if e else decode_blocks(words[f : f + n], firsts[:1] * 0, sizes[i : i + 1], escaped[:1] & False)
                for i, (f, n, s, e) in enumerate(zip(firsts, lengths, sizes, escaped))
            ]
        )
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    # The last word of a block may have room to spare.
    last = firsts + lengths - 1
    counts[last] -= sums(counts, lengths) - sizes
    width = np.repeat(WIDTHS[selector], counts)
    within = np.arange(int(counts.sum())) - np.repeat(starts_of(counts), counts)
    mask = (np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)
    return (np.repeat(words, counts) >> (within * width).astype(np.uint64)) & mask


def to_payload(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    words, firsts, sizes, escaped = encode_blocks(ids)
    table = np.zeros(len(firsts), np.dtype([("word", "<u8"), ("ids", "<u4"), ("escaped", "<u4")]))
    table["word"], table["ids"], table["escaped"] = firsts, sizes, escaped
    head = _MAGIC + struct.pack("<III", len(lengths), len(firsts), len(words))
    return head + lengths.astype("<u8").tobytes() + table.tobytes() + words.astype("<u8").tobytes()


def from_payload(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a chunk, and how many belong to each document."""
    if payload[:4] != _MAGIC:
        raise ValueError("not a chunk of token ids")
    docs, blocks, n_words = struct.unpack_from("<III", payload, 4)
    lengths = np.frombuffer(payload, "<u8", docs, 16).astype(np.int64)
    table = np.frombuffer(payload, np.dtype([("word", "<u8"), ("ids", "<u4"), ("escaped", "<u4")]), blocks, 16 + 8 * docs)
    words = np.frombuffer(payload, "<u8", n_words, 16 + 8 * docs + 16 * blocks)
    return (
        decode_blocks(words, table["word"].astype(np.int64), table["ids"].astype(np.int64), table["escaped"] > 0),
        lengths,
    )


def write_store(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text"
) -> None:
    """Encode whole texts and write them at ``path`` in ascending order of their ids."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer, end_id, _KNOWN_CHUNKS).encode
        shard = TaskContext.get().partitionId()
        first = 0
        held: list = []
        waiting = 0

        def chunk() -> pd.DataFrame:
            nonlocal first, waiting
            ids = np.concatenate([h[1] for h in held])
            lengths = np.concatenate([h[2] for h in held])
            names = [None if none else int(x) for h in held for x, none in zip(*h[0])]
            made = pd.DataFrame({"shard": [shard], "first": [first], "n_ids": [len(ids)], "doc_ids": [names], "payload": [to_payload(ids, lengths)]})
            first += len(ids)
            held.clear()
            waiting = 0
            return made

        for batch in batches:
            texts = batch["text"].tolist()
            for part in portions(map(len, texts), 200_000):
                ids, lengths = encode(texts[part])
                held.append(((batch["doc_id"].iloc[part], batch["no_id"].iloc[part]), ids, lengths))
                waiting += len(ids)
                if waiting >= CHUNK:
                    yield chunk()
        if held:
            yield chunk()

    ordered.select(*whole_id("doc_id"), "text").mapInPandas(run, CHUNKS).write.option("compression", "uncompressed").parquet(path)


def read_store(spark, path: str) -> DataFrame:
    """The chunks of a store."""
    return spark.read.schema(CHUNKS).parquet(path)


def shard_starts(chunks: DataFrame) -> DataFrame:
    """Ids before each shard; one small row per shard, read without the payloads."""
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))


def read_documents(spark, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document, decoded from the files: doc_id, start, n_tokens, ids_crc32.

    ``with_ids`` adds ``ids`` (unsigned 32-bit, little-endian).
    """
    chunks = read_store(spark, path)
    schema = "shard int, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, first, names, none, payload in zip(batch["shard"], batch["first"], batch["doc_ids"], batch["no_ids"], batch["payload"]):
                values, lengths = from_payload(payload)
                ids = values.astype("<u4")
                begins = starts_of(lengths)
                parts = [ids[a : a + n].tobytes() for a, n in zip(begins.tolist(), lengths.tolist())]
                made = {
                    "shard": np.full(len(lengths), shard, np.int32),
                    "doc_id": nullable(names, none),
                    "within": first + begins,
                    "n_tokens": lengths,
                    "ids_crc32": [zlib.crc32(p) for p in parts],
                }
                yield pd.DataFrame(made | ({"ids": parts} if with_ids else {}))

    ids = F.transform("doc_ids", lambda x: F.coalesce(x, F.lit(0).cast("long"))).alias("doc_ids")
    none = F.transform("doc_ids", lambda x: x.isNull()).alias("no_ids")
    rows = chunks.select("shard", "first", ids, none, "payload").mapInPandas(run, schema)
    return rows.join(shard_starts(chunks), "shard").select(
        "doc_id",
        (F.col("before") + F.col("within")).alias("start"),
        "n_tokens",
        "ids_crc32",
        *["ids"] * with_ids,
    )
