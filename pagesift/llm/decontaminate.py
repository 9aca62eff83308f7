"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every run of ``window`` consecutive words of a benchmark item is a pattern; an item of fewer
words is one pattern. For patterns of one length m the search looks at the last two words of
the current window of the text (one word where m is 1). A block shift table tells how far the
window may move without missing an occurrence; a block that no pattern holds moves it by
m - 1 words, so most of a clean text is never looked at. Where the shift is zero, the block's
bucket gives the patterns that end in it, and a direct comparison of the words confirms them.

The patterns are a stated set held against all rows: they are read in blocks of at most
``block_bytes`` of item text and each block is broadcast on its own, so a broadcast never
exceeds that bound. Documents are only mapped over, never shuffled; the passes of several
blocks are chained and carry the hit words along.

Input cases: null text (document or item) has no words; an item without words has no
pattern; items with equal text all count, rows repeated in the benchmark under one item id
count once, and a null item id is left out of the items but its words are hit; repeated
documents each get their row; an empty table on either side gives no hits; other columns of
the documents are carried through unless they clash with a result column, which wins.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 8 << 20
"""Item text per block of patterns."""

_LOWER = bytes(range(256)).lower()
# words are digits, letters and everything beyond ASCII
_TO_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in _LOWER)

_STATE = T.StructType([T.StructField("__words", T.LongType()), T.StructField("__hit", T.BinaryType()), T.StructField("__items", T.ArrayType(T.LongType()))])


def words_of(text: bytes) -> list[bytes]:
    """Lower-case ASCII letters, then runs of letters, digits and non-ASCII characters."""
    return text.translate(_TO_WORDS).split()


class Patterns:
    """Shift tables and buckets of one block of patterns, by pattern length."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        owners: dict[int, dict[tuple[bytes, ...], set]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = words_of(text)
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if words else 0):
                owners[size][tuple(words[i : i + size])].add(item)
        self.tables = []
        for size, patterns in sorted(owners.items()):
            width = min(2, size)
            shift: dict[tuple[bytes, ...], int] = {}
            buckets: dict[tuple[bytes, ...], list] = defaultdict(list)
            for pattern, items_of in patterns.items():
                for end in range(width, size + 1):
                    block = pattern[end - width : end]
                    shift[block] = min(shift.get(block, size), size - end)
                buckets[pattern[-width:]].append((pattern, sorted(i for i in items_of if i is not None)))
            self.tables.append((size, width, shift, dict(buckets)))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, list[int]]]:
        """Start, length and items of every occurrence."""
        total = len(words)
        for size, width, shift, buckets in self.tables:
            free = size - width + 1
            end = size
            while end <= total:
                block = tuple(words[end - width : end])
                step = shift.get(block, free)
                if step:
                    end += step
                    continue
                start = end - size
                for pattern, items in buckets[block]:
                    if words[start] == pattern[0] and tuple(words[start:end]) == pattern:
                        yield start, size, items
                end += 1


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, bytes]]]:
    block, held = [], 0
    for row in benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("text IS NOT NULL").toLocalIterator(prefetchPartitions=False):
        text = row[1].encode()
        if block and held + len(text) > block_bytes:
            yield block
            block, held = [], 0
        block.append((row[0], text))
        held += len(text)
    if block:
        yield block


def _pass(shared, at: int):
    """Adds the hits of one block of patterns to the three state columns, which follow the text at ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = shared.value
        for batch in batches:
            counts, hits, items = [], [], []
            before = (batch.column(at + 2).to_pylist(), batch.column(at + 3).to_pylist())
            for text, hit, had in zip(batch.column(at).cast(pa.binary()).to_pylist(), *before, strict=True):
                words = words_of(text) if text else []
                marks = np.frombuffer(hit, dtype=np.uint8).copy() if hit else None
                owners = set(had or ())
                for start, size, own in patterns.search(words):
                    if marks is None:
                        marks = np.zeros(len(words), dtype=np.uint8)
                    marks[start : start + size] = 1
                    owners.update(own)
                counts.append(len(words))
                hits.append(marks.tobytes() if marks is not None else None)
                items.append(sorted(owners))
            arrays = batch.columns[: at + 1] + [pa.array(counts, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return run


def _count(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            hits = batch.column(at + 2).to_pylist()
            counts = pa.array([len(words_of(t)) if t else 0 for t in texts], pa.int64())
            marked = pa.array([h.count(1) if h else 0 for h in hits], pa.int64())
            yield pa.RecordBatch.from_arrays(batch.columns[: at + 1] + [counts, marked, batch.column(at + 3)], names=batch.schema.names[: at + 1] + ["n_words", "n_hit", "items"])

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs(doc_id, text, …) -> all its columns with n_words, n_hit, items (sorted item ids), contaminated.

    A document is contaminated if 20 * n_hit >= n_words and anything is hit.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("text", "n_words", "n_hit", "items", "contaminated") and not re.match("__(words|hit|items)$", c)]
    state = docs.select(*(F.col(f"`{c}`") for c in kept), F.col("text").cast("string").alias("text"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in _STATE))
    at = len(kept)
    for block in _blocks(benchmark, block_bytes):
        state = state.mapInArrow(_pass(spark.sparkContext.broadcast(Patterns(block, window)), at), state.schema)
    schema = T.StructType(state.schema.fields[: at + 1]).add("n_words", T.LongType()).add("n_hit", T.LongType()).add("items", T.ArrayType(T.LongType()))
    counted = state.mapInArrow(_count(at), schema)
    items = F.coalesce("items", F.array().cast("array<bigint>"))
    return counted.withColumn("items", items).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
