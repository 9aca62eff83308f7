"""Importance resampling of documents towards a target, by hashed word n-grams.

Every run of ``low`` to ``high`` consecutive words is a feature; its bucket is the CRC-32 of its
words joined by one space, modulo ``BUCKETS``. A bucket's gain is a thousand times the log of how much
more common it is in the target than in the documents, a document's weight the mean gain of its features.
With Gumbel noise from the id added, the highest scores are a sample without replacement in which
documents like the target are more likely.

A document is scanned once: its words, joined by one space, are run through the CRC and the running
value is kept at every word's end. The value of any n-gram follows from two of those,
``crc(b) = crc(ab) xor shift(crc(a), len(b))``: appending ``len(b)`` bytes is a linear map over GF(2), which
is applied by tables for powers of two. No n-gram is ever built as a string.

Two scans: the first adds up ``BUCKETS`` counters for the documents and for the target, the second weighs
documents with the 10,000 gains. Scores are whole numbers in a range that the gains and the noise bound
(some 200,000 values), so the cutoff and each score's first rank come from a histogram, and rows are
only numbered within one score.

Input cases: null and empty texts have no words, weight 0 and no rank; a null id draws its noise as an empty
one and comes first among ties; repeated rows are ranked one after the other; empty tables give empty
results; with an empty target the gains only follow how rare a bucket is; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagesift.llm.common import as_bytes
from pagesift.session import written

BUCKETS = 10_000
MIN_WORDS = 20
"""Shorter documents are never drawn."""
PERCENT = 10
"""Share of the other documents that is drawn."""
SEED = "2024"
SLICE_BYTES = 1 << 22
"""Text that is held as words at a time; a longer document is taken whole."""

_WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_ALL = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    """CRC-32 register after one byte, from a register that holds just that byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return table


_BYTE_TABLE = _byte_table()


def _linear_tables(images: np.ndarray) -> np.ndarray:
    """A linear map, given by where it takes each bit, as four tables of 256, one for each byte of its argument."""
    tables = np.zeros((4, 256), dtype=np.uint32)
    for bit in range(32):
        byte, place = divmod(bit, 8)
        has = (np.arange(256) >> place) & 1 == 1
        tables[byte, has] ^= images[bit]
    return tables


def _apply(tables: np.ndarray, v: np.ndarray) -> np.ndarray:
    low = np.uint32(255)
    return tables[0][v & low] ^ tables[1][(v >> np.uint32(8)) & low] ^ tables[2][(v >> np.uint32(16)) & low] ^ tables[3][v >> np.uint32(24)]


_SHIFTS: list[np.ndarray] = []


def _shift_tables(power: int) -> np.ndarray:
    """The map of appending 2**power bytes, each by squaring the one before."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    while len(_SHIFTS) <= power:
        images = _apply(_SHIFTS[-1], _apply(_SHIFTS[-1], bits)) if _SHIFTS else _BYTE_TABLE[bits & np.uint32(255)] ^ (bits >> np.uint32(8))
        _SHIFTS.append(_linear_tables(images))
    return _SHIFTS[power]


def shift(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What each CRC of a prefix adds to the CRC of the prefix and ``length`` bytes more."""
    out = crcs.astype(np.uint32)
    for power in range(int(lengths.max(initial=0)).bit_length()):
        at = np.flatnonzero((lengths >> power) & 1)
        out[at] = _apply(_shift_tables(power), out[at])
    return out


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Scan:
    """Running CRCs of a few normalised documents, from which their n-grams' CRCs are taken."""

    def __init__(self, texts: list[bytes]):
        ends: list[int] = []
        sizes: list[int] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            words = words_of(text)
            if not words:
                continue
            counts[i] = len(words)
            state = crc32(words[0])
            ends.append(state)
            # the space before a word belongs to what is run through with it
            ends += [state := crc32(word, crc32(b" ", state)) for word in words[1:]]
            sizes += map(len, words)
        self.counts = counts
        self.ends = np.array(ends, dtype=np.uint32)
        self.after = np.cumsum(np.array(sizes, dtype=np.int64) + 1)  # bytes up to a word and its space, over all texts
        self.sizes = np.array(sizes, dtype=np.int64)
        self.doc = np.repeat(np.arange(len(texts)), counts)
        self.starts = np.zeros(len(ends), dtype=np.uint32)
        register = self.ends[:-1] ^ _ALL
        self.starts[1:] = (_BYTE_TABLE[(register ^ np.uint32(0x20)) & np.uint32(255)] ^ (register >> np.uint32(8))) ^ _ALL
        firsts = (np.cumsum(counts) - counts)[counts > 0]
        self.starts[firsts] = 0

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """CRCs of all runs of n words, and the document of each."""
        total = len(self.ends) - n + 1
        if total <= 0:
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.doc[:total] == self.doc[n - 1 :])
        last = at + n - 1
        lengths = self.after[last] - self.after[at] + self.sizes[at]
        return self.ends[last] ^ shift(self.starts[at], lengths), self.doc[at]


def _scans(texts: list[bytes]) -> Iterator[tuple[int, Scan]]:
    """Scans of so many documents at a time that their words stay small, each with the number of its first."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > SLICE_BYTES:
            yield start, Scan(texts[start:i])
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, Scan(texts[start:])


def bucket_counts(texts: DataFrame, low: int, high: int) -> np.ndarray:
    """Features of all texts by bucket; each task sends one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, scan in _scans(as_bytes(batch.column(0))):
                for n in range(low, high + 1):
                    counts += np.bincount(scan.ngrams(n)[0] % np.uint32(BUCKETS), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(counts[at], pa.int64())})

    rows = texts.mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS rows
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for r in rows:
        counts[r["bucket"]] = r["n"]
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    pairs = zip(source.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in pairs], dtype=np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, low: int, high: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_features, weight."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            words = np.zeros(batch.num_rows, dtype=np.int64)
            features, sums = words.copy(), words.copy()
            for start, scan in _scans(as_bytes(batch.column(1))):
                end = start + len(scan.counts)
                words[start:end] = scan.counts
                for n in range(low, high + 1):
                    crcs, doc = scan.ngrams(n)
                    totals = np.concatenate(([0], np.cumsum(gain[crcs % np.uint32(BUCKETS)])))
                    edges = np.searchsorted(doc, np.arange(len(scan.counts) + 1))
                    features[start:end] += np.diff(edges)
                    sums[start:end] += np.diff(totals[edges])
            weight = np.where(features > 0, sums // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def _noise(seed: str):
    """Gumbel noise in thousandths, from the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED) -> DataFrame:
    """docs(doc_id, text), target(text) -> doc_id, n_words, n_features, weight, score, rank; rank is null for what is not drawn."""
    if not 1 <= low <= high:
        raise ValueError("n-grams need 1 <= low <= high")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gains = bucket_gains(bucket_counts(docs.select("text"), low, high), bucket_counts(target.select(F.col("text").cast("string")), low, high))
    scored = written(weigh(docs, gains, low, high).withColumn("score", F.col("weight") + _noise(seed)), "scored")
    able = F.col("n_words") >= min_words
    counts = sorted(scored.where(able).groupBy("score").count().collect(), reverse=True)  # one row a score, see above
    wanted = percent * sum(n for _, n in counts) // 100
    first, offsets = 0, []
    for score, n in counts:
        if first >= wanted:
            break
        offsets.append((score, first))
        first += n
    cut = offsets[-1][0] if offsets else None
    drawable = F.lit(False) if cut is None else able & (F.col("score") >= cut)
    within = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_first("doc_id"), "weight", "n_words"))
    starts = spark.createDataFrame(offsets, "score bigint, start bigint")
    ranked = scored.where(drawable).withColumn("k", within).join(F.broadcast(starts), "score")
    place = F.col("start") + F.col("k")
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    drawn = ranked.select(*columns, F.when(place <= wanted, place).cast("bigint").alias("rank"))
    return drawn.unionByName(scored.where(~drawable).select(*columns, F.lit(None).cast("bigint").alias("rank")))
