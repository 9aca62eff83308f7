"""Set-similarity self join of documents on word n-grams, and its connected components.

Rare-first prefix filtering: the n-grams of a document are ordered by a global order that puts
rare ones first; two documents with Jaccard similarity t or more share an n-gram among the first
``n - ceil(t * n) + 1`` of either. Candidates are joined on those, thinned by a length filter,
a positional filter and a suffix filter (bitmaps, then counts, of n-grams by hash range bound the
overlap), and each remaining pair is verified once on the whole sets.

How it runs at scale
    * Frequencies for the order come from counters over all n-grams of all documents, added up
      in Spark; there is a fixed number of them, so what is broadcast has a fixed
      size. Any order that all documents share gives the same links; a better one is faster.
    * Documents with equal sets are one class, found by a grouped minimum; only one row a class
      takes part in the join.
    * Near copies in thousands would give pairs in millions. Therefore each n-gram first links
      its classes with a few leaders (``LEADERS``), which is linear; what is verified is merged
      to components. The last join then takes every pair of classes
      that share a prefix n-gram and are not in one component yet, so no link between components
      can be missed, and pairs inside a component are never formed.
    * Filters work on a few numbers a class. Whole sets are made only for the classes of pairs
      that pass them; flags of fixed number let the scan leave most other texts where they are.
    * Class numbers are 64-bit fingerprints of sets; results carry the smallest document id.

Input cases: null text or text without words has an empty set and is linked with nothing;
fewer words than an n-gram make the whole sequence one n-gram; a null id counts as the smallest
id and a component that holds it has a null component_id; rows that repeat an id get one row
each; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import NO_ID, as_bytes, counter_bytes, doc_key, forget, mix, window_hashes, word_hashes
from pagesift.llm.components import components
from pagesift.session import written

COUNTER_BITS = 23
"""2**23 frequency counters; a byte each is broadcast."""
WANTED_BITS = 22
"""Flags, a byte each, that tell in a scan which documents a join may want."""
LEADERS = 3
"""Classes of each n-gram that its other classes are compared with first."""
BATCH_BYTES = 2 << 20
RANGES = 256
"""Hash ranges of the suffix filter; with many, unrelated long documents fail it too."""

BITMAP = ["b0", "b1", "b2", "b3", "b4", "b5", "b6", "b7"]
"""Columns of the bitmap, 64 bits each: for each hash range, whether a set has an odd number of n-grams in it."""

_BASE = 0xD1B54A32D192ED03


def _lower(text: bytes) -> bytes:
    return text.lower()  # bytes.lower() changes A-Z only


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text."""
    words, counts = word_hashes([_lower(t) for t in texts])
    whole = window_hashes(words, size, _BASE)
    sets, at = [], 0
    for n in counts.tolist():
        if n >= size:
            sets.append(np.unique(whole[at : at + n - size + 1]))
        elif n:
            one = np.array([0x51ED2701 + n], dtype=np.uint64)
            for w in words[at : at + n]:
                one = mix(one * np.uint64(0x2545F4914F6CDD1D) + w)
            sets.append(one)
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
        at += n
    return sets


def _text_batches(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut to runs of rows of about ``BATCH_BYTES`` of text."""
    for batch in batches:
        texts = as_bytes(batch.column(at))
        start, held = 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= BATCH_BYTES or i == len(texts) - 1:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, held = i + 1, 0


def frequency_classes(docs: DataFrame, size: int) -> bytes:
    """One byte a counter: twice the binary logarithm of how many documents' n-grams fell on it, over all documents."""

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, texts in _text_batches([batch], 0):
            yield np.concatenate(shingle_sets(texts, size))

    return counter_bytes(docs.select("text"), hashes, COUNTER_BITS, lambda n: np.floor(2 * np.log2(n + 1.0)))


def _range_counts(grams: np.ndarray) -> bytes:
    counts = np.bincount((grams >> np.uint64(16)).astype(np.int64) % RANGES, minlength=RANGES)
    return counts.astype(np.uint16 if counts.max() < 1 << 16 else np.uint32).tobytes()


def _counts_of(ranges: bytes) -> np.ndarray:
    return np.frombuffer(ranges, np.uint16 if len(ranges) == 2 * RANGES else np.uint32).astype(np.int64)


def _index(shared, size: int, num: int, den: int):
    """Each document's set size, fingerprint, prefix and range counts."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("prefix", pa.list_(pa.int64())), ("ranges", pa.binary()), *((b, pa.int64()) for b in BITMAP)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        classes = np.frombuffer(shared.value, dtype=np.uint8)
        for batch, texts in _text_batches(batches, 3):
            ns, f1, f2, prefixes, ranges, bitmaps = [], [], [], [], [], []
            for s in shingle_sets(texts, size):
                n = len(s)
                ns.append(n)
                f1.append(int(mix(s ^ np.uint64(0x9FB21C651E98DF25)).sum(dtype=np.uint64).view(np.int64)))
                f2.append(int(mix(s * np.uint64(0x9E6C63D0876A9A47) + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)))
                first = n - -(-num * n // den) + 1 if n else 0
                order = np.argsort(classes[(s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)], kind="stable")[:first]  # ties by hash, as s is sorted
                prefixes.append(s[order].view(np.int64))
                ranges.append(_range_counts(s))
                bits = np.bincount((s >> np.uint64(16)).astype(np.int64) % (64 * len(BITMAP)), minlength=64 * len(BITMAP)) & 1
                bitmaps.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
            lengths = np.cumsum([0] + [len(p) for p in prefixes])
            lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(prefixes), pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ns, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), lists, pa.array(ranges, pa.binary()), *(pa.array(c, pa.int64()) for c in np.array(bitmaps).T)], schema=schema)

    return run, "k1 bigint, k2 bigint, doc_id bigint, n bigint, f1 bigint, f2 bigint, prefix array<bigint>, ranges binary, " + ", ".join(f"{b} bigint" for b in BITMAP)


def _sets(shared, size: int):
    """Sets of the flagged documents, which hold all that are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        flags = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            spots = batch.column(2).to_numpy().view(np.uint64) >> np.uint64(64 - WANTED_BITS)
            batch = batch.filter(pa.array(flags[spots.astype(np.int64)] > 0))
            for part, texts in _text_batches([batch], 3):
                grams = pa.array([s.tobytes() for s in shingle_sets(texts, size)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), grams], names=["k1", "k2", "grams"])

    return run


def _roomy(num: int, den: int):
    """Pairs whose counts by hash range leave room for the wanted overlap: u, v, n1, n2, and the counts of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = (batch.column(2).to_numpy() + batch.column(3).to_numpy()).tolist()
            ranges = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), sizes, strict=True)
            fits = [(den + num) * int(np.minimum(_counts_of(a), _counts_of(b)).sum()) >= num * n for a, b, n in ranges]
            yield batch.select(["u", "v"]).filter(pa.array(fits, pa.bool_()))

    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = np.concatenate((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)))
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                linked.append(den * shared >= num * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["u", "v", "linked"])

    return run


def _may_link(num: int, den: int, n1: Column, p1: Column, bits1: list[Column], n2: Column, p2: Column, bits2: list[Column]) -> Column:
    """Length, positional and bitmap filter of a pair that shares an n-gram at places p1 and p2 of the order.

    An n-gram that only one set has changes one bit, so the bitmaps differ in at most as many
    bits as the sets differ in n-grams. As part of a join's condition it keeps near misses of
    a large group from ever becoming rows.
    """
    short, long = F.least(n1, n2), F.greatest(n1, n2)
    most = F.least(p1, p2) + 1 + F.least(n1 - p1 - 1, n2 - p2 - 1)
    differ = reduce(lambda a, b: a + b, [F.bit_count(a.bitwiseXOR(b)) for a, b in zip(bits1, bits2, strict=True)])
    return (den * short >= num * long) & ((den + num) * most >= num * (n1 + n2)) & ((den + num) * differ <= (den - num) * (n1 + n2))


class NgramJoin:
    """The join of one document table; see the module for how it works."""

    def __init__(self, docs: DataFrame, size: int, num: int, den: int):
        self.size, self.num, self.den = size, num, den
        self.spark = docs.sparkSession
        k1, k2 = doc_key()
        self.docs = docs.select(k1.alias("k1"), k2.alias("k2"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        shared = self.spark.sparkContext.broadcast(frequency_classes(self.docs, size))
        run, ddl = _index(shared, size, num, den)
        self.indexed = written(self.docs.mapInArrow(run, ddl), "indexed")
        cls = F.xxhash64("f1", "f2", "n").alias("cls")
        self.classes = self.indexed.where("n > 0").groupBy(cls, "n").agg(
            F.min(F.struct("k1", "k2")).alias("first"), F.first("prefix").alias("prefix"), F.first("ranges").alias("ranges"),
            *(F.first(b).alias(b) for b in BITMAP),
        )
        self.heads = written(self.classes.select("cls", "n", "first", "ranges", *BITMAP), "heads")

    def _active(self) -> DataFrame:
        """Prefix entries of n-grams that two classes or more have in their prefixes."""
        entries = self.classes.select("cls", "n", F.posexplode("prefix").alias("pos", "gram"))
        narrow = entries.select("gram", "cls", "n", F.col("pos").cast("bigint").alias("pos"))
        counts = narrow.groupBy("gram").agg(F.count("*").alias("many"))
        shared = narrow.join(counts.where("many > 1"), "gram").select("gram", "cls", "n", "pos")
        return shared.join(self.heads.select("cls", *BITMAP), "cls")

    def _filtered(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs whose counts by hash range leave room for the wanted overlap."""
        a = self.heads.select(F.col("cls").alias("u"), F.col("n").alias("n1"), F.col("ranges").alias("r1"))
        b = self.heads.select(F.col("cls").alias("v"), F.col("n").alias("n2"), F.col("ranges").alias("r2"))
        met = pairs.distinct().join(a, "u").join(b, "v").select("u", "v", "n1", "n2", "r1", "r2")
        return written(met.mapInArrow(_roomy(self.num, self.den), "u bigint, v bigint"), "pairs")

    def _wanted_sets(self, pairs: DataFrame) -> DataFrame:
        """cls, grams of the classes of pairs, made from the text of the first document of each."""
        classes = pairs.select(F.col("u").alias("cls")).unionByName(pairs.select(F.col("v").alias("cls"))).distinct()
        wanted = written(self.heads.join(classes, "cls").select("cls", "first.k1", "first.k2"), "wanted")
        spot = F.xxhash64("k1", "k2")
        flags = counter_bytes(wanted.select(spot), lambda batch: [batch.column(0).to_numpy().view(np.uint64)], WANTED_BITS, lambda n: np.minimum(n, 1))
        shared = self.spark.sparkContext.broadcast(flags)
        sets = self.docs.select("k1", "k2", spot, "text").mapInArrow(_sets(shared, self.size), "k1 bigint, k2 bigint, grams binary")
        return written(sets.join(wanted, ["k1", "k2"]).select("cls", "grams"), "sets")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """pairs(u, v) with the outcome of the comparison of the whole sets."""
        sets = self._wanted_sets(pairs)
        left = pairs.join(sets.select(F.col("cls").alias("u"), F.col("grams").alias("g1")), "u")
        wide = left.join(sets.select(F.col("cls").alias("v"), F.col("grams").alias("g2")), "v").select("u", "v", "g1", "g2")
        # rows that repeat a document give its set more than once, hence distinct
        return written(wide.mapInArrow(_verify(self.num, self.den), "u bigint, v bigint, linked boolean").distinct(), "verified")

    def run(self) -> tuple[DataFrame, DataFrame]:
        """Documents with their class and component, and the verified links between classes."""
        active = written(self._active(), "active")
        first = self._verified(self._filtered(self._leader_pairs(active)))
        placed = self._placed(active, written(components(first.where("linked").select("u", "v")), "roots"))
        # n-grams whose classes are all in one component have nothing left to link
        split = placed.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("gram")
        rest = self._all_pairs(placed.join(split, "gram")).distinct().join(first.select("u", "v"), ["u", "v"], "left_anti")
        second = self._verified(self._filtered(rest))
        links = first.unionByName(second).where("linked").select("u", "v")
        roots = written(components(links), "roots")
        least = self._placed(self.heads.select("cls", "first"), roots)
        comps = least.groupBy("comp").agg(F.min("first").alias("least"))
        named = least.join(comps, "comp").select("cls", "least")
        members = self.indexed.select("doc_id", "k1", "k2", "n", F.when(F.col("n") > 0, F.xxhash64("f1", "f2", "n")).alias("cls")).join(named, "cls", "left")
        members = members.withColumn("least", F.when(F.col("n") > 0, F.col("least")).otherwise(F.struct("k1", "k2")))
        component = F.when(F.col("least.k1") != NO_ID, F.col("least.k1")).alias("component_id")
        stays = ((F.col("k1") == F.col("least.k1")) & (F.col("k2") == F.col("least.k2"))).alias("first")
        return members.select("doc_id", F.col("n").alias("n_shingles"), component, F.col("cls").alias("class_id"), stays, "k1", "k2"), links

    def _placed(self, rows: DataFrame, roots: DataFrame) -> DataFrame:
        return rows.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("root", "cls")).drop("root")

    def _leader_pairs(self, active: DataFrame) -> DataFrame:
        """Each class with the leaders of its n-grams: those with the smallest checksums."""
        entry = F.struct(F.col("cls").alias("c"), F.col("n").alias("m"), F.col("pos").alias("p"), *BITMAP)
        leaders = active.groupBy("gram").agg(*(F.min_by(entry, F.xxhash64("cls", F.lit(i))).alias(f"l{i}") for i in range(LEADERS)))
        leaders = leaders.select("gram", F.array_distinct(F.array(*(f"l{i}" for i in range(LEADERS)))).alias("leaders"))
        met = active.join(leaders, "gram").select("cls", "n", "pos", *BITMAP, F.explode("leaders").alias("lead")).where(F.col("cls") != F.col("lead.c"))
        own, other = [F.col(b) for b in BITMAP], [F.col(f"lead.{b}") for b in BITMAP]
        met = met.where(_may_link(self.num, self.den, F.col("n"), F.col("pos"), own, F.col("lead.m"), F.col("lead.p"), other))
        return met.select(F.least("cls", "lead.c").alias("u"), F.greatest("cls", "lead.c").alias("v"))

    def _all_pairs(self, placed: DataFrame) -> DataFrame:
        """Every pair of classes of different components that share an n-gram."""
        a = placed.select("gram", F.col("cls").alias("u"), F.col("n").alias("n1"), F.col("pos").alias("p1"), F.col("comp").alias("c1"), *BITMAP)
        b = placed.select(F.col("gram").alias("gram2"), F.col("cls").alias("v"), F.col("n").alias("n2"), F.col("pos").alias("p2"), F.col("comp").alias("c2"), *(F.col(x).alias(f"v_{x}") for x in BITMAP))
        near = _may_link(self.num, self.den, F.col("n1"), F.col("p1"), [F.col(x) for x in BITMAP], F.col("n2"), F.col("p2"), [F.col(f"v_{x}") for x in BITMAP])
        met = a.join(b, (F.col("gram") == F.col("gram2")) & (F.col("u") < F.col("v")) & (F.col("c1") != F.col("c2")) & near)
        return met.select("u", "v")


def ngram_join(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) -> (doc_id, n_shingles, component_id, class_id, first, k1, k2) and the links (u, v) between classes that were verified.

    ``first`` marks the document of each component with the smallest id; k1 and k2 are its
    ``doc_key``. Documents of one class have equal sets. Links hold at least one for every step that joins two
    components, not every pair inside one.
    """
    return NgramJoin(docs, size, num, den).run()
