"""Approximate search by banded hash tables that are probed several times each.

A vector's sign bits against fixed hyperplanes are cut into bands; the index is one row
``(slot, page_id)`` for each band, a slot being the band and its bits. A query looks up, in each
band, its own slot and those that differ in the bits it is least sure of: the ones whose
hyperplanes it lies closest to. Candidates come from an equi-join on the slot, so no page is met that
shares no slot with the query, and are scored exactly: the answer is a part of the exact one.

``plan_bands`` picks the cut from the threshold and the wanted recall. Where the slots to look up would
hold more than a given share of all pages (low thresholds), search is exact instead.

Equal vectors are one class, on both sides, so a vector that is a third of all pages is one row of
its slot; classes are widened to their k smallest ids only when hits are ranked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagesift import schemas as S
from pagesift.operators.search import SIGNATURE_BITS, _matrix, _planes, _QuerySet, _scans, _unit_rows, search_topk
from pagesift.session import written

RECALL = 0.95
MAX_SHARE = 0.2
"""Above this expected share of pages to be scored, search is exact."""
MAX_PROBES = 4_096
"""Slots that one query looks up in all bands, at most."""


@dataclass(frozen=True)
class Bands:
    """``count`` bands of ``width`` bits; ``probes`` slots are looked up in each, of at most ``flips`` other bits."""

    count: int
    width: int
    flips: int
    probes: int

    @property
    def share(self) -> float:
        """Of pages unlike the query, those in some slot that it looks up."""
        return min(1.0, self.count * self.probes / 2**self.width)


@lru_cache(maxsize=64)
def plan_bands(min_similarity: float, recall: float = RECALL, bits: int = SIGNATURE_BITS) -> Bands:
    """The cut that scores fewest pages and finds a page at the threshold with at least ``recall``.

    Each bit differs with probability angle / pi, so a band within ``r`` flips is binomial. As many slots
    are looked up as have at most r flips, but the likeliest ones of at most r + 1, which can only find more.
    """
    p = math.acos(max(-1.0, min(1.0, min_similarity))) / math.pi
    plans = []
    for width in range(4, 21):
        for r in range(0, 4):
            found = sum(math.comb(width, i) * p**i * (1 - p) ** (width - i) for i in range(r + 1))
            probes = sum(math.comb(width, i) for i in range(r + 1))
            count = 1 if found >= recall else math.ceil(math.log(1 - recall) / math.log(1 - found)) if found > 0 else bits
            if count * width <= bits and count * probes <= MAX_PROBES and r < width:
                plans.append(Bands(count, width, r + 1, probes))
    return min(plans, key=lambda b: (b.share, b.count), default=Bands(1, 4, 1, 16))


def classes_of(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages(page_id, vector) -> classes of equal vectors (page_id of the smallest member, vector), and members(class_id, page_id).

    Vectors are told apart by 128 bits of hash. One row a task and class meets the exchange.
    """
    keyed = pages.where(F.col("vector").isNotNull()).select("page_id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))
    first = Window.partitionBy("h1", "h2").orderBy("page_id")
    heads = written(keyed.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn"), "classes")
    heads_of = heads.select("h1", "h2", F.col("page_id").alias("class_id"))
    members = keyed.select("page_id", "h1", "h2").join(heads_of, ["h1", "h2"]).select("class_id", "page_id")
    return heads.select("page_id", "vector"), members


def _slots(bits: np.ndarray, bands: Bands) -> np.ndarray:
    """Own slot of each vector in each band."""
    weights = 1 << np.arange(bands.width, dtype=np.int64)
    codes = bits[:, : bands.count * bands.width].reshape(len(bits), bands.count, bands.width) @ weights
    return codes + (np.arange(bands.count, dtype=np.int64) << bands.width)


def build_bands(pages: DataFrame, dim: int, bands: Bands) -> DataFrame:
    """The index ``(slot, page_id)``: a map-only pass, to be stored (bucketed by slot, lookups need no shuffle of it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = _planes(dim, SIGNATURE_BITS)[: bands.count * bands.width].T
        for batch in batches:
            bits = (_matrix(batch.column("vector"), dim) @ planes >= 0).astype(np.int64)
            ids = np.repeat(batch.column("page_id").to_numpy(), bands.count)
            yield pa.RecordBatch.from_arrays([pa.array(_slots(bits, bands).ravel()), pa.array(ids)], names=["slot", "page_id"])

    return pages.select("page_id", "vector").where(F.col("vector").isNotNull()).mapInArrow(run, "slot bigint, page_id bigint")


def _flips(bands: Bands) -> np.ndarray:
    """All sets of at most ``flips`` bits, as rows of zeros and ones; smaller numbers first."""
    sets = [c for r in range(bands.flips + 1) for c in combinations(range(bands.width), r)]
    rows = np.zeros((len(sets), bands.width), dtype=np.int64)
    for row, chosen in zip(rows, sets, strict=True):
        row[list(chosen)] = 1
    return rows[np.argsort(rows @ (1 << np.arange(bands.width)))]


def probe_slots(queries: DataFrame, dim: int, bands: Bands) -> DataFrame:
    """queries(query_id, vector) -> (query_id, slot): the slots to look up, likeliest first in each band.

    Flipping bits costs the sum of their squared distances from their hyperplanes; the cheapest
    sets are taken, ties by the smaller number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = _planes(dim, SIGNATURE_BITS)[: bands.count * bands.width].T
        flips = _flips(bands)
        numbers = flips @ (1 << np.arange(bands.width, dtype=np.int64))
        for batch in batches:
            for query, vector in zip(batch.column("query_id").to_pylist(), _matrix(batch.column("vector"), dim), strict=True):
                margins = vector @ planes
                costs = flips @ (margins.reshape(bands.count, bands.width) ** 2).T
                best = np.argsort(costs, axis=0, kind="stable")[: bands.probes]
                own = _slots((margins >= 0).astype(np.int64)[None, :], bands)[0]
                slots = (numbers[best] ^ own[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slots), query, dtype=np.int64)), pa.array(slots)], names=["query_id", "slot"])

    return queries.select("query_id", "vector").mapInArrow(run, "query_id bigint, slot bigint")


def candidates(index: DataFrame, probes: DataFrame) -> DataFrame:
    """Pairs ``(query_id, page_id)`` that share a slot, each once."""
    return _meet(index, probes).select("query_id", "page_id").distinct()


def _meet(index: DataFrame, probes: DataFrame) -> DataFrame:
    """The equi-join on the slot. One query has thousands of probes, which the planner cannot know: neither side is to be broadcast."""
    return index.hint("merge").join(probes.hint("merge"), "slot")


def search_banded(
    pages: DataFrame,
    queries: DataFrame,
    dim: int,
    k: int = S.DEFAULT_K,
    min_similarity: float = S.MIN_SIMILARITY,
    recall: float = RECALL,
    max_share: float = MAX_SHARE,
) -> DataFrame:
    """Approximate top-k, as ``search_topk`` gives it: ``(query_id, rk, page_id, sim)``.

    ``pages(page_id, vector)`` with one row an id, ``queries(query_id, vector[, k])``.
    """
    bands = plan_bands(min_similarity, recall)
    if bands.share > max_share:
        return search_topk(pages, queries, k, min_similarity)
    wanted = (F.col("k") if "k" in queries.columns else F.lit(k)).cast("bigint").alias("k")
    asked = written(queries.where(F.col("vector").isNotNull()).select("query_id", "vector", wanted), "asked")
    kinds, askers = classes_of(asked.select(F.col("query_id").alias("page_id"), "vector"))
    kinds = kinds.withColumnRenamed("page_id", "query_id")
    heads, members = classes_of(pages)
    index = written(build_bands(heads, dim, bands), "bands")
    most = int(asked.agg(F.max("k")).first()[0] or 0)

    def run(group: list[_QuerySet]) -> DataFrame:
        q = group[0]
        shared = pages.sparkSession.sparkContext.broadcast(q)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = shared.value
            order = np.argsort(q.ids)
            for batch in batches:
                ids = batch.column("page_id").to_numpy()
                unit = _unit_rows(_matrix(batch.column("vector"), q.dim))
                lists = batch.column("near")
                at_query = order[np.searchsorted(q.ids[order], lists.flatten().to_numpy())]
                at_page = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
                for lo in range(0, len(at_query), 100_000):
                    qs, ps = at_query[lo : lo + 100_000], at_page[lo : lo + 100_000]
                    sims = np.einsum("ij,ij->i", q.unit[qs], unit[ps])
                    hit = sims > min_similarity
                    columns = [pa.array(q.ids[qs[hit]]), pa.array(q.k[qs[hit]].astype(np.int64)), pa.array(ids[ps[hit]]), pa.array(np.round(sims[hit], 6))]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "k", "page_id", "sim"])

        block = pages.sparkSession.createDataFrame(pa.table({"query_id": q.ids, "vector": pa.array(q.unit.tolist(), pa.list_(pa.float64()))}))
        found = _meet(index, probe_slots(block, dim, bands))
        near = written(found.groupBy("page_id").agg(F.collect_set("query_id").alias("near")), "near")  # at most one block of queries
        return near.join(heads, "page_id").select("page_id", "near", "vector").mapInArrow(score, "query_id bigint, k bigint, page_id bigint, sim double")

    # a class is named by its smallest id, so the best k pages lie in the best k classes
    first = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "page_id")
    found, _ = _scans(kinds, most, run, 1)
    hits = written(found.withColumn("rk", F.row_number().over(first)).where(F.col("rk") <= most), "class-hits")
    # and of a class only its k smallest ids can be among them
    few = Window.partitionBy("class_id").orderBy("page_id")
    hit_classes = hits.select(F.col("page_id").alias("class_id")).distinct()
    widened = members.join(hit_classes, "class_id").withColumn("rn", F.row_number().over(few)).where(F.col("rn") <= most).drop("rn")
    best = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "page_id")
    spread = hits.select(F.col("query_id").alias("kind"), F.col("page_id").alias("class_id"), "sim").join(widened, "class_id")
    ranked = spread.select(F.col("kind").alias("query_id"), "page_id", "sim").withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= most)
    own = askers.select(F.col("class_id").alias("kind"), F.col("page_id").alias("query_id")).join(asked.select("query_id", "k"), "query_id")
    answers = ranked.withColumnRenamed("query_id", "kind").join(own, "kind").where(F.col("rk") <= F.col("k"))
    return answers.select("query_id", "rk", "page_id", "sim")
