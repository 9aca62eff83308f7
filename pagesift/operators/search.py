"""Similarity search: exact top-k, signature-based approximate top-k, responses."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift import schemas as S
from pagesift.operators.ops import running_totals
from pagesift.session import written

# Queries of one block. Their matrix of doubles is what gets broadcast, so its size is bounded
# too. Several blocks share a scan of the pages; a worker holds those of one scan.
MAX_QUERIES_PER_BLOCK = 16_384
MAX_QUERY_BYTES = 16 << 20
BLOCKS_PER_SCAN = 8
MAX_KEPT_ROWS = 1_000_000  # hits held by a task; with more, what it has is sent on and ranked later
RANK_IN_WINDOW = 10_000  # up to this k a query's rows are ranked in one window; beyond it by threshold and slices
PART_ROWS = 1_000  # hits of one part of a long response
_RANK_BUCKETS = 64
_CELLS = 1_000  # histogram cells for each 1.0 of similarity
_HITS = "query_id bigint, k bigint, page_id bigint, sim double"
_MAX_CELLS = 8_000_000


def validate_requests(requests: DataFrame, default_k: int = S.DEFAULT_K) -> DataFrame:
    """``(query_id, q, k, status)`` of search requests ``(query_id, q, limit)``; limit is text.

    Empty ``q``, a limit that is not a whole number, or one below 1 is status 400
    with a NULL k. A missing or empty limit is the default; there is no upper bound.
    """
    limit = F.coalesce("limit", F.lit(""))
    asked = F.when(limit == "", F.lit(default_k).cast("bigint")).otherwise(
        F.when(limit.rlike(r"^[+-]?[0-9]+$"), limit.try_cast("bigint"))
    )
    good = (F.coalesce("q", F.lit("")) != "") & F.coalesce(asked > 0, F.lit(False))
    return requests.select(
        "query_id",
        "q",
        F.when(good, asked).alias("k"),
        F.when(good, F.lit(200)).otherwise(F.lit(400)).alias("status"),
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * dim:
        raise ValueError(f"expected vectors of {dim} dimensions")
    return flat.reshape(len(column), dim).astype(np.float64)


def _unit_rows(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norms > 0, norms, 1.0)


class _QuerySet:
    """The bounded query side of one pass, as plain arrays."""

    def __init__(self, rows: pa.Table, default_k: int):
        vectors = rows.column("vector").combine_chunks()
        self.dim = len(vectors[0])
        self.ids = rows.column("query_id").to_numpy()
        self.unit = _unit_rows(_matrix(vectors, self.dim))
        self.k = rows.column("k").to_numpy() if "k" in rows.column_names else np.full(len(self.ids), default_k)


class _TopK:
    """Best k rows per query seen so far in one task, ordered by (similarity, id).

    Memory is bounded whatever k is: ``full`` tells when the rows should be sent on.
    """

    def __init__(self, k: np.ndarray):
        self.k = k
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0
        self.kept = 0

    def add(self, query: np.ndarray, page: np.ndarray, sim: np.ndarray) -> None:
        self.parts.append((query, page, sim))
        self.pending += len(query)
        if self.pending > max(200_000, 2 * self.kept):
            self.shrink()

    @property
    def full(self) -> bool:
        return self.kept > MAX_KEPT_ROWS

    def shrink(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            empty = np.empty(0, dtype=np.int64)
            return empty, empty, np.empty(0)
        query, page, sim = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((page, -sim, query))
        query, page, sim = query[order], page[order], sim[order]
        first = np.searchsorted(query, query, side="left")
        best = np.arange(len(query)) - first < self.k[query]
        self.parts = [(query[best], page[best], sim[best])]
        self.kept = self.pending = int(best.sum())
        return self.parts[0]

    def rows(self, ids: np.ndarray) -> pa.RecordBatch:
        """What is held, as rows; nothing is held any more."""
        query, page, sim = self.shrink()
        self.parts, self.kept, self.pending = [], 0, 0
        columns = [(ids[query], pa.int64()), (self.k[query], pa.int64()), (page, pa.int64()), (sim, pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["query_id", "k", "page_id", "sim"])


def _ranked(hits: DataFrame, largest: int, in_window: int) -> DataFrame:
    """Final ranking; queries that ask for more than ``in_window`` pages are ranked by threshold."""
    if largest <= in_window:
        return _ranked_in_window(hits)
    stored = written(hits, "unranked")
    few = _ranked_in_window(stored.where(F.col("k") <= in_window))
    return few.unionByName(_ranked_by_threshold(stored.where(F.col("k") > in_window)))


def _ranked_in_window(hits: DataFrame) -> DataFrame:
    """Two steps: the best k of each group of tasks, then the best k of those.

    One query's rows from all tasks never meet in one task before they are cut to k per group.
    """
    grouped = hits.withColumn("_bucket", F.pmod(F.spark_partition_id(), F.lit(_RANK_BUCKETS)))
    first = Window.partitionBy("query_id", "_bucket").orderBy(F.col("sim").desc(), "page_id")
    best = grouped.withColumn("rk", F.row_number().over(first)).where(F.col("rk") <= F.col("k")).drop("rk", "_bucket")
    last = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "page_id")
    return best.withColumn("rk", F.row_number().over(last)).where(F.col("rk") <= F.col("k")).select("query_id", "rk", "page_id", "sim")


def cut_by_threshold(hits: DataFrame) -> DataFrame:
    """The hits ``(query_id, k, page_id, sim)`` that can be among the best k of their query.

    A histogram of similarities per query (some thousand cells, pre-summed in each task) tells the
    lowest cell that may hold one of the best k; rows below it go. What stays of a query is at
    most k rows and the rest of one cell. No row is ordered for it.
    """
    cell = F.floor(F.col("sim") * _CELLS)
    cells = hits.groupBy("query_id", cell.alias("_cell")).agg(F.count("*").alias("_n"), F.max("k").alias("_k"))
    higher = Window.partitionBy("query_id").orderBy(F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    needed = cells.withColumn("_above", F.coalesce(F.sum("_n").over(higher), F.lit(0))).where(F.col("_above") < F.col("_k"))
    cuts = written(needed.groupBy("query_id").agg(F.min("_cell").alias("_cut")), "cuts")  # a row per query, of known size
    return hits.join(cuts, "query_id").where(cell >= F.col("_cut")).drop("_cut")


def _ranked_by_threshold(hits: DataFrame) -> DataFrame:
    """Ranking for any k: what the threshold leaves is cut into slices of (query, similarity, page), and a rank is a running count."""
    left = written(cut_by_threshold(hits).withColumn("_falling", -F.col("sim")), "survivors")
    ranks = running_totals(left, F.lit(1), "query_id", ("_falling", "page_id"), name="rk")
    return ranks.where(F.col("rk") <= F.col("k")).select("query_id", F.col("rk").cast("int").alias("rk"), "page_id", "sim")


def _scan(pages: DataFrame, blocks: list[_QuerySet], min_similarity: float) -> DataFrame:
    """Hits of several blocks of queries from one scan of the pages."""
    shared = [pages.sparkSession.sparkContext.broadcast(q) for q in blocks]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.value, _TopK(b.value.k)) for b in shared]
        for batch in batches:
            page_ids = batch.column("page_id").to_numpy()
            for q, best in held:
                unit = _unit_rows(_matrix(batch.column("vector"), q.dim))
                step = max(1, _MAX_CELLS // len(q.ids))
                for lo in range(0, len(page_ids), step):
                    sims = q.unit @ unit[lo : lo + step].T
                    at_query, at_page = np.nonzero(sims > min_similarity)
                    best.add(at_query, page_ids[lo + at_page], np.round(sims[at_query, at_page], 6))
                    if best.full:
                        yield best.rows(q.ids)
        for q, best in held:
            yield best.rows(q.ids)

    vectors = pages.select("page_id", "vector").where(F.col("vector").isNotNull())
    return vectors.mapInArrow(scan, _HITS)


def _blocks(queries: DataFrame, default_k: int) -> Iterator[_QuerySet]:
    """The query set in blocks by id hash; it is computed and written once and read block by block."""
    stored = written(queries, "queries")
    rows, size = stored.agg(F.count("*"), F.coalesce(F.sum(F.size("vector").cast("bigint") * 8), F.lit(0))).first()
    count = max(1, -(-rows // MAX_QUERIES_PER_BLOCK), -(-size // MAX_QUERY_BYTES))
    for i in range(count):
        block = stored.where(F.pmod(F.xxhash64("query_id"), F.lit(count)) == i).toArrow()
        if block.num_rows:
            yield _QuerySet(block, default_k)


def _scans(queries: DataFrame, default_k: int, run, blocks_per_scan: int) -> tuple[DataFrame, int]:
    """Hits of ``run(blocks)`` for groups of at most ``blocks_per_scan`` blocks, and the largest k; the groups but a lone one are written."""
    blocks, parts, largest = _blocks(queries, default_k), [], 0
    while group := list(islice(blocks, blocks_per_scan)):
        parts.append(run(group))
        largest = max(largest, *(int(b.k.max()) for b in group))
    if not parts:
        return queries.sparkSession.createDataFrame([], _HITS), largest
    return (parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, [written(p, "search-scan") for p in parts])), largest


def _query_columns(queries: DataFrame) -> DataFrame:
    cols = ["query_id", "vector"] + (["k"] if "k" in queries.columns else [])
    return queries.select(cols).where(F.col("vector").isNotNull())


def search_topk(
    pages: DataFrame,
    queries: DataFrame,
    k: int = S.DEFAULT_K,
    min_similarity: float = S.MIN_SIMILARITY,
    rank_in_window: int = RANK_IN_WINDOW,
) -> DataFrame:
    """Exact top-k pages per query: ``(query_id, rk, page_id, sim)``, best first.

    ``pages(page_id, vector)``, ``queries(query_id, vector[, k])``. Cosine similarity
    must be strictly above the threshold; ties go to the smaller id. Pages are scanned
    in place as matrix products against the broadcast queries; each task sends on at
    most k rows per query, and that is all that is ever shuffled. Any number of queries
    is taken in blocks, ``BLOCKS_PER_SCAN`` of them in one scan of the pages. Rows that
    repeat a query id count as one query with several vectors, which should ask for the same k.
    Queries that ask for more than ``rank_in_window`` pages never have their rows in one task.
    """
    hits, largest = _scans(_query_columns(queries), k, lambda group: _scan(pages, group, min_similarity), BLOCKS_PER_SCAN)
    return _ranked(hits, largest, rank_in_window)


# --- approximate search -------------------------------------------------------------

SIGNATURE_BITS = 512


@lru_cache(maxsize=4)
def _planes(dim: int, bits: int) -> np.ndarray:
    """Fixed pseudo-random +1/-1 hyperplanes: the parity of successive md5 digits."""
    rows = []
    for b in range(bits):
        digits = "".join(hashlib.md5(f"{b}:{block}".encode()).hexdigest() for block in range(-(-dim // 32)))
        rows.append([1.0 if int(d, 16) % 2 == 0 else -1.0 for d in digits[:dim]])
    return np.array(rows)


def _sign_words(m: np.ndarray, dim: int, bits: int) -> np.ndarray:
    packed = np.packbits(m @ _planes(dim, bits).T >= 0, axis=1)
    return packed.view(np.uint64)


def hamming_radius(min_similarity: float, bits: int = SIGNATURE_BITS, recall: float = 0.95) -> int:
    """Differing signature bits within which a pair at the threshold falls with probability ``recall``.

    Two vectors at angle t disagree on each bit with probability t/pi; pairs above the
    threshold are closer, so their recall is higher.
    """
    p = math.acos(min_similarity) / math.pi
    lo, hi = -8.0, 8.0
    while hi - lo > 1e-6:
        z = (lo + hi) / 2
        lo, hi = (z, hi) if 0.5 * (1 + math.erf(z / math.sqrt(2))) < recall else (lo, z)
    return math.floor(bits * p + lo * math.sqrt(bits * p * (1 - p)))


def build_signatures(pages: DataFrame, dim: int, bits: int = SIGNATURE_BITS) -> DataFrame:
    """The approximate index: ``(page_id, signature)``, one bit per hyperplane.

    A column to store beside the vectors, computed once at write time by a map-only pass.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _sign_words(_matrix(batch.column("vector"), dim), dim, bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array([w.tobytes() for w in words], pa.binary())],
                names=["page_id", "signature"],
            )

    vectors = pages.select("page_id", "vector").where(F.col("vector").isNotNull())
    return vectors.mapInArrow(sign, "page_id bigint, signature binary")


def search_ann(
    signatures: DataFrame,
    pages: DataFrame,
    queries: DataFrame,
    k: int = S.DEFAULT_K,
    min_similarity: float = S.MIN_SIMILARITY,
    bits: int = SIGNATURE_BITS,
    recall: float = 0.95,
) -> DataFrame:
    """Approximate top-k: candidates by signature distance, then exact re-scoring.

    The wide vectors are joined in only for pages that came close to some query; every
    candidate within the radius is scored, so the answer is a subset of the exact one.
    """
    radius = hamming_radius(min_similarity, bits, recall)

    def run(group: list[_QuerySet]) -> DataFrame:
        q = group[0]
        shared = pages.sparkSession.sparkContext.broadcast(q)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = _sign_words(shared.value.unit, shared.value.dim, bits)
            step = max(1, _MAX_CELLS // mine.size)
            for batch in batches:
                page_ids = batch.column("page_id").to_numpy()
                raw = b"".join(batch.column("signature").to_pylist())
                theirs = np.frombuffer(raw, dtype=np.uint64).reshape(len(page_ids), -1)
                for lo in range(0, len(page_ids), step):
                    differing = np.bitwise_count(theirs[lo : lo + step, None, :] ^ mine[None, :, :]).sum(axis=2, dtype=np.int32)
                    close = differing <= radius
                    at = np.nonzero(close.any(axis=1))[0]
                    lists = [np.nonzero(close[i])[0].astype(np.int32) for i in at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(page_ids[lo + at], pa.int64()), pa.array(lists, pa.list_(pa.int32()))],
                        names=["page_id", "near"],
                    )

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = shared.value
            best = _TopK(q.k)
            for batch in batches:
                page_ids = batch.column("page_id").to_numpy()
                unit = _unit_rows(_matrix(batch.column("vector"), q.dim))
                lists = batch.column("near")
                at_query = lists.flatten().to_numpy()
                at_page = np.repeat(np.arange(len(page_ids)), np.diff(lists.offsets.to_numpy()))
                for lo in range(0, len(at_query), 100_000):
                    qs, ps = at_query[lo : lo + 100_000], at_page[lo : lo + 100_000]
                    sims = np.einsum("ij,ij->i", q.unit[qs], unit[ps])
                    hit = sims > min_similarity
                    best.add(qs[hit], page_ids[ps[hit]], np.round(sims[hit], 6))
                    if best.full:
                        yield best.rows(q.ids)
            yield best.rows(q.ids)

        candidates = signatures.mapInArrow(near, "page_id bigint, near array<int>")
        vectors = pages.select("page_id", "vector")
        return candidates.join(vectors, "page_id").select("page_id", "near", "vector").mapInArrow(score, _HITS)

    return _ranked(*_scans(_query_columns(queries), k, run, 1), RANK_IN_WINDOW)


# --- responses ----------------------------------------------------------------------


def with_page_fields(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """Attach ``url, title, description`` to finished hits; wide columns never meet the ranking.

    The hits are written first. Their size is then known to the planner, which sends a
    small answer to the pages instead of shuffling the pages to it.
    """
    return written(hits, "hits").join(pages.select("page_id", "url", "title", "description"), "page_id")


def search_responses(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """One JSON answer per query, ``{"pages":[{url,title,description}, …]}`` in rank order.

    ``hits`` holds at most k rows per query, and one answer must fit into a row: for a large k take
    ``search_response_parts``. A query without hits answers with an empty list.
    """
    per_query = hits.groupBy("query_id").agg(_pages_in_order().alias("found"))
    return queries.select("query_id").join(per_query, "query_id", "left").select("query_id", _body("found").alias("response"))


def search_response_parts(queries: DataFrame, hits: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Answers of any length as ``(query_id, part, parts, response)``: part 0 holds the best ``part_rows`` hits, and so on.

    Each response has the form of a whole answer. A query without hits has one part with an empty
    list. No row and no task holds more than ``part_rows`` hits of a query at a time.
    """
    ranked = hits.withColumn("part", F.floor((F.col("rk") - 1) / part_rows))
    found = ranked.groupBy("query_id", "part").agg(_pages_in_order().alias("found"))
    counts = hits.groupBy("query_id").agg(F.ceil(F.max("rk") / part_rows).alias("parts"))
    asked = queries.select("query_id").join(counts, "query_id", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("bigint")))
    numbered = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    return numbered.join(found, ["query_id", "part"], "left").select("query_id", "part", "parts", _body("found").alias("response"))


def write_response_parts(parts: DataFrame, path: str) -> None:
    """Parts as JSON lines; files and the lines in them follow (query, part), that is rank order."""
    parts.repartitionByRange("query_id", "part").sortWithinPartitions("query_id", "part").write.json(path)


def _pages_in_order() -> Column:
    page = F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("url", "title", "description")])
    return F.transform(F.array_sort(F.collect_list(F.struct("rk", page.alias("page")))), lambda x: x["page"])


def _body(found: str) -> Column:
    return F.to_json(F.struct(F.coalesce(found, F.array().cast(_RESPONSE_ITEM)).alias("pages")))


_RESPONSE_ITEM = "array<struct<url:string,title:string,description:string>>"


def empty_searches(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Queries that found nothing."""
    return queries.select("query_id").join(hits.select("query_id"), "query_id", "left_anti")
