"""Whitening of embeddings by a singular value decomposition of the centred vectors.

Entries become whole numbers, ``floor(256 * entry)``; the fit list is each distinct vector once. Its
sums are exact; its centred rows are reduced by blockwise QR: a task folds block after block into one
triangular factor, and factors are merged 32 at a time. The last one, as wide as the vectors, has the
singular values of the whole centred list; ``bidiagonal_qd`` finds them and the directions. No covariance is
formed on the way, so small variances keep their digits; only the check at the end adds up that of the whitened list.

Equal vectors meet in a distinct with map-side combine, so a vector that is a third of all rows
costs nothing. What the driver sees are sums and triangular factors: ``d * d`` numbers each, at most
32 of them. Vectors are shuffled once, for the distinct.

Input cases: vectors that are null or empty, or hold null, infinite or not-a-number entries, are
dropped, as are those of another length than the commonest of the fit list (of equally common ones the
longest); a null id is kept; rows repeated entirely are repeated in the result; entries beyond 2**55 stop at
the ends of a long; components without variance are left out (a single vector has none); with equal variances any directions
of their space may come, the same for all rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.bidiagonal_qd import EPS, right_vectors
from pagesift.llm.partial_merge import merge_parts
from pagesift.session import written

SCALE = 256
BLOCK_ROWS = 4_096
"""Rows folded into a triangular factor at a time."""


@dataclass
class Whitening:
    """Size and sums of the fit list, directions (a row each), their variances, and the sum of all variances."""

    n: int
    sums: list[int]
    directions: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def means(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def scaled(self) -> np.ndarray:
        return self.directions.T / np.sqrt(self.variances)


def whole_vectors(embeddings: DataFrame, *keep: str, column: str = "embedding") -> DataFrame:
    """-> the kept columns and x, for rows whose vector is whole."""
    entries = F.col(f"`{column}`").cast("array<double>")
    fine = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    x = F.transform(entries, lambda c: F.floor(F.lit(float(SCALE)) * c).cast("bigint"))
    return embeddings.where(entries.isNotNull() & (F.size(entries) > 0) & fine).select(*keep, x.alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _exact_sums(x: np.ndarray) -> list[int]:
    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if top * len(x) < 1 << 62:
        return x.sum(axis=0).tolist()
    return x.astype(object).sum(axis=0).tolist()


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n += len(x)
            sums = [a + b for a, b in zip(sums, _exact_sums(x), strict=True)]
        if n:
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "sums": pa.array([[Decimal(s) for s in sums]], pa.list_(kind))})

    each = fit.mapInArrow(run, "n bigint, sums array<decimal(38,0)>")
    # each task counts its rows once, beside the first dimension
    rows = each.select(F.posexplode("sums"), "n").groupBy("pos").agg(F.sum(F.col("col")).alias("s"), F.sum("n").alias("n")).orderBy("pos").collect()  # d rows
    return (int(rows[0]["n"]), [int(r["s"]) for r in rows]) if rows else (0, [0] * d)


def _triangle(fit: DataFrame, d: int, means: np.ndarray) -> np.ndarray:
    """Triangular factor of the centred fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            x = _matrix(batch.column(0), d)
            for start in range(0, len(x), BLOCK_ROWS):
                r = np.linalg.qr(np.concatenate((r, x[start : start + BLOCK_ROWS] - means)), mode="r")
        if len(r):
            yield pa.RecordBatch.from_pydict({"data": pa.array([r.tobytes()], pa.binary())})

    def merge(factors: list[bytes]) -> bytes:
        r = np.zeros((0, d))
        for f in factors:
            r = np.linalg.qr(np.concatenate((r, np.frombuffer(f).reshape(-1, d))), mode="r")
        return r.tobytes()

    found = np.frombuffer(merge_parts(fit.mapInArrow(run, "data binary"), merge)).reshape(-1, d)
    square = np.zeros((d, d))
    square[: len(found)] = found
    return square


def _identity_error(fit: DataFrame, d: int, model: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance less the identity."""
    k = len(model.variances)
    means, scaled = model.means, model.scaled

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = (_matrix(batch.column(0), d) - means) @ scaled
            total[0] += w.sum(axis=0)
            total[1:] += w.T @ w
        yield pa.RecordBatch.from_pydict({"data": pa.array([total.tobytes()], pa.binary())})

    def merge(totals: list[bytes]) -> bytes:
        return sum(np.frombuffer(t).reshape(k + 1, k) for t in totals).tobytes()

    total = np.frombuffer(merge_parts(fit.mapInArrow(run, "data binary"), merge)).reshape(k + 1, k) / model.n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max())


def fit_whitening(vectors: DataFrame, components: int) -> Whitening | None:
    """vectors(x) -> the whitening of its distinct rows; None if there are none."""
    fit = written(vectors.select("x").distinct(), "fit")
    lengths = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return None
    d = int(lengths[0]["d"])
    fit = fit.where(F.size("x") == d)
    n, sums = _sums(fit, d)
    model = Whitening(n, sums, np.zeros((0, d)), np.zeros(0), 0.0)
    squares, directions = right_vectors(_triangle(fit, d, model.means), components)
    model.trace = float(squares.sum()) / n
    there = squares[: len(directions)] > squares[0] * (10 * d * EPS) ** 2
    model.directions, model.variances = directions[there], squares[: len(directions)][there] / n
    if len(model.variances):
        model.identity_error = _identity_error(fit, d, model)
    return model


def apply_whitening(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vectors(vec_id, x) -> vec_id, deviation (exact), whitened (an entry for each component)."""
    d = len(model.sums)
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # a few rows as wide as the vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        means, scaled, sums = m.means, m.scaled, np.array(m.sums, dtype=object)
        for batch in batches:
            x = _matrix(batch.column(1), d)
            top = m.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, m.sums))
            if top * top * d < 1 << 62:
                off = m.n * x - sums.astype(np.int64)
                deviation = (off * off).sum(axis=1).tolist()
            else:
                deviation = ((m.n * x.astype(object) - sums) ** 2).sum(axis=1).tolist()
            whitened = (x - means) @ scaled
            offsets = np.arange(len(x) + 1, dtype=np.int32) * whitened.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(whitened.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([Decimal(v) for v in deviation], pa.decimal128(38, 0)), lists], names=["vec_id", "deviation", "whitened"])

    return vectors.where(F.size("x") == d).select("vec_id", "x").mapInArrow(run, "vec_id bigint, deviation decimal(38,0), whitened array<double>")


def whiten(embeddings: DataFrame, components: int = 4) -> DataFrame:
    """embeddings(vec_id, embedding) -> vec_id, component, n, deviation, whitened, explained, identity_error."""
    if components < 1:
        raise ValueError("components must be at least 1")
    vectors = whole_vectors(embeddings.withColumn("vec_id", F.col("vec_id").cast("bigint")), "vec_id")
    model = fit_whitening(vectors, components)
    if model is None or not len(model.variances):
        ddl = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return embeddings.sparkSession.createDataFrame([], ddl)
    shares = F.array(*(F.lit(float(v / model.trace)) for v in model.variances))
    rows = apply_whitening(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("pos", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("pos") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("pos")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
