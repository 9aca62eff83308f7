from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesift.llm import partial_merge
from pagesift.llm.bidiagonal_qd import right_vectors, squared_values
from pagesift.llm.whitening import whiten

EMBEDDINGS = "vec_id bigint, embedding array<float>, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], EMBEDDINGS)


def brute(rows, components=4):
    """numpy's own eigenvectors of the covariance, and exact deviations."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    a = np.array(fit, dtype=float) - np.array([float(Fraction(s, n)) for s in sums])
    values, vectors = np.linalg.eigh(a.T @ a / n)
    out = {}
    for k in range(min(components, len(sums))):
        e, v = values[-1 - k], vectors[:, -1 - k]
        for i, x in kept:
            w = float((np.array(x) - np.array(sums) / n) @ v) / math.sqrt(e)
            out[i, k + 1] = (n, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)), w, e / values.sum())
    return out


def same(got, expected, digits=1e-8):
    assert len(got) == len(expected)
    signs = {}
    for r in got:
        n, deviation, w, share = expected[r.vec_id, r.component]
        assert (r.n, int(r.deviation)) == (n, deviation)
        assert math.isclose(r.explained, share, rel_tol=1e-9)
        if abs(w) > 1e-3:
            sign = signs.setdefault(r.component, np.sign(r.whitened) * np.sign(w))
            assert abs(r.whitened - sign * w) <= digits * max(1, abs(w))
        assert r.identity_error < 1e-9


def test_equals_brute_force_with_nulls_copies_and_odd_entries(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.standard_normal((400, 9)) * np.array([3, 2, 1, 1, 0.5, 0.5, 0.1, 0.1, 0.01])).astype(np.float32).tolist()
    rows = [*enumerate(vectors), *((1000 + i, vectors[7]) for i in range(300)), (2000, None), (2001, []), (2002, [None] + [0.0] * 8), (2003, [float("nan")] * 9), (2004, [float("inf")] * 9), (2005, [-0.0] * 9)]
    df = frame(spark, rows).withColumns({"x": F.lit("clash"), "component": F.lit(1), "n": F.lit(2)}).repartition(7)
    same(whiten(df).collect(), brute(rows))


def test_the_given_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    same(whiten(df).collect(), brute([(r.vec_id, r.embedding) for r in df.collect()]))


def test_many_parts_are_merged_in_levels(spark, monkeypatch):
    monkeypatch.setattr(partial_merge, "FAN_IN", 3)
    rng = np.random.default_rng(5)
    rows = list(enumerate(rng.standard_normal((300, 5)).astype(np.float32).tolist()))
    monkeypatch.setattr("pagesift.llm.whitening.written", lambda df, name: df.repartition(23))
    same(whiten(frame(spark, rows), components=9).collect(), brute(rows, 9))


def test_no_variance_no_rows_and_other_lengths(spark):
    assert whiten(frame(spark, [])).collect() == []
    assert whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    rows = [(None, [0.0, 1.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0])]
    got = whiten(frame(spark, rows)).collect()  # two points: one component
    assert [(r.vec_id, r.component, r.n, int(r.deviation)) for r in sorted(got, key=lambda r: r.vec_id or 0)] == [(None, 1, 2, 131072), (2, 1, 2, 131072), (2, 1, 2, 131072)]
    assert {round(abs(r.whitened), 12) for r in got} == {1.0} and {r.explained for r in got} == {1.0}
    with pytest.raises(ValueError):
        whiten(frame(spark, rows), components=0)


def test_deviations_beyond_a_long_stay_exact(spark):
    rows = [(i, [float(2**40 + i), float(i * i)]) for i in range(40)]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    big = [(i, [v[0] * 2**10, v[1] * 2**30]) for i, v in rows]
    got = {r.vec_id: int(r.deviation) for r in whiten(frame(spark, big), components=1).collect()}
    assert got == {i: d for (i, _), (_, d, _, _) in brute(big, 1).items()} and max(got.values()) > 1 << 64


def cases():
    r = np.random.default_rng(1)
    q = np.linalg.qr(r.standard_normal((30, 30)))[0]
    wilkinson = np.diag(np.abs(np.arange(21) - 10.0) + 3) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    low = r.standard_normal((12, 12))
    low[3:] = 0
    return [r.standard_normal((40, 40)), q * ([5.0] * 10 + [3.0] * 10 + [1.0] * 10), q @ np.diag(np.logspace(0, -12, 30)), np.linalg.cholesky(wilkinson).T, np.eye(8), np.zeros((4, 4)), low, np.array([[-2.0]])]


def test_values_and_vectors_of_hard_matrices():
    for a in cases():
        values, rows = right_vectors(a, len(a))
        top = max(float(values[0]), 1e-300)
        expected = np.linalg.svd(a, compute_uv=False) ** 2
        assert np.allclose(values, expected, rtol=1e-11, atol=1e-28 * top)
        assert np.abs(rows @ rows.T - np.eye(len(rows))).max() < 1e-12
        assert np.abs(a.T @ (a @ rows.T) - rows.T * values).max() < 1e-9 * top


def test_small_values_are_as_accurate_as_large_ones():
    n = 30
    diagonal, above = 10.0 ** -np.arange(n), 10.0 ** -np.arange(1, n)
    product = np.prod(diagonal**2)  # determinants need no subtraction either
    assert math.isclose(np.prod(squared_values(diagonal, above)), product, rel_tol=1e-12)
