from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesift.operators import banded as B
from pagesift.operators import search as R

VECTORS = "page_id long, vector array<double>"


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def planted(dim, seed, queries=60, pages=4000, low=0.3, high=1.0):
    """Random pages, and for each query some at chosen similarities."""
    rng = np.random.default_rng(seed)
    q = unit(rng.standard_normal((queries, dim)))
    rows = [unit(rng.standard_normal((pages, dim)))]
    for _ in range(5):
        other = rng.standard_normal((queries, dim))
        other = unit(other - (other * q).sum(axis=1, keepdims=True) * q)
        s = rng.uniform(low, high, (queries, 1))
        rows.append(s * q + np.sqrt(1 - s * s) * other)
    return q, np.concatenate(rows)


def frames(spark, q, pages):
    p = spark.createDataFrame(list(enumerate(pages.tolist())), VECTORS).repartition(6)
    return p, spark.createDataFrame(list(enumerate(q.tolist())), "query_id long, vector array<double>")


def hits(df):
    return {(r.query_id, r.page_id): r.sim for r in df.collect()}


@pytest.mark.parametrize("dim", [64, 384])
def test_recall_and_share_at_a_high_threshold(spark, dim):
    q, pages = planted(dim, 3, low=0.7)
    p, asked = frames(spark, q, pages)
    exact = hits(R.search_topk(p, asked, min_similarity=0.7))
    found = hits(B.search_banded(p, asked, dim, min_similarity=0.7))
    assert len(exact) > 250 and len(found.keys() & exact.keys()) / len(exact) >= 0.9
    assert all(exact[x] == s for x, s in found.items())  # nothing but true hits, by their true similarity
    bands = B.plan_bands(0.7)
    scored = B.candidates(B.build_bands(p, dim, bands), B.probe_slots(asked, dim, bands)).count()
    assert scored < 0.1 * len(q) * len(pages)


def test_recall_at_a_low_threshold_is_that_of_exact_search(spark):
    q, pages = planted(64, 4, queries=20, pages=300)
    p, asked = frames(spark, q, pages)
    assert B.plan_bands(0.3).share > B.MAX_SHARE
    assert hits(B.search_banded(p, asked, 64)) == hits(R.search_topk(p, asked))
    forced = hits(B.search_banded(p, asked, 64, max_share=1.0))
    exact = hits(R.search_topk(p, asked))
    assert len(forced.keys() & exact.keys()) / len(exact) >= 0.9


def test_copies_are_ranked_as_single_pages_are(spark):
    q, pages = planted(64, 5, queries=8, pages=100, low=0.8)
    pages = np.concatenate((pages, np.repeat(q[:1], 400, axis=0), pages[-3:]))
    q = np.concatenate((q, q[:1], q[:1]))
    p, asked = frames(spark, q, pages)
    asked = asked.withColumn("k", F.when(F.col("query_id") % 2 == 0, 3).otherwise(500))
    exact, found = ([tuple(r) for r in x.orderBy("query_id", "rk").collect()] for x in (R.search_topk(p, asked, min_similarity=0.75), B.search_banded(p, asked, 64, min_similarity=0.75)))
    assert len(exact) > 400 and found == exact


def test_likelier_slots_are_looked_up_first(spark):
    bands = B.Bands(2, 6, 3, 7)
    rng = np.random.default_rng(6)
    q = rng.standard_normal((5, 16))
    got = {}
    for r in B.probe_slots(spark.createDataFrame(list(enumerate(q.tolist())), "query_id long, vector array<double>"), 16, bands).collect():
        got.setdefault((r.query_id, r.slot >> 6), []).append(r.slot & 63)
    for (query, band), slots in got.items():
        margins = (q[query] @ R._planes(16, R.SIGNATURE_BITS).T)[band * 6 : band * 6 + 6]
        own = sum(1 << i for i, m in enumerate(margins) if m >= 0)
        costs = {mask: sum(m * m for i, m in enumerate(margins) if mask >> i & 1) for mask in range(64) if mask.bit_count() <= 3}
        assert sorted(slots) == sorted(own ^ m for m in sorted(costs, key=lambda x: (costs[x], x))[:7])


def test_empty_sides_nulls_and_the_plan(spark):
    q, pages = planted(64, 7, queries=3, pages=50)
    p, asked = frames(spark, q, pages)
    nothing = p.where("page_id < 0")
    assert B.search_banded(nothing, asked, 64, min_similarity=0.7).count() == 0
    assert B.search_banded(p, asked.where("query_id < 0"), 64, min_similarity=0.7).count() == 0
    with_null = p.unionByName(spark.createDataFrame([(9999, None)], VECTORS))
    assert hits(B.search_banded(with_null, asked, 64, min_similarity=0.7)) == hits(B.search_banded(p, asked, 64, min_similarity=0.7))
    bands = B.plan_bands(0.7)
    plan = B.candidates(B.build_bands(p, 64, bands), B.probe_slots(asked, 64, bands))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and ("SortMergeJoin" in plan or "HashJoin" in plan)


def test_queries_in_several_blocks_are_answered_as_in_one(spark, monkeypatch):
    q, pages = planted(64, 8, queries=9, pages=40, low=0.8)
    p, asked = frames(spark, q, pages)
    exact = hits(R.search_topk(p, asked, min_similarity=0.75))
    monkeypatch.setattr(R, "MAX_QUERIES_PER_BLOCK", 4)
    assert len(exact) > 30 and hits(B.search_banded(p, asked, 64, min_similarity=0.75, recall=0.999)) == exact
