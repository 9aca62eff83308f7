from __future__ import annotations

import json
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagesift import schemas as S
from pagesift.functions import vectors as V
from pagesift.operators import search as R
from pagesift.operators.ops import running_totals
from pagesift.plans.searching import semantic_search

VECTORS = "page_id long, vector array<float>"
QUERIES = "query_id long, vector array<float>"


def hits(df):
    return sorted((r.query_id, r.rk, r.page_id, r.sim) for r in df.collect())


def same(got, want):
    assert [h[:3] for h in got] == [h[:3] for h in want]
    assert [h[3] for h in got] == pytest.approx([h[3] for h in want])
    return bool(got)


def brute_force(pages, queries, k, threshold):
    out = []
    for qid, q in queries:
        scored = []
        for pid, p in pages:
            a, b = np.asarray(q, float), np.asarray(p, float)
            sim = float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
            if sim > threshold:
                scored.append((-round(sim, 6), pid))
        out += [(qid, i + 1, pid, -s) for i, (s, pid) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def random_vectors(n, dim, seed, clusters=5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim))
    rows = centres[rng.integers(0, clusters, n)] + rng.standard_normal((n, dim))
    return [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(rows)]


def test_topk_equals_brute_force(spark):
    pages, queries = random_vectors(400, 16, 1), random_vectors(30, 16, 2)
    got = R.search_topk(spark.createDataFrame(pages, VECTORS).repartition(7), spark.createDataFrame(queries, QUERIES), k=5)
    assert same(hits(got), brute_force(pages, queries, 5, 0.3))


def test_more_queries_than_one_pass(spark, monkeypatch):
    pages, queries = random_vectors(100, 8, 3), random_vectors(40, 8, 4)
    p, q = spark.createDataFrame(pages, VECTORS), spark.createDataFrame(queries, QUERIES)
    expected = hits(R.search_topk(p, q, k=3))
    monkeypatch.setattr(R, "MAX_QUERIES_PER_BLOCK", 7)
    assert hits(R.search_topk(p, q, k=3)) == expected
    monkeypatch.setattr(R, "MAX_QUERIES_PER_BLOCK", 100)
    monkeypatch.setattr(R, "MAX_QUERY_BYTES", 8 * 8 * 10)
    assert hits(R.search_topk(p, q, k=3)) == expected
    assert same(expected, brute_force(pages, queries, 3, 0.3))


def test_three_blocks_share_one_scan(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(R, "MAX_QUERIES_PER_BLOCK", 14)
    spark.createDataFrame(random_vectors(200, 8, 3), VECTORS).write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    queries = random_vectors(40, 8, 4)
    q = spark.createDataFrame(queries, QUERIES)
    assert len(list(R._blocks(q, 10))) == 3
    found = R.search_topk(pages, q)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert same(hits(found), brute_force(random_vectors(200, 8, 3), queries, 10, 0.3))


def test_a_large_k_is_sent_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(R, "MAX_KEPT_ROWS", 50)
    task = R._TopK(np.array([1000]))
    for i in range(3):
        task.add(np.zeros(40, dtype=np.int64), np.arange(40) + 40 * i, np.linspace(0.4, 0.9, 40))
        task.shrink()
    assert task.full
    assert task.rows(np.array([7])).num_rows == 120 and not task.full
    pages = spark.createDataFrame(random_vectors(300, 8, 3, 1), VECTORS)
    q = spark.createDataFrame([(1, [1.0] + [0.0] * 7, 1_000_000)], QUERIES + ", k long")
    assert R.search_topk(pages, q, min_similarity=-2.0).count() == 300


@pytest.mark.parametrize("slice_rows", [50, 200_000])
def test_ranking_by_threshold_equals_brute_force(spark, monkeypatch, slice_rows):
    monkeypatch.setattr("pagesift.operators.search.running_totals", partial(running_totals, slice_rows=slice_rows))
    pages = random_vectors(300, 8, 3, 1)
    pages += [(1000 + i, pages[5][1]) for i in range(100)]  # a third of the best are ties
    asks = [(i, [float(x) for x in np.eye(8)[i]], (3, 40, 120, 10**6)[i % 4]) for i in range(8)]
    p, q = spark.createDataFrame(pages, VECTORS).repartition(5), spark.createDataFrame(asks, QUERIES + ", k long")
    got = hits(R.search_topk(p, q, min_similarity=-0.2, rank_in_window=10))
    want = sorted(h for i, v, k in asks for h in brute_force(pages, [(i, v)], k, -0.2))
    assert same(got, want)
    assert got == hits(R.search_topk(p, q, min_similarity=-0.2))


def test_threshold_leaves_k_rows_and_one_cell(spark):
    rows = [(0, 500, i, round(1 - i / 20_000, 6)) for i in range(20_000)] + [(1, 10**6, i, 0.5) for i in range(300)]
    left = R.cut_by_threshold(spark.createDataFrame(rows, "query_id long, k long, page_id long, sim double"))
    kept = {r.query_id: r["count"] for r in left.groupBy("query_id").count().collect()}
    assert 500 <= kept[0] <= 500 + 20 and kept[1] == 300


def test_no_window_holds_a_query_with_a_large_k(spark, monkeypatch):
    monkeypatch.setattr("pagesift.operators.search.running_totals", partial(running_totals, slice_rows=50))
    rows = spark.range(300).select(F.lit(1).alias("query_id"), F.lit(10**6).alias("k"), F.col("id").alias("page_id"), F.lit(0.5).alias("sim"))
    ranked = R._ranked_by_threshold(rows)
    windows = [line for line in ranked._jdf.queryExecution().optimizedPlan().toString().splitlines() if " Window " in line or "- Window" in line]
    assert windows and not any("row_number" in line for line in windows)
    assert all("_slice" in line for line in windows)
    assert [r.page_id for r in ranked.orderBy("rk").collect()] == list(range(300))


def test_long_responses_come_in_rank_ordered_parts(spark, tmp_path):
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    found = spark.createDataFrame([(1, rk, f"u{rk}", None, "d") for rk in range(25, 0, -1)], "query_id long, rk int, url string, title string, description string")
    parts = R.search_response_parts(queries, found, part_rows=10)
    got = {(r.query_id, r.part): (r.parts, [p["url"] for p in json.loads(r.response)["pages"]]) for r in parts.collect()}
    urls = [f"u{i}" for i in range(1, 26)]
    assert got == {(1, 0): (3, urls[:10]), (1, 1): (3, urls[10:20]), (1, 2): (3, urls[20:]), (2, 0): (1, [])}
    R.write_response_parts(parts, str(tmp_path / "out"))
    lines = [json.loads(x) for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert [(x["query_id"], x["part"]) for x in lines] == sorted(got)


def test_threshold_is_strict_and_edge_vectors_are_safe(spark):
    pages = spark.createDataFrame([(1, [0.3, float(np.sqrt(1 - 0.09))]), (2, [0.0, 0.0]), (3, None), (4, [2.0, 0.0]), (5, [-1.0, 0.0])], VECTORS)
    query = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 0.0]), (9, None)], QUERIES)
    assert hits(R.search_topk(pages, query, min_similarity=0.31)) == [(7, 1, 4, 1.0)]
    exact = spark.createDataFrame([(1, [3.0, 4.0]), (4, [2.0, 0.0])], VECTORS)
    assert hits(R.search_topk(exact, query, min_similarity=0.6)) == [(7, 1, 4, 1.0)]


def test_ties_go_to_the_smaller_id(spark):
    pages = spark.createDataFrame([(i, [1.0, 1.0]) for i in (9, 4, 7, 1)], VECTORS).repartition(4)
    got = R.search_topk(pages, spark.createDataFrame([(0, [1.0, 1.0])], QUERIES), k=2)
    assert [h[:3] for h in hits(got)] == [(0, 1, 1), (0, 2, 4)]


def test_k_per_query_and_no_queries(spark):
    pages = spark.createDataFrame(random_vectors(50, 4, 5, 1), VECTORS)
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], 2), (2, [1.0, 0.0, 0.0, 0.0], 1_000_000)], QUERIES + ", k long")
    got = R.search_topk(pages, queries, min_similarity=-2.0).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {1: 2, 2: 50}
    assert R.search_topk(pages, queries.where("query_id < 0")).count() == 0


def test_wrong_width_fails(spark):
    pages = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], VECTORS)
    with pytest.raises(Exception, match="expected vectors of 2 dimensions"):
        R.search_topk(pages, spark.createDataFrame([(1, [1.0, 0.0])], QUERIES)).collect()


@pytest.mark.parametrize("dim", [64, 384])
def test_ann_is_a_subset_with_high_recall(spark, dim):
    pages, queries = random_vectors(1500, dim, 6, 40), random_vectors(40, dim, 6, 40)
    p, q = spark.createDataFrame(pages, VECTORS), spark.createDataFrame(queries, QUERIES)
    exact = {h[0::2][0:2] for h in hits(R.search_topk(p, q))}
    near = {h[0::2][0:2] for h in hits(R.search_ann(R.build_signatures(p, dim), p, q))}
    assert len(near & exact) / len(exact) >= 0.95
    scores = {(h[0], h[2]): h[3] for h in hits(R.search_topk(p, q, k=1500))}
    assert all(scores[(h[0], h[2])] == h[3] for h in hits(R.search_ann(R.build_signatures(p, dim), p, q)))


def test_ann_recall_on_given_vectors(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("page_id"), F.col("embedding").alias("vector"))
    q = v.withColumnRenamed("page_id", "query_id")
    exact = {(h[0], h[2]) for h in hits(R.search_topk(v, q))}
    near = {(h[0], h[2]) for h in hits(R.search_ann(R.build_signatures(v, 64), v, q))}
    assert len(near & exact) / len(exact) >= 0.95


def test_norms_are_zero_or_one(spark):
    rows = [*random_vectors(50, 6, 8), (100, [0.0] * 6), (101, None)]
    df = spark.createDataFrame(rows, VECTORS).select("page_id", V.l2_normalize(F.col("vector")).alias("u"))
    norms = {r.page_id: r.n for r in df.select("page_id", V.l2_norm(F.col("u")).alias("n")).collect()}
    assert norms.pop(100) == 0.0 and norms.pop(101) is None
    assert list(norms.values()) == pytest.approx([1.0] * 50)


def test_request_validation(spark):
    cases = [("q", None, 10, 200), ("q", "", 10, 200), ("q", "0", None, 400), ("q", "-1", None, 400), ("q", "abc", None, 400),
             ("q", "1000000", 1_000_000, 200), ("q", "+5", 5, 200), ("q", "5.0", None, 400), ("q", " 5", None, 400),
             ("q", "99999999999999999999", None, 400), ("", "5", None, 400), (None, "5", None, 400)]
    df = spark.createDataFrame([(i, q, limit) for i, (q, limit, _, _) in enumerate(cases)], "query_id long, q string, limit string")
    got = [(r.k, r.status) for r in R.validate_requests(df).orderBy("query_id").collect()]
    assert got == [c[2:] for c in cases]


def test_responses(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    found = spark.createDataFrame([(1, 2, "u2", "t2", None), (1, 1, "u1", 'a "b"', "d")], "query_id long, rk int, url string, title string, description string")
    got = {r.query_id: json.loads(r.response) for r in R.search_responses(queries, found).collect()}
    assert got == {1: {"pages": [{"url": "u1", "title": 'a "b"', "description": "d"}, {"url": "u2", "title": "t2", "description": ""}]}, 2: {"pages": []}}
    assert [r.query_id for r in R.empty_searches(queries, found).collect()] == [2]


def test_semantic_search_with_stored_vectors(spark):
    pages = spark.createDataFrame([(1, "u1", "cats", "", "cats purr"), (2, "u2", "dogs", "", "dogs bark"), (3, "u3", "", "", "")], "page_id long, url string, title string, description string, content string")
    asks = spark.createDataFrame([(1, "cats purr", "1"), (2, "", ""), (3, "zebra", "5")], "query_id long, q string, limit string")
    assert [(h[0], h[2]) for h in hits(semantic_search(pages, asks))] == [(1, 1)]
    stored = spark.createDataFrame([(1, [1.0] * S.VECTOR_DIM)], VECTORS)
    constant = lambda: lambda texts: np.ones((len(texts), S.VECTOR_DIM), dtype=np.float32)
    assert [h[:3] for h in hits(semantic_search(stored, asks, loader=constant))] == [(1, 1, 1), (3, 1, 1)]
