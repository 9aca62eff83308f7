"""What the plans must look like, whatever the size of the tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagesift.registry import QUERIES
from pagesift.operators import frontier as Q
from pagesift.operators import pages as P
from pagesift.operators import search as R
from pagesift.registry.base import NOW, page_table, url_state, vectors_of
from pagesift.session import bucketed

FOLDER = "/root/testdata/sf0.001"
BUILT_WHILE_RUNNING = {n for n in QUERIES if n.startswith("stream_")} | {"crawl_replay"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - BUILT_WHILE_RUNNING))
def test_no_all_pairs_joins(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_point_lookup_reaches_the_scan(spark, tmp_path):
    page_table(spark, FOLDER).write.parquet(str(tmp_path / "pages"))
    stored = spark.read.parquet(str(tmp_path / "pages"))
    assert "EqualTo(url,https://x)" in plan(P.get_page(stored, "https://x"))
    backlog = plan(P.unvectorized(stored))
    assert "IsNull(vector)" in backlog and "EqualTo(can_be_vectorized,true)" in backlog
    assert "content" not in plan(P.recent_pages(stored)).split("ReadSchema")[1]


def test_bucketed_edges_are_joined_in_place(spark):
    edges = spark.range(1000).selectExpr("cast(id % 97 as string) as parent", "id")
    frontier = spark.range(50).selectExpr("cast(id as string) as parent")
    with bucketed(edges, "parent", "edges") as table:
        text = plan(table.join(frontier.hint("merge"), "parent"))
        assert text.count("Exchange") == 1
        name = next(t.name for t in spark.catalog.listTables() if t.name.startswith("pagesift_edges"))
    assert not spark.catalog.tableExists(name)


def test_releasing_retries_needs_no_join(spark):
    text = plan(Q.release_due(url_state(spark, FOLDER), NOW, 1))
    assert "Join" not in text


def test_search_shuffles_hits_only(spark):
    pages = vectors_of(spark, FOLDER)
    queries = pages.withColumnRenamed("page_id", "query_id")
    text = plan(R.search_topk(pages, queries))
    assert text.count("Exchange") == 2  # hits of groups of tasks, then of queries
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in text


def test_upsert_limits_updates_before_the_exchange(spark):
    pages = page_table(spark, FOLDER)
    updates = pages.drop("page_id", "can_be_vectorized").withColumn("version", F.hash("url"))
    text = plan(P.changed_pages(pages, updates))
    assert "row_number(), 1, Partial" in text
