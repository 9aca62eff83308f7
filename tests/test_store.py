from __future__ import annotations

import datetime as dt

import pytest
from pyspark.errors import PySparkException

from pagesift import schemas as S
from pagesift.operators import links as L
from pagesift.operators import pages as P

T0 = dt.datetime(2024, 1, 1)
UPDATE = "url string, title string, description string, content string, crawled_at timestamp_ntz, vector array<float>, version int"


def page(i, url, title="t", vector=None, flag=True, at=T0):
    return (i, url, title, "d", "c", at, vector, flag)


def test_upsert_inserts_then_overwrites(spark):
    empty = spark.createDataFrame([], S.PAGE)
    first = spark.createDataFrame([(f"URL{i}", f"old{i}", "d", "c", T0, None, 1) for i in (1, 2, 3)], UPDATE)
    stored = P.upsert_pages(empty, first)
    assert stored.count() == 3
    again = spark.createDataFrame([(f"URL{i}", f"new{i}", "d", "c", T0, None, 1) for i in (1, 2)], UPDATE)
    merged = P.upsert_pages(stored, again)
    assert {r.url: r.title for r in merged.collect()} == {"URL1": "new1", "URL2": "new2", "URL3": "old3"}
    ids = {r.url: r.page_id for r in stored.collect()}
    assert {r.url: r.page_id for r in merged.collect()} == ids
    assert merged.schema["vector"].dataType == stored.schema["vector"].dataType


def test_upsert_vector_states(spark):
    empty = spark.createDataFrame([], S.PAGE)
    rows = [("A", "t", "d", "c", T0, [3.0, 4.0], 1), ("B", "t", "d", "c", T0, [], 1), ("C", "t", "d", "c", T0, None, 1), ("D", "t", "d", "c", T0, [0.0, 0.0], 1)]
    got = {r.url: (r.vector, r.can_be_vectorized) for r in P.upsert_pages(empty, spark.createDataFrame(rows, UPDATE)).collect()}
    assert got["A"][0] == pytest.approx([0.6, 0.8]) and got["A"][1]
    assert got["B"] == (None, False)
    assert got["C"] == (None, True)
    assert got["D"] == ([0.0, 0.0], True)


def test_recrawl_clears_the_vector(spark):
    stored = spark.createDataFrame([page(1, "A", vector=[1.0, 0.0])], S.PAGE)
    merged = P.upsert_pages(stored, spark.createDataFrame([("A", "t2", "d", "c", T0, None, 1)], UPDATE))
    row = merged.collect()[0]
    assert row.vector is None and row.can_be_vectorized and row.page_id == 1


def test_latest_version_wins(spark):
    empty = spark.createDataFrame([], S.PAGE)
    rows = [("A", f"v{v}", "d", "c", T0, None, v) for v in (2, 3, 1)]
    assert [r.title for r in P.upsert_pages(empty, spark.createDataFrame(rows, UPDATE)).collect()] == ["v3"]


def test_insert_links(spark):
    pages = spark.createDataFrame([page(1, "PARENT"), page(2, "C1"), page(3, "C2")], S.PAGE)
    links = spark.createDataFrame([], S.LINK)
    seen = []
    for parent, child in (("PARENT", 2), ("PARENT", 3), ("PARENT", 2), ("UNKNOWN", 2)):
        new = L.new_links(pages, links, spark.createDataFrame([(parent, child)], "parent_url string, dst_page_id long"))
        seen.append(new.count())
        links = links.unionByName(new)
    assert seen == [1, 1, 0, 0]
    both = L.child_links(pages, links).orderBy("child_url").collect()
    assert [tuple(r) for r in both] == [("PARENT", "C1"), ("PARENT", "C2")]


def test_delete_cascades_at_both_ends(spark):
    pages = spark.createDataFrame([page(i, str(i)) for i in (1, 2, 3)], S.PAGE)
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 9)], S.LINK)
    left, kept = P.delete_pages(pages, links, spark.createDataFrame([(2,)], "page_id long"))
    assert sorted(r.page_id for r in left.collect()) == [1, 3]
    assert sorted(tuple(r) for r in kept.collect()) == [(3, 1), (3, 9)]
    assert [tuple(r) for r in L.valid_links(left, kept).collect()] == [(3, 1)]


def test_backlog_needs_text_and_no_vector(spark):
    rows = [page(1, "plain"), page(2, "done", vector=[1.0]), page(3, "refused", flag=False)]
    rows += [(4, "empty", "", "", "", T0, None, True), (5, "nulls", None, None, None, T0, None, True), (6, "titled", "x", None, None, T0, None, True)]
    got = P.unvectorized(spark.createDataFrame(rows, S.PAGE))
    assert sorted(r.url for r in got.collect()) == ["plain", "titled"]


def test_write_back_skips_newer_crawls(spark):
    later = T0 + dt.timedelta(days=1)
    pages = spark.createDataFrame([page(1, "A"), page(2, "B", at=later), page(3, "C"), page(4, "D")], S.PAGE)
    done = spark.createDataFrame([("A", T0, [0.0, 2.0]), ("B", T0, [1.0, 1.0]), ("C", T0, [])], "url string, crawled_at timestamp_ntz, vector array<float>")
    got = {r.url: (r.vector, r.can_be_vectorized) for r in P.write_back_vectors(pages, done).collect()}
    assert got == {"A": ([0.0, 1.0], True), "B": (None, True), "C": (None, False), "D": (None, True)}


def test_lookup_and_existence(spark):
    pages = spark.createDataFrame([(1, "A", None, "d", None, T0, None, True)], S.PAGE)
    assert P.get_page(pages, "A").collect()[0][:4] == ("A", "", "d", "")
    assert P.get_page(pages, "B").count() == 0
    probes = spark.createDataFrame([("A",), ("B",), ("A",)], "url string")
    assert sorted(tuple(r) for r in P.pages_exist(pages, probes).collect()) == [("A", True), ("B", False)]


def test_backfill_checks_width(spark):
    pages = spark.createDataFrame([page(1, "A", vector=[3.0, 4.0]), page(2, "B")], S.PAGE)
    got = {r.url: r.vector for r in P.backfill_vectors(pages, 2).collect()}
    assert got == {"A": pytest.approx([0.6, 0.8]), "B": None}
    with pytest.raises(PySparkException, match="expected 3 dimensions"):
        P.backfill_vectors(pages, 3).collect()
