from __future__ import annotations

import datetime as dt
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from pagesift.operators import pages as P
from pagesift.sources.page_store import PageStore, _names

PAGES = "page_id long, url string, title string, description string, content string, crawled_at timestamp_ntz, vector array<double>, can_be_vectorized boolean"
DAY = dt.datetime(2024, 1, 1)


def pages(spark, n, first=0, text="text"):
    rng = random.Random(first)
    rows = [(i, f"https://a.example/{i}", f"t{i}", "", f"{text} {i} " + "".join(rng.choices("abcdefgh ", k=2000)), DAY, None if i % 3 else [0.6, 0.8], True) for i in range(first, first + n)]
    return spark.createDataFrame(rows, PAGES)


def updates(spark, ids, day=1, vector=None):
    rows = [(f"https://a.example/{i}", f"new {version}", "d", f"again {i}", DAY + dt.timedelta(days=day), vector, version) for i in ids for version in (1, 2)]
    return spark.createDataFrame(rows, "url string, title string, description string, content string, crawled_at timestamp_ntz, vector array<double>, version int")


def rows(df):
    return sorted(map(str, df.select("url", "page_id", "title", "description", "content", "crawled_at", "vector", "can_be_vectorized").collect()))


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


@pytest.fixture
def store(spark, tmp_path):
    return PageStore.create(pages(spark, 1000), str(tmp_path / "store"), buckets=6)


def test_equals_the_rewritten_table_after_any_changes(spark, store):
    expected = pages(spark, 1000)
    for step, ids in enumerate([range(0, 30), range(20, 60), range(990, 1020)]):
        up = updates(spark, ids, step + 1, [] if step == 1 else [3.0, 4.0] if step == 2 else None)
        store.upsert(up)
        expected = P.upsert_pages(expected, up)
        assert rows(store.read()) == rows(expected)
        vectors = expected.select("url", F.when(F.col("page_id") % 2 == 0, F.col("crawled_at")).otherwise(F.col("crawled_at") - F.expr("interval 1 day")).alias("crawled_at"), F.array(F.lit(float(step)), F.lit(2.0)).alias("vector")).where("page_id % 5 < 2")
        vectors = vectors.unionByName(expected.where("page_id = 10").select("url", "crawled_at", F.array().cast("array<double>").alias("vector")))
        store.write_back(vectors)
        expected = P.write_back_vectors(expected, vectors)
        assert rows(store.read()) == rows(expected)
        if step == 0:
            store.compact({0, 3})
            assert rows(store.read()) == rows(expected)
    assert rows(PageStore(spark, store.folder).read()) == rows(expected)
    assert store.crowded() and store.compact() and not store.crowded(1)
    assert rows(store.read()) == rows(expected) and len(store.layers) == 1


def test_a_small_upsert_writes_little_and_moves_no_stored_text(spark, store):
    before = size(f"{store.folder}/layers")
    store.upsert(updates(spark, range(10)))
    assert size(f"{store.folder}/layers") - before < 0.03 * before
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with deltas too large to be sent about
    try:
        store.write_back(updates(spark, range(5), 1, [1.0, 0.0]).select("url", "crawled_at", "vector"))
        one = plan_of(store.read())
        store.upsert(updates(spark, range(500, 510)))
        store.write_back(updates(spark, range(500, 505), 1, [1.0, 0.0]).select("url", "crawled_at", "vector"))
        two = plan_of(store.read())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in one and "Exchange" not in one
    assert "SortMergeJoin" in two and "content" in two and not any("content" in x for x in exchanged(two))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanged(plan):
    """Plan lines below an exchange."""
    lines = plan.splitlines()
    depth = [re.search("[A-Z]", x).start() if re.search("[A-Z]", x) else 0 for x in lines]
    return [y for i, x in enumerate(lines) if "Exchange" in x for y in takewhile_deeper(lines, depth, i)]


def takewhile_deeper(lines, depth, i):
    for j in range(i + 1, len(lines)):
        if depth[j] <= depth[i]:
            return
        yield lines[j]


def test_a_killed_compaction_changes_nothing(spark, store, monkeypatch):
    store.upsert(updates(spark, range(40)))
    expected, version = rows(store.read()), store.version
    monkeypatch.setattr(PageStore, "_commit", lambda self, layers: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        store.compact()
    monkeypatch.undo()
    os.makedirs(f"{store.folder}/versions/{version + 1:012d}")  # a version whose writer was killed, too
    again = PageStore(spark, store.folder)
    assert again.version == version and rows(again.read()) == expected
    again.compact({1, 2})
    assert again.version == version + 2 and rows(PageStore(spark, store.folder).read()) == expected
    assert len(_names(spark, f"{store.folder}/layers")) == 4


def test_compaction_leaves_other_buckets_alone(spark, store):
    store.upsert(updates(spark, range(300)))
    store.compact({2})
    base, delta, merged = store.layers
    assert 2 not in base.buckets | delta.buckets and merged.buckets == {2}
    assert store.read().count() == 1000 and store.read({2}).count() == store.read().where(F.expr("pmod(hash(url), 6) = 2")).count()


def test_empty_stores_and_updates(spark, tmp_path):
    store = PageStore.create(pages(spark, 0), str(tmp_path / "empty"), buckets=3)
    assert store.read().count() == 0
    store.upsert(updates(spark, []))
    store.upsert(updates(spark, [5]))
    store.write_back(updates(spark, []).select("url", "crawled_at", "vector"))
    assert [r.title for r in store.read().collect()] == ["new 2"]
    assert PageStore.create(pages(spark, 5), str(tmp_path / "default")).n == 8
    with pytest.raises(FileNotFoundError):
        PageStore(spark, str(tmp_path / "none"))
