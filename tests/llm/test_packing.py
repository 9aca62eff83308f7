from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from pagesift.llm.vector_packing import place, shard_documents
from tests.llm.data import DOCS, documents, word_soup


def test_shards_are_even_and_keep_groups(spark):
    texts = word_soup(7, 800, 120)
    rows = shard_documents(documents(spark, texts), 8).collect()
    assert len(rows) == 800
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.n_tokens) == (len(raw) + 16, zlib.crc32(raw), len(raw.split()))
    load, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[texts[r.doc_id]].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(load) == set(range(8))
    assert max(load.values()) - min(load.values()) < 0.01 * sum(load.values()) / 8
    sizes = Counter(texts)
    assert all(len(where[t]) == 1 for t in sizes if sizes[t] * (len(t) + 16) < sum(load.values()) / 8)


def test_groups_that_fit_a_shard_stay_whole(spark):
    texts = ["one of fifteen copies " * 3] * 15 + [f"text {i} " * 8 for i in range(1985)]
    rows = shard_documents(documents(spark, texts), 40).collect()
    assert len({r.shard for r in rows if texts[r.doc_id] == texts[0]}) == 1
    nearly = [f"text {i} of many words " * 5 for i in range(900)] + ["copy text of many words " * 4] * 95
    rows = shard_documents(documents(spark, nearly), 10).collect()
    assert len({r.shard for r in rows if r.doc_id >= 900}) == 1


def test_a_group_of_a_third_of_all_rows_is_split(spark):
    texts = [f"text {i} " * 20 for i in range(600)] + ["copy of one text " * 10] * 300
    rows = shard_documents(documents(spark, texts), 10).collect()
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    assert max(load.values()) < 1.03 * min(load.values())


def test_nulls_repeats_and_empty(spark):
    rows = [(1, None), (None, "a b"), (2, "a b"), (2, "a b"), (3, "")]
    docs = documents(spark, rows).withColumns({"shard": F.lit("x"), "h": F.lit(1), "piece": F.lit(2)})
    got = shard_documents(docs, 2).collect()
    assert sorted((r.doc_id or 0, r.size, r.text_crc32, r.n_tokens) for r in got) == sorted(
        [(1, 16, 0, 0), (0, 19, zlib.crc32(b"a b"), 2), (2, 19, zlib.crc32(b"a b"), 2), (2, 19, zlib.crc32(b"a b"), 2), (3, 16, 0, 0)]
    )
    assert len({(r.shard, r.slot) for r in got}) == 5
    assert shard_documents(spark.createDataFrame([], DOCS), 4).count() == 0


def test_place_takes_the_shard_with_the_highest_dot_product():
    sizes = np.array([[6.0, 1, 1], [6, 1, 1], [1, 6, 1], [1, 6, 1], [1, 1, 6], [1, 1, 6]])
    where = place(sizes, 2)
    load = np.array([sizes[where == s].sum(axis=0) for s in (0, 1)])
    assert (load == 8).all()
