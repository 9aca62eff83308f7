from __future__ import annotations

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagesift.llm import substring_dedup as S
from pagesift.llm.common import pack, parts_for, unpack, window_hashes, word_hashes
from pagesift.llm.substring_dedup import substring_dedup
from tests.llm.data import DOCS, documents, word_soup

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, size):
    """doc_id -> (n_words, n_removed, kept text); ids are unique."""
    seen, out = {}, {}
    docs = sorted((i, WORD.findall(t or "")) for i, t in rows)
    for i, w in docs:
        for p in range(len(w) - size + 1):
            seen.setdefault(tuple(w[p : p + size]), (i, p))
    for i, w in docs:
        gone = set()
        for p in range(len(w) - size + 1):
            if seen[tuple(w[p : p + size])] < (i, p):
                gone.update(range(p, p + size))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def found(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in df.collect()}


def test_equals_brute_force(spark):
    texts = [*word_soup(1, 60), None, "", " \n", "one two", "x " * 500]
    rows = list(enumerate(texts))
    docs = documents(spark, texts).repartition(5)
    for size in (3, 20):
        # small chunks and buckets, so that windows meet in the second step
        assert found(substring_dedup(docs, size, chunk_bytes=400, bucket_bytes=600, group_bytes=500)) == brute(rows, size)


def test_two_steps_equal_brute_force(spark):
    texts = [*word_soup(2, 40), *["same " * 30 + "passage"] * 10, None, "", "x " * 200]
    docs = documents(spark, texts).repartition(5)
    got = found(substring_dedup(docs, 5, chunk_bytes=400, bucket_bytes=400, group_bytes=2000, direct=4, held_windows=50))
    assert got == brute(list(enumerate(texts)), 5)


def test_shuffled_bytes_do_not_grow_with_the_corpus():
    rng = np.random.default_rng(5)
    buckets = parts_for(10 << 40, S.BUCKET_BYTES)
    docs = [(i, i, " ".join(map(str, rng.integers(10**4, 10**6, 600))).encode()) for i in range(1200)]
    text = sum(len(d[2]) for d in docs)
    first = list(S._chunk(docs, 20, buckets, S.COARSE, 1 << 20))
    assert sum(len(data) for _, _, data in first) < 2 * text
    at_once = S._chunk(docs[:60], 20, buckets, buckets, 1 << 20)
    assert sum(len(data) for _, _, data in at_once) > 8 * text / 20  # what one step would shuffle
    # the second step, with an eighth of the windows that it holds and of the buckets of a part
    n = S.HELD_WINDOWS // 8
    fine = rng.integers(0, buckets // S.COARSE // 8, n)
    doc = np.sort(rng.integers(0, 10**6, n))
    key = rng.integers(0, 1 << 56, n).astype(np.uint64)
    _, of = S._starts(doc, doc)
    places = S._pack_places(doc, doc, of, np.arange(n) % 600)
    second = list(S._regroup([(7, [S._low(key), fine, *unpack(pack(*places))])], S.COARSE, 1 << 20))
    per_word = text / (1200 * 600)
    assert sum(len(data) for _, _, data in second) < 2.5 * per_word * n
    assert all(part % S.COARSE == 7 for kind, part, _ in second if kind == 0)


def test_a_passage_on_every_document_leaves_one_entry_in_the_second_step():
    passage = " ".join(f"p{i}" for i in range(20)).encode()
    blocks = [(part, unpack(data)) for i in range(500) for kind, part, data in S._chunk([(i, i, passage)], 20, 1 << 20, 64, 8) if kind == 0]
    assert len(blocks) == 500
    out = list(S._regroup(blocks, 64, 8))
    assert [kind for kind, _, _ in out].count(0) == 1
    removed = [S._unpack_places(unpack(data)) for kind, _, data in out if kind == 1]
    assert sorted(k for k1, _, _, _ in removed for k in k1.tolist()) == list(range(1, 500))


def test_intervals_are_maximal(spark):
    text = " ".join(f"a{i}" for i in range(60))
    docs = documents(spark, [text, "start " + text + " end"])
    row = substring_dedup(docs, 20).where("doc_id = 1").first()
    assert [tuple(x) for x in row.removed] == [(1, 61)]
    assert row.kept_text == "start end"


def test_repeated_rows_ties_and_clashing_columns(spark):
    text = " ".join(f"b{i}" for i in range(25))
    rows = [(1, text), (1, text), (2, text), (None, text + " tail"), (3, None)]
    docs = documents(spark, rows).withColumns({"k1": F.lit(1), "g": F.lit("x"), "n_words": F.lit(0)})
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in substring_dedup(docs, 20).collect())
    assert got == [(-1, 0), (1, 25), (1, 25), (2, 25), (3, 0)]  # the null id sorts before all


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], DOCS), 20).count() == 0


def test_very_long_text(spark):
    text = " ".join(f"c{i}" for i in range(400_000))
    got = found(substring_dedup(documents(spark, [text, text + " z"]), 20))
    assert got[0][1] == 0
    assert got[1][:2] == (400_001, 400_000)


@given(st.lists(st.text(alphabet="ab \n\tüé", max_size=30), max_size=8))
@settings(max_examples=60, deadline=None)
def test_word_hashes_tell_words_apart(texts):
    raw = [t.encode() for t in texts]
    hashes, counts = word_hashes(raw)
    words = [w for t in raw for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in raw]
    assert len(words) == len(hashes)
    assert {w: h for w, h in zip(words, hashes.tolist(), strict=True)} == dict(zip(words, hashes.tolist(), strict=True))
    assert len(set(hashes.tolist())) == len(set(words))


def test_window_hashes_depend_on_the_window_only():
    a = np.arange(1, 50, dtype=np.uint64)
    b = np.concatenate((np.array([9, 9, 9], dtype=np.uint64), a))
    assert window_hashes(a, 20, 0xC2B2AE3D27D4EB4F).tolist() == window_hashes(b, 20, 0xC2B2AE3D27D4EB4F).tolist()[3:]


@given(st.lists(st.lists(st.integers(-(2**62), 2**62)), max_size=4))
@settings(max_examples=50, deadline=None)
def test_pack_round_trip(lists):
    arrays = [np.array(x, dtype=np.int64) for x in lists]
    assert [x.astype(np.int64).tolist() for x in unpack(pack(*arrays))] == lists
