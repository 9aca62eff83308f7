from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from pagesift.llm.components import components
from pagesift.llm.ngram_join import ngram_join
from tests.llm.data import DOCS, documents, word_soup

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, size, num, den):
    """doc_id -> (set size, smallest id of the component)."""
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))} if w else set()
    least = {i: i for i in sets}
    find = lambda i: i if least[i] == i else find(least[i])
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                a_, b_ = sorted((find(a), find(b)))
                least[b_] = a_
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, n, words=80):
    """Texts that differ from one base in up to six words, so that some pairs link and some do not."""
    rng = random.Random(seed)
    base = [f"v{rng.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(words)] = f"z{rng.randrange(1000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("size", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_components_equal_brute_force(spark, size, num, den):
    texts = [*word_soup(3, 50), *near_copies(5, 60), *near_copies(6, 25, 30), None, "", "One", "one", "one two", "ONE TWO", "two one"]
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    members, links = ngram_join(documents(spark, rows).repartition(6), size, num, den)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in members.collect()} == brute(rows, size, num, den)
    pairs = [tuple(sorted((r.u, r.v))) for r in links.collect()]
    assert len(pairs) == len(set(pairs))  # once per pair


def test_exactly_at_the_threshold(spark):
    a = " ".join(f"a{i}" for i in range(20))  # 18 trigrams, 17 shared with the longer one of 19
    b = a + " tail"
    members, _ = ngram_join(documents(spark, [a, b]), 3, 18, 19)
    assert {r.component_id for r in members.collect()} == {0}
    members, _ = ngram_join(documents(spark, [a, b]), 3, 1801, 1900)
    assert {r.component_id for r in members.collect()} == {0, 1}


def test_repeats_ties_and_clashing_columns(spark):
    text = "some words that are all alike"
    rows = [(None, text), (4, text), (4, text), (4, "quite another text with words"), (9, "Quite another text with words"), (5, None), (5, None)]
    docs = documents(spark, rows).withColumns({"cls": F.lit(1), "n": F.lit("x"), "k1": F.lit(2)})
    members, _ = ngram_join(docs, 3, 90, 100)
    got = sorted(((r.doc_id or 0), r.n_shingles, r.component_id or 0, r["first"]) for r in members.collect())
    assert got == [(0, 4, 0, True), (4, 3, 4, True), (4, 4, 0, False), (4, 4, 0, False), (5, 0, 5, True), (5, 0, 5, True), (9, 3, 4, False)]


def test_empty_table(spark):
    members, links = ngram_join(spark.createDataFrame([], DOCS), 3, 90, 100)
    assert members.count() == 0
    assert links.count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(7, 7), (9, 8), (8, 9)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)]
    least = {}
    find = lambda i: i if least.setdefault(i, i) == i else find(least[i])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        least[y] = x
    want = {i: find(i) for i in least if any(find(j) == find(i) for j in least if j != i)}
    got = components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.root for r in got} == want
