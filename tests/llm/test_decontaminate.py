from __future__ import annotations

import re

from pyspark.sql import functions as F

from pagesift.llm.decontaminate import Patterns, find_contamination, words_of
from tests.llm.data import DOCS, documents, word_soup

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string"


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, size):
    patterns = []
    for item, text in items:
        w = plain_words(text)
        k = min(size, len(w))
        patterns += [(item, w[i : i + k]) for i in range(len(w) - k + 1) if k]
    out = []
    for text in texts:
        w, hit, own = plain_words(text), set(), set()
        for item, p in patterns:
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    own.add(item)
        own.discard(None)
        out.append((len(w), len(hit), sorted(own), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_equals_brute_force_in_one_block_and_in_many(spark):
    texts = [*word_soup(2, 40), None, "", "W1, w2; W3!", "ß Über 12a"]
    items = [(i, " ".join(t.split()[:n])) for i, (t, n) in enumerate(zip(texts[:12], (20, 13, 5, 1, 2, 40, 9, 14, 3, 13, 30, 8), strict=True))]
    items += [(50, None), (51, "..."), (None, "w1 w2"), (52, "über"), (0, items[0][1])]
    bench = spark.createDataFrame(items, ITEMS)
    docs = documents(spark, texts)
    for block in (1 << 20, 60):
        rows = find_contamination(docs, bench, 13, block_bytes=block).orderBy("doc_id").collect()
        assert [(r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in rows] == brute(texts, items, 13)


def test_overlapping_and_repeated_occurrences():
    patterns = Patterns([(1, b"a a a"), (2, b"a b")], 3)
    assert sorted(patterns.search(words_of(b"A a a a b"))) == [(0, 3, [1]), (1, 3, [1]), (3, 2, [2])]


def test_clashing_columns_and_empty_sides(spark):
    docs = documents(spark, ["a b c"]).withColumns({"n_hit": F.lit("x"), "__hit": F.lit(1), "items": F.lit(2)})
    none = find_contamination(docs, spark.createDataFrame([], ITEMS))
    assert [(r.n_words, r.n_hit, r["items"], r.contaminated) for r in none.collect()] == [(3, 0, [], False)]
    assert find_contamination(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a")], ITEMS)).count() == 0


def test_long_text(spark):
    text = "x " * 300_000 + "one two three four five six seven eight nine ten eleven twelve thirteen"
    row = find_contamination(documents(spark, [text]), spark.createDataFrame([(7, " ".join(text.split()[-13:]))], ITEMS)).first()
    assert (row.n_words, row.n_hit, row.contaminated) == (300_013, 13, False)
