from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagesift.llm import line_templates
from pagesift.llm.line_templates import drop_recurring_lines, masked
from tests.llm.data import DOCS, documents


def brute(texts, min_docs, depth=3, similarity=0.5):
    """Kept texts; documents are told apart by place."""
    forms, where = {}, {}
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            words = tuple("<*>" if any(c in "0123456789" for c in w) else w for w in line.split())
            if words:
                forms.setdefault(words, {}).setdefault(i, []).append(k)
    leaf = lambda w: (len(w), w[:depth])
    leaf_docs, places = {}, {}
    for w, docs in forms.items():
        leaf_docs.setdefault(leaf(w), set()).update(docs)
        for p in (p for p in range(depth, len(w)) if w[p] != "<*>"):
            places.setdefault((leaf(w), p, w[p]), set()).update(docs)
    shapes = {}
    for w in forms:
        constant = tuple((p, w[p]) for p in range(depth, len(w)) if w[p] != "<*>" and len(places[leaf(w), p, w[p]]) >= min_docs)
        if len(leaf_docs[leaf(w)]) >= min_docs and sum(x != "<*>" for x in w[:depth]) + len(constant) >= similarity * len(w):
            shapes.setdefault((leaf(w), constant), []).append(w)
    drops = {}
    for same in shapes.values():
        if len({i for w in same for i in forms[w]}) >= min_docs:
            spots = sorted((i, k) for w in same for i, ks in forms[w].items() for k in ks)
            for i, k in spots[1:]:
                drops.setdefault(i, set()).add(k)
    return [None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drops.get(i, ())) for i, t in enumerate(texts)]


def some_texts():
    texts = []
    for i in range(30):
        lines = [f"unique start{i} of number n{i}", f"user bob{i} logged in from host alpha at noon"]
        lines += ["All rights reserved."] * (i % 2)
        lines += [f"{i} {i} {i} and {i}"]
        lines += [f"page {i} of {i + 7}", ""] * (i % 3 == 0)
        lines += [f"the quick brown fox{'abc'[i % 3] * i} jumps over the lazy dog"]
        texts.append("\n".join(lines))
    return [*texts, None, "", "All rights reserved."]


@pytest.mark.parametrize("min_docs", [3, 10])
def test_equals_brute_force(spark, min_docs):
    texts = some_texts()
    rows = drop_recurring_lines(documents(spark, texts).repartition(4), min_docs).orderBy("doc_id").collect()
    assert [r.kept_text for r in rows] == brute(texts, min_docs)
    assert [r.n_lines for r in rows] == [0 if t is None else t.count("\n") + 1 for t in texts]


def test_variable_fields_are_generalised(spark):
    texts = [f"visit number {i} on site\n{'abcdefghijkl'[i]} own words of text" for i in range(12)]
    rows = drop_recurring_lines(documents(spark, texts), 10, similarity=0.8).orderBy("doc_id").collect()
    assert rows[0].kept_text == texts[0]
    assert [r.kept_text for r in rows[1:]] == [t.split("\n")[1] for t in texts[1:]]


def test_repeats_nulls_and_clashing_columns(spark):
    text = "same line here"
    rows = [(None, text), (1, text), (1, text), (2, text), (3, text + "\n" + text)]
    docs = documents(spark, rows).withColumns({"n_lines": F.lit("x"), "row": F.lit(1), "leaf": F.lit(2)})
    got = drop_recurring_lines(docs, 3)
    assert {"row", "leaf", "source"} <= set(got.columns)
    assert sorted(((r.doc_id or 0), r.kept_text, r.n_dropped) for r in got.collect()) == [(0, text, 0), (1, "", 1), (1, "", 1), (2, "", 1), (3, "", 2)]


def test_empty_table(spark):
    assert drop_recurring_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_masked():
    assert masked(b"  a1  b\tc-2-d ") == b"<*> b <*>"


def test_one_document_makes_no_template_recur(spark, monkeypatch):
    recipe = "\n".join(f"Step number {'abcdefghijkl'[i]} of the recipe needs x now" for i in range(12))
    two = ["\n".join(f"total sum of {'abcdefghijkl'[i]} found" for i in half) for half in (range(6), range(6, 12))]
    texts = [recipe, *two, "nothing of that kind"]
    for bits in (22, 6):  # the fewer counters there are, the more leaves share one
        monkeypatch.setattr(line_templates, "COUNTER_BITS", bits)
        rows = drop_recurring_lines(documents(spark, texts), 10).orderBy("doc_id").collect()
        assert [r.kept_text for r in rows] == brute(texts, 10) == texts


def test_long_texts_and_a_template_in_many_documents(spark):
    texts = [f"Step number {'abcdefghijkl'[i]} of the recipe needs x now\nown words of {'abcdefghijkl'[i]}\n" + f"filler{'abcdefghijkl'[i]} " * 20_000 for i in range(12)]
    rows = drop_recurring_lines(documents(spark, texts), 10).orderBy("doc_id").collect()
    assert [r.kept_text for r in rows] == brute(texts, 10)
    assert [r.n_dropped for r in rows] == [0] + [1] * 11
