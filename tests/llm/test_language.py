from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from pagesift.llm.language_id import FAMILIES, DIM, family_of, features, has_letter, held_out, identify, train
from tests.llm.data import DOCS

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy_on_the_given_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = train(docs.where(~held_out()))
    found = identify(docs, model).join(docs.select("doc_id", "lang").where(held_out()), "doc_id")
    right, total = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert total > 100
    assert right / total >= 0.97


def test_four_languages_of_two_families_and_one_unknown(spark):
    stems = {"en": "the thing shall", "de": "der schön auch", "fr": "le œuvre été", "es": "el niño año", "zz": "qo xix zaz"}
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(stems[lang].split()) for _ in range(30)), lang, "s", 0) for i, lang in enumerate(sorted(stems) * 12)]
    docs = spark.createDataFrame(rows, DOCS)
    model = train(docs)
    assert sorted(model.families) == ["germanic", "other", "romance"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs, model).collect()}
    assert all(got[i][0] == lang and 0.25 < got[i][1] <= 1 for i, _, lang, _, _ in rows)


def test_cases_without_a_letter_or_a_model(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "12 34 !?", "en", "s", 0), (None, "words here", None, "s", 0), (5, "more words", "en", "s", 0), (5, "more words", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit("x"), "lang_pred": F.lit(1)})
    got = sorted((r.doc_id or 0, r.lang_pred) for r in identify(docs, train(docs)).collect())
    assert got == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (5, "en"), (5, "en")]
    nothing = train(docs.where("lang = 'none'"))
    assert {(r.lang_pred, r.score) for r in identify(docs, nothing).collect()} == {("und", 0.0)}
    assert identify(spark.createDataFrame([], DOCS), nothing).count() == 0
    assert [r[1] for r in docs.select("doc_id", held_out()).collect() if r[0] is None] == [False]


def test_whole_text_counts():
    text = "abc " * 50_000
    x = features(text + "ż" * 50_000)
    assert abs(float(x.sum()) - 1) < 1e-3
    assert not np.allclose(x, features(text))
    assert x.shape == (DIM,)


def test_letters_and_families():
    assert has_letter("1é") and not has_letter("1²_") and not has_letter(None)
    assert family_of("de-AT") == "germanic" and family_of("xx") == "other"
    codes = [c for v in FAMILIES.values() for c in v]
    assert len(codes) == len(set(codes))
