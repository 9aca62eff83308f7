from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline as P
from pagesift.llm.registry import ORACLES, QUERIES
from tests.llm.data import DOCS
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    rows, problems = compare(spark, con, FOLDER, QUERIES[name], ORACLES[name])
    assert problems == []
    assert rows > 0


def test_every_operator_and_the_pipeline_are_registered():
    names = list(contract.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert "pipeline" in names
    assert [n for n, _ in P.STAGES] == ["quality", "lines", "near_dups", "decontaminate", "encode"]


def tables(spark, tmp_path, rows, bench, labels):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def prose(i, n=60):
    letters = lambda x: "".join(chr(97 + int(c)) for c in str(x))
    return " ".join(f"t{letters(i)}x{letters(k)}" for k in range(n))


def test_stages_act_on_planted_cases(spark, tmp_path):
    clean = [prose(i) for i in range(20)]
    item = " ".join(f"question{k}" for k in range(20))
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(clean)]
    rows += [(100, clean[3], "en", "s", 0), (101, clean[4] + " changed", "en", "s", 0)]
    rows += [(102, prose(50) + " " + item, "en", "s", 0), (103, "too short", "en", "s", 0), (104, None, None, None, None), (105, "again and again we go " * 10, "en", "s", 0)]
    rows += [(200 + i, prose(60 + i) + "\nShare this page with all your friends", "en", "s", 0) for i in range(12)]
    rows += [(None, prose(90), "en", "s", 0), (7, prose(91), "en", "s", 0), (6, clean[6], "en", "s", 0)]
    folder = tables(spark, tmp_path, rows, [(1, item), (2, None)], [(0, 1, 0)])
    got = P.run(spark, folder)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids"]
    ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in got.collect())
    assert ids == sorted([*range(20), 7, *range(200, 212), -1])
    from pagesift.llm.sentencepiece_codec import decode

    texts = {r.doc_id: r.text for r in decode(got).where("doc_id >= 200").collect()}
    assert texts[200].endswith("friends") and not any(texts[i].endswith("friends") for i in range(201, 212))


def test_each_stage_keeps_the_columns_and_takes_odd_input(spark, tmp_path):
    folder = tables(spark, tmp_path, [], [], [])
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "one two three", None, "s", 1)], DOCS)
    extra = odd.withColumns({"k1": F.lit("x"), "kept": F.lit(1), "items": F.lit(2), "row": F.lit("r")})
    for docs in (odd, extra, odd.limit(0)):
        for name, stage in P.STAGES:
            out = stage(spark, docs, folder)
            assert name == "encode" or out.columns == P.COLUMNS
            assert out.count() <= docs.count()
    assert P.run(spark, folder).count() == 0
