from __future__ import annotations

import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagesift import schemas as S
from pagesift.functions.text import page_text
from pagesift.operators.embed import ByteBudget, _TokenCodes, assign_chunks, embed_texts, hash_embedder
from pagesift.operators.extract import assemble_pages
from pagesift.plans.indexing import index_pass


def chunks(sizes, limit):
    budget, out = ByteBudget(limit), []
    for s in sizes:
        verdict = budget.place(s)
        if verdict == ByteBudget.TOO_BIG:
            out.append([])
        elif verdict == ByteBudget.NEXT_CHUNK:
            out.append([s])
        else:
            out[-1].append(s)
    return [c for c in out if c]


@pytest.mark.parametrize(
    ("sizes", "expected"),
    [
        ([], []),
        ([10], [[10]]),
        ([4, 6], [[4, 6]]),
        ([4, 7], [[4], [7]]),
        ([11, 4, 6], [[4, 6]]),
        ([4, 11, 6], [[4], [6]]),
        ([4, 6, 11], [[4, 6]]),
        ([11, 12], []),
        ([0, 10, 0, 1], [[0, 10, 0], [1]]),
    ],
)
def test_greedy_chunks(sizes, expected):
    assert chunks(sizes, 10) == expected


def test_chunks_never_exceed_the_limit():
    sizes = [int(x) for x in np.random.default_rng(0).integers(0, 15, 500)]
    assert all(sum(c) <= 10 for c in chunks(sizes, 10))
    assert sum(map(sum, chunks(sizes, 10))) == sum(s for s in sizes if s <= 10)


def test_assign_chunks_by_group(spark):
    rows = [(0, 0, 4), (0, 1, 7), (0, 2, 11), (0, 3, 1), (1, 4, 10)]
    got = assign_chunks(spark.createDataFrame(rows, "g long, id long, n long"), "g", "id", "n", 10).orderBy("id").collect()
    assert [r.chunk for r in got] == [0, 1, -1, 2, 0]


def recording(path):
    """A model that writes down the size of every call it gets."""

    def load():
        def embed(texts):
            with open(path, "a") as out:
                out.write(f"{sum(len(t.encode()) for t in texts)}\n")
            return np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

        return embed

    return load


def test_embedding_is_aligned_and_byte_bounded(spark, tmp_path):
    texts = ["é" * n for n in (1, 2, 3, 4, 6, 1, 2)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    log = tmp_path / "calls"
    got = embed_texts(df, ["id"], "text", recording(str(log)), limit=10).orderBy("id").collect()
    assert [r.vector for r in got] == [[1, 1], [2, 1], [3, 1], [4, 1], [], [1, 1], [2, 1], [0, 1], [0, 1]]
    assert [int(x) for x in log.read_text().split()] == [6, 6, 8, 6]


def test_empty_input(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert embed_texts(df, ["id"], "text").count() == 0


def test_a_failing_chunk_fails_the_call(spark):
    def load():
        def embed(texts):
            raise RuntimeError("model down")

        return embed

    df = spark.createDataFrame([(1, "x")], "id long, text string")
    with pytest.raises(Exception, match="model down"):
        embed_texts(df, ["id"], "text", load).collect()


def test_hash_embedder_is_deterministic():
    embed = hash_embedder(16)()
    a, b = embed(["Über uns: über_uns 42", "über uns ÜBER uns 42"])
    assert (a == b).all() and a.sum() != 0
    assert (embed(["..."]) == 0).all()


def test_page_text(spark):
    rows = [("T", "D", "C"), ("T", "", ""), ("", "D", None), (None, None, "C"), ("", "", "")]
    df = spark.createDataFrame(rows, "t string, d string, c string").coalesce(1)
    got = [r[0] for r in df.select(page_text(F.col("t"), F.col("d"), F.col("c"))).collect()]
    assert got == ["Title: T. Description: D. Content: C.", "Title: T. ", "Description: D. ", "Content: C.", ""]


def test_index_pass(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [
        (1, "A", "cats", "", "", t0, None, True),
        (2, "B", "x", "", "y" * 100, t0, None, True),
        (3, "C", "x", "", "", t0, [1.0, 0.0], True),
        (4, "D", "x", "", "", t0, None, False),
        (5, "E", "", None, "", t0, None, True),
    ]
    pages = spark.createDataFrame(rows, S.PAGE)
    once = index_pass(pages, hash_embedder(8), limit=50)
    got = {r.url: r for r in once.collect()}
    assert np.linalg.norm(got["A"].vector) == pytest.approx(1.0) and got["A"].can_be_vectorized
    assert got["B"].vector is None and not got["B"].can_be_vectorized
    assert got["C"].vector == [1.0, 0.0]
    assert (got["D"].vector, got["D"].can_be_vectorized) == (None, False)
    assert (got["E"].vector, got["E"].can_be_vectorized) == (None, True)
    again = {r.url: r for r in index_pass(once, hash_embedder(8), limit=50).collect()}
    assert again == got


def test_workers_are_handed_small_batches_and_remember_little(spark):
    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    rows = spark.range(0, 5_000, numPartitions=1).selectExpr("id AS page_id", "concat('https://h.example/', id) AS url", "concat('<p>', repeat('word ', 1000)) AS html")
    for made in (assemble_pages(rows), embed_texts(rows, ["page_id", "html"], "html")):
        handed = made.mapInArrow(sizes, "rows bigint, bytes bigint").collect()
        assert sum(r.rows for r in handed) == 5_000
        assert max(r.rows for r in handed) <= 2_000 and max(r.bytes for r in handed) < 8 << 20
    codes = _TokenCodes(8)
    assert codes["x" * 10_000] in range(16) and not codes
    assert codes["word"] in range(16) and list(codes) == ["word"]
