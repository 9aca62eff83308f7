from __future__ import annotations

import gc
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagesift.llm import common, quality_rules
from pagesift.llm.common import keep
from pagesift.llm.sentencepiece_codec import SEPARATOR, Codec, decode, encode, read_pieces
from tests.llm.data import DOCS, documents

BYTES = [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
TOY = [("<unk>", 0.0, 2), *BYTES, *((p, s, 1) for p, s in [("▁", -5.0), ("a", -3.0), ("b", -3.0), ("ab", -4.0), ("▁ab", -5.5), ("bab", -4.5), ("▁a", -4.0), ("é", -2.0), ("▁▁", -1e9)])]
SPANNING = [*TOY, ("b▁a", -1.0, 1)]


def best_score(codec, text):
    """Largest sum of scores over every way to cut the text, and its pieces, by plain recursion over ends."""
    best = [(0.0, [])]
    for end in range(1, len(text) + 1):
        options = [(best[end - 1][0] + codec.fallback, best[end - 1][1] + [None])]
        for start in range(end):
            if text[start:end] in codec.scores:
                options.append((best[start][0] + codec.scores[text[start:end]][1], best[start][1] + [text[start:end]]))
        best.append(max(options, key=lambda x: x[0]))
    return best[-1][0]


def score_of(codec, ids):
    by_id = {i: s for _, s, i in codec.scores.values()}
    total, run = 0.0, b""
    for i in ids:
        if i in by_id:
            total += by_id[i]
        else:  # bytes of characters, at most four each
            run += codec.bytes_of[i]
    return total + len(run.decode()) * codec.fallback


@pytest.mark.parametrize("pieces", [TOY, SPANNING])
@given(text=st.text(alphabet="ab é\nz", max_size=25))
@settings(max_examples=150, deadline=None)
def test_best_segmentation(pieces, text):
    codec = Codec(pieces)
    ids = codec.encode(text).tolist()
    assert codec.decode(ids) == text
    if text:
        assert score_of(codec, ids) == pytest.approx(best_score(codec, SEPARATOR + text.replace(" ", SEPARATOR)))


def test_cuts_do_not_change_the_result():
    codec, whole = Codec(read_pieces()), Codec(read_pieces())
    assert codec.cuts and not Codec(SPANNING).cuts
    whole.cuts = False
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice(["the", "ing", " ", "  ", "\n", "é", "1", "▁", "語", "🙂", "\t", "Q"]) for _ in range(rng.randrange(40)))
        assert codec.encode(text).tolist() == whole.encode(text).tolist()


CODEC = Codec(read_pieces())


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_round_trip_of_any_text(text):
    assert CODEC.decode(CODEC.encode(text).tolist()) == text


def test_spark_round_trip_with_odd_rows(spark):
    long = "Text of some length. " * 20_000
    texts = [None, "", " ", "▁", " ▁ a▁b", "plain words", "plain words", "two\n\nlines \n", long]
    docs = documents(spark, texts).withColumns({"ids": F.lit("x"), "n_tokens": F.lit(1)})
    tokens = encode(docs, check=True)
    rows = tokens.orderBy("doc_id").collect()
    assert all(r.round_trip for r in rows)
    assert rows[0].ids is None and rows[1].ids == [] and rows[5].ids == rows[6].ids
    assert [r.n_tokens for r in rows] == [len(r.ids or ()) for r in rows]
    assert [r.text for r in decode(tokens.drop("round_trip")).orderBy("doc_id").collect()] == texts
    assert encode(spark.createDataFrame([], DOCS)).count() == 0


def test_each_vocabulary_has_its_own_codec(spark):
    """Many vocabularies in one session, their broadcasts collected as garbage meanwhile."""
    docs = documents(spark, ["ab"]).coalesce(1)
    for k in range(25):
        pieces = [("a", -1.0, 1), ("b", -1.0, 1), ("▁", -1.0, 1), *(("x" * (i + 3), -1.0, 1) for i in range(k)), ("ab", -0.5, 1)]
        assert encode(docs, pieces).first().ids[-1] == k + 3
        gc.collect()


def test_long_segments_are_not_remembered():
    codec = Codec(read_pieces())
    text = " ".join("a" * n for n in range(1, 200))
    assert codec.decode(codec.encode(text).tolist()) == text
    assert max(map(len, codec.spaced)) <= 64 and codec.encode(text).tolist() == Codec(read_pieces()).encode(text).tolist()


def test_a_worker_keeps_one_codec_and_forgets_it():
    built = []
    for name in ("a", "a", "b"):
        keep(name, lambda: built.append(name) or Codec([]))
    assert built == ["a", "b"] and list(common._KEPT) == ["b"]
    list(quality_rules._measured(0, 0, {None: frozenset()})(iter(())))
    assert not common._KEPT
