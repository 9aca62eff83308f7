from __future__ import annotations

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from pagesift.llm.bilinear_lm import Model, Scorer, Trainer, contexts, count_words, encode, first_model, log_sums, score_texts, vocabulary
from tests.llm.data import documents


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    return [*(w for w in low.split(" ") if w), None]


def out(doc_id):
    return doc_id is not None and crc32(str(doc_id).encode()) % 7 == 2


def brute_base(docs):
    c = Counter(w for i, t in docs if not out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    rows = []
    for i, t in docs:
        w = tokens(t)
        rows.append((i, out(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)))
    return rows


def chain(seed, docs, words=60):
    """Texts in which a word tells much about the next."""
    rng = random.Random(seed)
    vocabulary = [f"Wörd{i}" for i in range(30)]
    texts = []
    for _ in range(docs):
        at, w = rng.randrange(30), []
        for _ in range(rng.randrange(5, words)):
            w.append(vocabulary[at])
            at = (at * 7 + rng.randrange(2)) % 30
        texts.append(rng.choice([" ", "\n", "\t "]).join(w))
    return texts


def key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:4]))


def test_base_columns_equal_brute_force(spark):
    docs = [*enumerate(chain(1, 200)), (900, None), (901, ""), (902, "\n \t"), (903, "only here"), (None, "null id null"), (5, "again Again"), (5, "again Again"), (904, "lang " * 40_000), (905, " ")]
    df = documents(spark, docs).withColumns({"row": F.lit(1), "word": F.lit("x"), "held_out": F.lit("y"), "score": F.lit(0)}).repartition(5)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in score_texts(df, classes=10, head=20).collect()), key=key)
    expected = sorted(brute_base(docs), key=key)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert all(math.isclose(g[5], e[5], rel_tol=1e-9, abs_tol=1e-9) for g, e in zip(got, expected, strict=True))
    assert any(r[1] for r in got)


def test_learns_the_order_of_words(spark):
    df = documents(spark, chain(2, 12_000)).coalesce(1)
    got = score_texts(df).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] > 0.75 * got[1]  # logs are negative: far more likely than by counts alone


def test_held_out_texts_of_the_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = score_texts(df).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_empty_tables_and_nothing_to_learn_from(spark):
    assert score_texts(documents(spark, [])).collect() == []
    only = next(i for i in range(99) if out(i))
    r = score_texts(documents(spark, [(only, "a b c")])).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 4, 0, 0, 0.0)
    assert math.isclose(r.score, 0.0, abs_tol=1e-6)


def test_probabilities_are_normalised():
    rng = np.random.default_rng(3)
    model = Model(*(rng.standard_normal(s).astype(np.float32) for s in ((8, 4), (2, 4), (7, 4), (7,))))
    scorer = Scorer(model, log_sums(model))
    for a in range(7):
        for b in range(7):
            total = sum(10 ** scorer.log10(np.array([a, b, w]), np.array([3]))[2] for w in range(7))
            assert abs(total - 1) < 1e-5


def test_steps_follow_the_gradient_of_the_objective():
    """The first step moves every parameter as the slope of the noise-contrastive objective says."""
    rng = np.random.default_rng(4)
    shares = rng.random(6)
    shares /= shares.sum()
    model = Model(*(rng.standard_normal(s) for s in ((7, 3), (2, 3), (6, 3), (6,))))
    before, second, word = (rng.integers(0, n, 5) for n in (7, 7, 6))
    trainer = Trainer(model, shares, 0.1, [1])
    noise = np.searchsorted(np.cumsum(shares), np.random.default_rng([1]).random(32) * np.cumsum(shares)[-1])

    def objective(arrays):
        context, places, output, bias = arrays
        total = 0.0
        for a, b, w in zip(before, second, word, strict=True):
            r = places[0] * context[a] + places[1] * context[b]
            away = lambda x: r @ output[x] + bias[x] - math.log(32 * shares[x])  # noqa: B023, E731
            total -= math.log1p(math.exp(-away(w))) + sum(math.log1p(math.exp(away(x))) for x in noise)
        return total / 5

    trainer.step(before, second, word)
    for k, (old, new) in enumerate(zip(model.arrays(), trainer.model.arrays(), strict=True)):
        for at in np.ndindex(old.shape):
            slope = 0.0
            for sign in (1, -1):
                moved = [a.copy() for a in model.arrays()]
                moved[k][at] += sign * 1e-5
                slope += sign * objective(moved) / 2e-5
            assert abs(float(new[at] - old[at]) - 0.1 * slope / math.sqrt(1e-2 + slope**2)) < 1e-4


def test_contexts_stop_at_text_borders_and_averages_are_by_tokens():
    before, second = contexts(np.array([1, 2, 3, 4]), np.array([3, 1]), 9)
    assert before.tolist() == [9, 1, 2, 9] and second.tolist() == [9, 9, 1, 9]
    model = first_model(np.array([0.5, 0.5]), 2)
    ones, threes = (Model(*(np.full(a.shape, float(x)) for a in model.arrays())) for x in (1, 3))
    weight, arrays = model.unpack(model.average([ones.pack(30), threes.pack(10)]))
    assert weight == 40 and all((a == 1.5).all() for a in arrays)


def test_common_words_are_chosen_by_whole_bins(spark):
    docs = documents(spark, ["a a a a b b b b c c d"] * 3)
    words = count_words(docs.select("text"))
    few = vocabulary(words, classes=5, head=2)
    assert sorted(few.counts.tolist()) == [12, 12] and (few.tokens, few.types, few.rest) == (36, 5, 2)
    none = vocabulary(words, classes=5, head=1)
    assert len(none.words) == 0 and none.class_counts.tolist() == [36]
    row = encode(docs.select("doc_id", F.lit(False).alias("held_out"), "text"), few).first()
    assert (row.n_tokens, row.n_known, len(row.rare)) == (12, 8, 4)
