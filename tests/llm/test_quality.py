from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from pagesift.llm import quality_rules as Q
from tests.llm.data import DOCS

LABELS = "doc_id bigint, quality int, toxic int"


def brute_base(text):
    words = text.split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if x.split()]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside))


@pytest.mark.parametrize("text", ["", "a", "a b c d e", "a b c d e " * 3, "x|y\nx|y\n\nq <b> ü é\nx|y", "a a a a a a a", "1 2 3 4 5 6 1 2 3 4 5 7 8 9 2 3 4 5 6 1"])
def test_base_numbers(text):
    assert Q.measure(text, frozenset())[:5] == brute_base(text)


def test_within_risk_is_the_exact_binomial_tail():
    for n, k, risk in [(300, 0, 0.01), (300, 1, 0.02), (1000, 3, 0.01), (50, 0, 0.05)]:
        tail = sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))
        for level in (tail * 0.99, tail * 1.01):
            assert Q.within_risk(k, n, risk, level) == (tail <= level and k <= risk * n)
    assert not Q.within_risk(0, 0, 0.01, 0.05)
    assert not Q.within_risk(5, 5, 0.01, 0.05)


def corpus(spark, n=3000):
    """Good prose, symbol junk and toxic texts; labels for all but the last hundred."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = [f"word{rng.randrange(5000)}" for _ in range(40)]
        kind = i % 10
        if kind == 8:
            words = [w + "###" for w in words]
        if kind == 9:
            words[::7] = ["vile"] * len(words[::7])
        rows.append((i, " ".join(words), "en" if i % 2 == 0 else "xx", "s", 0))
        if i < n - 100:
            labels.append((i, int(kind != 8), int(kind == 9)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)


def test_rejects_bad_and_keeps_clean(spark):
    docs, labels = corpus(spark)
    kept = {r.doc_id: r.kept for r in Q.quality_rules(docs, labels).collect()}
    # symbols appear in even documents only, toxic words in odd ones, so each rule is certified where it is needed
    assert all(kept[i] == (i % 10 < 8) for i in range(3000))


def test_too_few_labels_certify_nothing(spark):
    docs, labels = corpus(spark, 300)
    rows = Q.quality_rules(docs, labels).collect()
    assert all(r.kept and not r.rejected_by for r in rows)


def test_nulls_empty_tables_and_repeats(spark):
    rows = [(1, None, "en", "s", 0), (None, "a b c d e f g h i j k", None, None, None), (2, "", None, "s", 0), (3, "p q r s t u v w x y z", "en", "s", 1), (3, "p q r s t u v w x y z", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("clash"))
    labels = spark.createDataFrame([(3, 1, None), (None, 1, 0), (3, 1, 0), (3, 1, 0)], LABELS)
    got = sorted((r.doc_id or 0, r.base_failed, r.kept) for r in Q.quality_rules(docs, labels).collect())
    assert got == [(0, False, True), (1, True, False), (2, True, False), (3, False, True), (3, False, True)]
    assert sorted((r.doc_id or 0) for r in Q.keep_quality(docs, labels).collect()) == [0, 3, 3]
    none = spark.createDataFrame([], LABELS)
    assert Q.quality_rules(docs, none).count() == 5
    assert Q.quality_rules(spark.createDataFrame([], DOCS), none).count() == 0


def tongues(spark):
    """Toxic and good texts: 3,000 labels of one language, 500 of another, 60 of a third, some without language or label."""
    rng = random.Random(5)
    rows, labels = [], []
    for lang, n, labelled in [("en", 3000, 3000), ("fr", 500, 500), ("es", 200, 60), (None, 100, 0), ("it", 100, 0)]:
        for _ in range(n):
            i = len(rows)
            words = [f"{lang}{''.join(chr(97 + int(c)) for c in str(rng.randrange(3000)))}" for _ in range(40)]
            toxic = i % 10 == 9
            if toxic:
                words[::7] = [f"vile{lang if lang in ('en', 'fr') else 'en'}"] * len(words[::7])
            rows.append((i, " ".join(words), lang, "s", 0))
            if labelled > 0:
                labels.append((i, 1, int(toxic)))
                labelled -= 1
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)


def test_small_strata_and_those_without_labels_are_checked_for_toxic_words(spark):
    docs, labels = tongues(spark)
    rows = Q.quality_rules(docs, labels).collect()
    assert {(r.stratum, r.doc_id % 10 == 9) for r in rows if not r.kept} == {(s, True) for s in ("en", "fr", "es", None, "it")}
    assert all(r.kept == (r.doc_id % 10 != 9) for r in rows)


def test_a_shared_cutoff_spares_a_stratum_whose_own_labels_speak_against_it(spark):
    docs, labels = tongues(spark)
    # in the third language the word is in good texts as well
    usual = (F.col("lang") == "es") & (F.col("doc_id") % 10 == 0)
    docs = docs.withColumn("text", F.when(usual, F.concat("text", F.lit(" vileen" * 6))).otherwise(F.col("text")))
    rows = Q.quality_rules(docs, labels).collect()
    assert all(r.kept for r in rows if r.stratum == "es")
    assert all(r.kept == (r.doc_id % 10 != 9) for r in rows if r.stratum != "es")


def test_tests_are_counted_by_label_numbers():
    assert Q._tests_made([], 0.02, 0.05) == 1
    assert Q._tests_made([149, 3], 0.02, 0.05) == 1
    assert Q._tests_made([160] * 7, 0.02, 0.05) == 2  # none passes at half the level
    assert Q._tests_made([1000] * 21 + [314] * 7 + [297] * 7, 0.02, 0.05) == 28


def test_word_lists_equal_brute_force(spark):
    docs, labels = tongues(spark)
    docs = docs.select("doc_id", F.col("lang").alias("stratum"), "text")
    labels = Q._split(labels)
    texts = {r.doc_id: (r.stratum, r.text) for r in docs.collect()}
    fitted = [(r.doc_id, r.toxic == 1) for r in labels.where("fitted").collect()]

    def listed(rows):
        bad = [set(Q._LETTERS.findall(texts[i][1].lower())) for i, toxic in rows if toxic]
        other = [set(Q._LETTERS.findall(texts[i][1].lower())) for i, toxic in rows if not toxic]
        found = []
        for w in set().union(*bad) if other else ():
            a, b = sum(w in x for x in bad), sum(w in x for x in other)
            ratio = ((a + 0.5) / len(bad)) / ((b + 0.5) / len(other))
            if a >= Q.LEXICON_SUPPORT and a >= Q.LEXICON_SHARE * len(bad) and ratio >= Q.LEXICON_RATIO:
                found.append((-a, -ratio, w))
        return {w for _, _, w in sorted(found)[: Q.LEXICON_WORDS]}

    pooled = listed(fitted)
    own = {s: listed([(i, t) for i, t in fitted if texts[i][0] == s]) for s in {texts[i][0] for i, _ in fitted} - {None}}
    want = {s: w | pooled for s, w in own.items() if w} | {None: pooled.union(*own.values())}
    assert Q.toxic_lexicons(docs, labels) == want
    assert {"vileen", "vilefr"} <= want[None]


def test_choice_of_cutoffs_equals_brute_force(spark):
    """Few values for each signal, so many documents tie with a cutoff and many cutoffs with each other."""
    rng = random.Random(11)
    rows = []
    for stratum, n in [("en", 2500), ("fr", 700), ("es", 40), (None, 90)]:
        for _ in range(n):
            quality, toxic = int(rng.random() < 0.8), int(rng.random() < 0.1)
            signals = []
            for r, cutoffs in Q.RULES.items():
                bad = toxic if r == "toxic_words" else not quality
                signals.append(rng.choice([*cutoffs, 2 * cutoffs[0]]) if bad and rng.random() < 0.5 or rng.random() < 0.004 else 0.0)
            rows.append((stratum, rng.random() < 0.3, quality, toxic, *signals))
    holdout = spark.createDataFrame(rows, "stratum string, fitted boolean, quality int, toxic int, " + ", ".join(f"{r} double" for r in Q.RULES))

    def counts(at, rule, stratum=None):
        some = [x for x in rows if stratum in (None, x[0])]
        fine = [x[at] for x in some if x[2] == 1 and x[3] == 0 and not (rule == "toxic_words" and x[1])]
        bad = [x[at] for x in some if (x[3] == 1 if rule == "toxic_words" else x[2] == 0)]
        return fine, bad

    def tail(k, n):
        return sum(math.comb(n, i) * Q.RISK**i * (1 - Q.RISK) ** (n - i) for i in range(k + 1))

    sizes = [len(counts(4 + j, r, s)[0]) for s in ("en", "fr", "es", None) for j, r in enumerate(Q.RULES)]
    tests = next(m for m in range(1, 100) if sum(tail(0, n) <= Q.DELTA / m for n in sizes) <= m)
    level = Q.DELTA / tests

    def best(rule, fine, bad):
        found = []
        for i, c in enumerate(Q.RULES[rule]):
            k = sum(x > c for x in fine)
            if k > Q.RISK * len(fine) or tail(k, len(fine)) > level:
                break
            gain = sum(x > c for x in bad) - Q.GOOD_COST * k
            if gain > 0:
                found.append((-gain, i, c))
        return min(found)[2] if found else None

    chosen, shared = Q.choose_cutoffs(holdout)
    want, common = set(), {}
    for j, r in enumerate(Q.RULES):
        certifiable = {s for s in ("en", "fr", "es") if tail(0, len(counts(4 + j, r, s)[0])) <= level}
        want |= {(s, r, c) for s in certifiable if (c := best(r, *counts(4 + j, r, s))) is not None}
        if (c := best(r, *counts(4 + j, r))) is not None:
            refuted = {s for s in ("en", "fr", "es") if sum(x > c for x in counts(4 + j, r, s)[0]) > Q.RISK * len(counts(4 + j, r, s)[0])}
            common[r] = (c, sorted(certifiable | refuted))
    assert set(chosen) == want and len(chosen) > 0
    assert {r: (c, names) for r, c, names in shared} == common
