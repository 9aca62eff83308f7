from __future__ import annotations

import hashlib
import math
import random
import re
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from pagesift.llm.importance_resampling import BUCKETS, Scan, resample, shift, words_of
from tests.llm.data import documents

TOKEN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, target, low=1, high=1, percent=10, min_words=20):
    def features(text):
        w = TOKEN.findall(lower(text))
        return w, [" ".join(w[i : i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * BUCKETS, [0] * BUCKETS
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for f in features(x)[1]:
                counts[crc32(f.encode()) % BUCKETS] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + BUCKETS) / ((s[b] + 1) * (sum(t) + BUCKETS)))) for b in range(BUCKETS)]
    rows = []
    for doc_id, text in docs:
        w, f = features(text)
        weight = sum(gain[crc32(x.encode()) % BUCKETS] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(w), len(f), weight, score, None])
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], -(1 << 63) if r[0] is None else r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(str, rows))


def soup(seed, docs, words):
    rng = random.Random(seed)
    vocabulary = ["Alpha", "béta", "gamma9", "x", "12", "naïve-té", "Ω", "longword" * 9]
    return [rng.choice([" ", "\n", " -- "]).join(rng.choice(vocabulary) for _ in range(rng.randrange(words))) for _ in range(docs)]


def test_equals_brute_force_with_ties_repeats_and_odd_texts(spark):
    texts = [*soup(1, 300, 60), None, "", "…", " \t ", "one two " * 30_000]
    docs = [*enumerate(texts), (None, "null id " * 20), (7, texts[7]), (7, texts[7]), (8, "other text of the same id " * 5)]
    target = [*soup(2, 20, 30), None, ""]
    frame = documents(spark, docs).withColumns({"score": F.lit("x"), "rank": F.lit(1), "bucket": F.lit(2)})
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string").withColumn("n", F.lit(1))
    for low, high in ((1, 1), (2, 3)):
        got = [list(r) for r in resample(frame, goal, low, high).collect()]
        assert sorted(map(str, got)) == brute(docs, target, low, high)


def test_every_document_and_every_rank_is_there_once(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = resample(frame, spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"])
    assert len(got) == frame.count() and ranks == list(range(1, sum(r.n_words >= 20 for r in got) // 10 + 1))
    drawn, rest = [[r.weight for r in got if r.n_words >= 20 and bool(r["rank"]) is x] for x in (True, False)]
    assert sum(drawn) / len(drawn) > sum(rest) / len(rest)


def test_empty_tables(spark):
    none = documents(spark, [])
    goal = spark.createDataFrame([], "item_id bigint, text string")
    assert resample(none, goal).collect() == []
    one = resample(documents(spark, ["word " * 25] * 10), goal).collect()
    assert sorted(r["rank"] or 0 for r in one) == [0] * 9 + [1]


def test_crcs_of_substrings_come_from_two_prefixes():
    texts = [t.encode() for t in soup(3, 40, 40)] + [b"", b"a" * 70_000 + b" b"]
    scan = Scan(texts)
    for n in (1, 2, 5):
        crcs, doc = scan.ngrams(n)
        expected = [(crc32(b" ".join(w[i : i + n])), k) for k, w in enumerate(map(words_of, texts)) for i in range(len(w) - n + 1)]
        assert list(zip(crcs.tolist(), doc.tolist(), strict=True)) == expected
    zero = np.array([crc32(b"ab")], dtype=np.uint32)
    assert int(shift(zero, np.array([3]))[0]) ^ crc32(b"cde") == crc32(b"abcde")
