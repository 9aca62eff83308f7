"""Quality rules whose cutoffs are chosen on labelled holdouts with a bounded risk.

Every document gets a few signals (shares of symbols, repeated lines, repeated words and so
on, and hits of a toxic-word list). A rule rejects documents whose signal is above a cutoff.
Cutoffs are set per stratum (language) and rule:

    * the null hypothesis of a cutoff is "more than ``risk`` of the good documents of this
      stratum would be rejected"; the exact (Clopper-Pearson) upper bound on the share of good
      holdout documents above it decides;
    * within one rule and stratum the cutoffs are tried from the loosest down and the first
      failure ends the row (fixed-sequence testing), so no level is spent twice; across rules
      and strata the level is divided by the number of tests (Bonferroni). Only rules and strata
      with labels enough to pass without a false rejection are tested and counted; label numbers
      alone decide that. With probability at least 1 - ``delta`` every certified cutoff keeps its
      promise, whichever is picked later;
    * among the certified cutoffs the one with the most bad documents rejected is used, good
      ones counting ``GOOD_COST`` times; ties go to the loosest;
    * all labels together are one more stratum. Its cutoffs, certified in the same way for good
      documents of the whole mixture, serve documents without stratum and those of strata
      with too few labels for the rule, unless the stratum's own good labels show more than ``risk``
      above the cutoff. With too few labels altogether nothing is rejected.

Toxic words are fitted for each stratum and over all, on a bounded sample (``LEXICON_ROWS``). The
promise is about good documents, so only those must not be seen twice: the fit takes all toxic
documents and one in ``FIT_SHARE`` of the others, and the good ones of the rest, all of them, set
the cutoff on the hits. Toxic documents that were fitted count as rejected ones too, which bears
on the pick among certified cutoffs only. The other signals are not fitted, so their cutoffs are
set on all labels. A document is compared with the words of its stratum and those over all, one
without stratum or of a stratum without words with all words.

Base rules, before all others: fewer than 10 words, or over 20 % of the words in five-word
windows that occur twice or more.

Input cases: null or empty text has no words and fails the base rules; labels with a null
in any column are left out, and of labels repeated for one document each row counts, but none
as good for the toxic words if one says toxic; a document that is repeated is judged each time alike; a null document id is judged but never
matches a label; empty labels certify nothing; empty documents give an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagesift.llm.common import doc_key, forget
from pagesift.session import written

RISK = 0.02
"""Largest share of good documents of a stratum that one rule may reject."""
DELTA = 0.05
"""Probability that any of the certified cutoffs breaks its promise."""
GOOD_COST = 50
LEXICON_ROWS = 20_000
"""Labelled documents that the toxic-word list is fitted on, at most."""
LEXICON_WORDS = 1_000
SLICES = 16
FIT_SHARE = 5
"""One in so many labelled documents that are not toxic serves the word list and not its cutoff."""
LEXICON_SUPPORT = 5
LEXICON_SHARE = 0.02
"""A word of a list is in at least so many toxic documents of its stratum, and in this share of them."""
LEXICON_RATIO = 20.0
"""A word is toxic if its share of toxic documents is so many times its share of others."""

#: Rules and the cutoffs that are tried, from the loosest to the tightest.
RULES: dict[str, list[float]] = {
    "symbol_share": [0.5, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01, 0.005],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2],
    "repeat_share": [0.2, 0.175, 0.15, 0.125, 0.1, 0.075, 0.05],
    "same_next_share": [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05],
    "upper_share": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
    "mark_share": [1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.1],
    "toxic_words": [10.0, 5.0, 4.0, 3.0, 2.0, 1.0, 0.0],
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

# what to delete so that these characters are left
_SYMBOLS = bytes(c for c in range(256) if c not in b"#*$%&|<>")
_UPPER = bytes(c for c in range(256) if not 0x41 <= c <= 0x5A)
_SMALL = bytes(c for c in range(256) if not 0x61 <= c <= 0x7A)
_LETTERS = re.compile(r"[^\W\d_]+")
_MEASURE_DDL = ", ".join(f"{c} bigint" for c in BASE) + ", " + ", ".join(f"{r} double" for r in RULES)


def _repeated(words: list[bytes], size: int = 5) -> int:
    """Words inside a window of ``size`` words that occurs twice or more in the text."""
    if len(words) <= size:
        return 0
    shifted = [words[i:] for i in range(size)]
    windows = list(zip(*shifted, strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts, total, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + size - max(i, end)
            end = i + size
    return total


def measure(text: str, lexicon: frozenset[str]) -> tuple:
    """Base numbers and signals of one text."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = len(raw.translate(None, _SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.split()]
    dup_lines = len(lines) - len(set(lines))
    repeated = _repeated(words)
    same = sum(map(bytes.__eq__, words, words[1:]))
    upper = len(raw.translate(None, _UPPER))
    letters = upper + len(raw.translate(None, _SMALL))
    hits = sum(map(lexicon.__contains__, _LETTERS.findall(text.lower()))) if lexicon else 0
    return (
        n, word_chars, symbols, dup_lines, repeated,
        symbols / max(1, word_chars), dup_lines / max(1, len(lines)), repeated / max(1, n), same / max(1, n - 1),
        upper / max(1, letters), raw.count(b"!") / max(1, n), float(hits),
    )


def _measured(at: int, stratum_at: int, lexicons: dict[str | None, frozenset[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            strata = batch.column(stratum_at).to_pylist()
            rows = [measure(t or "", lexicons.get(s, lexicons[None])) for s, t in zip(strata, batch.column(at).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(BASE) + len(RULES))
            kinds = [pa.int64()] * len(BASE) + [pa.float64()] * len(RULES)
            arrays = batch.columns[:at] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names[:at] + BASE + list(RULES))

    return run


def _split(labels: DataFrame) -> DataFrame:
    """labels and ``fitted``: true for documents that the word lists may see, false for those that set their cutoff."""
    toxic = F.max(F.col("toxic") == 1).over(Window.partitionBy("doc_id"))
    share = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FIT_SHARE)) == 0
    return labels.withColumn("fitted", toxic | share)


def toxic_lexicons(docs: DataFrame, labels: DataFrame, rows: int = LEXICON_ROWS) -> dict[str | None, frozenset[str]]:
    """Words far more frequent in toxic documents than in others, by stratum, over at most ``rows`` fitted labels.

    Each stratum has the words that stand out in it and those that stand out over all; under None
    are all of them. The sample is the first ``rows`` in an order by checksum; its ids and flags
    are the only thing broadcast. Documents count once for each word that they have.
    """
    sample = labels.where("fitted").orderBy(F.crc32(F.concat(F.lit("lexicon"), F.col("doc_id").cast("string")).cast("binary")), "doc_id").limit(rows)
    sample = sample.select("doc_id", (F.col("toxic") == 1).alias("bad"))
    spark = docs.sparkSession
    picked = spark.createDataFrame(sample.collect(), "doc_id bigint, bad boolean")  # at most ``rows`` pairs
    texts = docs.join(F.broadcast(picked), "doc_id").select("stratum", "bad", "text").where("text IS NOT NULL")
    schema = pa.schema([("pool", pa.bool_()), ("stratum", pa.string()), ("word", pa.string()), ("bad", pa.bool_()), ("n", pa.int64())])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        counts: dict[tuple[str | None, bool], Counter] = {}
        for batch in batches:
            for stratum, bad, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = counts.setdefault((stratum, bad), Counter())
                own.update(set(_LETTERS.findall(text.lower())))
                own[""] += 1
        for (stratum, bad), found in counts.items():
            for pool in (True, False) if stratum is not None else (True,):
                k = len(found)
                yield pa.RecordBatch.from_pydict({"pool": [pool] * k, "stratum": ["" if pool else stratum] * k, "word": list(found), "bad": [bad] * k, "n": list(found.values())}, schema=schema)

    counted = texts.mapInArrow(words, "pool boolean, stratum string, word string, bad boolean, n bigint").groupBy("pool", "stratum", "word").agg(
        F.coalesce(F.sum(F.when(F.col("bad"), F.col("n"))), F.lit(0)).alias("a"), F.coalesce(F.sum(F.when(~F.col("bad"), F.col("n"))), F.lit(0)).alias("b")
    )
    # words of the sample that are frequent enough, and one row of totals (the empty word) for each stratum of it
    counted = written(counted.where((F.col("a") >= LEXICON_SUPPORT) | (F.col("word") == "")), "words")
    totals = counted.where("word = '' AND b > 0").select("pool", "stratum", F.col("a").alias("all_a"), F.col("b").alias("all_b"))
    # no more rows than the sample has, and one
    counted = counted.where("word <> ''").join(F.broadcast(totals), ["pool", "stratum"]).where(F.col("a") >= LEXICON_SHARE * F.col("all_a"))
    counted = counted.withColumn("ratio", ((F.col("a") + 0.5) / F.col("all_a")) / ((F.col("b") + 0.5) / F.col("all_b"))).where(F.col("ratio") >= LEXICON_RATIO)
    # the first of each slice of words, then of each stratum: no task ranks more than SLICES lists
    top = counted.withColumn("slice", F.pmod(F.xxhash64("word"), F.lit(SLICES)))
    for key in (["pool", "stratum", "slice"], ["pool", "stratum"]):
        order = Window.partitionBy(*key).orderBy(F.desc("a"), F.desc("ratio"), "word")
        top = top.withColumn("r", F.row_number().over(order)).where(F.col("r") <= LEXICON_WORDS)
    pooled: set[str] = set()
    own: dict[str, set[str]] = {}
    for pool, stratum, word in top.select("pool", "stratum", "word").collect():
        (pooled if pool else own.setdefault(stratum, set())).add(word)
    return {s: frozenset(w | pooled) for s, w in own.items()} | {None: frozenset(pooled.union(*own.values()))}


def within_risk(k: int, n: int, risk: float, level: float) -> bool:
    """True if the exact upper bound of k in n at this level is at most ``risk``."""
    if n <= 0 or k >= n or k > risk * n:
        return False
    log_p, log_q = math.log(risk), math.log1p(-risk)
    log_sum = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q for i in range(k + 1)]
    top = max(log_sum)
    return top + math.log(math.fsum(math.exp(x - top) for x in log_sum)) <= math.log(level)


def _tests_made(sizes: list[int], risk: float, delta: float) -> int:
    """The smallest m such that no more than m tests have labels enough to pass at delta / m without a false rejection."""
    return next((m for m in range(1, len(sizes)) if sum(within_risk(0, n, risk, delta / m) for n in sizes) <= m), max(1, len(sizes)))


def choose_cutoffs(holdout: DataFrame, risk: float = RISK, delta: float = DELTA) -> tuple[list[tuple[str, str, float]], list[tuple[str, float, list[str]]]]:
    """holdout(stratum, fitted, quality, toxic, signals) -> (stratum, rule, cutoff), and (rule, cutoff, strata without it) over all labels.

    ``fitted`` marks rows that the word lists may have seen; no good one of them counts for their
    rule. Only counts reach the driver: one row per stratum.
    """
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    sums = []
    for r, cutoffs in RULES.items():
        fine, bad = (good & ~F.col("fitted"), F.col("toxic") == 1) if r == "toxic_words" else (good, F.col("quality") == 0)
        sums.append(F.count_if(fine).alias(f"n_{r}"))
        for i, c in enumerate(cutoffs):
            sums += [F.count_if(fine & (F.col(r) > c)).alias(f"g_{r}_{i}"), F.count_if(bad & (F.col(r) > c)).alias(f"b_{r}_{i}")]
    rows = [row.asDict() for row in holdout.groupBy("stratum").agg(*sums).collect()]
    strata = {row["stratum"]: row for row in rows if row["stratum"] is not None}
    if not rows:
        return [], []
    pool = {name: sum(row[name] for row in rows) for name in rows[0] if name != "stratum"}
    level = delta / _tests_made([row[f"n_{r}"] for row in [*strata.values(), pool] for r in RULES], risk, delta)

    def pick(row: dict, r: str) -> tuple[int, float] | None:
        best = None
        for i, c in enumerate(RULES[r]):
            k = row[f"g_{r}_{i}"]
            if not within_risk(k, row[f"n_{r}"], risk, level):
                break
            gain = row[f"b_{r}_{i}"] - GOOD_COST * k
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, i)
        return best and (best[1], RULES[r][best[1]])

    chosen, shared = [], []
    for r in RULES:
        tested = [s for s, row in strata.items() if within_risk(0, row[f"n_{r}"], risk, level)]
        chosen += [(s, r, best[1]) for s in tested if (best := pick(strata[s], r))]
        if best := pick(pool, r):
            refuted = [s for s, row in strata.items() if row[f"g_{r}_{best[0]}"] > risk * row[f"n_{r}"]]
            shared.append((r, best[1], sorted({*tested, *refuted})))
    return chosen, shared


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """docs(doc_id, text, lang), labels(doc_id, quality, toxic) -> doc_id, the base numbers, the signals, stratum, base_failed, rejected_by, kept, k1, k2.

    ``rejected_by`` names the rules whose cutoff was passed; k1 and k2 are the ``doc_key``.
    """
    labels = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality", "toxic").dropna()
    k1, k2 = doc_key()
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("stratum"), k1.alias("k1"), k2.alias("k2"), F.col("text").cast("string").alias("text"))
    labels = _split(labels)
    lexicons = toxic_lexicons(plain, labels)
    measured = plain.mapInArrow(_measured(4, 1, lexicons), "doc_id bigint, stratum string, k1 bigint, k2 bigint, " + _MEASURE_DDL)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    # numbers only: a few dozen bytes a document, read twice below
    measured = written(measured.withColumn("base_failed", failed), "signals")
    chosen, shared = choose_cutoffs(measured.where("NOT base_failed").join(labels, "doc_id"), risk, delta)
    hits = [F.when((F.col("stratum") == s) & (F.col(r) > c), F.lit(r)) for s, r, c in chosen]
    # a document without stratum, or of one that is not named
    hits += [F.when((F.col("stratum").isNull() | ~F.col("stratum").isin(names)) & (F.col(r) > c), F.lit(r)) for r, c, names in shared]
    rejected = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    return measured.withColumn("rejected_by", rejected).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def keep_quality(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    k1, k2 = doc_key()
    keys = quality_rules(docs, labels, risk, delta).where("kept").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("stratum").alias("__stratum")).distinct()
    same = (k1 == F.col("__k1")) & (k2 == F.col("__k2")) & F.col("lang").cast("string").eqNullSafe(F.col("__stratum"))
    return docs.join(keys, same, "left_semi")
