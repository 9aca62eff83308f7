"""From raw documents to token ids: quality rules, line dedup, near-duplicate groups, decontamination, encoding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns the
documents that the next stage reads. ``run`` applies them to the documents table, each result
being written to the shared folder and read again, so a lost executor costs one stage at most.

    quality       documents that the base rules or a certified cutoff reject go
    lines         lines of recurring templates go but for the first; a document that loses its
                  last word goes
    near_dups     of each group of near duplicates (five words, similarity 0.8) the document with the smallest
                  id stays, of rows with one id and text the first
    decontaminate documents that hold benchmark passages by the contamination rule go
    encode        the result: doc_id, n_tokens, ids, and the columns of documents but text

Null and empty texts fail the base rules; a null id is kept as any other; empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.common import doc_key, prepare, read_table
from pagesift.llm.decontaminate import find_contamination
from pagesift.llm.line_templates import drop_recurring_lines
from pagesift.llm.ngram_join import ngram_join
from pagesift.llm.quality_rules import keep_quality
from pagesift.llm.sentencepiece_codec import encode
from pagesift.session import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: The five stages together have no SQL form: exact binomial bounds and the Viterbi search need code.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return keep_quality(docs.select(COLUMNS), read_table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = drop_recurring_lines(docs.select(COLUMNS))
    empty = F.regexp_count("kept_text", F.lit(r"[^\x20\x09-\x0D]")) == 0
    return found.where((F.col("n_dropped") == 0) | ~empty).withColumn("text", F.col("kept_text")).select(COLUMNS)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    members, _ = ngram_join(docs, size=5, num=80, den=100)
    keep = members.where("first").select("k1", "k2").distinct()
    k1, k2 = doc_key()
    kept = docs.withColumns({"k1": k1, "k2": k2}).join(keep, ["k1", "k2"], "left_semi")
    return kept.dropDuplicates(["k1", "k2"]).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return find_contamination(docs, read_table(spark, sf_dir, "benchmark")).where("NOT contaminated").select(COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return encode(docs).select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids")


STAGES = [("quality", quality), ("lines", lines), ("near_dups", near_dups), ("decontaminate", decontaminate), ("encode", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
