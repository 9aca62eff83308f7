"""Line dedup with a log-template tree of fixed depth.

Lines are parsed as log messages are. A line goes down the tree by its number of words and its
first ``DEPTH`` words, words with a digit counting as the variable ``<*>``. In the leaf that it
reaches, variable fields are generalised: a word stays constant at its place if enough lines
documents of the leaf have that word there, else the place becomes variable too. Lines with the same
constants at the same places share a template, provided that at least ``SIMILARITY`` of the places
are constant; a ``<*>`` never is. A template of ``min_docs`` documents or more recurs: its first line (smallest
document, then line) stays, every other one is dropped. All counts, of leaves, places and
templates, are of distinct documents, so no document makes a template recur alone, however many of its lines
are alike.

The generalisation is by counts and so does not depend on the order of lines, and no leaf is
gathered anywhere: documents are made distinct by leaf, place or template and document, and then counted.
Lines in leaves of fewer than ``min_docs`` documents, nearly all of prose, leave the job at once:
a fixed number of counters, filled over all documents, tells most of them in the
scan (never a line that could recur), exact counts the rest.

Input cases: null text stays null and has no lines; empty and blank lines are never dropped;
rows with equal id and text are one document and treated alike; a null id sorts before all; a line
that repeats inside one document counts once for it; empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import as_bytes, counter_bytes, doc_key, forget, word_hashes
from pagesift.session import written

MIN_DOCS = 10
DEPTH = 3
SIMILARITY = 0.5
COUNTER_BITS = 22

_VARIABLE = re.compile(rb"[^ ]*[0-9][^ ]*")
_VARIABLE_HASH = int(word_hashes([b"<*>"])[0].view(np.int64)[0])


def masked(line: bytes) -> bytes:
    """Words joined by one space, those with a digit as ``<*>``."""
    plain = b" ".join(line.split())
    return _VARIABLE.sub(b"<*>", plain)


def _number(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


def _leaf(line: bytes, depth: int) -> int:
    words = line.split(b" ", depth)
    return _number(b"%d " % (line.count(b" ") + 1) + b" ".join(words[:depth]))


def _forms(text: bytes) -> dict[bytes, list[int]]:
    """Masked lines with a word, each with its line numbers."""
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate(text.split(b"\n")):
        if form := masked(line):
            found.setdefault(form, []).append(i)
    return found


def _leaves(depth: int):
    def run(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for text in as_bytes(batch.column(0)):
            # each leaf once, as the exact counts have it, so no leaf that passes those is lost here
            leaves = {_leaf(form, depth) for form in _forms(text)}
            yield np.fromiter(leaves, dtype=np.int64, count=len(leaves)).view(np.uint64)

    return run


def _candidates(shared, depth: int, min_docs: int):
    """One row for each document and distinct masked line whose leaf may recur."""
    schema = pa.schema([("leaf", pa.int64()), ("form", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("lines", pa.list_(pa.int32())), ("words", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        counters = np.frombuffer(shared.value, dtype=np.uint8)
        shift = 64 - COUNTER_BITS
        for batch in batches:
            leaves, forms, k1s, k2s, places, texts = [], [], [], [], [], []
            for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                for form, at in _forms(text).items():
                    leaf = _leaf(form, depth)
                    if counters[(leaf & 0xFFFFFFFFFFFFFFFF) >> shift] >= min_docs:
                        leaves.append(leaf)
                        forms.append(_number(form))
                        k1s.append(k1)
                        k2s.append(k2)
                        places.append(at)
                        texts.append(form)
            if leaves:
                words, counts = word_hashes(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(words.view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), pa.array(forms, pa.int64()), pa.array(k1s, pa.int64()), pa.array(k2s, pa.int64()), pa.array(places, pa.list_(pa.int32())), lists], schema=schema)

    return run


def _dropped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, gone, texts = [], [], []
        for text, drops in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            lines = [] if text is None else text.split("\n")
            counts.append(len(lines))
            gone.append(len(drops or ()))
            if drops:
                out = set(drops)
                text = "\n".join(x for i, x in enumerate(lines) if i not in out)
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], names=["row", "n_lines", "n_dropped", "kept_text"])


def templates(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """keyed docs(k1, k2, text) -> lines of possible templates (leaf, form, k1, k2, lines), and form -> template, first, docs."""
    if not 1 <= min_docs <= 255:
        raise ValueError("min_docs must be 1 to 255")
    counters = counter_bytes(docs.select("text"), _leaves(depth), COUNTER_BITS, lambda n: np.minimum(n, 255))
    shared = docs.sparkSession.sparkContext.broadcast(counters)
    ddl = "leaf bigint, form bigint, k1 bigint, k2 bigint, lines array<int>, words array<bigint>"
    lines = written(docs.select("k1", "k2", "text").mapInArrow(_candidates(shared, depth, min_docs), ddl), "lines")
    doc = ["k1", "k2"]

    def in_enough(rows: DataFrame, *key: str) -> DataFrame:
        """The keys that ``min_docs`` documents or more have, with the number of these."""
        return rows.select(*key, *doc).distinct().groupBy(*key).agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)

    lines = written(lines.join(in_enough(lines, "leaf").select("leaf"), "leaf"), "lines")
    first = F.min(F.struct(*doc, F.array_min("lines").alias("line")))
    forms = lines.groupBy("leaf", "form").agg(first.alias("first"), F.first("words").alias("words"))
    # the first words are the path to the leaf and constant there
    later = (F.col("place") >= depth) & (F.col("word") != _VARIABLE_HASH)
    words = F.posexplode("words").alias("place", "word")
    constant = in_enough(lines.select("leaf", *doc, words).where(later), "leaf", "place", "word").drop("docs")
    places = forms.select("leaf", "form", words).where(later).join(constant, ["leaf", "place", "word"])
    kept = places.groupBy("leaf", "form").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("constants"))  # as long as one line
    path = F.size(F.filter(F.slice("words", 1, depth), lambda w: w != _VARIABLE_HASH)).alias("path")
    shaped = forms.select("leaf", "form", "first", F.size("words").alias("size"), path).join(kept, ["leaf", "form"], "left")
    same = F.col("path") + F.when(F.col("constants").isNull(), 0).otherwise(F.size("constants"))
    shaped = shaped.where(same >= F.lit(similarity) * F.col("size")).withColumn("template", F.xxhash64("leaf", "constants"))
    shaped = written(shaped.select("leaf", "form", "template", "first"), "shaped")
    found = in_enough(lines.join(shaped.drop("first"), ["leaf", "form"]), "template")
    firsts = shaped.groupBy("template").agg(F.min("first").alias("first"))
    return lines.drop("words"), shaped.drop("first").join(found.join(firsts, "template"), "template")


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, similarity: float = SIMILARITY) -> DataFrame:
    """docs(doc_id, text, …) -> its columns but text, and n_lines, n_dropped, kept_text."""
    k1, k2 = doc_key()
    keyed = docs.withColumns({"k1": k1, "k2": k2, "text": F.col("text").cast("string")})
    lines, recurring = templates(keyed.select("k1", "k2", "text"), min_docs, depth, similarity)
    met = lines.join(recurring.select("leaf", "form", "first"), ["leaf", "form"])
    line = F.explode("lines").alias("line")
    all_lines = met.select("k1", "k2", "first", line)
    stays = (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2")) & (F.col("line") == F.col("first.line"))
    drops = all_lines.where(~stays).groupBy("k1", "k2").agg(F.collect_set("line").alias("drops"))  # lines of one document
    kept = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped", "kept_text")]
    row = keyed.select("k1", "k2", F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), "text")
    joined = row.join(drops, ["k1", "k2"], "left").select("row", "text", "drops")
    ddl = f"row {joined.schema['row'].dataType.simpleString()}, n_lines bigint, n_dropped bigint, kept_text string"
    return joined.mapInArrow(_dropped, ddl).select("row.*", "n_lines", "n_dropped", "kept_text")
