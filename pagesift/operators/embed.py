"""Text to vectors: byte-bounded batches through a pluggable embedding function."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift import schemas as S
from pagesift.session import limit_batches

# A loader runs at the start of each task and returns the function that embeds a list of
# texts. What is expensive to load belongs in a cached module function, which lives as
# long as the Python worker and so serves many tasks.
EmbedFn = Callable[[list[str]], np.ndarray]
EmbedLoader = Callable[[], EmbedFn]

_TOKEN = re.compile(r"[^\W_]+")
_CACHE_LIMIT = 100_000
_CACHE_TOKEN = 64
"""Longer tokens are not remembered."""


class _TokenCodes(dict):
    """Token to signed bucket number; bounded in entries and their length, so that a worker's memory stays flat."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim
        self.codes = list(range(2 * dim))  # one object a number, however many tokens have it

    def __missing__(self, token: str) -> int:
        digest = hashlib.md5(token.encode()).hexdigest()
        code = self.codes[int(digest[:8], 16) % self.dim * 2 + int(digest[8], 16) % 2]
        if len(token) <= _CACHE_TOKEN:
            if len(self) >= _CACHE_LIMIT:
                self.clear()
            self[token] = code
        return code


@lru_cache(maxsize=4)
def _codes(dim: int) -> _TokenCodes:
    return _TokenCodes(dim)


@lru_cache(maxsize=2)
def _sentence_model(name: str):
    from sentence_transformers import SentenceTransformer

    return SentenceTransformer(name)


def hash_embedder(dim: int = S.VECTOR_DIM) -> EmbedLoader:
    """Deterministic signed feature hashing; the default model, and one that SQL can restate."""

    def load() -> EmbedFn:
        codes = _codes(dim)

        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for i, text in enumerate(texts):
                found = np.fromiter(map(codes.__getitem__, _TOKEN.findall(text.lower())), dtype=np.int64)
                counts = np.bincount(found, minlength=2 * dim)
                out[i] = counts[0::2] - counts[1::2]
            return out

        return embed

    return load


def sentence_transformer(name: str = "all-MiniLM-L6-v2") -> EmbedLoader:
    """Adapter for a sentence-transformers model, where that package is installed on the executors."""

    def load() -> EmbedFn:
        model = _sentence_model(name)
        return lambda texts: np.asarray(model.encode(texts), dtype=np.float32)

    return load


class ByteBudget:
    """Greedy chunking in input order: chunks of at most ``limit`` bytes, larger texts refused."""

    TOO_BIG, NEXT_CHUNK, SAME_CHUNK = range(3)

    def __init__(self, limit: int):
        self.limit = limit
        self.used = 0
        self.open = False

    def place(self, size: int) -> int:
        if size > self.limit:
            self.used, self.open = 0, False
            return self.TOO_BIG
        if self.open and self.used + size <= self.limit:
            self.used += size
            return self.SAME_CHUNK
        self.used, self.open = size, True
        return self.NEXT_CHUNK


def is_too_big(text: Column, limit: int = S.MAX_CHUNK_BYTES) -> Column:
    return F.octet_length(text) > limit


MAX_CALL_ROWS = 2_048
"""Texts handed to the model at once; a chunk of many short texts takes several calls."""


def embed_texts(
    df: DataFrame,
    keep: list[str],
    text: str,
    loader: EmbedLoader | None = None,
    limit: int = S.MAX_CHUNK_BYTES,
    unit: bool = False,
    old: str | None = None,
) -> DataFrame:
    """``keep`` columns plus ``vector``; a text over the byte limit gets an empty vector.

    Vectors come as the model returns them (floats), or with ``unit`` normalised to
    length one in double precision while they are still packed arrays. With ``old``, the name
    of a vector column, rows with a NULL text pass through with that vector.

    Map-only. Each task walks its rows in order and hands the model chunks of at
    most ``limit`` bytes and calls of at most ``MAX_CALL_ROWS`` texts, so neither a task nor a
    model call ever holds more than that. A chunk the model fails on fails the task. Chunks do
    not cross tasks.
    """
    limit_batches(df.sparkSession)
    loader = loader or hash_embedder()
    src = df.select(*keep, F.col(text).alias("_text"), *([F.col(old).cast("array<double>" if unit else "array<float>").alias("_old")] if old else []))
    cell, arrow_cell, numpy_cell = (T.DoubleType(), pa.float64(), np.float64) if unit else (T.FloatType(), pa.float32(), np.float32)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("vector", T.ArrayType(cell))])
    too_big, passing = -1, -2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed, budget = loader(), ByteBudget(limit)
        rows: list[pa.RecordBatch] = []
        texts: list[str] = []
        places: list[int] = []  # of each row: the number of its text, or how it goes without

        def finish() -> pa.RecordBatch:
            held = pa.Table.from_batches(rows).combine_chunks()
            columns = [held.column(c).combine_chunks() for c in keep]
            flat = np.zeros((0, 0), dtype=numpy_cell)
            if texts:
                flat = np.ascontiguousarray(embed(texts), dtype=numpy_cell)
                if unit:
                    norms = np.linalg.norm(flat, axis=1, keepdims=True)
                    flat = flat / np.where(norms > 0, norms, 1.0)
            if len(texts) == len(places):
                offsets = np.arange(len(places) + 1, dtype=np.int32) * flat.shape[1]
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))
            else:
                before = held.column("_old").to_pylist() if old else [None] * len(places)
                column = pa.array([flat[p] if p >= 0 else [] if p == too_big else v for p, v in zip(places, before, strict=True)], pa.list_(arrow_cell))
            rows.clear()
            texts.clear()
            places.clear()
            return pa.RecordBatch.from_arrays([*columns, column], names=[*keep, "vector"])

        for batch in batches:
            start = 0  # rows before it are in ``rows`` or gone
            for i, value in enumerate(batch.column("_text").to_pylist()):
                verdict = ByteBudget.SAME_CHUNK
                if value is not None or not old:
                    verdict = budget.place(len((value or "").encode()))
                if places and (verdict != ByteBudget.SAME_CHUNK or len(places) >= MAX_CALL_ROWS):
                    if i > start:
                        rows.append(batch.slice(start, i - start))
                    start = i
                    yield finish()
                if value is None and old:
                    places.append(passing)
                elif verdict == ByteBudget.TOO_BIG:
                    places.append(too_big)
                else:
                    places.append(len(texts))
                    texts.append(value or "")
            if batch.num_rows > start:
                rows.append(batch.slice(start))
        if places:
            yield finish()

    return src.mapInArrow(run, schema)


def assign_chunks(sized: DataFrame, group: str, order: str, size: str, limit: int = S.MAX_CHUNK_BYTES) -> DataFrame:
    """Chunk number of every text within its group, -1 for texts over the limit.

    ``sized(group, order, size)`` carries sizes only, never texts. The walk is
    sequential inside a group, so keep groups to a fixed number of rows.
    """

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        budget, chunk, out = ByteBudget(limit), -1, []
        for n in pdf[size]:
            verdict = budget.place(int(n))
            chunk += verdict == ByteBudget.NEXT_CHUNK
            out.append(-1 if verdict == ByteBudget.TOO_BIG else chunk)
        return pdf.assign(chunk=np.array(out, dtype="int64"))

    narrow = sized.select(group, order, size)
    schema = T.StructType([*narrow.schema.fields, T.StructField("chunk", T.LongType())])
    return narrow.groupBy(group).applyInPandas(number, schema)
