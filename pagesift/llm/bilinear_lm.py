"""Language-model scores of whole texts: a log-bilinear model trained by noise-contrastive estimation.

A word is predicted from the two before it: their vectors, each weighted by its place, add up to the
vector that is expected, and its products with the output vectors, plus a bias, are the scores. The
``CLASSES`` commonest training words have vectors; all others are one class, inside which a word is as likely as its
smoothed count says. As expected vectors are sums, the normalising sums over all words, for every pair of
context words, are one matrix product, so token probabilities are exactly normalised.

All counts are of all training documents. Words travel as 64-bit hashes: counted with map-side
combine, the ``HEAD`` commonest (chosen by whole frequency bins, never more) are broadcast, and
what other words a text holds meets the counts in a join. A text is read twice, to count and to be turned into classes
of two bytes a token; training and scoring read those.

Training takes every training document once, in ``ROUNDS`` rounds of disjoint documents. In a round each task runs
AdaGrad over its documents from the round's start, and the tasks' models are averaged by tokens.
A model is some 135,000 numbers whatever the corpus; tasks' models are averaged 32 at a time, written between levels.

Input cases: null and empty texts have one token, their end; a null id is not held out, so learned from;
repeated rows count each time and score alike; without training documents every token has probability
one; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import as_bytes, word_hashes
from pagesift.llm.partial_merge import merge_parts
from pagesift.session import written

CLASSES = 2_047
"""Words with vectors; their number squared is what normalising sums take."""
HEAD = 1 << 19
"""Words whose counts are broadcast, at most."""
BINS = 64
"""Frequency bins for each doubling, by which those are chosen."""
DIM, ROUNDS, BATCH, NOISE, RATE = 32, 4, 1_024, 32, 0.3
"""Size of vectors, rounds, tokens of a step, noise words of a step, and AdaGrad's rate in the first round."""
SLICE_BYTES = 1 << 22
TRAIN_TOKENS = 1 << 16
"""Text, and tokens, held at a time."""

_END = np.uint64(0x5EED_0F_A_7E47_E4D1)
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def held_out(folds: int = 7, fold: int = 2) -> Column:
    """True for documents that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts in order, ends included, and how many each text has."""
    words, counts = word_hashes([t.translate(_LOWER) for t in texts])
    return np.insert(words, np.cumsum(counts), _END), counts + 1


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch, so many at a time that they are small, with the number of the first."""
    start, size, texts = 0, 0, []
    for i, text in enumerate(as_bytes(batch.column(column))):
        if texts and size + len(text) > SLICE_BYTES:
            yield start, texts
            start, size, texts = i, 0, []
        texts.append(text)
        size += len(text)
    if texts:
        yield start, texts


def count_words(docs: DataFrame) -> DataFrame:
    """docs(text) -> word (a hash), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _slices(batch, 0):
                words, n = np.unique(token_hashes(texts)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n, pa.int64())], names=["word", "n"])

    return docs.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Counts of the commonest words, sorted by hash; their class, and the sums that probabilities take."""

    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    tokens: int
    types: int
    class_counts: np.ndarray  # of each class; the last stands for all words without one
    rest_types: int

    @property
    def rest(self) -> int:
        return len(self.class_counts) - 1


def vocabulary(words: DataFrame, classes: int = CLASSES, head: int = HEAD) -> Vocabulary:
    """words(word, n), one row a word."""
    bin_of = F.floor(F.log2("n") * BINS).cast("int")
    bins = sorted(words.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("types"), F.sum("n").alias("n")).collect(), reverse=True)  # BINS a doubling
    edge, room = None, head
    for b in bins:
        room -= b["types"]
        if room < 0:
            break
        edge = b["bin"]
    common = words.where(F.lit(False) if edge is None else bin_of >= edge).toArrow()  # at most ``head`` rows
    hashes = common.column("word").to_numpy().astype(np.int64).view(np.uint64)
    counts = common.column("n").to_numpy().astype(np.int64)
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    ranked = np.lexsort((hashes, -counts))[:classes]
    own = np.full(len(hashes), len(ranked), dtype=np.uint16)
    own[ranked] = np.arange(len(ranked))
    tokens, types = sum(b["n"] for b in bins), sum(b["types"] for b in bins)
    class_counts = np.append(counts[ranked], tokens - counts[ranked].sum())
    return Vocabulary(hashes, counts, own, tokens, types, class_counts, types - len(ranked))


_CODES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, known_log double, rest_log double, classes binary, rare array<bigint>"


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """docs(doc_id, held_out, text) -> classes of the tokens, sums of log counts of broadcast words, and the hashes of other words."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        words = np.append(voc.words, np.uint64(0xFFFFFFFFFFFFFFFF))
        logs = np.append(np.log10(voc.counts + 1.0), 0.0)
        classes = np.append(voc.classes, np.uint16(voc.rest))
        for batch in batches:
            for start, texts in _slices(batch, 2):
                hashes, counts = token_hashes(texts)
                at = np.searchsorted(voc.words, hashes)
                known = (words[at] == hashes) & (at < len(voc.words))
                at[~known] = len(voc.words)
                own = classes[at]
                log = logs[at]
                edges = np.concatenate(([0], np.cumsum(counts)))
                firsts = edges[:-1]
                rare_edges = np.concatenate(([0], np.cumsum(~known)))[edges].astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(rare_edges, pa.int32()), pa.array(hashes[~known].view(np.int64)))
                packed = own.astype("<u2")
                arrays = [
                    batch.column(0).slice(start, len(texts)),
                    batch.column(1).slice(start, len(texts)),
                    pa.array(counts, pa.int64()),
                    pa.array(np.add.reduceat(known, firsts, dtype=np.int64)),
                    pa.array(np.add.reduceat(log, firsts)),
                    pa.array(np.add.reduceat(np.where(own == voc.rest, log, 0.0), firsts)),
                    pa.array([packed[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
                    rare,
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _CODES.split(", ")])

    return docs.mapInArrow(run, _CODES)


@dataclass
class Model:
    """Vectors of context words (the last stands before a text), weights of the two places, output vectors, biases."""

    context: np.ndarray
    places: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.context, self.places, self.output, self.bias]

    def pack(self, weight: float) -> bytes:
        return struct.pack("<d", weight) + b"".join(a.astype("<f4").tobytes() for a in self.arrays())

    def unpack(self, data: bytes) -> tuple[float, list[np.ndarray]]:
        """Weight and arrays of a packed model of the same shape."""
        values, at, out = np.frombuffer(data, dtype="<f4", offset=8), 0, []
        for a in self.arrays():
            out.append(values[at : at + a.size].reshape(a.shape))
            at += a.size
        return struct.unpack_from("<d", data)[0], out

    def average(self, packed: list[bytes]) -> bytes:
        total, sums = 0.0, [np.zeros(a.shape) for a in self.arrays()]
        for data in packed:
            weight, arrays = self.unpack(data)
            total += weight
            for s, a in zip(sums, arrays, strict=True):
                s += weight * a
        return Model(*(s / total for s in sums)).pack(total)


def first_model(shares: np.ndarray, dim: int = DIM) -> Model:
    """Small random vectors; biases are the shares' logs, so it begins as good as counts alone."""
    m, random = len(shares), np.random.default_rng(1)
    small = lambda n: random.standard_normal((n, dim)).astype(np.float32) * np.float32(0.1)
    return Model(small(m + 1), np.array([[1.0], [0.5]], dtype=np.float32) * np.ones(dim, dtype=np.float32), small(m), np.log(shares).astype(np.float32))


def contexts(classes: np.ndarray, counts: np.ndarray, outside: int) -> tuple[np.ndarray, np.ndarray]:
    """The word before each, and the one before that; ``outside`` before a text."""
    firsts = np.cumsum(counts) - counts
    before = np.empty_like(classes)
    before[1:] = classes[:-1]
    before[firsts] = outside
    second = np.empty_like(before)
    second[1:] = before[:-1]
    second[firsts] = outside
    return before, second


def _spread(at: np.ndarray, rows: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Sums of rows by where they go."""
    dim = shape[1]
    spots = (at[:, None] * dim + np.arange(dim)).ravel()
    return np.bincount(spots, weights=rows.ravel(), minlength=shape[0] * dim).reshape(shape)


class Trainer:
    """AdaGrad steps of noise-contrastive estimation; noise words are drawn by their share, anew for each step."""

    def __init__(self, model: Model, shares: np.ndarray, rate: float, seed: list[int]):
        self.model = Model(*(a.copy() for a in model.arrays()))
        self.squares = [np.full(a.shape, 1e-2, dtype=np.float32) for a in self.model.arrays()]
        self.shares, self.cumulated, self.rate = shares, np.cumsum(shares), rate
        self.log_noise = np.log(NOISE * shares).astype(np.float32)
        self.random = np.random.default_rng(seed)
        self.tokens = 0

    def step(self, before: np.ndarray, second: np.ndarray, word: np.ndarray) -> None:
        m = self.model
        noise = np.minimum(np.searchsorted(self.cumulated, self.random.random(NOISE) * self.cumulated[-1]), len(self.shares) - 1)
        x1, x2 = m.context[before], m.context[second]
        expected = m.places[0] * x1 + m.places[1] * x2
        true, false = m.output[word], m.output[noise]
        # how far each word is from being told for certain from noise, and each noise word from words
        up = 1.0 / (1.0 + np.exp(np.einsum("ij,ij->i", expected, true) + m.bias[word] - self.log_noise[word]))
        down = -1.0 / (1.0 + np.exp(-(expected @ false.T + (m.bias[noise] - self.log_noise[noise]))))
        pull = up[:, None] * true + down @ false
        output = _spread(word, up[:, None] * expected, m.output.shape)
        np.add.at(output, noise, down.T @ expected)
        bias = np.bincount(word, weights=up, minlength=len(m.bias))
        np.add.at(bias, noise, down.sum(axis=0))
        both = np.concatenate((m.places[0] * pull, m.places[1] * pull))
        context = _spread(np.concatenate((before, second)), both, m.context.shape)
        places = np.stack(((x1 * pull).sum(axis=0), (x2 * pull).sum(axis=0)))
        for value, gradient, square in zip(m.arrays(), (context, places, output, bias), self.squares, strict=True):
            g = (gradient / len(word)).astype(np.float32)
            square += g * g
            value += self.rate * g / np.sqrt(square)
        self.tokens += len(word)

    def take(self, texts: list[np.ndarray]) -> None:
        if not texts:
            return
        word = np.concatenate(texts).astype(np.int64)
        before, second = contexts(word, np.array([len(t) for t in texts]), len(self.shares))
        for a in range(0, len(word), BATCH):
            self.step(before[a : a + BATCH], second[a : a + BATCH], word[a : a + BATCH])


def train(codes: DataFrame, voc: Vocabulary, rounds: int = ROUNDS) -> Model:
    """codes(row, held_out, classes) -> the model after all rounds."""
    shares = (voc.class_counts + 1.0) / (voc.class_counts.sum() + len(voc.class_counts))
    model = first_model(shares)
    learned = codes.where("NOT held_out").withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(rounds)))
    for r in range(rounds):
        shared = codes.sparkSession.sparkContext.broadcast(model)
        rate = RATE / math.sqrt(r + 1)

        def run(batches: Iterator[pa.RecordBatch], r=r, shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            trainer, held, size = None, [], 0
            for batch in batches:
                for row, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    trainer = trainer or Trainer(shared.value, shares, rate, [r, row])
                    held.append(np.frombuffer(data, dtype="<u2"))
                    size += len(held[-1])
                    if size >= TRAIN_TOKENS:
                        trainer.take(held)
                        held, size = [], 0
            if trainer:
                trainer.take(held)
                yield pa.RecordBatch.from_pydict({"data": pa.array([trainer.model.pack(trainer.tokens)], pa.binary())})

        found = merge_parts(learned.where(F.col("slice") == r).select("row", "classes").mapInArrow(run, "data binary"), model.average)
        shared.unpersist()
        if found:
            model = Model(*(a.copy() for a in model.unpack(found)[1]))
    return model


def log_sums(model: Model) -> np.ndarray:
    """Logs of the normalising sums, by the second word before (rows) and the word before (columns)."""
    near = ((model.places[0] * model.context) @ model.output.T).astype(np.float64)
    top_near = near.max(axis=1, keepdims=True)
    near -= top_near
    np.exp(near, out=near)
    out = np.empty((len(near), len(near)), dtype=np.float32)
    for a in range(0, len(out), 256):
        far = ((model.places[1] * model.context[a : a + 256]) @ model.output.T + model.bias).astype(np.float64)
        top_far = far.max(axis=1, keepdims=True)
        sums = np.exp(far - top_far) @ near.T
        out[a : a + 256] = np.log(np.maximum(sums, 1e-300)) + top_far + top_near.T
    return out


class Scorer:
    """Tables from which a token's log probability is three look-ups."""

    def __init__(self, model: Model, sums: np.ndarray):
        self.near = (model.places[0] * model.context) @ model.output.T
        self.far = (model.places[1] * model.context) @ model.output.T + model.bias
        self.sums, self.outside = sums, len(model.bias)

    def log10(self, word: np.ndarray, counts: np.ndarray) -> np.ndarray:
        before, second = contexts(word, counts, self.outside)
        return (self.near[before, word] + self.far[second, word] - self.sums[second, before]).astype(np.float64) / math.log(10.0)


def _class_scores(codes: DataFrame, model: Model) -> DataFrame:
    shared = codes.sparkSession.sparkContext.broadcast((model, log_sums(model)))  # 17 MB
    rest = len(model.bias) - 1
    kept = ["row", "doc_id", "held_out", "n_tokens", "n_known", "known_log", "rest_log"]
    ddl = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, known_log double, rest_log double, n_rest bigint, class_log double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or Scorer(*shared.value)
            found, rests = np.zeros(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64)
            counts, texts = batch.column(3).to_numpy(), batch.column(len(kept)).to_pylist()
            start = 0
            while start < len(texts):  # some tokens at a time, a text at least
                end = max(start + 1, int(np.searchsorted(np.cumsum(counts[start:]), 8 * TRAIN_TOKENS)) + start)
                word = np.frombuffer(b"".join(texts[start:end]), dtype="<u2").astype(np.int64)
                own = counts[start:end]
                firsts = np.cumsum(own) - own
                found[start:end] = np.add.reduceat(scorer.log10(word, own), firsts)
                rests[start:end] = np.add.reduceat(word == rest, firsts, dtype=np.int64)
                start = end
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(rests), pa.array(found)], names=[c.split()[0] for c in ddl.split(", ")])

    return codes.select(*kept, "classes").mapInArrow(run, ddl)


def score_texts(docs: DataFrame, classes: int = CLASSES, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; logs are to base 10."""
    if not 0 < classes < 1 << 15:
        raise ValueError("classes must be 1 to 32767")
    text = F.col("text").cast("string").alias("text")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), text)
    words = written(count_words(docs.where("NOT held_out").select("text")), "words")
    voc = vocabulary(words, classes, head)
    codes = written(encode(docs, voc).withColumn("row", F.monotonically_increasing_id()), "codes")
    model = train(codes, voc, rounds)
    rare = codes.select("row", F.explode("rare").alias("word")).join(words, "word")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("rare_log"), F.count("*").alias("n_rare"))
    found = _class_scores(codes, model).join(rare, "row", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    all_words = math.log10(voc.tokens + voc.types + 1)
    other_words = math.log10(int(voc.class_counts[-1]) + voc.rest_types + 1)
    return found.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(voc.tokens).cast("bigint").alias("train_tokens"),
        (F.col("known_log") + rare_log - F.col("n_tokens") * F.lit(all_words)).alias("base_score"),
        (F.col("class_log") + F.col("rest_log") + rare_log - F.col("n_rest") * F.lit(other_words)).alias("score"),
    )
