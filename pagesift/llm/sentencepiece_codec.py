"""SentencePiece encoding by a single-pass Viterbi over an Aho-Corasick automaton, and decoding.

The automaton runs once over a segment. At each position its output links give every piece that
ends there; each relaxes the best score of that position from the best score where the piece
starts. Scores are those of the vocabulary file; the segmentation with the largest sum wins, on
ties the one whose last piece is longer. A character that no piece covers falls back to its UTF-8
bytes at a score below every piece. Pieces whose score is a mere placeholder (below -1e8, runs of
separators) count as that if they are one character, and are not used otherwise. The vocabulary
is read, never trained.

Spaces become the separator U+2581, with one in front of the text. No usable piece has a
separator after its first character, nor a line break, so text is cut into segments there without
changing the result; segments met before are looked up. Decoding gives back the exact text: a
U+2581 of the text itself is always encoded by its bytes.

Input cases: null text has null ids and decodes to null; empty text has no ids; repeated rows
are encoded alike; empty tables give empty results; other columns are carried along.
"""

from __future__ import annotations

import math
import uuid
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift.llm.common import keep

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEPARATOR = "▁"
CACHE_BYTES = 64 << 20
"""About how much a worker remembers of segments of either kind; when full the memory is emptied. Results do not depend on it."""
CACHE_SEGMENT = 64
"""Longer segments are not remembered."""
_ENTRY_BYTES = 160

_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_UNUSABLE = -1e8


def read_pieces(path: str = MODEL) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id, from a model file that the driver can read."""
    from sentencepiece import sentencepiece_model_pb2 as formats

    model = formats.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return [(p.piece, p.score, p.type) for p in model.pieces]


class Codec:
    """Encoder and decoder of one vocabulary; built once in each Python worker."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        self.scores: dict[str, tuple[int, float, int]] = {}
        for i, (piece, score, kind) in enumerate(pieces):
            if kind == _BYTE:
                value = int(piece[1:-1], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif kind == _NORMAL:
                self.bytes_of.append(piece.replace(SEPARATOR, " ").encode())
                self.scores[piece] = (len(piece), score, i)
            else:
                self.bytes_of.append(b"")
        usable = [s for _, s, _ in self.scores.values() if s > _UNUSABLE]
        self.fallback = min(usable, default=0.0) - 10.0
        # some pieces carry a placeholder for a score: those of one character count as its bytes do, longer ones go
        self.scores = {p: (n, max(s, self.fallback), i) for p, (n, s, i) in self.scores.items() if s > _UNUSABLE or n == 1}
        self.singles = frozenset(p for p in self.scores if len(p) == 1)
        self.cuts = not any(SEPARATOR in p[1:] or "\n" in p for p in self.scores)
        self.automaton = ahocorasick.Automaton()
        for piece, value in self.scores.items():
            self.automaton.add_word(piece, value)
        self.automaton.make_automaton()
        self.line_break = self._ids_of_bytes(b"\n")
        self.spaced: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.room = {id(self.spaced): CACHE_BYTES, id(self.bare): CACHE_BYTES}

    def _ids_of_bytes(self, raw: bytes) -> bytes:
        return np.array([self.byte_ids[b] for b in raw], dtype=np.int32).tobytes()

    def segment(self, text: str, literal_from: int) -> list[int]:
        """Ids of one segment; separators at ``literal_from`` or later are characters of the text, not spaces."""
        n = len(text)
        if self.singles.issuperset(text) and text.find(SEPARATOR, literal_from) < 0:
            return self._covered(text, n)
        best = [0.0] * (n + 1)
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)  # length of the last piece and its id, -1 for bytes
        done = 0  # best[0..done] are final but for pieces that end at ``done``
        fallback = self.fallback
        literal = text.find(SEPARATOR, literal_from) >= 0
        for end, (size, score, piece) in self.automaton.iter(text) if self.scores else ():
            at = end + 1
            while done < at:
                done += 1
                best[done] = best[done - 1] + fallback
                back[done] = (1, -1)
            start = at - size
            if literal and text.find(SEPARATOR, max(start, literal_from), at) >= 0:
                continue
            total = best[start] + score
            if total > best[at] or total == best[at] and (size > back[at][0] or back[at][1] < 0):
                best[at] = total
                back[at] = (size, piece)
        while done < n:
            done += 1
            best[done] = best[done - 1] + fallback
            back[done] = (1, -1)
        ids: list[int] = []
        at = n
        while at:
            size, piece = back[at]
            at -= size
            if piece >= 0:
                ids.append(piece)
            else:
                char = " " if text[at] == SEPARATOR and at < literal_from else text[at]
                ids.extend(self.byte_ids[b] for b in reversed(char.encode()))
        ids.reverse()
        return ids

    def _covered(self, text: str, n: int) -> list[int]:
        """The same where each character is a piece: bytes never win, so they need not be weighed."""
        best = [0.0] + [-math.inf] * n
        back = [(0, 0)] * (n + 1)
        for end, (size, score, piece) in self.automaton.iter(text):  # the longest of an end comes first and wins ties
            at = end + 1
            total = best[at - size] + score
            if total > best[at]:
                best[at] = total
                back[at] = (size, piece)
        ids: list[int] = []
        at = n
        while at:
            size, piece = back[at]
            ids.append(piece)
            at -= size
        ids.reverse()
        return ids

    def _encode_bare(self, word: str) -> bytes:
        """A segment without a space in front."""
        return array("i", self.segment(word, 0)).tobytes()

    def _encode_spaced(self, word: str) -> bytes:
        return array("i", self.segment(SEPARATOR + word, 1)).tobytes()

    def _lookup(self, memory: dict[str, bytes], word: str, encode) -> bytes:
        ids = memory.get(word)
        if ids is None:
            ids = encode(word)
            if len(word) <= CACHE_SEGMENT:
                self.room[id(memory)] -= _ENTRY_BYTES + len(word) + len(ids)
                if self.room[id(memory)] < 0:
                    memory.clear()
                    self.room[id(memory)] = CACHE_BYTES
                memory[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int32)
        if not self.cuts:
            literal = self._ids_of_bytes(SEPARATOR.encode())
            parts = [p.replace(" ", SEPARATOR) for p in text.split(SEPARATOR)]
            parts[0] = SEPARATOR + parts[0]
            return np.frombuffer(literal.join(np.array(self.segment(p, len(p)), dtype=np.int32).tobytes() for p in parts), dtype=np.int32)
        out: list[bytes] = []
        spaced, lookup = self.spaced, self._lookup
        for i, line in enumerate(text.split("\n")):
            words = line.split(" ")
            first = words[0]
            if i:
                out.append(self.line_break)
                if first:
                    out.append(lookup(self.bare, first, self._encode_bare))
                words = words[1:]
            found = list(map(spaced.get, words))
            if None in found:
                for k, ids in enumerate(found):
                    if ids is None:
                        found[k] = lookup(spaced, words[k], self._encode_spaced)
            out += found
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def decode(self, ids) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw.decode("utf-8", "replace").removeprefix(" ")


def _codec(shared) -> Codec:
    """The worker's codec of a broadcast vocabulary."""
    return keep(shared.id, lambda: Codec(shared.value))


class _Shared:
    """A broadcast value with a name of its own, by which workers remember what was built from it."""

    def __init__(self, spark: SparkSession, value):
        self.broadcast = spark.sparkContext.broadcast(value)
        self.id = uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def _lists(rows: list[np.ndarray | None]) -> pa.ListArray:
    lengths = np.array([0 if r is None else len(r) for r in rows], dtype=np.int64)
    offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32), pa.int32())
    values = np.concatenate(rows_) if (rows_ := [r for r in rows if r is not None]) else np.zeros(0, dtype=np.int32)
    mask = pa.array([r is None for r in rows], pa.bool_())
    return pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()), mask=mask)


def encode(docs: DataFrame, pieces: list[tuple[str, float, int]] | None = None, check: bool = False) -> DataFrame:
    """docs(text, …) -> its columns without text, ids, n_tokens; with ``check`` also round_trip: does decoding give the text back?"""
    shared = _Shared(docs.sparkSession, pieces if pieces is not None else read_pieces())
    kept = [c for c in docs.columns if c not in ("text", "ids", "n_tokens", "round_trip")]
    source = docs.select(*(F.col(f"`{c}`") for c in kept), F.col("text").cast("string").alias("text"))
    at = len(kept)
    schema = T.StructType(source.schema.fields[:at]).add("ids", T.ArrayType(T.IntegerType())).add("n_tokens", T.LongType())
    if check:
        schema = schema.add("round_trip", T.BooleanType())
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                texts = batch.column(at).to_pylist()
                ids = [None if t is None else codec.encode(t) for t in texts]
                arrays = [*batch.columns[:at], _lists(ids), pa.array([0 if i is None else len(i) for i in ids], pa.int64())]
                if check:
                    arrays.append(pa.array([t is None or codec.decode(i.tolist()) == t for t, i in zip(texts, ids, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(run, schema)


def decode(tokens: DataFrame, pieces: list[tuple[str, float, int]] | None = None) -> DataFrame:
    """tokens(ids, …) -> its columns without ids, text."""
    shared = _Shared(tokens.sparkSession, pieces if pieces is not None else read_pieces())
    kept = [c for c in tokens.columns if c not in ("text", "ids")]
    source = tokens.select(*(F.col(f"`{c}`") for c in kept), F.col("ids").cast("array<int>").alias("ids"))
    at = len(kept)
    schema = T.StructType(source.schema.fields[:at]).add("text", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            texts = [None if i is None else codec.decode(i) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)
