"""Shared pieces of the training-data operators: table access, word hashing, packing.

Word hashes and window hashes are polynomial (Rabin-Karp) hashes modulo 2**64, computed for
a whole buffer at once: with ``C`` the running sum of ``value[i] * P**i``, the hash of the
slice ``[a, b)`` is ``(C[b] - C[a]) * P**-a``. ``P`` is odd, hence invertible.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.session import limit_batches, ship_package

NO_ID = -(1 << 63)
"""Stands for a null document id inside the operators: it sorts before every other id."""

SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
"""The word separators of the contracts: ASCII white space, as ``bytes.split()`` takes it."""

_SLICE_BYTES = 1 << 19
_SPACE_TABLE = np.isin(np.arange(256), list(SPACES))
_BYTE_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_KEPT: dict[str, Any] = {}
_CODEC = pa.Codec("zstd", compression_level=1)


KEPT_POWERS = 1 << 17
"""Entries of a power table that a worker keeps; longer ones go after use."""


def prepare(spark: SparkSession) -> None:
    """What every operator's job needs: the package on the executors, and small Arrow batches."""
    ship_package(spark)
    limit_batches(spark)


def keep(name: str, build: Callable[[], Any]) -> Any:
    """What a worker builds once and uses in all its tasks of a job, by name; the newest alone is kept."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = build()
    return _KEPT[name]


def forget() -> None:
    """Lets go of what an earlier job's tasks built; workers outlive jobs, and tasks that need the room call it first."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a column over all rows; sizes the number of buckets, never the work."""
    return int(df.agg(F.sum(F.octet_length(column).cast("bigint"))).first()[0] or 0)


def parts_for(size: int, per_part: int, least: int = 8) -> int:
    return max(least, -(-size // per_part))


def doc_key(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """Two longs that tell the rows of a table apart: the id, and a checksum of the text.

    Rows that agree in both are repeats of one document and get one result.
    """
    return F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)), F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(-1).cast("bigint"))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i below at least n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        have = (both[0], both[1])
        if size <= KEPT_POWERS or base == _WORD_BASE:  # those of bytes are bounded by the slices
            _POWERS[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the low-order structure of polynomial hashes over all bits, in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


def _slices(buf: np.ndarray, sep: np.ndarray):
    """Cut at separators into runs of about ``_SLICE_BYTES``; a longer word stays whole."""
    start, n = 0, len(buf)
    while start < n:
        end = min(start + _SLICE_BYTES, n)
        if end < n:
            cut = np.flatnonzero(sep[start:end])
            if len(cut):
                end = start + int(cut[-1]) + 1
            else:
                rest = np.flatnonzero(sep[end:])
                end = end + int(rest[0]) + 1 if len(rest) else n
        yield start, end
        start = end


def word_hashes(texts: list[bytes], separators: np.ndarray = _SPACE_TABLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text.

    ``separators`` is a table of 256 booleans; the byte 0x20 must be one of them.
    """
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    sep = separators[buf]
    found, starts_of = [], []
    for a, b in _slices(buf, sep):
        inside = ~sep[a:b]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate(([0], edges))
        if len(edges) % 2:
            edges = np.concatenate((edges, [b - a]))
        starts, ends = edges[0::2], edges[1::2]
        if not len(starts):
            continue
        up, down = powers(_WORD_BASE, b - a + 1)
        sums = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[buf[a:b]] * up[: b - a], out=sums[1:])
        found.append(mix((sums[ends] - sums[starts]) * down[starts]))
        starts_of.append(starts + a)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    if not found:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    return np.concatenate(found), np.diff(np.searchsorted(np.concatenate(starts_of), bounds))


def window_hashes(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """Rolling hash of every run of ``size`` consecutive words, text borders ignored."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(base, len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[size:] - sums[:n]) * down[:n])


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as one compressed value, each in its narrowest unsigned type if it has no negatives."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        if len(a) and a.dtype != np.uint8 and a.min() >= 0:
            top = int(a.max())
            for kind in (np.uint8, np.uint16, np.uint32):
                if top <= np.iinfo(kind).max:
                    a = a.astype(kind)
                    break
        raw = a.tobytes()
        small = _CODEC.compress(raw, asbytes=True) if raw else b""
        out.append(struct.pack("<3sqq", a.dtype.str.encode()[:3], len(raw), len(small)))
        out.append(small)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    at, arrays = 1, []
    for _ in range(data[0]):
        kind, size, stored = struct.unpack_from("<3sqq", data, at)
        at += struct.calcsize("<3sqq")
        raw = _CODEC.decompress(data[at : at + stored], decompressed_size=size, asbytes=True) if size else b""
        arrays.append(np.frombuffer(raw, dtype=np.dtype(kind.rstrip(b"\0").decode())))
        at += stored
    return arrays


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def counter_bytes(df: DataFrame, hashes, bits: int, squeeze) -> bytes:
    """2**bits counters over all rows, one byte each: how often a 64-bit hash fell on a counter by its top bits.

    ``hashes(batch)`` yields arrays of hashes; ``squeeze`` maps exact sums to bytes. Each task adds
    up its own and sends compressed blocks of counters; the result has a fixed size.
    """
    blocks = 64
    size = (1 << bits) // blocks

    def count(batches):
        forget()
        counters = None
        for batch in batches:
            for found in hashes(batch):
                if counters is None:
                    counters = np.zeros(1 << bits, dtype=np.uint32)
                np.add.at(counters, (found >> np.uint64(64 - bits)).astype(np.int64), 1)
        if counters is not None:
            packed = [pack(b) for b in counters.reshape(blocks, -1)]
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(blocks), pa.int32()), "data": pa.array(packed, pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        counters = np.zeros(size, dtype=np.uint64)
        for data in table.column("data").to_pylist():
            counters += unpack(data)[0]
        done = squeeze(counters).astype(np.uint8).tobytes()
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "data": pa.array([done], pa.binary())})

    added = df.mapInArrow(count, "block int, data binary").groupBy("block").applyInArrow(total, "block int, data binary")
    found = {block: bytes(data) for block, data in added.collect()}  # 2**bits bytes
    return b"".join(found.get(i, bytes(size)) for i in range(blocks))
