"""Substring dedup: every fixed-length word window is hashed (Rabin-Karp) and counted in Spark.

A window whose word sequence also starts earlier (smaller document id, or the same document
and an earlier start) is repeated; repeated windows merge into maximal removal intervals.

How it runs
    1. Each task hashes the windows of its documents in chunks of about ``chunk_bytes``.
       A window met again inside the chunk is settled there, so a passage that fills a third
       of the corpus leaves one entry per chunk. What is left travels in packed blocks of one
       bucket each: 56 bits of hash, and document and start as small differences.
    2. A chunk fills only so many buckets with blocks worth their head. Beyond ``direct`` buckets
       (64 GB of text) windows first go to ``COARSE`` parts, each of which is read as a stream, a
       million windows at a time: what repeats among those is settled, the rest is packed
       again by its own bucket. So a passage that is on every document does not swell its
       bucket, and what is shuffled for a byte of text does not grow with the corpus.
    3. Each bucket (a few million windows) is sorted in one task and tells the later starts.
       Bucket and the 56 bits come from two different polynomials, so the number of chance
       matches per bucket stays at 10**-4 or so however many buckets there are.
    4. Repeated starts go back to the documents, both dealt by document in small groups.

Input cases: a null or empty text has no words; a null id sorts before all ids; rows with
equal id and text are one document with one result each; rows with equal id and different
texts are ordered by a checksum of the text; an empty table gives an empty result; other
columns are ignored. A document must fit into the memory of one Python worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import as_bytes, doc_key, pack, parts_for, text_bytes, unpack, window_hashes, word_hashes

_BASE_KEY, _BASE_BUCKET = 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_LOW56 = np.uint64((1 << 56) - 1)

BUCKET_BYTES = 8 << 20
"""Text per hash bucket: over a million windows, sorted in one task."""
GROUP_BYTES = 4 << 20
"""Text per group of documents in the last step."""
CHUNK_BYTES = 5 << 20
"""Text hashed at a time."""

DIRECT_BUCKETS = 8_192
"""Buckets that a chunk is cut into at once; more are reached in two steps."""
COARSE = 4_096
"""Parts of the first of two steps."""
HELD_WINDOWS = 1 << 20
"""Windows that the second step holds at a time."""

_PACKED = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("data", pa.binary())])
_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("kept_text", pa.string()),
        ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)
_RESULT_DDL = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, removed array<struct<start: bigint, end: bigint>>"


def _steps(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by (doc, pos): first row of each doc, rows per doc, positions as differences."""
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    steps = np.diff(pos, prepend=0)
    steps[first] = pos[first]
    return first, np.diff(np.concatenate((first, [len(doc)]))), steps


def _unsteps(count: np.ndarray, steps: np.ndarray) -> np.ndarray:
    total = np.cumsum(steps.astype(np.int64))
    first = np.concatenate(([0], np.cumsum(count.astype(np.int64))[:-1]))
    return total - np.repeat(total[first] - steps[first].astype(np.int64), count)


def _pack_places(k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
    """Arrays that tell the (document, position) rows, which are sorted by document and position."""
    first, count, steps = _steps(doc, pos)
    ids = k1[first]
    return [ids[:1], np.diff(ids), k2[first], count, steps]


def _unpack_places(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    head, ids, k2, count, steps = arrays
    k1 = np.cumsum(np.concatenate((head.astype(np.int64), ids.astype(np.int64))))
    return k1, k2.astype(np.int64), count.astype(np.int64), _unsteps(count, steps)


def _chunk(rows: list[tuple[int, int, bytes]], size: int, buckets: int, coarse: int, groups: int) -> Iterator[tuple[int, int, bytes]]:
    rows = sorted({(k1, k2): text for k1, k2, text in rows}.items())
    k1 = np.array([k[0] for k, _ in rows], dtype=np.int64)
    k2 = np.array([k[1] for k, _ in rows], dtype=np.int64)
    words, counts = word_hashes([text for _, text in rows])
    n = len(words) - size + 1
    if n <= 0:
        return
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), counts)
    pos = np.arange(len(words), dtype=np.int64) - np.repeat(np.cumsum(counts) - counts, counts)
    inside = np.flatnonzero(doc[:n] == doc[size - 1 :])
    if not len(inside):
        return
    key = window_hashes(words, size, _BASE_KEY)[inside]
    bucket = (window_hashes(words, size, _BASE_BUCKET)[inside] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), dtype=bool)
    later[order[1:]] = key[order[1:]] == key[order[:-1]]
    yield from _removals(k1, k2, doc[inside[later]], pos[inside[later]], groups)
    left = np.flatnonzero(~later)
    part = bucket % coarse
    left = left[np.argsort(part[left].astype(np.uint16) if coarse < 1 << 16 else part[left], kind="stable")]
    edges = np.flatnonzero(np.concatenate(([True], part[left[1:]] != part[left[:-1]], [True])))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = left[a:b]
        at = doc[inside[own]]
        fine = [bucket[own] // coarse] if coarse < buckets else []
        yield 0, int(part[own[0]]), pack(_low(key[own]), *fine, *_pack_places(k1[at], k2[at], at, pos[inside[own]]))


def _low(key: np.ndarray) -> np.ndarray:
    """The low 56 bits of each key, as bytes."""
    return key.view(np.uint8).reshape(-1, 8)[:, :7].reshape(-1)


def _wide(low: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(low) // 7, 8), dtype=np.uint8)
    wide[:, :7] = low.reshape(-1, 7)
    return wide.view(np.uint64).reshape(-1)


def _starts(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by document: the first row of each, and the number of the document of each row."""
    new = np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))) if len(k1) else np.zeros(0, dtype=bool)
    return np.flatnonzero(new), np.cumsum(new) - 1


def _first_and_later(key: np.ndarray, k1: np.ndarray, k2: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold the first start of a key, and rows that hold a later one; repeats of a first row are neither."""
    order = np.lexsort((pos, k2, k1, key))
    key, k1, k2, pos = key[order], k1[order], k2[order], pos[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
    of = np.repeat(first, np.diff(np.concatenate((first, [len(key)]))))
    later = (k1 != k1[of]) | (k2 != k2[of]) | (pos != pos[of])
    return order[first], order[later]


def _later_removals(k1: np.ndarray, k2: np.ndarray, pos: np.ndarray, groups: int) -> Iterator[tuple[int, int, bytes]]:
    order = np.lexsort((pos, k2, k1))
    k1, k2, pos = k1[order], k2[order], pos[order]
    head, doc = _starts(k1, k2)
    return _removals(k1[head], k2[head], doc, pos, groups)


def _regroup(blocks: list[tuple[int, list[np.ndarray]]], coarse: int, groups: int) -> Iterator[tuple[int, int, bytes]]:
    """Blocks of coarse parts as removals, for what repeats among them, and blocks of single buckets."""
    keys, buckets, k1s, k2s, poss = [], [], [], [], []
    for part, (low, fine, *places) in blocks:
        k1, k2, count, pos = _unpack_places(places)
        keys.append(_wide(low))
        buckets.append(fine.astype(np.int64) * coarse + part)
        k1s.append(np.repeat(k1, count))
        k2s.append(np.repeat(k2, count))
        poss.append(pos)
    key, bucket, k1, k2, pos = (np.concatenate(x) for x in (keys, buckets, k1s, k2s, poss))
    # windows of other buckets are other windows: some bits of what differs inside a part go above the 56
    full = key ^ ((bucket // coarse).astype(np.uint64) << np.uint64(56))
    first, later = _first_and_later(full, k1, k2, pos)
    yield from _later_removals(k1[later], k2[later], pos[later], groups)
    first = first[np.lexsort((pos[first], k2[first], k1[first], bucket[first]))]
    key, bucket, k1, k2, pos = key[first], bucket[first], k1[first], k2[first], pos[first]
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        _, doc = _starts(k1[a:b], k2[a:b])
        yield 0, int(bucket[a]), pack(_low(key[a:b]), *_pack_places(k1[a:b], k2[a:b], doc, pos[a:b]))


def _refine(coarse: int, groups: int, held_windows: int):
    """The second of two steps, over the stream of blocks of a part; removals pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            passed = batch.filter(pc.equal(batch.column("kind"), 1))
            if passed.num_rows:
                yield passed
            for kind, part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    held.append((part, unpack(data)))
                    count += len(held[-1][1][1])
                    if count >= held_windows:
                        yield _packed_batch(list(_regroup(held, coarse, groups)))
                        held, count = [], 0
        if held:
            yield _packed_batch(list(_regroup(held, coarse, groups)))

    return run


def _removals(k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, pos: np.ndarray, groups: int) -> Iterator[tuple[int, int, bytes]]:
    """Repeated windows, packed by the group of their document. ``doc`` indexes k1 and k2; (doc, pos) is sorted."""
    if not len(doc):
        return
    group = ((k1 ^ k2) % groups)[doc]
    order = np.argsort(group, kind="stable")
    doc, pos, group = doc[order], pos[order], group[order]
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield 1, int(group[a]), pack(*_pack_places(k1[doc[a:b]], k2[doc[a:b]], doc[a:b], pos[a:b]))


def _packed_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds, parts, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(parts, pa.int32()), pa.array(data, pa.binary())], schema=_PACKED)


def _scan(size: int, buckets: int, coarse: int, groups: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                rows.append(row)
                held += len(row[2])
                if held >= chunk_bytes:
                    if out := list(_chunk(rows, size, buckets, coarse, groups)):
                        yield _packed_batch(out)
                    rows, held = [], 0
        if rows and (out := list(_chunk(rows, size, buckets, coarse, groups))):
            yield _packed_batch(out)

    return run


def _settle(groups: int):
    """The windows of one bucket: all but the first start of each sequence are repeated."""

    def run(table: pa.Table) -> pa.Table:
        keys, k1s, k2s, poss = [], [], [], []
        for data in table.column("data").to_pylist():
            low, *places = unpack(data)
            k1, k2, count, pos = _unpack_places(places)
            keys.append(_wide(low))
            k1s.append(np.repeat(k1, count))
            k2s.append(np.repeat(k2, count))
            poss.append(pos)
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        met = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
        k1, k2, pos = (np.concatenate(x)[met] for x in (k1s, k2s, poss))
        _, later = _first_and_later(key[met], k1, k2, pos)
        out = list(_later_removals(k1[later], k2[later], pos[later], groups))
        return pa.Table.from_batches([_packed_batch(out)] if out else [], schema=_PACKED)

    return run


def _rebuild(size: int):
    """One group of documents with its repeated windows: what stays of each text."""

    def run(docs: pa.Table, repeats: pa.Table) -> pa.Table:
        starts: dict[tuple[int, int], list[np.ndarray]] = {}
        for data in repeats.column("data").to_pylist():
            k1, k2, count, pos = _unpack_places(unpack(data))
            ends = np.cumsum(count)
            for a, b, end, n in zip(k1.tolist(), k2.tolist(), ends.tolist(), count.tolist(), strict=True):
                starts.setdefault((a, b), []).append(pos[end - n : end])
        columns: list[list] = [[], [], [], [], []]
        keys = zip(docs.column("k1").to_pylist(), docs.column("k2").to_pylist(), strict=True)
        for key, doc_id, text in zip(keys, docs.column("doc_id").to_pylist(), as_bytes(docs.column("text")), strict=True):
            words, gone, removed = text.split(), 0, []
            kept = words
            if key in starts:
                turns = np.zeros(len(words) + 1, dtype=np.int64)
                at = np.concatenate(starts[key])
                np.add.at(turns, at, 1)
                np.add.at(turns, at + size, -1)
                covered = np.cumsum(turns[:-1]) > 0
                gone = int(covered.sum())
                kept = list(compress(words, ~covered))
                edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0])))).tolist()
                removed = [{"start": a, "end": b} for a, b in zip(edges[0::2], edges[1::2], strict=True)]
            for column, value in zip(columns, (doc_id, len(words), gone, b" ".join(kept).decode(), removed), strict=True):
                column.append(value)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RESULT, strict=True)], schema=_RESULT)

    return run


def substring_dedup(
    docs: DataFrame,
    window: int = 20,
    chunk_bytes: int = CHUNK_BYTES,
    bucket_bytes: int = BUCKET_BYTES,
    group_bytes: int = GROUP_BYTES,
    direct: int = DIRECT_BUCKETS,
    held_windows: int = HELD_WINDOWS,
) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, kept_text, removed.

    ``removed`` holds the maximal intervals [start, end) of word numbers that go; ``kept_text``
    the other words joined by one space.
    """
    size = text_bytes(docs, "text")
    buckets, groups = parts_for(size, bucket_bytes), parts_for(size, group_bytes)
    k1, k2 = doc_key()
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coarse = buckets if buckets <= direct else min(COARSE, direct)
    packed = keyed.select("k1", "k2", "text").mapInArrow(_scan(window, buckets, coarse, groups, chunk_bytes), "kind int, part int, data binary")
    if coarse < buckets:
        packed = packed.repartition(coarse, "kind", "part").mapInArrow(_refine(coarse, groups, held_windows), "kind int, part int, data binary")
    # one scan gives both kinds: blocks of windows to settle, and windows settled on the spot
    settled = packed.groupBy("kind", "part").applyInArrow(_either(groups), "kind int, part int, data binary")
    left = keyed.withColumn("g", F.pmod(F.col("k1").bitwiseXOR(F.col("k2")), F.lit(groups)).cast("int"))
    right = settled.select(F.col("part").alias("g"), "data")
    return left.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(_rebuild(window), _RESULT_DDL)


def _either(groups: int):
    settle = _settle(groups)

    def run(table: pa.Table) -> pa.Table:
        table = table.select(["kind", "part", "data"])
        return settle(table) if table.column("kind")[0].as_py() == 0 else table.cast(_PACKED)

    return run
