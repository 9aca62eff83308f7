"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Documents of equal text are one group. Groups are placed from the largest down, each on the
shard where the dot product of its size vector with the shard's residual capacity is highest.

To place any number of groups with bounded work on the driver, groups that are small against a
shard are first put on pallets by hash, ``PALLETS`` for each shard; a pallet is placed as a
whole and so keeps its groups whole. Groups above ``HEAVY`` of a shard are placed on their own.
Only one that no shard could hold (say, copies that are a third of all rows) goes in parts of about
``PART`` of a shard, dealt by a checksum of the id. What the driver sees is at most
``shards * (PALLETS + 2 / HEAVY)`` sums, whatever the number of rows.

Slots number the rows of a shard without gaps: rows are numbered inside small blocks of each
shard and the blocks' counts give the offsets, so no task sorts a whole shard.

Input cases: null text counts no bytes and no words, and all null texts are one group; a null
id is kept; rows repeated entirely each get a slot of their own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagesift.session import written

PALLETS = 500
"""Pallets per shard."""
HEAVY = 1 / 200
"""Groups of more than this part of a shard's bytes, tokens or rows are placed on their own."""
PART = 1 / 4
"""Groups larger than a shard are placed in parts of about this size."""
ROW_BYTES = 16
"""Bytes that each row counts besides its text."""
BLOCK_ROWS = 50_000
"""Rows that are numbered together."""
WEIGHTS = (1.0, 0.2, 0.2)
"""Weights of bytes, tokens and rows in the dot product; bytes must come out near equal."""


def place(sizes: np.ndarray, shards: int) -> np.ndarray:
    """sizes: one row (bytes, tokens, rows) for each group -> its shard."""
    where = np.zeros(len(sizes), dtype=np.int64)
    if not len(sizes):
        return where
    capacity = np.maximum(sizes.sum(axis=0) / shards, 1e-9)
    parts = sizes / capacity
    residual = np.ones((shards, sizes.shape[1]))
    weights = np.array(WEIGHTS)
    for i in np.lexsort((np.arange(len(sizes)), -parts.max(axis=1))):
        # room in bytes first: a shard that the group would overfill is taken only if all would
        gain = residual @ (weights * parts[i]) - 1e3 * np.maximum(parts[i, 0] - residual[:, 0] - 1e-3, 0)
        where[i] = int(np.argmax(gain))
        residual[where[i]] -= parts[i]
    return where


def _even_out(sizes: np.ndarray, where: np.ndarray, shards: int) -> np.ndarray:
    """Narrow the gap in bytes between the fullest and the emptiest shard, by moving one group or swapping two, while that is possible."""
    size = sizes[:, 0]
    load = np.bincount(where, weights=size, minlength=shards)
    for _ in range(20 * shards):
        full, empty = int(load.argmax()), int(load.argmin())
        gap = load[full] - load[empty]
        giving, taking = np.flatnonzero(where == full), np.flatnonzero(where == empty)
        # the last column stands for getting nothing back
        back = np.concatenate((size[taking], [0.0]))
        shift = size[giving][:, None] - back[None, :]
        off = np.where((shift > 0) & (shift < gap), np.abs(shift - gap / 2), np.inf)
        if not off.size or not np.isfinite(off.min()):
            break
        i, j = divmod(int(off.argmin()), len(back))
        where[giving[i]] = empty
        if j < len(taking):
            where[taking[j]] = full
        load[full] -= shift[i, j]
        load[empty] += shift[i, j]
    return where


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """docs(doc_id, text) -> doc_id, size, text_crc32, n_tokens, shard, slot."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    items = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length(text).cast("bigint"), F.lit(0)) + ROW_BYTES).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"),
        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint"), F.lit(0)).alias("n_tokens"),
        F.xxhash64(text, text.isNull()).alias("h"),
    )
    items = written(items, "items")  # a few numbers a row; the text is read once
    total = [float(x or 0) for x in items.agg(F.sum("size"), F.sum("n_tokens"), F.count("*")).first()]
    share = [max(1.0, x / shards) for x in total]
    sums = [F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")]
    part = F.greatest(*(F.col(c) / F.lit(s) for c, s in zip(("bytes", "tokens", "rows"), share, strict=True)))
    key = ["h", "text_crc32", "size"]
    heavy = items.groupBy(*key).agg(*sums).where(part > HEAVY).select(*key, F.when(part > 1, F.ceil(part / PART)).otherwise(1).cast("int").alias("parts"))
    heavy = written(heavy, "heavy")  # at most 3 * shards / HEAVY rows
    pallet = F.pmod(F.xxhash64("h", "text_crc32", "size"), F.lit(shards * PALLETS)).cast("int")
    piece = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id", "h"), F.col("parts"))).otherwise(0).cast("int")
    keyed = items.join(F.broadcast(heavy), key, "left").withColumns(
        {"pallet": F.when(F.col("parts").isNull(), pallet), "gh": F.when(F.col("parts").isNotNull(), F.xxhash64("h", "text_crc32", "size")), "piece": piece}
    )
    loads = keyed.groupBy("pallet", "gh", "piece").agg(*sums).orderBy("pallet", "gh", "piece").collect()  # bounded, see above
    sizes = np.array([[r["bytes"], r["tokens"], r["rows"]] for r in loads], dtype=float).reshape(-1, 3)
    where = _even_out(sizes, place(sizes, shards), shards)
    rows = [(r["pallet"], r["gh"], r["piece"], int(s)) for r, s in zip(loads, where, strict=True)]
    plan = spark.createDataFrame(rows, "pallet int, gh bigint, piece int, shard int")
    pal = plan.where("pallet IS NOT NULL").select("pallet", F.col("shard").alias("s1"))
    big = plan.where("gh IS NOT NULL").select("gh", "piece", F.col("shard").alias("s2"))
    placed = keyed.join(F.broadcast(pal), "pallet", "left").join(F.broadcast(big), ["gh", "piece"], "left")
    placed = placed.select("doc_id", "size", "text_crc32", "n_tokens", "h", F.coalesce("s1", "s2").alias("shard"))
    blocks = max(1, int(-(-total[2] // (shards * BLOCK_ROWS))))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc_id", "h", "text_crc32"), F.lit(blocks)).cast("int"))
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("shard", "block").orderBy("doc_id", "h", "text_crc32")
    numbered = placed.withColumn("k", F.row_number().over(order) - 1).join(offsets, ["shard", "block"])
    return numbered.select("doc_id", "size", "text_crc32", "n_tokens", "shard", (F.col("offset") + F.col("k")).alias("slot"))
