"""Merging what tasks send, one value each, without ever gathering all of them in one place."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.session import written

FAN_IN = 32
"""Values that are merged together at a time."""


def merge_parts(parts: DataFrame, merge: Callable[[list[bytes]], bytes]) -> bytes | None:
    """parts(data binary), one row a task -> all of them merged; None without rows.

    Each level merges groups of ``FAN_IN`` in tasks and is written to the shared folder; the
    last one is merged by the driver, which so gets at most ``FAN_IN`` values.
    """
    level = written(parts.select("data").withColumn("part", F.monotonically_increasing_id()), "parts")
    count = level.count()

    def merged(table: pa.Table) -> pa.Table:
        return pa.table({"data": pa.array([merge([bytes(x) for x in table.column("data").to_pylist()])], pa.binary())})

    while count > FAN_IN:
        groups = -(-count // FAN_IN)
        numbered = level.select("data", F.pmod(F.xxhash64("part"), F.lit(groups)).alias("g"))
        level = written(numbered.groupBy("g").applyInArrow(merged, "data binary").withColumn("part", F.monotonically_increasing_id()), "parts")
        count = level.count()
    # in the order of their tasks, so that rounding is the same each time
    found = [bytes(r["data"]) for r in level.orderBy("part").collect()]
    return merge(found) if found else None
