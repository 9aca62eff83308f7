"""Operational analytics over event logs: rates, histograms, gauges, deltas, concurrency.

Ordered computations (deltas, running sums) are cut into slices of about equally many rows, at
points sampled from (label, time, tie), so that one label or one second holding most of the log is
still spread over many tasks; slices are stitched together through one small summary row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesift.session import written

# Default latency bounds in seconds; the last bucket is open.
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
WINDOW_SECONDS = 300


def _start(ts: str, seconds: int) -> Column:
    return F.window(ts, f"{seconds} seconds")["start"].alias("window_start")


def rates(events: DataFrame, label: str, ts: str = "ts", value: str | None = None, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Per-second rate of events (or of ``sum(value)``) by label over tumbling windows."""
    amount = F.count("*") if value is None else F.sum(value)
    grouped = events.groupBy(_start(ts, seconds), F.col(label).alias("label"))
    return grouped.agg((amount.cast("double") / seconds).alias("rate"))


def sliding_rates(
    events: DataFrame, label: str, ts: str = "ts", seconds: int = WINDOW_SECONDS, slide: int = 60
) -> DataFrame:
    """Per-second rate by label over sliding windows.

    Events are first counted per slide step, then the counts (not the events) are
    copied into the overlapping windows.
    """
    steps = events.groupBy(_start(ts, slide), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    spread = steps.select(F.window("window_start", f"{seconds} seconds", f"{slide} seconds")["start"].alias("window_start"), "label", "n")
    return spread.groupBy("window_start", "label").agg((F.sum("n").cast("double") / seconds).alias("rate"))


def bucket_counts(
    events: DataFrame, keys: list[str], value: Column, bounds: list[float] | None = None
) -> DataFrame:
    """Cumulative histogram: ``(keys…, le, n)`` with ``le`` = +Inf for the open bucket.

    One conditional count per bound in a single aggregation; only the finished
    counts are turned into rows.
    """
    bounds = LATENCY_BOUNDS if bounds is None else bounds
    counts = [F.count_if(value <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    wide = events.groupBy(keys).agg(*counts, F.count(value).alias("_binf"))
    cells = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit(float("inf")).alias("le"), F.col("_binf").alias("n")))
    return wide.select(*keys, F.explode(F.array(cells)).alias("cell")).select(*keys, "cell.le", "cell.n")


def bucket_quantiles(buckets: DataFrame, keys: list[str], quantiles: list[float]) -> DataFrame:
    """Quantiles estimated from cumulative buckets by linear interpolation.

    The first bucket at or above the wanted rank is interpolated from the previous
    bound (0 for the first); the open bucket answers with the last finite bound.
    """
    cells = F.array_sort(F.collect_list(F.struct("le", "n"))).alias("cells")
    grouped = buckets.groupBy(keys).agg(cells, F.max("n").alias("total"))
    asked = grouped.where("total > 0").select(
        *keys, "cells", "total", F.explode(F.array([F.lit(q) for q in quantiles])).alias("q")
    )
    rank = F.col("q") * F.col("total")
    hit = F.element_at(F.filter("cells", lambda c: c["n"] >= rank), 1)
    below = F.filter("cells", lambda c: c["n"] < rank)
    last_below = F.try_element_at(below, F.lit(-1))
    located = asked.select(
        *keys,
        "q",
        rank.alias("rank"),
        hit["le"].alias("hi"),
        hit["n"].alias("hi_n"),
        F.coalesce(last_below["le"], F.lit(0.0)).alias("lo"),
        F.coalesce(last_below["n"], F.lit(0)).alias("lo_n"),
    )
    inside = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("rank") - F.col("lo_n")) / (F.col("hi_n") - F.col("lo_n"))
    return located.select(*keys, "q", F.when(F.col("hi") == float("inf"), F.col("lo")).otherwise(inside).alias("value"))


def ratio_of_counts(events: DataFrame, keys: list[Column], numerator: Column, denominator: Column) -> DataFrame:
    """Ratio of two conditional counts per key; NULL where the denominator is zero."""
    return events.groupBy(keys).agg(F.try_divide(F.count_if(numerator), F.count_if(denominator)).alias("ratio"))


def ratio_of_sums(events: DataFrame, keys: list[Column], numerator: Column, denominator: Column) -> DataFrame:
    return events.groupBy(keys).agg(F.try_divide(F.sum(numerator).cast("double"), F.sum(denominator)).alias("ratio"))


SLICE_ROWS = 200_000
"""Rows of a slice, about."""
MAX_SLICES = 4_096
"""A longer log has longer slices; this many keep a large cluster busy."""
SAMPLE_ROWS = 50
"""Sampled rows for each slice, from which the cut points come."""


def _cuts(keyed: DataFrame, slice_rows: int) -> tuple[DataFrame | None, int]:
    """Cut points of about equally many rows as a table of one row, and how many slices there are.

    They are keys (label, time, tie) of a sample: a burst in one second is cut between its ties. The
    table is written, so that whoever looks a row up finds the same slice.
    """
    n = keyed.count()
    slices = min(MAX_SLICES, -(-n // slice_rows))
    if slices <= 1:
        return None, 1
    share = min(1.0, SAMPLE_ROWS * slices / n)
    found = keyed.sample(share, seed=11).agg(F.array_sort(F.collect_list("_key")).alias("keys"))  # SAMPLE_ROWS * MAX_SLICES keys at most, about
    step = F.greatest(F.lit(1), F.floor(F.size("keys") / slices).cast("int"))
    return written(found.select(F.filter("keys", lambda _, i: (i > 0) & (i % step == 0)).alias("cuts")), "cuts"), slices


def _sliced(rows: DataFrame, order: tuple[str, str], label: str | None, slice_rows: int) -> tuple[DataFrame, int]:
    """With ``_label``, which is never NULL, and ``_slice``: how many cut points lie at or before the row. Also how many slices there are.

    A missing label or time is a key like any other. Plain equality of such keys lets a window and a
    join on them share one shuffle. Looking up is a binary search, a column a step.
    """
    ts, tie = order
    rows = rows.withColumn("_label", F.struct(label) if label else F.struct(F.lit(0).alias("all")))
    key = F.struct(F.col("_label"), F.col(ts).alias("at"), F.col(tie).alias("tie"))
    cuts, slices = _cuts(rows.select(key.alias("_key")), slice_rows)
    if cuts is None:
        return rows.withColumn("_slice", F.lit(0)), slices
    points = cuts.scalar()
    rows = rows.withColumn("_slice", F.lit(0))
    for step in (1 << b for b in range((2 * slices).bit_length(), -1, -1)):
        at = F.col("_slice")
        there = (at + step <= F.size(points)) & (key >= F.get(points, at + (step - 1)))
        rows = rows.withColumn("_slice", at + F.when(there, step).otherwise(0))
    return rows, slices


def _keyed(rows: DataFrame, order: tuple[str, str], label: str | None, slice_rows: int) -> DataFrame:
    return _sliced(rows, order, label, slice_rows)[0]


def counter_deltas(
    snapshots: DataFrame, label: str, value: str = "total", order: tuple[str, str] = ("ts", "event_id"), slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Increase of a cumulative counter since its previous snapshot, per label.

    The first snapshot counts in full. Lags are taken inside (label, slice);
    the first row of a slice continues from the last row of the slice before it. Slices hold
    about ``slice_rows`` rows, however these are spread over labels and time.
    """
    ts, tie = order
    sliced = _keyed(snapshots, order, label, slice_rows)
    within = Window.partitionBy("_label", "_slice").orderBy(ts, tie)
    ends = sliced.groupBy("_label", "_slice").agg(F.max(F.struct(ts, tie, value))[value].alias("_end"))
    carried = ends.withColumn("_carry", F.lag("_end", 1, 0.0).over(Window.partitionBy("_label").orderBy("_slice")))
    before = sliced.withColumn("_prev", F.lag(value).over(within))
    joined = before.join(carried.select("_label", "_slice", "_carry"), ["_label", "_slice"])
    delta = F.col(value) - F.coalesce("_prev", "_carry")
    return joined.select(*snapshots.columns, delta.alias("delta"))


def running_totals(
    events: DataFrame,
    amount: Column,
    label: str | None = None,
    order: tuple[str, str] = ("ts", "event_id"),
    slice_rows: int = SLICE_ROWS,
    name: str = "total",
) -> DataFrame:
    """Running sum of ``amount`` in time order, per label or over the whole log.

    Sums run inside slices of about ``slice_rows`` rows, whose totals give the offsets. Rows of
    one label, time and tie cannot be told apart and stay together.
    """
    ts, tie = order
    sliced, slices = _sliced(events.withColumn("_amount", amount), order, label, slice_rows)
    within = Window.partitionBy("_label", "_slice").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    sums = sliced.groupBy("_label", "_slice").agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy("_label").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_label", "_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    local = sliced.withColumn("_local", F.sum("_amount").over(within))
    if slices == 1:  # nothing to stitch; without a label the join would have no key either
        nothing = F.lit(0).cast(offsets.schema["_offset"].dataType)
        return local.select(*events.columns, (F.col("_local") + nothing).alias(name))
    joined = local.join(offsets, ["_label", "_slice"])
    return joined.select(*events.columns, (F.col("_local") + F.col("_offset")).alias(name))


def latest_gauge(events: DataFrame, label: str, value: str = "value", order: tuple[str, str] = ("ts", "event_id")) -> DataFrame:
    """Latest value per label."""
    ts, tie = order
    newest = F.max(F.struct(ts, tie, value))
    return events.groupBy(F.col(label).alias("label")).agg(newest[value].alias("value"), newest[ts].alias("ts"))


def counter_totals(events: DataFrame, label: str, value: str = "value") -> DataFrame:
    return events.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def concurrency(intervals: DataFrame, start: str = "start_ts", end: str = "end_ts", id_col: str = "event_id", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Active intervals after each start or end: ``(ts, id, change, active)``; ends come first on ties."""
    marks = intervals.select(
        F.col(id_col),
        F.explode(
            F.array(
                F.struct(F.col(start).alias("ts"), F.lit(1).alias("change")),
                F.struct(F.col(end).alias("ts"), F.lit(-1).alias("change")),
            )
        ).alias("mark"),
    ).select(F.col("mark.ts").alias("ts"), F.col("mark.change").alias("change"), F.struct("mark.change", id_col).alias("_tie"), id_col)
    return running_totals(marks, F.col("change"), None, ("ts", "_tie"), slice_rows, "active").select(
        "ts", id_col, "change", "active"
    )
