from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagesift.operators import ops as M

T0 = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp_ntz, label string, value double"


def events(spark, *rows):
    return spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), l, float(v)) for i, (s, l, v) in enumerate(rows)], EVENTS)


def test_rates(spark):
    df = events(spark, (0, "a", 30), (299, "a", 30), (300, "a", 30), (1, "b", 3))
    got = {(r.window_start, r.label): r.rate for r in M.rates(df, "label").collect()}
    assert got == {(T0, "a"): 2 / 300, (T0 + dt.timedelta(minutes=5), "a"): 1 / 300, (T0, "b"): 1 / 300}
    by_value = {(r.window_start, r.label): r.rate for r in M.rates(df, "label", value="value").collect()}
    assert by_value[(T0, "a")] == pytest.approx(0.2)


def test_sliding_equals_direct_windows(spark):
    df = events(spark, *[(s * 17 % 900, "ab"[s % 2], 1) for s in range(200)])
    direct = df.groupBy(F.window("ts", "300 seconds", "60 seconds")["start"].alias("window_start"), "label").agg((F.count("*") / 300.0).alias("rate"))
    fast = M.sliding_rates(df, "label")
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, direct.select("window_start", "label", "rate").collect()))


def test_quantiles_interpolate_and_clamp(spark):
    values = [0.004] * 2 + [0.3] * 6 + [20.0] * 2
    buckets = M.bucket_counts(events(spark, *[(i, "a", v) for i, v in enumerate(values)]), ["label"], F.col("value"))
    counts = {r.le: r.n for r in buckets.collect()}
    assert (counts[0.005], counts[0.25], counts[0.5], counts[10.0], counts[float("inf")]) == (2, 2, 8, 8, 10)
    got = {r.q: r.value for r in M.bucket_quantiles(buckets, ["label"], [0.1, 0.5, 0.95]).collect()}
    assert got[0.1] == pytest.approx(0.0025)
    assert got[0.5] == pytest.approx(0.25 + 0.25 * (5 - 2) / 6)
    assert got[0.95] == 10.0


def test_ratio_of_nothing_is_null(spark):
    df = events(spark, (0, "a", 1))
    assert M.ratio_of_counts(df, [F.col("label")], F.lit(True), F.lit(False)).collect()[0].ratio is None


def test_deltas_and_totals_across_slices(spark):
    increments = [1.0, 2.0, 0.0, 5.0, 7.0, 3.0]
    df = events(spark, *[(s * 2000, "a", v) for s, v in enumerate(increments)], (0, "b", 9))
    totals = M.running_totals(df, F.col("value"), "label", slice_rows=2)
    assert [r.total for r in totals.where("label = 'a'").orderBy("ts").collect()] == [1, 3, 3, 8, 15, 18]
    deltas = M.counter_deltas(totals, "label", slice_rows=2)
    assert [r.delta for r in deltas.where("label = 'a'").orderBy("ts").collect()] == increments
    assert [r.delta for r in deltas.where("label = 'b'").collect()] == [9.0]


def test_no_row_is_lost_to_a_missing_label(spark):
    df = events(spark, (0, None, 1), (10, None, 2), (9000, None, 4), (5, "a", 8))
    totals = M.running_totals(df, F.col("value"), "label")
    assert sorted(r.total for r in totals.collect()) == [1, 3, 7, 8]
    assert sorted(r.delta for r in M.counter_deltas(totals, "label").collect()) == [1, 2, 4, 8]


def test_one_label_over_many_slices_equals_one_window(spark):
    df = events(spark, *[(s * 37 % 50_000, "hot" if s % 3 else "cold", s % 11) for s in range(3000)])
    plain = df.selectExpr("event_id", "sum(value) over (partition by label order by ts, event_id) as total").collect()
    sliced = M.running_totals(df, F.col("value"), "label", slice_rows=100).select("event_id", "total").collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, sliced))


def test_a_burst_in_one_second_is_cut_evenly(spark):
    """Nine tenths of the log in one second, most of it one label."""
    df = events(spark, *[(5 if s % 10 else s, "hot" if s % 7 else None, s % 13) for s in range(20_000)]).repartition(9)
    plain = df.selectExpr("event_id", "sum(value) over (partition by label order by ts, event_id) as total").collect()
    got = M.running_totals(df, F.col("value"), "label", slice_rows=500)
    assert sorted(map(tuple, plain)) == sorted(map(tuple, got.select("event_id", "total").collect()))
    sizes = [r["count"] for r in M._keyed(df, ("ts", "event_id"), "label", 500).groupBy("_slice").count().collect()]
    assert len(sizes) >= 30 and max(sizes) < 2_000
    deltas = M.counter_deltas(got, "label", slice_rows=700)
    assert sorted((r.event_id, r.delta) for r in deltas.collect()) == sorted((r.event_id, r.value) for r in df.collect())


def test_concurrency_equals_one_window_with_many_slices(spark):
    rows = [(i, T0 + dt.timedelta(seconds=i % 50), T0 + dt.timedelta(seconds=i % 50 + i % 7)) for i in range(2_000)]
    df = spark.createDataFrame(rows, "event_id long, start_ts timestamp_ntz, end_ts timestamp_ntz")
    marks = df.selectExpr("event_id", "start_ts as ts", "1 as change").unionAll(df.selectExpr("event_id", "end_ts", "-1"))
    plain = marks.selectExpr("event_id", "change", "sum(change) over (order by ts, change, event_id) as active").collect()
    got = M.concurrency(df, slice_rows=100).select("event_id", "change", "active").collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, got))


def test_latest_gauge_breaks_ties_by_id(spark):
    got = M.latest_gauge(events(spark, (5, "a", 1), (5, "a", 2), (1, "a", 3)), "label").collect()
    assert [(r.label, r.value) for r in got] == [("a", 2.0)]


def test_concurrency_peak(spark):
    rows = [(0, T0, T0 + dt.timedelta(hours=3)), (1, T0 + dt.timedelta(hours=1), T0 + dt.timedelta(hours=2)), (2, T0 + dt.timedelta(hours=2), T0 + dt.timedelta(hours=4))]
    got = M.concurrency(spark.createDataFrame(rows, "event_id long, start_ts timestamp_ntz, end_ts timestamp_ntz"))
    assert [r.active for r in got.orderBy("ts", "change").collect()] == [1, 2, 1, 2, 1, 0]
