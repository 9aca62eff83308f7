"""Operational analytics over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesift.operators import ops as M
from pagesift.registry.base import query
from pagesift.session import written
from pagesift.sources.tables import table

_BOUNDS = M.LATENCY_BOUNDS


def _events(spark, sf):
    return table(spark, sf, "events")


@query(
    "event_rate",
    "SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, event_type AS label, count(*) / 300.0::DOUBLE AS rate FROM events GROUP BY ALL",
)
def event_rate(spark, sf):
    return M.rates(_events(spark, sf), "event_type")


@query(
    "event_rate_sliding",
    """WITH s AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(CAST(k AS INTEGER)) AS window_start, event_type AS label
                  FROM events, range(5) AS r(k))
       SELECT window_start, label, count(*) / 300.0::DOUBLE AS rate FROM s GROUP BY ALL""",
)
def event_rate_sliding(spark, sf):
    return M.sliding_rates(_events(spark, sf), "event_type")


@query(
    "value_rate",
    "SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, event_type AS label, round(sum(value) / 300.0::DOUBLE, 6) AS rate FROM events GROUP BY ALL",
)
def value_rate(spark, sf):
    return M.rates(_events(spark, sf), "event_type", value="value").withColumn("rate", F.round("rate", 6))


_BUCKET_SQL = f"""b AS (SELECT unnest([{", ".join(map(str, _BOUNDS))}, 'infinity'::DOUBLE]) AS le),
bc AS (SELECT event_type, le, count(*) FILTER (value / 100.0 <= le) AS n FROM events, b GROUP BY event_type, le)"""


@query("latency_buckets", f"WITH {_BUCKET_SQL} SELECT event_type, nullif(le, 'infinity'::DOUBLE) AS le, n FROM bc")
def latency_buckets(spark, sf):
    buckets = M.bucket_counts(_events(spark, sf), ["event_type"], F.col("value") / 100.0)
    return buckets.withColumn("le", F.when(F.col("le") != float("inf"), F.col("le")))  # NULL: the open bucket


@query(
    "latency_quantiles",
    f"""WITH {_BUCKET_SQL}, t AS (SELECT event_type, max(n) AS total FROM bc GROUP BY event_type),
    asked AS (SELECT event_type, q, q * total AS rank FROM t, (SELECT unnest([0.5, 0.95, 0.99]::DOUBLE[]) AS q)),
    hit AS (SELECT a.event_type, q, rank, min(le) AS hi, min_by(n, le) AS hi_n FROM asked a JOIN bc ON bc.event_type = a.event_type AND n >= rank GROUP BY ALL),
    lowr AS (SELECT h.event_type, h.q, rank, hi, hi_n, coalesce(max(le), 0) AS lo, coalesce(max(n), 0) AS lo_n
             FROM hit h LEFT JOIN bc ON bc.event_type = h.event_type AND n < rank GROUP BY ALL)
    SELECT event_type, q, round(CASE WHEN hi = 'infinity'::DOUBLE THEN lo ELSE lo + (hi - lo) * (rank - lo_n) / (hi_n - lo_n) END, 6) AS value FROM lowr""",
)
def latency_quantiles(spark, sf):
    buckets = M.bucket_counts(_events(spark, sf), ["event_type"], F.col("value") / 100.0)
    found = M.bucket_quantiles(buckets, ["event_type"], [0.5, 0.95, 0.99])
    return found.select("event_type", "q", F.round("value", 6).alias("value"))


@query(
    "empty_ratio",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
       round(count(*) FILTER (event_type = 'view' AND value < 10) / nullif(count(*) FILTER (event_type = 'view'), 0)::DOUBLE, 6) AS ratio
       FROM events GROUP BY 1""",
)
def empty_ratio(spark, sf):
    """A view is a search request, one below 10 a search that found nothing."""
    hour = F.window("ts", "1 hour")["start"].alias("window_start")
    views = F.col("event_type") == "view"
    found = M.ratio_of_counts(_events(spark, sf), [hour], views & (F.col("value") < 10), views)
    return found.withColumn("ratio", F.round("ratio", 6))


@query(
    "mean_wait",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
       round(coalesce(sum(value) FILTER (event_type = 'click'), 0) / nullif(count(*) FILTER (event_type = 'click'), 0), 6) AS ratio
       FROM events GROUP BY 1""",
)
def mean_wait(spark, sf):
    hour = F.window("ts", "1 hour")["start"].alias("window_start")
    wait = F.when(F.col("event_type") == "click", F.col("value")).otherwise(0.0)
    n = F.when(F.col("event_type") == "click", 1).otherwise(0)
    return M.ratio_of_sums(_events(spark, sf), [hour], wait, n).withColumn("ratio", F.round("ratio", 6))


@query(
    "counter_deltas",
    """SELECT event_id, event_type, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id), 4) AS total, round(value, 4) AS delta FROM events""",
)
def counter_deltas(spark, sf):
    """Cumulative snapshots per event type, and their increments."""
    log = _events(spark, sf).select("event_id", "ts", "event_type", "value")
    snapshots = written(M.running_totals(log, F.col("value"), "event_type"), "snapshots")
    deltas = M.counter_deltas(snapshots, "event_type")
    return deltas.select("event_id", "event_type", F.round("total", 4).alias("total"), F.round("delta", 4).alias("delta"))


@query(
    "latest_gauge",
    "SELECT event_type AS label, max_by(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY 1",
)
def latest_gauge(spark, sf):
    return M.latest_gauge(_events(spark, sf), "event_type")


@query("counter_totals", "SELECT event_type AS label, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def counter_totals(spark, sf):
    return M.counter_totals(_events(spark, sf), "event_type").withColumn("total", F.round("total", 4))


@query(
    "active_intervals",
    """WITH m AS (SELECT ts, event_id, 1 AS change FROM events
         UNION ALL SELECT ts + to_microseconds(CAST(round(value * 60000000) AS BIGINT)), event_id, -1 FROM events)
       SELECT ts, event_id, change, CAST(sum(change) OVER (ORDER BY ts, change, event_id) AS BIGINT) AS active FROM m""",
)
def active_intervals(spark, sf):
    """Each event is active for ``value`` minutes."""
    end = F.expr("ts + make_dt_interval(0, 0, 0, cast(value * 60 as decimal(18, 6)))").alias("end_ts")
    return M.concurrency(_events(spark, sf).select("event_id", F.col("ts").alias("start_ts"), end))


@query(
    "peak_concurrency",
    """WITH m AS (SELECT ts, event_id, 1 AS change FROM events
         UNION ALL SELECT ts + to_microseconds(CAST(round(value * 60000000) AS BIGINT)), event_id, -1 FROM events),
       r AS (SELECT ts, sum(change) OVER (ORDER BY ts, change, event_id) AS active FROM m)
       SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, CAST(max(active) AS BIGINT) AS peak FROM r GROUP BY 1""",
)
def peak_concurrency(spark, sf):
    hour = F.window("ts", "1 hour")["start"].alias("window_start")
    return active_intervals(spark, sf).groupBy(hour).agg(F.max("active").alias("peak"))
