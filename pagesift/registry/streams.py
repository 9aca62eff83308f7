"""Structured Streaming runs over the given tables, read back from their parquet sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.registry.base import SQL_CONTENT, canon_sql, checksum, query
from pagesift.registry.search import _hash_sql
from pagesift.session import scratch_path
from pagesift.sources.tables import event_stream, page_stream
from pagesift.streaming import jobs as J


def _caught_up(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream until it has read everything there is, and read its sink."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    J.append_to(stream, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


@query(
    "stream_index",
    f"""WITH {SQL_CONTENT}, x AS (SELECT page_id, url, title, 'Title: ' || title || '. Description: ' || description || '. Content: ' || content || '.' AS txt FROM ap),
    {_hash_sql("d", "x", "page_id", "txt")},
    c AS (SELECT page_id, sum(CAST(w AS DOUBLE) / norm * (bucket + 1)) AS s FROM d_w JOIN d_n USING (page_id) GROUP BY page_id)
    SELECT page_id, url, title, true AS can_be_vectorized, round(s, 5) AS checksum FROM x JOIN c USING (page_id)
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1""",
)
def stream_index(spark, sf):
    out = scratch_path(spark, "stream_index")
    arrivals = page_stream(spark, sf).withColumn("crawled_at", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    J.index_arrivals(arrivals, f"{out}/data", f"{out}/checkpoint", vector_type="array<double>").awaitTermination()
    schema = "page_id bigint, url string, title string, crawled_at timestamp_ntz, vector array<double>, can_be_vectorized boolean, batch_id bigint"
    stored = J.current_pages(spark.read.schema(schema).parquet(f"{out}/data"))
    return stored.select("page_id", "url", "title", "can_be_vectorized", checksum().alias("checksum"))


@query("stream_dedup", f"SELECT DISTINCT {canon_sql('url')} AS url FROM pages")
def stream_dedup(spark, sf):
    return _caught_up(J.unseen_urls(page_stream(spark, sf)), "stream_dedup")


@query(
    "stream_rate",
    """WITH w AS (SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, event_type AS label, count(*) / 300.0::DOUBLE AS rate FROM events GROUP BY ALL)
       SELECT * FROM w WHERE window_start + INTERVAL 5 MINUTES <= (SELECT max(ts) - INTERVAL 10 MINUTES FROM events)""",
)
def stream_rate(spark, sf):
    return _caught_up(J.windowed_rates(event_stream(spark, sf), "event_type"), "stream_rate")


_KINDS = {"view": "discover", "click": "take", "error": "retry", "purchase": "done", "signup": "recover"}
_KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items()) + " END"
_URL_EVENTS_SQL = f"""ue AS (SELECT 'https://site.example.com/' || user_id AS url, ts, event_id AS seq, {_KIND_SQL} AS kind,
  'w' || (event_id % 20) AS worker_id, (epoch_us(ts) // 1000) + CAST(round(value * 3600000) AS BIGINT) AS retry_at,
  'https://site.example.com/' || (user_id // 2) AS parent FROM events)"""


def url_events(events: DataFrame) -> DataFrame:
    """The event log read as crawl events: users are URLs, event types are transitions."""
    kind = F.create_map([F.lit(x) for pair in _KINDS.items() for x in pair])
    site = "https://site.example.com/"
    return events.select(
        F.concat(F.lit(site), F.col("user_id").cast("string")).alias("url"),
        "ts",
        F.col("event_id").alias("seq"),
        kind[F.col("event_type")].alias("kind"),
        F.concat(F.lit("w"), (F.col("event_id") % 20).cast("string")).alias("worker_id"),
        (F.unix_millis(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 3_600_000).cast("bigint")).alias("retry_at"),
        F.concat(F.lit(site), F.floor(F.col("user_id") / 2).cast("string")).alias("parent"),
    )


_LAST_SQL = f"""{_URL_EVENTS_SQL}, wm AS (SELECT (epoch_us(max(ts)) // 1000) - 600000 AS wm FROM events),
newest AS (SELECT * FROM ue QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts DESC, seq DESC) = 1)"""


@query("stream_retry", f"WITH {_LAST_SQL} SELECT url, retry_at FROM newest, wm WHERE kind = 'retry' AND retry_at <= wm")
def stream_retry(spark, sf):
    return _caught_up(J.retry_timers(url_events(event_stream(spark, sf))), "stream_retry")


@query(
    "stream_reaper",
    f"WITH {_LAST_SQL} SELECT url, (epoch_us(ts) // 1000) + 15000 AS stale_at FROM newest, wm WHERE kind = 'take' AND (epoch_us(ts) // 1000) + 15000 <= wm",
)
def stream_reaper(spark, sf):
    return _caught_up(J.stale_work(url_events(event_stream(spark, sf))), "stream_reaper")


@query(
    "stream_url_state",
    f"""WITH {_URL_EVENTS_SQL} SELECT url,
      coalesce(max_by(CASE kind WHEN 'take' THEN 2 WHEN 'retry' THEN 6 WHEN 'done' THEN 3 ELSE 1 END, (ts, seq)) FILTER (kind <> 'discover'), 1) AS status,
      coalesce(max_by(worker_id, (ts, seq)) FILTER (kind = 'take'), '') AS worker_id,
      count(*) FILTER (kind = 'retry') AS try,
      coalesce(max_by((epoch_us(ts) // 1000), (ts, seq)) FILTER (kind = 'take'), -1) AS take_on_at,
      coalesce(max_by(retry_at, (ts, seq)) FILTER (kind = 'retry'), -1) AS retry_at,
      coalesce(min_by(parent, (ts, seq)) FILTER (kind = 'discover'), '') AS parent
    FROM ue GROUP BY url""",
)
def stream_url_state(spark, sf):
    out = scratch_path(spark, "stream_url_state")
    J.follow_url_state(url_events(event_stream(spark, sf)), f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return J.stored_url_state(spark, f"{out}/data")
