"""Structured Streaming jobs. Sinks are parquet folders; nothing passes through the driver."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagesift import schemas as S
from pagesift.functions.urls import canonical_url
from pagesift.operators.embed import EmbedLoader
from pagesift.operators.extract import assemble_pages
from pagesift.plans.indexing import index_pass

WATERMARK = "10 minutes"
COMPACT_EVERY = 64


def append_to(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start appending a stream to a parquet folder; by default it stops once caught up."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.option("path", path).trigger(**(trigger or {"availableNow": True})).start()


def index_arrivals(
    raw_pages: DataFrame,
    path: str,
    checkpoint: str,
    loader: EmbedLoader | None = None,
    trigger: dict | None = None,
    vector_type: str = "array<float>",
) -> StreamingQuery:
    """Parse and embed pages as they arrive, one folder per micro-batch.

    A batch that is replayed after a failure overwrites its own folder, so no page is
    indexed twice. The first run over an existing folder is the cold start. A page crawled
    again is written again; ``current_pages`` reads the newest row of each URL. Parsing and
    embedding are one chain of maps over the batch, of which nothing is kept.
    """

    def index(batch: DataFrame, batch_id: int) -> None:
        pages = assemble_pages(batch).select(
            "page_id",
            "url",
            "title",
            "description",
            "content",
            "crawled_at",
            F.lit(None).cast(vector_type).alias("vector"),
            F.lit(True).alias("can_be_vectorized"),
        )
        index_pass(pages, loader).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = raw_pages.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def current_pages(stored: DataFrame) -> DataFrame:
    """The newest row of each URL of what ``index_arrivals`` has written, by (crawled_at, page_id).

    Which batch a row came with does not matter, so neither does how arrivals were cut into batches.
    """
    newest = Window.partitionBy("url").orderBy(F.col("crawled_at").desc(), F.col("page_id").desc())
    return stored.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn", "batch_id")


def _first_per_url(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.sort_values(list(pdf.columns)).drop_duplicates("url")


def unseen_urls(urls: DataFrame, ts: str | None = None, horizon: str | None = None) -> DataFrame:
    """First sight of each canonical ``url`` on a stream.

    Remembers every URL ever seen, unless ``ts`` and ``horizon`` bound the memory; then a
    URL counts as new again once the horizon has passed. Repeats inside a task's batch
    are dropped before the shuffle, so a URL on every page does not swamp one task.
    """
    canonical = urls.withColumn("url", canonical_url(F.col("url"))).where(F.col("url").isNotNull())
    if ts is None:
        return canonical.select("url").mapInPandas(_first_per_url, "url string").dropDuplicates(["url"])
    timed = canonical.select("url", F.col(ts).cast("timestamp").alias("ts"))
    firsts = timed.mapInPandas(_first_per_url, "url string, ts timestamp").withWatermark("ts", horizon)
    return firsts.dropDuplicatesWithinWatermark(["url"]).withColumnRenamed("ts", ts)


def windowed_rates(events: DataFrame, label: str, seconds: int = 300, watermark: str = WATERMARK) -> DataFrame:
    """Per-second rate by label, each window once it is closed; later rows are dropped."""
    counted = (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", watermark)
        .groupBy(F.window("ts", f"{seconds} seconds"), F.col(label).alias("label"))
        .agg(F.count("*").alias("n"))
    )
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "label", (F.col("n").cast("double") / seconds).alias("rate"))


# --- timers ---------------------------------------------------------------------------


def _last_per_url(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.sort_values(["ts", "seq"]).drop_duplicates("url", keep="last")


def _timer(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        _, _, due_at = state.get
        state.remove()
        yield pd.DataFrame({"url": [key[0]], "due_at": [due_at]})
        return
    newest = state.get if state.exists else (-1, -1, -1)
    for pdf in batches:
        for ts, seq, due_at in zip(pdf["ts_us"], pdf["seq"], pdf["due_at"], strict=True):
            newest = max(newest, (int(ts), int(seq), int(due_at)))
    now, due_at = state.getCurrentWatermarkMs(), newest[2]
    state.update(newest)
    if due_at < 0:
        return
    if due_at <= now:
        state.remove()
        yield pd.DataFrame({"url": [key[0]], "due_at": [due_at]})
    else:
        # timers fire strictly before the watermark; one millisecond earlier makes "due now" due
        state.setTimeoutTimestamp(max(due_at - 1, now + 1))


def fire_timers(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """``(url, due_at)`` once event time has reached the due time of a URL's latest event.

    ``events(url, ts, seq, due_at)``; ``due_at`` is epoch milliseconds, NULL for an event
    that only cancels an earlier timer. An event later than the watermark is dropped, a cancelling
    one too: choose a watermark longer than events are ever late. Each task reduces its rows to the latest event
    per URL before the shuffle, so a busy URL sends on one row per batch.
    """
    src = (
        events.select("url", F.col("ts").cast("timestamp").alias("ts"), "seq", F.coalesce("due_at", F.lit(-1).cast("bigint")).alias("due_at"))
        .mapInPandas(_last_per_url, "url string, ts timestamp, seq bigint, due_at bigint")
        .withWatermark("ts", watermark)
    )
    keyed = src.withColumn("ts_us", F.unix_micros("ts"))
    return keyed.groupBy("url").applyInPandasWithState(
        _timer,
        "url string, due_at bigint",
        "ts_us bigint, seq bigint, due_at bigint",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def retry_timers(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Retries of ``events(url, ts, seq, kind, retry_at)`` as they come due."""
    due = F.when(F.col("kind") == "retry", F.col("retry_at"))
    return fire_timers(events.withColumn("due_at", due), watermark).withColumnRenamed("due_at", "retry_at")


def stale_work(events: DataFrame, stale_ms: int = S.STALE_AFTER_MS, watermark: str = WATERMARK) -> DataFrame:
    """URLs of ``events(url, ts, seq, kind)`` that were taken and then not heard of for ``stale_ms``."""
    due = F.when(F.col("kind") == "take", F.unix_millis(F.col("ts").cast("timestamp")) + stale_ms)
    return fire_timers(events.withColumn("due_at", due), watermark).withColumnRenamed("due_at", "stale_at")


# --- state fold -------------------------------------------------------------------------


def fold_url_events(events: DataFrame) -> DataFrame:
    """Latest state per URL from ``events(url, ts, seq, kind, worker_id, retry_at, parent)``.

    Kinds: discover, take, retry, done, give_up, manual, recover. A discover never changes
    a URL that has any other event. Every column is an ordinary aggregate, so the same
    function serves batch and stream, is combined before the shuffle, and keeps its
    state in the native store.
    """
    order = F.struct("ts", "seq")
    kind = F.col("kind")
    status = F.lit(None).cast("int")
    for name, code in {
        "take": S.PROCESSING,
        "retry": S.RETRY,
        "done": S.DONE,
        "give_up": S.GIVE_UP,
        "manual": S.MANUAL,
        "recover": S.QUEUED,
    }.items():
        status = F.when(kind == name, F.lit(code)).otherwise(status)

    def last(value: Column, when: Column) -> Column:
        return F.max(F.when(when, F.struct(order.alias("o"), value.alias("v"))))["v"]

    def first(value: Column, when: Column) -> Column:
        return F.min(F.when(when, F.struct(order.alias("o"), value.alias("v"))))["v"]

    return events.groupBy("url").agg(
        F.coalesce(last(status, kind != "discover"), F.lit(S.QUEUED)).alias("status"),
        F.coalesce(last(F.col("worker_id"), kind == "take"), F.lit("")).alias("worker_id"),
        F.count_if(kind == "retry").alias("try"),
        F.coalesce(last(F.unix_millis(F.col("ts").cast("timestamp")), kind == "take"), F.lit(-1)).alias("take_on_at"),
        F.coalesce(last(F.col("retry_at"), kind == "retry"), F.lit(-1)).alias("retry_at"),
        F.coalesce(first(F.col("parent"), kind == "discover"), F.lit("")).alias("parent"),
    )


def follow_url_state(
    events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, compact_every: int = COMPACT_EVERY
) -> StreamingQuery:
    """Keep URL states up to date: every micro-batch writes the rows it changed.

    Every ``compact_every``-th batch writes the newest row of every URL instead, so that
    ``stored_url_state`` never reads more than that one and the batches after it.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if (batch_id + 1) % compact_every == 0 and batch_id:
            before = batch.sparkSession.read.parquet(path).where(F.col("batch_id").between(max(batch_id - compact_every, 0), batch_id - 1))
            rows = current_url_state(before.select(*batch.columns, "batch_id").unionByName(batch.withColumn("batch_id", F.lit(batch_id))))
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = fold_url_events(events).writeStream.outputMode("update").foreachBatch(store)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stored_url_state(spark: SparkSession, path: str, compact_every: int = COMPACT_EVERY) -> DataFrame:
    """The newest row per URL of what ``follow_url_state`` has written below ``path``."""
    stored = spark.read.parquet(path)
    newest = stored.agg(F.max("batch_id")).first()[0]
    return current_url_state(stored.where(F.col("batch_id") >= (newest + 1) // compact_every * compact_every - 1))


def current_url_state(stored: DataFrame) -> DataFrame:
    """The newest row per URL of rows that carry the ``batch_id`` they were written with."""
    columns = [c for c in stored.columns if c not in ("url", "batch_id")]
    newest = F.max(F.struct("batch_id", *columns)).alias("row")
    return stored.groupBy("url").agg(newest).select("url", *[F.col(f"row.{c}").alias(c) for c in columns])
