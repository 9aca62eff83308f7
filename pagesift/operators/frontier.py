"""Crawl-frontier state as table transformations.

``url_state`` has one row per URL (see ``schemas.URL_STATE``). Queue order is
``(enqueue_round, enqueue_seq, enqueue_pos)`` with the URL as tie-break: every batch
that queues URLs takes a higher round number, so the table is never numbered as a whole.
Every transition returns one row per URL, however often its input names one.
``now`` is always a parameter (epoch milliseconds).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift import schemas as S
from pagesift.functions.fetch import fetch_class
from pagesift.functions.urls import start_url

COLUMNS = [f.name for f in S.URL_STATE.fields]
QUEUE_ORDER = ["enqueue_round", "enqueue_seq", "enqueue_pos", "url"]
MAX_TIME = (1 << 63) - 1


def _long(value: int | None) -> Column:
    return F.lit(value).cast("bigint")


def _fresh(url: Column, parent: Column, round_no: int, seq: Column, pos: Column, tries: int = 0) -> list[Column]:
    return [
        url.alias("url"),
        F.lit(S.QUEUED).alias("status"),
        F.lit("").alias("worker_id"),
        F.lit(tries).alias("try"),
        _long(-1).alias("take_on_at"),
        _long(-1).alias("retry_at"),
        parent.alias("parent"),
        _long(round_no).alias("enqueue_round"),
        seq.cast("bigint").alias("enqueue_seq"),
        pos.cast("bigint").alias("enqueue_pos"),
    ]


def latest_per_url(rows: DataFrame, *order: str) -> DataFrame:
    """One row per URL: the highest by ``order``, ties by the other columns; combined before the shuffle."""
    rest = [c for c in rows.columns if c != "url" and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("best")
    return rows.groupBy("url").agg(best).select(*(F.col("url") if c == "url" else F.col(f"best.{c}") for c in rows.columns))


def empty_state(spark) -> DataFrame:
    """A reset frontier: the state table with no rows."""
    return spark.createDataFrame([], S.URL_STATE)


def push_urls(state: DataFrame, candidates: DataFrame, round_no: int, also: Sequence[DataFrame] = ()) -> DataFrame:
    """Rows that ``candidates(url, parent, seq, pos)`` add: unseen URLs, first by (seq, pos) wins.

    ``pos`` may be left out. A URL with a row in ``state`` or ``also``, whatever its status, is ignored. First-wins is a minimum,
    so the most linked-to URL is one row per task before the shuffle.
    """
    pos = F.col("pos") if "pos" in candidates.columns else _long(0)
    first = candidates.groupBy("url").agg(F.min(F.struct("seq", pos.alias("pos"), "parent")).alias("first"))
    unseen = first
    for known in (state, *also):
        unseen = unseen.join(known.select("url"), "url", "left_anti")
    return unseen.select(_fresh(F.col("url"), F.col("first.parent"), round_no, F.col("first.seq"), F.col("first.pos")))


def reset_and_seed(state: DataFrame, seeds: DataFrame, round_no: int) -> DataFrame:
    """The whole state table after a restart of the crawl: every old row goes, the seeds are queued."""
    return seed_frontier(state.limit(0), seeds, round_no)


def seed_frontier(state: DataFrame, seeds: DataFrame, round_no: int) -> DataFrame:
    """Push the site roots of ``seeds(raw, seq)``; text without a host is dropped."""
    roots = seeds.select(start_url(F.col("raw")).alias("url"), F.lit("").alias("parent"), "seq")
    return push_urls(state, roots.where(F.col("url").isNotNull()), round_no)


def replace_rows(state: DataFrame, changed: DataFrame) -> DataFrame:
    """The state table with ``changed`` rows in place of the old ones, new URLs appended."""
    return state.join(changed.select("url"), "url", "left_anti").select(COLUMNS).unionByName(changed.select(COLUMNS))


def may_retry(tries: Column, try_limit: int = S.TRY_LIMIT) -> Column:
    return F.lit(True) if try_limit == -1 else tries < try_limit


def retry_time(tries: Column, now: Column, base_ms: int = S.RETRY_BASE_MS) -> Column:
    """``now + base * 2^try``, at most the largest time there is."""
    room = (_long(MAX_TIME) - now) / F.lit(max(base_ms, 1))
    # a double above: half the room is left as margin for its rounding
    fits = F.pow(F.lit(2.0), tries) < room / 2
    step = F.pow(F.lit(2.0), F.least(tries, F.lit(62))).cast("bigint")
    return F.when(fits, now + F.lit(base_ms).cast("bigint") * step).otherwise(_long(MAX_TIME))


def schedule_retries(
    state: DataFrame, failed: DataFrame, now: int, try_limit: int = S.TRY_LIMIT, base_ms: int = S.RETRY_BASE_MS
) -> DataFrame:
    """Rows of ``failed(url)`` after back-off scheduling, or given up once the limit is reached."""
    hit = state.join(failed.select("url").distinct(), "url", "left_semi")
    again = may_retry(F.col("try"), try_limit)
    return hit.select(
        "url",
        F.when(again, F.lit(S.RETRY)).otherwise(F.lit(S.GIVE_UP)).alias("status"),
        "worker_id",
        F.when(again, F.col("try") + 1).otherwise(F.col("try")).alias("try"),
        "take_on_at",
        F.when(again, retry_time(F.col("try"), _long(now), base_ms)).otherwise(F.col("retry_at")).alias("retry_at"),
        "parent",
        "enqueue_round",
        "enqueue_seq",
        "enqueue_pos",
    )


def release_due(state: DataFrame, now: int, round_no: int, retry_queue: DataFrame | None = None) -> DataFrame:
    """Rows whose retry time has come (``retry_at <= now``), queued again in (time, url) order.

    ``retry_queue(url, retry_at)`` defaults to the rows in state Retry; of several entries of
    one URL the earliest counts. An entry without a state row is queued with a fresh row at try 1.
    """
    if retry_queue is None:
        due = state.where((F.col("status") == S.RETRY) & (F.col("retry_at") <= now))
        return due.select(
            "url",
            F.lit(S.QUEUED).alias("status"),
            *["worker_id", "try", "take_on_at", "retry_at", "parent"],
            _long(round_no).alias("enqueue_round"),
            F.col("retry_at").alias("enqueue_seq"),
            _long(0).alias("enqueue_pos"),
        )
    due = retry_queue.where(F.col("retry_at") <= now).groupBy("url").agg(F.min("retry_at").alias("due_at"))
    return due.join(state, "url", "left").select(
        "url",
        F.lit(S.QUEUED).alias("status"),
        F.coalesce("worker_id", F.lit("")).alias("worker_id"),
        F.coalesce("try", F.lit(1)).alias("try"),
        F.coalesce("take_on_at", _long(-1)).alias("take_on_at"),
        F.coalesce("retry_at", _long(-1)).alias("retry_at"),
        F.coalesce("parent", F.lit("")).alias("parent"),
        _long(round_no).alias("enqueue_round"),
        F.col("due_at").alias("enqueue_seq"),
        _long(0).alias("enqueue_pos"),
    )


def retries_left(state: DataFrame, now: int) -> DataFrame:
    """How many retries are not due yet, as one row ``(remaining)``."""
    return state.agg(F.count_if((F.col("status") == S.RETRY) & (F.col("retry_at") > now)).alias("remaining"))


def mark_processed(state: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rows of ``outcomes(url, new_status)`` with their terminal status; unknown URLs are left out.

    Of several outcomes of one URL the one with the highest ``seq`` counts, where that column is given.
    """
    order = [c for c in ("seq",) if c in outcomes.columns]
    latest = latest_per_url(outcomes.select("url", *order, "new_status"), *order)
    return state.join(latest.select("url", "new_status"), "url").withColumn("status", F.col("new_status")).select(COLUMNS)


def unknown_urls(state: DataFrame, wanted: DataFrame) -> DataFrame:
    """The reject table of any transition: URLs that have no state row."""
    return wanted.select("url").join(state.select("url"), "url", "left_anti").distinct()


def recover(state: DataFrame, urls: DataFrame, round_no: int) -> DataFrame:
    """Rows of ``urls(url)`` queued again, tries unchanged; a URL without state gets a fresh row."""
    return urls.select("url").distinct().join(state, "url", "left").select(
        "url",
        F.lit(S.QUEUED).alias("status"),
        F.coalesce("worker_id", F.lit("")).alias("worker_id"),
        F.coalesce("try", F.lit(0)).alias("try"),
        F.coalesce("take_on_at", _long(-1)).alias("take_on_at"),
        F.coalesce("retry_at", _long(-1)).alias("retry_at"),
        F.coalesce("parent", F.lit("")).alias("parent"),
        _long(round_no).alias("enqueue_round"),
        F.coalesce("take_on_at", _long(-1)).alias("enqueue_seq"),
        _long(0).alias("enqueue_pos"),
    )


def sweep_stale(
    state: DataFrame, now: int, round_no: int, stale_ms: int = S.STALE_AFTER_MS, in_flight: DataFrame | None = None
) -> DataFrame:
    """Rows recovered because they were taken at least ``stale_ms`` ago.

    ``in_flight(url)`` is the set of URLs being processed; it defaults to the rows in
    state Processing. URLs in flight without a state row are recovered too.
    """
    old = _long(now) - F.col("take_on_at") >= stale_ms
    if in_flight is None:
        stuck = state.where((F.col("status") == S.PROCESSING) & old).select("url")
    else:
        ages = state.select("url", "take_on_at")
        joined = in_flight.select("url").distinct().join(ages, "url", "left")
        stuck = joined.where(F.col("take_on_at").isNull() | old).select("url")
    return recover(state, stuck, round_no)


def crawl_metadata(state: DataFrame) -> DataFrame:
    """One row: URLs still to be processed and the earliest retry time (NULL when none)."""
    return state.agg(
        F.count_if(F.col("status").isin(S.QUEUED, S.PROCESSING, S.RETRY)).alias("unprocessed"),
        F.min(F.when(F.col("status") == S.RETRY, F.col("retry_at"))).alias("earliest_retry"),
    )


def queue_depths(state: DataFrame) -> DataFrame:
    return state.agg(
        F.count_if(F.col("status") == S.QUEUED).alias("queue_depth"),
        F.count_if(F.col("status") == S.RETRY).alias("retry_depth"),
    )


def crawl_outcomes(
    state: DataFrame,
    fetches: DataFrame,
    now: int,
    try_limit: int = S.TRY_LIMIT,
    base_ms: int = S.RETRY_BASE_MS,
    retry_transport: bool = False,
) -> DataFrame:
    """Next state of every fetched URL, with the outcome label it is counted under.

    ``fetches(url, http_status, error_kind, extract_failed, store_error)``, of which the one with
    the highest ``seq`` counts for a URL, where that column is given. Transport and
    extraction errors give up at once; ``store_error`` is '', 'transient' (leave the row
    for the stale sweep) or 'fatal'. With ``retry_transport`` transport errors back off
    like a retryable status. A body that a browser must render first (``client_rendered``,
    where given) ends as ``render`` in state Manual: it holds nothing to store yet.
    """
    order = [c for c in ("seq",) if c in fetches.columns]
    wanted = ["http_status", "error_kind", "extract_failed", "store_error", *(c for c in ("client_rendered",) if c in fetches.columns)]
    latest = latest_per_url(fetches.select("url", *order, *wanted), *order)
    joined = latest.join(state.select("url", "status", "try", "retry_at"), "url")
    render = F.coalesce("client_rendered", F.lit(False)) if "client_rendered" in fetches.columns else F.lit(False)
    kind = fetch_class(F.col("http_status"))
    transport = F.coalesce(F.col("error_kind"), F.lit("")) != ""
    retryable = kind == S.FETCH_RETRY
    if retry_transport:
        retryable, transport = retryable | transport, F.lit(False)
    again = may_retry(F.col("try"), try_limit)
    verdict = (
        F.when(transport, F.lit("give_up"))
        .when(retryable & again, F.lit("retry"))
        .when(retryable, F.lit("give_up"))
        .when(kind == S.FETCH_MANUAL, F.lit("manual"))
        .when(kind == S.FETCH_IMPOSSIBLE, F.lit("impossible"))
        .when(render, F.lit("render"))
        .when(F.col("extract_failed") | (F.col("store_error") == "fatal"), F.lit("give_up"))
        .when(F.col("store_error") == "transient", F.lit("left"))
        .otherwise(F.lit("ok"))
    )
    label = F.col("outcome")
    return joined.withColumn("outcome", verdict).select(
        "url",
        F.when(label == "ok", F.lit(S.DONE))
        .when(label == "retry", F.lit(S.RETRY))
        .when(label.isin("manual", "render"), F.lit(S.MANUAL))
        .when(label == "left", F.col("status"))
        .otherwise(F.lit(S.GIVE_UP))
        .alias("new_status"),
        F.when(label != "left", label).alias("outcome"),
        F.when(label == "retry", F.col("try") + 1).otherwise(F.col("try")).alias("try"),
        F.when(label == "retry", retry_time(F.col("try"), _long(now), base_ms)).otherwise(F.col("retry_at")).alias("retry_at"),
    )
