from __future__ import annotations

import datetime as dt
import pathlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pagesift import schemas as S
from pagesift.operators.embed import hash_embedder
from pagesift.sources.tables import page_stream, table_stream
from pagesift.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1)
URL_EVENT = "url string, ts timestamp_ntz, seq long, kind string, worker_id string, retry_at long, parent string"


def ms(seconds):
    return int((T0 - dt.datetime(1970, 1, 1)).total_seconds() * 1000) + int(seconds * 1000)


def event(seq, url, second, kind, retry_at=None, worker="", parent=""):
    return (url, T0 + dt.timedelta(seconds=second), seq, kind, worker, retry_at, parent)


def add_file(spark, folder, name, rows, schema=URL_EVENT):
    """A file of the table that ``name`` is called after, but for its number."""
    table = pathlib.Path(folder) / f"{name.rstrip('0123456789')}.parquet"
    table.mkdir(exist_ok=True)
    pq.write_table(spark.createDataFrame(rows, schema).toArrow(), f"{table}/{name}.parquet")


def follow(stream, tmp_path):
    J.append_to(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()


def url_events(spark, folder):
    schema = spark.createDataFrame([], URL_EVENT).schema
    return table_stream(spark, str(folder), "log", schema, files_per_batch=1)


@pytest.fixture
def log(tmp_path):
    (tmp_path / "in" / "log.parquet").mkdir(parents=True)
    return tmp_path / "in"


def test_retries_fire_when_due_across_batches(spark, log, tmp_path):
    add_file(spark, log, "log1", [event(1, "A", 0, "retry", ms(30)), event(2, "B", 1, "retry", ms(5000)), event(3, "C", 2, "retry", ms(30))])
    first = follow(J.retry_timers(url_events(spark, log), "1 second"), tmp_path)
    assert first == []
    add_file(spark, log, "log2", [event(4, "C", 20, "done"), event(5, "Z", 31, "discover")])
    second = follow(J.retry_timers(url_events(spark, log), "1 second"), tmp_path)
    assert sorted(tuple(r) for r in second) == [("A", ms(30))]
    add_file(spark, log, "log3", [event(6, "Z", 6000, "discover")])
    third = follow(J.retry_timers(url_events(spark, log), "1 second"), tmp_path)
    assert sorted(tuple(r) for r in third) == [("A", ms(30)), ("B", ms(5000))]


def test_later_retry_replaces_earlier(spark, log, tmp_path):
    add_file(spark, log, "log1", [event(1, "A", 0, "retry", ms(10)), event(2, "A", 1, "retry", ms(20)), event(3, "Z", 100, "discover")])
    got = follow(J.retry_timers(url_events(spark, log), "1 second"), tmp_path)
    assert [tuple(r) for r in got] == [("A", ms(20))]


def test_reaper(spark, log, tmp_path):
    add_file(spark, log, "log1", [event(1, "A", 0, "take"), event(2, "B", 0, "take"), event(3, "B", 5, "done"), event(4, "C", 90, "take"), event(5, "Z", 100, "discover")])
    got = follow(J.stale_work(url_events(spark, log), watermark="1 second"), tmp_path)
    assert [tuple(r) for r in got] == [("A", ms(15))]


def test_state_fold_stream_equals_batch(spark, log, tmp_path):
    rows = [
        event(1, "A", 0, "discover", parent="p1"), event(2, "A", 1, "take", worker="w1"), event(3, "A", 2, "retry", ms(9)),
        event(4, "B", 3, "discover", parent="p2"), event(5, "A", 4, "discover", parent="p9"), event(6, "A", 5, "take", worker="w2"),
        event(7, "B", 6, "take", worker="w3"), event(8, "B", 7, "recover"), event(9, "A", 8, "done"),
    ]
    add_file(spark, log, "log1", rows[:4])
    add_file(spark, log, "log2", rows[4:])
    J.follow_url_state(url_events(spark, log), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert stored.select("batch_id").distinct().count() == 2
    got = {tuple(r) for r in J.current_url_state(stored).collect()}
    batch = {tuple(r) for r in J.fold_url_events(spark.createDataFrame(rows, URL_EVENT)).collect()}
    assert got == batch == {("A", S.DONE, "w2", 1, ms(5), ms(9), "p1"), ("B", S.QUEUED, "w3", 0, ms(6), -1, "p2")}


def test_state_is_compacted(spark, log, tmp_path):
    rows = [event(i, f"U{i % 3}", i, "retry" if i % 2 else "take", ms(i), worker=f"w{i}") for i in range(7)]
    for i, r in enumerate(rows):
        add_file(spark, log, f"log{i}", [r])
    out = str(tmp_path / "out")
    J.follow_url_state(url_events(spark, log), out, str(tmp_path / "ckpt"), compact_every=3).awaitTermination()
    counts = {r.batch_id: r["count"] for r in spark.read.parquet(out).groupBy("batch_id").count().collect()}
    assert counts == {0: 1, 1: 1, 2: 3, 3: 1, 4: 1, 5: 3, 6: 1}
    got = {tuple(r) for r in J.stored_url_state(spark, out, compact_every=3).collect()}
    assert got == {tuple(r) for r in J.fold_url_events(spark.createDataFrame(rows, URL_EVENT)).collect()}


def test_index_arrivals_is_incremental_and_replay_safe(spark, log, tmp_path):
    body = "<html><head><title>{0}</title></head><body><article><p>" + "Words about {0}, and more words. " * 5 + "</p></article></body></html>"
    schema = S.RAW_PAGE

    def run():
        stream = page_stream(spark, str(log)).withColumn("crawled_at", F.lit(T0).cast("timestamp_ntz"))
        J.index_arrivals(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), hash_embedder(8)).awaitTermination()
        stored = spark.read.schema("url string, vector array<float>, batch_id long").parquet(str(tmp_path / "out"))
        return sorted((r.batch_id, r.url, len(r.vector)) for r in stored.collect())

    add_file(spark, log, "pages1", [(1, "https://a.example/1/", body.format("one"))], schema)
    assert run() == [(0, "https://a.example/1", 8)]
    add_file(spark, log, "pages2", [(2, "https://a.example/2", body.format("two"))], schema)
    assert run() == run() == [(0, "https://a.example/1", 8), (1, "https://a.example/2", 8)]


def test_dedup_across_batches(spark, log, tmp_path):
    add_file(spark, log, "pages1", [(1, "https://a.example/x", ""), (2, "https://A.example/x/?q", "")], S.RAW_PAGE)
    add_file(spark, log, "pages2", [(3, "https://a.example/x#f", ""), (4, "https://a.example/y", "")], S.RAW_PAGE)
    got = follow(J.unseen_urls(page_stream(spark, str(log), files_per_batch=1)), tmp_path)
    assert sorted(r.url for r in got) == ["https://a.example/x", "https://a.example/y"]


def test_bounded_dedup(spark, log, tmp_path):
    add_file(spark, log, "log1", [event(1, "https://a.example/x", 0, "d"), event(2, "https://a.example/x", 5, "d")])
    stream = url_events(spark, log).withColumn("ts", F.col("ts").cast("timestamp"))
    got = follow(J.unseen_urls(stream, ts="ts", horizon="1 minute"), tmp_path)
    assert [r.url for r in got] == ["https://a.example/x"]


def test_rates_emit_closed_windows_only(spark, log, tmp_path):
    rows = [event(i, "A", s, "view") for i, s in enumerate((0, 10, 310, 1000))]
    add_file(spark, log, "log1", rows)
    got = follow(J.windowed_rates(url_events(spark, log), "kind", watermark="10 seconds"), tmp_path)
    assert sorted((r.window_start, r.rate) for r in got) == [(T0, 2 / 300), (T0 + dt.timedelta(minutes=5), 1 / 300)]
