from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift import schemas as S
from pagesift.operators import frontier as Q
from pagesift.plans.crawl import CrawlTables, apply_changes, replay_crawl, settle_batch

NOW = 1_000_000
URLS = [c * n for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for n in (1, 2, 3)]


def row(url, status=S.QUEUED, worker="", tries=0, taken=-1, retry_at=-1, parent="", rnd=0, seq=0, pos=0):
    return (url, status, worker, tries, taken, retry_at, parent, rnd, seq, pos)


def state_of(spark, *rows):
    return spark.createDataFrame(list(rows), S.URL_STATE)


def candidates(spark, *rows):
    return spark.createDataFrame([(u, p, i) for i, (u, p) in enumerate(rows)], "url string, parent string, seq long")


def by_url(df):
    return {r.url: r for r in df.collect()}


def test_push_once(spark):
    empty = Q.empty_state(spark)
    urls = candidates(spark, *[(u, "") for u in URLS])
    pushed = Q.push_urls(empty, urls, 0)
    assert pushed.count() == len(URLS) == 78
    assert Q.push_urls(pushed, urls, 1).count() == 0


def test_first_occurrence_fixes_parent(spark):
    got = by_url(Q.push_urls(Q.empty_state(spark), candidates(spark, ("A", "p1"), ("A", "p2"), ("B", "p2")), 3))
    assert tuple(got["A"]) == row("A", parent="p1", rnd=3, seq=0)
    assert got["B"].parent == "p2"


def test_any_known_state_blocks_a_push(spark):
    state = state_of(spark, *[row(f"U{i}", status=i) for i in range(7)])
    assert Q.push_urls(state, candidates(spark, *[(f"U{i}", "") for i in range(8)]), 1).collect()[0].url == "U7"


def test_order_holds_for_large_page_ids(spark):
    far = 1 << 44
    rows = [("A", "p2", far + 1, 5), ("A", "p1", far + 1, (1 << 20) + 7), ("B", "p3", far, 1 << 21), ("B", "p4", far + 1, 0)]
    got = by_url(Q.push_urls(Q.empty_state(spark), spark.createDataFrame(rows, "url string, parent string, seq long, pos long"), 1))
    assert {u: (r.parent, r.enqueue_seq, r.enqueue_pos) for u, r in got.items()} == {"A": ("p2", far + 1, 5), "B": ("p3", far, 1 << 21)}


def test_backoff_saturates(spark):
    state = state_of(spark, *[row(f"U{t}", S.PROCESSING, tries=t) for t in (0, 10, 49, 50, 60, 2000)])
    got = by_url(Q.schedule_retries(state, state.select("url"), NOW, try_limit=-1, base_ms=5000))
    assert {u: r.retry_at for u, r in got.items()} == {
        "U0": NOW + 5000, "U10": NOW + 5000 * 1024, "U49": NOW + 5000 * (1 << 49), "U50": Q.MAX_TIME, "U60": Q.MAX_TIME, "U2000": Q.MAX_TIME
    }


def test_every_transition_gives_one_row_per_url(spark):
    state = state_of(spark, row("A", S.PROCESSING), row("B", S.RETRY, retry_at=5))
    outcomes = spark.createDataFrame([("A", 1, S.DONE), ("A", 2, S.MANUAL)], "url string, seq long, new_status int")
    assert [r.status for r in Q.mark_processed(state, outcomes).collect()] == [S.MANUAL]
    queue = spark.createDataFrame([("B", 5), ("B", 3), ("X", 4), ("X", 4)], "url string, retry_at long")
    assert {r.url: r.enqueue_seq for r in Q.release_due(state, NOW, 1, queue).collect()} == {"B": 3, "X": 4}
    kind = "url string, seq long, http_status int, error_kind string, extract_failed boolean, store_error string"
    fetches = spark.createDataFrame([("A", 1, 200, "", False, ""), ("A", 3, 404, "", False, ""), ("A", 2, 200, "", False, "")], kind)
    assert [(r.url, r.new_status) for r in Q.crawl_outcomes(state, fetches, NOW).collect()] == [("A", S.GIVE_UP)]


def test_retry_backoff_and_limit(spark):
    state = state_of(spark, *[row(f"U{i}", status=S.PROCESSING, tries=i) for i in range(5)])
    failed = state.select("url")
    got = by_url(Q.schedule_retries(state, failed, NOW, try_limit=3, base_ms=100))
    assert [(got[f"U{i}"].status, got[f"U{i}"]["try"], got[f"U{i}"].retry_at) for i in range(5)] == [
        (S.RETRY, 1, NOW + 100), (S.RETRY, 2, NOW + 200), (S.RETRY, 3, NOW + 400), (S.GIVE_UP, 3, -1), (S.GIVE_UP, 4, -1),
    ]
    unlimited = by_url(Q.schedule_retries(state, failed, NOW, try_limit=-1, base_ms=100))
    assert unlimited["U4"].retry_at == NOW + 1600


def test_unknown_urls_are_rejected(spark):
    state = state_of(spark, row("A"))
    wanted = spark.createDataFrame([("A",), ("X",)], "url string")
    assert Q.schedule_retries(state, wanted, NOW).count() == 1
    assert [r.url for r in Q.unknown_urls(state, wanted).collect()] == ["X"]


def test_release_due_is_inclusive_and_idempotent(spark):
    state = state_of(spark, row("URL1", S.RETRY, tries=1, retry_at=NOW), row("URL2", S.RETRY, tries=1, retry_at=NOW + 1))
    due = Q.release_due(state, NOW, 1)
    assert [(r.url, r.status, r["try"], r.retry_at) for r in due.collect()] == [("URL1", S.QUEUED, 1, NOW)]
    assert Q.retries_left(state, NOW).collect()[0].remaining == 1
    after = Q.replace_rows(state, due)
    assert Q.release_due(after, NOW, 2).count() == 0
    later = Q.replace_rows(after, Q.release_due(after, NOW + 1, 2))
    assert Q.retries_left(later, NOW + 1).collect()[0].remaining == 0


def test_release_orphan(spark):
    queue = spark.createDataFrame([("X", NOW - 5)], "url string, retry_at long")
    got = Q.release_due(Q.empty_state(spark), NOW, 4, queue).collect()
    assert [tuple(r) for r in got] == [row("X", tries=1, rnd=4, seq=NOW - 5)]


def test_mark_terminal(spark):
    state = state_of(spark, row("A", S.PROCESSING), row("B", S.PROCESSING), row("C", S.PROCESSING))
    outcomes = spark.createDataFrame([("A", S.DONE), ("B", S.GIVE_UP), ("C", S.MANUAL), ("NO", S.DONE)], "url string, new_status int")
    got = by_url(Q.mark_processed(state, outcomes))
    assert {u: r.status for u, r in got.items()} == {"A": S.DONE, "B": S.GIVE_UP, "C": S.MANUAL}


@pytest.mark.parametrize(("age", "recovered"), [(14_999, 0), (15_000, 1), (20_000, 1)])
def test_sweep_threshold(spark, age, recovered):
    state = state_of(spark, row("A", S.PROCESSING, "w1", 2, NOW - age, -1, "p"))
    got = Q.sweep_stale(state, NOW, 1).collect()
    assert len(got) == recovered
    if recovered:
        assert (got[0].status, got[0]["try"], got[0].parent) == (S.QUEUED, 2, "p")


def test_sweep_many_and_orphans(spark):
    state = state_of(spark, *[row(u, S.PROCESSING, taken=0) for u in URLS])
    assert Q.sweep_stale(state, NOW, 1).count() == 78
    assert Q.sweep_stale(Q.empty_state(spark), NOW, 1).count() == 0
    flying = spark.createDataFrame([("ORPHAN",)], "url string")
    assert [tuple(r) for r in Q.sweep_stale(state, NOW, 2, in_flight=flying).collect()] == [row("ORPHAN", rnd=2, seq=-1)]


def test_summary(spark):
    state = state_of(spark, row("A"), row("B", S.PROCESSING), row("C", S.RETRY, retry_at=NOW + 7), row("D", S.RETRY, retry_at=NOW + 9), row("E", S.DONE, retry_at=1))
    assert tuple(Q.crawl_metadata(state).collect()[0]) == (4, NOW + 7)
    assert tuple(Q.queue_depths(state).collect()[0]) == (1, 2)
    done = state_of(spark, row("E", S.DONE))
    assert tuple(Q.crawl_metadata(done).collect()[0]) == (0, None)


def test_outcomes(spark):
    cases = {
        "ok": (200, "", False, "", 0, S.DONE, "ok"),
        "net": (200, "network", False, "", 0, S.GIVE_UP, "give_up"),
        "401": (401, "", False, "", 0, S.MANUAL, "manual"),
        "404": (404, "", False, "", 0, S.GIVE_UP, "impossible"),
        "503": (503, "", False, "", 0, S.RETRY, "retry"),
        "503last": (503, "", False, "", 1, S.GIVE_UP, "give_up"),
        "extract": (200, "", True, "", 0, S.GIVE_UP, "give_up"),
        "fatal": (200, "", False, "fatal", 0, S.GIVE_UP, "give_up"),
        "transient": (200, "", False, "transient", 0, S.PROCESSING, None),
    }
    state = state_of(spark, *[row(u, S.PROCESSING, tries=c[4]) for u, c in cases.items()])
    fetches = spark.createDataFrame([(u, *c[:4]) for u, c in cases.items()], "url string, http_status int, error_kind string, extract_failed boolean, store_error string")
    got = by_url(Q.crawl_outcomes(state, fetches, NOW, try_limit=1, base_ms=50))
    assert {u: (r.new_status, r.outcome) for u, r in got.items()} == {u: c[5:] for u, c in cases.items()}
    assert got["503"].retry_at == NOW + 50 and got["503"]["try"] == 1
    kind = Q.crawl_outcomes(state, fetches, NOW, try_limit=1, retry_transport=True)
    assert by_url(kind)["net"].outcome == "retry"


def test_seed_and_reset(spark):
    seeds = spark.createDataFrame([("Example.com/a", 0), ("https://example.com", 1), ("https://", 2)], "raw string, seq long")
    state = Q.seed_frontier(Q.empty_state(spark), seeds, 0)
    assert [(r.url, r.enqueue_seq) for r in state.collect()] == [("https://example.com", 0)]
    assert Q.seed_frontier(state, seeds, 1).count() == 0
    assert Q.seed_frontier(Q.empty_state(spark), seeds, 1).count() == 1


def test_replay(spark):
    def body(*hrefs):
        return "<article>" + "".join(f'<a href="{h}">x</a>' for h in hrefs) + "</article>"

    pages = [
        (1, "https://a.example", body("/about", "/about", "/about", "https://b.example/x", "#top")),
        (2, "https://a.example/about/", body("/deep", "/", "/missing")),
        (3, "https://a.example/deep", body("/about")),
        (4, "https://a.example/unreached", body("/deep")),
        (5, "https://b.example/x", body("/y")),
    ]
    corpus = spark.createDataFrame(pages, "page_id long, url string, html string")
    seeds = spark.createDataFrame([("a.example/start", 0)], "raw string, seq long")
    got = by_url(replay_crawl(corpus, seeds))
    assert {u: (r.status, r.parent, r.enqueue_round) for u, r in got.items()} == {
        "https://a.example": (S.DONE, "", 0),
        "https://a.example/about": (S.DONE, "https://a.example", 1),
        "https://a.example/deep": (S.DONE, "https://a.example/about", 2),
        "https://a.example/missing": (S.GIVE_UP, "https://a.example/about", 2),
    }
    assert replay_crawl(corpus, seeds, max_rounds=1).count() == 2


def test_state_json_round_trip(spark):
    state = state_of(spark, row("A", S.RETRY, "w", 2, 5, 9, "p"))
    fields = [f.name for f in S.URL_STATE_JSON.fields]
    text = state.select(F.to_json(F.struct(*fields)).alias("j"))
    assert text.collect()[0].j == '{"status":6,"worker_id":"w","take_on_at":5,"try":2,"retry_at":9,"parent":"p"}'
    back = text.select(F.from_json("j", S.URL_STATE_JSON).alias("s")).select("s.*")
    assert tuple(back.collect()[0]) == (6, "w", 5, 2, 9, "p")


def fetched(spark, *rows):
    """(url, final_url or None, status, body), later ones with a higher seq"""
    full = [(u, f, st, "text/html", False, "", b, i) for i, (u, f, st, b) in enumerate(rows)]
    return spark.createDataFrame(full, T.StructType([*S.FETCH_RECORD.fields, T.StructField("seq", T.LongType())]))


def start(spark, *urls, tries=0):
    state = state_of(spark, *[row(u, S.PROCESSING, tries=tries) for u in urls])
    return CrawlTables(state, spark.createDataFrame([], S.PAGE), spark.createDataFrame([], S.LINK))


def page_body(*hrefs):
    text = "Some article text that is long enough, with a comma, to be taken as content. " * 3
    return f"<html><head><title>T</title></head><body><article><p>{text}</p>" + "".join(f'<a href="{h}">x</a>' for h in hrefs) + "</article></body></html>"


def step(tables, *args, **kwargs):
    return apply_changes(tables, settle_batch(tables, *args, **kwargs))


SITE = "https://a.example"


def statuses(tables):
    return {r.url.removeprefix(SITE): r.status for r in tables.state.collect()}


def test_batch_stores_pages_and_queues_links(spark):
    home = fetched(spark, (SITE, None, 200, page_body("/1", "/2", "/3", "https://b.example/x", "https://c.example/")))
    first = step(start(spark, SITE), home, NOW, 1)
    assert statuses(first) == {"": S.DONE, "/1": S.QUEUED, "/2": S.QUEUED, "/3": S.QUEUED}
    page = first.pages.collect()[0]
    assert (page.url, page.title, page.vector, page.can_be_vectorized) == (SITE, "T", None, True)
    assert first.links.count() == 0
    rest = fetched(spark, *[(f"{SITE}/{i}", None, 200, page_body("/")) for i in (1, 2, 3)])
    second = step(first, rest, NOW, 3)
    assert set(statuses(second).values()) == {S.DONE}
    assert second.pages.count() == 4
    ids = {r.url: r.page_id for r in second.pages.collect()}
    assert sorted(tuple(r) for r in second.links.collect()) == sorted((ids[SITE], ids[f"{SITE}/{i}"]) for i in (1, 2, 3))


def test_batch_retries_then_gives_up(spark):
    records = fetched(spark, (SITE, None, 503, None), (SITE + "/gone", None, 404, None))
    first = step(start(spark, SITE, SITE + "/gone"), records, NOW, 1, try_limit=1, base_ms=50)
    assert statuses(first) == {"": S.RETRY, "/gone": S.GIVE_UP}
    waiting = first.state.where("status = 6").collect()[0]
    assert (waiting["try"], waiting.retry_at) == (1, NOW + 50)
    late = step(first, records, NOW + 50, 5, try_limit=1, base_ms=50)
    assert statuses(late) == {"": S.GIVE_UP, "/gone": S.GIVE_UP}


def test_batch_takes_the_latest_record_and_queues_links_once(spark):
    records = fetched(spark, (SITE, None, 404, None), (SITE, None, 200, page_body("/about", "/about", "https://x.example/a", "//y.example")))
    got = step(start(spark, SITE), records, NOW, 1)
    assert statuses(got) == {"": S.DONE, "/about": S.QUEUED}
    got = step(start(spark, SITE), fetched(spark, (SITE, None, 200, page_body("/a")), (SITE, None, 404, None)), NOW, 1)
    assert statuses(got) == {"": S.GIVE_UP} and got.pages.count() == 0


def test_batch_redirect_gate_and_client_rendered_pages(spark):
    app = '<html><body><div id="root"></div></body></html>'
    records = fetched(spark, (SITE + "/a", SITE + "/b/", 200, page_body("/c", "d", "../e")), (SITE + "/pdf", None, 200, "%PDF-1.7"), (SITE + "/app", None, 200, app), ("https://unknown.example", None, 200, app))
    got = step(start(spark, SITE + "/a", SITE + "/pdf", SITE + "/app", SITE + "/unread"), records, NOW, 1)
    assert statuses(got) == {"/a": S.DONE, "/pdf": S.GIVE_UP, "/app": S.MANUAL, "/unread": S.PROCESSING, "/c": S.QUEUED, "/d": S.QUEUED, "/e": S.QUEUED}
    assert [r.url for r in got.pages.collect()] == [SITE + "/b"]
    assert {r.parent for r in got.state.where(F.col("status") == S.QUEUED).collect()} == {SITE + "/b"}


def test_reset_and_seed(spark):
    seeds = spark.createDataFrame([("a.example/x", 0), ("A.example", 1)], "raw string, seq long")
    assert [(r.url, r.status, r.enqueue_round) for r in Q.reset_and_seed(state_of(spark, row("D", S.DONE)), seeds, 4).collect()] == [(SITE, S.QUEUED, 4)]
