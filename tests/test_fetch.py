from __future__ import annotations

from pyspark.sql import functions as F

from pagesift import schemas as S
from pagesift.functions import fetch

HTML = "\n\t<!DOCTYPE html>\n<html><head><title>T</title></head><body><h1>H</h1></body></html>"
PLAIN = "\n\tLorem ipsum dolor sit amet, consectetur adipiscing elit.\n"


def apply(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").repartition(2)
    return [r[1] for r in sorted(df.select("i", fn(F.col("v"))).collect())]


def test_status_classes(spark):
    expected = {
        200: S.FETCH_OK,
        **dict.fromkeys([201, 204, 301, 304, 308, 403, 404, 410, 501, 505], S.FETCH_IMPOSSIBLE),
        **dict.fromkeys([408, 429, 500, 502, 503, 504], S.FETCH_RETRY),
        **dict.fromkeys([400, 401, 411], S.FETCH_MANUAL),
    }
    assert apply(spark, list(expected), "int", fetch.fetch_class) == list(expected.values())


def test_labels(spark):
    assert apply(spark, [0, 1, 2, 3, 4, None], "int", fetch.fetch_label) == [
        "fetch impossible", "fetch ok", "fetch retry", "fetch manual", "unknown fetch status", "unknown fetch status",
    ]
    assert apply(spark, [0, 1, 2, 3, 4, 5, 6, 7], "int", fetch.crawl_label) == [
        "Unknown", "Queued", "Processing", "Done", "Manual", "GiveUp", "Retry", "Unknown",
    ]


def test_error_reasons(spark):
    assert apply(spark, ["dns", "timeout", "network", "not_text", "bad_url", "", None], "string", fetch.error_reason) == [
        "dns_error", "timeout", "connection_error", "parse_error", "parse_error", None, None,
    ]


def test_content_type_by_header_or_body(spark):
    cases = [
        ("text/html", False, HTML, "text/html"),
        (None, None, HTML, "text/html"),
        ("text/plain", False, HTML, "text/html"),
        ("text/plain", False, PLAIN, "text/plain"),
        ("", True, PLAIN, "text/plain"),
        ("text/csv", False, PLAIN, "text/plain"),
        ("text/csv", True, PLAIN, "text/csv"),
        ("text/markdown; charset=utf-8", True, HTML, "text/markdown; charset=utf-8"),
        ("", False, "<?xml version='1.0'?>", "text/xml"),
        ("", False, "%PDF-1.7", "application/pdf"),
        ("", False, "<hello>", "text/plain"),
        ("", False, "<p>", "text/html"),
        ("", False, "<pre>", "text/plain"),
        ("", False, "<!-- c -->", "text/html"),
        ("", False, "a\x00b", "application/octet-stream"),
        ("", False, "é" * 600, "text/plain"),
        ("", False, " " * 600 + "<html>", "text/plain"),
        ("", False, "", "text/plain"),
    ]
    df = spark.createDataFrame(cases, "t string, n boolean, b string, want string")
    wrong = df.where(fetch.effective_content_type(F.col("t"), F.col("n"), F.col("b")) != F.col("want"))
    assert wrong.collect() == []


def test_text_gate(spark):
    assert apply(spark, ["text/html", "text/plain", "text/markdown; x", "text/csv", "image/png"], "string", fetch.is_text) == [
        True, True, True, False, False,
    ]


def test_client_rendered(spark):
    yes = [
        '<div id="root"></div>', '<div id="app">', '<div id="__next">', "<div data-reactroot>", '<app ng-version="1">',
        "x __NEXT_DATA__ y", "window.__NUXT__={}", "window.__INITIAL_STATE__", "<NOSCRIPT>You need JavaScript</NOSCRIPT>",
    ]
    no = [HTML, "<noscript><b>javascript</b></noscript>", '<div id="rooted">', '<DIV ID="root">']
    assert apply(spark, yes + no, "string", fetch.is_client_rendered) == [True] * len(yes) + [False] * len(no)
