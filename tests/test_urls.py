from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagesift.functions import urls as U
from pagesift.operators.urls import dedupe_urls

CANONICAL = [
    ("https://Example.COM/Path/", "https://example.com/Path"),
    ("HTTPS://example.com", "https://example.com"),
    ("https://example.com///", "https://example.com"),
    ("https://user:pw@example.com:8080/a?b=c#d", "https://example.com:8080/a"),
    ("https://u@ser@example.com/a", "https://example.com/a"),
    ("https://example.com/a?", "https://example.com/a"),
    ("https://example.com?x=1", "https://example.com"),
    ("https://example.com#frag", "https://example.com"),
    ("https://example.com:443/a", "https://example.com:443/a"),
    ("https://www.example.com/a//b/", "https://www.example.com/a//b"),
    ("https://example.com/für,", "https://example.com/f%C3%BCr,"),
    ("https://example.com/f%C3%BCr", "https://example.com/f%C3%BCr"),
    ("https://example.com/a%2Fb", "https://example.com/a%2Fb"),
    ("https://example.com/a b", "https://example.com/a%20b"),
    ("https://example.com/a b+c~(d)*", "https://example.com/a%20b+c~%28d%29%2A"),
    ("https://example.com/a!(b)*'", "https://example.com/a!(b)*'"),
    ("https://example.com/ü%2Fx", "https://example.com/%C3%BC/x"),
    ("https://MÜNCHEN.example/x", "https://m%C3%BCnchen.example/x"),
    ("http://[::1]:80/x/", "http://[::1]:80/x"),
    ("https://example.com/q?bad=%zz", "https://example.com/q"),
    ("ftp://example.com/x", "ftp://example.com/x"),
    ("example.com/a", None),
    ("/a/b", None),
    ("//example.com/a", None),
    ("https://", None),
    ("https:///path", None),
    ("mailto:a@example.com", None),
    ("https://exa mple.com/", None),
    ("https://example.com:port/", None),
    ("https://example.com/%zz", None),
    ("https://example.com/%4", None),
    ("https://example.com/a#%zz", None),
    ("https://example.com/a\tb", None),
    ("", None),
    (None, None),
]

BASE = "https://example.com/articles/go"
RESOLVED = [
    ("/next", "https://example.com/next"),
    ("next", "https://example.com/articles/next"),
    ("./next", "https://example.com/articles/next"),
    ("../next", "https://example.com/next"),
    ("../../../next/", "https://example.com/next"),
    ("a/./b/../c", "https://example.com/articles/a/c"),
    ("/a/../b/.", "https://example.com/b"),
    ("?page=2", BASE),
    ("#top", BASE),
    ("next?page=2#x", "https://example.com/articles/next"),
    ("//cdn.example.com/x", "https://cdn.example.com/x"),
    ("http://EXAMPLE.com/X", "http://example.com/X"),
    ("https://example.com/a/../b", "https://example.com/b"),
    ("mailto:a@example.com", None),
    ("javascript:void(0)", None),
    ("1:2", None),
    ("a/1:2", "https://example.com/articles/a/1:2"),
    ("/%zz", None),
    ("/für", "https://example.com/f%C3%BCr"),
    ("...", "https://example.com/articles/..."),
]


def rows(spark, pairs, fn):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(pairs)], "i int, u string").repartition(2)
    return [r[1] for r in sorted(df.select("i", fn(F.col("u"))).collect())]


def test_canonical(spark):
    got = rows(spark, CANONICAL, U.canonical_url)
    assert [(a, g) for (a, _), g in zip(CANONICAL, got, strict=True)] == CANONICAL


def test_canonical_is_idempotent(spark):
    got = rows(spark, CANONICAL, lambda u: U.canonical_url(U.canonical_url(u)))
    assert got == [b for _, b in CANONICAL]


def test_long_url_does_not_overflow(spark):
    url = "https://example.com/" + "%C3%BC" * 20_000 + "/" + "ü" * 20_000
    assert rows(spark, [(url, None)], U.canonical_url) == ["https://example.com/" + "%C3%BC" * 20_000 + "/" + "%C3%BC" * 20_000]


def test_resolve(spark):
    got = rows(spark, RESOLVED, lambda h: U.resolve_url(F.lit(BASE), h))
    assert [(a, g) for (a, _), g in zip(RESOLVED, got, strict=True)] == RESOLVED


def test_resolve_agrees_with_rfc_resolution(spark):
    import itertools
    from urllib.parse import urljoin

    parts = ["a", "..", ".", "b.c", "..."]
    hrefs = ["/".join(p) for n in (1, 2, 3, 4) for p in itertools.product(parts, repeat=n)]
    hrefs += ["/" + h for h in hrefs]
    got = rows(spark, [(h, None) for h in hrefs], lambda h: U.resolve_url(F.lit(BASE), h))
    want = [urljoin(BASE, h).rstrip("/") for h in hrefs]
    assert [(h, g) for h, g in zip(hrefs, got, strict=True)] == list(zip(hrefs, want, strict=True))


def test_resolve_against_trimmed_or_real_directory(spark):
    page = [("b", None)]
    assert rows(spark, page, lambda h: U.resolve_url(F.lit("https://example.com/a"), h)) == ["https://example.com/b"]
    strict = rows(spark, page, lambda h: U.resolve_url(F.lit("https://example.com/a"), h, F.lit("https://example.com/a/")))
    assert strict == ["https://example.com/a/b"]


def test_resolve_against_root(spark):
    assert rows(spark, [("b", None), ("", None)], lambda h: U.resolve_url(F.lit("https://example.com"), h)) == [
        "https://example.com/b",
        "https://example.com",
    ]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("example.com/a", "https://example.com"),
        ("http://Example.com:80/x?y", "http://example.com:80"),
        ("https://u:p@example.com", "https://example.com"),
        ("https:///x", None),
        ("", None),
    ],
)
def test_start_url(spark, raw, expected):
    assert rows(spark, [(raw, None)], U.start_url) == [expected]


def test_same_site(spark):
    pairs = [
        ("https://a.example:80/x", "http://A.example/y", True),
        ("https://www.a.example", "https://a.example", False),
        ("http://[::1]:80/", "http://[::1]/x", True),
    ]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert df.where(U.same_site(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_static_assets(spark):
    cases = [("https://a.example/x/logo.png", True), ("https://a.example/png", False), ("https://a.example/a.png/b", False), ("https://a.png", False)]
    assert rows(spark, cases, U.is_static_asset) == [w for _, w in cases]


def test_dedupe_keeps_smallest_id(spark):
    df = spark.createDataFrame([(7, "https://a.example/x?1"), (3, "https://A.example/x/"), (9, "nope")], "page_id long, url string")
    assert dedupe_urls(df).collect() == [(3, "https://a.example/x")]
