"""Corpus scans, URL forms, fetch-log classes, extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesift.functions import fetch
from pagesift.functions.text import page_text
from pagesift.functions.urls import base_path, base_root, canonical_url, hostname, is_static_asset, resolve_hrefs, same_site, start_url
from pagesift.operators.extract import assemble_pages, extract_links, parse_bodies
from pagesift.operators.urls import dedupe_urls
from pagesift.registry.base import (
    SNIFF_SQL,
    SQL_CONTENT,
    SQL_FETCHES,
    SQL_LINKS,
    canon_sql,
    fetch_log,
    host_sql,
    page_table,
    query,
    root_sql,
)
from pagesift.sources.tables import corpus, table


@query("corpus_scan", f"SELECT page_id, {canon_sql('url')} AS url, CAST(strlen(html) AS BIGINT) AS n_bytes FROM pages")
def corpus_scan(spark, sf):
    return corpus(table(spark, sf, "pages")).select("page_id", "url", "n_bytes")


@query("canonical_urls", f"SELECT page_id, {canon_sql('url')} AS url, {canon_sql('url')} = url AS unchanged FROM pages")
def canonical_urls(spark, sf):
    url = canonical_url(F.col("url"))
    return table(spark, sf, "pages").select("page_id", url.alias("url"), (url == F.col("url")).alias("unchanged"))


_RAW_SEED = "CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '^https?://', '') ELSE url END"


@query(
    "start_urls",
    f"""SELECT page_id, {root_sql("full_url")} AS url FROM (
        SELECT page_id, CASE WHEN regexp_matches(raw, '^https?://') THEN raw ELSE 'https://' || raw END AS full_url
        FROM (SELECT page_id, {_RAW_SEED} AS raw FROM pages))""",
)
def start_urls(spark, sf):
    raw = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", start_url(raw).alias("url"))


@query("resolved_links", f"WITH {SQL_LINKS} SELECT page_id, pos, url FROM lk")
def resolved_links(spark, sf):
    parsed = assemble_pages(table(spark, sf, "pages"))
    page = F.col("url")
    split = parsed.select("page_id", "hrefs", base_root(page).alias("root"), base_path(page).alias("path"))
    return split.select("page_id", F.inline(resolve_hrefs(F.col("hrefs"), F.col("root"), F.col("path"))))


@query("dedupe_urls", f"SELECT min(page_id) AS page_id, url FROM (SELECT page_id, {canon_sql('url')} AS url FROM pages) GROUP BY url")
def dedupe(spark, sf):
    return dedupe_urls(table(spark, sf, "pages"))


@query(
    "same_site_links",
    f"""WITH {SQL_LINKS}, x AS (SELECT page_id, pos, parent, url FROM lk
          UNION ALL SELECT page_id, pos, parent, 'https://other.example' || regexp_extract(url, '^[^/]*//[^/]*(.*)$', 1) FROM lk)
        SELECT page_id, pos, url, {host_sql("url")} AS host, {host_sql("url")} = {host_sql("parent")} AS same_site FROM x""",
)
def same_site_links(spark, sf):
    links = extract_links(table(spark, sf, "pages"))
    outside = F.concat(F.lit("https://other.example"), F.regexp_extract("url", "^[^/]*//[^/]*(.*)$", 1))
    both = links.select("page_id", "pos", "parent", F.explode(F.array("url", outside)).alias("url"))
    same = same_site(F.col("url"), F.col("parent")).alias("same_site")
    return both.select("page_id", "pos", "url", hostname(F.col("url")).alias("host"), same)


# The suffixes again, as SQL takes them.
_ASSETS = "jpg|jpeg|png|gif|webp|avif|svg|ico|heic|woff|woff2|ttf|eot|otf|mp4|mp3|webm|ogg|wav|mov|m3u8|ts|mpd|avi|mkv|m4s|pdf|zip"
_ASSET_URL = "CASE page_id % 3 WHEN 0 THEN {u} || '/logo.png' WHEN 1 THEN {u} || '/clip.m3u8' ELSE {u} END"


@query(
    "asset_filter",
    f"""SELECT page_id, asset_url AS url, regexp_matches(asset_url, '^[^:/?#]+://[^/]*/.*\\.({_ASSETS})$') AS is_asset
        FROM (SELECT page_id, {_ASSET_URL.format(u=canon_sql("url"))} AS asset_url FROM pages)""",
)
def asset_filter(spark, sf):
    url = canonical_url(F.col("url"))
    p = F.col("page_id")
    named = F.when(p % 3 == 0, F.concat(url, F.lit("/logo.png"))).when(p % 3 == 1, F.concat(url, F.lit("/clip.m3u8"))).otherwise(url)
    src = table(spark, sf, "pages").select(p, named.alias("url"))
    return src.select("page_id", "url", is_static_asset(F.col("url")).alias("is_asset"))


_CLASS_SQL = """CASE WHEN http_status = 200 THEN 1 WHEN http_status IN (408, 429, 500, 502, 503, 504) THEN 2
    WHEN http_status IN (400, 401, 411) THEN 3 ELSE 0 END"""


@query("classify_status", f"WITH {SQL_FETCHES} SELECT page_id, http_status, CAST({_CLASS_SQL} AS INTEGER) AS fetch_class FROM fl")
def classify_status(spark, sf):
    return fetch_log(spark, sf).select("page_id", "http_status", fetch.fetch_class(F.col("http_status")).alias("fetch_class"))


@query(
    "status_labels",
    f"""WITH {SQL_FETCHES} SELECT page_id,
        ['fetch impossible', 'fetch ok', 'fetch retry', 'fetch manual'][1 + ({_CLASS_SQL})] AS fetch_label,
        coalesce(['Unknown', 'Queued', 'Processing', 'Done', 'Manual', 'GiveUp', 'Retry'][1 + page_id % 9], 'Unknown') AS crawl_label
        FROM fl""",
)
def status_labels(spark, sf):
    return fetch_log(spark, sf).select(
        "page_id",
        fetch.fetch_label(fetch.fetch_class(F.col("http_status"))).alias("fetch_label"),
        fetch.crawl_label(F.col("page_id") % 9).alias("crawl_label"),
    )


@query(
    "error_reasons",
    f"""WITH {SQL_FETCHES}, r AS (SELECT CASE error_kind WHEN 'dns' THEN 'dns_error' WHEN 'timeout' THEN 'timeout'
          WHEN 'network' THEN 'connection_error' WHEN '' THEN CASE WHEN http_status >= 500 THEN 'http_5xx' END
          ELSE 'parse_error' END AS reason FROM fl)
        SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason""",
)
def error_reasons(spark, sf):
    reasons = F.explode(fetch.error_reasons(F.col("error_kind"), F.col("http_status"))).alias("reason")
    return fetch_log(spark, sf).select(reasons).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "text_gate",
    f"""WITH {SQL_FETCHES}, g AS (SELECT page_id, CASE WHEN nosniff AND content_type <> '' THEN content_type ELSE {SNIFF_SQL} END AS kind FROM fl)
        SELECT page_id, kind, contains(kind, 'text/plain') OR contains(kind, 'text/html') OR contains(kind, 'text/markdown') AS accepted
        FROM g""",
)
def text_gate(spark, sf):
    kind = fetch.effective_content_type(F.col("content_type"), F.col("nosniff"), F.col("body"))
    src = fetch_log(spark, sf).select("page_id", kind.alias("kind"))
    return src.select("page_id", "kind", fetch.is_text(F.col("kind")).alias("accepted"))


@query(
    "spa_detect",
    f"""WITH {SQL_FETCHES} SELECT page_id, contains(body, '<div id="root"') OR contains(body, '<div id="app"')
        OR contains(body, '<div id="__next"') OR contains(body, 'data-reactroot') OR contains(body, 'ng-version')
        OR contains(body, '__NEXT_DATA__') OR contains(body, '__NUXT__') OR contains(body, 'window.__INITIAL_STATE__')
        OR regexp_matches(body, '(?i)<noscript>[^<]*javascript') AS is_spa FROM fl""",
)
def spa_detect(spark, sf):
    return fetch_log(spark, sf).select("page_id", fetch.is_client_rendered(F.col("body")).alias("is_spa"))


@query("extract_links", f"WITH {SQL_LINKS} SELECT page_id, pos, parent, url FROM lk")
def links(spark, sf):
    return extract_links(table(spark, sf, "pages"))


def _assembled(spark, sf):
    return assemble_pages(table(spark, sf, "pages"))


@query("page_titles", f"WITH {SQL_CONTENT} SELECT page_id, title FROM ap")
def page_titles(spark, sf):
    return _assembled(spark, sf).select("page_id", "title")


@query("page_descriptions", f"WITH {SQL_CONTENT} SELECT page_id, description FROM ap")
def page_descriptions(spark, sf):
    return _assembled(spark, sf).select("page_id", "description")


@query("page_content", f"WITH {SQL_CONTENT} SELECT page_id, content FROM ap")
def page_content(spark, sf):
    return parse_bodies(table(spark, sf, "pages").select("page_id", "html")).select("page_id", "content")


@query("assemble_pages", f"WITH {SQL_CONTENT} SELECT page_id, url, title, description, content, n_hrefs FROM ap")
def assembled(spark, sf):
    return _assembled(spark, sf).select(
        "page_id", "url", "title", "description", "content", F.size("hrefs").cast("bigint").alias("n_hrefs")
    )


@query(
    "page_text",
    """SELECT doc_id AS page_id, 'Title: ' || source || '. ' || CASE WHEN lang = 'en' THEN '' ELSE 'Description: ' || lang || '. ' END
       || CASE WHEN text <> '' THEN 'Content: ' || text || '.' ELSE '' END AS page_text FROM documents""",
)
def text_of_pages(spark, sf):
    described = F.when(F.col("description") == "en", F.lit(None)).otherwise(F.col("description"))
    return page_table(spark, sf).select("page_id", page_text(F.col("title"), described, F.col("content")).alias("page_text"))


