"""Registration, shared derived tables, and their SQL twins.

The given tables have no fetch log, page table or URL state, so those are derived
from whole given tables by plain column arithmetic, once in Spark and once in SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift import schemas as S
from pagesift.functions.urls import canonical_url
from pagesift.operators.urls import dedupe_urls
from pagesift.session import ship_package
from pagesift.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NOW = 1_704_067_200_000  # 2024-01-01T00:00:00Z, the fixed "now" of every query
CHUNK_BYTES = 8_000  # for chunk numbers and the report of large texts only; what is embedded is bounded by the operators' own limit


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        @wraps(run)
        def shipped(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return run(spark, folder)

        QUERIES[name] = shipped
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


# --- SQL fragments --------------------------------------------------------------------

_ABS = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"
_KEEP = {"%2F": "/", "%24": "$", "%26": "&", "%2B": "+", "%2C": ",", "%3A": ":", "%3B": ";", "%3D": "=", "%40": "@"}


def canon_sql(url: str) -> str:
    path = f"rtrim(regexp_extract({url}, '{_ABS}', 3), '/')"
    encoded = f"url_encode(url_decode(replace({path}, '+', '%2B')))"
    for code, char in _KEEP.items():
        encoded = f"replace({encoded}, '{code}', '{char}')"
    plain = "^[A-Za-z0-9._~!$&''()*+,;=:@/%\\[\\]-]*$"
    path = f"CASE WHEN regexp_matches({path}, '{plain}') THEN {path} ELSE {encoded} END"
    return f"({root_sql(url)} || {path})"


def root_sql(url: str) -> str:
    host = f"lower(regexp_replace(regexp_extract({url}, '{_ABS}', 2), '^.*@', ''))"
    return f"(lower(regexp_extract({url}, '{_ABS}', 1)) || '://' || {host})"


def host_sql(url: str) -> str:
    return f"regexp_replace(lower(regexp_replace(regexp_extract({url}, '{_ABS}', 2), '^.*@', '')), ':[0-9]*$', '')"


def checksum_sql(vector: str) -> str:
    """Position-weighted sum of a vector."""
    return f"list_sum(list_transform(range(1, len({vector}) + 1), lambda i: CAST({vector}[i] AS DOUBLE) * i))"


def norm_sql(vector: str) -> str:
    return f"sqrt(list_sum(list_transform({vector}, lambda x: CAST(x AS DOUBLE) * x)))"


SQL_CANONICAL = f"""
cp AS (SELECT min(page_id) AS page_id, url FROM (SELECT page_id, {canon_sql("url")} AS url FROM pages) GROUP BY url)"""

SQL_LINKS = f"""
hrefs AS (
  SELECT page_id, parent, unnest(found) AS href, unnest(range(len(found))) AS pos
  FROM (SELECT page_id, {canon_sql("url")} AS parent,
               regexp_extract_all(html, '<a href="([^"]*)"', 1) AS found FROM pages)),
lk AS (
  SELECT page_id, CAST(pos AS INTEGER) AS pos, parent, {canon_sql("full_url")} AS url
  FROM (SELECT page_id, pos, parent, regexp_extract(parent, '^[^/]*//[^/]*') || href AS full_url FROM hrefs))"""

def unescape_sql(text: str) -> str:
    """The character references that occur in the given pages; the oldest names need no semicolon in text."""
    for entity, char in {"&lt;?": "<", "&gt;?": ">", "&quot;?": '"', "&#x27;": "''", "&#39;": "''", "&amp;?": "&"}.items():
        text = f"regexp_replace({text}, '{entity}', '{char}', 'g')"
    return text


def line_sql(text: str) -> str:
    return f"trim(regexp_replace({unescape_sql(text)}, '\\s+', ' ', 'g'))"


SQL_CONTENT = f"""
body_lines AS (
  SELECT page_id, {canon_sql("url")} AS url,
    {line_sql("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title,
    list_filter(list_transform(
      regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>|<br>'),
      lambda s: {line_sql("regexp_replace(s, '<[^>]*>', '', 'g')")}), lambda s: s <> '') AS lines,
    len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS n_hrefs
  FROM pages),
ap AS (
  SELECT page_id, url, title, lines[2] AS description, array_to_string(lines, chr(10)) AS content,
         CAST(n_hrefs AS BIGINT) AS n_hrefs
  FROM body_lines)"""

SQL_PAGE_TABLE = f"""
pt AS (
  SELECT d.doc_id AS page_id, 'https://docs.example.com/' || d.source || '/' || d.doc_id AS url, d.source AS title,
         d.lang AS description, d.text AS content,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(d.doc_id * 60) AS crawled_at,
         e.embedding AS vector, strlen(d.text) <= {S.MAX_CHUNK_BYTES} AS can_be_vectorized
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""

SQL_STATE = f"""{SQL_CANONICAL},
st AS (
  SELECT url, CAST(page_id % 7 AS INTEGER) AS status,
         CASE WHEN page_id % 7 = 2 THEN 'w' || (page_id % {S.WORKERS}) ELSE '' END AS worker_id,
         CAST(page_id % 6 AS INTEGER) AS try,
         CASE WHEN page_id % 7 = 2 THEN {NOW} - (page_id % 40) * 1000 ELSE -1 END AS take_on_at,
         CASE WHEN page_id % 7 = 6 THEN {NOW} + (page_id % 21 - 10) * 1000 ELSE -1 END AS retry_at,
         '' AS parent, CAST(0 AS BIGINT) AS enqueue_round, page_id AS enqueue_seq, CAST(0 AS BIGINT) AS enqueue_pos
  FROM cp)"""

SQL_FETCHES = f"""
fl AS (
  SELECT page_id, {canon_sql("url")} AS url,
    CAST(CASE page_id % 10 WHEN 4 THEN 500 WHEN 5 THEN 429 WHEN 6 THEN 301 WHEN 7 THEN 404 WHEN 8 THEN 503 WHEN 9 THEN 401 ELSE 200 END AS INTEGER) AS http_status,
    CASE page_id % 11 WHEN 3 THEN 'dns' WHEN 5 THEN 'timeout' WHEN 7 THEN 'network' WHEN 9 THEN 'not_text' ELSE '' END AS error_kind,
    CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'text/html; charset=utf-8' WHEN 2 THEN 'text/markdown' ELSE 'image/png' END AS content_type,
    page_id % 3 = 0 AS nosniff,
    CASE page_id % 5 WHEN 0 THEN html WHEN 1 THEN regexp_replace(html, '<[^>]*>', '', 'g')
         WHEN 2 THEN '%PDF-1.7 ' || html WHEN 3 THEN replace(html, '<article>', '<div id="root"></div><article>')
         ELSE replace(html, '</body>', '<noscript>Please enable JavaScript</noscript></body>') END AS body
  FROM pages)"""


SNIFF_SQL = """CASE WHEN regexp_matches(body, '(?i)^[\\t\\n\\f\\r ]*<(!DOCTYPE HTML|HTML)[ >]') THEN 'text/html'
  WHEN starts_with(body, '%PDF-') THEN 'application/pdf' WHEN starts_with(body, 'BM') THEN 'image/bmp'
  WHEN regexp_matches(body, '^[\\x{0000}-\\x{FFFF}]{34}LP') THEN 'application/vnd.ms-fontobject' ELSE 'text/plain' END"""


# --- the same tables in Spark -----------------------------------------------------------


def canonical_pages(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe_urls(table(spark, sf, "pages"))


def page_table(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return docs.join(vectors, "doc_id", "left").select(
        F.col("doc_id").alias("page_id"),
        doc_url().alias("url"),
        F.col("source").alias("title"),
        F.col("lang").alias("description"),
        F.col("text").alias("content"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id * 60)").alias("crawled_at"),
        "vector",
        (F.octet_length("text") <= S.MAX_CHUNK_BYTES).alias("can_be_vectorized"),
    )


def doc_url(source: str = "source", doc_id: str = "doc_id") -> Column:
    return F.concat(F.lit("https://docs.example.com/"), F.col(source), F.lit("/"), F.col(doc_id).cast("string"))


def url_state(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("page_id")
    return canonical_pages(spark, sf).select(
        "url",
        (p % 7).cast("int").alias("status"),
        F.when(p % 7 == 2, F.concat(F.lit("w"), (p % S.WORKERS).cast("string"))).otherwise("").alias("worker_id"),
        (p % 6).cast("int").alias("try"),
        F.when(p % 7 == 2, F.lit(NOW) - (p % 40) * 1000).otherwise(F.lit(-1)).cast("bigint").alias("take_on_at"),
        F.when(p % 7 == 6, F.lit(NOW) + (p % 21 - 10) * 1000).otherwise(F.lit(-1)).cast("bigint").alias("retry_at"),
        F.lit("").alias("parent"),
        F.lit(0).cast("bigint").alias("enqueue_round"),
        p.alias("enqueue_seq"),
        F.lit(0).cast("bigint").alias("enqueue_pos"),
    )


def fetch_log(spark: SparkSession, sf: str) -> DataFrame:
    p, html = F.col("page_id"), F.col("html")

    def pick(key: Column, values: dict[int, object], default: object) -> Column:
        chain = F.lit(default) if not isinstance(default, Column) else default
        for k, v in values.items():
            chain = F.when(key == k, v if isinstance(v, Column) else F.lit(v)).otherwise(chain)
        return chain

    return table(spark, sf, "pages").select(
        p,
        canonical_url(F.col("url")).alias("url"),
        pick(p % 10, {4: 500, 5: 429, 6: 301, 7: 404, 8: 503, 9: 401}, 200).alias("http_status"),
        pick(p % 11, {3: "dns", 5: "timeout", 7: "network", 9: "not_text"}, "").alias("error_kind"),
        pick(p % 4, {0: "", 1: "text/html; charset=utf-8", 2: "text/markdown"}, "image/png").alias("content_type"),
        (p % 3 == 0).alias("nosniff"),
        pick(
            p % 5,
            {
                0: html,
                1: F.regexp_replace(html, "<[^>]*>", ""),
                2: F.concat(F.lit("%PDF-1.7 "), html),
                3: F.replace(html, F.lit("<article>"), F.lit('<div id="root"></div><article>')),
            },
            F.replace(html, F.lit("</body>"), F.lit("<noscript>Please enable JavaScript</noscript></body>")),
        ).alias("body"),
    )


def vectors_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("page_id"), F.col("embedding").alias("vector"), "label")


def checksum(vector: str | Column = "vector") -> Column:
    """Position-weighted sum of a vector, to compare whole vectors as one number."""
    cell = F.zip_with(vector, F.sequence(F.lit(1), F.size(vector)), lambda x, i: x.cast("double") * i)
    return F.when(F.size(vector) > 0, F.round(F.aggregate(cell, F.lit(0.0), lambda a, x: a + x), 5))
