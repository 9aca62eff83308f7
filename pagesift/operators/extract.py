"""HTML pages to page rows and link rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift.functions.html import find_hrefs, parse_html
from pagesift.functions.urls import base_path, base_root, canonical_url, hostname, resolve_hrefs
from pagesift.session import limit_batches

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "timestamp_ntz": pa.timestamp("us")}
_TYPES = {pa.string(): T.StringType(), pa.list_(pa.string()): T.ArrayType(T.StringType())}
_TEXTS = [pa.field(name, pa.string()) for name in ("title", "description", "content")]
_HREFS = pa.field("hrefs", pa.list_(pa.string()))


def _map_bodies(corpus: DataFrame, body: str, fields: list[pa.Field], values: Callable[[str], tuple]) -> DataFrame:
    """Replace the body column by ``fields`` computed from it, one body at a time.

    What is held is one small batch of bodies and what was found in them.
    """
    limit_batches(corpus.sparkSession)
    kept = [f for f in corpus.schema.fields if f.name != body]
    names = [f.name for f in kept]
    arrow_schema = pa.schema([pa.field(f.name, _ARROW[f.dataType.simpleString()]) for f in kept] + fields)
    schema = T.StructType([*kept, *[T.StructField(f.name, _TYPES[f.type]) for f in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = zip(*[values(b.as_py() or "") for b in batch.column(body)], strict=True) if batch.num_rows else [[]] * len(fields)
            columns = [batch.column(n).cast(t) for n, t in zip(names, arrow_schema.types, strict=False)]
            columns += [pa.array(list(column), f.type) for column, f in zip(found, fields, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow_schema)

    return corpus.mapInArrow(run, schema)


def parse_bodies(corpus: DataFrame, body: str = "html") -> DataFrame:
    """Replace the body column by ``title, description, content, hrefs``.

    One map-only pass: each body is parsed once and never leaves its task. The
    other columns ride along unchanged and must be long, int, string or timestamp.
    """
    return _map_bodies(corpus, body, [*_TEXTS, _HREFS], parse_html)


def hrefs_in(corpus: DataFrame, body: str = "html") -> DataFrame:
    """Replace the body column by ``hrefs`` alone."""
    return _map_bodies(corpus, body, [_HREFS], lambda text: (find_hrefs(text),))


def without_site_name(title: Column) -> Column:
    """Cut a trailing site name such as ``Article | Site`` when enough title remains."""
    head = F.regexp_replace(title, r"\s[|\-–—»/>]\s[^|\-–—»/>]*$", "")
    return F.when(F.size(F.split(head, " ")) >= 3, head).otherwise(title)


def assemble_pages(corpus: DataFrame, url: str = "url", body: str = "html", strip_site_name: bool = False) -> DataFrame:
    """Page rows with their raw hrefs: ``url`` is the canonical *final* URL.

    Rows whose URL is not absolute are dropped. Store the result once and derive
    pages and links from it; the parse is the expensive part.
    """
    src = corpus.withColumn(url, canonical_url(F.col(url))).where(F.col(url).isNotNull())
    out = parse_bodies(src, body)
    return out.withColumn("title", without_site_name(F.col("title"))) if strip_site_name else out


def links_of(assembled: DataFrame, url: str = "url", id_col: str = "page_id", strict_base: str | None = None) -> DataFrame:
    """Same-site links in document order, duplicates kept: ``(page_id, pos, parent, url)``."""
    page = F.col(url)
    taken_apart = assembled.select(
        id_col,
        page.alias("parent"),
        "hrefs",
        base_root(page).alias("_root"),
        base_path(F.col(strict_base) if strict_base else page).alias("_path"),
        hostname(page).alias("_host"),
    )
    links = resolve_hrefs(F.col("hrefs"), F.col("_root"), F.col("_path"), F.col("_host"))
    return taken_apart.select(id_col, "parent", F.inline(links)).select(id_col, "pos", "parent", "url")


def extract_links(corpus: DataFrame, url: str = "url", body: str = "html", id_col: str = "page_id") -> DataFrame:
    """Link rows straight from bodies, when the page text itself is not wanted."""
    src = corpus.select(id_col, canonical_url(F.col(url)).alias("url"), F.col(body).alias("html"))
    return links_of(hrefs_in(src.where(F.col("url").isNotNull())), id_col=id_col)


