"""The pages table: lookups, upsert, vector write-back, backlog, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagesift.functions.vectors import l2_normalize
from pagesift.session import written

_TEXT = ["title", "description", "content"]
_PAGE = ["url", *_TEXT, "crawled_at", "vector"]


def get_pages(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``pages`` for the URLs in ``wanted(url)``; missing text reads as ''."""
    keys = wanted.select("url").distinct()
    found = pages.select(_PAGE).join(keys, "url", "left_semi")
    return found.select("url", *[F.coalesce(c, F.lit("")).alias(c) for c in _TEXT], "crawled_at", "vector")


def get_page(pages: DataFrame, url: str) -> DataFrame:
    """One page by URL, as a filter that reaches the scan."""
    return pages.where(F.col("url") == F.lit(url)).select(
        "url", *[F.coalesce(c, F.lit("")).alias(c) for c in _TEXT], "crawled_at", "vector"
    )


def pages_exist(pages: DataFrame, probes: DataFrame) -> DataFrame:
    """``(url, exists)`` for every distinct probe URL."""
    asked = probes.select("url").distinct()
    known = pages.select("url").join(asked, "url", "left_semi").distinct()
    return asked.join(known.withColumn("known", F.lit(True)), "url", "left").select(
        "url", F.coalesce("known", F.lit(False)).alias("exists")
    )


def changed_pages(existing: DataFrame, updates: DataFrame, version: str = "version") -> DataFrame:
    """The page rows that ``updates`` write: every non-key column overwritten by URL.

    Among several updates of one URL the highest ``version`` wins. Existing pages
    keep their id; new pages get a hash of their URL. Updates carry no page_id.
    ``row_number() = 1`` is limited per task before the exchange, so a URL that
    is updated over and over does not pile up in one task. Of the existing table
    only the two key columns are read.
    """
    newest = Window.partitionBy("url").orderBy(F.col(version).desc())
    latest = updates.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn", version)
    ids = existing.select("url", "page_id")
    rows = latest.join(ids, "url", "left").select(
        F.coalesce("page_id", F.xxhash64("url")).alias("page_id"),
        "url",
        *_TEXT,
        "crawled_at",
        F.when(F.size("vector") > 0, l2_normalize(F.col("vector"))).alias("vector"),
        (~F.coalesce(F.size("vector") == 0, F.lit(False))).alias("can_be_vectorized"),
    )
    return rows.select(*[F.col(c).cast(existing.schema[c].dataType).alias(c) for c in rows.columns])


def replace_pages(existing: DataFrame, changed: DataFrame) -> DataFrame:
    """The pages table with ``changed`` rows in place of the old ones of the same URL."""
    return existing.join(changed.select("url"), "url", "left_anti").select(changed.columns).unionByName(changed)


def upsert_pages(existing: DataFrame, updates: DataFrame, version: str = "version") -> DataFrame:
    """The whole pages table after ``updates``; see ``changed_pages`` for the rules.

    The changed rows are written once and read twice.
    """
    return replace_pages(existing, written(changed_pages(existing, updates, version), "changed"))


def unvectorized(pages: DataFrame) -> DataFrame:
    """Pages still to be embedded: no vector, not refused, and some text."""
    has_text = (F.col("title") != "") | (F.col("description") != "") | (F.col("content") != "")
    return pages.where(F.col("vector").isNull() & F.col("can_be_vectorized") & has_text).select(
        "url", *_TEXT, "crawled_at"
    )


def write_back_vectors(pages: DataFrame, embedded: DataFrame) -> DataFrame:
    """Store vectors for the exact crawl they were computed from.

    ``embedded(url, crawled_at, vector)``: a filled vector is normalised and
    stored, an empty one marks the page as never to be embedded. A page crawled
    again in the meantime no longer matches and keeps waiting. Of several vectors for
    one crawl the greatest counts, a filled one before an empty one.
    """
    new = embedded.groupBy("url", "crawled_at").agg(F.max("vector").alias("_new"))
    joined = pages.join(new, ["url", "crawled_at"], "left")
    kind = pages.schema["vector"].dataType
    return joined.select(
        "page_id",
        "url",
        *_TEXT,
        "crawled_at",
        F.when(F.size("_new") > 0, l2_normalize(F.col("_new")).cast(kind))
        .when(F.size("_new") == 0, F.lit(None).cast(kind))
        .otherwise(F.col("vector"))
        .alias("vector"),
        F.when(F.col("_new").isNotNull(), F.size("_new") > 0).otherwise(F.col("can_be_vectorized")).alias("can_be_vectorized"),
    )


def backfill_vectors(pages: DataFrame, dim: int, vector: str = "vector") -> DataFrame:
    """Normalise every stored vector; a vector of any other width fails the job."""
    width = F.size(vector)
    checked = F.when(
        F.col(vector).isNotNull() & (width != dim),
        F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, found "), width.cast("string"))).cast("array<double>"),
    ).otherwise(l2_normalize(F.col(vector)))
    return pages.withColumn(vector, checked)


def recent_pages(pages: DataFrame, n: int = 20) -> DataFrame:
    """Newest ``n`` pages by crawl time."""
    return pages.select("url", "title", "crawled_at", "vector").orderBy(F.col("crawled_at").desc(), "url").limit(n)


def table_counts(pages: DataFrame, links: DataFrame) -> DataFrame:
    total_pages = pages.agg(F.count("*").alias("n")).select(F.lit("pages").alias("table_name"), "n")
    return total_pages.unionByName(links.agg(F.count("*").alias("n")).select(F.lit("links").alias("table_name"), "n"))


def delete_pages(pages: DataFrame, links: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete pages by id; links touching them at either end go too."""
    gone = doomed.select("page_id").distinct()
    kept_links = links.join(gone.withColumnRenamed("page_id", "src_page_id"), "src_page_id", "left_anti").join(
        gone.withColumnRenamed("page_id", "dst_page_id"), "dst_page_id", "left_anti"
    )
    return pages.join(gone, "page_id", "left_anti"), kept_links.select("src_page_id", "dst_page_id")
