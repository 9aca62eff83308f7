"""The links table: insert-ignore, referential checks, children of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_links(pages: DataFrame, links: DataFrame, candidates: DataFrame) -> DataFrame:
    """Link rows that ``candidates(parent_url, dst_page_id)`` add to ``links``.

    Candidates are made distinct before the join, so repeated links cost one row
    per task. Unknown parents and pairs already stored add nothing.
    """
    wanted = candidates.select("parent_url", "dst_page_id").distinct()
    ids = pages.select(F.col("url").alias("parent_url"), F.col("page_id").alias("src_page_id"))
    resolved = wanted.join(ids, "parent_url").select("src_page_id", "dst_page_id")
    return resolved.join(links, ["src_page_id", "dst_page_id"], "left_anti")


def valid_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Links whose both ends exist."""
    ids = pages.select("page_id")
    return (
        links.join(ids.withColumnRenamed("page_id", "src_page_id"), "src_page_id", "left_semi")
        .join(ids.withColumnRenamed("page_id", "dst_page_id"), "dst_page_id", "left_semi")
        .select("src_page_id", "dst_page_id")
    )


def child_links(pages: DataFrame, links: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """``(parent_url, child_url)`` of every link, or of the links of ``parents(url)``."""
    src = pages.select(F.col("page_id").alias("src_page_id"), F.col("url").alias("parent_url"))
    if parents is not None:
        src = src.join(parents.select(F.col("url").alias("parent_url")), "parent_url", "left_semi")
    dst = pages.select(F.col("page_id").alias("dst_page_id"), F.col("url").alias("child_url"))
    return links.join(src, "src_page_id").join(dst, "dst_page_id").select("parent_url", "child_url")
