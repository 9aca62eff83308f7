"""Deduplication of URL tables by canonical form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.functions.urls import canonical_url


def dedupe_urls(df: DataFrame, url: str = "url", id_col: str = "page_id") -> DataFrame:
    """One row per canonical URL, survivor = smallest id; unparsable URLs drop out.

    A plain minimum, so a URL that repeats millions of times is reduced to one
    row per task before anything is shuffled.
    """
    return (
        df.select(F.col(id_col), canonical_url(F.col(url)).alias("canonical"))
        .where(F.col("canonical").isNotNull())
        .groupBy("canonical")
        .agg(F.min(id_col).alias(id_col))
        .select(id_col, F.col("canonical").alias("url"))
    )
