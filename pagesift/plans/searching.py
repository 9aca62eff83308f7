"""End-to-end search: request text in, ranked pages out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift import schemas as S
from pagesift.functions.text import page_text
from pagesift.operators.embed import EmbedLoader, embed_texts
from pagesift.operators.search import search_topk, validate_requests


def embed_queries(requests: DataFrame, loader: EmbedLoader | None = None) -> DataFrame:
    """``(query_id, k, vector)`` of the valid requests; the text is embedded as it is."""
    valid = validate_requests(requests).where(F.col("status") == 200)
    return embed_texts(valid, ["query_id", "k"], "q", loader).where(F.size("vector") > 0)


def embed_pages(pages: DataFrame, loader: EmbedLoader | None = None, limit: int = S.MAX_CHUNK_BYTES) -> DataFrame:
    """``(page_id, vector)`` of pages that have text within the byte limit."""
    text = page_text(F.col("title"), F.col("description"), F.col("content"))
    src = pages.select("page_id", text.alias("text")).where(F.col("text") != "")
    return embed_texts(src, ["page_id"], "text", loader, limit).where(F.size("vector") > 0)


def semantic_search(
    pages: DataFrame, requests: DataFrame, loader: EmbedLoader | None = None, min_similarity: float = S.MIN_SIMILARITY
) -> DataFrame:
    """Hits ``(query_id, rk, page_id, sim)`` of requests ``(query_id, q, limit)``.

    ``pages`` either carries stored vectors or is embedded on the fly in the same scan;
    both ways the page side is never shuffled.
    """
    vectors = pages.select("page_id", "vector") if "vector" in pages.columns else embed_pages(pages, loader)
    return search_topk(vectors, embed_queries(requests, loader), min_similarity=min_similarity)
