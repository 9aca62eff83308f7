"""Indexing: give every waiting page its vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift import schemas as S
from pagesift.functions.text import page_text
from pagesift.operators.embed import EmbedLoader, embed_texts

_COLUMNS = ["page_id", "url", "title", "description", "content", "crawled_at"]


def _text() -> Column:
    return page_text(F.col("title"), F.col("description"), F.col("content"))


def index_pass(pages: DataFrame, loader: EmbedLoader | None = None, limit: int = S.MAX_CHUNK_BYTES) -> DataFrame:
    """The pages table after one pass over its backlog.

    One scan and no shuffle: waiting pages are embedded in place, the rest passes through
    the same tasks unchanged. A page whose text exceeds the byte limit keeps
    a NULL vector and is never selected again.
    """
    has_text = (F.col("title") != "") | (F.col("description") != "") | (F.col("content") != "")
    waiting = F.coalesce(F.col("vector").isNull() & F.col("can_be_vectorized") & has_text, F.lit(False))
    kind = pages.schema["vector"].dataType
    source = pages.select(*_COLUMNS, "vector", "can_be_vectorized", waiting.alias("_waits"), F.when(waiting, _text()).alias("_todo"))
    done = embed_texts(source, [*_COLUMNS, "can_be_vectorized", "_waits"], "_todo", loader, limit, unit=True, old="vector")
    filled = F.size("vector") > 0
    return done.select(
        *_COLUMNS,
        F.when(~F.col("_waits") | filled, F.col("vector").cast(kind)).alias("vector"),
        F.when(F.col("_waits"), filled).otherwise(F.col("can_be_vectorized")).alias("can_be_vectorized"),
    )
