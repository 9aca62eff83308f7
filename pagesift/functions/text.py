"""Text expressions: the embedding input of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_text(title: Column, description: Column, content: Column) -> Column:
    """``Title: t. Description: d. Content: c.`` with empty parts left out.

    The blank after a title or description stays even when nothing follows it.
    """

    def part(prefix: str, value: Column, suffix: str) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(prefix), value, F.lit(suffix))).otherwise("")

    return F.concat(
        part("Title: ", title, ". "),
        part("Description: ", description, ". "),
        part("Content: ", content, "."),
    )
