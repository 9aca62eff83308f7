"""Every operator as a runnable query over the given tables, most with the SQL it must equal."""

from __future__ import annotations

from pagesift.registry import corpus, crawl, metrics, search, store, streams
from pagesift.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "corpus", "crawl", "metrics", "search", "store", "streams"]
