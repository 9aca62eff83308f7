"""Crawling over stored fetches: settling a batch against the tables, and replay of a whole corpus."""

from __future__ import annotations

from contextlib import ExitStack
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift import schemas as S
from pagesift.functions.fetch import effective_content_type, fetch_class, is_client_rendered, is_text
from pagesift.functions.urls import canonical_url
from pagesift.operators import frontier
from pagesift.operators.extract import assemble_pages, extract_links, links_of
from pagesift.operators.links import new_links
from pagesift.operators.pages import changed_pages, replace_pages
from pagesift.session import bucketed, written

_LAYERS = 16


class CrawlTables(NamedTuple):
    state: DataFrame
    pages: DataFrame
    links: DataFrame


def apply_changes(tables: CrawlTables, changes: CrawlTables) -> CrawlTables:
    """The tables with the changed rows of one batch in place.

    Lazy: keep several batches as small change sets and write the merged tables out as
    often as suits, not once per batch.
    """
    return CrawlTables(
        frontier.replace_rows(tables.state, changes.state),
        replace_pages(tables.pages, changes.pages),
        tables.links.unionByName(changes.links),
    )


def link_candidates(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """``(parent_url, dst_page_id)`` for edges ``(parent, url)`` whose child is a stored page.

    Edges taken from the URL state (each URL with the page that discovered it) give the
    discovery links a crawl records; edges from ``links_of`` give the full link graph.
    """
    child = pages.select("url", F.col("page_id").alias("dst_page_id"))
    known = edges.where(F.col("parent") != "").select("url", F.col("parent").alias("parent_url"))
    return known.join(child, "url").select("parent_url", "dst_page_id")


def settle_batch(
    tables: CrawlTables, fetched: DataFrame, now: int, round_no: int, try_limit: int = S.TRY_LIMIT, base_ms: int = S.RETRY_BASE_MS
) -> CrawlTables:
    """The changed rows of each table after the results of a batch of fetches were read and settled.

    ``fetched`` holds any number of records per URL (``schemas.FETCH_RECORD`` and ``seq``); the
    one with the highest ``seq`` counts. Pages are stored under their final URL and linked to
    the page that discovered them; their unseen same-site links are queued under ``round_no``
    in the order (seq, position in the page). Bodies are read where they lie, in one pass, and
    only what was parsed from them travels; of the big tables the keys are scanned, no stored text.
    """
    final = canonical_url(F.coalesce("final_url", "url"))
    ok = fetch_class(F.col("http_status")) == S.FETCH_OK
    text = is_text(effective_content_type(F.col("content_type"), F.col("nosniff"), F.col("body")))
    no_error = F.coalesce("error_kind", F.lit("")) == ""
    gated = fetched.withColumns(
        {
            "final_url": final,
            "error_kind": F.when(~no_error, F.col("error_kind")).when(final.isNull(), F.lit("bad_url")).when(ok & ~text, F.lit("not_text")).otherwise(F.lit("")),
            "client_rendered": F.coalesce(ok & no_error & text & is_client_rendered(F.col("body")), F.lit(False)),
        }
    )
    read = gated.where(ok & (F.col("error_kind") == "") & ~F.col("client_rendered"))
    stored = read.select(F.col("url").alias("asked"), "seq", F.col("final_url").alias("url"), "body")
    parsed = written(assemble_pages(stored, body="body"), "parsed")
    narrow = gated.select(
        "url", "seq", "http_status", "error_kind", F.lit(False).alias("extract_failed"), F.lit("").alias("store_error"), "client_rendered"
    )
    narrow = written(narrow, "fetches")
    settled = frontier.crawl_outcomes(tables.state, narrow, now, try_limit, base_ms)
    settled = written(settled.join(narrow.groupBy("url").agg(F.max("seq").alias("seq")), "url").join(tables.state.select("url", "parent"), "url"), "settled")
    good = settled.where("outcome = 'ok'").select(F.col("url").alias("asked"), "seq", "parent")
    kept = written(parsed.join(good, ["asked", "seq"]), "kept")

    crawled_at = F.timestamp_millis(F.lit(now)).cast("timestamp_ntz").alias("crawled_at")
    updates = kept.select("url", "title", "description", "content", crawled_at, F.lit(None).cast("array<float>").alias("vector"), F.col("seq").alias("version"))
    pages = written(changed_pages(tables.pages, updates), "pages")
    known = tables.pages.join(pages.select("url"), "url", "left_anti").select("url", "page_id").unionByName(pages.select("url", "page_id"))
    links = new_links(known, tables.links, link_candidates(pages, kept.select("url", "parent"))).distinct()

    new = settled.select("url", F.col("new_status").alias("_status"), F.col("try").alias("_try"), F.col("retry_at").alias("_retry_at"))
    after = tables.state.join(new, "url").withColumns({"status": F.col("_status"), "try": F.col("_try"), "retry_at": F.col("_retry_at")})
    hrefs = links_of(kept, id_col="seq").select("url", "parent", "seq", "pos")
    pushed = frontier.push_urls(tables.state, hrefs, round_no)
    state = after.select(frontier.COLUMNS).unionByName(pushed)
    return CrawlTables(written(state, "state"), pages, written(links, "links"))


def replay_crawl(corpus: DataFrame, seeds: DataFrame, max_rounds: int | None = None, buckets: int | None = None) -> DataFrame:
    """Final URL state after crawling ``corpus(page_id, url, html)`` from ``seeds(raw, seq)``.

    Every body is parsed once, up front, into a narrow edge table with one row per (parent,
    url), bucketed by the source URL. What a round finds is bucketed by URL as well, so a
    round reads edges, its frontier and all that was seen where they lie; only the newly
    found URLs are shuffled. A URL found in the corpus ends as Done, any other as GiveUp.
    ``enqueue_round`` is the distance from the seeds; among pages of one round the
    discoverer is the one with the smallest page id, then link position.
    """
    at = F.min(F.struct("page_id", "pos")).alias("at")
    edges = extract_links(corpus).groupBy("parent", "url").agg(at).select("parent", "url", F.col("at.page_id").alias("seq"), F.col("at.pos").alias("pos"))
    with ExitStack() as stack:

        def kept(df: DataFrame, key: str, name: str) -> DataFrame:
            return stack.enter_context(bucketed(df, key, name, buckets))

        links = kept(edges, "parent", "edges")
        layers = [kept(frontier.seed_frontier(frontier.empty_state(corpus.sparkSession), seeds, 0), "url", "layer")]
        round_no = 0
        while (max_rounds is None or round_no < max_rounds) and not layers[-1].isEmpty():
            round_no += 1
            found = links.join(layers[-1].select(F.col("url").alias("parent")), "parent")
            layers.append(kept(frontier.push_urls(layers[0], found, round_no, layers[1:]), "url", "layer"))
            if len(layers) > _LAYERS:
                layers = [kept(_union(layers[:-1]), "url", "seen"), layers[-1]]
        seen = written(_union(layers), "seen")
    return seen.join(stored_urls(corpus), "url", "left").withColumn(
        "status", F.when(F.col("stored"), F.lit(S.DONE)).otherwise(F.lit(S.GIVE_UP))
    ).select(frontier.COLUMNS)


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def stored_urls(corpus: DataFrame) -> DataFrame:
    """Canonical URLs that the corpus can answer."""
    urls = corpus.select(canonical_url(F.col("url")).alias("url")).where(F.col("url").isNotNull())
    return urls.distinct().withColumn("stored", F.lit(True))
