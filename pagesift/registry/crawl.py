"""Frontier state and crawl replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesift import schemas as S
from pagesift.operators import frontier as Q
from pagesift.operators.extract import extract_links
from pagesift.operators.links import child_links
from pagesift.plans.crawl import CrawlTables, apply_changes, replay_crawl, settle_batch
from pagesift.registry.base import (
    NOW,
    SNIFF_SQL,
    SQL_CONTENT,
    SQL_FETCHES,
    SQL_LINKS,
    SQL_STATE,
    canon_sql,
    canonical_pages,
    fetch_log,
    query,
    root_sql,
    url_state,
)
from pagesift.sources.tables import table

_FAR = 1 << 44  # page ids are hashes in practice, so the registered order keys are large


@query(
    "seed_frontier",
    f"""WITH s AS (SELECT {root_sql("url")} AS url, page_id FROM pages)
        SELECT url, 1 AS status, '' AS worker_id, 0 AS try, CAST(-1 AS BIGINT) AS take_on_at, CAST(-1 AS BIGINT) AS retry_at,
               '' AS parent, CAST(0 AS BIGINT) AS enqueue_round, min(page_id) AS enqueue_seq, CAST(0 AS BIGINT) AS enqueue_pos FROM s GROUP BY url""",
)
def seed_frontier(spark, sf):
    seeds = table(spark, sf, "pages").select(F.col("url").alias("raw"), F.col("page_id").alias("seq"))
    return Q.seed_frontier(Q.empty_state(spark), seeds, 0)


@query(
    "frontier_push",
    f"""WITH {SQL_LINKS}, {SQL_STATE}, c AS (
          SELECT url, parent, page_id + {_FAR} AS seq, CAST(pos AS BIGINT) AS pos FROM lk UNION ALL SELECT parent, '', page_id + {_FAR}, -1 FROM lk)
        SELECT url, 1 AS status, '' AS worker_id, 0 AS try, CAST(-1 AS BIGINT) AS take_on_at, CAST(-1 AS BIGINT) AS retry_at,
               parent, CAST(1 AS BIGINT) AS enqueue_round, seq AS enqueue_seq, pos AS enqueue_pos
        FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq, pos, parent) AS rn FROM c)
        WHERE rn = 1 AND url NOT IN (SELECT url FROM st)""",
)
def frontier_push(spark, sf):
    links = extract_links(table(spark, sf, "pages"))
    seq = (F.col("page_id") + _FAR).alias("seq")
    candidates = links.select("url", "parent", seq, F.col("pos").cast("bigint").alias("pos")).unionByName(
        links.select(F.col("parent").alias("url"), F.lit("").alias("parent"), seq, F.lit(-1).cast("bigint").alias("pos"))
    )
    return Q.push_urls(url_state(spark, sf), candidates, 1)


@query(
    "retry_schedule",
    f"""WITH {SQL_STATE} SELECT url, CASE WHEN try < {S.TRY_LIMIT} THEN 6 ELSE 5 END AS status, worker_id,
          CASE WHEN try < {S.TRY_LIMIT} THEN try + 1 ELSE try END AS try, take_on_at,
          CASE WHEN try < {S.TRY_LIMIT} THEN {NOW} + {S.RETRY_BASE_MS} * CAST(pow(2, try) AS BIGINT) ELSE retry_at END AS retry_at,
          parent, enqueue_round, enqueue_seq, enqueue_pos FROM st""",
)
def retry_schedule(spark, sf):
    state = url_state(spark, sf)
    return Q.schedule_retries(state, canonical_pages(spark, sf), NOW)


@query(
    "retry_release",
    f"""WITH {SQL_STATE}, rq AS (
          SELECT url, retry_at FROM st WHERE status = 6
          UNION ALL SELECT 'https://orphan.example.com/' || item_id, {NOW} + (item_id % 5 - 2) * 1000 FROM benchmark)
        SELECT rq.url, 1 AS status, coalesce(worker_id, '') AS worker_id, coalesce(try, 1) AS try, coalesce(take_on_at, -1) AS take_on_at,
               coalesce(st.retry_at, -1) AS retry_at, coalesce(parent, '') AS parent, CAST(1 AS BIGINT) AS enqueue_round, rq.retry_at AS enqueue_seq, CAST(0 AS BIGINT) AS enqueue_pos
        FROM (SELECT url, min(retry_at) AS retry_at FROM rq GROUP BY url) rq LEFT JOIN st USING (url) WHERE rq.retry_at <= {NOW}""",
)
def retry_release(spark, sf):
    state = url_state(spark, sf)
    item = F.col("item_id")
    orphans = table(spark, sf, "benchmark").select(
        F.concat(F.lit("https://orphan.example.com/"), item.cast("string")).alias("url"),
        (F.lit(NOW) + (item % 5 - 2) * 1000).alias("retry_at"),
    )
    waiting = state.where(F.col("status") == S.RETRY).select("url", "retry_at").unionByName(orphans)
    return Q.release_due(state, NOW, 1, waiting)


@query(
    "mark_processed",
    f"""WITH {SQL_STATE} SELECT url, CASE enqueue_seq % 3 WHEN 0 THEN 3 WHEN 1 THEN 5 ELSE 4 END AS status, worker_id, try,
          take_on_at, retry_at, parent, enqueue_round, enqueue_seq, enqueue_pos FROM st""",
)
def mark_processed(spark, sf):
    p = F.col("page_id")
    outcomes = canonical_pages(spark, sf).select(
        "url", F.when(p % 3 == 0, F.lit(S.DONE)).when(p % 3 == 1, F.lit(S.GIVE_UP)).otherwise(F.lit(S.MANUAL)).alias("new_status")
    )
    return Q.mark_processed(url_state(spark, sf), outcomes)


@query(
    "unknown_urls",
    f"WITH {SQL_LINKS}, {SQL_STATE} SELECT DISTINCT url FROM lk WHERE url NOT IN (SELECT url FROM st)",
)
def unknown_urls(spark, sf):
    return Q.unknown_urls(url_state(spark, sf), extract_links(table(spark, sf, "pages")))


_ORPHANS_SQL = "SELECT 'https://orphan.example.com/' || item_id AS url FROM benchmark"


@query(
    "stale_sweep",
    f"""WITH {SQL_STATE}, fly AS (SELECT url FROM st WHERE status = 2 UNION ALL {_ORPHANS_SQL})
        SELECT fly.url, 1 AS status, coalesce(worker_id, '') AS worker_id, coalesce(try, 0) AS try, coalesce(take_on_at, -1) AS take_on_at,
               coalesce(retry_at, -1) AS retry_at, coalesce(parent, '') AS parent, CAST(1 AS BIGINT) AS enqueue_round,
               coalesce(take_on_at, -1) AS enqueue_seq, CAST(0 AS BIGINT) AS enqueue_pos
        FROM fly LEFT JOIN st USING (url) WHERE st.url IS NULL OR {NOW} - take_on_at >= {S.STALE_AFTER_MS}""",
)
def stale_sweep(spark, sf):
    state = url_state(spark, sf)
    orphans = table(spark, sf, "benchmark").select(F.concat(F.lit("https://orphan.example.com/"), F.col("item_id").cast("string")).alias("url"))
    in_flight = state.where(F.col("status") == S.PROCESSING).select("url").unionByName(orphans)
    return Q.sweep_stale(state, NOW, 1, in_flight=in_flight)


@query(
    "crawl_metadata",
    f"""WITH {SQL_STATE} SELECT count(*) FILTER (status IN (1, 2, 6)) AS unprocessed, min(retry_at) FILTER (status = 6) AS earliest_retry FROM st""",
)
def crawl_metadata(spark, sf):
    return Q.crawl_metadata(url_state(spark, sf))


@query(
    "retries_left",
    f"WITH {SQL_STATE} SELECT count(*) FILTER (status = 6 AND retry_at > {NOW}) AS remaining FROM st",
)
def retries_left(spark, sf):
    return Q.retries_left(url_state(spark, sf), NOW)


@query(
    "queue_depths",
    f"WITH {SQL_STATE} SELECT count(*) FILTER (status = 1) AS queue_depth, count(*) FILTER (status = 6) AS retry_depth FROM st",
)
def queue_depths(spark, sf):
    return Q.queue_depths(url_state(spark, sf))


@query(
    "url_state_json",
    f"WITH {SQL_STATE} SELECT url, status, worker_id, take_on_at, try, retry_at, parent FROM st",
)
def url_state_json(spark, sf):
    fields = ["status", "worker_id", "take_on_at", "try", "retry_at", "parent"]
    encoded = url_state(spark, sf).select("url", F.to_json(F.struct(*fields)).alias("state"))
    return encoded.select("url", F.from_json("state", S.URL_STATE_JSON).alias("s")).select("url", "s.*")


@query(
    "crawl_outcomes",
    f"""WITH {SQL_FETCHES}, {SQL_STATE}, j AS (
      SELECT fl.page_id, fl.url, st.try, st.status, st.retry_at,
        CASE WHEN error_kind <> '' THEN 'give_up'
             WHEN http_status IN (408, 429, 500, 502, 503, 504) AND st.try < {S.TRY_LIMIT} THEN 'retry'
             WHEN http_status IN (408, 429, 500, 502, 503, 504) THEN 'give_up'
             WHEN http_status IN (400, 401, 411) THEN 'manual'
             WHEN http_status <> 200 THEN 'impossible'
             WHEN fl.page_id % 13 = 5 THEN 'left' ELSE 'ok' END AS outcome
      FROM (SELECT * FROM fl QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1) fl JOIN st USING (url))
    SELECT url, CASE outcome WHEN 'ok' THEN 3 WHEN 'retry' THEN 6 WHEN 'manual' THEN 4 WHEN 'left' THEN status ELSE 5 END AS new_status,
           nullif(outcome, 'left') AS outcome, CASE outcome WHEN 'retry' THEN try + 1 ELSE try END AS try,
           CASE outcome WHEN 'retry' THEN {NOW} + {S.RETRY_BASE_MS} * CAST(pow(2, try) AS BIGINT) ELSE retry_at END AS retry_at FROM j""",
)
def crawl_outcomes(spark, sf):
    fetches = fetch_log(spark, sf).select(
        "url",
        F.col("page_id").alias("seq"),
        "http_status",
        "error_kind",
        F.lit(False).alias("extract_failed"),
        F.when(F.col("page_id") % 13 == 5, F.lit("transient")).otherwise(F.lit("")).alias("store_error"),
    )
    return Q.crawl_outcomes(url_state(spark, sf), fetches, NOW)


@query(
    "recover_urls",
    f"""WITH {SQL_LINKS}, {SQL_STATE}, w AS (SELECT url FROM lk UNION SELECT parent FROM lk)
        SELECT w.url, 1 AS status, coalesce(worker_id, '') AS worker_id, coalesce(try, 0) AS try, coalesce(take_on_at, -1) AS take_on_at,
               coalesce(retry_at, -1) AS retry_at, coalesce(parent, '') AS parent, CAST(1 AS BIGINT) AS enqueue_round,
               coalesce(take_on_at, -1) AS enqueue_seq, CAST(0 AS BIGINT) AS enqueue_pos FROM w LEFT JOIN st USING (url)""",
)
def recover_urls(spark, sf):
    links = extract_links(table(spark, sf, "pages"))
    wanted = links.select(F.explode(F.array("url", "parent")).alias("url"))
    return Q.recover(url_state(spark, sf), wanted, 1)


_BATCH_SQL = f"""{SQL_FETCHES}, {SQL_STATE}, {SQL_CONTENT},
ids AS (SELECT url, page_id FROM cp),
own AS (SELECT st.*, coalesce(up.url, '') AS found_on FROM st JOIN ids USING (url)
        LEFT JOIN ids up ON up.page_id = ids.page_id // 2 AND ids.page_id > 0),
kinds AS (SELECT *, CASE WHEN nosniff AND content_type <> '' THEN content_type ELSE {SNIFF_SQL} END AS kind,
            page_id % 5 IN (3, 4) AS spa, CASE WHEN page_id % 9 = 4 THEN url || '/moved' ELSE url END AS final FROM fl),
lastest AS (SELECT * FROM kinds QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1),
rec AS (
  SELECT own.*, k.page_id AS seq, final, body, k.page_id % 5 AS variant,
    CASE WHEN error_kind <> '' THEN 'give_up'
         WHEN http_status IN (408, 429, 500, 502, 503, 504) AND try < {S.TRY_LIMIT} THEN 'retry'
         WHEN http_status IN (408, 429, 500, 502, 503, 504) THEN 'give_up'
         WHEN http_status IN (400, 401, 411) THEN 'manual'
         WHEN http_status <> 200 THEN 'impossible'
         WHEN NOT (contains(kind, 'text/plain') OR contains(kind, 'text/html') OR contains(kind, 'text/markdown')) THEN 'give_up'
         WHEN spa THEN 'render' ELSE 'ok' END AS outcome
  FROM own JOIN lastest k USING (url)),
stored AS (SELECT * FROM rec WHERE outcome = 'ok'),
found AS (
  SELECT seq, parent, pos, {canon_sql("full_url")} AS url FROM (
    SELECT seq, final AS parent, unnest(range(len(hs))) AS pos, regexp_extract(final, '^[^/]*//[^/]*') || unnest(hs) AS full_url
    FROM (SELECT seq, final, regexp_extract_all(body, '<a href="([^"]*)"', 1) AS hs FROM stored)))"""


def _batch(spark, sf):
    """The derived fetch log, some of it redirected, settled against the derived state, whose pages are found by others."""
    p = F.col("page_id")
    ids = canonical_pages(spark, sf).select("url", "page_id")
    up = ids.select(F.col("url").alias("found_on"), p.alias("half"))
    parents = ids.join(up, (F.floor(p / 2) == F.col("half")) & (p > 0), "left").select("url", F.coalesce("found_on", F.lit("")).alias("parent"))
    state = url_state(spark, sf).drop("parent").join(parents, "url").select(Q.COLUMNS)
    log = fetch_log(spark, sf)
    moved = F.when(p % 9 == 4, F.concat("url", F.lit("/moved"))).otherwise(F.col("url"))
    records = log.withColumn("final_url", moved).withColumnRenamed("page_id", "seq")
    blank = [F.lit("").alias(c) for c in ("title", "description", "content")]
    pages = ids.select("page_id", "url", *blank, *(F.lit(None).cast(f.dataType).alias(f.name) for f in S.PAGE.fields[5:]))
    tables = CrawlTables(state, pages, spark.createDataFrame([], S.LINK))
    return tables, settle_batch(tables, records, NOW, 1)


@query(
    "settled_states",
    f"""WITH {_BATCH_SQL}
    SELECT url, CASE outcome WHEN 'ok' THEN 3 WHEN 'retry' THEN 6 WHEN 'manual' THEN 4 WHEN 'render' THEN 4 ELSE 5 END AS status,
           CASE outcome WHEN 'retry' THEN try + 1 ELSE try END AS try,
           CASE outcome WHEN 'retry' THEN {NOW} + {S.RETRY_BASE_MS} * CAST(pow(2, try) AS BIGINT) ELSE retry_at END AS retry_at,
           found_on AS parent, enqueue_round, enqueue_seq, enqueue_pos FROM rec
    UNION ALL SELECT url, 1, 0, -1, parent, 1, seq, pos FROM (
      SELECT * FROM found WHERE url NOT IN (SELECT url FROM st) QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq, pos) = 1)""",
)
def settled_states(spark, sf):
    _, after = _batch(spark, sf)
    return after.state.select("url", "status", "try", "retry_at", "parent", "enqueue_round", "enqueue_seq", "enqueue_pos")


@query(
    "settled_pages",
    f"""WITH {_BATCH_SQL}
    SELECT final AS url, CASE WHEN variant = 1 THEN '' ELSE title END AS title,
           CASE WHEN variant = 1 THEN '' ELSE description END AS description, CASE WHEN variant = 1 THEN '' ELSE content END AS content
    FROM stored JOIN ap ON ap.page_id = stored.seq""",
)
def settled_pages(spark, sf):
    _, after = _batch(spark, sf)
    return after.pages.select("url", "title", "description", "content")


@query(
    "settled_links",
    f"""WITH {_BATCH_SQL}
    SELECT DISTINCT found_on AS parent_url, final AS child_url FROM stored
    WHERE found_on IN (SELECT url FROM ids UNION SELECT final FROM stored)""",
)
def settled_links(spark, sf):
    tables, after = _batch(spark, sf)
    return child_links(apply_changes(tables, after).pages, after.links)


@query(
    "reset_and_seed",
    f"""WITH s AS (SELECT {root_sql("url")} AS url, page_id FROM pages)
        SELECT url, 1 AS status, '' AS worker_id, 0 AS try, CAST(-1 AS BIGINT) AS take_on_at, CAST(-1 AS BIGINT) AS retry_at,
               '' AS parent, CAST(5 AS BIGINT) AS enqueue_round, min(page_id) AS enqueue_seq, CAST(0 AS BIGINT) AS enqueue_pos FROM s GROUP BY url""",
)
def reset_and_seed(spark, sf):
    seeds = table(spark, sf, "pages").select(F.col("url").alias("raw"), F.col("page_id").alias("seq"))
    return Q.reset_and_seed(url_state(spark, sf), seeds, 5)


_SITE = "https://corpus.example.com"


@query(
    "crawl_replay",
    f"""WITH RECURSIVE reach AS (
      SELECT 0 AS page_id, 0 AS r UNION ALL
      SELECT e.dst, r + 1 FROM reach JOIN (SELECT page_id AS src, page_id * 2 + 1 AS dst FROM pages
        UNION ALL SELECT page_id, page_id * 2 + 2 FROM pages) e ON e.src = reach.page_id WHERE e.dst IN (SELECT page_id FROM pages)),
    own AS (SELECT page_id, unnest(found) AS href, unnest(range(len(found))) AS pos FROM (
        SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS found FROM pages)),
    tree AS (SELECT page_id, '/p/' || (page_id * 2 + 1 + pos) AS href, pos + 1000000 AS pos FROM pages, (VALUES (0), (1)) AS v(pos)),
    lk AS (SELECT r + 1 AS enqueue_round, page_id, pos, CASE WHEN page_id = 0 THEN '{_SITE}' ELSE '{_SITE}/p/' || page_id END AS parent,
             {canon_sql(f"('{_SITE}' || href)")} AS url
           FROM (SELECT * FROM own UNION ALL SELECT * FROM tree) JOIN reach USING (page_id)),
    firsts AS (SELECT url, parent, enqueue_round FROM lk WHERE url <> '{_SITE}'
               QUALIFY row_number() OVER (PARTITION BY url ORDER BY enqueue_round, page_id, pos) = 1)
    SELECT url, CASE WHEN url IN (SELECT '{_SITE}/p/' || page_id FROM pages WHERE page_id > 0) THEN 3 ELSE 5 END AS status,
           parent, CAST(enqueue_round AS BIGINT) AS enqueue_round FROM firsts
    UNION ALL SELECT '{_SITE}', 3, '', 0""",
)
def crawl_replay(spark, sf):
    """All pages moved to one site, each linking to two more beside its own links."""
    p = F.col("page_id")
    anchors = F.concat(
        F.lit('<a href="/p/'), (p * 2 + 1).cast("string"), F.lit('">l</a><a href="/p/'), (p * 2 + 2).cast("string"), F.lit('">r</a>')
    )
    pages = table(spark, sf, "pages").select(
        (p + _FAR).alias("page_id"),
        F.when(p == 0, F.lit(_SITE)).otherwise(F.concat(F.lit(_SITE + "/p/"), p.cast("string"))).alias("url"),
        F.concat("html", anchors).alias("html"),
    )
    seeds = pages.agg(F.min("page_id").alias("seq")).select(F.lit(_SITE).alias("raw"), "seq")
    return replay_crawl(pages, seeds).select("url", "status", "parent", "enqueue_round")
