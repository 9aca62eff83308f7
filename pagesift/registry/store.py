"""Pages and links tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesift.functions.vectors import l2_norm
from pagesift.operators import links as L
from pagesift.operators import pages as P
from pagesift.operators.embed import is_too_big
from pagesift.registry.base import CHUNK_BYTES, SQL_PAGE_TABLE, checksum, checksum_sql, doc_url, norm_sql, page_table, query
from pagesift.session import scratch_path
from pagesift.sources.page_store import PageStore
from pagesift.sources.tables import table

_NORM = norm_sql("vector")
_UNIT_SQL = f"round({checksum_sql('embedding')} / {norm_sql('embedding')}, 5)"
_STORED_SQL = f"round({checksum_sql('vector')}, 5)"

_UPDATES_SQL = """
up AS (
  SELECT 'https://docs.example.com/' || d.source || '/' || d.doc_id AS url, v.title,
         'quality ' || l.quality AS description, d.text AS content,
         TIMESTAMP '2024-06-01 00:00:00' + to_seconds(d.doc_id) AS crawled_at, l.toxic = 1 AS refused, v.version
  FROM labels l JOIN documents d USING (doc_id), (VALUES ('draft', 1), ('final', 2)) AS v(title, version)
  UNION ALL
  SELECT 'https://bench.example.com/' || item_id, 'benchmark', '', text, TIMESTAMP '2024-06-01 00:00:00', false, 1 FROM benchmark),
latest AS (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY url ORDER BY version DESC) = 1)"""


def _updates(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id")
    versions = F.explode(
        F.array(
            F.struct(F.lit("draft").alias("title"), F.lit(1).alias("version")),
            F.struct(F.lit("final").alias("title"), F.lit(2).alias("version")),
        )
    ).alias("v")
    none, refused = F.lit(None).cast("array<float>"), F.array().cast("array<float>")
    recrawled = docs.select("*", versions).select(
        doc_url().alias("url"),
        F.col("v.title").alias("title"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("description"),
        F.col("text").alias("content"),
        F.expr("timestamp_ntz'2024-06-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id)").alias("crawled_at"),
        F.when(F.col("toxic") == 1, refused).otherwise(none).alias("vector"),
        F.col("v.version").alias("version"),
    )
    added = table(spark, sf, "benchmark").select(
        F.concat(F.lit("https://bench.example.com/"), F.col("item_id").cast("string")).alias("url"),
        F.lit("benchmark").alias("title"),
        F.lit("").alias("description"),
        F.col("text").alias("content"),
        F.expr("timestamp_ntz'2024-06-01 00:00:00'").alias("crawled_at"),
        none.alias("vector"),
        F.lit(1).alias("version"),
    )
    return recrawled.unionByName(added)


@query(
    "pages_upsert",
    f"""WITH {SQL_PAGE_TABLE}, {_UPDATES_SQL}
    SELECT pt.page_id, pt.url, pt.title, pt.description, md5(pt.content) AS content_md5, pt.crawled_at,
           pt.vector IS NOT NULL AS has_vector, round({checksum_sql("vector")}, 5) AS checksum, pt.can_be_vectorized
    FROM pt ANTI JOIN latest USING (url)
    UNION ALL
    SELECT coalesce(pt.page_id, -1), latest.url, latest.title, latest.description, md5(latest.content), latest.crawled_at,
           false, NULL, NOT latest.refused
    FROM latest LEFT JOIN pt USING (url)""",
)
def pages_upsert(spark, sf):
    existing = page_table(spark, sf)
    merged = P.upsert_pages(existing, _updates(spark, sf))
    known = F.col("url").startswith("https://docs.example.com/")
    return merged.select(
        F.when(known, F.col("page_id")).otherwise(F.lit(-1).cast("bigint")).alias("page_id"),
        "url",
        "title",
        "description",
        F.md5("content").alias("content_md5"),
        "crawled_at",
        F.col("vector").isNotNull().alias("has_vector"),
        checksum().alias("checksum"),
        "can_be_vectorized",
    )


@query(
    "pages_merge_on_read",
    f"""WITH {SQL_PAGE_TABLE}, {_UPDATES_SQL},
    now AS (
      SELECT page_id, url, title, description, content, crawled_at, vector, can_be_vectorized FROM pt ANTI JOIN latest USING (url)
      UNION ALL
      SELECT coalesce(pt.page_id, CAST('0x' || substr(md5(latest.url), 1, 15) AS BIGINT)), latest.url, latest.title, latest.description, latest.content, latest.crawled_at,
             NULL, NOT latest.refused
      FROM latest LEFT JOIN pt USING (url)),
    em AS (SELECT now.url, now.crawled_at, label = 4 AS refused, embedding FROM now JOIN embeddings ON vec_id = page_id WHERE label % 2 = 0)
    SELECT page_id, now.url, title, description, md5(content) AS content_md5, now.crawled_at,
           CASE WHEN em.url IS NOT NULL THEN CASE WHEN NOT refused THEN {_UNIT_SQL} END
                WHEN vector IS NOT NULL THEN {_STORED_SQL} END AS checksum,
           CASE WHEN em.url IS NOT NULL THEN NOT refused ELSE can_be_vectorized END AS can_be_vectorized
    FROM now LEFT JOIN em ON em.url = now.url AND em.crawled_at = now.crawled_at""",
)
def pages_merge_on_read(spark, sf):
    """The store's whole rows after an upsert, a compaction of half of the buckets, and a write-back of vectors, some of an older crawl."""
    vector = F.col("vector").cast("array<double>")
    store = PageStore.create(page_table(spark, sf).withColumn("vector", vector), scratch_path(spark, "store"))
    by_url = F.conv(F.substring(F.md5("url"), 1, 15), 16, 10).cast("bigint")
    store.upsert(_updates(spark, sf).withColumn("vector", vector), new_id=by_url)
    store.compact(set(range(0, store.n, 2)))
    ids = store.read().select("page_id", "url", "crawled_at")
    found = ids.join(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "page_id"), "page_id")
    stale = F.expr("crawled_at - make_dt_interval(1, 0, 0, 0)")
    entries = F.when(F.col("label") == 4, F.array().cast("array<double>")).otherwise(F.col("embedding").cast("array<double>"))
    store.write_back(found.select("url", F.when(F.col("label") % 2 == 0, F.col("crawled_at")).otherwise(stale).alias("crawled_at"), entries.alias("vector")))
    return store.read().select("page_id", "url", "title", "description", F.md5("content").alias("content_md5"), "crawled_at", checksum().alias("checksum"), "can_be_vectorized")


@query(
    "vector_writeback",
    f"""WITH {SQL_PAGE_TABLE}, em AS (
      SELECT pt.url, CASE WHEN e.label % 2 = 0 THEN pt.crawled_at ELSE pt.crawled_at - INTERVAL 1 DAY END AS crawled_at,
             e.label = 4 AS refused, e.embedding
      FROM pt JOIN embeddings e ON e.vec_id = pt.page_id),
    j AS (SELECT pt.*, em.url IS NOT NULL AS hit, em.refused, em.embedding FROM pt LEFT JOIN em ON em.url = pt.url AND em.crawled_at = pt.crawled_at)
    SELECT page_id, url, CASE WHEN hit THEN NOT refused ELSE vector IS NOT NULL END AS has_vector,
           CASE WHEN hit AND refused THEN NULL WHEN vector IS NOT NULL THEN round({_NORM}, 4) END AS norm,
           CASE WHEN hit AND refused THEN NULL WHEN hit THEN {_UNIT_SQL} WHEN vector IS NOT NULL THEN {_STORED_SQL} END AS checksum,
           CASE WHEN hit THEN NOT refused ELSE can_be_vectorized END AS can_be_vectorized FROM j""",
)
def vector_writeback(spark, sf):
    pages = page_table(spark, sf).withColumn("vector", F.col("vector").cast("array<double>"))
    ids = pages.select("page_id", "url", "crawled_at")
    found = ids.join(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "page_id"), "page_id")
    stale = F.expr("crawled_at - make_dt_interval(1, 0, 0, 0)")
    embedded = found.select(
        "url",
        F.when(F.col("label") % 2 == 0, F.col("crawled_at")).otherwise(stale).alias("crawled_at"),
        F.when(F.col("label") == 4, F.array().cast("array<double>"))
        .otherwise(F.transform("embedding", lambda x: x.cast("double") * 3))
        .alias("vector"),
    )
    return P.write_back_vectors(pages, embedded).select(
        "page_id",
        "url",
        F.col("vector").isNotNull().alias("has_vector"),
        F.when(F.col("vector").isNotNull(), F.round(l2_norm(F.col("vector")), 4)).alias("norm"),
        checksum().alias("checksum"),
        "can_be_vectorized",
    )


@query(
    "vector_backfill",
    f"""SELECT vec_id AS page_id, round(e.c / n.norm, 6) AS first_component, CAST(round(1.0, 6) AS DOUBLE) AS norm, {_UNIT_SQL} AS checksum
       FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS c, embedding FROM embeddings) e
       JOIN (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS norm FROM embeddings) n USING (vec_id)""",
)
def vector_backfill(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("page_id"), F.col("embedding").alias("vector"))
    filled = P.backfill_vectors(vectors, 64)
    return filled.select(
        "page_id", F.round(F.col("vector")[0], 6).alias("first_component"), F.round(l2_norm(F.col("vector")), 6).alias("norm"), checksum().alias("checksum")
    )


@query("recent_pages", f"WITH {SQL_PAGE_TABLE} SELECT url, title, crawled_at FROM pt ORDER BY crawled_at DESC, url LIMIT 20")
def recent_pages(spark, sf):
    return P.recent_pages(page_table(spark, sf)).select("url", "title", "crawled_at")


_TREE_SQL = """lt AS (SELECT doc_id AS src_page_id, doc_id * 2 + 1 AS dst_page_id FROM documents
  UNION ALL SELECT doc_id, doc_id * 2 + 2 FROM documents)"""


def _tree(spark, sf):
    """Links from every document to two others, half of which do not exist."""
    children = F.explode(F.array(F.col("doc_id") * 2 + 1, F.col("doc_id") * 2 + 2)).alias("dst_page_id")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("src_page_id"), children)


@query(
    "table_counts",
    f"""WITH {_TREE_SQL} SELECT 'pages' AS table_name, (SELECT count(*) FROM documents) AS n
        UNION ALL SELECT 'links', (SELECT count(*) FROM lt)""",
)
def table_counts(spark, sf):
    return P.table_counts(page_table(spark, sf), _tree(spark, sf))


@query(
    "get_page",
    f"""WITH {SQL_PAGE_TABLE}, w AS (SELECT DISTINCT 'https://docs.example.com/' || source || '/' || doc_id AS url FROM labels JOIN documents USING (doc_id))
        SELECT pt.url, title, description, md5(content) AS content_md5, crawled_at, vector IS NOT NULL AS has_vector FROM pt SEMI JOIN w USING (url)""",
)
def get_page(spark, sf):
    wanted = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").select(doc_url().alias("url"))
    return P.get_pages(page_table(spark, sf), wanted).select(
        "url", "title", "description", F.md5("content").alias("content_md5"), "crawled_at", F.col("vector").isNotNull().alias("has_vector")
    )


@query(
    "page_exists",
    """WITH probe AS (SELECT DISTINCT 'https://docs.example.com/' || source || '/' || (doc_id * 2) AS url FROM documents),
       known AS (SELECT DISTINCT 'https://docs.example.com/' || source || '/' || doc_id AS url FROM documents)
       SELECT probe.url, known.url IS NOT NULL AS "exists" FROM probe LEFT JOIN known USING (url)""",
)
def page_exists(spark, sf):
    docs = table(spark, sf, "documents").select("source", (F.col("doc_id") * 2).alias("doc_id"))
    return P.pages_exist(page_table(spark, sf), docs.select(doc_url().alias("url")))


@query(
    "unvectorized_backlog",
    f"""WITH {SQL_PAGE_TABLE} SELECT url, title, description, md5(content) AS content_md5, crawled_at FROM pt
        WHERE vector IS NULL AND can_be_vectorized AND (title <> '' OR description <> '' OR content <> '')""",
)
def unvectorized_backlog(spark, sf):
    return P.unvectorized(page_table(spark, sf)).select("url", "title", "description", F.md5("content").alias("content_md5"), "crawled_at")


_CANDIDATES_SQL = f"""{_TREE_SQL}, cand AS (
  SELECT 'https://docs.example.com/' || source || '/' || doc_id AS parent_url, doc_id * 2 + 1 AS dst_page_id FROM documents
  UNION ALL SELECT 'https://docs.example.com/' || source || '/' || doc_id, doc_id // 2 FROM documents
  UNION ALL SELECT 'https://docs.example.com/' || source || '/' || doc_id, doc_id // 2 FROM documents
  UNION ALL SELECT 'https://unknown.example.com/' || item_id, item_id FROM benchmark)"""


@query(
    "links_insert",
    f"""WITH {SQL_PAGE_TABLE}, {_CANDIDATES_SQL}
        SELECT DISTINCT pt.page_id AS src_page_id, dst_page_id FROM cand JOIN pt ON pt.url = cand.parent_url
        WHERE NOT EXISTS (SELECT 1 FROM lt WHERE lt.src_page_id = pt.page_id AND lt.dst_page_id = cand.dst_page_id)""",
)
def links_insert(spark, sf):
    docs = table(spark, sf, "documents")
    half = F.floor(F.col("doc_id") / 2)
    known = docs.select(doc_url().alias("parent_url"), F.explode(F.array(F.col("doc_id") * 2 + 1, half, half)).alias("dst_page_id"))
    unknown = table(spark, sf, "benchmark").select(
        F.concat(F.lit("https://unknown.example.com/"), F.col("item_id").cast("string")).alias("parent_url"),
        F.col("item_id").alias("dst_page_id"),
    )
    return L.new_links(page_table(spark, sf), _tree(spark, sf), known.unionByName(unknown))


@query(
    "links_valid",
    f"WITH {_TREE_SQL} SELECT src_page_id, dst_page_id FROM lt WHERE src_page_id IN (SELECT doc_id FROM documents) AND dst_page_id IN (SELECT doc_id FROM documents)",
)
def links_valid(spark, sf):
    return L.valid_links(page_table(spark, sf), _tree(spark, sf))


@query(
    "child_links",
    f"""WITH {SQL_PAGE_TABLE}, {_TREE_SQL} SELECT p.url AS parent_url, c.url AS child_url
        FROM lt JOIN pt p ON p.page_id = src_page_id JOIN pt c ON c.page_id = dst_page_id""",
)
def child_links(spark, sf):
    return L.child_links(page_table(spark, sf), _tree(spark, sf))


@query(
    "delete_cascade",
    f"""WITH {_TREE_SQL}, gone AS (SELECT doc_id FROM labels WHERE toxic = 1)
        SELECT 'links' AS table_name, src_page_id, dst_page_id FROM lt WHERE src_page_id NOT IN (SELECT doc_id FROM gone) AND dst_page_id NOT IN (SELECT doc_id FROM gone)
        UNION ALL SELECT 'pages', doc_id, NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone)""",
)
def delete_cascade(spark, sf):
    doomed = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_id"))
    pages, links = P.delete_pages(page_table(spark, sf), _tree(spark, sf), doomed)
    left = pages.select(F.lit("pages").alias("table_name"), F.col("page_id").alias("src_page_id"), F.lit(None).cast("bigint").alias("dst_page_id"))
    return links.select(F.lit("links").alias("table_name"), "src_page_id", "dst_page_id").unionByName(left)


@query(
    "too_big_texts",
    f"SELECT doc_id AS page_id, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents WHERE strlen(text) > {CHUNK_BYTES}",
)
def too_big_texts(spark, sf):
    docs = table(spark, sf, "documents").where(is_too_big(F.col("text"), CHUNK_BYTES))
    return docs.select(F.col("doc_id").alias("page_id"), F.octet_length("text").cast("bigint").alias("n_bytes"))
