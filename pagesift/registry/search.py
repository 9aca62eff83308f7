"""Vectors, embedding and search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift import schemas as S
from pagesift.functions.vectors import inner_product, l2_norm, l2_normalize
from pagesift.operators import banded as B
from pagesift.operators import search as R
from pagesift.operators.embed import assign_chunks, embed_texts
from pagesift.plans.indexing import index_pass
from pagesift.plans.searching import semantic_search
from pagesift.registry.base import CHUNK_BYTES, SQL_PAGE_TABLE, checksum, checksum_sql, norm_sql, page_table, query, vectors_of
from pagesift.sources.tables import table

_VEC_SQL = "ev AS (SELECT vec_id AS page_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query(
    "l2_normalize",
    f"""WITH {_VEC_SQL} SELECT page_id, round(3 * v[1] / (3 * sqrt(list_inner_product(v, v))), 6) AS head,
        round(3 * v[64] / (3 * sqrt(list_inner_product(v, v))), 6) AS tail,
        round({checksum_sql("v")} / {norm_sql("v")}, 5) AS checksum FROM ev""",
)
def normalised(spark, sf):
    tripled = F.transform("vector", lambda x: x.cast("double") * 3)
    unit = vectors_of(spark, sf).select("page_id", l2_normalize(tripled).alias("u"))
    return unit.select("page_id", F.round(F.col("u")[0], 6).alias("head"), F.round(F.col("u")[63], 6).alias("tail"), checksum("u").alias("checksum"))


@query(
    "inner_product",
    f"""WITH {_VEC_SQL}, nx AS (SELECT page_id - 1 AS page_id, v AS w FROM ev)
        SELECT page_id, round(list_inner_product(v, w), 6) AS product, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM ev JOIN nx USING (page_id)""",
)
def inner_products(spark, sf):
    """Every vector with its successor."""
    vectors = vectors_of(spark, sf).select("page_id", "vector")
    after = vectors.select((F.col("page_id") - 1).alias("page_id"), F.col("vector").alias("w"))
    product = F.round(inner_product(F.col("vector"), F.col("w")), 6).alias("product")
    return vectors.join(after, "page_id").select("page_id", product, F.round(l2_norm(F.col("vector")), 6).alias("norm"))


_TOP = """SELECT query_id, rk, page_id, sim FROM (
  SELECT query_id, page_id, round(sim, 6) AS sim,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 6) DESC, page_id) AS INTEGER) AS rk
  FROM (SELECT query_id, page_id, list_inner_product(q, v) / (sqrt(list_inner_product(q, q)) * sqrt(list_inner_product(v, v))) AS sim
        FROM qs, ev) WHERE sim > 0.3) WHERE rk <= 10"""

_CENTROIDS_SQL = """qs AS (SELECT CAST(label AS BIGINT) AS query_id, list(m ORDER BY pos) AS q FROM (
  SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS pos FROM ev) GROUP BY label, pos) GROUP BY label)"""
_NEWEST_SQL = "qs AS (SELECT CAST(label AS BIGINT) AS query_id, max_by(v, page_id) AS q FROM ev GROUP BY label)"


def _centroids(spark, sf) -> DataFrame:
    cells = vectors_of(spark, sf).select("label", F.posexplode("vector").alias("pos", "x"))
    means = cells.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m")))
    return means.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(F.transform(ordered, lambda c: c["m"]).alias("vector"))


def _newest(spark, sf) -> DataFrame:
    """The latest vector of every label, as the query."""
    newest = F.max_by("vector", "page_id")
    return vectors_of(spark, sf).groupBy(F.col("label").cast("bigint").alias("query_id")).agg(newest.alias("vector"))


@query("search_topk", f"WITH {_VEC_SQL}, {_CENTROIDS_SQL} {_TOP}")
def search_topk(spark, sf):
    return R.search_topk(vectors_of(spark, sf), _centroids(spark, sf))


@query("similar_pages", f"WITH {_VEC_SQL}, {_NEWEST_SQL} {_TOP}")
def similar_pages(spark, sf):
    return R.search_topk(vectors_of(spark, sf), _newest(spark, sf))


_DEEP_K = "CASE WHEN query_id % 2 = 0 THEN 1000000 ELSE 200 END"


@query("search_deep", f"WITH {_VEC_SQL}, {_NEWEST_SQL} {_TOP.replace('rk <= 10', f'rk <= {_DEEP_K}')}")
def search_deep(spark, sf):
    """A million pages for every other label, 200 for the rest, all ranked by threshold and slices."""
    asked = _newest(spark, sf).withColumn("k", F.expr(_DEEP_K).cast("bigint"))
    return R.search_topk(vectors_of(spark, sf), asked, rank_in_window=100)


_BITS_SQL = f"""planes AS MATERIALIZED (
  SELECT b, list(CASE WHEN CAST('0x' || substr(md5(b || ':' || (d // 32)), d % 32 + 1, 1) AS INTEGER) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END ORDER BY d) AS p
  FROM (SELECT unnest(range({R.SIGNATURE_BITS})) AS b), (SELECT unnest(range(64)) AS d) GROUP BY b),
bits AS MATERIALIZED (SELECT page_id, b, list_inner_product(v, p) >= 0 AS bit FROM ev, planes),
qbits AS MATERIALIZED (SELECT query_id, b, list_inner_product(q, p) >= 0 AS bit FROM qs, planes),
near AS (SELECT query_id, page_id FROM bits JOIN qbits USING (b) GROUP BY query_id, page_id
         HAVING count(*) FILTER (bits.bit <> qbits.bit) <= {R.hamming_radius(0.3)})"""


@query("search_ann", f"WITH {_VEC_SQL}, {_NEWEST_SQL}, {_BITS_SQL} {_TOP.replace('FROM qs, ev)', 'FROM qs JOIN near USING (query_id) JOIN ev USING (page_id))')}")
def search_ann(spark, sf):
    pages = vectors_of(spark, sf).select("page_id", "vector")
    return R.search_ann(R.build_signatures(pages, 64), pages, _newest(spark, sf))


_BANDS = B.plan_bands(0.7)
_PROBES_SQL = f"""{_VEC_SQL},
hd AS (SELECT min(page_id) AS page_id, v FROM ev GROUP BY v),
qs AS (SELECT min(page_id) AS query_id, v AS q FROM ev WHERE page_id % 20 = 0 GROUP BY v),
planes AS MATERIALIZED (
  SELECT b // {_BANDS.width} AS band, b % {_BANDS.width} AS i,
         list(CASE WHEN CAST('0x' || substr(md5(b || ':' || (d // 32)), d % 32 + 1, 1) AS INTEGER) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END ORDER BY d) AS p
  FROM (SELECT unnest(range({_BANDS.count * _BANDS.width})) AS b), (SELECT unnest(range(64)) AS d) GROUP BY b),
ix AS MATERIALIZED (SELECT page_id, band, CAST(sum(CASE WHEN list_inner_product(v, p) >= 0 THEN 1 << i ELSE 0 END) AS BIGINT) AS code FROM hd, planes GROUP BY page_id, band),
qm AS MATERIALIZED (SELECT query_id, band, i, list_inner_product(q, p) AS m FROM qs, planes),
qc AS (SELECT query_id, band, CAST(sum(CASE WHEN m >= 0 THEN 1 << i ELSE 0 END) AS BIGINT) AS own FROM qm GROUP BY query_id, band),
mk AS (SELECT mask FROM (SELECT unnest(range({1 << _BANDS.width})) AS mask) WHERE bit_count(mask) <= {_BANDS.flips}),
mb AS (SELECT mask, i FROM mk, (SELECT unnest(range({_BANDS.width})) AS i) WHERE (mask >> i) & 1 = 1),
cost AS (SELECT query_id, band, mask, sum(m * m) AS c FROM qm JOIN mb USING (i) GROUP BY ALL UNION ALL SELECT query_id, band, 0, 0.0 FROM qc),
pr AS (SELECT query_id, band, mask FROM cost QUALIFY row_number() OVER (PARTITION BY query_id, band ORDER BY c, mask) <= {_BANDS.probes}),
cand AS MATERIALIZED (SELECT DISTINCT query_id, page_id FROM pr JOIN qc USING (query_id, band) JOIN ix ON ix.band = pr.band AND ix.code = xor(own, mask))"""


@query("banded_candidates", f"WITH {_PROBES_SQL} SELECT query_id, page_id FROM cand")
def banded_candidates(spark, sf):
    """Which distinct vectors each of the distinct query vectors would score at 0.7."""
    vectors = vectors_of(spark, sf).select("page_id", "vector")
    heads, _ = B.classes_of(vectors)
    kinds, _ = B.classes_of(vectors.where("page_id % 20 = 0"))
    probes = B.probe_slots(kinds.withColumnRenamed("page_id", "query_id"), 64, _BANDS)
    return B.candidates(B.build_bands(heads, 64, _BANDS), probes)


@query(
    "search_banded",
    f"""WITH {_PROBES_SQL},
    sims AS (SELECT query_id, page_id, list_inner_product(q, v) / (sqrt(list_inner_product(q, q)) * sqrt(list_inner_product(v, v))) AS sim
             FROM cand JOIN qs USING (query_id) JOIN hd USING (page_id)),
    wide AS (SELECT a.page_id AS query_id, b.page_id, round(sim, 6) AS sim FROM sims JOIN qs ON qs.query_id = sims.query_id JOIN hd ON hd.page_id = sims.page_id
             JOIN ev a ON a.v = q AND a.page_id % 20 = 0 JOIN ev b ON b.v = hd.v WHERE sim > 0.7)
    SELECT query_id, CAST(rk AS INTEGER) AS rk, page_id, sim FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, page_id) AS rk FROM wide) WHERE rk <= 10""",
)
def search_banded(spark, sf):
    """Pages like every twentieth page, itself included."""
    vectors = vectors_of(spark, sf).select("page_id", "vector")
    return B.search_banded(vectors, vectors.where("page_id % 20 = 0").withColumnRenamed("page_id", "query_id"), 64, min_similarity=0.7)


def _hash_sql(name: str, source: str, key: str, text: str) -> str:
    """CTEs ``{name}_w(key, bucket, w)``: the non-zero sums of the hash embedder."""
    return f"""{name}_t AS (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS t FROM {source}),
{name}_w AS MATERIALIZED (SELECT {key}, bucket, sum(s) AS w FROM (
  SELECT {key}, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 384 AS bucket,
         CASE WHEN CAST('0x' || substr(md5(t), 9, 1) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END AS s FROM {name}_t)
  GROUP BY {key}, bucket HAVING sum(s) <> 0),
{name}_n AS MATERIALIZED (SELECT {key}, sqrt(sum(w * w)) AS norm FROM {name}_w GROUP BY {key})"""


@query(
    "embed_documents",
    f"""WITH {_hash_sql("d", "documents", "doc_id", "text")}
        SELECT doc_id, CAST(bucket AS INTEGER) AS bucket, round(CAST(w AS DOUBLE) / norm, 6) AS weight FROM d_w JOIN d_n USING (doc_id)""",
)
def embed_documents(spark, sf):
    vectors = embed_texts(table(spark, sf, "documents"), ["doc_id"], "text", unit=True)
    cells = vectors.select("doc_id", F.posexplode("vector").alias("bucket", "weight"))
    return cells.where("weight <> 0").select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@query(
    "embed_chunks",
    f"""WITH RECURSIVE s AS (
      SELECT doc_id // 128 AS g, doc_id, CAST(strlen(text) AS BIGINT) AS n, row_number() OVER (PARTITION BY doc_id // 128 ORDER BY doc_id) AS rn FROM documents),
    walk AS (
      SELECT g, doc_id, n, rn, CASE WHEN n > {CHUNK_BYTES} THEN -1 ELSE 0 END AS last, CASE WHEN n > {CHUNK_BYTES} THEN 0 ELSE n END AS used,
             n <= {CHUNK_BYTES} AS open, CASE WHEN n > {CHUNK_BYTES} THEN -1 ELSE 0 END AS chunk FROM s WHERE rn = 1
      UNION ALL
      SELECT s.g, s.doc_id, s.n, s.rn,
             CASE WHEN s.n > {CHUNK_BYTES} THEN last WHEN open AND used + s.n <= {CHUNK_BYTES} THEN last ELSE last + 1 END,
             CASE WHEN s.n > {CHUNK_BYTES} THEN 0 WHEN open AND used + s.n <= {CHUNK_BYTES} THEN used + s.n ELSE s.n END,
             s.n <= {CHUNK_BYTES},
             CASE WHEN s.n > {CHUNK_BYTES} THEN -1 WHEN open AND used + s.n <= {CHUNK_BYTES} THEN last ELSE last + 1 END
      FROM walk JOIN s ON s.g = walk.g AND s.rn = walk.rn + 1)
    SELECT g, doc_id, n AS n_bytes, CAST(chunk AS BIGINT) AS chunk FROM walk""",
)
def embed_chunks(spark, sf):
    """Blocks of 128 consecutive documents, chunked at 8,000 bytes."""
    sized = table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 128).alias("g"), "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes")
    )
    return assign_chunks(sized, "g", "doc_id", "n_bytes", CHUNK_BYTES)


_REQUESTS_SQL = """rq AS (SELECT event_id AS query_id, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS q,
  ['', '0', '-1', 'abc', '1000000', '+5', '10'][1 + event_id % 7] AS lim FROM events)"""


@query(
    "validate_queries",
    f"""WITH {_REQUESTS_SQL}, a AS (SELECT *, CASE WHEN lim = '' THEN 10 ELSE TRY_CAST(lim AS BIGINT) END AS asked FROM rq),
        g AS (SELECT *, q <> '' AND coalesce(asked > 0, false) AS good FROM a)
        SELECT query_id, q, CASE WHEN good THEN asked END AS k, CASE WHEN good THEN 200 ELSE 400 END AS status FROM g""",
)
def validate_queries(spark, sf):
    limits = F.array([F.lit(x) for x in ["", "0", "-1", "abc", "1000000", "+5", "10"]])
    requests = table(spark, sf, "events").select(
        F.col("event_id").alias("query_id"),
        F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("q"),
        F.get(limits, (F.col("event_id") % 7).cast("int")).alias("limit"),
    )
    return R.validate_requests(requests)


_DOC_TEXT_SQL = "'Title: ' || source || '. ' || 'Content: ' || text || '.'"
_SEMANTIC_SQL = f"""dt AS (SELECT doc_id, {_DOC_TEXT_SQL} AS txt FROM documents),
{_hash_sql("d", "dt", "doc_id", "txt")},
{_hash_sql("q", "benchmark", "item_id", "text")},
hits AS (SELECT query_id, page_id, sim, CAST(rk AS INTEGER) AS rk FROM (
  SELECT query_id, page_id, round(sim, 6) AS sim, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 6) DESC, page_id) AS rk FROM (
    SELECT item_id AS query_id, doc_id AS page_id, sum(CAST(d_w.w AS DOUBLE) * q_w.w) / any_value(d_n.norm * q_n.norm) AS sim
    FROM q_w JOIN d_w USING (bucket) JOIN d_n USING (doc_id) JOIN q_n USING (item_id) GROUP BY item_id, doc_id) WHERE sim > 0.3) WHERE rk <= 10)"""


def _doc_pages(spark, sf) -> DataFrame:
    url = F.concat(F.lit("https://docs.example.com/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("page_id"), url.alias("url"), F.col("source").alias("title"), F.lit("").alias("description"), F.col("text").alias("content")
    )


def _requests(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"), F.lit("").alias("limit"))


def _search_documents(spark, sf) -> DataFrame:
    return semantic_search(_doc_pages(spark, sf), _requests(spark, sf))


@query("semantic_search", f"WITH {_SEMANTIC_SQL} SELECT query_id, rk, page_id, sim FROM hits")
def semantic(spark, sf):
    return _search_documents(spark, sf)


@query(
    "search_json",
    f"""WITH {_SEMANTIC_SQL}, r AS (
      SELECT query_id, list({{'url': 'https://docs.example.com/' || source || '/' || doc_id, 'title': source, 'description': ''}} ORDER BY rk) AS pages
      FROM hits JOIN documents ON doc_id = page_id GROUP BY query_id)
    SELECT item_id AS query_id, CASE WHEN pages IS NULL THEN '{{"pages":[]}}' ELSE CAST(to_json({{'pages': pages}}) AS VARCHAR) END AS response
    FROM benchmark LEFT JOIN r ON item_id = query_id""",
)
def search_json(spark, sf):
    hits = R.with_page_fields(_search_documents(spark, sf), _doc_pages(spark, sf))
    return R.search_responses(_requests(spark, sf), hits)


@query(
    "search_json_parts",
    f"""WITH {_SEMANTIC_SQL}, r AS (
      SELECT query_id, (rk - 1) // 4 AS part, list({{'url': 'https://docs.example.com/' || source || '/' || doc_id, 'title': source, 'description': ''}} ORDER BY rk) AS pages
      FROM hits JOIN documents ON doc_id = page_id GROUP BY ALL)
    SELECT item_id AS query_id, CAST(coalesce(part, 0) AS BIGINT) AS part, CAST(coalesce(max(part) OVER (PARTITION BY item_id), 0) + 1 AS BIGINT) AS parts,
      CASE WHEN pages IS NULL THEN '{{"pages":[]}}' ELSE CAST(to_json({{'pages': pages}}) AS VARCHAR) END AS response
    FROM benchmark LEFT JOIN r ON item_id = query_id""",
)
def search_json_parts(spark, sf):
    hits = R.with_page_fields(_search_documents(spark, sf), _doc_pages(spark, sf))
    return R.search_response_parts(_requests(spark, sf), hits, part_rows=4)


@query("empty_searches", f"WITH {_SEMANTIC_SQL} SELECT item_id AS query_id FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM hits)")
def empty_searches(spark, sf):
    return R.empty_searches(_requests(spark, sf), _search_documents(spark, sf))


_WAITING = "vector IS NULL AND can_be_vectorized"


@query(
    "index_pass",
    f"""WITH {SQL_PAGE_TABLE}, x AS (
      SELECT *, 'Title: ' || title || '. Description: ' || description || '. ' || CASE WHEN content <> '' THEN 'Content: ' || content || '.' ELSE '' END AS txt FROM pt),
    todo AS (SELECT page_id, txt FROM x WHERE {_WAITING} AND strlen(txt) <= {S.MAX_CHUNK_BYTES}),
    {_hash_sql("d", "todo", "page_id", "txt")},
    c AS (SELECT page_id, sum(CAST(w AS DOUBLE) / norm * (bucket + 1)) AS s FROM d_w JOIN d_n USING (page_id) GROUP BY page_id)
    SELECT x.page_id, url, CASE WHEN {_WAITING} THEN strlen(txt) <= {S.MAX_CHUNK_BYTES} ELSE can_be_vectorized END AS can_be_vectorized,
      round(CASE WHEN vector IS NOT NULL THEN {checksum_sql("vector")} ELSE c.s END, 5) AS checksum
    FROM x LEFT JOIN c USING (page_id)""",
)
def indexed(spark, sf):
    pages = page_table(spark, sf).withColumn("vector", F.col("vector").cast("array<double>"))
    done = index_pass(pages)
    return done.select("page_id", "url", "can_be_vectorized", checksum().alias("checksum"))


