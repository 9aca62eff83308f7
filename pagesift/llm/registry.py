"""The operators as queries over the given tables, with the SQL that some of them must equal."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.bilinear_lm import score_texts
from pagesift.llm.common import prepare, read_table
from pagesift.llm.decontaminate import find_contamination
from pagesift.llm.html_consensus import extract_pages
from pagesift.llm.importance_resampling import BUCKETS, MIN_WORDS, PERCENT, SEED, resample
from pagesift.llm.language_id import held_out, identify, train
from pagesift.llm.license_scan import BLANK, LINE_STOP, NOTICES, STOP, THRESHOLD, bigrams, family_of, scan_licenses
from pagesift.llm.line_templates import DEPTH, MIN_DOCS, SIMILARITY, drop_recurring_lines
from pagesift.llm.ngram_join import ngram_join
from pagesift.llm.quality_rules import BASE, quality_rules
from pagesift.llm.sentencepiece_codec import encode
from pagesift.llm.substring_dedup import substring_dedup
from pagesift.llm.vector_packing import shard_documents
from pagesift.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        @wraps(run)
        def shipped(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark)
            return run(spark, folder)

        QUERIES[name] = shipped
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


_SPACES = "[\\x20\\x09-\\x0D]+"


def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{_SPACES}'), lambda x: x <> '')"


_OP1_SQL = f"""
WITH d AS (SELECT doc_id, {words_sql("text")} AS w FROM documents),
st AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20),
win AS (SELECT st.doc_id, st.p, array_to_string(d.w[st.p : st.p + 19], ' ') AS seq FROM st JOIN d USING (doc_id)),
rep AS (SELECT doc_id, p FROM (
  SELECT doc_id, p, row_number() OVER (PARTITION BY seq ORDER BY doc_id, p) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM rep),
lost AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN w
         ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(ps, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id)"""


@query("op1_substring_dedup", _OP1_SQL)
def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup(read_table(spark, folder, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


_OP4_TOKENS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _bench_words_sql(text: str) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"list_filter(regexp_split_to_array(translate(coalesce({text}, ''), '{upper}', '{lower}'), '{_OP4_TOKENS}'), lambda x: x <> '')"


_OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_bench_words_sql("text")} AS w FROM documents),
b AS (SELECT item_id, {_bench_words_sql("text")} AS w FROM benchmark),
pat AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS seq FROM (
  SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
win AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS seq FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM pat) WHERE len(w) >= n)),
occ AS (SELECT doc_id, p, win.n, item_id FROM win JOIN pat USING (n, seq)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS p FROM occ) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)"""


@query("op4_decontaminate", _OP4_SQL)
def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    found = find_contamination(docs, read_table(spark, folder, "benchmark"), window=13)
    ids = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "contaminated")


_OP2_SQL = f"""
WITH ln AS (SELECT doc_id, i, ls[i] AS line FROM (
  SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
w AS (SELECT doc_id, i, list_transform({words_sql("line")}, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM ln),
inst AS (SELECT doc_id, w, min(i) AS i FROM w WHERE len(w) > 0 GROUP BY doc_id, w),
di AS (SELECT *, len(w) AS size, w[1:{DEPTH}] AS head FROM inst),
leaf AS (SELECT size, head FROM di GROUP BY size, head HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
hot AS (SELECT di.* FROM di JOIN leaf USING (size, head)),
pl AS (SELECT doc_id, w, size, head, p, w[p] AS word FROM (SELECT *, unnest(range({DEPTH} + 1, size + 1)) AS p FROM hot) WHERE w[p] <> '<*>'),
con AS (SELECT size, head, p, word FROM pl GROUP BY size, head, p, word HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
kept AS (SELECT w, list((p, word) ORDER BY p) AS cs, count(*) AS k FROM (SELECT DISTINCT w, size, head, p, word FROM pl) JOIN con USING (size, head, p, word) GROUP BY w),
shape AS (SELECT hot.*, cs FROM hot LEFT JOIN kept USING (w) WHERE len(list_filter(head, lambda x: x <> '<*>')) + coalesce(k, 0) >= {SIMILARITY} * size),
tn AS (SELECT size, head, cs, count(DISTINCT doc_id) AS docs, min((doc_id, i)) AS fst FROM shape GROUP BY size, head, cs),
tpl AS (SELECT DISTINCT shape.w, docs, fst FROM shape JOIN tn ON tn.size = shape.size AND tn.head = shape.head AND tn.cs IS NOT DISTINCT FROM shape.cs),
gone AS (SELECT w.doc_id, w.i FROM w JOIN tpl ON w.w = tpl.w WHERE docs >= {MIN_DOCS} AND (w.doc_id, w.i) <> fst),
lost AS (SELECT doc_id, count(*) AS n, list(i) AS ps FROM gone GROUP BY doc_id),
d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents)
SELECT d.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_dropped,
       sha256(CASE WHEN n IS NULL THEN text ELSE array_to_string(
         list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(ps, i)), lambda i: ls[i]), chr(10)) END) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id)"""


@query("op2_line_templates", _OP2_SQL)
def op2_line_templates(spark: SparkSession, folder: str) -> DataFrame:
    found = drop_recurring_lines(read_table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_rules(read_table(spark, folder, "documents").select("doc_id", "text", "lang"), read_table(spark, folder, "labels"))
    return found.select("doc_id", *BASE, "base_failed", "kept", "stratum", "rejected_by")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP5_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {words_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
st AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS p FROM d WHERE len(w) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 2], ' ') AS g FROM st),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
ov AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM ov JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id
FROM documents LEFT JOIN sz USING (doc_id) LEFT JOIN low USING (doc_id)"""


@query("op5_ngram_join", _OP5_SQL)
def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    members, _ = ngram_join(read_table(spark, folder, "documents").select("doc_id", "text"), size=3, num=90, den=100)
    return members.select("doc_id", "n_shingles", "component_id")


@query("op6_vector_packing")
def op6_vector_packing(spark: SparkSession, folder: str) -> DataFrame:
    found = shard_documents(read_table(spark, folder, "documents").select("doc_id", "text"), shards=40)
    grown = F.lit(None).cast("int").alias("grown_shard")
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", grown, "n_tokens")


def _list_sql(texts: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in texts) + "]"


_OP7_TEMPLATES = ", ".join(
    f"('{name}', '{family}', {_list_sql(marks)}, {_list_sql([m for m in marks if m in grams])}, {_list_sql(grams)})"
    for name, grams, (family, marks) in ((name, bigrams(text), family_of(name)) for name, text in NOTICES)
)
_OP7_SQL = f"""
WITH tpl AS (SELECT * FROM (VALUES {_OP7_TEMPLATES}) AS t(license, family, marks, own, t)),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents WHERE text IS NOT NULL),
pg AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '{BLANK}'), lambda x: contains(x, chr(10)))) AS s FROM documents WHERE text IS NOT NULL),
li AS (SELECT doc_id, list_filter(regexp_split_to_array(s, '{LINE_STOP}'), lambda x: regexp_matches(x, '[A-Za-z0-9]')) AS p FROM ln),
pi AS (SELECT doc_id, list_filter(regexp_split_to_array(s, '{STOP}'), lambda x: regexp_matches(x, '[A-Za-z0-9]')) AS p FROM pg),
seg AS (SELECT * FROM ln UNION ALL SELECT * FROM pg UNION ALL SELECT doc_id, unnest(p) FROM li WHERE len(p) > 1
  UNION ALL SELECT doc_id, unnest(list_filter(p, lambda x: contains(trim(x, ' ' || chr(9) || chr(13) || chr(10)), chr(10)))) FROM pi WHERE len(p) > 1),
wd AS (SELECT doc_id, row_number() OVER () AS k,
  string_split(trim(regexp_replace(translate(s, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM seg),
gr AS (SELECT doc_id, k, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM wd WHERE len(w) > 1),
sc AS (SELECT doc_id, k, license, family, CAST(2 * len(list_intersect(g, t)) AS DOUBLE) / (len(g) + len(t)) AS dice,
  list_sort(list_intersect(g, marks)) <> list_sort(own) AS other
  FROM gr JOIN tpl ON 2 * least(len(g), len(t)) >= {THRESHOLD} * (len(g) + len(t)) AND list_has_any(g, t)),
nm AS (SELECT doc_id, k, other, dice, CASE WHEN other THEN family ELSE license END AS license FROM sc WHERE dice >= {THRESHOLD}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY other, dice DESC, license) AS r FROM nm) WHERE r = 1)
SELECT doc_id, license, count(*) AS n_segments, max(dice) AS dice FROM best GROUP BY doc_id, license"""


@query("op7_license_scan", _OP7_SQL)
def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(read_table(spark, folder, "documents").select("doc_id", "text"))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = identify(docs, train(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op9_sentencepiece")
def op9_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return encode(docs, check=True).select("doc_id", "n_tokens", "ids", "round_trip")


@query("op10_html_consensus")
def op10_html_consensus(spark: SparkSession, folder: str) -> DataFrame:
    return extract_pages(read_table(spark, folder, "pages").select("page_id", "url", "html"))


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whiten(read_table(spark, folder, "embeddings"), components=4)
    return found.withColumn("deviation", F.col("deviation").try_cast("bigint"))


@query("op12_bilinear_lm")
def op12_bilinear_lm(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(read_table(spark, folder, "documents"))


_CRC32_TABLE = "list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"

_OP13_SQL = f"""
WITH d AS (SELECT doc_id, {_bench_words_sql("text")} AS w FROM documents),
b AS (SELECT {_bench_words_sql("text")} AS w FROM benchmark),
df AS (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(w) AS f FROM d) GROUP BY doc_id, f),
bf AS (SELECT f, count(*) AS n FROM (SELECT unnest(w) AS f FROM b) GROUP BY f),
tb AS (SELECT {_CRC32_TABLE} AS t),
hx AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)),
oc AS (SELECT f, list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))) AS x FROM hx),
bk AS (SELECT f, xor(list_reduce(x, lambda s, y: xor(s >> 8, t[(xor(s, y) & 255) + 1])), 4294967295) % {BUCKETS} AS k FROM oc, tb),
sc AS (SELECT k, sum(n) AS n FROM df JOIN bk USING (f) GROUP BY k),
tc AS (SELECT k, sum(n) AS n FROM bf JOIN bk USING (f) GROUP BY k),
al AS (SELECT (SELECT coalesce(sum(n), 0) FROM sc) AS s, (SELECT coalesce(sum(n), 0) FROM tc) AS t),
gn AS (SELECT k, CAST(floor(1000 * ln((CAST(coalesce(tc.n, 0) AS DOUBLE) + 1) * (s + {BUCKETS}) / ((CAST(coalesce(sc.n, 0) AS DOUBLE) + 1) * (t + {BUCKETS})))) AS BIGINT) AS g
  FROM (SELECT DISTINCT k FROM bk) LEFT JOIN sc USING (k) LEFT JOIN tc USING (k), al),
wt AS (SELECT doc_id, sum(n) AS n, sum(n * g) AS g FROM df JOIN bk USING (f) JOIN gn USING (k) GROUP BY doc_id),
x AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features,
  CAST(CASE WHEN g IS NULL THEN 0 WHEN g >= 0 THEN g // n ELSE -((n - 1 - g) // n) END AS BIGINT) AS weight,
  CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN wt USING (doc_id)),
y AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / 4294967296))) AS BIGINT) AS score FROM x),
rk AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM y WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {PERCENT} * n // 100 THEN r END AS rank FROM y LEFT JOIN rk USING (doc_id)"""


@query("op13_importance_resampling", _OP13_SQL)
def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    found = resample(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"), low=1, high=1)
    return found.select("doc_id", "n_features", "weight", "score", "rank")
