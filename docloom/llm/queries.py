"""The registered queries of the corpus operators, one for each, over their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_text, imatch, license_scan, packing, prefix_trie, simhash, token_alignment, token_counts, topk, toxicity, url_filter, warc
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = decontamination.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return report.drop("items", "spans")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("fp")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("n_offending", F.size("sentences").cast("bigint")).drop("sentences")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_documents(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_tokens(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_license_scan,
        op3_decontamination,
        op4_simhash,
        op5_packing,
        op6_url_filter,
        op7_top_k,
        op8_html_text,
        op9_warc,
        op10_toxicity,
        op11_fingerprints,
        op12_prefix_trie,
        op13_token_alignment,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(w)) AS n,
         array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS win
  FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT r, i, s.n AS n, array_to_string(list_slice(w, i, i + s.n - 1), ' ') AS win
  FROM d, sizes s, LATERAL (SELECT unnest(range(1, len(w) - s.n + 2)) AS i) WHERE len(w) >= s.n),
hit AS (SELECT dw.r, dw.i, dw.n, iw.item FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
words_hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit USING (r) LEFT JOIN items USING (r)
"""

OP6_SQL = f"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM p),
s AS (SELECT page_id, {_LOWER.format("raw_host")} AS host, regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM h),
m AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
              WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM s)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN {" OR ".join(f"contains('.' || host, '.{x}.')" for x in url_filter.OWN_LABELS)} THEN 'block' ELSE 'allow' END AS verdict
FROM m
"""

OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""

OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM m
"""

_TERMS = r"list_transform(list_distinct(list_filter(regexp_split_to_array(lower({}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')), lambda w: CAST('0x' || left(md5(w), 15) AS BIGINT))"
_LIKE = """CASE WHEN {0} = {1} THEN 1.0 WHEN {0}[1] = '=' OR {1}[1] = '=' THEN 0.0 WHEN abs({0}_s - {1}_s) > 2 THEN 0.0
  WHEN len(list_distinct(list_transform({0}_p[1 + greatest({1}_s - {0}_s, 0)] || {1}_p[1 + greatest({0}_s - {1}_s, 0)], lambda x: x[1:2]))) = 0 THEN 0.0
  ELSE len(list_intersect({0}_p[1 + greatest({1}_s - {0}_s, 0)], {1}_p[1 + greatest({0}_s - {1}_s, 0)])) / CAST(len(list_distinct(list_transform({0}_p[1 + greatest({1}_s - {0}_s, 0)] || {1}_p[1 + greatest({0}_s - {1}_s, 0)], lambda x: x[1:2]))) AS DOUBLE) END"""

OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, text, length(text) AS n, row_number() OVER w AS r, count(*) OVER () AS total, lead(text) OVER w AS led, first_value(text) OVER w AS first FROM d WINDOW w AS (ORDER BY doc_id NULLS FIRST, text)),
e AS (SELECT doc_id, r, total, n, text, left(text, n - n // 2) || left(CASE WHEN r = total THEN first ELSE led END, n // 2) AS edited FROM s),
v AS (SELECT r, 'a' AS v, text AS x, {_TERMS.format("text")} AS ts FROM e UNION ALL SELECT r, 'b', edited, {_TERMS.format("edited")} FROM e),
z AS (SELECT r, v, x, ts, len(list_filter(range(0, 40), lambda k: (64 << k) <= len(ts))) AS step FROM v),
h AS (SELECT r, v, step, unnest(ts) AS t FROM z),
lex AS (SELECT t FROM h WHERE v = 'a' GROUP BY t HAVING count(*) >= 2 AND count(*) <= greatest(2, floor((SELECT count(*) FROM d) * CAST(0.1 AS DOUBLE)))),
parts AS (SELECT r, v, k, printf('%02x', t % 64) AS part, left(md5(string_agg(CAST(t AS VARCHAR), ',' ORDER BY t)), 4) AS hash
  FROM h SEMI JOIN lex USING (t), range(0, 3) k(k) WHERE (t >> 6) % (1 << CAST(step + k AS INTEGER)) = 0 GROUP BY r, v, k, t % 64),
segs AS (SELECT r, v, k, list(part || hash ORDER BY part) AS p FROM parts GROUP BY r, v, k),
fp AS (SELECT z.r, z.v, z.step AS s, [coalesce(s0.p, []), coalesce(s1.p, []), coalesce(s2.p, [])] AS p,
    CASE WHEN s0.p IS NULL THEN '=' || md5(x) ELSE CAST(z.step AS VARCHAR) || ';' || array_to_string(s0.p, ',') || ';' || array_to_string(coalesce(s1.p, []), ',') || ';' || array_to_string(coalesce(s2.p, []), ',') END AS f
  FROM z LEFT JOIN segs s0 ON s0.r = z.r AND s0.v = z.v AND s0.k = 0 LEFT JOIN segs s1 ON s1.r = z.r AND s1.v = z.v AND s1.k = 1 LEFT JOIN segs s2 ON s2.r = z.r AND s2.v = z.v AND s2.k = 2),
j AS (SELECT e.doc_id, e.n, e.edited, a.f AS a, a.s AS a_s, a.p AS a_p, b.f AS b, b.s AS b_s, b.p AS b_p, c.f AS c, c.s AS c_s, c.p AS c_p
  FROM e JOIN fp a ON a.r = e.r AND a.v = 'a' JOIN fp b ON b.r = e.r AND b.v = 'b' JOIN fp c ON c.r = e.r % e.total + 1 AND c.v = 'a')
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, a AS fingerprint, b AS edited_fingerprint,
  CAST({_LIKE.format("a", "b")} AS DOUBLE) AS near_edited,
  CAST({_LIKE.format("a", "c")} AS DOUBLE) AS near_next
FROM j
"""

_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT))),
  lambda acc, x: list_reduce([xor(acc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)))"""

OP12_SQL = f"""
WITH s AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(CAST(length(role) AS VARCHAR) || ':' || role || text)) AS k FROM s),
c AS (SELECT conv_id, max(k) AS own, {_CRC32} % 6 AS h, conv_id - conv_id % 100 AS base FROM t GROUP BY conv_id),
l AS (SELECT c.*, least(c.h, coalesce(b.own, 0)) AS taken FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT l.conv_id, t.k AS place, role, text FROM l JOIN t ON t.conv_id = l.base WHERE t.k <= l.h
  UNION ALL SELECT l.conv_id, t.k - l.h + l.taken, role, text FROM l JOIN t ON t.conv_id = l.conv_id WHERE t.k > l.h),
p AS (SELECT conv_id, place AS depth, length(text) AS chars, list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY place) AS path FROM r
  UNION ALL SELECT conv_id, 0, 0, [] FROM l),
m AS (SELECT conv_id, depth, chars, min(conv_id) OVER (PARTITION BY depth, path) AS node, max(depth) OVER (PARTITION BY conv_id) AS last FROM p),
n AS (SELECT node, depth, count(*) AS n_convs, max(chars) AS chars, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last = depth) AS ends FROM m GROUP BY 1, 2),
u AS (SELECT n.*, m.node AS parent FROM n LEFT JOIN m ON m.conv_id = n.node AND m.depth = n.depth - 1),
k AS (SELECT parent, depth - 1 AS depth, count(*) AS n_children FROM u WHERE parent IS NOT NULL GROUP BY 1, 2),
w AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN k ON k.parent = u.node AND k.depth = u.depth),
sub AS (SELECT m.node, m.depth, sum(CAST(w.n_children = 0 AS BIGINT)) AS n_leaves, sum((w.n_convs - 1) * w.chars) AS saved FROM w JOIN m ON m.conv_id = w.node AND m.depth <= w.depth GROUP BY 1, 2)
SELECT w.node AS conv_id, w.depth AS depth, w.parent AS parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM w JOIN sub ON sub.node = w.node AND sub.depth = w.depth
"""

SQL = {"op12_prefix_trie": OP12_SQL, "op11_fingerprints": OP11_SQL, "op3_decontamination": OP3_SQL, "op6_url_filter": OP6_SQL, "op7_top_k": OP7_SQL, "op9_warc": OP9_SQL}


def queries() -> dict:
    """All queries of the corpus operators and the pipeline."""
    return {**QUERIES, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
