"""Queries of ingestion, layout, fields, kinds, sections and tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import columns as C
from docloom.operators import documents, ingest, tables

from .standins import DOC_PAGES, ITEMS, LINES, doc_pages, items, lines, read

# Keywords that occur in the given texts, in place of those of financial documents.
KINDS = {"kind_a": ("the", "tion", "ing", "er ", "an "), "kind_b": ("de ", "que", "ción", "los", "la "), "kind_c": ("ich", "und", "der ", "sch", "ein")}
NEGATIVE = {"kind_a": ("mente", "schaft"), "kind_b": ("idiot", "license"), "kind_c": ("example", "http")}


def ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"), F.concat(F.lit("t"), (F.col("doc_id") % 3).cast("string")).alias("tenant_id"), F.col("doc_id").alias("arrived"),
        F.concat(F.when(F.col("doc_id") % 5 != 0, F.lit("%PDF")).otherwise(F.lit("PK..")), F.coalesce("text", F.lit(""))).cast("binary").alias("content"),
    )
    return ingest.outcomes(files, max_bytes=3000).select("file_id", "status", "error_code", "priority")


def dedup_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    new, seen = d.filter(F.col("doc_id") % 4 != 0), d.filter(F.col("doc_id") % 4 == 0)
    return ingest.unseen(ingest.first_of_each(new.withColumn("sha", C.sha_id(F.col("content"))), ["sha"], "doc_id"), seen.select(C.sha_id(F.col("content")).alias("sha")), ["sha"]).select("doc_id", "sha")


def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.lit(100.0).alias("width"), F.lit(50.0).alias("height"),
        F.lit(0.0).alias("x0"), F.lit(0.0).alias("top"), (F.col("l_quantity") * 2 - 6).alias("x1"), (F.col("l_linenumber") * 10.0).alias("bottom"),
    )
    return documents.page_class(chars)


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = doc_pages(spark, sf_dir)
    ocr = p.filter(F.col("page") % 2 == 0).select("doc_id", "page", F.concat(F.lit("ocr "), F.coalesce("text", F.lit(""))).alias("text"))
    scanned = F.length(F.coalesce("text", F.lit(""))) % 3 == 0  # pages without text of their own
    return documents.page_text(p.withColumn("text", F.when(~scanned, F.col("text"))), ocr)


def line_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, x = F.col("quantity") % 12, F.col("seq") * 40.0
    blocks = items(spark, sf_dir).select(
        "doc_id", F.lit(1).alias("page"), "seq", F.concat(F.lit("p"), F.col("part").cast("string")).alias("text"), x.alias("x0"), y.alias("y0"), (x + 30).alias("x1"), (y + 10).alias("y1")
    )
    return documents.group_lines(blocks)


def keyword_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    return t.select("doc_id", *[F.round(C.keyword_density(F.col("t"), w), 8).alias(k) for k, w in KINDS.items()])


def schema_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.detect_kind(read(spark, sf_dir, "documents"), KINDS, NEGATIVE, least=0.1, gap=1.2)


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.sections(documents.page_profiles(doc_pages(spark, sf_dir), KINDS), list(KINDS))


FIELDS = {"code": (r"\b(\d{4,})\b", r"\b(\d{2,3})\b"), "word": (r"(?:^| )(th[a-z]{6,})[ .,]", r"^([a-z]{3,})[ .,]"), "mail": (r"([a-z0-9]+@[a-z0-9.]+\.com)",)}


def find_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents.find_fields(lines(spark, sf_dir), FIELDS, ["seq"], {})
    return found.select("doc_id", "field", "value", "seq")


def field_abstentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents.find_fields(lines(spark, sf_dir), FIELDS, ["seq"], {})
    return documents.abstentions(read(spark, sf_dir, "documents"), found, list(FIELDS))


def _order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for every line item: its page is the line number, headers and rows follow from the item."""
    i = items(spark, sf_dir)
    headers = F.when(F.col("quantity") < 20, F.array(F.lit("Date"), F.lit("Amount"))).when(F.col("quantity") < 35, F.array(F.lit("ISIN"), F.lit("Name of paper"), F.lit("Qty"))).otherwise(F.array().cast("array<string>"))
    return i.select("doc_id", F.col("seq").alias("page"), F.col("seq").alias("table_seq"), headers.alias("headers"), F.array(F.col("part").cast("string")).alias("rows"))


def best_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = tables.best_table(_order_tables(spark, sf_dir), ("ISIN", "Name", "Price"))
    return best.select("doc_id", "table_seq", F.round("header_score", 6).alias("header_score"))


def stitch_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.stitch_tables(_order_tables(spark, sf_dir))
    return s.select("doc_id", "table_seq", F.array_join("rows", ",").alias("rows"), F.array_join("pages", ",").alias("pages"))


def merge_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.merge_same_headers(_order_tables(spark, sf_dir))
    return s.select("doc_id", "table_seq", F.array_join("headers", "|").alias("headers"), F.array_join("rows", ",").alias("rows"))


def _rails(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    i = read(spark, sf_dir, "lineitem")
    values = F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_returnflag"), F.col("l_linestatus"))
    a = i.select(F.col("l_orderkey").alias("table_key"), F.col("l_linenumber").alias("r"), F.posexplode(values).alias("c", "v"))
    b = a.filter(~((F.col("table_key") % 31 == 0) & (F.col("r") == 1))).withColumn("v", F.when((F.col("table_key") % 13 == 0) & (F.col("c") == F.col("r") % 4), F.concat(F.col("v"), F.lit("x"))).otherwise(F.concat(F.lit(" "), F.lower("v"))))
    return a, b


def triangulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.triangulate(*_rails(spark, sf_dir))


def triangulate_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that differ by one letter more: alike if they are long, not if they are short."""
    i = items(spark, sf_dir)
    a = i.select(F.col("doc_id").alias("table_key"), F.col("seq").alias("r"), F.posexplode(F.array(F.col("part").cast("string"), F.concat(F.lit("item "), F.col("part").cast("string")))).alias("c", "v"))
    b = a.filter(~((F.col("table_key") % 31 == 0) & (F.col("r") == 1))).withColumn("v", F.when((F.col("table_key") + F.col("r")) % 5 == 0, F.concat("v", F.lit("x"))).otherwise(F.col("v")))
    return tables.triangulate(a, b, fuzzy=True)


# Personal data of every form, by the document's number: texts hold some of them only.
SECRETS = ("a.b@mail.example.com", "GB29 NWBK 6016 1331 9268 19", "DE89370400440532013000", "3782 822463 10005", "4111-1111-1111-1111", "123-45-6789", "10.20.30.40", "+44 20 7946 0958", "07911 123456", "555-123-4567", "+1 (555) 123-4567", "no. 12 of 2024")


# The six forms as the oracle states them: mail, IBAN, cards, social security, addresses, telephones.
_FORMS = (
    r"[[:alnum:]._%+-]+@[[:alnum:].-]+[.][[:alpha:]]{2,}",
    r"\b[[:upper:]]{2}[0-9]{2}( ?[[:upper:]0-9]{4}){2,7}( ?[[:upper:]0-9]{1,3})?\b",
    r"\b([0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,4}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})\b",
    r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    r"\b[0-9]{1,3}([.][0-9]{1,3}){3}\b",
    r"[+][0-9]{1,3}[ .-]?([(][0-9]{1,4}[)][ .-]?)?[0-9]{1,4}([ .-]?[0-9]{2,4}){1,4}\b",
    r"([(][0-9]{3}[)] ?|\b[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b",
    r"\b0[0-9]{4}[ -]?[0-9]{6}\b",
    r"\b0[0-9]{2,4}[ -][0-9]{3,4}[ -]?[0-9]{3,4}\b",
)
PERSONAL = "|".join(f"({f})" for f in _FORMS)


def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    secret = F.element_at(F.array(*[F.lit(x) for x in SECRETS]), (F.col("doc_id") % len(SECRETS) + 1).cast("int"))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\nsee "), secret, F.lit(" there"))
    once = d.select("doc_id", C.redacted(text).alias("r")).select("doc_id", F.col("r.text").alias("red"), F.col("r.log").alias("log"))
    last = F.get("log", F.size("log") - 1)
    hidden = F.aggregate("log", F.lit(0), lambda s, x: s + x["end"] - x["start"])
    return once.select("doc_id", F.md5("red").alias("redacted_md5"), F.size("log").cast("bigint").alias("redactions"), hidden.cast("bigint").alias("hidden"), last["entity_type"].alias("last_entity"), last["start"].cast("bigint").alias("last_start"))


def parse_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    plain = F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    k = F.col("o_orderkey") % 6
    raw = F.when(k == 0, F.concat(F.lit("("), plain, F.lit(")"))).when(k == 1, F.concat(F.lit("-€"), plain)).when(k == 2, F.concat(F.lit(" £ 1,"), F.lpad(plain, 12, "0"))).when(k == 3, F.lit("$")).when(k == 4, F.concat(F.lit("EUR"), plain)).otherwise(plain)
    return o.select("o_orderkey", C.parse_amount(raw).alias("amount"), C.to_float(raw).alias("loose"))


def parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    raw = F.when(k == 0, F.date_format(d, "dd/MM/yyyy")).when(k == 1, F.date_format(d, "yyyy-MM-dd")).when(k == 2, F.date_format(d, "d.M.yyyy")).when(k == 3, F.date_format(d, "d MMM yyyy")).when(k == 4, F.date_format(d, "MMMM d, yyyy")).otherwise(F.date_format(d, "yyyyMMdd"))
    return o.select("o_orderkey", C.parse_date(raw).alias("iso"), C.parse_swift_date(raw).alias("swift"))


def header_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("page")
    p = doc_pages(spark, sf_dir).withColumn("before", F.coalesce(F.lag("text").over(w), F.lit("")))
    return p.select("doc_id", "page", F.round(documents.signature_overlap(F.col("before"), F.coalesce("text", F.lit(""))), 6).alias("overlap"))


QUERIES = {f.__name__: f for f in (ingest_rejects, dedup_sha, page_coverage, page_text, line_grouping, keyword_density, schema_route, sections, find_field, field_abstentions, best_table, stitch_tables, merge_tables, triangulate, triangulate_fuzzy, redact, parse_amount, parse_date, header_overlap)}


def _density(kind: str) -> str:
    words = KINDS[kind]
    hits = " + ".join(f"least((length(t) - length(replace(t, '{w}', ''))) // {len(w)}, 3)" for w in words)
    return f"({hits}) / ({len(words)}.0 * greatest(nw / 100.0, 1.0))"


def _penalised(kind: str) -> str:
    return f"greatest({_density(kind)} - 0.01 * (" + " + ".join(f"CAST(contains(t, '{w}') AS INTEGER)" for w in NEGATIVE[kind]) + "), 0.0)"


SECRET_ENTITIES = ("EMAIL_ADDRESS", "IBAN_CODE", "IBAN_CODE", "CREDIT_CARD", "CREDIT_CARD", "US_SSN", "IP_ADDRESS", "PHONE_NUMBER", "PHONE_NUMBER", "PHONE_NUMBER", "PHONE_NUMBER", "")


def _entity(match: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_full_match({match}, '{p}') THEN '{e}'" for e, p in C.PII.items()) + " END"


_WORDS = "len(list_filter(regexp_split_to_array(trim(t, ' ' || chr(9) || chr(10) || chr(13)), '\\s+'), lambda w: w <> ''))"
_BEST = "CASE WHEN a = top THEN 'kind_a' WHEN b = top THEN 'kind_b' WHEN c = top THEN 'kind_c' END"
_FOUND = rf"""{LINES}, hit AS (
  SELECT doc_id, seq, 'code' AS field, CASE WHEN regexp_matches(text, '(?im)\b(\d{{4,}})\b') THEN 0 WHEN regexp_matches(text, '(?im)\b(\d{{2,3}})\b') THEN 1 END AS k,
    CASE WHEN regexp_matches(text, '(?im)\b(\d{{4,}})\b') THEN regexp_extract(text, '(?im)\b(\d{{4,}})\b', 1) ELSE regexp_extract(text, '(?im)\b(\d{{2,3}})\b', 1) END AS v FROM lines
  UNION ALL SELECT doc_id, seq, 'word', CASE WHEN regexp_matches(text, '(?im)(?:^| )(th[a-z]{{6,}})[ .,]') THEN 0 WHEN regexp_matches(text, '(?im)^([a-z]{{3,}})[ .,]') THEN 1 END,
    CASE WHEN regexp_matches(text, '(?im)(?:^| )(th[a-z]{{6,}})[ .,]') THEN regexp_extract(text, '(?im)(?:^| )(th[a-z]{{6,}})[ .,]', 1) ELSE regexp_extract(text, '(?im)^([a-z]{{3,}})[ .,]', 1) END FROM lines
  UNION ALL SELECT doc_id, seq, 'mail', CASE WHEN regexp_matches(text, '(?im)([a-z0-9]+@[a-z0-9.]+\.com)') THEN 0 END, regexp_extract(text, '(?im)([a-z0-9]+@[a-z0-9.]+\.com)', 1) FROM lines),
best AS (SELECT doc_id, field, v AS value, seq, row_number() OVER (PARTITION BY doc_id, field ORDER BY k, seq) AS n FROM hit WHERE k IS NOT NULL)"""
_TABLES = (
    ITEMS
    + """, tbl AS (SELECT doc_id, seq AS page, seq AS table_seq,
  CASE WHEN quantity < 20 THEN ['Date', 'Amount'] WHEN quantity < 35 THEN ['ISIN', 'Name of paper', 'Qty'] ELSE CAST([] AS VARCHAR[]) END AS headers, CAST(part AS VARCHAR) AS row FROM items)"""
)

SQL = {
    "ingest_rejects": """WITH f AS (SELECT doc_id, 't' || CAST(doc_id % 3 AS VARCHAR) AS tenant, doc_id % 5 <> 0 AS pdf, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 4 AS n,
  sha256(CASE WHEN doc_id % 5 <> 0 THEN '%PDF' ELSE 'PK..' END || coalesce(text, '')) AS sha FROM documents),
r AS (SELECT *, CASE WHEN NOT pdf THEN 1 WHEN n > 3000 THEN 2 END AS early FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY tenant, sha, early IS NULL ORDER BY doc_id) AS i FROM r)
SELECT doc_id AS file_id, CASE WHEN early IS NOT NULL THEN 'rejected' WHEN i > 1 THEN 'duplicate' ELSE 'accepted' END AS status,
  CASE WHEN early = 1 THEN 'ERR_INGESTION_001' WHEN early = 2 THEN 'ERR_INGESTION_002' WHEN i > 1 THEN 'ERR_INGESTION_003' END AS error_code,
  CASE WHEN n < 1000000 THEN 'high' ELSE 'normal' END AS priority FROM k""",
    "dedup_sha": """WITH d AS (SELECT doc_id, 'sha256:' || sha256(coalesce(text, '')) AS sha FROM documents)
SELECT min(doc_id) AS doc_id, sha FROM d WHERE doc_id % 4 <> 0 AND sha NOT IN (SELECT sha FROM d WHERE doc_id % 4 = 0) GROUP BY sha""",
    "page_coverage": """WITH g AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, round(least(1.0, greatest(0.0, sum(greatest(0.0, l_quantity * 2 - 6) * (l_linenumber * 10.0)) / 5000.0)), 6) AS coverage FROM lineitem GROUP BY 1, 2)
SELECT *, CASE WHEN coverage >= 0.8 THEN 'DIGITAL' ELSE 'SCANNED' END AS page_class FROM g""",
    "page_text": f"""WITH {DOC_PAGES} , p AS (SELECT *, CASE WHEN length(coalesce(text, '')) % 3 = 0 THEN '' ELSE coalesce(text, '') END AS own FROM doc_pages)
SELECT doc_id, page, CASE WHEN length(trim(own)) < 50 AND page % 2 = 0 THEN 'ocr ' || coalesce(text, '') ELSE own END AS text FROM p""",
    "line_grouping": """WITH """ + ITEMS + """, b AS (SELECT doc_id, seq, 'p' || CAST(part AS VARCHAR) AS text, seq * 40.0 AS x0, quantity % 12 AS y0 FROM items),
f AS (SELECT *, CASE WHEN abs(y0 - lag(y0) OVER w) > 5 THEN 1 ELSE 0 END AS new FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line FROM f)
SELECT doc_id, 1 AS page, line, string_agg(text, ' ' ORDER BY seq) AS text, CAST(min(x0) AS DOUBLE) AS x0, min(y0) AS y0, CAST(max(x0 + 30) AS DOUBLE) AS x1, max(y0 + 10) AS y1 FROM g GROUP BY 1, 3""",
    "keyword_density": f"WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), n AS (SELECT *, {_WORDS} AS nw FROM d) SELECT doc_id, "
    + ", ".join(f"round({_density(k)}, 8) AS {k}" for k in KINDS)
    + " FROM n",
    "schema_route": f"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), n AS (SELECT *, {_WORDS} AS nw FROM d),
s AS (SELECT doc_id, {_penalised("kind_a")} AS a, {_penalised("kind_b")} AS b, {_penalised("kind_c")} AS c FROM n),
r AS (SELECT *, greatest(a, b, c) AS top, list_reverse_sort([a, b, c])[2] AS second FROM s)
SELECT doc_id, CASE WHEN top >= 0.1 AND NOT (second > 0 AND top < 1.2 * second) THEN {_BEST} ELSE 'unknown' END AS kind, round(top, 8) AS score FROM r""",
    "sections": f"""WITH {DOC_PAGES}, d AS (SELECT doc_id, page, lower(coalesce(text, '')) AS t FROM doc_pages), n AS (SELECT *, {_WORDS} AS nw FROM d),
s AS (SELECT doc_id, page, {_density("kind_a")} AS a, {_density("kind_b")} AS b, {_density("kind_c")} AS c FROM n),
p AS (SELECT *, greatest(a, b, c) AS top FROM s), q AS (SELECT *, CASE WHEN top > 0.005 THEN {_BEST} ELSE 'unknown' END AS kind FROM p),
e AS (SELECT *, CASE WHEN kind <> 'unknown' AND lag(kind) OVER w <> 'unknown' AND kind <> lag(kind) OVER w AND top > 0.02 AND lag(top) OVER w > 0.02 THEN 1 ELSE 0 END AS edge, count(*) OVER (PARTITION BY doc_id) AS pages FROM q WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
i AS (SELECT *, CAST(sum(edge) OVER (PARTITION BY doc_id ORDER BY page ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM e),
g AS (SELECT doc_id, section, min(page) AS start_page, max(page) AS end_page, max(pages) AS pages, count(*) AS n, sum(a) AS a, sum(b) AS b, sum(c) AS c, max(top) AS ptop, min(kind) AS own FROM i GROUP BY 1, 2),
t AS (SELECT *, greatest(a, b, c) AS top FROM g), v AS (SELECT *, CASE WHEN top > 0.01 THEN {_BEST} ELSE 'unknown' END AS voted FROM t)
SELECT doc_id, section, start_page, end_page, CASE WHEN pages = 1 THEN own ELSE voted END AS kind, round(CASE WHEN pages = 1 THEN ptop WHEN voted = 'unknown' THEN 0.0 ELSE top / n END, 8) AS confidence FROM v""",
    "find_field": f"WITH {_FOUND} SELECT doc_id, field, value, seq FROM best WHERE n = 1",
    "field_abstentions": f"WITH {_FOUND} SELECT d.doc_id, f.field, 'ERR_EXTRACT_001' AS reason FROM documents d, (SELECT unnest(['code', 'word', 'mail']) AS field) f WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.doc_id = d.doc_id AND b.field = f.field)",
    "best_table": f"""WITH {_TABLES}, l AS (SELECT *, list_transform(headers, lambda h: lower(trim(h))) AS hs FROM tbl),
s AS (SELECT doc_id, table_seq, (CAST(len(list_filter(hs, lambda h: contains(h, 'isin') OR contains('isin', h))) > 0 AS INTEGER) + CAST(len(list_filter(hs, lambda h: contains(h, 'name') OR contains('name', h))) > 0 AS INTEGER) + CAST(len(list_filter(hs, lambda h: contains(h, 'price') OR contains('price', h))) > 0 AS INTEGER)) / 3.0 AS score FROM l)
SELECT doc_id, table_seq, round(CAST(score AS DOUBLE), 6) AS header_score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, table_seq) AS n FROM s WHERE score >= 0.6) WHERE n = 1""",
    "stitch_tables": f"""WITH {_TABLES}, f AS (SELECT *, CASE WHEN lag(headers) OVER w = headers AND len(headers) > 0 AND page - lag(page) OVER w <= 1 THEN 0 ELSE 1 END AS new FROM tbl WINDOW w AS (PARTITION BY doc_id ORDER BY page, table_seq)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY page, table_seq ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT doc_id, min(table_seq) AS table_seq, string_agg(row, ',' ORDER BY page, table_seq) AS rows, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages FROM g GROUP BY doc_id, island""",
    "merge_tables": f"WITH {_TABLES} SELECT doc_id, min(table_seq) AS table_seq, array_to_string(headers, '|') AS headers, string_agg(row, ',' ORDER BY table_seq) AS rows FROM tbl GROUP BY doc_id, headers",
    "triangulate": """WITH i AS (SELECT l_orderkey AS k, l_linenumber AS r, [CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), l_returnflag, l_linestatus] AS vs FROM lineitem),
a AS (SELECT k, r, c, lower(trim(vs[c + 1])) AS v FROM i, (SELECT unnest([0, 1, 2, 3]) AS c)),
b AS (SELECT k, r, c, CASE WHEN k % 13 = 0 AND c = r % 4 THEN v || 'x' ELSE v END AS v FROM a WHERE NOT (k % 31 = 0 AND r = 1)),
j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, '') <> coalesce(b.v, '') AS d FROM a FULL JOIN b ON a.k = b.k AND a.r = b.r AND a.c = b.c),
g AS (SELECT k, count(*) AS cells, count(*) FILTER (d) AS mismatches FROM j GROUP BY 1),
sa AS (SELECT k, max(r) AS r FROM a GROUP BY 1), sb AS (SELECT k, max(r) AS r FROM b GROUP BY 1),
s AS (SELECT g.*, CASE WHEN sa.r IS DISTINCT FROM sb.r THEN 1.0 ELSE mismatches / cells END AS x FROM g LEFT JOIN sa USING (k) LEFT JOIN sb USING (k))
SELECT k AS table_key, cells, mismatches, round(CAST(x AS DOUBLE), 6) AS score, CASE WHEN round(x, 6) < 0.10 THEN 'agreement' WHEN round(x, 6) < 0.40 THEN 'soft_flag' ELSE 'hard_flag' END AS verdict FROM s""",
    "triangulate_fuzzy": f"""WITH {ITEMS}, a AS (SELECT doc_id AS k, seq AS r, c, CASE WHEN c = 0 THEN CAST(part AS VARCHAR) ELSE 'item ' || CAST(part AS VARCHAR) END AS v FROM items, (SELECT unnest([0, 1]) AS c)),
g AS (SELECT k, count(*) AS cells, max(r) AS ra, max(r) FILTER (NOT (k % 31 = 0 AND r = 1)) AS rb, count(*) FILTER ((k % 31 = 0 AND r = 1) OR ((k + r) % 5 = 0 AND 2.0 * length(v) / (2 * length(v) + 1) < 0.9)) AS mismatches FROM a GROUP BY 1),
s AS (SELECT *, CASE WHEN ra IS DISTINCT FROM rb THEN 1.0 ELSE mismatches / cells END AS x FROM g)
SELECT k AS table_key, cells, mismatches, round(CAST(x AS DOUBLE), 6) AS score, CASE WHEN round(x, 6) < 0.10 THEN 'agreement' WHEN round(x, 6) < 0.40 THEN 'soft_flag' ELSE 'hard_flag' END AS verdict FROM s""",
    "redact": rf"""WITH d AS (SELECT doc_id, doc_id % {len(SECRETS)} AS k, coalesce(text, '') || chr(10) || 'see ' || {list(SECRETS)}[doc_id % {len(SECRETS)} + 1] || ' there' AS t FROM documents),
r AS (SELECT *, regexp_extract_all(t, '{PERSONAL}') AS found FROM d), l AS (SELECT *, list_sum(list_transform(found, lambda m: length(m))) AS n, len(found) AS c FROM r)
SELECT doc_id, md5(regexp_replace(t, '{PERSONAL}', '[REDACTED]', 'g')) AS redacted_md5, CAST(c AS BIGINT) AS redactions, CAST(coalesce(n, 0) AS BIGINT) AS hidden,
  CASE WHEN c = 0 THEN NULL WHEN k = 11 THEN {_entity("found[c]")} ELSE {list(SECRET_ENTITIES)}[k + 1] END AS last_entity,
  CASE WHEN c = 0 THEN NULL WHEN k = 11 THEN CAST(length(t) - length(last_part) - length(found[c]) AS BIGINT) ELSE CAST(length(t) - 6 - length(found[c]) AS BIGINT) END AS last_start
FROM (SELECT *, regexp_split_to_array(t, '{PERSONAL}')[-1] AS last_part FROM l)""",
    "parse_amount": r"""WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
p AS (SELECT *, CAST(cents // 100 AS VARCHAR) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS plain FROM o)
SELECT o_orderkey, CASE k WHEN 0 THEN -CAST(plain AS DOUBLE) WHEN 1 THEN -CAST(plain AS DOUBLE) WHEN 2 THEN CAST('1' || lpad(plain, 12, '0') AS DOUBLE) WHEN 3 THEN 0.0 WHEN 4 THEN NULL ELSE CAST(plain AS DOUBLE) END AS amount,
  CASE k WHEN 0 THEN NULL WHEN 1 THEN -CAST(plain AS DOUBLE) WHEN 2 THEN CAST('1' || lpad(plain, 12, '0') AS DOUBLE) WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE CAST(plain AS DOUBLE) END AS loose FROM p""",
    "parse_date": """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN strftime(o_orderdate, '%Y%m%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso, strftime(o_orderdate, '%Y-%m-%d') AS swift FROM orders""",
    "header_overlap": r"""WITH p AS (SELECT conv_id AS doc_id, turn + 1 AS page, coalesce(text, '') AS t, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS b FROM conversations),
w AS (SELECT doc_id, page, list_distinct(list_slice(list_filter(regexp_split_to_array(trim(b, ' ' || chr(10)), '\s+'), lambda x: x <> ''), 1, 20)) AS x, list_distinct(list_slice(list_filter(regexp_split_to_array(trim(t, ' ' || chr(10)), '\s+'), lambda x: x <> ''), 1, 20)) AS y FROM p)
SELECT doc_id, page, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS overlap FROM w""",
}
