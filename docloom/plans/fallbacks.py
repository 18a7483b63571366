"""Queries of the model fallback by page windows, discovery with its cache, retries and two-phase extraction; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import discovery, fallback, flow, model_io
from docloom.shared import shared_dir

from .flows import _listed
from .standins import ITEMS, items, read

PAGE = 500


def _letters(c: F.Column) -> F.Column:
    return F.translate(c.cast("string"), "0123456789", "abcdefghij")


def long_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, text: whole documents in pages of 500 characters, without digits; a name on the first page, a reference on the
    middle one, a balance on the last."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.translate(F.coalesce("text", F.lit("")), "0123456789@", "abcdefghijk").alias("t"))
    d = d.withColumn("n", F.greatest(F.lit(1), F.ceil(F.length("t") / PAGE)).cast("int"))
    p = d.select("doc_id", "t", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("page"))
    chunk = F.substring(F.col("t"), (F.col("page") - 1) * PAGE + 1, F.lit(PAGE))
    code = _letters(F.col("doc_id"))
    name = F.when(F.col("page") == 1, F.concat(F.lit("\nFrom kw"), code, F.lit("w")))
    reference = F.when(F.col("page") == F.ceil(F.col("n") / 2), F.concat(F.lit("\nRef zq"), code, F.lit("q")))
    balance = F.when(F.col("page") == F.col("n"), F.concat(F.lit("\nClosing "), F.length("t").cast("string"), F.lit(".5")))
    return p.select("doc_id", F.col("page").cast("bigint").alias("page"), F.concat(chunk, *[F.coalesce(x, F.lit("")) for x in (name, reference, balance)]).alias("text"))


def _missing(docs: DataFrame) -> DataFrame:
    k = F.col("doc_id") % 3
    fields = F.when(k == 0, F.array(F.lit("institution"), F.lit("closing_balance"))).when(k == 1, F.array(F.lit("portfolio_id"))).otherwise(F.array(F.lit("portfolio_id"), F.lit("closing_balance")))
    return docs.select("doc_id", F.explode(fields).alias("field"))


def _reads(asked: DataFrame) -> DataFrame:
    """A model that reads what stands in its prompt, and makes up a reference for some documents."""
    seen = lambda pattern: F.nullif(F.regexp_extract("prompt", pattern, 1), F.lit(""))
    said = {"closing_balance": seen(r"Closing (\d+\.5)"), "institution": seen("From (kw[a-j]+w)"), "portfolio_id": F.when(F.col("doc_id") % 7 == 3, F.lit("made-up-here")).otherwise(seen("Ref (zq[a-j]+q)"))}
    parts = [F.when(F.array_contains("fields", f), F.concat(F.lit(f'"{f}": '), F.coalesce(F.concat(F.lit('{"value": "'), v, F.lit('", "confidence": 0.9}')), F.lit("null")))) for f, v in said.items()]
    return asked.withColumn("reply", F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ", "), F.lit("}")))


def windowed_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing fields of whole documents, short and long: all in one call, by target pages, by windows; a budget that ends."""
    pages = long_pages(spark, sf_dir)
    missing = _missing(read(spark, sf_dir, "documents"))
    done = fallback.run(pages, missing, _reads, maximum=6000, mode="skip", context=2400)
    calls = done.calls.groupBy("doc_id").agg(F.first("tier").alias("tier"), F.count("*").alias("asked"), F.count_if("allowed").alias("counted"), F.sum(F.when(F.col("allowed"), F.col("input_tokens") + F.col("output_tokens"))).alias("tokens"))
    return calls.join(_listed(done.fields, F.concat_ws("=", "field", "value"), "found").hint("merge"), "doc_id", "left").join(_listed(done.open, F.concat_ws("=", "field", "reason"), "open").hint("merge"), "doc_id", "left")


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, F.Column]:
    return read(spark, sf_dir, "orders"), F.col("o_orderkey")


def _notices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One-page letters of five layouts by priority, and their tenants."""
    o, k = _orders(spark, sf_dir)
    text = F.concat(F.lit("Notice "), F.regexp_replace("o_orderpriority", "[^A-Z]", " "), F.lit(" from the house\nReference "), k.cast("string"), F.lit("\nDue "), k.cast("string"), F.lit(".75"))
    pages = o.select(k.alias("doc_id"), F.lit(1).cast("bigint").alias("page"), text.alias("text"))
    return pages, o.select(k.alias("doc_id"), F.concat(F.lit("t"), (F.col("o_custkey") % 3).cast("string")).alias("tenant_id"))


def _knows_notices(asked: DataFrame) -> DataFrame:
    """A model that has a schema for all layouts but one, reads references, and makes up the due amount of some."""
    reference = F.regexp_extract("prompt", r"Reference (\d+)", 1)
    due = F.when(F.endswith(reference, F.lit("0")), "none of that kind").otherwise(F.regexp_extract("prompt", r"Due (\S+)", 1))
    values = F.concat(F.lit('{"header_fields": {"reference": "'), reference, F.lit('", "due": {"value": "'), due, F.lit('", "confidence": 0.99}, "signed": null}}'))
    layout = F.trim(F.regexp_extract("prompt", "Notice ([A-Z ]+) from", 1))
    schema = F.concat(F.lit('{"institution": "The House", "document_type_label": "'), F.lower(F.regexp_replace(layout, " +", "-")), F.lit('", "fields": [{"field_name": "reference"}, {"field_name": "due"}, {"field_name": "signed"}, {"field_name": " "}]}'))
    return asked.withColumn("reply", F.when(F.startswith("prompt", F.lit("[discover]")), F.when(layout != "MEDIUM", schema).otherwise("?")).otherwise(values))


def discovery_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown layouts twice over the same caches; the second run's model would answer nothing."""
    pages, tenants = _notices(spark, sf_dir)
    path = f"{shared_dir(spark)}/discovery-{uuid.uuid4().hex}"
    schemas, replies = discovery.schema_cache(f"{path}/schemas"), discovery.reply_cache(f"{path}/replies")
    discovery.discover(pages, tenants, discovery.remembering(_knows_notices, replies), schemas, "2024-01-01")
    mute = lambda asked: asked.withColumn("reply", F.lit(None).cast("string"))
    again = discovery.discover(pages, tenants, discovery.remembering(mute, replies), schemas, "2024-01-02")
    out = tenants.join(again.kinds.hint("merge"), "doc_id", "left").join(_listed(again.fields, F.concat_ws("=", "field", "value"), "found").hint("merge"), "doc_id", "left").join(_listed(again.open, F.concat_ws("=", "field", "reason"), "open").hint("merge"), "doc_id", "left")
    uses = schemas.read(spark).select("tenant_id", F.concat(F.lit("discovered:"), F.element_at(F.split("fingerprint", "::"), -1)).alias("kind"), "use_count", F.date_format("last_used_at", "yyyy-MM-dd").alias("last_used"))
    return out.join(uses, ["tenant_id", "kind"], "left").select("doc_id", "kind", "found", "open", "use_count", "last_used")


def retry_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that gain, stay or lose by one more round after a diagnosis."""
    o, k = _orders(spark, sf_dir)
    code = k.cast("string")
    text = F.concat(F.lit("Report alpha "), code, F.when(k % 3 != 0, F.concat(F.lit(" beta "), code, F.lit(".5"))).otherwise(""), F.lit(" by "), code)
    pages = o.select(k.alias("doc_id"), F.lit(1).cast("bigint").alias("page"), text.alias("text"))
    names = F.when(k % 6 == 0, F.array(F.lit("isin"), F.lit("price"))).otherwise(F.array(F.lit("isin")))
    zero, one = F.array(*[F.lit(0.0)] * 4), F.lit(1).cast("bigint")
    fields = o.select(k.alias("doc_id"), F.explode(names).alias("field")).select("doc_id", "field", F.lit("x").alias("value"), F.lit(0.95).alias("confidence"), F.lit("native").alias("source"), F.lit("pattern").alias("rule"), one.alias("page"), zero.alias("bbox"))
    lost = F.when(k % 5 == 0, F.array(F.lit("quantity"))).otherwise(F.array(F.lit("quantity"), F.lit("trade_date"), F.lit("settlement_date")))
    abstained = o.select(k.alias("doc_id"), F.explode(lost).alias("field")).withColumn("reason", F.lit("ERR_VLM_003"))
    kinds = o.select(k.alias("doc_id"), F.lit("swift_confirm").alias("kind"))
    tenants = o.select(k.alias("doc_id"), F.lit("t").alias("tenant_id"))

    def ask(asked: DataFrame) -> DataFrame:
        seen = F.regexp_extract("prompt", r"by (\d+)", 1).try_cast("bigint") % 7
        plan = F.when(seen == 0, '{"recommended_strategy": "none"}').when(seen == 2, "not json").when(seen != 1, '```json\n{"diagnosis": "x", "recommended_strategy": "auto_discovery"}\n```')
        found = lambda p: F.coalesce(F.concat(F.lit('"'), F.nullif(F.regexp_extract("prompt", p, 1), F.lit("")), F.lit('"')), F.lit("null"))
        values = F.concat(F.lit('{"alpha": '), found(r"alpha (\S+)"), F.lit(', "beta": '), found(r"beta (\S+)"), F.lit("}"))
        schema = F.lit('{"institution": "i", "document_type_label": "report", "fields": [{"field_name": "alpha"}, {"field_name": "beta"}]}')
        return asked.withColumn("reply", F.when(F.startswith("prompt", F.lit("[diagnose]")), plan).when(F.startswith("prompt", F.lit("[discover]")), schema).otherwise(values))

    cache = discovery.schema_cache(f"{shared_dir(spark)}/retry-{uuid.uuid4().hex}")
    f, a, kd, calls = flow.retried(pages, kinds, fields, abstained, ask, tenants, cache, "2024-01-01")
    asked = calls.groupBy("doc_id").agg(F.count("*").alias("calls"))
    out = kd.join(_listed(f, F.concat_ws("=", "field", "value"), "found").hint("merge"), "doc_id", "left").join(_listed(a, F.concat_ws("=", "field", "reason"), "open").hint("merge"), "doc_id", "left").join(asked.hint("merge"), "doc_id", "left")
    return out.select("doc_id", "kind", "found", "open", F.coalesce("calls", F.lit(0)).alias("calls"))


def two_phase_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts from one call a document, tables from calls by window about these accounts; some without accounts."""
    pages = items(spark, sf_dir).select("doc_id", F.col("seq").alias("page"), F.concat(F.lit("Order "), F.col("doc_id").cast("string"), F.lit(" part "), F.col("part").cast("string"), F.lit("\n")).alias("text"))

    def ask(asked: DataFrame) -> DataFrame:
        k = F.col("__k")
        account = lambda n, flag: F.concat(F.lit(f'{{"account_number": "{n}-'), k.cast("string"), F.lit('", "opening_balance": 1.5, "has_transactions": '), flag.cast("string"), F.lit("}"))
        phase_one = F.when(k % 5 != 0, F.concat(F.lit('{"value": {"document_type": "x", "accounts": ['), account("A", F.lit(False)), F.lit(", "), account("B", k % 2 == 0), F.lit("]}}")))
        parts = F.regexp_extract_all("prompt", F.lit(r"part (\d+)"), 1)
        late = F.contains("prompt", F.lit("Pages 4-"))
        as_lists = F.concat(F.lit('{"tables": [{"table_type": "transactions", "headers": ["Part"], "rows": ['), F.array_join(F.transform(parts, lambda p: F.concat(F.lit('["'), p, F.lit('"]'))), ", "), F.lit("]}]}"))
        as_objects = F.concat(F.lit('```json\n{"tables": [{"table_type": "other", "headers": ["Part", "No"], "rows": ['), F.array_join(F.transform(parts, lambda p: F.concat(F.lit('{"No": "n", "Part": "'), p, F.lit('"}'))), ", "), F.lit("]}]}\n```"))
        named = F.contains("prompt", F.concat(F.lit("Accounts: A-"), k.cast("string"), F.lit(", B-"), k.cast("string"), F.lit("\n")))
        phase_two = F.when(named, F.when(late & (k % 4 == 0), as_objects).when(late & (k % 4 == 1), "broken").otherwise(as_lists))
        known = asked.withColumn("__k", F.regexp_extract("prompt", r"Order (\d+)", 1).cast("bigint"))
        return known.withColumn("reply", F.when(F.startswith("prompt", F.lit("[metadata]")), phase_one).otherwise(phase_two)).drop("__k")

    a = model_io.two_phases(pages, ask)
    cells = F.flatten(F.transform("tables", lambda t: F.transform(t["rows"], lambda r: F.array_join(r, "/", "-"))))
    return a.select("doc_id", "acct_seq", "account_number", F.coalesce(F.array_join(F.transform("tables", lambda t: F.array_join(t["headers"], "/")), ","), F.lit("")).alias("headers"), F.coalesce(F.array_join(cells, ","), F.lit("")).alias("rows"))


QUERIES = {f.__name__: f for f in (windowed_fallback, discovery_runs, retry_round, two_phase_extraction)}

LONG_PAGES = """lt AS (SELECT doc_id, translate(coalesce(text, ''), '0123456789@', 'abcdefghijk') AS t, translate(CAST(doc_id AS VARCHAR), '0123456789', 'abcdefghij') AS code FROM documents),
ln AS (SELECT *, length(t) AS chars, CAST(greatest(1, ceil(length(t) / 500)) AS BIGINT) AS n FROM lt),
lp AS (SELECT doc_id, code, chars, n, CAST(ceil(n / 2) AS BIGINT) AS mid, p, substr(t, (p - 1) * 500 + 1, 500) || CASE WHEN p = 1 THEN chr(10) || 'From kw' || code || 'w' ELSE '' END
  || CASE WHEN p = CAST(ceil(n / 2) AS BIGINT) THEN chr(10) || 'Ref zq' || code || 'q' ELSE '' END || CASE WHEN p = n THEN chr(10) || 'Closing ' || CAST(chars AS VARCHAR) || '.5' ELSE '' END AS text
  FROM ln, LATERAL (SELECT unnest(range(1, n + 1)) AS p))"""

SQL = {
    "windowed_fallback": f"""WITH {LONG_PAGES},
s AS (SELECT doc_id, any_value(code) AS code, any_value(chars) AS chars, any_value(n) AS n, any_value(mid) AS mid, floor((sum(length(text)) + count(*) - 1) / 3.5) AS est FROM lp GROUP BY 1),
t AS (SELECT *, CASE WHEN est <= 1920 THEN 'single' WHEN doc_id % 3 = 0 THEN 'tier1' ELSE 'tier2' END AS tier,
  CASE doc_id % 3 WHEN 0 THEN ['closing_balance', 'institution'] WHEN 1 THEN ['portfolio_id'] ELSE ['closing_balance', 'portfolio_id'] END AS fields FROM s),
w AS (SELECT doc_id, code, chars, n, mid, tier, 0 AS k, 1 AS a, n AS b, fields FROM t WHERE tier = 'single'
  UNION ALL SELECT doc_id, code, chars, n, mid, tier, 0, 1, 2, ['institution'] FROM t WHERE tier = 'tier1' UNION ALL SELECT doc_id, code, chars, n, mid, tier, 1, n - 1, n, ['closing_balance'] FROM t WHERE tier = 'tier1'
  UNION ALL SELECT doc_id, code, chars, n, mid, tier, k, k * 9 + 1, least(k * 9 + 12, n), fields FROM t, LATERAL (SELECT unnest(range(0, CAST(greatest(0, ceil((n - 12) / 9)) AS BIGINT) + 1)) AS k) WHERE tier = 'tier2'),
p AS (SELECT w.*, (SELECT sum(length(lp.text) + length('--- PAGE  ---') + length(CAST(lp.p AS VARCHAR)) + 1) + count(*) - 1 FROM lp WHERE lp.doc_id = w.doc_id AND lp.p BETWEEN w.a AND w.b) AS body,
  list_transform(fields, lambda f: CASE f
    WHEN 'closing_balance' THEN CASE WHEN b = n THEN CAST(chars AS VARCHAR) || '.5' END WHEN 'institution' THEN CASE WHEN a = 1 THEN 'kw' || code || 'w' END
    ELSE CASE WHEN doc_id % 7 = 3 THEN 'made-up-here' WHEN mid BETWEEN a AND b THEN 'zq' || code || 'q' END END) AS said FROM w),
r AS (SELECT *, length('{{' || array_to_string(list_transform(list_zip(fields, said), lambda x: '"' || x[1] || '": ' || coalesce('{{"value": "' || x[2] || '", "confidence": 0.9}}', 'null')), ', ') || '}}') AS reply,
  length('[fallback]Fields: Pages -') + 3 + length(array_to_string(fields, ', ')) + length(CAST(a AS VARCHAR)) + length(CAST(b AS VARCHAR)) + body AS prompt FROM p),
i AS (SELECT *, CAST(floor(prompt / 3.5) AS BIGINT) AS tin, CAST(floor(reply / 3.5) AS BIGINT) AS tout FROM r),
g AS (SELECT *, coalesce(sum(tin) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_in FROM i),
h AS (SELECT *, coalesce(sum(tin + tout) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g WHERE before_in <= 6000),
c AS (SELECT doc_id, any_value(tier) AS tier, count(*) AS asked, count(*) FILTER (before <= 6000) AS counted, CAST(sum(tin + tout) FILTER (before <= 6000) AS BIGINT) AS tokens, bool_or(before + tin + tout > 6000) AS over FROM h GROUP BY 1),
v AS (SELECT doc_id, x[1] AS field, x[2] AS value FROM (SELECT doc_id, unnest(list_zip(fields, said)) AS x FROM h WHERE before <= 6000) WHERE x[2] IS NOT NULL),
f AS (SELECT DISTINCT doc_id, field, value FROM v WHERE value <> 'made-up-here'),
o AS (SELECT t.doc_id, u.field, CASE WHEN over THEN 'ERR_VLM_007' WHEN EXISTS (SELECT 1 FROM v WHERE v.doc_id = t.doc_id AND v.field = u.field) THEN 'ERR_VLM_004' ELSE 'ERR_VLM_003' END AS reason
  FROM t JOIN c USING (doc_id), LATERAL (SELECT unnest(t.fields) AS field) u WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = t.doc_id AND f.field = u.field))
SELECT c.doc_id, tier, asked, counted, tokens, (SELECT string_agg(field || '=' || value, ',' ORDER BY field || '=' || value) FROM f WHERE f.doc_id = c.doc_id) AS found,
  (SELECT string_agg(field || '=' || reason, ',' ORDER BY field || '=' || reason) FROM o WHERE o.doc_id = c.doc_id) AS open FROM c""",
    "discovery_runs": """WITH o AS (SELECT o_orderkey AS k, 't' || CAST(o_custkey % 3 AS VARCHAR) AS tenant, trim(regexp_replace(o_orderpriority, '[^A-Z]', ' ', 'g')) AS layout FROM orders),
u AS (SELECT tenant, layout, count(*) * 2 AS uses FROM o GROUP BY 1, 2)
SELECT k AS doc_id, CASE WHEN layout <> 'MEDIUM' THEN 'discovered:' || lower(regexp_replace(layout, ' +', '-', 'g')) END AS kind,
  CASE WHEN layout <> 'MEDIUM' THEN CASE WHEN k % 10 = 0 THEN '' ELSE 'due=' || k || '.75,' END || 'reference=' || k END AS found,
  CASE WHEN layout = 'MEDIUM' THEN 'document_kind=ERR_DISCOVERY_001' WHEN k % 10 = 0 THEN 'due=ERR_VLM_004,signed=ERR_EXTRACT_001' ELSE 'signed=ERR_EXTRACT_001' END AS open,
  CASE WHEN layout <> 'MEDIUM' THEN uses END AS use_count, CASE WHEN layout <> 'MEDIUM' THEN '2024-01-02' END AS last_used FROM o JOIN u USING (tenant, layout)""",
    "retry_round": """WITH o AS (SELECT o_orderkey AS k, 1 + CAST(o_orderkey % 6 = 0 AS INTEGER) AS n, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 3 END AS lost, o_orderkey % 7 NOT IN (0, 1) AS told FROM orders),
r AS (SELECT *, lost > n AND told AS sent, lost > n AND told AND k % 3 <> 0 AS gain FROM o)
SELECT k AS doc_id, CASE WHEN gain THEN 'discovered:report' ELSE 'swift_confirm' END AS kind, CASE WHEN gain THEN 'alpha=' || k || ',beta=' || k || '.5' WHEN n = 2 THEN 'isin=x,price=x' ELSE 'isin=x' END AS found,
  CASE WHEN gain THEN NULL WHEN lost = 1 THEN 'quantity=ERR_VLM_003' ELSE 'quantity=ERR_VLM_003,settlement_date=ERR_VLM_003,trade_date=ERR_VLM_003' END AS open, CAST(sent AS BIGINT) AS calls FROM r""",
    "two_phase_extraction": f"""WITH {ITEMS}, i AS (SELECT doc_id AS k, seq, CAST(part AS VARCHAR) AS part, count(*) OVER (PARTITION BY doc_id) AS n FROM items WHERE doc_id % 5 <> 0),
w AS (SELECT k, seq, part, CASE WHEN n >= 20 THEN (seq - 1) // 5 ELSE (seq - 1) // 3 END AS w, n FROM i), s AS (SELECT *, n < 20 AND w = 1 AS late FROM w),
t AS (SELECT k, late AND k % 4 = 0 AS other, string_agg(CASE WHEN late AND k % 4 = 0 THEN part || '/n' ELSE part END, ',' ORDER BY seq) AS listed, min(seq) AS began FROM s WHERE NOT (late AND k % 4 = 1) GROUP BY 1, 2),
g AS (SELECT k, string_agg(CASE WHEN other THEN 'Part/No' ELSE 'Part' END, ',' ORDER BY began) AS headers, string_agg(listed, ',' ORDER BY began) AS listed FROM t GROUP BY 1)
SELECT k AS doc_id, a AS acct_seq, ['A-', 'B-'][a + 1] || k AS account_number, CASE WHEN a = CAST(k % 2 = 0 AS BIGINT) THEN headers ELSE '' END AS headers, CASE WHEN a = CAST(k % 2 = 0 AS BIGINT) THEN listed ELSE '' END AS "rows"
FROM g, (SELECT unnest([0, 1]) AS a)""",
}
