"""Queries of tenants, keys, rules, caches, retries, table sources, exports and marks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import admin, discovery, documents, flow, ingest, model_io, record, tables
from docloom.sources import files, sinks
from docloom.streaming import windows

from .flows import _stream
from .standins import FAILURES, ITEMS, JOBS, LINES, USAGE, failures, items, jobs, lines, read, usage


def _text(column: str, prefix: str) -> F.Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def tenant_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.usage_totals(admin.for_tenant(usage(spark, sf_dir), "t2"), "model_id")


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenants = read(spark, sf_dir, "supplier").select(_text("s_suppkey", "t").alias("tenant_id"), F.sha2(_text("s_suppkey", "key-"), 256).alias("key_hash"), (F.col("s_suppkey") % 4 == 0).alias("suspended"))
    asked = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("request_id"), _text("c_custkey", "key-").alias("api_key"))
    return admin.api_key_outcome(asked, tenants).select("request_id", "tenant_id", "error_code")


def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % n + 1).cast("int"))
    rules = read(spark, sf_dir, "customer").select(
        k.alias("rule_id"), pick(4, "budget_threshold", "error_rate", "circuit_breaker", "other").alias("rule_type"), (k % 7 - 1).alias("threshold_tokens"),
        pick(3, "weekly", "monthly", "daily").alias("billing_period"), (k % 130).alias("threshold_percent"), F.when(k % 5 != 0, k % 50).alias("evaluation_window_minutes"),
        F.when(k % 6 != 0, pick(2, " ", "bedrock")).alias("service_name"), pick(2, "email", "webhook").alias("channel"), pick(5, "a@b.example", "https://h.example/x", "nobody", "", "ftp://x").alias("target"),
    )
    return admin.rule_errors(rules).select("rule_id", "errors", "target_ok")


def protection(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = read(spark, sf_dir, "events").select(_text("user_id", "t").alias("tenant_id"), (F.col("event_id") % (F.col("user_id") % 3 + 1) == 0).alias("enabled"))
    return admin.protection_level(settings)


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = failures(spark, sf_dir)
    text = F.concat(F.lit("Failures with the code "), F.col("error_code"), F.lit(" in fields of documents of institution "), F.coalesce("institution", F.lit("unknown")))
    return admin.suggestions(f.select(F.col("schema_type").alias("category"), text.alias("description"), F.lit("medium").alias("priority"), F.col("id").alias("seq")))


def stale_abstentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    names = F.array(*[F.lit(n) for n in ("opening_balance", "iban", "isin", "currency")])
    abstained = i.select("doc_id", F.when(F.col("part") % 6 < 4, F.element_at(names, (F.col("part") % 6 + 1).cast("int"))).otherwise(_text("seq", "f")).alias("field"), F.when(F.col("part") % 5 == 0, F.lit("t_transactions_1")).when(F.col("part") % 5 == 1, F.lit("positions")).when(F.col("part") % 5 == 2, F.lit("fees")).alias("table_id"), "seq")
    found = i.filter(F.col("seq") == 1).select("doc_id", F.lit("iban").alias("field"), F.when(F.col("doc_id") % 3 != 0, "x").alias("value"))
    data = read(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("doc_id"))
    return record.still_open(abstained, found, data).select("doc_id", "seq", "field")


def normal_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = o.select("o_orderkey", F.when(k % 3 == 0, day).otherwise("").alias("date"), F.when(k % 3 == 1, day).alias("value_date"), day.alias("transaction_date"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("narrative"), F.lit("see").alias("details"), F.when(k % 4 == 0, k).otherwise(0).alias("debit"), F.when(k % 4 != 1, k * 2).alias("credit"))
    n = record.normal_transaction(rows)
    return n.select("o_orderkey", record.transaction_key(F.col("date"), F.col("description"), F.col("amount")).alias("txn_key"))


def schema_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = read(spark, sf_dir, "customer").select(F.concat(F.lit("t"), (F.col("c_custkey") % 3).cast("string")).alias("tenant_id"), _text("c_custkey", "j").alias("fingerprint"), (F.col("c_custkey") % 4).alias("use_count"), F.lit("2024-01-01").cast("timestamp_ntz").cast("timestamp").alias("last_used_at"))
    used = usage(spark, sf_dir).select("tenant_id", F.col("job_id").alias("fingerprint"))
    known = discovery.cache_lookup(used, cache).filter(F.col("use_count").isNotNull()).select("tenant_id", "fingerprint")
    after = discovery.cache_after(cache, known, "2024-02-01")
    return after.select("tenant_id", "fingerprint", "use_count", F.date_format("last_used_at", "yyyy-MM-dd").alias("last_used"))


def retry_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    first = i.select("doc_id", _text("seq", "f").alias("field"), F.when(F.col("part") % 2 == 0, F.lit("first")).alias("value"))
    again = i.select("doc_id", _text("seq", "f").alias("field"), F.when(F.col("part") % 5 < 3, F.lit("again")).alias("value"))
    return record.keep_better(first, again)


def discovered_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderpriority", "o_orderstatus")
    defined = o.select("doc_id", F.array(*[F.struct(F.lit(n).alias("field_name"), F.lit("text").alias("field_type"), F.lit(n == "total").alias("required")) for n in ("total", "status", "other")]).alias("fields"))
    answer = lambda v, c: F.struct(v.alias("value"), c.alias("confidence"))
    reply = F.to_json(F.create_map(F.lit("total"), answer(F.col("o_orderpriority"), F.lit(0.99)), F.lit("status"), answer(F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).otherwise(F.col("o_orderstatus")), F.lit(0.5))))
    answered = o.select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("```json\n"), reply, F.lit("\n```"))).alias("reply"))
    return discovery.extracted_values(defined, answered)


def refine_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas of low success are put to a model with their worst fields and a sample, and take what it names."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", _text("user_id", "k").alias("schema_key"), (F.col("event_id") % 10).alias("extracted"), _text("event_id", "f").alias("one"))
    performance = admin.schema_performance(e.select(F.col("event_id").alias("id"), "ts", "schema_key", "extracted", F.lit(10).cast("bigint").alias("total")))
    schemas = e.groupBy("schema_key").agg(F.array(F.lit("total"), F.lit("date")).alias("fields"))
    failed = e.filter("extracted < 5").select("schema_key", F.concat(F.lit("f"), (F.col("event_id") % 4).cast("string")).alias("field_name"), F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(" of a@b.com")).alias("sample"), "ts", F.col("event_id").alias("id"))
    asked = discovery.refinement_requests(performance, schemas, discovery.common_failures(failed), discovery.failure_samples(failed))
    reply = F.when(F.length("prompt") % 3 != 0, F.lit('{"fields": [{"field_name": "sum"}, {"field_name": " "}]}')).otherwise(F.lit("no answer"))
    known = discovery.refined(schemas, asked.select("schema_key", reply.alias("reply")))
    return known.join(asked.select("schema_key", F.md5("prompt").alias("prompt_md5")), "schema_key", "left").select("schema_key", F.array_join("fields", ",").alias("fields"), "refined", "prompt_md5")


def table_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    raw = i.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "part"))), lambda x: F.array(x["part"].cast("string"), F.when(x["part"] % 2 == 0, x["seq"].cast("string")))).alias("rows"))
    t = files.split_header(raw)
    return t.select("doc_id", F.array_join("headers", "|").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";").alias("rows"))


def table_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).select("doc_id", "seq", "part")
    first = i.filter(F.col("part") % 4 == 0).withColumn("rail", F.lit("a"))
    return files.with_fallback(first, i.withColumn("rail", F.lit("b"))).groupBy("doc_id", "rail").agg(F.count("*").alias("tables"), F.sum("part").alias("parts"))


def paired_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).select("doc_id", (F.col("seq") % 2).alias("page"), F.col("seq").alias("table_seq"), "part")
    return tables.pair_rails(i, i.filter(F.col("part") % 3 != 0)).select("doc_id", "page", "table_seq", "b_table_seq")


def recognised_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the same image share one recognition."""
    p = read(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), F.coalesce("text", F.lit("")).cast("binary").alias("image"))
    seen = files.recognise_once(p, lambda d: d.select("page_hash", F.octet_length("image").cast("bigint").alias("bytes")))
    return seen.select("doc_id", "page", "page_hash", "bytes")


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("version"), F.col("event_type").alias("state"))
    old = e.filter(F.col("version") % 2 == 0).groupBy("key").agg(F.max_by(F.struct("version", "state"), "version").alias("r")).select("key", "r.*")
    return ingest.upsert(old, e.filter(F.col("version") % 2 == 1), ["key"], "version")


def account_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    a = c.select(F.col("c_nationkey").alias("doc_id"), F.when(k % 3 == 0, "").otherwise(_text("c_custkey", "n")).alias("account_number"), _text("c_custkey", "IB").alias("iban"), F.round(F.col("c_acctbal") * 100).cast("bigint").alias("closing_balance"))
    b = a.filter(F.length("iban") % 2 == 0).withColumn("closing_balance", F.col("closing_balance") + F.when(F.length("iban") == 4, 1).otherwise(0))
    return record.balance_diff(a, b)


def section_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents from two sections as one table; the second lacks a column."""
    n = lines(spark, sf_dir)
    a, b = n.filter(F.col("seq") < 3).select("doc_id", "seq", F.length("text").alias("chars")), n.filter(F.col("seq") >= 3).select("doc_id", "seq")
    return flow.concatenate(a, b).groupBy("doc_id").agg(F.count("*").alias("rows"), F.count("chars").alias("measured"), F.sum("chars").alias("chars"))


def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers, written with every value quoted and read back."""
    import uuid

    from docloom.shared import shared_dir

    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    c = read(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(' "x", y')).alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"))
    sinks.write_csv(c, path)
    return spark.read.option("header", True).option("escape", '"').schema("c_custkey bigint, name string, segment string").csv(path)


def html_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select("n_regionkey", F.concat("n_name", F.lit(" <&>")).alias("name"), "n_nationkey")
    return sinks.html_table(n, "n_regionkey", ["name", "n_nationkey"])


def acknowledged_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    history = e.filter(F.col("event_type") == "error").select(F.col("event_id").alias("id"), F.col("user_id").alias("rule_id"))
    marks = e.filter(F.col("event_type") != "error").select((F.col("event_id") - F.col("event_id") % 3).alias("id"), "user_id", F.col("ts").cast("timestamp").alias("at"))
    return model_io.acknowledged(history, marks).select("id", "rule_id", "acknowledged_by", F.date_format("acknowledged_at", "yyyy-MM-dd HH:mm:ss").alias("acknowledged_at"))


def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The update mode over a stream of steps: the last row of each job and kind."""
    e = _stream(spark, sf_dir, "events").select(_text("user_id", "j").alias("job_id"), F.when(F.col("event_type") == "view", "ocr").otherwise("vlm").alias("kind"), (F.col("user_id") % 9).alias("total"))
    return windows.run_once(windows.progress_counts(e), "update", ["job_id", "kind"])


def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paced stream whose batches go to a table; its query is stopped once all that is there has been read."""
    import uuid

    from docloom.shared import shared_dir

    folder = f"{shared_dir(spark)}/paced-{uuid.uuid4().hex}"
    e = _stream(spark, sf_dir, "events").select("event_type", "value")
    query = windows.run_every(e, lambda b, k: b.write.mode("overwrite").parquet(f"{folder}/out/batch={k}"), f"{folder}/check", seconds=1)
    query.processAllAvailable()
    query.stop()
    out = spark.read.schema("event_type string, value double").parquet(f"{folder}/out")
    return out.groupBy("event_type").agg(F.count("*").alias("events"), F.sum(F.floor(F.col("value") * 100).cast("bigint")).alias("value"))


def relevant_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), (F.length("text") % 4 == 0).alias("has_table"), F.when(F.col("turn") % 2 == 0, F.contains("text", F.lit("a"))).alias("has_total"))
    return documents.relevant_pages(p, ["has_table", "has_total"]).select("doc_id", "page")


QUERIES = {
    f.__name__: f
    for f in (
        tenant_usage, api_keys, alert_rules, protection, suggestions, stale_abstentions, normal_transactions, schema_cache, retry_results, discovered_values, refine_schemas, table_headers, table_fallback,
        paired_tables, recognised_once, upserted, account_balances, section_lines, csv_export, html_export, acknowledged_alerts, stream_progress, stream_batches, relevant_pages,
    )
}

_TX = "strftime(o_orderdate, '%Y-%m-%d')"

SQL = {
    "tenant_usage": f"""WITH {USAGE} SELECT model_id, count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens,
  round(sum(input_tokens) * 0.003 / 1000 + sum(output_tokens) * 0.015 / 1000, 6)::DOUBLE AS estimated_cost FROM usage WHERE tenant_id = 't2' GROUP BY 1""",
    "api_keys": """SELECT c_custkey AS request_id, CASE WHEN s_suppkey IS NOT NULL THEN 't' || CAST(s_suppkey AS VARCHAR) END AS tenant_id, CASE WHEN s_suppkey IS NULL THEN 'ERR_AUTH_001' WHEN s_suppkey % 4 = 0 THEN 'ERR_AUTH_002' END AS error_code
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""",
    "alert_rules": """WITH r AS (SELECT c_custkey AS k, ['budget_threshold', 'error_rate', 'circuit_breaker', 'other'][c_custkey % 4 + 1] AS t, ['weekly', 'monthly', 'daily'][c_custkey % 3 + 1] AS p,
  CASE WHEN c_custkey % 6 <> 0 THEN [' ', 'bedrock'][c_custkey % 2 + 1] END AS s FROM customer),
e AS (SELECT k, list_filter([CASE WHEN t = 'budget_threshold' AND k % 7 - 1 <= 0 THEN 'threshold_tokens must be a positive number' END, CASE WHEN t = 'budget_threshold' AND p = 'daily' THEN 'billing_period must be monthly or weekly' END,
  CASE WHEN t = 'error_rate' AND k % 130 > 100 THEN 'threshold_percent must be within 0 and 100' END, CASE WHEN t = 'error_rate' AND (k % 5 = 0 OR k % 50 = 0) THEN 'evaluation_window_minutes must be positive' END,
  CASE WHEN t = 'circuit_breaker' AND coalesce(trim(s), '') = '' THEN 'service_name is required' END, CASE WHEN t = 'other' THEN 'unknown rule type' END], lambda x: x IS NOT NULL) AS es FROM r)
SELECT k AS rule_id, array_to_string(es, '; ') AS errors, CASE WHEN k % 2 = 0 THEN k % 5 = 0 ELSE k % 5 = 1 END AS target_ok FROM e""",
    "protection": """SELECT 't' || CAST(user_id AS VARCHAR) AS tenant_id, CASE WHEN r >= 0.8 THEN 'high' WHEN r >= 0.4 THEN 'medium' ELSE 'low' END AS level
FROM (SELECT user_id, avg(CASE WHEN event_id % (user_id % 3 + 1) = 0 THEN 1.0 ELSE 0.0 END) AS r FROM events GROUP BY 1)""",
    "suggestions": f"""WITH {FAILURES}, d AS (SELECT schema_type AS category, 'Failures with the code ' || error_code || ' in fields of documents of institution ' || coalesce(institution, 'unknown') AS description, 'medium' AS priority, id AS seq FROM failures),
r AS (SELECT *, row_number() OVER (PARTITION BY category, substr(description, 1, 50) ORDER BY seq) AS n FROM d) SELECT category, description, priority, seq FROM r WHERE n = 1 ORDER BY seq DESC, category DESC LIMIT 50""",
    "stale_abstentions": f"""WITH {ITEMS}, a AS (SELECT doc_id, seq, CASE part % 6 WHEN 0 THEN 'opening_balance' WHEN 1 THEN 'iban' WHEN 2 THEN 'isin' WHEN 3 THEN 'currency' ELSE 'f' || CAST(seq AS VARCHAR) END AS field, part % 5 AS t FROM items)
SELECT doc_id, seq, field FROM a WHERE NOT (field = 'iban' AND doc_id % 3 <> 0) AND NOT (doc_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND (field IN ('opening_balance', 'isin') OR t < 2))""",
    "normal_transactions": f"""SELECT o_orderkey, {_TX} || '|' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'see' END || '|' ||
  CASE WHEN o_orderkey % 4 = 0 AND o_orderkey <> 0 THEN CAST(o_orderkey AS VARCHAR) WHEN o_orderkey % 4 <> 1 AND o_orderkey <> 0 THEN CAST(o_orderkey * 2 AS VARCHAR) ELSE '' END AS txn_key FROM orders""",
    "schema_cache": f"""WITH {USAGE}, u AS (SELECT tenant_id, job_id AS fingerprint, count(*) AS n FROM usage GROUP BY 1, 2), c AS (SELECT 't' || CAST(c_custkey % 3 AS VARCHAR) AS tenant_id, 'j' || CAST(c_custkey AS VARCHAR) AS fingerprint, c_custkey % 4 AS n0 FROM customer)
SELECT tenant_id, fingerprint, n0 + coalesce(n, 0) AS use_count, CASE WHEN n IS NULL THEN '2024-01-01' ELSE '2024-02-01' END AS last_used FROM c LEFT JOIN u USING (tenant_id, fingerprint)""",
    "retry_results": f"""WITH {ITEMS}, g AS (SELECT doc_id, count(*) FILTER (part % 5 < 3) > count(*) FILTER (part % 2 = 0) AS better FROM items GROUP BY 1)
SELECT doc_id, 'f' || CAST(seq AS VARCHAR) AS field, CASE WHEN better THEN CASE WHEN part % 5 < 3 THEN 'again' END ELSE CASE WHEN part % 2 = 0 THEN 'first' END END AS value FROM items JOIN g USING (doc_id)""",
    "discovered_values": """SELECT o_orderkey AS doc_id, f AS field, f = 'total' AS required, CASE WHEN o_orderkey % 7 = 0 OR f = 'other' THEN NULL WHEN f = 'total' THEN o_orderpriority WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS value,
  CASE WHEN o_orderkey % 7 = 0 OR f = 'other' THEN 0.0 WHEN f = 'total' THEN 0.95 ELSE 0.5 END::DOUBLE AS confidence FROM orders, (SELECT unnest(['total', 'status', 'other']) AS f)""",
    "refine_schemas": """WITH e AS (SELECT event_id AS id, ts, 'k' || CAST(user_id AS VARCHAR) AS schema_key, event_id % 10 AS x FROM events),
w AS (SELECT *, count(*) OVER v AS n, sum(CAST(x >= 5 AS INTEGER)) OVER v AS s FROM e WINDOW v AS (PARTITION BY schema_key ORDER BY ts, id ROWS UNBOUNDED PRECEDING)),
p AS (SELECT schema_key, count(*) AS uses, round(sum(CAST(x >= 5 AS INTEGER)) / count(*), 6) AS rate, bool_or(n >= 10 AND s / n >= 0.95) AS stable FROM w GROUP BY 1),
c AS (SELECT schema_key, 'f' || CAST(id % 4 AS VARCHAR) AS f, count(*) AS n FROM e WHERE x < 5 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY schema_key ORDER BY n DESC, f) AS k FROM c),
g AS (SELECT schema_key, string_agg(f || ' (' || CAST(n AS VARCHAR) || ' failures)', ', ' ORDER BY k) AS worst FROM r WHERE k <= 5 GROUP BY 1),
l AS (SELECT *, row_number() OVER (PARTITION BY schema_key ORDER BY ts DESC, id DESC) AS k FROM e WHERE x < 5), o AS (SELECT schema_key, arg_min(id, k * -1) AS id FROM l WHERE k <= 3 GROUP BY 1),
q AS (SELECT p.schema_key, '[refine]' || chr(10) || 'Fields: total, date' || chr(10) || 'Found in ' || CAST(CAST(floor(rate * 100) AS BIGINT) AS VARCHAR) || ' % of ' || CAST(uses AS VARCHAR) || ' uses' || chr(10) || 'Often missing: ' || coalesce(worst, '') || chr(10) || 'Example:' || chr(10) || coalesce('event ' || CAST(o.id AS VARCHAR) || ' of [REDACTED]', '') AS prompt
  FROM p LEFT JOIN g USING (schema_key) LEFT JOIN o USING (schema_key) WHERE uses >= 5 AND rate < 0.70 AND NOT stable)
SELECT p.schema_key, CASE WHEN length(prompt) % 3 <> 0 THEN 'sum' ELSE 'total,date' END AS fields, coalesce(length(prompt) % 3 <> 0, false) AS refined, md5(prompt) AS prompt_md5 FROM p LEFT JOIN q USING (schema_key)""",
    "table_headers": f"""WITH {ITEMS}, r AS (SELECT doc_id, seq, CAST(part AS VARCHAR) || '|' || CASE WHEN part % 2 = 0 THEN CAST(seq AS VARCHAR) ELSE '' END AS line FROM items)
SELECT doc_id, max(line) FILTER (seq = 1) AS headers, coalesce(string_agg(line, ';' ORDER BY seq) FILTER (seq > 1), '') AS rows FROM r GROUP BY 1""",
    "table_fallback": f"""WITH {ITEMS}, h AS (SELECT doc_id FROM items WHERE part % 4 = 0 GROUP BY 1)
SELECT doc_id, 'a' AS rail, count(*) AS tables, CAST(sum(part) AS BIGINT) AS parts FROM items WHERE part % 4 = 0 GROUP BY 1 UNION ALL SELECT doc_id, 'b', count(*), CAST(sum(part) AS BIGINT) FROM items WHERE doc_id NOT IN (SELECT doc_id FROM h) GROUP BY 1""",
    "paired_tables": f"""WITH {ITEMS}, a AS (SELECT doc_id, seq % 2 AS page, seq, row_number() OVER (PARTITION BY doc_id, seq % 2 ORDER BY seq) AS i FROM items),
b AS (SELECT doc_id, seq % 2 AS page, seq AS bs, row_number() OVER (PARTITION BY doc_id, seq % 2 ORDER BY seq) AS i FROM items WHERE part % 3 <> 0)
SELECT doc_id, page, seq AS table_seq, bs AS b_table_seq FROM a LEFT JOIN b USING (doc_id, page, i)""",
    "recognised_once": "SELECT doc_id, 1 AS page, sha256(coalesce(text, '')) AS page_hash, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM documents",
    "upserted": """WITH e AS (SELECT user_id AS key, event_id AS version, event_type AS state FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS n FROM e WHERE version % 2 = 0),
b AS (SELECT key, version, state FROM o WHERE n = 1 UNION ALL SELECT * FROM e WHERE version % 2 = 1), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY version DESC) AS n FROM b) SELECT key, version, state FROM r WHERE n = 1""",
    "account_balances": """WITH a AS (SELECT c_nationkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN 'IB' ELSE 'n' END || CAST(c_custkey AS VARCHAR) AS acct_key, length(CAST(c_custkey AS VARCHAR)) + 2 AS n, CAST(round(c_acctbal * 100) AS BIGINT) AS v FROM customer)
SELECT doc_id, acct_key, v AS old, CASE WHEN n % 2 = 0 THEN v + CASE WHEN n = 4 THEN 1 ELSE 0 END END AS new, n % 2 <> 0 OR n = 4 AS changed FROM a""",
    "section_lines": f"WITH {LINES} SELECT doc_id, count(*) AS rows, count(*) FILTER (seq < 3) AS measured, CAST(sum(length(text)) FILTER (seq < 3) AS BIGINT) AS chars FROM lines GROUP BY 1",
    "csv_export": """SELECT c_custkey, c_name || ' "x", y' AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment FROM customer""",
    "html_export": """WITH r AS (SELECT n_regionkey, '<tr><td>' || n_name || ' &lt;&amp;&gt;</td><td>' || CAST(n_nationkey AS VARCHAR) || '</td></tr>' AS row FROM nation)
SELECT n_regionkey, '<table><tr><th>name</th><th>n_nationkey</th></tr>' || string_agg(row, '' ORDER BY row) || '</table>' AS html FROM r GROUP BY 1""",
    "acknowledged_alerts": """WITH m AS (SELECT event_id - event_id % 3 AS id, user_id, ts, row_number() OVER (PARTITION BY event_id - event_id % 3 ORDER BY ts, user_id) AS n FROM events WHERE event_type <> 'error')
SELECT event_id AS id, e.user_id AS rule_id, m.user_id AS acknowledged_by, strftime(m.ts, '%Y-%m-%d %H:%M:%S') AS acknowledged_at FROM events e LEFT JOIN m ON m.id = event_id AND n = 1 WHERE event_type = 'error'""",
    "stream_progress": "SELECT 'j' || CAST(user_id AS VARCHAR) AS job_id, CASE WHEN event_type = 'view' THEN 'ocr' ELSE 'vlm' END AS kind, count(*) AS done, max(user_id % 9) AS total FROM events GROUP BY 1, 2",
    "stream_batches": "SELECT event_type, count(*) AS events, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS value FROM events GROUP BY 1",
    "relevant_pages": "SELECT conv_id AS doc_id, turn AS page FROM conversations WHERE coalesce(length(text) % 4 = 0, false) OR (turn % 2 = 0 AND coalesce(contains(text, 'a'), false))",
}
