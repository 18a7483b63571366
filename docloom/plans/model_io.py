"""Queries of model replies, records' status, breakers and alert history, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import model_io

from .standins import ITEMS, USAGE, items, read, usage


def flat_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    account = F.struct(F.concat(F.lit("N"), F.col("c_custkey").cast("string")).alias("account_number"), F.when(F.col("c_custkey") % 2 == 0, F.lit("EUR")).alias("currency"), (F.col("c_custkey") * 1.5).alias("closing_balance"))
    body = F.struct(F.col("c_name").alias("client_name"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("institution"), F.when(F.col("c_custkey") % 5 == 0, F.array().cast("array<struct<account_number:string,currency:string,closing_balance:double>>")).otherwise(F.array(account, account)).alias("accounts"))
    reply = F.when(F.col("c_custkey") % 4 == 0, F.to_json(F.struct(body.alias("value")))).otherwise(F.concat(F.lit("```json\n"), F.to_json(body), F.lit("\n```")))
    return model_io.flat_fields(c.select(F.col("c_custkey").alias("doc_id"), reply.alias("reply")))


def attach_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    accounts = i.select("doc_id", F.col("seq").alias("acct_seq"), (F.col("part") % 4 == 0).alias("has_transactions"))
    tables = i.filter(F.col("part") % 5 == 0).select("doc_id", F.col("seq").alias("table_seq"), F.when(F.col("part") % 2 == 0, "transactions").otherwise("positions").alias("table_type"))
    return model_io.attach_tables(accounts, tables, "transactions", "has_transactions").select("doc_id", "table_seq", "acct_seq")


def header_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    h = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("date of"), F.lit("date"))).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("x"), F.lit("value date"), F.lit("da"))).otherwise(F.array(F.lit("x"), F.lit("y")))
    return o.select("o_orderkey", model_io.header_index(h, ["date", "datum"]).cast("bigint").alias("place"))


def result_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
    status = F.element_at(F.array(F.lit("failed"), F.lit("complete"), F.lit("partial"), F.lit(None)), (F.col("k") % 4 + 1).cast("int"))
    return o.select("o_orderkey", model_io.result_status(status, F.col("k") % 3, F.col("k") % 5, F.col("k") % 7).alias("result"))


def page_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = items(spark, sf_dir).select("doc_id", F.col("seq").alias("field"), F.when(F.col("part") % 10 != 0, F.col("seq")).alias("page"))
    return model_io.highlights(f, 2)


def section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    sections = i.filter(F.col("seq") % 3 == 1).select("doc_id", F.col("seq").alias("section"), F.col("seq").alias("start_page"), (F.col("seq") + 2).alias("end_page"))
    return model_io.section_pages(sections, i.select("doc_id", F.col("seq").alias("page"))).select("doc_id", "section", "page")


def account_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.transform(F.sequence(F.lit(1), F.col("o_orderkey") % 3 + 1), lambda k: F.sequence(F.lit(1).cast("bigint"), k + 1)).alias("tables"))
    return model_io.account_counts(a)


def job_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_io.job_usage(usage(spark, sf_dir), 20_000)


def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    fields = i.select("doc_id", F.concat(F.lit("f"), F.col("seq").cast("string")).alias("field"), F.when(F.col("part") % 6 != 0, F.col("part").cast("string")).alias("value"))
    required = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(F.lit("f1"), F.lit("f2"))).alias("field"))
    return model_io.required_missing(fields, required)


def breaker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = read(spark, sf_dir, "events").select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("service"), F.col("event_id").cast("double").alias("at"), (F.col("value") < 40).alias("ok"))
    return model_io.breaker_states(calls, 2, 200.0).groupBy("service").agg(F.count_if("allowed").alias("allowed"), F.count_if(F.col("state") == "open").alias("open"), F.count("*").alias("calls"))


def alert_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    changes = e.select(F.col("event_id").alias("rule_id"), F.explode(F.array(F.struct(F.col("ts").cast("timestamp").alias("at"), F.lit("firing").alias("to_state")), F.struct((F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("at"), F.when(F.col("event_id") % 3 == 0, "resolved").otherwise("idle").alias("to_state")))).alias("c")).select("rule_id", "c.*")
    old = e.filter(F.col("event_id") % 2 == 0).select(F.col("event_id").alias("rule_id"), (F.col("ts").cast("timestamp") - F.expr("INTERVAL 1 DAY")).alias("fired_at"), F.lit(None).cast("timestamp").alias("resolved_at"))
    h = model_io.history_after(old, changes)
    return h.groupBy((F.col("rule_id") % 6).alias("k")).agg(F.count("*").alias("fired"), F.count("resolved_at").alias("resolved"))


QUERIES = {f.__name__: f for f in (flat_reply, attach_tables, header_index, result_status, page_highlights, section_pages, account_counts, job_usage, required_fields, breaker_states, alert_history)}

_STEP = """CASE WHEN starts_with(acc, 'open') AND CAST(split_part(x, '|', 1) AS DOUBLE) - CAST(split_part(acc, '|', 3) AS DOUBLE) < 200 THEN 'open|' || split_part(acc, '|', 2) || '|' || split_part(acc, '|', 3) || '|' || split_part(acc, '|', 4) || '|' || CAST(CAST(split_part(acc, '|', 5) AS BIGINT) + 1 AS VARCHAR)
  WHEN split_part(x, '|', 2) = 't' THEN 'closed|0|' || split_part(acc, '|', 3) || '|' || CAST(CAST(split_part(acc, '|', 4) AS BIGINT) + 1 AS VARCHAR) || '|' || split_part(acc, '|', 5)
  WHEN CAST(split_part(acc, '|', 2) AS BIGINT) + 1 >= 2 THEN 'open|' || CAST(CAST(split_part(acc, '|', 2) AS BIGINT) + 1 AS VARCHAR) || '|' || split_part(x, '|', 1) || '|' || CAST(CAST(split_part(acc, '|', 4) AS BIGINT) + 1 AS VARCHAR) || '|' || CAST(CAST(split_part(acc, '|', 5) AS BIGINT) + 1 AS VARCHAR)
  ELSE split_part(acc, '|', 1) || '|' || CAST(CAST(split_part(acc, '|', 2) AS BIGINT) + 1 AS VARCHAR) || '|' || split_part(x, '|', 1) || '|' || CAST(CAST(split_part(acc, '|', 4) AS BIGINT) + 1 AS VARCHAR) || '|' || split_part(acc, '|', 5) END"""

SQL = {
    "flat_reply": """SELECT c_custkey AS doc_id, 'client_name' AS field, c_name AS value FROM customer WHERE c_name IS NOT NULL UNION ALL SELECT c_custkey, 'institution', c_mktsegment FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey, 'account_number', 'N' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, 'currency', 'EUR' FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'closing_balance', CAST(CAST(c_custkey * 1.5 AS DOUBLE) AS VARCHAR) FROM customer WHERE c_custkey % 5 <> 0""",
    "attach_tables": f"WITH {ITEMS}, t AS (SELECT doc_id, coalesce(min(seq) FILTER (part % 4 = 0), min(seq)) AS acct_seq FROM items GROUP BY 1) SELECT doc_id, seq AS table_seq, acct_seq FROM items JOIN t USING (doc_id) WHERE part % 10 = 0",
    "header_index": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END::BIGINT AS place FROM orders",
    "result_status": """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'success' WHEN 2 THEN CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 > 0 THEN 'success' ELSE 'warning' END
ELSE CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 7 > 0 THEN 'error' WHEN o_orderkey % 7 > 0 THEN 'warning' ELSE 'success' END END AS result FROM orders""",
    "page_highlights": f"WITH {ITEMS} SELECT doc_id, seq AS field, CASE WHEN part % 10 <> 0 THEN seq END AS page FROM items WHERE part % 10 = 0 OR seq = 2",
    "section_pages": f"WITH {ITEMS} SELECT doc_id, ((seq - 1) // 3) * 3 + 1 AS section, seq AS page FROM items",
    "account_counts": "SELECT o_custkey AS doc_id, CAST(sum(o_orderkey % 3 + 1) AS BIGINT) AS tables, CAST(sum(CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 5 ELSE 9 END) AS BIGINT) AS table_rows FROM orders GROUP BY 1",
    "job_usage": f"WITH {USAGE} SELECT job_id, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, sum(input_tokens + output_tokens) > 20000 AS exceeded FROM usage GROUP BY 1",
    "required_fields": f"WITH {ITEMS}, r AS (SELECT o_orderkey AS doc_id, unnest([1, 2]) AS k FROM orders) SELECT doc_id, 'required_fields' AS validator, 'f' || CAST(k AS VARCHAR) AS field, 'ERR_VAL_REQUIRED' AS error_code FROM r WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.doc_id = r.doc_id AND i.seq = r.k AND part % 6 <> 0)",
    "breaker_states": f"""WITH g AS (SELECT 's' || CAST(user_id AS VARCHAR) AS service, count(*) AS calls, list(CAST(event_id AS VARCHAR) || '|' || CASE WHEN value < 40 THEN 't' ELSE 'f' END ORDER BY event_id) AS xs FROM events GROUP BY 1),
f AS (SELECT service, calls, list_reduce(list_prepend('closed|0|0|0|0', xs), lambda acc, x: {_STEP}) AS a FROM g) SELECT service, CAST(split_part(a, '|', 4) AS BIGINT) AS allowed, CAST(split_part(a, '|', 5) AS BIGINT) AS open, calls FROM f""",
    "alert_history": "SELECT event_id % 6 AS k, count(*) + count(*) FILTER (event_id % 2 = 0) AS fired, count(*) FILTER (event_id % 3 = 0) AS resolved FROM events GROUP BY 1",
}
