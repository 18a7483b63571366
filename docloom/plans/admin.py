"""Queries of the operational analytics and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import admin

from .standins import FAILURES, JOBS, LOGS, USAGE, failures, jobs, logs, read, usage


def usage_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = admin.usage_filter(usage(spark, sf_dir), tenant="t1", model="click", start="2024-01-05", end="2024-01-20")
    return admin.page(rows, [F.desc("ts"), F.desc("id")], 2, 50).select("id", "job_id", "input_tokens", "output_tokens")


def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.usage_totals(usage(spark, sf_dir), "model_id")


def usage_by_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.usage_totals(usage(spark, sf_dir), "tenant_id", "job_id")


def usage_timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.share_of_peak(admin.usage_timeseries(admin.usage_filter(usage(spark, sf_dir), start="2024-01-02", end="2024-01-28"), "week"))


def logs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = admin.log_filter(logs(spark, sf_dir), "warning", tenant="t2", start="2024-01-03", end="2024-01-25")
    return rows.groupBy("severity", "event_name").agg(F.count("*").alias("entries"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def logs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.page(admin.log_filter(logs(spark, sf_dir), "error"), [F.desc("ts"), F.desc("id")], 3, 100).select("id", "severity", "trace_id")


def logs_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.log_filter(logs(spark, sf_dir), trace="tr42").orderBy("ts", "id").select("id", "severity", "event_name", "message")


def budget_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("rule_id"),
        F.when(F.col("c_custkey") % 4 != 3, F.concat(F.lit("t"), (F.col("c_custkey") % 4).cast("string"))).alias("tenant_id"),
        (F.col("c_custkey") * 1500).alias("threshold_tokens"),
        F.when(F.col("c_custkey") % 2 == 0, "weekly").otherwise("monthly").alias("billing_period"),
    )
    return admin.budget_alerts(rules, usage(spark, sf_dir), "2024-01-24 12:00:00")


def error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.error_rates(jobs(spark, sf_dir), "2024-01-20 00:00:00", 4320, "tenant_id", "schema_type")


def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.batch_status(jobs(spark, sf_dir))


def feedback_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    feedback = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"),
        F.concat(F.lit("f"), (F.col("event_id") % 7).cast("string")).alias("field_name"),
        ((F.col("event_id") % 100) / 100).alias("confidence"),
        (F.col("event_id") % 5 == 0).alias("is_critical"),
        F.col("ts").alias("created_at"),
    )
    return admin.feedback_review(feedback, jobs(spark, sf_dir), "2024-01-10")


def failure_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.failure_patterns(failures(spark, sf_dir))


def latest_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.failure_patterns(admin.latest_failures(failures(spark, sf_dir)))


def schema_perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "ts", F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("schema_key"),
        F.when(F.col("user_id") % 3 == 0, F.lit(9)).otherwise(F.col("event_id") % 10).cast("bigint").alias("extracted"), F.lit(10).cast("bigint").alias("total"),
    )
    return admin.schema_performance(runs)


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("seq"),
        F.when(F.col("l_returnflag") == "N", "ocr").otherwise("vlm").alias("kind"),
        F.lit(10).alias("total"), (F.col("l_quantity") / 10).alias("seconds"),
    )
    return admin.progress(steps)


def rbac(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    roles = F.element_at(F.array(F.lit("admin"), F.lit("operator"), F.lit("viewer")), (F.col("c_custkey") % 3 + 1).cast("int"))
    users = c.select(F.col("c_custkey").alias("user_id"), roles.alias("role"), F.array((F.col("c_custkey") % 5).cast("string"), (F.col("c_custkey") % 7).cast("string")).alias("tenant_ids"))
    requests = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 7).cast("string").alias("tenant_id"),
        F.element_at(F.array(F.lit("read"), F.lit("write"), F.lit("manage")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("permission"),
    )
    grants = c.select(F.explode(F.array(*[F.struct(F.lit(a).alias("role"), F.lit(b).alias("permission")) for a, b in
        (("admin", "read"), ("admin", "write"), ("admin", "manage"), ("operator", "read"), ("operator", "write"), ("viewer", "read"))])).alias("g")).select("g.*").distinct()
    return admin.allowed(users, grants, requests).select("request_id", "allowed")


def redaction_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "supplier")
    base = n.select(F.col("s_suppkey").alias("tenant_id"), F.concat(F.lit("EMAIL,"), F.col("s_nationkey").cast("string")).alias("entities"))
    over = n.filter(F.col("s_suppkey") % 3 == 0).select(F.col("s_suppkey").alias("tenant_id"), F.concat(F.lit("s"), (F.col("s_suppkey") % 4).cast("string")).alias("schema_type"), F.lit("IBAN").alias("entities"))
    return admin.effective_redaction(base, over)


_TOTALS = """count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens, round(sum(input_tokens) * 0.003 / 1000 + sum(output_tokens) * 0.015 / 1000, 6) AS estimated_cost"""
_SEV = "CASE lower(trim(severity)) WHEN 'warn' THEN 'warning' WHEN 'err' THEN 'error' WHEN 'fatal' THEN 'critical' WHEN 'crit' THEN 'critical' WHEN 'debug' THEN 'debug' WHEN 'warning' THEN 'warning' WHEN 'error' THEN 'error' WHEN 'critical' THEN 'critical' ELSE 'info' END"
_PATTERNS = """SELECT category, subject, failures, priority FROM (
  SELECT 'field_pattern' AS category, institution || '/' || field_name AS subject, count(*) AS failures, CASE WHEN count(*) >= 5 THEN 'high' ELSE 'medium' END AS priority FROM f WHERE institution IS NOT NULL AND field_name IS NOT NULL GROUP BY 2 HAVING count(*) >= 3
  UNION ALL SELECT 'schema_coverage', schema_type, count(*), 'high' FROM f WHERE error_code IN ('ERR_VLM_003', 'ERR_EXTRACT_002') GROUP BY 2 HAVING count(*) >= 5
  UNION ALL SELECT 'error_code', error_code, count(*), CASE WHEN count(*) >= 20 THEN 'high' ELSE 'medium' END FROM f GROUP BY 2 HAVING count(*) >= 10)
WHERE (SELECT count(*) FROM f) >= 5"""

QUERIES = {f.__name__: f for f in (usage_list, usage_summary, usage_by_tenant, usage_timeseries, logs_query, logs_page, logs_trace, budget_alert, error_rate, batch_status, feedback_review, failure_patterns, latest_failures, schema_perf, progress, rbac, redaction_config)}

SQL = {
    "usage_list": f"WITH {USAGE} SELECT id, job_id, input_tokens, output_tokens FROM usage WHERE tenant_id = 't1' AND model_id = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, id DESC LIMIT 50 OFFSET 50",
    "usage_summary": f"WITH {USAGE} SELECT model_id, {_TOTALS} FROM usage GROUP BY model_id",
    "usage_by_tenant": f"WITH {USAGE} SELECT tenant_id, job_id, {_TOTALS} FROM usage GROUP BY tenant_id, job_id",
    "usage_timeseries": f"""WITH {USAGE}, s AS (SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS period, {_TOTALS} FROM usage WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-28' GROUP BY 1)
SELECT *, round(total_tokens * 100.0 / max(total_tokens) OVER (), 4) AS percent FROM s""",
    "logs_query": f"""WITH {LOGS}, n AS (SELECT *, {_SEV} AS sev FROM logs) SELECT sev AS severity, event_name, count(*) AS entries, min(id) AS first_id, max(id) AS last_id FROM n
WHERE sev IN ('warning', 'error', 'critical') AND tenant_id = 't2' AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-25' GROUP BY 1, 2""",
    "logs_page": f"WITH {LOGS}, n AS (SELECT id, ts, trace_id, {_SEV} AS severity FROM logs) SELECT id, severity, trace_id FROM n WHERE severity IN ('error', 'critical') ORDER BY ts DESC, id DESC LIMIT 100 OFFSET 200",
    "logs_trace": f"WITH {LOGS} SELECT id, {_SEV} AS severity, event_name, message FROM logs WHERE trace_id = 'tr42'",
    "budget_alert": f"""WITH {USAGE}, r AS (SELECT c_custkey AS rule_id, CASE WHEN c_custkey % 4 <> 3 THEN 't' || CAST(c_custkey % 4 AS VARCHAR) END AS tenant_id, c_custkey * 1500 AS threshold, c_custkey % 2 = 0 AS weekly FROM customer),
w AS (SELECT tenant_id, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS u FROM usage WHERE ts >= TIMESTAMP '2024-01-22' AND ts <= TIMESTAMP '2024-01-24 12:00:00' GROUP BY 1),
m AS (SELECT tenant_id, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS u FROM usage WHERE ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-01-24 12:00:00' GROUP BY 1),
x AS (SELECT rule_id, threshold, CAST(coalesce(CASE WHEN weekly THEN (SELECT sum(u) FROM w WHERE r.tenant_id IS NULL OR w.tenant_id = r.tenant_id) ELSE (SELECT sum(u) FROM m WHERE r.tenant_id IS NULL OR m.tenant_id = r.tenant_id) END, 0) AS BIGINT) AS used FROM r)
SELECT rule_id, used, used >= threshold AS breached FROM x""",
    "error_rate": f"""WITH {JOBS} SELECT tenant_id, schema_type, count(*) FILTER (status = 'failed') AS failed, count(*) AS total, round(count(*) FILTER (status = 'failed') * 100.0 / count(*), 4) AS error_rate
FROM jobs WHERE created_at >= TIMESTAMP '2024-01-17' AND created_at <= TIMESTAMP '2024-01-20' GROUP BY 1, 2""",
    "batch_status": f"WITH {JOBS} SELECT batch_id, count(*) AS jobs, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'failed') AS failed, bool_and(status IN ('complete', 'failed', 'partial')) AS finished FROM jobs GROUP BY 1",
    "feedback_review": f"""WITH {JOBS}, fb AS (SELECT event_id AS job_id, 'f' || CAST(event_id % 7 AS VARCHAR) AS field_name, (event_id % 100) / 100.0 AS confidence, event_id % 5 = 0 AS is_critical, ts FROM events)
SELECT schema_type, field_name, count(*) AS corrections, round(avg(CAST(confidence AS DOUBLE)), 6) AS mean_confidence, count(*) FILTER (is_critical) AS critical FROM fb JOIN jobs USING (job_id) WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1, 2""",
    "failure_patterns": f"WITH {FAILURES}, f AS (SELECT * FROM failures) {_PATTERNS}",
    "latest_failures": f"WITH {FAILURES}, f AS (SELECT * FROM failures ORDER BY ts DESC, id DESC LIMIT 1000) {_PATTERNS}",
    "schema_perf": """WITH r AS (SELECT event_id AS id, ts, 'k' || CAST(user_id AS VARCHAR) AS schema_key, CASE WHEN (CASE WHEN user_id % 3 = 0 THEN 9 ELSE event_id % 10 END) >= 5 THEN 1 ELSE 0 END AS ok FROM events),
w AS (SELECT *, count(*) OVER x AS n, sum(ok) OVER x AS s FROM r WINDOW x AS (PARTITION BY schema_key ORDER BY ts, id ROWS UNBOUNDED PRECEDING)),
g AS (SELECT schema_key, count(*) AS uses, CAST(sum(ok) AS BIGINT) AS successes, bool_or(n >= 10 AND s / n >= 0.95) AS stable FROM w GROUP BY 1)
SELECT schema_key, uses, successes, stable, round(successes / uses, 6) AS rate, uses >= 5 AND successes / uses < 0.70 AND NOT stable AS needs_refinement FROM g""",
    "progress": """WITH s AS (SELECT l_orderkey AS job_id, l_linenumber AS seq, CASE WHEN l_returnflag = 'N' THEN 'ocr' ELSE 'vlm' END AS kind, l_quantity / 10 AS seconds FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY job_id, kind ORDER BY seq DESC) AS k FROM s),
g AS (SELECT job_id, count(*) FILTER (kind = 'ocr') AS od, CASE WHEN bool_or(kind = 'ocr') THEN 10 ELSE 0 END AS ot, count(*) FILTER (kind = 'vlm') AS vd, coalesce(avg(seconds) FILTER (kind = 'ocr' AND k <= 20), 0) AS mean FROM k GROUP BY 1)
SELECT job_id, CAST(floor(least(od, 10) * 5.0 + least(vd, 10) * 4.0) AS BIGINT) AS percent, round(greatest(ot - od, 0) * mean, 4) AS ocr_eta_seconds FROM g""",
    "rbac": """WITH u AS (SELECT c_custkey AS user_id, ['admin', 'operator', 'viewer'][c_custkey % 3 + 1] AS role, [CAST(c_custkey % 5 AS VARCHAR), CAST(c_custkey % 7 AS VARCHAR)] AS tenants FROM customer),
q AS (SELECT o_orderkey AS request_id, o_custkey AS user_id, CAST(o_orderkey % 7 AS VARCHAR) AS tenant_id, ['read', 'write', 'manage'][o_orderkey % 3 + 1] AS permission FROM orders)
SELECT request_id, coalesce((role = 'admin' OR (role = 'operator' AND permission IN ('read', 'write')) OR (role = 'viewer' AND permission = 'read')) AND (role = 'admin' OR list_contains(tenants, tenant_id)), false) AS allowed FROM q LEFT JOIN u USING (user_id)""",
    "redaction_config": "SELECT s_suppkey AS tenant_id, CASE WHEN s_suppkey % 3 = 0 THEN 's' || CAST(s_suppkey % 4 AS VARCHAR) END AS schema_type, CASE WHEN s_suppkey % 3 = 0 THEN 'IBAN' ELSE 'EMAIL,' || CAST(s_nationkey AS VARCHAR) END AS entities FROM supplier",
}
