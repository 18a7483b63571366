"""Queries that join jobs, users and rules with what hangs on them; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import admin

from .standins import JOBS, jobs, read


def _text(column: str, prefix: str) -> F.Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def job_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with everything that hangs on them."""
    line = read(spark, sf_dir, "lineitem")
    tenants = read(spark, sf_dir, "region").select(_text("r_regionkey", "t").alias("tenant_id"), F.col("r_name").alias("tenant"))
    batches = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("batch_id"), F.col("c_mktsegment").alias("batch_status"))
    results = read(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 2).alias("job_id"), F.col("o_orderkey").alias("created_at"), (F.col("o_custkey") % 9).alias("fields_extracted"))
    feedback = line.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("rating"))
    calls = line.select(F.col("l_partkey").alias("job_id"), F.floor("l_quantity").cast("bigint").alias("total_tokens"))
    sent = line.select(F.col("l_suppkey").alias("job_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("attempt"), F.col("l_linestatus").alias("status"))
    out = admin.job_relations(jobs(spark, sf_dir).select("job_id", "tenant_id", "batch_id", "status"), tenants, batches, results, feedback, calls, sent)
    return out.select("job_id", "tenant_id", "batch_id", "status", "tenant", "batch_status", "fields_extracted", "feedback", "rating", "calls", "tokens", "delivery_status")


def user_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.concat(F.lit("t"), (F.col("o_orderkey") % 3).cast("string")).alias("tenant_id"), F.col("o_orderstatus").alias("role"))
    users = admin.users_with_roles(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")), roles)
    return users.select("user_id", F.array_join(F.transform("roles", lambda r: F.concat(r["tenant_id"], F.lit(":"), r["role"])), ",").alias("roles"))


def rule_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of one tenant's alerts by rule; rules without any too."""
    e = read(spark, sf_dir, "events")
    none = F.lit(None).cast("timestamp_ntz")
    history = e.select(F.col("user_id").alias("rule_id"), F.concat(F.lit("t"), (F.col("event_id") % 3).cast("string")).alias("tenant_id"), F.col("ts").alias("fired_at"), F.when(F.col("event_type") != "error", F.col("ts")).otherwise(none).alias("resolved_at"))
    out = admin.rules_with_history(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rule_id")), admin.history_filter(history, tenant="t1"))
    return out.withColumn("last_fired_at", F.date_format("last_fired_at", "yyyy-MM-dd HH:mm:ss"))


QUERIES = {f.__name__: f for f in (job_relations, user_roles, rule_history)}

SQL = {
    "job_relations": f"""WITH {JOBS}, r AS (SELECT o_orderkey // 2 AS job_id, max_by(o_custkey % 9, o_orderkey) AS fields_extracted FROM orders GROUP BY 1),
f AS (SELECT l_orderkey AS job_id, count(*) AS feedback, round(avg(l_linenumber), 4) AS rating FROM lineitem GROUP BY 1), u AS (SELECT l_partkey AS job_id, count(*) AS calls, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS tokens FROM lineitem GROUP BY 1),
d AS (SELECT l_suppkey AS job_id, max(lpad(CAST(l_orderkey * 10 + l_linenumber AS VARCHAR), 20, '0') || l_linestatus)[-1] AS delivery_status FROM lineitem GROUP BY 1)
SELECT job_id, tenant_id, batch_id, status, r_name AS tenant, c_mktsegment AS batch_status, fields_extracted, coalesce(feedback, 0) AS feedback, rating, coalesce(calls, 0) AS calls, coalesce(tokens, 0) AS tokens, delivery_status
FROM jobs LEFT JOIN r USING (job_id) LEFT JOIN f USING (job_id) LEFT JOIN u USING (job_id) LEFT JOIN d USING (job_id) LEFT JOIN region ON tenant_id = 't' || CAST(r_regionkey AS VARCHAR) LEFT JOIN customer ON c_custkey = batch_id""",
    "user_roles": """WITH r AS (SELECT DISTINCT o_custkey AS user_id, 't' || CAST(o_orderkey % 3 AS VARCHAR) || ':' || o_orderstatus AS role FROM orders)
SELECT c_custkey AS user_id, coalesce(string_agg(role, ',' ORDER BY role), '') AS roles FROM customer LEFT JOIN r ON user_id = c_custkey GROUP BY 1""",
    "rule_history": """WITH h AS (SELECT user_id, count(*) AS firings, count(*) FILTER (event_type = 'error') AS open, max(ts) AS last FROM events WHERE event_id % 3 = 1 GROUP BY 1)
SELECT c_custkey AS rule_id, coalesce(firings, 0) AS firings, coalesce(open, 0) AS open, strftime(last, '%Y-%m-%d %H:%M:%S') AS last_fired_at FROM customer LEFT JOIN h ON user_id = c_custkey""",
}
