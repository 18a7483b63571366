"""Operational and document tables derived from the driver's tables, as DataFrames and as the same SQL.

Each function derives one table from the given Parquet tables; the constant of the same name in capitals is a CTE body
for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, tenant_id, job_id, model_id, input_tokens, output_tokens, ts."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"),
        F.concat(F.lit("j"), F.col("user_id").cast("string")).alias("job_id"),
        F.col("event_type").alias("model_id"),
        F.floor("value").cast("bigint").alias("input_tokens"),
        (F.col("event_id") % 500).alias("output_tokens"),
        F.col("ts"),
    )


USAGE = """usage AS (SELECT event_id AS id, 't' || CAST(user_id % 3 AS VARCHAR) AS tenant_id, 'j' || CAST(user_id AS VARCHAR) AS job_id,
  event_type AS model_id, CAST(floor(value) AS BIGINT) AS input_tokens, event_id % 500 AS output_tokens, ts FROM events)"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, severity (as written by programs), event_name, tenant_id, trace_id, message."""
    kinds = F.create_map(*[F.lit(x) for kv in (("error", "ERR"), ("purchase", "warn"), ("signup", "Fatal"), ("click", "debug"), ("view", "info")) for x in kv])
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        "ts",
        kinds[F.col("event_type")].alias("severity"),
        F.col("event_type").alias("event_name"),
        F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"),
        F.concat(F.lit("tr"), (F.col("event_id") % 700).cast("string")).alias("trace_id"),
        F.col("props").alias("message"),
    )


LOGS = """logs AS (SELECT event_id AS id, ts,
  CASE event_type WHEN 'error' THEN 'ERR' WHEN 'purchase' THEN 'warn' WHEN 'signup' THEN 'Fatal' WHEN 'click' THEN 'debug' WHEN 'view' THEN 'info' END AS severity,
  event_type AS event_name, 't' || CAST(user_id % 3 AS VARCHAR) AS tenant_id, 'tr' || CAST(event_id % 700 AS VARCHAR) AS trace_id, props AS message FROM events)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, tenant_id, batch_id, schema_type, status, created_at."""
    e = read(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "processing").when(F.col("event_type") == "signup", "partial").otherwise("complete")
    return e.select(
        F.col("event_id").alias("job_id"),
        F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"),
        (F.col("event_id") % 997).alias("batch_id"),
        F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("schema_type"),
        status.alias("status"),
        F.col("ts").alias("created_at"),
    )


JOBS = """jobs AS (SELECT event_id AS job_id, 't' || CAST(user_id % 3 AS VARCHAR) AS tenant_id, event_id % 997 AS batch_id,
  's' || CAST(user_id % 4 AS VARCHAR) AS schema_type,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'processing' WHEN 'signup' THEN 'partial' ELSE 'complete' END AS status,
  ts AS created_at FROM events)"""


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, tenant_id, schema_type, institution, field_name, error_code, ts."""
    codes = F.create_map(*[F.lit(x) for kv in (("error", "ERR_VLM_003"), ("view", "ERR_EXTRACT_002"), ("click", "ERR_EXTRACT_001"), ("signup", "ERR_OCR_001"), ("purchase", "ERR_VAL_001")) for x in kv])
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"),
        F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("schema_type"),
        F.when(F.col("user_id") % 20 != 0, F.concat(F.lit("inst"), (F.col("user_id") % 20).cast("string"))).alias("institution"),
        F.when(F.col("event_id") % 6 != 0, F.concat(F.lit("f"), (F.col("event_id") % 6).cast("string"))).alias("field_name"),
        codes[F.col("event_type")].alias("error_code"),
        "ts",
    )


FAILURES = """failures AS (SELECT event_id AS id, 't' || CAST(user_id % 3 AS VARCHAR) AS tenant_id, 's' || CAST(user_id % 4 AS VARCHAR) AS schema_type,
  CASE WHEN user_id % 20 <> 0 THEN 'inst' || CAST(user_id % 20 AS VARCHAR) END AS institution,
  CASE WHEN event_id % 6 <> 0 THEN 'f' || CAST(event_id % 6 AS VARCHAR) END AS field_name,
  CASE event_type WHEN 'error' THEN 'ERR_VLM_003' WHEN 'view' THEN 'ERR_EXTRACT_002' WHEN 'click' THEN 'ERR_EXTRACT_001' WHEN 'signup' THEN 'ERR_OCR_001' WHEN 'purchase' THEN 'ERR_VAL_001' END AS error_code,
  ts FROM events)"""


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """acct_id, txn_seq, txn_id, date, description, debit, credit, balance: cents; some balances missing or wrong."""
    o = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "acct_id")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    order = Window.partitionBy("acct_id").orderBy("o_orderdate", "o_orderkey")
    t = o.select(
        "acct_id",
        F.row_number().over(order).cast("bigint").alias("txn_seq"),
        F.col("o_orderkey").alias("txn_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.concat(F.lit("order "), F.col("o_orderpriority")).alias("description"),
        F.when(F.col("o_orderstatus") == "F", cents).alias("debit"),
        F.when(F.col("o_orderstatus") != "F", cents).alias("credit"),
        F.sum(F.when(F.col("o_orderstatus") == "F", -cents).otherwise(cents)).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("true_balance"),
    )
    balance = F.when(F.col("txn_id") % 5 == 0, None).when(F.col("txn_id") % 97 == 0, F.col("true_balance") + 100).otherwise(F.col("true_balance"))
    return t.withColumn("balance", balance).drop("true_balance")


TRANSACTIONS = """raw_txn AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
ordered_txn AS (SELECT o_custkey AS acct_id, row_number() OVER w AS txn_seq, o_orderkey AS txn_id, strftime(o_orderdate, '%Y-%m-%d') AS date,
  'order ' || o_orderpriority AS description, CASE WHEN o_orderstatus = 'F' THEN cents END AS debit, CASE WHEN o_orderstatus <> 'F' THEN cents END AS credit,
  CAST(sum(CASE WHEN o_orderstatus = 'F' THEN -cents ELSE cents END) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS true_balance
  FROM raw_txn WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
transactions AS (SELECT acct_id, txn_seq, txn_id, date, description, debit, credit,
  CASE WHEN txn_id % 5 = 0 THEN NULL WHEN txn_id % 97 = 0 THEN true_balance + 100 ELSE true_balance END AS balance FROM ordered_txn)"""


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """acct_id, opening, closing (cents; closing is wrong for one account in 11, missing for one in 13), total_debits, total_credits."""
    sums = transactions(spark, sf_dir).groupBy("acct_id").agg(F.sum(F.coalesce("debit", F.lit(0))).alias("d"), F.sum(F.coalesce("credit", F.lit(0))).alias("c"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("acct_id"), F.round(F.col("c_acctbal") * 100).cast("bigint").alias("opening"))
    j = c.join(sums, "acct_id", "left").withColumns({"d": F.coalesce("d", F.lit(0)), "c": F.coalesce("c", F.lit(0))})
    closing = F.col("opening") + F.col("c") - F.col("d") + F.when(F.col("acct_id") % 11 == 0, 500).otherwise(0)
    return j.select(
        "acct_id",
        "opening",
        F.when(F.col("acct_id") % 13 != 0, closing).alias("closing"),
        (F.col("d") + F.when(F.col("acct_id") % 17 == 0, 300).otherwise(0)).alias("total_debits"),
        F.when(F.col("acct_id") % 3 != 0, F.col("c")).alias("total_credits"),
    )


ACCOUNTS = (
    TRANSACTIONS
    + """,
acct_sums AS (SELECT acct_id, CAST(sum(coalesce(debit, 0)) AS BIGINT) AS d, CAST(sum(coalesce(credit, 0)) AS BIGINT) AS c FROM transactions GROUP BY 1),
acct_base AS (SELECT c_custkey AS acct_id, CAST(round(c_acctbal * 100) AS BIGINT) AS opening, coalesce(d, 0) AS d, coalesce(c, 0) AS c FROM customer LEFT JOIN acct_sums ON acct_id = c_custkey),
accounts AS (SELECT acct_id, opening, CASE WHEN acct_id % 13 <> 0 THEN opening + c - d + CASE WHEN acct_id % 11 = 0 THEN 500 ELSE 0 END END AS closing,
  d + CASE WHEN acct_id % 17 = 0 THEN 300 ELSE 0 END AS total_debits, CASE WHEN acct_id % 3 <> 0 THEN c END AS total_credits FROM acct_base)"""
)


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page (from 1), text."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page"), "text")


DOC_PAGES = "doc_pages AS (SELECT conv_id AS doc_id, turn + 1 AS page, text FROM conversations)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq (from 0), text: the lines of documents."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    return d.withColumn("seq", F.col("seq").cast("bigint"))


LINES = """lines AS (SELECT doc_id, i - 1 AS seq, parts[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
  LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i))"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq (from 1, within doc_id), part, quantity: line items in an order without ties."""
    # the key has its name before it is dealt by, so that later steps by doc_id find it dealt
    w = Window.partitionBy("doc_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    return read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "doc_id").select("doc_id", F.row_number().over(w).cast("bigint").alias("seq"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"))


ITEMS = """items AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS seq,
  l_partkey AS part, l_quantity AS quantity FROM lineitem)"""
