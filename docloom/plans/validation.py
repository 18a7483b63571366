"""Queries of the validators, page windows, merging, records and differences, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import record, validators, windows

from .standins import ACCOUNTS, DOC_PAGES, ITEMS, TRANSACTIONS, accounts, doc_pages, items, read, transactions


def _txn_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).withColumnRenamed("acct_id", "doc_id")


def running_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validators.running_balance(transactions(spark, sf_dir))


def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validators.reconciliation(accounts(spark, sf_dir), transactions(spark, sf_dir))


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    # rows of orders that are still open belong to no account yet
    t = transactions(spark, sf_dir).withColumn("acct_id", F.when(F.col("debit").isNotNull() | (F.col("txn_id") % 5 == 0), F.col("acct_id")))
    return validators.completeness(accounts(spark, sf_dir), t)


def totals_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validators.totals_crosscheck(accounts(spark, sf_dir), transactions(spark, sf_dir))


def arithmetic_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = accounts(spark, sf_dir).select(F.col("acct_id").alias("doc_id"), F.when(F.col("acct_id") % 6 == 0, "custody_statement").otherwise("bank_statement").alias("kind"), "opening", "closing")
    return validators.arithmetic_totals(docs, _txn_docs(spark, sf_dir))


def totals_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same check from tables of text, whose headers tell the columns."""
    a, t = accounts(spark, sf_dir), transactions(spark, sf_dir)
    k = F.col("acct_id")
    docs = a.select(k.alias("doc_id"), F.lit("bank_statement").alias("kind"), (F.col("opening") / 100).alias("opening"), (F.col("closing") / 100).alias("closing"))
    money = lambda c: F.coalesce(F.concat(F.lit("£"), F.format_number(F.col(c) / 100, 2)), F.lit(""))
    cells = F.array(F.col("date"), money("debit"), money("credit"))
    rows = t.groupBy("acct_id").agg(F.collect_list(F.when(F.col("txn_id") % 9 == 0, F.slice(cells, 1, 2)).otherwise(cells)).alias("rows"))
    headers = F.when(k % 3 == 0, F.array(F.lit("Date"), F.lit("Debit"), F.lit("CR"))).when(k % 3 == 1, F.array(F.lit("Date"), F.lit("Debits (GBP)"), F.lit("Credit"))).otherwise(F.array(F.lit("Date"), F.lit("Out"), F.lit("In")))
    tables_ = rows.select(k.alias("doc_id"), F.when(k % 7 == 0, "fees").otherwise("transactions").alias("type"), headers.alias("headers"), "rows")
    return validators.arithmetic_totals(docs, validators.table_amounts(tables_))


def column_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir)
    date = F.when((F.col("acct_id") % 4 == 0) & (F.col("txn_id") % 3 == 0), F.lit("1,234.50")).otherwise(F.col("date"))
    return validators.column_types(t.withColumns({"date": date, "description": F.when(F.col("txn_id") % (F.col("acct_id") % 9 + 2) == 0, F.lit("12,345.6")).otherwise(F.col("description"))}))


def multi_ccy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).select(F.col("acct_id").alias("doc_id"), F.concat(F.lit("C"), (F.col("txn_id") % 3).cast("string")).alias("currency"), "debit", "credit")
    sums = t.groupBy("doc_id", "currency").agg(F.sum(F.coalesce("debit", F.lit(0))).alias("d"), F.sum(F.coalesce("credit", F.lit(0))).alias("c"))
    balances = sums.select("doc_id", "currency", F.lit(100).cast("bigint").alias("opening"), (F.lit(100) + F.col("c") - F.col("d") + F.when(F.col("doc_id") % 7 == 0, 5).otherwise(0)).alias("closing"))
    return validators.multi_currency(balances, t)


def _identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, field, value: IBANs and ISINs with right and wrong check digits, codes and currencies."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    body = F.concat(F.lit("WEST"), F.lpad(F.col("doc_id").cast("string"), 14, "0"))
    rest = F.aggregate(F.split(F.concat(F.lit("32142829"), F.lpad(F.col("doc_id").cast("string"), 14, "0"), F.lit("161100")), ""), F.lit(0).cast("bigint"), lambda a, d: (a * 10 + d.cast("bigint")) % 97)
    check = F.lpad(F.when(F.col("doc_id") % 7 == 0, (98 - rest) % 90 + 5).otherwise(98 - rest).cast("string"), 2, "0")
    value = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("GB"), check, body))
        .when(F.col("doc_id") % 5 == 1, F.concat(F.lit("US"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), (F.col("doc_id") % 10).cast("string")))
        .when(F.col("doc_id") % 5 == 2, F.lpad(F.col("doc_id").cast("string"), 8, "0"))
        .when(F.col("doc_id") % 5 == 3, F.element_at(F.array(F.lit("eur"), F.lit("XXQ"), F.lit("GBP")), (F.col("doc_id") % 3 + 1).cast("int")))
        .otherwise(F.lit("DEUTDEFF"))
    )
    return c.select("doc_id", F.lit("code").alias("field"), value.alias("value"))


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validators.identifiers(_identifier(spark, sf_dir))


def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight forms that are read, and two that are not."""
    o = read(spark, sf_dir, "orders")
    forms = ("yyyy-MM-dd", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy/M/d", "d MMMM yy")
    value = F.element_at(F.array(*[F.date_format("o_orderdate", f) for f in forms]), (F.col("o_orderkey") % 10 + 1).cast("int"))
    return validators.dates(o.select(F.col("o_orderkey").alias("doc_id"), F.lit("date").alias("field"), value.alias("value")), "2000-06-30")


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    box = F.when(F.col("part") % 11 == 0, F.array(F.lit(1.0))).when(F.col("part") % 13 == 0, F.array(F.lit(-1.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)))
    source = F.when(F.col("part") % 17 == 0, "guess").otherwise("native")
    return validators.provenance(i.select("doc_id", F.concat(F.lit("f"), F.col("seq").cast("string")).alias("field"), (F.col("seq") - 1).alias("page"), F.lit(5).alias("total_pages"), box.alias("bbox"), source.alias("source")))


def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, t = accounts(spark, sf_dir), transactions(spark, sf_dir)
    parts = (validators.running_balance(t), validators.account_checks(a, t), validators.identifiers(_identifier(spark, sf_dir)))
    return validators.by_validator(validators.all_failures(*parts))


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("n_chars") / 150).cast("bigint").alias("n_pages"))
    return windows.sliding_windows(docs)


def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling_windows(doc_pages(spark, sf_dir)).withColumn("text", F.md5("text"))


def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = items(spark, sf_dir).select(F.col("doc_id").alias("job_id"), F.col("seq").alias("call_idx"), F.floor("quantity").cast("bigint").alias("tokens"))
    return windows.token_budget(calls, 70)


def tier_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("iban"), F.lit("currency"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("iban"), F.lit("transactions"))).otherwise(F.array().cast("array<string>"))
    return windows.select_tier(read(spark, sf_dir, "documents").select("doc_id", "text", missing.alias("missing")), context=800)


def target_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.array(F.lit("institution"), F.lit("opening_balance"), F.lit("closing_balance"), F.lit("iban"))
    d = read(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("n_chars") / 400).cast("int").alias("n_pages"), F.element_at(fields, (F.col("doc_id") % 4 + 1).cast("int")).alias("f"), F.element_at(fields, (F.floor(F.col("doc_id") / 4) % 4 + 1).cast("int")).alias("g"))
    m = d.select("doc_id", "n_pages", F.explode(F.array_distinct(F.array("f", "g"))).alias("field"))
    return windows.target_pages(m).select("doc_id", F.array_join("pages", ",").alias("pages"))


def dedup_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).select(
        (F.col("part") % 500).alias("doc_id"), F.col("doc_id").alias("window_idx"), F.col("seq").alias("txn_seq"), F.concat(F.lit("d"), (F.col("part") % 3).cast("string")).alias("date"),
        F.lit("x").alias("description"), F.when(F.col("quantity") % 2 == 0, F.col("quantity") - 10).alias("debit"), F.col("quantity").alias("credit"),
    )
    return windows.dedup_transactions(rows)


def merge_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = items(spark, sf_dir).select(
        "doc_id", F.col("seq").alias("window_idx"), F.when(F.col("part") % 2 == 0, F.concat(F.lit("i"), F.col("part").cast("string"))).alias("institution"),
        F.when(F.col("part") % 3 == 0, F.col("part")).alias("opening_balance"), F.when(F.col("part") % 5 != 0, F.col("part")).alias("closing_balance"),
    )
    return windows.merge_windows(w)


def first_non_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).select("doc_id", "seq", F.when(F.col("part") % 4 == 0, F.col("part")).alias("a"), F.when(F.col("quantity") > 25, F.col("quantity")).alias("b"))
    return windows.first_non_null(i, "doc_id", "seq", ["a", "b"])


def merge_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("acct_seq"), F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("n"), (F.col("o_orderkey") % 3).cast("string"))).otherwise("").alias("account_number"),
        F.when(F.col("o_orderkey") % 8 == 0, F.lit("IB")).alias("iban"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("EUR")).otherwise("").alias("currency"), F.lit(None).cast("string").alias("account_type"),
        F.round(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).otherwise(0.0), 2).alias("opening_balance"), F.lit(None).cast("double").alias("closing_balance"),
        F.when(F.col("o_orderkey") % 6 == 0, F.array().cast("array<bigint>")).otherwise(F.array("o_orderkey")).alias("transactions"),
    )
    m = windows.merge_accounts(o)
    return m.select("doc_id", "acct_key", "acct_seq", "currency", "opening_balance", F.array_join("transactions", ",").alias("transactions"))


def sample_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sample_pages(doc_pages(spark, sf_dir), first=4, context=300).select("doc_id", "page")


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).filter(F.col("part") % 3 != 0).select(
        "doc_id", F.concat(F.lit("f"), F.col("seq").cast("string")).alias("field"), F.col("part").cast("string").alias("value"), (F.col("quantity") / 50).alias("confidence"),
        (F.col("part") % 5 == 0).alias("vlm_used"), F.lit(False).alias("has_data"), F.lit("pattern:x").alias("rule"),
    )


def _abstained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).filter(F.col("part") % 3 == 0).select("doc_id", F.concat(F.lit("f"), F.col("seq").cast("string")).alias("field"), F.lit("ERR_EXTRACT_001").alias("reason"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))


def confidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record.confidence_summary(_docs(spark, sf_dir), _fields(spark, sf_dir), _abstained(spark, sf_dir))


def package_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = record.confidence_summary(_docs(spark, sf_dir), _fields(spark, sf_dir), _abstained(spark, sf_dir))
    p = record.package(s, _fields(spark, sf_dir), _abstained(spark, sf_dir))
    return p.select("doc_id", "status", F.coalesce(F.size("fields"), F.lit(0)).cast("bigint").alias("n_fields"), F.array_join(F.transform("abstentions", lambda a: a["field"]), ",").alias("abstained"))


def resolve_abstentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = items(spark, sf_dir).filter(F.col("part") % 2 == 0).select("doc_id", F.concat(F.lit("f"), F.col("seq").cast("string")).alias("field"), F.when(F.col("part") % 4 == 0, F.col("part").cast("string")).alias("value"), F.lit(0.8).alias("confidence"))
    return record.resolve(_abstained(spark, sf_dir), answers).groupBy("resolved").agg(F.count("*").alias("fields"), F.count("value").alias("answers"))


def abstention_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = record.confidence_summary(_docs(spark, sf_dir), _fields(spark, sf_dir), _abstained(spark, sf_dir))
    return record.needs_retry(s).select("doc_id", "abstention_rate", "retry")


def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record.bands(_fields(spark, sf_dir))


def doc_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    long = lambda d: d.select(F.col("o_orderkey").alias("key"), F.explode(F.array(F.struct(F.lit("status").alias("field"), F.col("o_orderstatus").alias("value")), F.struct(F.lit("priority").alias("field"), F.col("o_orderpriority").alias("value")))).alias("f")).select("key", "f.*")
    b = o.filter(F.col("o_orderkey") % 11 != 0).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 17 == 0, "X").otherwise(F.col("o_orderstatus")))
    return record.field_diff(long(o.filter(F.col("o_orderkey") % 7 != 0)), long(b)).groupBy("field", "change").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


def txn_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).select("acct_id", "txn_id", record.transaction_key(F.col("date"), F.col("description"), F.coalesce("debit", "credit")).alias("txn_key"))
    shifted = t.filter(F.col("txn_id") % 11 != 0).withColumn("txn_key", F.when(F.col("txn_id") % 17 == 0, F.concat("txn_key", F.lit("0"))).otherwise(F.col("txn_key")))
    return record.transaction_diff(t, shifted, ["acct_id", "txn_key"])


QUERIES = {f.__name__: f for f in (running_balance, reconciliation, completeness, totals_crosscheck, arithmetic_totals, totals_from_tables, column_types, multi_ccy, identifiers, date_range, provenance, validation_report, sliding_windows, tumbling_windows, token_budget, tier_select, target_pages, dedup_txn, merge_windows, first_non_null, merge_accounts, sample_pages, confidence_summary, package_result, resolve_abstentions, abstention_rate, confidence_bands, doc_diff, txn_diff)}

_SUMS = "sums AS (SELECT acct_id, count(*) AS n, CAST(sum(coalesce(debit, 0)) AS BIGINT) AS sd, CAST(sum(coalesce(credit, 0)) AS BIGINT) AS sc FROM transactions GROUP BY 1)"
_RB = """rb AS (SELECT acct_id AS doc_id, 'running_balance' AS validator, CAST(txn_seq AS VARCHAR) AS field, 'ERR_VAL_RUNNING_BALANCE' AS error_code FROM (
  SELECT *, last_value(balance IGNORE NULLS) OVER (PARTITION BY acct_id ORDER BY txn_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lb FROM transactions)
  WHERE balance IS NOT NULL AND lb IS NOT NULL AND abs(balance - (lb + coalesce(credit, 0) - coalesce(debit, 0))) > 0.02)"""
_REC = "rec AS (SELECT acct_id AS doc_id, 'reconciliation' AS validator, CAST(acct_id AS VARCHAR) AS field, 'ERR_VAL_BALANCE_RECON' AS error_code FROM accounts JOIN sums USING (acct_id) WHERE abs(closing - (opening + sc - sd)) > 0.02)"
_COM = "com AS (SELECT acct_id AS doc_id, 'completeness' AS validator, CAST(acct_id AS VARCHAR) AS field, 'ERR_VAL_NO_TRANSACTIONS' AS error_code FROM accounts WHERE acct_id NOT IN (SELECT acct_id FROM transactions))"
_TOT = """tot AS (SELECT acct_id AS doc_id, 'totals_crosscheck' AS validator, acct_id || '.total_debits' AS field, 'ERR_VAL_TOTALS_MISMATCH' AS error_code FROM accounts LEFT JOIN sums USING (acct_id) WHERE abs(total_debits - coalesce(sd, 0)) > 0.02
  UNION ALL SELECT acct_id, 'totals_crosscheck', acct_id || '.total_credits', 'ERR_VAL_TOTALS_MISMATCH' FROM accounts LEFT JOIN sums USING (acct_id) WHERE abs(total_credits - coalesce(sc, 0)) > 0.02)"""
_IDS = r"""ids AS (SELECT c_custkey AS k, lpad(CAST(c_custkey AS VARCHAR), 14, '0') AS p FROM customer),
rests AS (SELECT k, p, CAST(CAST('32142829' || p || '161100' AS HUGEINT) % 97 AS BIGINT) AS m FROM ids),
vals AS (SELECT k, CASE k % 5 WHEN 0 THEN 'GB' || lpad(CAST(CASE WHEN k % 7 = 0 THEN (98 - m) % 90 + 5 ELSE 98 - m END AS VARCHAR), 2, '0') || 'WEST' || p
  WHEN 1 THEN 'US' || lpad(CAST(k AS VARCHAR), 9, '0') || CAST(k % 10 AS VARCHAR) WHEN 2 THEN lpad(CAST(k AS VARCHAR), 8, '0') WHEN 3 THEN ['eur', 'XXQ', 'GBP'][k % 3 + 1] ELSE 'DEUTDEFF' END AS v, m FROM rests),
luhn AS (SELECT k, list_reverse(string_split('3028' || lpad(CAST(k AS VARCHAR), 9, '0') || CAST(k % 10 AS VARCHAR), '')) AS d FROM ids WHERE k % 5 = 1),
luhn_sum AS (SELECT k, list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i % 2 = 0 THEN CAST(d[i] AS BIGINT) * 2 // 10 + CAST(d[i] AS BIGINT) * 2 % 10 ELSE CAST(d[i] AS BIGINT) END)) AS s FROM luhn),
idf AS (SELECT k AS doc_id, 'iban' AS validator, 'code' AS field, 'ERR_VAL_002' AS error_code FROM vals WHERE k % 5 = 0 AND k % 7 = 0 AND ((98 - m) % 90 + 5 - (98 - m)) % 97 <> 0
  UNION ALL SELECT k, 'iban', 'code', 'ERR_VAL_002' FROM vals WHERE k % 5 = 1 AND CAST(substr(v, 5) || '3028' || substr(v, 3, 2) AS HUGEINT) % 97 <> 1
  UNION ALL SELECT k, 'isin', 'code', 'ERR_VAL_003' FROM luhn_sum WHERE s % 10 <> 0
  UNION ALL SELECT k, 'bic', 'code', 'ERR_VAL_004' FROM vals WHERE k % 5 = 2
  UNION ALL SELECT k, 'currency', 'code', 'ERR_VAL_006' FROM vals WHERE v = 'XXQ')"""
_FIELDS = f"""{ITEMS}, fl AS (SELECT doc_id, 'f' || CAST(seq AS VARCHAR) AS field, quantity / 50 AS confidence, part % 5 = 0 AS vlm FROM items WHERE part % 3 <> 0),
ab AS (SELECT doc_id, 'f' || CAST(seq AS VARCHAR) AS field, part, seq FROM items WHERE part % 3 = 0),
fg AS (SELECT doc_id, count(*) AS n, avg(confidence) AS mean, min(confidence) AS least, count(*) FILTER (vlm) AS v FROM fl GROUP BY 1), ag AS (SELECT doc_id, count(*) AS m, string_agg(field, ',' ORDER BY field) AS names FROM ab GROUP BY 1),
sm AS (SELECT o_orderkey AS doc_id, coalesce(n, 0) AS n, coalesce(m, 0) AS m, coalesce(v, 0) AS v, mean, least, names FROM orders LEFT JOIN fg ON fg.doc_id = o_orderkey LEFT JOIN ag ON ag.doc_id = o_orderkey)"""
_STATUS = "CASE WHEN n = 0 THEN 'failed' WHEN (n >= 3 AND m <= 2) OR m = 0 THEN 'complete' ELSE 'partial' END"

SQL = {
    "running_balance": f"WITH {TRANSACTIONS}, {_RB} SELECT * FROM rb",
    "reconciliation": f"WITH {ACCOUNTS}, {_SUMS}, {_REC} SELECT * FROM rec",
    "totals_from_tables": f"""WITH {ACCOUNTS}, s AS (SELECT acct_id, sum(coalesce(credit, 0) - coalesce(debit, 0)) AS net FROM transactions WHERE txn_id % 9 <> 0 AND acct_id % 3 < 2 AND acct_id % 7 <> 0 GROUP BY 1)
SELECT acct_id AS doc_id, 'arithmetic_totals' AS validator, 'closing_balance' AS field, 'ERR_VAL_001' AS error_code FROM accounts LEFT JOIN s USING (acct_id) WHERE closing IS NOT NULL AND abs(closing - opening - coalesce(net, 0)) > 2""",
    "completeness": f"WITH {ACCOUNTS}, {_COM.replace('FROM transactions', 'FROM transactions WHERE debit IS NOT NULL OR txn_id % 5 = 0')} SELECT * FROM com",
    "totals_crosscheck": f"WITH {ACCOUNTS}, {_SUMS}, {_TOT} SELECT * FROM tot",
    "arithmetic_totals": f"WITH {ACCOUNTS}, {_SUMS} SELECT acct_id AS doc_id, 'arithmetic_totals' AS validator, 'closing_balance' AS field, 'ERR_VAL_001' AS error_code FROM accounts LEFT JOIN sums USING (acct_id) WHERE acct_id % 6 <> 0 AND abs(closing - opening - coalesce(sc, 0) + coalesce(sd, 0)) > 0.02",
    "column_types": f"""WITH {TRANSACTIONS}, g AS (SELECT acct_id, count(*) AS n, count(*) FILTER (acct_id % 4 = 0 AND txn_id % 3 = 0) AS d, count(*) FILTER (txn_id % (acct_id % 9 + 2) = 0) AS x FROM transactions GROUP BY 1)
SELECT acct_id AS doc_id, 'column_types' AS validator, acct_id || '.date' AS field, 'ERR_VAL_COLUMN_TYPE' AS error_code FROM g WHERE d / n > 0.2 UNION ALL SELECT acct_id, 'column_types', acct_id || '.description', 'ERR_VAL_COLUMN_TYPE' FROM g WHERE x / n > 0.2""",
    "multi_ccy": f"WITH {TRANSACTIONS} SELECT acct_id AS doc_id, 'multi_currency' AS validator, 'C' || CAST(txn_id % 3 AS VARCHAR) AS field, 'ERR_VAL_001' AS error_code FROM transactions WHERE acct_id % 7 = 0 GROUP BY 1, 3 HAVING sum(coalesce(debit, 0) + coalesce(credit, 0)) > 0",
    "identifiers": f"WITH {_IDS} SELECT * FROM idf",
    "date_range": "SELECT o_orderkey AS doc_id, 'date_range' AS validator, 'date' AS field, 'ERR_VAL_005' AS error_code FROM orders WHERE o_orderkey % 10 < 8 AND (date_trunc('day', o_orderdate) > TIMESTAMP '2000-06-30' OR date_trunc('day', o_orderdate) < TIMESTAMP '1990-06-30')",
    "provenance": f"""WITH {ITEMS} SELECT doc_id, 'provenance' AS validator, 'f' || CAST(seq AS VARCHAR) || '.' || fault AS field, 'ERR_VAL_007' AS error_code FROM items,
  LATERAL (SELECT unnest(list_filter([CASE WHEN seq - 1 < 1 THEN 'page_low' END, CASE WHEN seq - 1 > 5 THEN 'page_high' END, CASE WHEN part % 11 = 0 THEN 'bbox_length' WHEN part % 13 = 0 THEN 'bbox_negative' END, CASE WHEN part % 17 = 0 THEN 'source' END], lambda x: x IS NOT NULL)) AS fault)""",
    "validation_report": f"WITH {ACCOUNTS}, {_SUMS}, {_RB}, {_REC}, {_COM}, {_TOT}, {_IDS}, every AS (SELECT * FROM rb UNION ALL SELECT * FROM rec UNION ALL SELECT * FROM com UNION ALL SELECT * FROM tot UNION ALL SELECT * FROM idf) SELECT validator, count(*) AS failures, count(DISTINCT doc_id) AS documents FROM every GROUP BY 1",
    "sliding_windows": """WITH d AS (SELECT doc_id, CAST(n_chars // 150 AS BIGINT) AS n FROM documents), w AS (SELECT doc_id, n, unnest(range(0, CAST(greatest(0, ceil((n - 12) / 9.0)) AS BIGINT) + 1)) AS win FROM d WHERE n > 0)
SELECT doc_id, win AS "window", win * 9 + 1 AS start_page, least(win * 9 + 12, n) AS end_page FROM w""",
    "tumbling_windows": f"""WITH {DOC_PAGES}, s AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY doc_id) >= 20 THEN 5 ELSE 3 END AS size FROM doc_pages)
SELECT doc_id, CAST((page - 1) // size AS BIGINT) AS "window", min(page) AS start_page, max(page) AS end_page, md5(string_agg(text, chr(10) ORDER BY page)) AS text FROM s GROUP BY 1, 2""",
    "token_budget": f"""WITH {ITEMS}, c AS (SELECT doc_id AS job_id, seq AS call_idx, CAST(floor(quantity) AS BIGINT) AS tokens FROM items),
b AS (SELECT *, CAST(coalesce(sum(tokens) OVER (PARTITION BY job_id ORDER BY call_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS total_before FROM c)
SELECT *, total_before <= 70 AS allowed, total_before + tokens > 70 AS exceeded FROM b""",
    "tier_select": "SELECT doc_id, CASE WHEN floor(length(coalesce(text, '')) / 3.5) <= 640 THEN 'single' WHEN doc_id % 3 = 0 THEN 'tier1' ELSE 'tier2' END AS tier FROM documents",
    "target_pages": """WITH d AS (SELECT doc_id, n_chars // 400 AS n, list_distinct([['institution', 'opening_balance', 'closing_balance', 'iban'][doc_id % 4 + 1], ['institution', 'opening_balance', 'closing_balance', 'iban'][(doc_id // 4) % 4 + 1]]) AS fs FROM documents),
e AS (SELECT doc_id, n, unnest(fs) AS f FROM d WHERE n > 0),
r AS (SELECT doc_id, n, CASE f WHEN 'closing_balance' THEN greatest(1, n - 1) ELSE 1 END AS a, CASE f WHEN 'institution' THEN 1 WHEN 'opening_balance' THEN least(3, n) WHEN 'iban' THEN least(2, n) ELSE n END AS b FROM e),
p AS (SELECT doc_id, n, list_sort(list_distinct(flatten(list(range(a, b + 1))))) AS p FROM r GROUP BY 1, 2),
q AS (SELECT doc_id, CASE WHEN len(p) < 2 AND n >= 2 THEN CASE WHEN p[1] < n THEN [p[1], p[1] + 1] ELSE [p[1] - 1, p[1]] END ELSE p END AS p FROM p)
SELECT doc_id, array_to_string(list_slice(p, 1, 5), ',') AS pages FROM q""",
    "dedup_txn": f"""WITH {ITEMS}, r AS (SELECT part % 500 AS doc_id, doc_id AS window_idx, seq AS txn_seq, 'd' || CAST(part % 3 AS VARCHAR) AS date, 'x' AS description, CASE WHEN quantity % 2 = 0 THEN quantity - 10 END AS debit, quantity AS credit FROM items),
a AS (SELECT *, abs(coalesce(debit, credit)) AS amount FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, date, description, amount ORDER BY window_idx, txn_seq) AS n FROM a)
SELECT doc_id, window_idx, txn_seq, date, description, debit, credit FROM n WHERE amount = 0 OR n = 1""",
    "merge_windows": f"""WITH {ITEMS} SELECT doc_id, max(CASE WHEN seq = 1 AND part % 2 = 0 THEN 'i' || CAST(part AS VARCHAR) END) AS institution, arg_min(part, seq) FILTER (part % 3 = 0) AS opening_balance,
  arg_max(part, seq) FILTER (part % 5 <> 0) AS closing_balance, count(*) AS windows FROM items GROUP BY 1""",
    "first_non_null": f"WITH {ITEMS} SELECT doc_id, arg_min(part, seq) FILTER (part % 4 = 0) AS a, arg_min(quantity, seq) FILTER (quantity > 25) AS b FROM items GROUP BY 1",
    "merge_accounts": """WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS k, CASE WHEN o_orderkey % 4 <> 0 THEN 'n' || CAST(o_orderkey % 3 AS VARCHAR) WHEN o_orderkey % 8 = 0 THEN 'IB' END AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'EUR' END AS cur,
  CASE WHEN o_orderkey % 5 <> 0 AND round(o_totalprice, 2) <> 0 THEN round(o_totalprice, 2) END AS ob, o_orderkey % 6 <> 0 AS has FROM orders)
SELECT doc_id, coalesce(id, 'unidentified_' || CAST(k AS VARCHAR)) AS acct_key, min(k) AS acct_seq, arg_min(cur, k) FILTER (cur IS NOT NULL) AS currency, arg_min(ob, k) FILTER (ob IS NOT NULL) AS opening_balance,
  coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FILTER (has), '') AS transactions FROM o WHERE id IS NOT NULL OR has GROUP BY 1, 2""",
    "sample_pages": f"""WITH {DOC_PAGES}, w AS (SELECT doc_id, page, row_number() OVER x AS n, sum(length(coalesce(text, ''))) OVER (x ROWS UNBOUNDED PRECEDING) AS c FROM doc_pages WINDOW x AS (PARTITION BY doc_id ORDER BY page))
SELECT doc_id, page FROM w WHERE n <= 4 AND (n = 1 OR floor(c / 3.5) <= 240)""",
    "confidence_summary": f"WITH {_FIELDS} SELECT doc_id, n AS fields_extracted, m AS fields_abstained, v AS vlm_used_count, round(coalesce(mean, 0), 4) AS mean_confidence, round(coalesce(least, 0), 4) AS min_confidence, {_STATUS} AS status FROM sm",
    "package_result": f"WITH {_FIELDS} SELECT doc_id, {_STATUS} AS status, n AS n_fields, names AS abstained FROM sm",
    "resolve_abstentions": f"WITH {_FIELDS} SELECT part % 4 = 0 AS resolved, count(*) AS fields, count(*) FILTER (part % 4 = 0) AS answers FROM ab GROUP BY 1",
    "abstention_rate": f"WITH {_FIELDS} SELECT doc_id, round(CASE WHEN n + m = 0 THEN 0.0 ELSE m / (n + m) END, 6) AS abstention_rate, n + m > 0 AND m / (n + m) > 0.5 AS retry FROM sm",
    "confidence_bands": f"WITH {_FIELDS} SELECT CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS band, count(*) AS fields FROM fl GROUP BY 1",
    "doc_diff": """WITH l AS (SELECT o_orderkey AS k, f.field, CASE f.field WHEN 'status' THEN o_orderstatus ELSE o_orderpriority END AS v FROM orders, (SELECT unnest(['status', 'priority']) AS field) f),
a AS (SELECT * FROM l WHERE k % 7 <> 0), b AS (SELECT k, field, CASE WHEN field = 'status' AND k % 17 = 0 THEN 'X' ELSE v END AS v FROM l WHERE k % 11 <> 0)
SELECT coalesce(a.field, b.field) AS field, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'same' ELSE 'changed' END AS change, count(*) AS n, CAST(sum(coalesce(a.k, b.k)) AS BIGINT) AS keys
FROM a FULL JOIN b ON a.k = b.k AND a.field = b.field GROUP BY 1, 2""",
    "txn_diff": f"""WITH {TRANSACTIONS}, t AS (SELECT acct_id, txn_id, date || '|' || description || '|' || CAST(coalesce(debit, credit) AS VARCHAR) AS txn_key FROM transactions),
b AS (SELECT acct_id, txn_id, CASE WHEN txn_id % 17 = 0 THEN txn_key || '0' ELSE txn_key END AS txn_key FROM t WHERE txn_id % 11 <> 0)
SELECT *, 'added' AS change FROM b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.acct_id = b.acct_id AND t.txn_key = b.txn_key) UNION ALL SELECT *, 'removed' FROM t WHERE NOT EXISTS (SELECT 1 FROM b WHERE t.acct_id = b.acct_id AND t.txn_key = b.txn_key)""",
}
