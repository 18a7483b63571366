"""Validators: each turns typed rows into failures (doc_id, validator, field, error_code); none means passed.

Money may be in any one unit; tolerances are in that unit. Fields are rows (doc_id, field, value STRING), accounts are
rows with their balances, transactions rows with debit, credit and balance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import columns as C

from .model_io import header_index

TOLERANCE = 0.02


def _failures(df: DataFrame, key: Column, name: str, field: Column, code: str) -> DataFrame:
    return df.select(key.alias("doc_id"), F.lit(name).alias("validator"), field.cast("string").alias("field"), F.lit(code).alias("error_code"))


def identifiers(fields: DataFrame) -> DataFrame:
    """V2, V3, V4, V6: values that look like an IBAN, ISIN, BIC (any 8 or 11 letters and digits) or currency and are none."""
    raw = F.coalesce("value", F.lit(""))
    # both forms are columns of their own, and the checks an array that is not filtered by a lambda, so that each is computed once and compiled
    forms = fields.select("doc_id", "field", F.explode(F.array(F.struct(F.upper(F.regexp_replace(raw, r"\s+", "")).alias("v"), F.upper(F.trim(raw)).alias("t")))).alias("x"))
    v, t = F.col("x.v"), F.col("x.t")
    checks = (
        ("iban", v.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]+$"), C.iban_ok(v), "ERR_VAL_002"),
        ("isin", t.rlike(r"^[A-Z]{2}[A-Z0-9]{9}\d$"), C.isin_ok(t), "ERR_VAL_003"),
        ("bic", t.rlike(r"^([A-Z0-9]{8}|[A-Z0-9]{11})$"), C.bic_ok(t), "ERR_VAL_004"),
        ("currency", t.rlike(r"^[A-Z]{3}$"), C.currency_ok(t), "ERR_VAL_006"),
    )
    found = F.array(*[F.when(looks, F.when(~ok, F.struct(F.lit(n).alias("validator"), F.lit(code).alias("error_code")))) for n, looks, ok, code in checks])
    return forms.select("doc_id", "field", F.explode(found).alias("f")).filter(F.col("f").isNotNull()).select("doc_id", "f.validator", "field", "f.error_code")


def dates(fields: DataFrame, as_of: str, years: int = 10) -> DataFrame:
    """Readable dates after ``as_of`` or more than ten years before it."""
    now = F.lit(as_of).cast("timestamp")
    read = fields.select("doc_id", "field", C.once(C.try_date(F.col("value")), "d"))
    bad = (F.col("d") > now) | (F.col("d") < now - F.make_interval(years=F.lit(years)))
    return _failures(read.filter(bad), F.col("doc_id"), "date_range", F.col("field"), "ERR_VAL_005")


def provenance(fields: DataFrame) -> DataFrame:
    """V7: several failures a field: page below 1, page beyond the document, box of other than four numbers, negative box, unknown source.

    Input: doc_id, field, page, total_pages, bbox, source.
    """
    box = F.when(F.size("bbox") != 4, F.lit("bbox_length")).when(F.exists("bbox", lambda x: x < 0), F.lit("bbox_negative"))
    faults = F.array(
        F.when(F.col("page") < 1, F.lit("page_low")),
        F.when((F.col("total_pages") > 0) & (F.col("page") > F.col("total_pages")), F.lit("page_high")),
        box,
        F.when(~F.col("source").isin("native", "ocr", "vlm"), F.lit("source")),
    )
    rows = fields.select("doc_id", "field", F.explode(faults).alias("fault")).filter(F.col("fault").isNotNull())
    return rows.select("doc_id", F.lit("provenance").alias("validator"), F.concat_ws(".", "field", "fault").alias("field"), F.lit("ERR_VAL_007").alias("error_code"))


def arithmetic_totals(docs: DataFrame, transactions: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """V1: closing is not opening + credits - debits; documents without rows count sums of 0. docs: doc_id, kind, opening, closing."""
    sums = transactions.groupBy("doc_id").agg(F.sum(F.coalesce("credit", F.lit(0))).alias("__c"), F.sum(F.coalesce("debit", F.lit(0))).alias("__d"))
    j = docs.filter((F.col("kind") == "bank_statement") & F.col("opening").isNotNull() & F.col("closing").isNotNull()).join(sums, "doc_id", "left")
    diff = F.abs(F.col("closing") - F.col("opening") - F.coalesce("__c", F.lit(0)) + F.coalesce("__d", F.lit(0)))
    return _failures(j.filter(diff > tolerance), F.col("doc_id"), "arithmetic_totals", F.lit("closing_balance"), "ERR_VAL_001")


def table_amounts(tables: DataFrame) -> DataFrame:
    """doc_id, debit, credit of the rows of tables (doc_id, type, headers, rows) of the type transactions.

    The columns are looked up by their lower-cased headers; a table without both, or a row that is too short, has none.
    """
    low = F.transform("headers", F.lower)
    t = tables.filter(F.col("type") == "transactions").select("doc_id", "rows", header_index(low, ("debit", "debits", "dr")).alias("__d"), header_index(low, ("credit", "credits", "cr")).alias("__c"))
    r = t.filter(F.col("__d").isNotNull() & F.col("__c").isNotNull()).select("doc_id", "__d", "__c", F.explode("rows").alias("__r"))
    r = r.filter(F.size("__r") > F.greatest("__d", "__c"))
    return r.select("doc_id", C.to_float(F.get("__r", F.col("__d"))).alias("debit"), C.to_float(F.get("__r", F.col("__c"))).alias("credit"))


def table_transactions(tables: DataFrame) -> DataFrame:
    """doc_id, txn_seq, date, description, debit, credit, balance of the rows of tables (doc_id, page or pages, table_seq, headers, rows) with debit and
    credit columns, in the order of pages, tables and rows; a row that is too short for both has none."""
    low = F.col("__low")
    names = {"date": ("date",), "description": ("description", "narrative", "details"), "debit": ("debit", "debits", "dr"), "credit": ("credit", "credits", "cr"), "balance": ("balance",)}
    at = F.struct(F.col("page") if "page" in tables.columns else F.array_min("pages").alias("page"), "table_seq")
    t = tables.withColumn("__low", F.transform("headers", F.lower)).select("doc_id", at.alias("__at"), "rows", *[header_index(low, names[n]).alias(f"__{n}") for n in names])
    r = t.filter(F.col("__debit").isNotNull() & F.col("__credit").isNotNull()).select("doc_id", "__at", *[f"__{n}" for n in names], F.posexplode("rows").alias("__k", "__r"))
    r = r.filter(F.size("__r") > F.greatest("__debit", "__credit"))
    cell = lambda n: F.get("__r", F.col(f"__{n}"))
    order = Window.partitionBy("doc_id").orderBy("__at", "__k")
    return r.select("doc_id", F.row_number().over(order).cast("bigint").alias("txn_seq"), cell("date").alias("date"), cell("description").alias("description"), *[C.to_float(cell(n)).alias(n) for n in ("debit", "credit", "balance")])


def running_balance(transactions: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Rows whose balance is not the last known one before it plus credit less debit."""
    w = Window.partitionBy("acct_id").orderBy("txn_seq").rowsBetween(Window.unboundedPreceding, -1)
    t = transactions.withColumn("__last", F.last("balance", ignorenulls=True).over(w))
    expected = F.col("__last") + F.coalesce("credit", F.lit(0)) - F.coalesce("debit", F.lit(0))
    bad = F.col("balance").isNotNull() & F.col("__last").isNotNull() & (F.abs(F.col("balance") - expected) > tolerance)
    return _failures(t.filter(bad), F.col("acct_id"), "running_balance", F.col("txn_seq"), "ERR_VAL_RUNNING_BALANCE")


def _account_sums(transactions: DataFrame) -> DataFrame:
    """A12."""
    return transactions.groupBy("acct_id").agg(F.count("*").alias("__n"), F.sum(F.coalesce("debit", F.lit(0))).alias("__d"), F.sum(F.coalesce("credit", F.lit(0))).alias("__c"))


def reconciliation(accounts: DataFrame, transactions: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """V9: accounts with both balances and transactions whose closing does not follow from them."""
    j = accounts.filter(F.col("opening").isNotNull() & F.col("closing").isNotNull()).join(_account_sums(transactions), "acct_id")
    bad = F.abs(F.col("closing") - (F.col("opening") + F.col("__c") - F.col("__d"))) > tolerance
    return _failures(j.filter(bad), F.col("acct_id"), "reconciliation", F.col("acct_id"), "ERR_VAL_BALANCE_RECON")


def column_types(transactions: DataFrame, rate: float = 0.2) -> DataFrame:
    """Accounts where over a fifth of the dates are numbers or of the descriptions are digits (more than three)."""
    date = F.trim(F.coalesce(F.col("date"), F.lit("")))
    number = C.to_double(F.replace(date, F.lit(","), F.lit(""))).isNotNull() & C.try_date(date).isNull()
    digits = F.regexp_replace(F.trim(F.coalesce("description", F.lit(""))), "[,.]", "").rlike(r"^\d{4,}$")
    g = transactions.groupBy("acct_id").agg(F.count("*").alias("n"), F.count_if(number).alias("date"), F.count_if(digits).alias("description"))
    found = F.array_compact(F.array(*[F.when(F.col(c) / F.col("n") > rate, F.lit(c)) for c in ("date", "description")]))
    rows = g.select("acct_id", F.explode(found).alias("__column"))
    return _failures(rows, F.col("acct_id"), "column_types", F.concat_ws(".", "acct_id", "__column"), "ERR_VAL_COLUMN_TYPE")


def completeness(accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    """Accounts without transactions."""
    return _failures(accounts.join(transactions, "acct_id", "left_anti"), F.col("acct_id"), "completeness", F.col("acct_id"), "ERR_VAL_NO_TRANSACTIONS")


def totals_crosscheck(accounts: DataFrame, transactions: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Stated totals that are not the sums of their columns (accounts without transactions sum to 0)."""
    j = accounts.join(_account_sums(transactions), "acct_id", "left")
    off = lambda stated, sum_: F.abs(F.col(stated) - F.coalesce(sum_, F.lit(0))) > tolerance
    found = F.array_compact(F.array(F.when(off("total_debits", "__d"), F.lit("total_debits")), F.when(off("total_credits", "__c"), F.lit("total_credits"))))
    rows = j.select("acct_id", F.explode(found).alias("__column"))
    return _failures(rows, F.col("acct_id"), "totals_crosscheck", F.concat_ws(".", "acct_id", "__column"), "ERR_VAL_TOTALS_MISMATCH")


def account_checks(accounts: DataFrame, transactions: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """The failures of ``reconciliation``, ``completeness`` and ``totals_crosscheck`` together.

    What accounts state and the sums of their transactions are grouped by account in a step of its own, instead of joined
    three times on top of the joins that made the accounts, so that a task holds one table and not all of them.
    """
    stated = accounts.select("acct_id", F.struct("opening", "closing", "total_debits", "total_credits").alias("__a"))
    g = stated.unionByName(_account_sums(transactions), allowMissingColumns=True).groupBy("acct_id")
    known = g.agg(F.collect_list("__a").alias("__a"), *[F.max(c).alias(c) for c in ("__n", "__d", "__c")])
    known = known.select("acct_id", F.explode("__a").alias("__a"), *[F.when(F.col("acct_id").isNotNull(), F.col(c)).alias(c) for c in ("__n", "__d", "__c")])
    key = F.col("acct_id").cast("string")
    fault = lambda bad, name, field, code: F.when(bad, F.struct(F.lit(name).alias("validator"), field.alias("field"), F.lit(code).alias("error_code")))
    off = lambda stated, sum_: F.abs(F.col(f"__a.{stated}") - F.coalesce(sum_, F.lit(0))) > tolerance
    found = [
        fault(F.abs(F.col("__a.closing") - (F.col("__a.opening") + F.col("__c") - F.col("__d"))) > tolerance, "reconciliation", key, "ERR_VAL_BALANCE_RECON"),
        fault(F.col("__n").isNull(), "completeness", key, "ERR_VAL_NO_TRANSACTIONS"),
        *[fault(off(c, s), "totals_crosscheck", F.concat_ws(".", "acct_id", F.lit(c)), "ERR_VAL_TOTALS_MISMATCH") for c, s in (("total_debits", "__d"), ("total_credits", "__c"))],
    ]
    return known.select(F.col("acct_id").alias("doc_id"), F.explode(F.array_compact(F.array(*found))).alias("f")).select("doc_id", "f.*")


def multi_currency(balances: DataFrame, transactions: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """V13 (opt-in): for each currency of a document with any amount, closing against opening and sums.

    balances: doc_id, currency, opening, closing; transactions: doc_id, currency, debit, credit.
    """
    s = transactions.groupBy("doc_id", "currency").agg(F.sum(F.coalesce("debit", F.lit(0))).alias("__d"), F.sum(F.coalesce("credit", F.lit(0))).alias("__c"))
    j = balances.join(s, ["doc_id", "currency"]).filter((F.col("__d") + F.col("__c")) > 0)
    bad = F.abs(F.col("closing") - (F.col("opening") + F.col("__c") - F.col("__d"))) > tolerance
    return _failures(j.filter(bad), F.col("doc_id"), "multi_currency", F.col("currency"), "ERR_VAL_001")


def all_failures(*parts: DataFrame) -> DataFrame:
    """One table of failures from lazily built ones."""
    return reduce(DataFrame.unionByName, [p.withColumn("doc_id", F.col("doc_id").cast("string")) for p in parts])


def by_validator(failures: DataFrame) -> DataFrame:
    """A25."""
    return failures.groupBy(F.coalesce("validator", F.lit("unknown")).alias("validator")).agg(F.count("*").alias("failures"), F.countDistinct("doc_id").alias("documents"))
