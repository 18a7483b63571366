"""From fields, tables and abstentions to a document's record, and comparing two records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.columns import confidence_band


def confidence_summary(docs: DataFrame, fields: DataFrame, abstained: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """A1, A2: one row per document, without fields too: counts, mean and least confidence, status.

    failed without fields; complete with account data, with three fields and at most two abstentions, or without
    abstentions; else partial. Both sides are aggregated before they are joined.
    """
    f = fields.groupBy("doc_id").agg(
        F.count("*").alias("fields_extracted"), F.avg("confidence").alias("__mean"), F.min("confidence").alias("__min"), F.count_if("vlm_used").alias("vlm_used_count"),
        F.bool_or(F.coalesce("has_data", F.lit(False))).alias("__data"),
    )
    a = abstained.filter(F.col("field").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("fields_abstained"))
    j = docs.select("doc_id").join(f.hint("merge"), "doc_id", "left").join(a.hint("merge"), "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    n, m = zero("fields_extracted"), zero("fields_abstained")
    status = F.when(n == 0, "failed").when(F.coalesce("__data", F.lit(False)) | ((n >= 3) & (m <= 2)) | (m == 0), "complete").otherwise("partial")
    out = j.select(
        "doc_id", n.alias("fields_extracted"), m.alias("fields_abstained"), zero("vlm_used_count").alias("vlm_used_count"),
        F.round(F.coalesce("__mean", F.lit(0.0)), 4).alias("mean_confidence"), F.round(F.coalesce("__min", F.lit(0.0)), 4).alias("min_confidence"), status.alias("status"),
    )
    if tables is None:
        return out
    hard = tables.groupBy("doc_id").agg(F.count("*").alias("tables"), F.count_if(F.col("verdict") == "hard_flag").alias("tables_hard_flagged"))
    return out.join(hard.hint("merge"), "doc_id", "left").withColumns({"tables": zero("tables"), "tables_hard_flagged": zero("tables_hard_flagged")})


def package(summary: DataFrame, fields: DataFrame, abstained: DataFrame) -> DataFrame:
    """The nested record of a document: its summary, a map of fields, a list of abstentions."""
    f = fields.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.struct("value", "confidence", "rule").alias("v"))))).alias("fields"))
    a = abstained.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("field", "reason"))).alias("abstentions"))
    return summary.join(f.hint("merge"), "doc_id", "left").join(a.hint("merge"), "doc_id", "left")


def resolve(abstained: DataFrame, answers: DataFrame) -> DataFrame:
    """Abstentions with the model's answer (value, confidence) and whether it resolves them."""
    j = abstained.join(answers.select("doc_id", "field", "value", "confidence").hint("merge"), ["doc_id", "field"], "left")
    return j.withColumn("resolved", F.col("value").isNotNull())


# Fields that a model's account data stand for.
ACCOUNT_FIELDS = ("portfolio_id", "valuation_date", "total_value", "trade_date", "settlement_date", "isin", "quantity", "price", "counterparty_bic", "opening_balance")


def still_open(abstained: DataFrame, fields: DataFrame, with_accounts: DataFrame | None = None) -> DataFrame:
    """abstentions (doc_id, field[, table_id]) that nothing has resolved.

    A field that has a value by now is resolved. Documents in ``with_accounts`` (doc_id: a model found accounts with
    transactions or tables) need no abstention of a transactions or positions table, nor of an account field.
    """
    out = abstained.join(fields.filter(F.col("value").isNotNull()).select("doc_id", "field").distinct().hint("merge"), ["doc_id", "field"], "left_anti")
    if with_accounts is None:
        return out
    covered = F.coalesce(F.col("field").isin(*ACCOUNT_FIELDS), F.lit(False))
    if "table_id" in abstained.columns:
        covered = covered | F.coalesce(F.contains("table_id", F.lit("transactions")) | F.contains("table_id", F.lit("positions")), F.lit(False))
    marked = out.join(with_accounts.select("doc_id").distinct().withColumn("__data", F.lit(True)).hint("merge"), "doc_id", "left")
    return marked.filter(~(F.col("__data").isNotNull() & covered)).select(*abstained.columns)


def needs_retry(docs: DataFrame, most: float = 0.5) -> DataFrame:
    """Documents (fields_extracted, fields_abstained) with more than half of the attempted fields missing."""
    attempted = F.col("fields_extracted") + F.col("fields_abstained")
    rate = F.coalesce(F.try_divide(F.col("fields_abstained").cast("double"), attempted.cast("double")), F.lit(0.0))
    return docs.withColumn("abstention_rate", F.round(rate, 6)).withColumn("retry", rate > most)


def keep_better(first: DataFrame, retried: DataFrame) -> DataFrame:
    """The retry's fields for documents where it found strictly more, else the first run's."""
    count = lambda d, n: d.filter(F.col("value").isNotNull()).groupBy("doc_id").agg(F.count("*").alias(n))
    better = count(retried, "__r").join(count(first, "__f").hint("merge"), "doc_id", "left").filter(F.col("__r") > F.coalesce("__f", F.lit(0))).select("doc_id")
    return retried.join(better.hint("merge"), "doc_id", "left_semi").unionByName(first.join(better.hint("merge"), "doc_id", "left_anti"))


def bands(fields: DataFrame) -> DataFrame:
    """fields by confidence band."""
    return fields.groupBy(confidence_band(F.col("confidence")).alias("band")).agg(F.count("*").alias("fields"))


def field_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Key, field, old, new, change (added, removed, changed, same) over the union of both sides' fields."""
    j = a.select("key", "field", F.col("value").cast("string").alias("old"), F.lit(True).alias("__a")).join(
        b.select("key", "field", F.col("value").cast("string").alias("new"), F.lit(True).alias("__b")).hint("merge"), ["key", "field"], "full_outer"
    )
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return j.select("key", "field", "old", "new", change.alias("change"))


def balance_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Accounts of two records by number, else IBAN, else 'unknown', with both closing balances."""
    key = F.coalesce(F.nullif("account_number", F.lit("")), F.nullif("iban", F.lit("")), F.lit("unknown")).alias("acct_key")
    return a.select("doc_id", key, F.col("closing_balance").alias("old")).join(b.select("doc_id", key, F.col("closing_balance").alias("new")).hint("merge"), ["doc_id", "acct_key"], "full_outer").withColumn("changed", ~F.col("old").eqNullSafe(F.col("new")))


def normal_transaction(rows: DataFrame) -> DataFrame:
    """Rows with date, description and amount from the first of the usual names that holds something.

    Empty texts and zero amounts count as missing; names that ``rows`` lacks are passed over.
    """

    def first(*names: str) -> Column:
        kept = [F.when(~F.coalesce(F.col(n).cast("string"), F.lit("")).isin("", "0", "0.0", "0.00"), F.col(n).cast("string")) for n in names if n in rows.columns]
        return F.coalesce(*kept, F.lit(""))

    return rows.withColumns({"date": first("date", "value_date", "transaction_date"), "description": first("description", "narrative", "details"), "amount": first("amount", "debit", "credit")})


def transaction_key(date: Column, description: Column, amount: Column) -> Column:
    """The comparison key of a transaction."""
    return F.concat_ws("|", F.coalesce(date, F.lit("")), F.coalesce(description, F.lit("")), F.coalesce(amount.cast("string"), F.lit("")))


def transaction_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of b that a lacks (added) and of a that b lacks (removed); repeated rows repeat."""
    added = b.join(a.select(*keys).distinct(), keys, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(a.join(b.select(*keys).distinct(), keys, "left_anti").withColumn("change", F.lit("removed")))
