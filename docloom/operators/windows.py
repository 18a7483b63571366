"""Page windows, token budgets, and merging what windows and sections return."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import fixed
from docloom.functions.columns import to_float, token_estimate


def sliding_windows(docs: DataFrame, size: int = 12, overlap: int = 3) -> DataFrame:
    """doc_id, window (from 0), start_page, end_page, of documents (doc_id, n_pages); the last window ends the document.

    Windows follow from the page count by arithmetic; the pages themselves are not touched.
    """
    step = max(1, size - overlap)
    last = F.greatest(F.lit(0), F.ceil((F.col("n_pages") - size) / F.lit(float(step)))).cast("int")
    w = docs.filter(F.col("n_pages") > 0).select("doc_id", "n_pages", F.explode(F.sequence(F.lit(0), last)).alias("window"))
    return w.select("doc_id", F.col("window").cast("bigint").alias("window"), (F.col("window") * step + 1).cast("bigint").alias("start_page"), F.least(F.col("window") * step + size, F.col("n_pages")).cast("bigint").alias("end_page"))


def tumbling_windows(pages: DataFrame) -> DataFrame:
    """doc_id, window, start_page, end_page, text: five pages a window from 20 pages on, else three."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    size = F.when(n >= 20, 5).otherwise(3)
    p = pages.withColumn("window", F.floor((F.col("page") - 1) / size).cast("bigint"))
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return p.groupBy("doc_id", "window").agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def token_budget(calls: DataFrame, maximum: int, mode: str = "skip") -> DataFrame:
    """Calls (job_id, call_idx, tokens) with the total before them and whether they go ahead.

    skip: a call goes ahead while the total before it is at most the maximum; flag, proceed: always. ``exceeded`` tells
    that the total with it is over the maximum.
    """
    if mode not in ("skip", "flag", "proceed"):
        raise ValueError("mode is skip, flag or proceed")
    w = Window.partitionBy("job_id").orderBy("call_idx").rowsBetween(Window.unboundedPreceding, -1)
    c = calls.withColumn("total_before", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    go = (F.col("total_before") <= maximum) if mode == "skip" else F.lit(True)
    return c.withColumn("allowed", go).withColumn("exceeded", F.col("total_before") + F.col("tokens") > maximum)


def select_tier(docs: DataFrame, context: int = fixed.CONTEXT_TOKENS, share: float = fixed.CONTEXT_SHARE) -> DataFrame:
    """P10: doc_id, tier, of documents (doc_id, text, missing ARRAY<STRING>): single if the text fits, tier1 if only header fields are missing, else tier2."""
    header = F.array(*[F.lit(f) for f in fixed.HEADER_PAGES])
    only_header = (F.size("missing") > 0) & (F.size(F.array_except("missing", header)) == 0)
    tier = F.when(token_estimate(F.col("text")) <= int(context * share), "single").when(only_header, "tier1").otherwise("tier2")
    return docs.select("doc_id", tier.alias("tier"))


def target_pages(missing: DataFrame, pages_of: Mapping[str, tuple[int, int]] | None = None, least: int = 2, most: int = 5) -> DataFrame:
    """doc_id, pages: the pages that a document's missing header fields stand on, two at least and five at most.

    missing: doc_id, n_pages, field. Negative places count from the end; a set of one page takes its neighbour.
    """
    pages_of = pages_of or fixed.HEADER_PAGES
    place = lambda k: F.lit(k) if k > 0 else F.col("n_pages") + 1 + k
    first = F.create_map(*[x for f, (a, _) in pages_of.items() for x in (F.lit(f), F.greatest(F.lit(1), place(a)))])[F.col("field")]
    last = F.create_map(*[x for f, (_, b) in pages_of.items() for x in (F.lit(f), F.least(F.col("n_pages"), place(b)))])[F.col("field")]
    m = missing.withColumn("__a", F.least(first, F.col("n_pages")).cast("int")).withColumn("__b", F.greatest(last, F.lit(1)).cast("int")).filter("__a is not null and n_pages > 0")
    g = m.groupBy("doc_id", "n_pages").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("__a", "__b"))))).alias("p"))
    more = F.when((F.size("p") < least) & (F.col("n_pages") >= least), F.array_sort(F.array_union("p", F.array(F.when(F.get("p", F.lit(0)) < F.col("n_pages"), F.get("p", F.lit(0)) + 1).otherwise(F.get("p", F.lit(0)) - 1).cast("int"))))).otherwise(F.col("p"))
    return g.select("doc_id", F.slice(more, 1, most).alias("pages"))


def dedup_transactions(rows: DataFrame, keys: Sequence[str] = ("doc_id",), order: Sequence[str] = ("window_idx", "txn_seq")) -> DataFrame:
    """One row for each (date, description, absolute amount), the first in order; rows with amount 0 all stay.

    The amount is the debit, else the credit; what is no number counts as 0.
    """
    amount = F.abs(F.coalesce(to_float(F.coalesce(F.col("debit").cast("string"), F.col("credit").cast("string"))), F.lit(0.0)))
    r = rows.withColumn("__amount", amount)
    w = Window.partitionBy(*keys, "date", "description", "__amount").orderBy(*order)
    return r.withColumn("__n", F.row_number().over(w)).filter("__n = 1 or __amount = 0").drop("__n", "__amount")


def merge_windows(windows: DataFrame) -> DataFrame:
    """doc_id, institution and opening_balance of the first window, closing_balance of the last that has one."""
    least = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("window_idx")))
    return windows.groupBy("doc_id").agg(
        F.min_by("institution", "window_idx").alias("institution"), least("opening_balance").alias("opening_balance"),
        F.max_by("closing_balance", F.when(F.col("closing_balance").isNotNull(), F.col("window_idx"))).alias("closing_balance"), F.count("*").alias("windows"),
    )


def first_non_null(rows: DataFrame, key: str, order: str, fields: Sequence[str]) -> DataFrame:
    """Each field's first known value in order."""
    return rows.groupBy(key).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])


def merge_accounts(accounts: DataFrame, fields: Sequence[str] = ("currency", "account_type", "opening_balance", "closing_balance")) -> DataFrame:
    """Accounts of a document with the same number (else IBAN) become one; without either each stays alone.

    Scalars come from the first row, in acct_seq order, that has one (empty and zero count as none); transaction lists
    are joined in order. Rows without a key and without transactions go.
    """
    a = accounts.withColumn("__id", F.coalesce(F.nullif(F.trim("account_number"), F.lit("")), F.nullif(F.trim("iban"), F.lit(""))))
    a = a.filter(F.col("__id").isNotNull() | (F.size("transactions") > 0)).withColumn("acct_key", F.coalesce("__id", F.concat(F.lit("unidentified_"), F.col("acct_seq").cast("string"))))
    types = dict(a.dtypes)

    def first(c: str) -> Column:
        known = F.nullif(F.trim(c), F.lit("")) if types[c] == "string" else F.nullif(F.col(c), F.lit(0))
        return F.min_by(known, F.when(known.isNotNull(), F.col("acct_seq"))).alias(c)

    lists = F.array_sort(F.collect_list(F.struct("acct_seq", "transactions")))
    return a.groupBy("doc_id", "acct_key").agg(F.min("acct_seq").alias("acct_seq"), *[first(c) for c in fields], F.flatten(F.transform(lists, lambda x: x["transactions"])).alias("transactions"))


def sample_pages(pages: DataFrame, first: int = 5, context: int = fixed.CONTEXT_TOKENS, share: float = 0.8) -> DataFrame:
    """K9: a document's first pages, less the last of them while they pass the share of the context; one stays."""
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    p = pages.withColumn("__n", F.count("*").over(w)).filter(F.col("__n") <= first)
    p = p.withColumn("__chars", F.sum(F.length(F.coalesce("text", F.lit("")))).over(w))
    return p.filter((F.col("__n") == 1) | (F.floor(F.col("__chars") / fixed.CHARS_PER_TOKEN) <= context * share)).drop("__n", "__chars")
