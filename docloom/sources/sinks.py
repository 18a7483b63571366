"""Sinks: exports, payloads and their delivery, the log table."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.shared import numbered

TRANSACTION_COLUMNS = ("account_number", "currency", "date", "description", "debit", "credit", "balance", "amount")


def flat_transactions(accounts: DataFrame) -> DataFrame:
    """One row per transaction of accounts (account_number, currency, transactions ARRAY<STRUCT<...>>)."""
    t = accounts.select("account_number", "currency", F.explode("transactions").alias("t"))
    return t.select("account_number", "currency", "t.date", "t.description", "t.debit", "t.credit", "t.balance", F.coalesce("t.credit", -F.col("t.debit")).alias("amount"))


def write_csv(df: DataFrame, path: str) -> None:
    """Every value quoted, quotes doubled, nulls empty; one part a task."""
    df.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def csv_line(*values: Column) -> Column:
    """The same quoting as an expression."""
    return F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.coalesce(v.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for v in values])


def html_table(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A table of HTML for each key, rows in the order of their values."""
    cell = lambda c: F.concat(F.lit("<td>"), F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</td>"))
    head = "<tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>"
    row = F.concat(F.lit("<tr>"), *[cell(c) for c in columns], F.lit("</tr>"))
    return df.groupBy(key).agg(F.concat(F.lit(f"<table>{head}"), F.array_join(F.array_sort(F.collect_list(row)), ""), F.lit("</table>")).alias("html"))


def write_json(df: DataFrame, path: str, tenant: str, job: str | None = None) -> None:
    """The results of a tenant, or of one of its jobs, as JSON lines."""
    from docloom.operators.admin import for_tenant

    out = for_tenant(df, tenant)
    (out if job is None else out.filter(F.col("job_id") == job)).write.json(path)


def batch_payloads(jobs: DataFrame) -> DataFrame:
    """batch_id and the JSON payload of batches all of whose jobs have ended."""
    ended = F.bool_and(F.col("status").isin("complete", "failed", "partial"))
    results = F.array_sort(F.collect_list(F.struct(F.col("job_id").cast("string").alias("job_id"), "status")))
    g = jobs.groupBy("batch_id").agg(
        ended.alias("__ended"), F.min("tenant_id").alias("tenant_id"), F.count("*").alias("jobs_total"), F.count_if(F.col("status") == "complete").alias("jobs_complete"),
        F.count_if(F.col("status") == "failed").alias("jobs_failed"), results.alias("results"),
    )
    body = F.to_json(F.struct(F.lit("batch").alias("type"), F.col("batch_id").cast("string").alias("batch_id"), "tenant_id", "jobs_total", "jobs_complete", "jobs_failed", "results"))
    return g.filter("__ended").select("batch_id", body.alias("payload"))


def standalone_payload(job_id: Column, trace_id: Column, status: Column, result: Column) -> Column:
    """The payload of a job that belongs to no batch."""
    return F.to_json(F.struct(F.lit("standalone").alias("type"), job_id.cast("string").alias("job_id"), trace_id.alias("trace_id"), status.alias("status"), result.alias("result")))


def deliver(payloads: DataFrame, send: Callable[[str], bool], attempts: int = 3, pause: Callable[[int], float] | None = None) -> DataFrame:
    """Payloads (payload) with ``delivered`` and ``attempts``; a refused one is tried again after a pause, which
    doubles from one second with up to a second of jitter and ends at 30 seconds.

    Runs where the rows are; for a stream, call it inside foreachBatch.
    """
    import random

    import pandas as pd

    pause = pause or (lambda n: min(2.0**n + random.random(), 30.0))

    def run(batches):
        for b in batches:
            rows = []
            for p in b["payload"]:
                ok, n = False, 0
                while not ok and n < attempts:
                    if n:
                        time.sleep(pause(n - 1))
                    n += 1
                    ok = bool(send(p))
                rows.append((p, ok, n))
            yield pd.DataFrame(rows, columns=["payload", "delivered", "attempts"])

    return payloads.select("payload").mapInPandas(run, "payload string, delivered boolean, attempts int")


def log_rows(events: DataFrame, known: tuple[str, ...] = ("timestamp", "severity", "event", "tenant_id", "job_id", "trace_id", "message"), keep: tuple[str, ...] = ()) -> DataFrame:
    """Log events (event MAP<STRING,STRING>) as columns for known keys and the rest as JSON."""
    rest = F.map_filter("event", lambda k, _: ~k.isin(*known))
    return events.select(*[F.try_element_at("event", F.lit(k)).alias(k if k != "event" else "event_name") for k in known], F.when(F.size(rest) > 0, F.to_json(rest)).alias("fields"), *keep)


def log_entries(events: DataFrame, start: int = 1) -> DataFrame:
    """Log rows with ids from ``start`` that follow their timestamps without gaps; events of one time are ordered by their content."""
    n = numbered(events, [F.try_element_at("event", F.lit("timestamp")), F.to_json("event")], "__n")
    ids = (F.col("__n") + start).cast("bigint")
    rest = log_rows(n.select("event", F.struct(ids.alias("id")).alias("__keep")), keep=("__keep",))
    return rest.select("__keep.id", *[c for c in rest.columns if c != "__keep"])
