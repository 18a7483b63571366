"""What models return, flattened and merged into records; calls guarded by a breaker."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.columns import once, redact, strip_fences, truncate_middle
from docloom.shared import checkpointed

from .windows import tumbling_windows

# The fields of a document and of its first account.
TOP_FIELDS = ("document_type", "statement_date", "period_from", "period_to", "institution", "client_name")
ACCOUNT_FIELDS = ("account_number", "iban", "currency", "account_type", "opening_balance", "closing_balance")
REPLY = (
    "document_type STRING, statement_date STRING, period_from STRING, period_to STRING, institution STRING, client_name STRING, "
    "accounts ARRAY<STRUCT<account_number: STRING, iban: STRING, currency: STRING, account_type: STRING, opening_balance: DOUBLE, "
    "closing_balance: DOUBLE, has_transactions: BOOLEAN, has_other_tables: BOOLEAN>>"
)


def unwrapped(reply: Column) -> Column:
    """The text of a JSON reply, out of a {"value": {...}} envelope if there is one."""
    return _enveloped(strip_fences(reply))


def _enveloped(text: Column) -> Column:
    return F.coalesce(F.get_json_object(text, "$.value"), text)


def flat_fields(replies: DataFrame) -> DataFrame:
    """doc_id, field, value of replies (doc_id, reply): six fields of the document and six of its first account; nulls go."""
    r = replies.select("doc_id", F.from_json(unwrapped(F.col("reply")), REPLY).alias("r"))
    first = F.get("r.accounts", F.lit(0))
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f"r.{f}").alias("value")) for f in TOP_FIELDS] + [F.struct(F.lit(f).alias("field"), first[f].cast("string").alias("value")) for f in ACCOUNT_FIELDS]
    return r.select("doc_id", F.explode(F.array(*pairs)).alias("p")).select("doc_id", "p.*").filter(F.col("value").isNotNull())


def attach_tables(accounts: DataFrame, tables: DataFrame, kind: str, flag: str) -> DataFrame:
    """acct_seq of each table of a kind: the document's first account with the flag set, else its first account."""
    order = F.struct((~F.coalesce(F.col(flag), F.lit(False))).alias("unflagged"), F.col("acct_seq"))
    target = accounts.groupBy("doc_id").agg(F.min_by("acct_seq", order).alias("acct_seq"))
    return tables.filter(F.col("table_type") == kind).join(target, "doc_id", "left")


def header_index(headers: Column, candidates: Sequence[str]) -> Column:
    """Place (from 0) of the first header that equals a candidate, else of the first that begins one or begins with one."""
    at = [F.array_position(headers, F.lit(c)) for c in candidates]
    exact = F.array_min(F.array(*[F.when(p > 0, p - 1) for p in at])).cast("int")
    # headers that are no candidate are rare, and the lambdas run for those only
    places = F.transform(headers, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    names = F.array(*[F.lit(c) for c in candidates])
    begins = F.get(F.filter(places, lambda p: F.exists(names, lambda c: F.startswith(p["h"], c) | F.startswith(c, p["h"]))), F.lit(0))["i"]
    return F.coalesce(exact, begins)


def result_status(status: Column, fields: Column, failures: Column, abstentions: Column) -> Column:
    """error, success or warning; partial results with fields and without failures count as success."""
    known = F.when(status == "failed", "error").when(status == "complete", "success").when(status == "partial", F.when((failures == 0) & (fields > 0), "success").otherwise("warning"))
    rest = F.when((fields == 0) & (abstentions > 0), "error").when(abstentions > 0, "warning").otherwise("success")
    return F.when(status.isNull(), rest).otherwise(F.coalesce(known, rest))


def highlights(fields: DataFrame, page: int) -> DataFrame:
    """fields to mark on a page: those on it and those without a page."""
    return fields.filter(F.col("page").isNull() | (F.col("page") == page))


def section_pages(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages with the section whose range they lie in; ranges are met within the document only."""
    return pages.join(sections, "doc_id").filter(F.col("page").between(F.col("start_page"), F.col("end_page")))


def account_counts(accounts: DataFrame) -> DataFrame:
    """Tables and their rows over a document's accounts (tables ARRAY<ARRAY<...>>: rows of each table)."""
    rows = F.aggregate("tables", F.lit(0).cast("bigint"), lambda n, t: n + F.size(t))
    return accounts.groupBy("doc_id").agg(F.sum(F.size("tables").cast("bigint")).alias("tables"), F.sum(rows).alias("table_rows"))


def job_usage(calls: DataFrame, maximum: int) -> DataFrame:
    """Calls and tokens of each job and whether they pass the maximum."""
    g = calls.groupBy("job_id").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return g.withColumn("exceeded", F.col("input_tokens") + F.col("output_tokens") > maximum)


def required_missing(fields: DataFrame, required: DataFrame) -> DataFrame:
    """Opt-in validator: failures for required (doc_id, field) without a value."""
    have = fields.filter(F.col("value").isNotNull()).select("doc_id", "field").distinct()
    lost = required.join(have, ["doc_id", "field"], "left_anti")
    return lost.select("doc_id", F.lit("required_fields").alias("validator"), "field", F.lit("ERR_VAL_REQUIRED").alias("error_code"))


def breaker_states(calls: DataFrame, threshold: int = 3, recovery: float = 30.0) -> DataFrame:
    """Service, at, state and allowed for a service's calls (service, at in seconds, ok) in order.

    ``threshold`` failures in a row open the breaker; ``recovery`` seconds later one call is let through, and its success
    closes it. A refused call counts for nothing. Calls are sorted by service and time and run through batch by batch;
    only the breaker's state is carried, so a service may have any number of calls, but its calls run in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        service, state, failed, last = None, "closed", 0, 0.0
        first = True
        for batch in batches:
            states, passed = [], []
            for name, at, ok in zip(*(batch.column(c).to_pylist() for c in ("service", "at", "ok"))):
                if first or name != service:
                    service, state, failed, last, first = name, "closed", 0, 0.0, False
                allowed = state != "open" or (at is not None and at - last >= recovery)
                if allowed and ok:
                    state, failed = "closed", 0
                elif allowed:
                    failed, last = failed + 1, at if at is not None else last
                    state = "open" if failed >= threshold else state
                states.append(state)
                passed.append(allowed)
            yield pa.RecordBatch.from_arrays([batch.column("service"), batch.column("at"), pa.array(states, pa.string()), pa.array(passed, pa.bool_())], ["service", "at", "state", "allowed"])

    c = calls.select("service", F.col("at").cast("double").alias("at"), "ok")
    kind = c.schema["service"].dataType.simpleString()
    return c.repartition("service").sortWithinPartitions("service", "at", "ok").mapInArrow(run, f"service {kind}, at double, state string, allowed boolean")


def history_after(history: DataFrame, changes: DataFrame) -> DataFrame:
    """ST5, J13: alert history (rule_id, fired_at, resolved_at) after changes (rule_id, at, to_state): firing appends a row, resolved closes the latest open one."""
    none = F.lit(None).cast("timestamp")
    rows = history.select("rule_id", "fired_at", "resolved_at").unionByName(changes.filter("to_state = 'firing'").select("rule_id", F.col("at").alias("fired_at"), none.alias("resolved_at")))
    # a mark closes the row that was fired last before it, or at its time: within the day, else the last one of an earlier
    # day, so that a busy rule's history is dealt out by days
    points = rows.select("rule_id", F.col("fired_at").alias("at"), F.lit(0).alias("kind")).unionByName(changes.filter("to_state = 'resolved'").select("rule_id", "at", F.lit(1).alias("kind")))
    points = points.withColumn("__day", F.to_date("at"))
    order = Window.partitionBy("rule_id", "__day").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    today = F.last(F.when(F.col("kind") == 0, F.col("at")), ignorenulls=True).over(order)
    days = points.groupBy("rule_id", "__day").agg(F.max(F.when(F.col("kind") == 0, F.col("at"))).alias("__last"))
    earlier = Window.partitionBy("rule_id").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select("rule_id", "__day", F.max("__last").over(earlier).alias("__before"))
    points = points.withColumn("__today", today).join(carried, ["rule_id", "__day"])
    fired = F.coalesce("__today", "__before")
    closing = points.withColumn("fired_at", fired).filter("kind = 1 and fired_at is not null").groupBy("rule_id", "fired_at").agg(F.min("at").alias("__closed"))
    return rows.join(closing, ["rule_id", "fired_at"], "left").select("rule_id", "fired_at", F.coalesce("resolved_at", "__closed").alias("resolved_at"))


def acknowledged(history: DataFrame, marks: DataFrame) -> DataFrame:
    """ST8: history with acknowledged_by and acknowledged_at of the first mark (id, user_id, at) of each row."""
    first = marks.groupBy("id").agg(F.min(F.struct("at", "user_id")).alias("m"))
    return history.join(first, "id", "left").select(*history.columns, F.col("m.user_id").alias("acknowledged_by"), F.col("m.at").alias("acknowledged_at"))


TABLES_REPLY = "tables ARRAY<STRUCT<table_type: STRING, headers: ARRAY<STRING>, rows: ARRAY<STRING>>>"


def accounts_of(answered: DataFrame) -> DataFrame:
    """P14, phase one: doc_id, acct_seq (from 0), the account fields and flagged (it has tables) of replies (doc_id, reply) that parse and name accounts."""
    r = answered.select("doc_id", once(strip_fences(F.col("reply")), "t")).select("doc_id", once(F.from_json(_enveloped(F.col("t")), REPLY)["accounts"], "accounts"))
    a = r.select("doc_id", F.posexplode("accounts").alias("acct_seq", "a"))
    flagged = F.coalesce("a.has_transactions", F.lit(False)) | F.coalesce("a.has_other_tables", F.lit(False))
    return a.select("doc_id", F.col("acct_seq").cast("bigint").alias("acct_seq"), *[F.col(f"a.{f}").alias(f) for f in ACCOUNT_FIELDS], flagged.alias("flagged"))


def table_requests(pages: DataFrame, accounts: DataFrame) -> DataFrame:
    """P14, W8, phase two: doc_id, window, prompt, prompt_key for the windows of documents in which phase one found accounts.

    A prompt names the accounts, so that phase two is asked about what phase one returned; windows are three pages, five
    from 20 pages on, and together hold the whole document.
    """
    named = F.array_sort(F.collect_list(F.struct("acct_seq", F.coalesce("account_number", "iban", F.lit("?")).alias("n"))))
    known = accounts.groupBy("doc_id").agg(F.array_join(F.transform(named, lambda x: x["n"]), ", ").alias("__accounts"))
    w = tumbling_windows(pages).join(known, "doc_id")
    place = F.concat(F.lit("\nPages "), F.col("start_page").cast("string"), F.lit("-"), F.col("end_page").cast("string"), F.lit("\n"))
    w = w.select("doc_id", "window", "__accounts", "start_page", "end_page", once(redact(F.coalesce("text", F.lit(""))), "text"))
    prompt = F.concat(F.lit("[tables]\nAccounts: "), F.col("__accounts"), place, F.col("text"))
    return w.select("doc_id", "window", prompt.alias("prompt")).withColumn("prompt_key", F.sha2("prompt", 256))


def window_tables(answered: DataFrame) -> DataFrame:
    """doc_id, table_seq, table_type, headers, rows of replies (doc_id, window, reply): tables with equal headers are one, wherever they stand.

    A row is a list of cells or an object by header. Tables are numbered by where they begin, rows keep the order of
    windows. Replies that do not parse have none.
    """
    t = answered.select("doc_id", "window", once(strip_fences(F.col("reply")), "t")).select("doc_id", "window", once(F.from_json(_enveloped(F.col("t")), TABLES_REPLY)["tables"], "tables")).select("doc_id", "window", F.posexplode("tables").alias("k", "t"))
    cells = lambda row: F.when(row.startswith("{"), F.transform("t.headers", lambda h: F.try_element_at(F.from_json(row, "map<string,string>"), h))).otherwise(F.from_json(row, "array<string>"))
    rows = F.transform(F.coalesce("t.rows", F.array().cast("array<string>")), cells)
    at = F.struct("window", "k")
    g = t.filter(F.col("t").isNotNull()).select("doc_id", at.alias("at"), "t.table_type", F.coalesce("t.headers", F.array().cast("array<string>")).alias("headers"), rows.alias("rows"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "rows")))
    m = g.groupBy("doc_id", "headers").agg(F.min("at").alias("at"), F.min_by("table_type", "at").alias("table_type"), F.flatten(F.transform(ordered, lambda x: x["rows"])).alias("rows"))
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1
    return m.select("doc_id", seq.cast("bigint").alias("table_seq"), "table_type", "headers", "rows")


def two_phases(pages: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Accounts (doc_id, acct_seq, account fields) with tables, an array of the tables that phase two found, in order.

    Phase one asks once a document for its accounts, phase two by windows for tables. All tables of a document go to its
    first account that phase one flagged as having some, else to its first.
    """
    accounts = checkpointed(accounts_of(ask(metadata_requests(pages))))
    found = checkpointed(window_tables(ask(table_requests(pages, accounts))))
    target = accounts.groupBy("doc_id").agg(F.min_by("acct_seq", F.struct(~F.col("flagged"), F.col("acct_seq"))).alias("acct_seq"))
    listed = F.array_sort(F.collect_list(F.struct("table_seq", "table_type", "headers", "rows")))
    of_account = found.groupBy("doc_id").agg(listed.alias("tables")).join(target, "doc_id")
    return accounts.drop("flagged").join(of_account, ["doc_id", "acct_seq"], "left")


def metadata_requests(pages: DataFrame) -> DataFrame:
    """P14, X12, phase one: doc_id, prompt, prompt_key; of a long text, its beginning and end, where documents name their accounts."""
    ordered = F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("t"))))
    d = pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("__t"))
    d = d.select("doc_id", once(redact(F.col("__t")), "__t"))
    return d.select("doc_id", F.concat(F.lit("[metadata]\n"), truncate_middle(F.col("__t"))).alias("prompt")).withColumn("prompt_key", F.sha2("prompt", 256))
