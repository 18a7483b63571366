"""Queries of whole flows: extraction, verification, discovery, alerts, streams, exports; and their SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.similarity import repair_json
from docloom.operators import admin, discovery, documents, flow, layout, record, verify
from docloom.shared import shared_dir
from docloom.sources import files, sinks
from docloom.streaming import alerts, delivery, windows

from .documents import _BEST, _FOUND, _WORDS, FIELDS, KINDS, NEGATIVE, PERSONAL, _penalised
from .standins import ITEMS, JOBS, TRANSACTIONS, doc_pages, items, jobs, lines, read, transactions


def extract_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: kind, fields, abstentions and status of every document."""
    docs = read(spark, sf_dir, "documents")
    kinds = documents.detect_kind(docs, KINDS, NEGATIVE, least=0.1, gap=1.2)
    found = documents.find_fields(lines(spark, sf_dir), FIELDS, ["seq"], {})
    missing = documents.abstentions(docs, found, list(FIELDS))
    summary = record.confidence_summary(docs, found.withColumns({"vlm_used": F.lit(False), "has_data": F.lit(False)}), missing)
    packed = record.package(summary, found, missing).join(kinds, "doc_id")
    return packed.select("doc_id", "kind", "status", "fields_extracted", "mean_confidence", F.try_element_at("fields", F.lit("word"))["value"].alias("word"), F.array_join(F.transform("abstentions", lambda a: a["field"]), ",").alias("abstained"))


def xy_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks on a grid of rows and columns with clear gaps, so that rows come first, then columns."""
    i = items(spark, sf_dir)
    x, y = F.col("part") % 3 * 80.0, F.floor(F.col("quantity") / 10) * 20.0
    blocks = i.select("doc_id", F.lit(1).alias("page"), "seq", x.alias("x0"), y.alias("y0"), (x + 50).alias("x1"), (y + 10).alias("y1"))
    return layout.order_blocks(blocks).select("doc_id", "seq", "reading_seq")


def verify_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values whose outcome exact rules decide: two words that stand together, a word of three letters or more with one too many, none."""
    p = doc_pages(spark, sf_dir)
    texts = p.select("doc_id", (F.col("page") * 1_000_000).alias("seq"), "text")
    picked = p.select("doc_id", "page", F.split(F.coalesce("text", F.lit("")), r"\s+").alias("t"))
    third = F.get("t", F.lit(2))
    value = F.when(F.col("page") % 3 == 0, F.concat_ws(" ", F.get("t", F.lit(0)), F.get("t", F.lit(1)))).when((F.col("page") % 3 == 1) & (F.length(third) >= 3), F.concat(third, F.lit("x"))).otherwise(F.lit("zzzzqqqq"))
    out = verify.verify_values(picked.select("doc_id", F.concat(F.lit("f"), F.col("page").cast("string")).alias("field"), value.alias("value")), texts, split=True)
    return out.select("doc_id", "field", "verified", (F.col("how") == "no_value").alias("blank"), F.col("seq").isNotNull().alias("placed"))


def llm_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.requests(doc_pages(spark, sf_dir), "discover").select("doc_id", F.md5("prompt").alias("prompt_md5"))


def discover_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = discovery.requests(doc_pages(spark, sf_dir), "discover")
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.concat(F.lit("Bank "), (F.length("prompt") % 9).cast("string")).alias("institution"), F.lit("letter").alias("document_type_label"),
        F.array(F.struct(F.lit("total").alias("field_name"), F.lit("amount").alias("field_type"), F.lit(True).alias("required")), F.struct(F.when(F.length("prompt") % 2 == 0, F.lit("reference")).otherwise(F.lit("")).alias("field_name"), F.lit("text").alias("field_type"), F.lit(False).alias("required"))).alias("fields"))), F.lit("\n```"))
    answered = discovery.replay(asked, asked.filter(F.length("prompt") % 5 != 0).select("prompt_key", reply.alias("reply")).dropDuplicates(["prompt_key"]))
    return discovery.discovered_schemas(answered).groupBy("fingerprint").agg(F.count("*").alias("documents"), F.sum(F.size("fields")).alias("fields"))


def common_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = read(spark, sf_dir, "events").select(F.concat(F.lit("k"), (F.col("user_id") % 40).cast("string")).alias("schema_key"), F.concat(F.lit("f"), (F.col("event_id") % 11).cast("string")).alias("field_name"))
    return discovery.common_failures(f)


def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('{"rows": [{"a": "'), F.col("o_orderpriority"), F.lit('", "b": '), F.col("o_orderkey").cast("string"), F.lit("}, {\"a\": \"x\", \"b\": [1, 2"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.get_json_object(repair_json(body), "$.rows[0].b").cast("bigint").alias("b"))


def ocr_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t, c: F.struct(t.alias("text"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0)).alias("bbox"), c.alias("confidence"))
    reply = F.to_json(F.struct(F.array(one(F.col("o_orderpriority"), F.lit(0.9)), one(F.when(F.col("o_orderkey") % 2 == 0, F.lit(" ")).otherwise(F.lit("w")), F.lit(0.5)), one(F.lit("neg"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(-1.0)).otherwise(F.lit(0.25)))).alias("results")))
    tokens = files.ocr_tokens(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_key"), reply.alias("reply")))
    return tokens.groupBy("page_key").agg(F.count("*").alias("tokens"), F.round(F.sum("confidence"), 4).alias("confidence"), F.max("y1").alias("y1"))


def export_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir)
    a = t.groupBy(F.col("acct_id").cast("string").alias("account_number")).agg(F.collect_list(F.struct("date", "description", "debit", "credit", "balance")).alias("transactions")).withColumn("currency", F.lit('E"R'))
    flat = sinks.flat_transactions(a)
    return flat.select("account_number", sinks.csv_line(*[F.col(c) for c in ("currency", "date", "debit", "credit", "amount")]).alias("line"))


def batch_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = sinks.batch_payloads(jobs(spark, sf_dir))
    return p.select("batch_id", F.get_json_object("payload", "$.jobs_total").cast("bigint").alias("jobs_total"), F.get_json_object("payload", "$.jobs_failed").cast("bigint").alias("jobs_failed"), F.size(F.from_json(F.get_json_object("payload", "$.results"), "array<struct<job_id:string,status:string>>")).cast("bigint").alias("results"))


def log_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    event = F.create_map(F.lit("severity"), F.col("event_type"), F.lit("trace_id"), F.concat(F.lit("tr"), F.col("user_id").cast("string")), F.lit("extra"), (F.col("event_id") % 5).cast("string"))
    return sinks.log_rows(e.select(event.alias("event"))).groupBy("severity", "trace_id", "fields").agg(F.count("*").alias("entries"))


def _evaluations(e: DataFrame) -> DataFrame:
    return e.select(F.col("user_id").alias("rule_id"), F.col("ts").cast("timestamp").alias("at"), (F.col("value") > 60).alias("breached"))


def alert_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.alert_summary(_evaluations(read(spark, sf_dir, "events")))


def alert_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = alerts.alert_board(_rules(spark, sf_dir), _evaluations(read(spark, sf_dir, "events")))
    return board.withColumn("last_evaluated_at", F.date_format("last_evaluated_at", "yyyy-MM-dd HH:mm:ss"))


def error_rate_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rules = read(spark, sf_dir, "customer").select(k.alias("rule_id"), F.when(k % 4 != 3, F.concat(F.lit("t"), (k % 4).cast("string"))).alias("tenant_id"), (k % 40).cast("double").alias("threshold_percent"), F.element_at(F.array(F.lit(60), F.lit(1440), F.lit(10080)), (k % 3 + 1).cast("int")).alias("window_minutes"))
    return admin.error_rate_alerts(rules, jobs(spark, sf_dir), "2024-01-20 00:00:00")


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of files; a table that is one file is read from its folder by its name."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    if "://" not in sf_dir and os.path.isfile(path):
        return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return spark.readStream.schema(schema).parquet(path)


def _in_stretches(spark: SparkSession, sf_dir: str, each_batch, stretches: int = 3) -> None:
    """The events as files that arrive stretch by stretch of time, each met by a new run of the same stream."""
    e = read(spark, sf_dir, "events")
    folder = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    cuts = e.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [k / stretches for k in range(1, stretches)], 10_000).alias("c")).first()["c"] or []
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    for k in range(len(cuts) + 1):
        part = e if not cuts else e.filter(micros < cuts[0]) if k == 0 else e.filter((micros >= cuts[k - 1]) & (micros < cuts[k])) if k < len(cuts) else e.filter(micros >= cuts[-1])
        part.write.mode("append").parquet(f"{folder}/rows")
        windows.run_batches(_evaluations(spark.readStream.schema(e.schema).parquet(f"{folder}/rows")), each_batch, f"{folder}/check")


def alert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = alerts.AlertStream(f"{shared_dir(spark)}/alerts-{uuid.uuid4().hex}")
    _in_stretches(spark, sf_dir, stream)
    return stream.changes(spark).groupBy("rule_id", "to_state").agg(F.count("*").alias("changes"))


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rule_id"), (F.col("c_custkey") % 4 != 0).alias("enabled"))


def alert_stream_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board after three micro-batches, with disabled rules: what alert_board finds over the whole table."""
    stream = alerts.AlertStream(f"{shared_dir(spark)}/alerts-{uuid.uuid4().hex}", lambda s: _rules(s, sf_dir))
    _in_stretches(spark, sf_dir, stream)
    return stream.board(spark).withColumn("last_evaluated_at", F.date_format("last_evaluated_at", "yyyy-MM-dd HH:mm:ss"))


def alert_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History and notifications from the stream's changes, with every batch handed over twice."""
    path = f"{shared_dir(spark)}/notices-{uuid.uuid4().hex}"
    targets = spark.createDataFrame([("t0", True, "https://a.example/x"), ("t1", True, " "), ("t2", False, "https://c.example/x")], "tenant_id string, enabled boolean, callback_url string")
    sink = delivery.DeliverySink(f"{path}/sent", _takes, targets)
    owners = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rule_id"), F.concat(F.lit("t"), (F.col("c_custkey") % 3).cast("string")).alias("tenant_id"))
    stream, history = alerts.AlertStream(f"{path}/alerts"), delivery.AlertHistory(f"{path}/history", sink, owners)

    def both(batch: DataFrame, batch_id: int) -> None:
        stream(batch, batch_id)
        for _ in range(2):
            history(spark.read.schema(alerts.TRANSITION).parquet(f"{stream.path}/batch={batch_id}"), batch_id)

    _in_stretches(spark, sf_dir, both)
    sent = sink.outcomes(spark).groupBy(F.split("payload_id", "@")[0].cast("bigint").alias("rule_id")).agg(F.count("*").alias("notices"), F.count_if(F.col("outcome") == "delivered").alias("delivered"))
    rows = history.read(spark).groupBy("rule_id").agg(F.count("*").alias("firings"), F.count_if(F.col("resolved_at").isNull()).alias("open"))
    return rows.join(sent, "rule_id", "left")


def _takes(key: str, url: str, payload: str) -> bool:
    return True


def _refuses_some(key: str, url: str, payload: str) -> bool:
    return int(key) % 7 != 0


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of ended batches in two micro-batches, the first handed over again at the end; a receiver that refuses some."""
    targets = spark.createDataFrame([("t0", True, "https://a.example/x"), ("t1", True, " ")], "tenant_id string, enabled boolean, callback_url string")
    sink = delivery.DeliverySink(f"{shared_dir(spark)}/deliveries-{uuid.uuid4().hex}", _refuses_some, targets, pause=lambda n: 0.0, wave=100)
    p = sinks.batch_payloads(jobs(spark, sf_dir)).select(F.col("batch_id").cast("string").alias("payload_id"), F.get_json_object("payload", "$.tenant_id").alias("tenant_id"), "payload", "batch_id")
    half = lambda k: p.filter(F.col("batch_id") % 2 == k).drop("batch_id")
    for k, batch in ((0, half(0)), (1, half(1)), (0, half(0)), (2, half(0))):
        sink(batch, k)
    return sink.outcomes(spark).select("payload_id", "tenant_id", "outcome", "attempts", F.col("payload").isNotNull().alias("kept"))


def log_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    event = F.create_map(F.lit("timestamp"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("severity"), F.col("event_type"), F.lit("trace_id"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    return sinks.log_entries(e.select(event.alias("event")), start=101).select("id", "timestamp", "severity", "trace_id")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = windows.event_time(_stream(spark, sf_dir, "events").select("ts", "event_type", F.floor(F.col("value") * 100).cast("bigint").alias("value")))
    return windows.run_once(windows.tumbling(e, "1 day", "event_type"), "complete").withColumn("start", F.date_format("start", "yyyy-MM-dd"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = windows.event_time(_stream(spark, sf_dir, "events").select("ts", "user_id"))
    s = windows.run_once(windows.sessions(e, "6 hours", "user_id"), "complete")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"), F.max("events").alias("longest"))


def circuit_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    states = F.array(F.lit("closed"), F.lit("open"), F.lit("half_open"))
    events = e.select("event_id", F.col("event_type").alias("service_name"), F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"), F.element_at(states, (F.col("event_id") % 3 + 1).cast("int")).alias("previous_state"), F.element_at(states, (F.floor(F.col("event_id") / 3) % 3 + 1).cast("int")).alias("new_state"))
    rules = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("rule_id"), F.element_at(F.array(F.lit("click"), F.lit("view"), F.lit("error")), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("service_name"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("t"), (F.col("s_suppkey") % 5).cast("string"))).alias("tenant_id"), (F.col("s_suppkey") % 4 != 0).alias("enabled"))
    return alerts.circuit_counts(events, rules)


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, seq, text: a bank statement, a custody statement or a SWIFT confirmation for every order."""
    o = read(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
    money = F.concat(F.floor("o_totalprice").cast("string"), F.lit(".5"))
    bank = [F.lit("Account Statement"), F.concat(F.lit("Account Number: "), F.lpad(F.col("k").cast("string"), 10, "7")), F.concat(F.lit("Statement Date: "), F.date_format("o_orderdate", "d/M/yyyy")), F.concat(F.lit("Opening Balance: £"), F.format_number(F.col("k"), 0)), F.when(F.col("k") % 7 != 0, F.concat(F.lit("Closing Balance: "), money))]
    custody = [F.lit("Holdings and market value"), F.concat(F.lit("Portfolio ID: PORT-"), F.col("k").cast("string")), F.concat(F.lit("Valuation Date: "), F.date_format("o_orderdate", "yyyy-MM-dd")), F.concat(F.lit("Net Asset Value: €"), money)]
    swift = [F.lit("Swift trade confirmation"), F.concat(F.lit(":98A::TRAD//"), F.date_format("o_orderdate", "yyyyMMdd")), F.lit(":35B:ISIN US0378331005"), F.concat(F.lit(":36B::SETT//UNIT/"), F.format_number(F.col("k"), 0)), F.lit(":95P::SELL//DEUTDEFFXXX"), F.lit(":20:R {4:")]
    none = [F.lit("A letter to a friend")]
    parts = F.when(F.col("k") % 4 == 0, F.array(*bank)).when(F.col("k") % 4 == 1, F.array(*custody)).when(F.col("k") % 4 == 2, F.array(*swift)).otherwise(F.array(*none))
    lines_ = o.select(F.col("k").alias("doc_id"), F.lit(1).alias("page"), F.posexplode(parts).alias("seq", "text"))
    return lines_.filter(F.col("text").isNotNull())


def process_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds, fields and abstentions of a statement for every order, by the real patterns."""
    out = flow.process(statements(spark, sf_dir)).outcomes
    number = F.round(F.col("value").try_cast("double") * 10).cast("bigint").cast("string")
    value = F.when(F.col("field").isin("closing_balance", "opening_balance", "total_value", "quantity", "price"), number).otherwise(F.col("value"))
    return out.select("doc_id", "field", F.coalesce("reason", value).alias("value"), "kind")


def _run_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks out of order: the statements, with a balance of other wording, a second part of another kind, letters of two layouts."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    money = F.concat(F.floor("o_totalprice").cast("string"), F.lit(".5"))
    known = statements(spark, sf_dir).filter(F.col("doc_id") % 4 != 3)
    one = lambda d, page, seq, text: d.select(k.alias("doc_id"), F.lit(page).alias("page"), F.lit(seq).alias("seq"), text.alias("text"))
    many = lambda d, page, texts: d.select(k.alias("doc_id"), F.lit(page).alias("page"), F.posexplode(F.array(*texts)).alias("seq", "text"))
    late = one(o.filter((k % 4 == 0) & (k % 7 == 0)), 1, 7, F.concat(F.when(k % 14 == 0, "In all ").otherwise("In sum "), money))
    second = many(o.filter(k % 12 == 0), 2, [F.lit("Holdings and market value"), F.concat(F.lit("Portfolio ID: PORT-"), k.cast("string")), F.concat(F.lit("Valuation Date: "), F.date_format("o_orderdate", "yyyy-MM-dd")), F.concat(F.lit("Net Asset Value: €"), money)])
    notice = many(o.filter(k % 8 == 3), 1, [F.lit("Notice of dispatch for the house"), F.concat(F.lit("Reference "), k.cast("string")), F.concat(F.lit("Due "), k.cast("string"), F.lit(".25"))])
    letter = one(o.filter(k % 8 == 7), 1, 0, F.lit("A friend wrote us a long letter"))
    y = F.col("seq") * 15.0
    rows = known.unionByName(late).unionByName(second).unionByName(notice).unionByName(letter)
    return rows.select("doc_id", "page", (100 - F.col("seq")).alias("seq"), "text", F.lit(10.0).alias("x0"), y.alias("y0"), F.lit(200.0).alias("x1"), (y + 8).alias("y1"))


def _run_tables(o: DataFrame, mark: F.Column) -> DataFrame:
    """A table of two transactions a document; some do not add up, some have a wrong balance, some no debit column."""
    k = F.col("o_orderkey")
    gain = F.floor("o_totalprice") + F.lit(0.5) - k + F.when(k % 3 == 1, 1).otherwise(0)
    at = k + gain
    cell = lambda c: c.cast("string")
    rows = F.array(F.array(F.lit("2024-01-01"), mark, F.lit(""), cell(gain), cell(at)), F.array(F.lit("2024-01-02"), F.lit("end"), F.lit("0"), F.lit(""), cell(at + F.when(k % 11 == 0, 5).otherwise(0))))
    names = F.array(F.lit("Date"), F.lit("Description"), F.when(k % 13 != 0, "Debit").otherwise("Amount"), F.lit("Credit"), F.lit("Balance"))
    return o.select(k.alias("doc_id"), F.lit(1).alias("page"), F.lit(1).alias("table_seq"), names.alias("headers"), rows.alias("rows"))


def _run_model(asked: DataFrame) -> DataFrame:
    """A model that goes by its prompt: it reads two wordings, makes one up, knows one layout, and has no diagnosis."""
    seen = lambda pattern: F.nullif(F.regexp_extract("prompt", pattern, 1), F.lit(""))
    made_up = F.when(F.contains("prompt", F.lit("In sum ")), "zzzz-qqqq")
    said = {"closing_balance": F.coalesce(seen(r"In all (\S+)"), made_up), "reference": seen(r"Reference (\d+)"), "due": seen(r"Due (\S+)")}
    parts = [F.concat(F.lit(f'"{f}": {{"value": "'), v, F.lit('", "confidence": 0.9}')) for f, v in said.items()]
    values = F.concat(F.lit("```json\n{"), F.array_join(F.array_compact(F.array(*parts)), ", "), F.lit("}\n```"))
    schema = F.lit('{"institution": "House", "document_type_label": "notice", "fields": [{"field_name": "reference"}, {"field_name": "due"}, {"field_name": "signatory"}]}')
    reply = F.when(F.startswith("prompt", F.lit("[fallback]")), values).when(F.startswith("prompt", F.lit("[discover]")), F.when(F.contains("prompt", F.lit("Notice of dispatch")), schema).otherwise("no idea"))
    return asked.withColumn("reply", reply)


def run_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way for every order: sections of two kinds, two readings of a table, model fallback, unknown layouts, all checks."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    rail_a, rail_b = _run_tables(o.filter(k % 5 != 0), F.lit("x")), _run_tables(o, F.when(k % 11 == 0, F.lit("y")).otherwise("X "))
    tenants = o.select(k.alias("doc_id"), F.concat(F.lit("t"), (F.col("o_custkey") % 3).cast("string")).alias("tenant_id"))
    cache = discovery.schema_cache(f"{shared_dir(spark)}/schemas-{uuid.uuid4().hex}")
    done = flow.run(_run_blocks(spark, sf_dir), rail_a, rail_b, _run_model, "2000-06-30", tenants, cache)
    failures = _listed(done.failures.withColumn("doc_id", F.col("doc_id").cast("bigint")), F.concat_ws(":", "validator", "field"), "failures")
    out = done.summary.join(failures, "doc_id", "left").join(_listed(done.abstentions, "reason", "reasons"), "doc_id", "left")
    out = out.join(_listed(done.sections, F.concat_ws(":", "section", "start_page", "end_page", "kind"), "sections"), "doc_id", "left")
    out = out.join(done.tables.select("doc_id", F.size("rows").alias("table_rows")), "doc_id", "left")
    verdict = F.when(F.col("tables_hard_flagged") > 0, "hard").when(F.col("tables") > 0, "compared")
    return out.select("doc_id", "kind", "status", "fields_extracted", "fields_abstained", "vlm_used_count", "failures", "reasons", "sections", "table_rows", verdict.alias("verdict"))


def _listed(d: DataFrame, c: F.Column | str, name: str) -> DataFrame:
    """doc_id and its values of c, sorted, joined by commas."""
    return d.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(c)), ",").alias(name))


def job_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.floor("l_quantity").cast("bigint").alias("total_tokens"))
    jobs_ = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("tenant_id"), F.col("o_orderstatus").alias("status"))
    tenants = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tenant_id"), F.col("c_name").alias("tenant"))
    return admin.job_overview(admin.history_filter(jobs_, statuses=("F", "O")), calls, tenants)


QUERIES = {f.__name__: f for f in (extract_documents, process_documents, run_documents, job_overview, xy_cut, verify_tokens, llm_requests, discover_schemas, common_failures, json_repair, ocr_json, export_flat, batch_payload, log_sink, alert_states, alert_board, error_rate_alerts, alert_stream, alert_stream_board, alert_notices, deliveries, log_ids, stream_windows, stream_sessions, circuit_alerts)}

_REDACTED = f"regexp_replace(t, '{PERSONAL}', '[REDACTED]', 'g')"

_FOLD = """CASE WHEN starts_with(acc, 'resolved') THEN 'idle|' || split_part(acc, '|', 2) WHEN x = 't' AND starts_with(acc, 'firing') THEN acc
  WHEN x = 't' THEN 'firing|' || CAST(CAST(split_part(acc, '|', 2) AS BIGINT) + 1 AS VARCHAR) WHEN starts_with(acc, 'firing') THEN 'resolved|' || split_part(acc, '|', 2) ELSE 'idle|' || split_part(acc, '|', 2) END"""

_part = lambda k: f"split_part(acc, '|', {k})"
_more = lambda k: f"CAST(CAST({_part(k)} AS BIGINT) + 1 AS VARCHAR)"
_COUNTED = (
    f"CASE WHEN {_part(1)} = 'resolved' THEN 'idle|' || {_part(2)} || '|' || {_part(3)} || '|' || {_more(4)} "
    f"WHEN {_part(1)} = 'firing' AND x = 'f' THEN 'resolved|' || {_part(2)} || '|' || {_more(3)} || '|' || {_part(4)} "
    f"WHEN {_part(1)} = 'idle' AND x = 't' THEN 'firing|' || {_more(2)} || '|' || {_part(3)} || '|' || {_part(4)} ELSE acc END"
)

_MONEY = "CAST(CAST(floor(o_totalprice) AS BIGINT) * 10 + 5 AS VARCHAR)"
_ISO = "strftime(o_orderdate, '%Y-%m-%d')"

SQL = {
    "process_documents": f"""WITH b AS (SELECT o_orderkey AS k, * FROM orders WHERE o_orderkey % 4 = 0), c AS (SELECT o_orderkey AS k, * FROM orders WHERE o_orderkey % 4 = 1), s AS (SELECT o_orderkey AS k, * FROM orders WHERE o_orderkey % 4 = 2)
SELECT k AS doc_id, 'account_number' AS field, lpad(CAST(k AS VARCHAR), 10, '7') AS value, 'bank_statement' AS kind FROM b
UNION ALL SELECT k, 'statement_date', {_ISO}, 'bank_statement' FROM b UNION ALL SELECT k, 'opening_balance', CAST(k * 10 AS VARCHAR), 'bank_statement' FROM b
UNION ALL SELECT k, 'closing_balance', CASE WHEN k % 7 <> 0 THEN {_MONEY} ELSE 'ERR_EXTRACT_001' END, 'bank_statement' FROM b
UNION ALL SELECT k, 'portfolio_id', 'PORT-' || CAST(k AS VARCHAR), 'custody_statement' FROM c UNION ALL SELECT k, 'valuation_date', {_ISO}, 'custody_statement' FROM c UNION ALL SELECT k, 'total_value', {_MONEY}, 'custody_statement' FROM c
UNION ALL SELECT k, 'trade_date', {_ISO}, 'swift_confirm' FROM s UNION ALL SELECT k, 'isin', 'US0378331005', 'swift_confirm' FROM s UNION ALL SELECT k, 'quantity', CAST(k * 10 AS VARCHAR), 'swift_confirm' FROM s
UNION ALL SELECT k, 'counterparty_bic', 'DEUTDEFFXXX', 'swift_confirm' FROM s UNION ALL SELECT k, unnest(['settlement_date', 'price']), 'ERR_EXTRACT_001', 'swift_confirm' FROM s
UNION ALL SELECT o_orderkey, 'document_kind', 'ERR_EXTRACT_002', 'unknown' FROM orders WHERE o_orderkey % 4 = 3""",
    "run_documents": """WITH o AS (SELECT o_orderkey AS k, date_trunc('day', o_orderdate) AS d, o_orderkey % 4 AS t, o_orderkey % 4 = 0 AND o_orderkey % 7 = 0 AS late, o_orderkey % 14 = 0 AS told, floor(o_totalprice) + 0.5 AS money FROM orders),
x AS (SELECT *, d > TIMESTAMP '2000-06-30' OR d < TIMESTAMP '1990-06-30' AS off, t = 0 AND (NOT late OR told) AS closed, k % 13 <> 0 AS booked, t = 3 AND k % 8 = 3 AS notice FROM o)
SELECT k AS doc_id, CASE t WHEN 0 THEN 'bank_statement' WHEN 1 THEN 'custody_statement' WHEN 2 THEN 'swift_confirm' ELSE CASE WHEN notice THEN 'discovered:notice' ELSE 'unknown' END END AS kind,
  CASE WHEN t < 3 THEN 'complete' WHEN notice THEN 'partial' ELSE 'failed' END AS status,
  CASE t WHEN 0 THEN 3 + CAST(closed AS INTEGER) + CASE WHEN k % 12 = 0 THEN 3 ELSE 0 END WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE CASE WHEN notice THEN 2 ELSE 0 END END AS fields_extracted,
  CASE t WHEN 0 THEN CAST(NOT closed AS INTEGER) WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS fields_abstained, CASE WHEN late AND told THEN 1 WHEN notice THEN 2 ELSE 0 END AS vlm_used_count,
  nullif(array_to_string(list_sort(list_filter([
    CASE WHEN closed AND booked AND k % 3 = 1 OR closed AND NOT booked THEN 'arithmetic_totals:closing_balance' END, CASE WHEN t = 0 AND NOT booked THEN 'completeness:' || k END,
    CASE WHEN closed AND booked AND k % 3 = 1 THEN 'reconciliation:' || k END, CASE WHEN t = 0 AND booked AND k % 11 = 0 THEN 'running_balance:2' END, CASE WHEN t = 2 THEN 'iban:isin' END,
    CASE WHEN off AND t = 0 THEN 'date_range:statement_date' END, CASE WHEN off AND (t = 1 OR k % 12 = 0) THEN 'date_range:valuation_date' END, CASE WHEN off AND t = 2 THEN 'date_range:trade_date' END], lambda x: x IS NOT NULL)), ','), '') AS failures,
  CASE WHEN t = 0 AND NOT closed THEN 'ERR_VLM_004' WHEN t = 2 THEN 'ERR_VLM_003,ERR_VLM_003' WHEN notice THEN 'ERR_EXTRACT_001' WHEN t = 3 THEN 'ERR_DISCOVERY_001' END AS reasons,
  CASE t WHEN 0 THEN '0:1:1:bank_statement' || CASE WHEN k % 12 = 0 THEN ',1:2:2:custody_statement' ELSE '' END WHEN 1 THEN '0:1:1:custody_statement' WHEN 2 THEN '0:1:1:swift_confirm' ELSE '0:1:1:' || CASE WHEN notice THEN 'discovered:notice' ELSE 'unknown' END END AS sections,
  2 AS table_rows, CASE WHEN k % 5 <> 0 THEN 'compared' END AS verdict FROM x""",
    "job_overview": """WITH u AS (SELECT l_orderkey AS job_id, count(*) AS calls, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS tokens FROM lineitem GROUP BY 1)
SELECT o_orderkey AS job_id, o_custkey AS tenant_id, o_orderstatus AS status, coalesce(calls, 0) AS calls, coalesce(tokens, 0) AS tokens, c_name AS tenant FROM orders LEFT JOIN u ON u.job_id = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus IN ('F', 'O')""",
    "extract_documents": f"""WITH {_FOUND}, found AS (SELECT doc_id, field, value FROM best WHERE n = 1),
d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), nw AS (SELECT *, {_WORDS} AS nw FROM d), s AS (SELECT doc_id, {_penalised("kind_a")} AS a, {_penalised("kind_b")} AS b, {_penalised("kind_c")} AS c FROM nw),
r AS (SELECT *, greatest(a, b, c) AS top, list_reverse_sort([a, b, c])[2] AS second FROM s), g AS (SELECT doc_id, count(*) AS n, list(field) AS fs, max(value) FILTER (field = 'word') AS word FROM found GROUP BY 1),
j AS (SELECT r.doc_id, CASE WHEN top >= 0.1 AND NOT (second > 0 AND top < 1.2 * second) THEN {_BEST} ELSE 'unknown' END AS kind, coalesce(n, 0) AS n, coalesce(fs, []) AS fs, word FROM r LEFT JOIN g USING (doc_id))
SELECT doc_id, kind, CASE WHEN n = 0 THEN 'failed' WHEN n = 3 THEN 'complete' ELSE 'partial' END AS status, n AS fields_extracted, CASE WHEN n > 0 THEN 0.95 ELSE 0.0 END::DOUBLE AS mean_confidence, word,
  CASE WHEN n < 3 THEN array_to_string(list_filter(['code', 'mail', 'word'], lambda f: NOT list_contains(fs, f)), ',') END AS abstained FROM j""",
    "llm_requests": f"""WITH p AS (SELECT conv_id AS doc_id, string_agg('--- PAGE ' || CAST(turn + 1 AS VARCHAR) || ' ---' || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn) AS t FROM conversations GROUP BY 1),
r AS (SELECT doc_id, {_REDACTED} AS t FROM p)
SELECT doc_id, md5('[discover]' || chr(10) || CASE WHEN length(t) > 15000 THEN substr(t, 1, 8000) || chr(10) || chr(10) || '[... cut ...]' || chr(10) || chr(10) || right(t, 5000) ELSE t END) AS prompt_md5 FROM r""",
    "discover_schemas": f"""WITH p AS (SELECT conv_id AS doc_id, string_agg('--- PAGE ' || CAST(turn + 1 AS VARCHAR) || ' ---' || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn) AS t FROM conversations GROUP BY 1),
r AS (SELECT doc_id, {_REDACTED} AS t FROM p), n AS (SELECT 11 + CASE WHEN length(t) > 15000 THEN 13018 ELSE length(t) END AS n FROM r)
SELECT 'bank_' || CAST(n % 9 AS VARCHAR) || '::letter' AS fingerprint, count(*) AS documents, CAST(sum(1 + CAST(n % 2 = 0 AS INTEGER)) AS BIGINT) AS fields FROM n WHERE n % 5 <> 0 GROUP BY 1""",
    "xy_cut": f"""WITH {ITEMS} SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY floor(quantity / 10), part % 3, seq) - 1 AS reading_seq FROM items""",
    "verify_tokens": r"""WITH p AS (SELECT conv_id AS doc_id, turn + 1 AS page, regexp_split_to_array(coalesce(text, ''), '\s+') AS t FROM conversations),
v AS (SELECT *, CASE WHEN page % 3 = 0 THEN trim(concat_ws(' ', t[1], t[2])) WHEN page % 3 = 1 AND length(t[3]) >= 3 THEN t[3] || 'x' ELSE 'zzzzqqqq' END AS value FROM p)
SELECT doc_id, 'f' || CAST(page AS VARCHAR) AS field, value NOT IN ('', 'zzzzqqqq') AS verified, value = '' AS blank, value NOT IN ('', 'zzzzqqqq') AS placed FROM v""",
    "alert_stream": f"""WITH g AS (SELECT user_id AS rule_id, list(CASE WHEN value > 60 THEN 't' ELSE 'f' END ORDER BY ts, value > 60) AS xs FROM events GROUP BY 1),
f AS (SELECT rule_id, string_split(list_reduce(list_prepend('idle|0|0|0', xs), lambda acc, x: {_COUNTED}), '|') AS a FROM g)
SELECT rule_id, to_state, CAST(a[k] AS BIGINT) AS changes FROM f, (VALUES (2, 'firing'), (3, 'resolved'), (4, 'idle')) s(k, to_state) WHERE CAST(a[k] AS BIGINT) > 0""",
    "alert_notices": f"""WITH g AS (SELECT user_id AS rule_id, list(CASE WHEN value > 60 THEN 't' ELSE 'f' END ORDER BY ts, value > 60) AS xs FROM events GROUP BY 1),
f AS (SELECT rule_id, string_split(list_reduce(list_prepend('idle|0|0|0', xs), lambda acc, x: {_COUNTED}), '|') AS a FROM g)
SELECT rule_id, CAST(a[2] AS BIGINT) AS firings, CAST(a[2] AS BIGINT) - CAST(a[3] AS BIGINT) AS open, CAST(a[2] AS BIGINT) AS notices, CASE WHEN rule_id % 3 = 0 AND rule_id BETWEEN (SELECT min(c_custkey) FROM customer) AND (SELECT max(c_custkey) FROM customer) THEN CAST(a[2] AS BIGINT) ELSE 0 END AS delivered FROM f WHERE CAST(a[2] AS BIGINT) > 0""",
    "deliveries": f"""WITH {JOBS}, b AS (SELECT batch_id, min(tenant_id) AS tenant_id FROM jobs GROUP BY 1 HAVING bool_and(status IN ('complete', 'failed', 'partial')))
SELECT CAST(batch_id AS VARCHAR) AS payload_id, tenant_id, CASE tenant_id WHEN 't1' THEN 'no_callback_url' WHEN 't2' THEN 'not_configured' ELSE CASE WHEN batch_id % 7 = 0 THEN 'refused' ELSE 'delivered' END END AS outcome,
  CASE WHEN tenant_id <> 't0' THEN 0 WHEN batch_id % 7 = 0 THEN 3 ELSE 1 END AS attempts, tenant_id = 't0' AND batch_id % 7 = 0 AS kept FROM b""",
    "log_ids": """SELECT 100 + row_number() OVER (ORDER BY ts, event_type, event_id) AS id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, event_type AS severity, lpad(CAST(event_id AS VARCHAR), 12, '0') AS trace_id FROM events""",
    "common_failures": """WITH g AS (SELECT 'k' || CAST(user_id % 40 AS VARCHAR) AS schema_key, 'f' || CAST(event_id % 11 AS VARCHAR) AS field_name, count(*) AS failures FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY schema_key ORDER BY failures DESC, field_name) AS rank FROM g) SELECT * FROM r WHERE rank <= 5""",
    "json_repair": "SELECT o_orderkey, o_orderkey AS b FROM orders",
    "ocr_json": "SELECT o_orderkey AS page_key, 1 + CAST(o_orderkey % 2 <> 0 AS BIGINT) + CAST(o_orderkey % 3 <> 0 AS BIGINT) AS tokens, round(0.9 + CASE WHEN o_orderkey % 2 <> 0 THEN 0.5 ELSE 0 END + CASE WHEN o_orderkey % 3 <> 0 THEN 0.25 ELSE 0 END, 4)::DOUBLE AS confidence, 4.0::DOUBLE AS y1 FROM orders",
    "export_flat": f"""WITH {TRANSACTIONS} SELECT CAST(acct_id AS VARCHAR) AS account_number, '"E""R","' || date || '","' || coalesce(CAST(debit AS VARCHAR), '') || '","' || coalesce(CAST(credit AS VARCHAR), '') || '","' || CAST(coalesce(credit, -debit) AS VARCHAR) || '"' AS line FROM transactions""",
    "batch_payload": f"WITH {JOBS} SELECT batch_id, count(*) AS jobs_total, count(*) FILTER (status = 'failed') AS jobs_failed, count(*) AS results FROM jobs GROUP BY 1 HAVING bool_and(status IN ('complete', 'failed', 'partial'))",
    "log_sink": """SELECT event_type AS severity, 'tr' || CAST(user_id AS VARCHAR) AS trace_id, '{"extra":"' || CAST(event_id % 5 AS VARCHAR) || '"}' AS fields, count(*) AS entries FROM events GROUP BY 1, 2, 3""",
    "alert_states": f"""WITH g AS (SELECT user_id AS rule_id, count(*) AS evaluations, list(CASE WHEN value > 60 THEN 't' ELSE 'f' END ORDER BY ts, value > 60) AS xs FROM events GROUP BY 1),
f AS (SELECT rule_id, evaluations, list_reduce(list_prepend('idle|0', xs), lambda acc, x: {_FOLD}) AS a FROM g) SELECT rule_id, split_part(a, '|', 1) AS state, CAST(split_part(a, '|', 2) AS BIGINT) AS notifications, evaluations FROM f""",
    "alert_board": f"""WITH g AS (SELECT user_id AS rule_id, max(ts) AS last, list(CASE WHEN value > 60 THEN 't' ELSE 'f' END ORDER BY ts, value > 60) AS xs FROM events GROUP BY 1),
f AS (SELECT rule_id, last, list_reduce(list_prepend('idle|0', xs), lambda acc, x: {_FOLD}) AS a FROM g)
SELECT c_custkey AS rule_id, coalesce(split_part(a, '|', 1), 'idle') AS state, coalesce(CAST(split_part(a, '|', 2) AS BIGINT), 0) AS notifications, strftime(last, '%Y-%m-%d %H:%M:%S') AS last_evaluated_at FROM customer LEFT JOIN f ON rule_id = c_custkey AND c_custkey % 4 <> 0""",
    "error_rate_alerts": f"""WITH {JOBS}, r AS (SELECT c_custkey AS rule_id, CASE WHEN c_custkey % 4 <> 3 THEN 't' || CAST(c_custkey % 4 AS VARCHAR) END AS tenant_id, c_custkey % 40 AS threshold, [60, 1440, 10080][c_custkey % 3 + 1] AS m FROM customer),
s AS (SELECT rule_id, threshold, count(status) FILTER (status = 'failed') AS failed, count(status) AS total FROM r LEFT JOIN jobs ON (r.tenant_id IS NULL OR r.tenant_id = jobs.tenant_id) AND created_at <= TIMESTAMP '2024-01-20' AND created_at >= TIMESTAMP '2024-01-20' - to_minutes(m) GROUP BY 1, 2)
SELECT rule_id, failed, total, round(CASE WHEN total > 0 THEN failed * 100.0 / total ELSE 0.0 END, 4)::DOUBLE AS error_rate, CASE WHEN total > 0 THEN failed * 100.0 / total ELSE 0.0 END > threshold AS breached FROM s""",
    "stream_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS events, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS value FROM events GROUP BY 1, 2",
    "stream_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e), g AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events, max(n) AS longest FROM g GROUP BY 1""",
    "circuit_alerts": """WITH e AS (SELECT event_type AS service_name, 't' || CAST(user_id % 3 AS VARCHAR) AS tenant_id, event_id % 3 AS p, (event_id // 3) % 3 AS n FROM events),
r AS (SELECT s_suppkey AS rule_id, ['click', 'view', 'error'][s_suppkey % 3 + 1] AS service_name, CASE WHEN s_suppkey % 2 = 0 THEN 't' || CAST(s_suppkey % 5 AS VARCHAR) END AS tenant_id FROM supplier WHERE s_suppkey % 4 <> 0)
SELECT rule_id, CASE WHEN p = 0 THEN 'firing' ELSE 'resolved' END AS to_state, count(*) AS changes FROM e JOIN r ON e.service_name = r.service_name AND (r.tenant_id IS NULL OR r.tenant_id = e.tenant_id) WHERE (p = 0 AND n = 1) OR (p = 1 AND n = 0) GROUP BY 1, 2""",
}

SQL["alert_stream_board"] = SQL["alert_board"]
