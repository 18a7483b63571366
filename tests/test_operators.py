"""Operators on worked cases: order, ties, nulls, empty tables."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import fixed
from docloom.operators import discovery, documents, ingest, layout, record, tables, validators, verify, windows
from docloom.sources import files, sinks
from docloom.streaming import alerts
from docloom.streaming.windows import run_once


def lines(spark, *texts):
    return spark.createDataFrame([("d", 1, k, t) for k, t in enumerate(texts)], "doc_id string, page int, seq int, text string")


def test_bank_fields(spark):
    got = documents.find_fields(lines(spark, "IBAN: GB29NWBK60161331926819", "Statement Date: 15/01/2024", "Closing Balance: £1,500.00", None), fixed.PATTERNS["bank_statement"])
    assert {r.field: r.value for r in got.collect()} == {"account_number": "GB29NWBK60161331926819", "statement_date": "2024-01-15", "closing_balance": "1500.0"}


def test_custody_and_swift_fields(spark):
    got = documents.find_fields(lines(spark, "Portfolio ID: PORT-12345", "Valuation Date: 31/12/2023"), fixed.PATTERNS["custody_statement"])
    assert {r.field: r.value for r in got.collect()} == {"portfolio_id": "PORT-12345", "valuation_date": "2023-12-31"}
    got = documents.find_fields(lines(spark, ":98A::TRAD//20240115", "Counterparty BIC: DEUTDEFFXXX"), fixed.PATTERNS["swift_confirm"])
    found = {r.field: r.value for r in got.collect()}
    assert found["trade_date"] == "2024-01-15" and found["counterparty_bic"] == "DEUTDEFFXXX"


def test_earlier_pattern_beats_earlier_line(spark):
    got = documents.find_fields(lines(spark, "b2", "a1"), {"f": (r"a(\d)", r"b(\d)")}, normalisers={}).first()
    assert (got.value, got.seq) == ("1", 1)


def test_kinds(spark):
    d = spark.createDataFrame([(1, "Statement of account balance debit credit transaction iban"), (2, "portfolio custody valuation holdings isin securities"), (3, "{1: {4: :20: swift settlement bic counterparty"), (4, "a letter to a friend"), (5, None)], "doc_id int, text string")
    assert {r.doc_id: r.kind for r in documents.detect_kind(d).collect()} == {1: "bank_statement", 2: "custody_statement", 3: "swift_confirm", 4: "unknown", 5: "unknown"}


def test_sections(spark):
    p = spark.createDataFrame([(1, 1, "aa aa"), (1, 2, "bb"), (1, 3, ""), (1, 4, "bb"), (2, 1, "x")], "doc_id int, page int, text string")
    got = documents.sections(documents.page_profiles(p, {"a": ["aa"], "b": ["bb"]}), ["a", "b"])
    assert sorted((r.doc_id, r.start_page, r.end_page, r.kind) for r in got.collect()) == [(1, 1, 1, "a"), (1, 2, 4, "b"), (2, 1, 1, "unknown")]


def test_lines(spark):
    b = spark.createDataFrame([(1, 1, k, t, float(k), y, k + 1.0, y + 8) for k, (t, y) in enumerate([("a", 10.0), ("b", 14.0), ("c", 30.0)])], "doc_id int, page int, seq int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [r.text for r in documents.group_lines(b).orderBy("line").collect()] == ["a b", "c"]
    assert [r.text for r in documents.group_lines(b, separator="").orderBy("line").collect()] == ["ab", "c"]


def test_triangulation(spark):
    cell = "table_key int, r int, c int, v string"
    a = spark.createDataFrame([(1, r, c, "x") for r in range(5) for c in range(3)] + [(2, 0, 0, "x")], cell)
    b = spark.createDataFrame([(1, r, c, "y" if (r, c) in ((0, 0), (1, 1), (2, 2)) else " X ") for r in range(5) for c in range(3)] + [(2, 0, 0, "x"), (2, 1, 0, "x")], cell)
    got = {r.table_key: (r.score, r.verdict) for r in tables.triangulate(a, b).collect()}
    assert got == {1: (0.2, "soft_flag"), 2: (1.0, "hard_flag")}
    assert tables.triangulate(a.limit(0), b.limit(0)).count() == 0


def test_stitching(spark):
    t = spark.createDataFrame([(1, 1, 1, ["A"], [["1"]]), (1, 2, 2, ["A"], [["2"]]), (1, 5, 3, ["A"], [["3"]]), (1, 6, 4, [], [["4"]]), (1, 7, 5, [], [["5"]])], "doc_id int, page int, table_seq int, headers array<string>, rows array<array<string>>")
    near = {r.table_seq: (r.pages, len(r.rows)) for r in tables.stitch_tables(t).collect()}
    assert near == {1: ([1, 2], 2), 3: ([5], 1), 4: ([6], 1), 5: ([7], 1)}
    assert {r.table_seq: len(r.rows) for r in tables.stitch_tables(t, adjacent_pages=False).collect()} == {1: 3, 4: 1, 5: 1}


def test_rails_pair_by_position(spark):
    s = "doc_id int, page int, table_seq int"
    got = tables.pair_rails(spark.createDataFrame([(1, 1, 1), (1, 1, 4)], s), spark.createDataFrame([(1, 1, 9)], s))
    assert {r.table_seq: r.b_table_seq for r in got.collect()} == {1: 9, 4: None}


def test_fifty_pages_make_six_windows(spark):
    got = windows.sliding_windows(spark.createDataFrame([(1, 50), (2, 0), (3, 12)], "doc_id int, n_pages int"))
    assert sorted((r.doc_id, r.start_page, r.end_page) for r in got.collect()) == [(1, 1, 12), (1, 10, 21), (1, 19, 30), (1, 28, 39), (1, 37, 48), (1, 46, 50), (3, 1, 12)]


def test_transactions_of_two_windows(spark):
    t = spark.createDataFrame([("d", 0, 1, "x", "a", 5.0, None), ("d", 0, 2, "x", "b", 6.0, None), ("d", 1, 1, "x", "b", 6.0, None), ("d", 1, 2, "x", "c", 0.0, None), ("d", 1, 3, "x", "c", 0.0, None)], "doc_id string, window_idx int, txn_seq int, date string, description string, debit double, credit double")
    assert windows.dedup_transactions(t).count() == 4


def test_budget(spark):
    c = spark.createDataFrame([("j", 1, 60), ("j", 2, 50), ("j", 3, 1)], "job_id string, call_idx int, tokens int")
    assert [(r.allowed, r.exceeded) for r in windows.token_budget(c, 100).orderBy("call_idx").collect()] == [(True, False), (True, True), (False, True)]


def test_target_pages(spark):
    m = spark.createDataFrame([(1, 10, "institution"), (2, 10, "closing_balance"), (3, 1, "iban"), (4, 9, "iban"), (4, 9, "closing_balance")], "doc_id int, n_pages int, field string")
    assert {r.doc_id: r.pages for r in windows.target_pages(m).collect()} == {1: [1, 2], 2: [9, 10], 3: [1], 4: [1, 2, 8, 9]}


def test_running_balance_skips_nulls(spark):
    t = spark.createDataFrame([(1, 1, None, 10.0, 10.0), (1, 2, None, 5.0, None), (1, 3, None, 5.0, 20.0), (1, 4, 1.0, None, 14.0)], "acct_id int, txn_seq int, debit double, credit double, balance double")
    assert [r.field for r in validators.running_balance(t).orderBy("field").collect()] == ["3", "4"]


def test_provenance_counts_every_fault(spark):
    f = spark.createDataFrame([("d", "f", 0, 3, [1.0], "guess"), ("d", "g", 4, 3, [-1.0, 0.0, 0.0, 0.0], "ocr"), ("d", "h", 1, 0, [0.0] * 4, "vlm")], "doc_id string, field string, page int, total_pages int, bbox array<double>, source string")
    assert sorted(r.field for r in validators.provenance(f).collect()) == ["f.bbox_length", "f.page_low", "f.source", "g.bbox_negative", "g.page_high"]


def test_status(spark):
    d = spark.createDataFrame([(k,) for k in (1, 2, 3)], "doc_id int")
    f = spark.createDataFrame([(1, "a", 0.5, False, False)] + [(2, x, 1.0, True, False) for x in "abc"], "doc_id int, field string, confidence double, vlm_used boolean, has_data boolean")
    a = spark.createDataFrame([(1, "b"), (2, "x"), (2, None)], "doc_id int, field string")
    assert {r.doc_id: (r.status, r.fields_abstained) for r in record.confidence_summary(d, f, a).collect()} == {1: ("partial", 1), 2: ("complete", 1), 3: ("failed", 0)}


def test_differences_keep_repeats(spark):
    s = "k string, n int"
    a, b = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], s), spark.createDataFrame([("y", 4), ("z", 5)], s)
    assert sorted((r.change, r.k) for r in record.transaction_diff(a, b, ["k"]).collect()) == [("added", "z"), ("removed", "x"), ("removed", "x")]


def test_verify(spark):
    w = spark.createDataFrame([(1, k, t) for k, t in enumerate(["Name:", "John", "Smith", "helo", "far", "and", "wide", "open", "sea", "air"])], "doc_id int, seq int, text string")
    v = spark.createDataFrame([(1, "a", "john smith"), (1, "b", "hello"), (1, "c", "nowhere else"), (1, "d", " "), (1, "e", "far and wide open sea air"), (2, "f", "John")], "doc_id int, field string, value string")
    got = {r.field: (r.verified, r.how) for r in verify.verify_values(v, w).collect()}
    assert got == {"a": (True, "run"), "b": (True, "word"), "c": (False, "unverifiable"), "d": (False, "no_value"), "e": (True, "run"), "f": (False, "unverifiable")}
    assert not verify.verify_values(v.filter("field = 'b'"), w, 0.99).first().verified


def test_reading_order():
    x0, y0 = np.array([0.0, 100.0, 0.0, 100.0, 0.0]), np.array([0.0, 1.0, 10.0, 11.0, 40.0])
    assert layout.reading_order(x0, y0, x0 + 30, y0 + 9) == [0, 2, 1, 3, 4]


def test_ingestion(spark):
    f = spark.createDataFrame([(1, "t", 1, b"%PDFa"), (2, "t", 2, b"%PDFa"), (3, "u", 3, b"%PDFa"), (4, "t", 4, b"PK"), (5, "t", 5, b"%PDF" + b"x" * 50), (6, "t", 6, None)], "file_id int, tenant_id string, arrived int, content binary")
    got = {r.file_id: (r.status, r.error_code) for r in ingest.outcomes(f, max_bytes=20).collect()}
    assert got == {1: ("accepted", None), 2: ("duplicate", "ERR_INGESTION_003"), 3: ("accepted", None), 4: ("rejected", "ERR_INGESTION_001"), 5: ("rejected", "ERR_INGESTION_002"), 6: ("rejected", "ERR_INGESTION_001")}


def test_files_to_fields(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDFStatement Date: 15/01/2024\nClosing Balance: 12.50")
    (tmp_path / "b.pdf").write_bytes(b"%PDF\xff")
    tokens = files.read_pages(files.binary_files(spark, str(tmp_path)), files.text_adapter)
    bad = tokens.filter("page is null").count()
    blocks = tokens.filter("page is not null").withColumnRenamed("file_id", "doc_id")
    found = documents.find_fields(documents.group_lines(blocks), fixed.PATTERNS["bank_statement"], ["page", "line"])
    assert bad == 1 and {r.field: r.value for r in found.collect()} == {"statement_date": "2024-01-15", "closing_balance": "12.5"}


def test_delivery_retries(spark):
    p = spark.createDataFrame([("good",), ("bad",)], "payload string")
    got = {r.payload: (r.delivered, r.attempts) for r in sinks.deliver(p, lambda x: x == "good", pause=lambda n: 0.0).collect()}
    assert got == {"good": (True, 1), "bad": (False, 3)}


def test_csv(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([("a\"b", None)], "x string, y string").coalesce(1), f"{tmp_path}/out")
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert text == '"x","y"\n"a""b",""\n'


def test_discovery(spark):
    pages = spark.createDataFrame([(1, 1, "mail a@b.cd"), (2, 1, "mail a@b.cd")], "doc_id int, page int, text string")
    asked = discovery.requests(pages, "discover")
    assert all("a@b.cd" not in r.prompt for r in asked.collect())
    answered = discovery.answer(asked, lambda p: '```json\n{"institution": "My Bank", "document_type_label": "loan", "fields": [{"field_name": "sum"}, {"field_name": " "}]}\n```')
    schemas = discovery.discovered_schemas(answered)
    assert {(r.fingerprint, len(r.fields)) for r in schemas.collect()} == {("my_bank::loan", 1)}
    values = discovery.extracted_values(schemas, answered.withColumn("reply", F.lit('{"sum": {"value": "5", "confidence": 1.0}}')))
    assert {(r.doc_id, r.value, r.confidence) for r in values.collect()} == {(1, "5", 0.95), (2, "5", 0.95)}


@pytest.mark.parametrize("flags,states", [([1, 1, 0, 1, 1], ["firing", "resolved", "idle", "firing"]), ([0, 0], [])])
def test_alert_stream_equals_the_fold(spark, tmp_path, flags, states):
    rows = [(1, datetime(2024, 1, 1, 0, k), bool(f)) for k, f in enumerate(flags)]
    e = spark.createDataFrame(rows, "rule_id bigint, at timestamp, breached boolean")
    stream = alerts.AlertStream(f"{tmp_path}/stream")
    for k in (0, 1, 0):
        stream(e.filter(F.minute("at") < 2 if k == 0 else F.minute("at") >= 2), k)
    assert [r.to_state for r in stream.changes(spark).orderBy("at").collect()] == states
    assert [(r.state, r.notifications) for r in stream.board(spark).collect()] == [(states[-1] if states else "idle", states.count("firing"))]
    got = alerts.alert_summary(e).first()
    assert got.state == (states[-1] if states else "idle") and got.notifications == states.count("firing")


def test_update_mode_keeps_keys_of_earlier_batches(spark, tmp_path):
    from docloom.streaming.windows import progress_counts

    schema = "job_id string, kind string, total int"
    for rows in ([("a", "page", 3), ("b", "page", 2)], [("b", "page", 2)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/p")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/p")
    out = run_once(progress_counts(stream), "update", ["job_id", "kind"])
    assert sorted(tuple(r) for r in out.collect()) == [("a", "page", 1, 3), ("b", "page", 2, 2)]


def test_busy_keys_are_not_gathered_in_one_row(spark):
    from docloom.operators import model_io

    n = 20_000
    e = spark.range(n).selectExpr("1L AS rule_id", "timestamp_seconds(id) AS at", "hash(id) % 5 > 1 AS breached")
    with_plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    state, sent = "idle", 0
    for r in e.orderBy("at").collect():
        new = "idle" if state == "resolved" else "firing" if r.breached else "resolved" if state == "firing" else "idle"
        sent += new == "firing" != state
        state = new
    got = alerts.alert_summary(e)
    assert "rangepartitioning" in with_plan(got)
    assert [tuple(r) for r in got.collect()] == [(1, state, sent, n)]
    calls = e.selectExpr("'s' AS service", "CAST(unix_seconds(at) AS DOUBLE) AS at", "NOT breached AS ok")
    states = model_io.breaker_states(calls, 2, 7.0)
    assert "collect_list" not in with_plan(states)
    now, failed, last, want = "closed", 0, 0.0, []
    for r in calls.orderBy("at").collect():
        allowed = now != "open" or r.at - last >= 7
        if allowed:
            failed = 0 if r.ok else failed + 1
            now, last = ("closed", last) if r.ok else ("open" if failed >= 2 else now, r.at)
        want.append((r.at, now, allowed))
    assert sorted((r.at, r.state, r.allowed) for r in states.collect()) == want


def test_upsert(spark):
    s = "k string, at int, v string"
    old, new = spark.createDataFrame([("a", 1, "old"), ("b", 5, "old")], s), spark.createDataFrame([("a", 1, "new"), ("b", 4, "new"), ("c", 1, None)], s)
    got = ingest.upsert(old, new, ["k"], "at")
    assert got.columns == ["k", "at", "v"] and {r.k: r.v for r in got.collect()} == {"a": "new", "b": "old", "c": None}


def test_breaker_and_history(spark):
    from docloom.operators import model_io

    calls = spark.createDataFrame([("s", float(t), ok) for t, ok in [(0, False), (1, False), (2, False), (10, True), (33, False), (40, True), (70, True)]], "service string, at double, ok boolean")
    got = [(r.state, r.allowed) for r in model_io.breaker_states(calls).orderBy("at").collect()]
    assert got == [("closed", True), ("closed", True), ("open", True), ("open", False), ("open", True), ("open", False), ("closed", True)]
    at = lambda h: datetime(2024, 1, 1, h)
    history = spark.createDataFrame([(1, at(1), None), (2, at(1), at(2))], "rule_id int, fired_at timestamp, resolved_at timestamp")
    changes = spark.createDataFrame([(1, at(3), "resolved"), (1, at(4), "firing"), (2, at(5), "firing"), (2, at(6), "resolved")], "rule_id int, at timestamp, to_state string")
    rows = sorted((r.rule_id, r.fired_at.hour, r.resolved_at and r.resolved_at.hour) for r in model_io.history_after(history, changes).collect())
    assert rows == [(1, 1, 3), (1, 4, None), (2, 1, 2), (2, 5, 6)]


def test_tenants_keys_and_rules(spark):
    from docloom.operators import admin

    t = spark.createDataFrame([("t1", False, "k1"), ("t2", True, "k2")], "tenant_id string, suspended boolean, k string").select("tenant_id", "suspended", F.sha2("k", 256).alias("key_hash"))
    got = admin.api_key_outcome(spark.createDataFrame([("k1",), ("k2",), ("k3",)], "api_key string"), t)
    assert {r.api_key: r.error_code for r in got.collect()} == {"k1": None, "k2": "ERR_AUTH_002", "k3": "ERR_AUTH_001"}
    rules = spark.createDataFrame(
        [("budget_threshold", 0, "daily", None, None, None, "email", "a@b.c"), ("error_rate", None, None, 101.0, 5, None, "webhook", "http://x"), ("circuit_breaker", None, None, None, None, "ocr", "webhook", "ftp://x"), ("other", None, None, None, None, None, "email", "nobody")],
        "rule_type string, threshold_tokens int, billing_period string, threshold_percent double, evaluation_window_minutes int, service_name string, channel string, target string",
    )
    assert [(r.errors.count(";") + bool(r.errors), r.target_ok) for r in admin.rule_errors(rules).collect()] == [(2, True), (1, True), (0, False), (1, False)]


def test_whole_flow(spark):
    from docloom.operators import flow

    texts = {"b": ["Account Statement", "IBAN: GB29NWBK60161331926819", "Closing Balance: £1,500.00", "Statement Date: 15/01/2034"], "c": ["Portfolio holdings and valuation", "Portfolio ID: PORT-12345", "Total Value: EUR 1,234"], "x": ["A letter"]}
    rows = [(d, 1, k, float(k) * 20, t) for d, ts in texts.items() for k, t in enumerate(ts)]
    blocks = spark.createDataFrame([(d, p, k, t, 10.0, y, 200.0, y + 12) for d, p, k, y, t in rows], "doc_id string, page int, seq int, text string, x0 double, y0 double, x1 double, y1 double")
    page_tables = spark.createDataFrame([("b", 1, 1, ["Date", "Description", "Debit", "Credit", "Balance"], [["1"]]), ("b", 2, 2, ["Date", "Description", "Debit", "Credit", "Balance"], [["2"]])], "doc_id string, page int, table_seq int, headers array<string>, rows array<array<string>>")
    lines, stitched = flow.assemble(blocks, page_tables)
    run = flow.process(lines, stitched, "2030-01-01")
    assert {r.doc_id: r.kind for r in run.kinds.collect()} == {"b": "bank_statement", "c": "custody_statement", "x": "unknown"}
    assert {(r.doc_id, r.field): r.value for r in run.fields.collect()} == {("b", "account_number"): "GB29NWBK60161331926819", ("b", "closing_balance"): "1500.0", ("b", "statement_date"): "2034-01-15", ("c", "portfolio_id"): "PORT-12345"}
    assert {(r.doc_id, r.field) for r in run.abstentions.collect()} == {("b", "opening_balance"), ("c", "valuation_date"), ("c", "total_value"), ("x", "document_kind")}
    assert {r.doc_id: r.status for r in run.summary.collect()} == {"b": "complete", "c": "partial", "x": "failed"}
    assert [(r.doc_id, r.validator) for r in run.failures.collect()] == [("b", "date_range")]
    assert [(r.doc_id, len(r.rows)) for r in run.tables.collect()] == [("b", 2)]


def test_no_read_without_a_tenant(spark):
    import io
    from contextlib import redirect_stdout

    from docloom.operators import admin

    usage = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").withColumnRenamed("c_mktsegment", "tenant_id")
    for nobody in (None, "", 7):
        with pytest.raises(ValueError, match="needs the tenant"):
            admin.for_tenant(usage, nobody)
    plan = io.StringIO()
    with redirect_stdout(plan):
        admin.for_tenant(usage, "BUILDING").groupBy("c_nationkey").count().explain("formatted")
    assert "PushedFilters: [IsNotNull(tenant_id), EqualTo(tenant_id,BUILDING)]" in plan.getvalue() or "EqualTo(c_mktsegment,BUILDING)" in plan.getvalue()


def test_suggestions_keep_the_first_of_equals_and_the_last_fifty(spark):
    from docloom.operators import admin

    rows = [("a", "x" * 50 + str(k), "high", k) for k in range(3)] + [("b", f"text {k:03d}", "low", 10 + k) for k in range(60)] + [("b", "text 001", "high", 99)]
    got = admin.suggestions(spark.createDataFrame(rows, "category string, description string, priority string, seq int")).collect()
    assert len(got) == 50 and {r.seq for r in got} == set(range(20, 70))


def test_history_closes_the_row_before(spark):
    from docloom.operators import model_io

    h = spark.createDataFrame([(1, 10, None), (1, 20, None), (2, 5, 6)], "rule_id int, f int, r int").select("rule_id", F.timestamp_seconds("f").alias("fired_at"), F.timestamp_seconds("r").alias("resolved_at"))
    c = spark.createDataFrame([(1, 15, "resolved"), (1, 17, "resolved"), (1, 30, "firing"), (1, 30, "resolved"), (2, 1, "resolved"), (3, 1, "resolved")], "rule_id int, a int, to_state string").select("rule_id", F.timestamp_seconds("a").alias("at"), "to_state")
    got = {(r.rule_id, r.f): r.r for r in model_io.history_after(h, c).select("rule_id", F.unix_seconds("fired_at").alias("f"), F.unix_seconds("resolved_at").alias("r")).collect()}
    assert got == {(1, 10): 15, (1, 20): None, (1, 30): 30, (2, 5): 6}


def test_values_meet_like_words_before_equal_ones(spark):
    words = spark.createDataFrame([(1, k, t) for k, t in enumerate("helo hello there general kenobi general grievous".split())], "doc_id int, seq int, text string")
    values = spark.createDataFrame([(1, "a", "hello"), (1, "b", "General Kenobi"), (1, "c", "grievous general"), (1, "d", "grievouss"), (2, "e", "hello")], "doc_id int, field string, value string")
    got = {r.field: (r.how, r.seq) for r in verify.verify_values(values, words).collect()}
    assert got == {"a": ("word", 0), "b": ("run", 3), "c": ("unverifiable", None), "d": ("word", 6), "e": ("unverifiable", None)}
