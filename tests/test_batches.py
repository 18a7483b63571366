"""Micro-batch functions that are repeated or die midway, keyed tables, numbers in order, the model fallback's plan."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docloom.operators import discovery, fallback
from docloom.shared import numbered
from docloom.sources.keyed import KeyedTable
from docloom.sources.sinks import log_entries, standalone_payload, write_json
from docloom.streaming.alerts import AlertStream
from docloom.streaming.delivery import AlertHistory, DeliverySink


def test_keyed_table(spark, tmp_path):
    t = KeyedTable(f"{tmp_path}/t", "k int, v string", ["k"])
    assert t.read(spark).count() == 0 and t.versions(spark) == []
    made = lambda *rows: spark.createDataFrame(rows, "k int, v string")
    assert t.merge(made((1, "a"), (2, "b"))) and t.merge(made((2, "c"), (3, "d")))
    assert sorted(map(tuple, t.read(spark).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert not t.merge(made((1, "late")), version=1) and t.merge(made((1, "new")), version=5)
    assert sorted(map(tuple, t.read(spark).collect())) == [(1, "new"), (2, "c"), (3, "d")]
    os.makedirs(f"{tmp_path}/t/v=9")  # a run that died while it wrote
    assert t.versions(spark)[-1] == 5 and t.replace(made((7, "z")), version=9)
    assert [tuple(r) for r in t.read(spark).collect()] == [(7, "z")]


def test_numbers_have_no_gaps(spark):
    d = spark.range(3000).select((F.col("id") % 7).alias("a"), F.xxhash64("id").alias("b")).repartition(9)
    d = d.unionByName(d.limit(5))
    n = numbered(d, [F.col("a"), F.col("b")]).collect()
    assert sorted(r.number for r in n) == list(range(3005))
    rows = [(r.a, r.b) for r in sorted(n, key=lambda r: r.number)]
    assert rows == sorted(rows)
    assert numbered(d.limit(0), [F.col("a")]).count() == 0
    same = numbered(spark.range(1000).select(F.lit(1).alias("a")).repartition(6), [F.col("a")])
    assert sorted(r.number for r in same.collect()) == list(range(1000))


def test_log_ids_follow_time(spark):
    e = spark.createDataFrame([({"timestamp": f"2024-01-01 00:00:{k % 60:02d}", "event": "x", "n": str(k)},) for k in range(120)], "event map<string,string>").repartition(5)
    rows = log_entries(e, start=11).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(11, 131)) and [r.timestamp for r in rows] == sorted(r.timestamp for r in rows)
    assert rows[0].fields == '{"n":"0"}'


def _counting(folder, fail_at=None):
    """A receiver that notes each payload in a file of its own, and breaks down at one until told otherwise."""

    def send(key, url, payload):
        if key == fail_at and not os.path.exists(f"{folder}/mended"):
            raise RuntimeError("receiver is down")
        with open(f"{folder}/got-{key}", "a") as f:
            f.write("x")
        return key != "k3"

    return send


def test_delivery_of_a_batch_that_dies_midway(spark, tmp_path):
    got = tmp_path / "got"
    got.mkdir()
    targets = spark.createDataFrame([("a", True, "u"), ("b", True, ""), ("c", False, "u")], "tenant_id string, enabled boolean, callback_url string")
    rows = [(f"k{k}", "a", f"body {k}") for k in range(40)] + [("k1", "a", "body 1"), ("x", "b", "y"), ("y", "c", "y"), ("z", None, None)]
    batch = spark.createDataFrame(rows, "payload_id string, tenant_id string, payload string")
    sink = DeliverySink(f"{tmp_path}/sent", _counting(str(got), "k17"), targets, attempts=2, pause=lambda n: 0.0, wave=8)
    with pytest.raises(Exception):
        sink(batch, 0)
    before = {r.payload_id for r in sink.outcomes(spark).collect()}
    assert 0 < len(before) < 43
    (got / "mended").touch()
    for k in (0, 0, 1):
        sink(batch, k)
    out = {r.payload_id: r for r in sink.outcomes(spark).collect()}
    assert len(out) == 43 and sink.outcomes(spark).count() == 43
    assert {out[k].outcome for k in ("x", "y", "z")} == {"no_callback_url", "not_configured"} and out["x"].attempts == 0
    assert (out["k3"].outcome, out["k3"].attempts, out["k3"].payload) == ("refused", 2, "body 3") and out["k4"].payload is None
    assert [r.payload_id for r in sink.dead_letters(spark).collect()] == ["k3"]
    for k in before - {"x", "y", "z", "k3"}:
        assert (got / f"got-{k}").read_text() == "x"  # what finished waves had sent was not sent again


def test_alert_history_over_repeated_batches(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    made = lambda *rows: spark.createDataFrame(rows, "rule_id bigint, at timestamp, to_state string")
    targets = spark.createDataFrame([("t", True, "u")], "tenant_id string, enabled boolean, callback_url string")
    sink = DeliverySink(f"{tmp_path}/sent", lambda key, url, body: True, targets)
    tenants = spark.createDataFrame([(1, "t")], "rule_id bigint, tenant_id string")
    h = AlertHistory(f"{tmp_path}/h", sink, tenants)
    first, second = made((1, at(0), "firing"), (2, at(1), "firing"), (1, at(2), "resolved"), (1, at(3), "idle"), (1, at(4), "firing")), made((1, at(5), "resolved"), (3, at(6), "resolved"))
    for batch, k in ((first, 0), (first, 0), (second, 1), (second, 1), (first, 0)):
        h(batch, k)
    assert sorted((r.rule_id, r.fired_at.minute, r.resolved_at and r.resolved_at.minute) for r in h.read(spark).collect()) == [(1, 0, 2), (1, 4, 5), (2, 1, None)]
    assert sorted((r.payload_id[:1], r.outcome) for r in sink.outcomes(spark).collect()) == [("1", "delivered"), ("1", "delivered"), ("2", "not_configured")]


def test_busy_rule_in_many_stretches(spark, tmp_path):
    """One rule has nearly all rows of a batch; changes and board are those of a plain fold, whatever the stretches."""
    rows = [(1, datetime.fromtimestamp(1_700_000_000 + k), (k * 7919) % 13 < 6) for k in range(1200)] + [(2, datetime.fromtimestamp(1_700_000_000), True), (5, datetime.fromtimestamp(1_700_000_000), True)]
    e = spark.createDataFrame(rows, "rule_id bigint, at timestamp, breached boolean").repartition(7)
    rules = spark.createDataFrame([(1, True), (2, True), (5, False), (9, True)], "rule_id bigint, enabled boolean")
    s = AlertStream(f"{tmp_path}/s", lambda _: rules)
    cut = datetime.fromtimestamp(1_700_000_500)
    s(e.filter(F.col("at") < cut), 0)
    s(e.filter(F.col("at") >= cut), 1)
    now, sent, changes = "idle", 0, 0
    for _, _, breached in rows[:1200]:
        new = "idle" if now == "resolved" else "firing" if breached else "resolved" if now == "firing" else "idle"
        sent += new == "firing" != now
        changes += new != now
        now = new
    board = {r.rule_id: (r.state, r.notifications) for r in s.board(spark).collect()}
    assert board == {1: (now, sent), 2: ("firing", 1), 5: ("idle", 0), 9: ("idle", 0)}
    assert s.changes(spark).filter("rule_id = 1").count() == changes


def _pages(spark, texts):
    return spark.createDataFrame([(d, p + 1, t) for d, ts in texts.items() for p, t in enumerate(ts)], "doc_id bigint, page bigint, text string")


def test_calls_by_tier(spark):
    pages = _pages(spark, {1: ["short"], 2: ["x" * 900] * 30, 3: ["x" * 900] * 30, 4: ["x" * 9000] * 2, 5: ["x" * 9000, None, "x" * 9000], 7: ["x" * 900] * 30})
    missing = [(1, "isin"), (2, "closing_balance"), (2, "opening_balance"), (3, "isin"), (3, "iban"), (4, "closing_balance"), (4, "institution"), (5, "institution"), (6, "isin"), (7, "closing_balance")]
    calls = fallback.plan_calls(pages, spark.createDataFrame(missing, "doc_id bigint, field string"), context=2000)
    got = {r.doc_id: (r.tier, [(w.start_page, w.end_page) for w in r.windows]) for r in calls.collect()}
    assert got == {1: ("single", [(1, 1)]), 2: ("tier1", [(1, 3), (29, 30)]), 3: ("tier2", [(1, 12), (10, 21), (19, 30)]), 4: ("tier1", [(1, 2)]), 5: ("tier1", [(1, 2)]), 7: ("tier1", [(29, 30)])}
    asked = fallback.requests(pages, calls).collect()
    assert all(f"PAGE {p} " in a.prompt for a in asked for p in range(a.start_page, a.end_page + 1))


def test_value_in_the_middle_and_a_budget(spark):
    """30,000 characters with the value in their middle; the same with a budget that ends before."""
    texts = {1: ["w " * 250 for _ in range(60)]}
    texts[1][30] += " CODE-77 "

    def ask(asked):
        return asked.withColumn("reply", F.when(F.contains("prompt", F.lit("CODE-77")), '{"header_fields": {"isin": "CODE-77"}, "transactions": [{"date": "d", "description": "s", "debit": 5}]}').otherwise('{"isin": null}'))

    missing = spark.createDataFrame([(1, "isin")], "doc_id bigint, field string")
    run = lambda n, mode: fallback.run(_pages(spark, texts), missing, ask, maximum=n, mode=mode, context=2000)
    done = run(100_000, "skip")
    assert [(r.field, r.value, r.rule) for r in done.fields.collect()] == [("isin", "CODE-77", "model:tier2")] and done.open.count() == 0
    assert [(r.date, r.debit) for r in done.transactions.collect()] == [("d", 5.0)]  # two windows share it
    assert [r.reason for r in run(3_000, "skip").open.collect()] == ["ERR_VLM_007"] and run(3_000, "flag").open.count() == 0


def test_made_up_and_odd_replies(spark):
    pages = _pages(spark, {1: ["one two"], 2: ["one"], 3: ["one"], 4: [None]})
    missing = spark.createDataFrame([(k, f) for k in (1, 2, 3, 4) for f in ("client_name", "isin")], "doc_id bigint, field string")
    replies = F.element_at(F.array(F.lit('{"client_name": {"value": "two", "confidence": 1.0}, "isin": "nothing like it"}'), F.lit("no json"), F.lit(None), F.lit("[]")), F.col("doc_id").cast("int"))
    done = fallback.run(pages, missing, lambda a: a.withColumn("reply", replies))
    assert [(r.doc_id, r.field, r.value, r.confidence) for r in done.fields.collect()] == [(1, "client_name", "two", 0.95)]
    assert sorted((r.doc_id, r.reason) for r in done.open.collect()) == [(1, "ERR_VLM_004")] + [(k, "ERR_VLM_003") for k in (2, 2, 3, 3, 4, 4)]


def test_second_run_asks_nothing(spark, tmp_path):
    pages = _pages(spark, {1: ["Letter of the house no 1 sum 5"], 2: ["Letter of the house no 22 sum 6"], 3: ["Other words here"]})
    tenants = spark.createDataFrame([(k, "t") for k in (1, 2, 3)], "doc_id bigint, tenant_id string")
    asked = []

    def ask(calls):
        asked.extend(r.prompt for r in calls.collect())
        schema = F.lit('{"institution": "H", "document_type_label": "letter", "fields": [{"field_name": "no"}]}')
        value = F.concat(F.lit('{"no": {"value": "'), F.regexp_extract("prompt", r"no (\d+)", 1), F.lit('", "confidence": 0.9}}'))
        return calls.withColumn("reply", F.when(F.startswith("prompt", F.lit("[discover]")), F.when(F.contains("prompt", F.lit("Letter")), schema).otherwise("?")).otherwise(value))

    schemas, replies = discovery.schema_cache(f"{tmp_path}/s"), discovery.reply_cache(f"{tmp_path}/r")
    runs = []
    for _ in range(2):
        got = discovery.discover(pages, tenants, discovery.remembering(ask, replies), schemas, "2024-01-01")
        runs.append((sorted((r.doc_id, r.value) for r in got.fields.collect()), [(r.doc_id, r.reason) for r in got.open.collect()], len(asked)))
    assert runs[0][:2] == ([(1, "1"), (2, "22")], [(3, "ERR_DISCOVERY_001")]) == runs[1][:2]
    assert runs[0][2] == runs[1][2] == 4  # one schema for two documents, one that does not parse, two of values
    assert [(r.fingerprint, r.use_count) for r in schemas.read(spark).collect()] == [("h::letter", 4)]


def test_exports_by_tenant(spark, tmp_path):
    d = spark.createDataFrame([("a", "j1", 1), ("a", "j2", 2), ("b", "j1", 3)], "tenant_id string, job_id string, v int")
    write_json(d, f"{tmp_path}/all", "a")
    write_json(d, f"{tmp_path}/one", "a", "j2")
    assert [spark.read.json(f"{tmp_path}/{n}").count() for n in ("all", "one")] == [2, 1]
    p = spark.range(1).select(standalone_payload(F.lit(7), F.lit("tr"), F.lit("complete"), F.struct(F.lit(1).alias("x"))).alias("p")).first().p
    assert p == '{"type":"standalone","job_id":"7","trace_id":"tr","status":"complete","result":{"x":1}}'


def test_pages_and_percent_confidence(spark):
    from docloom.operators.admin import page_count
    from docloom.sources.files import percent_confidence

    assert [tuple(page_count(spark.range(n)).first()) for n in (0, 50, 51)] == [(0, 0), (50, 1), (51, 2)]
    d = percent_confidence(spark.createDataFrame([(95.0,), (None,), (0.0,)], "confidence double"))
    assert [r.confidence for r in d.collect()] == [0.95, None, 0.0]


def test_a_batch_is_sent_in_one_job(spark, tmp_path):
    """F8: the number of jobs of a batch does not grow with its payloads, and a batch that ended is not computed again."""
    targets = spark.createDataFrame([("a", True, "u")], "tenant_id string, enabled boolean, callback_url string")
    jobs = []
    for n in (40, 400):
        sink = DeliverySink(f"{tmp_path}/sent{n}", lambda key, url, body: True, targets, wave=8)
        batch = spark.range(n).select(F.col("id").cast("string").alias("payload_id"), F.lit("a").alias("tenant_id"), F.lit("b").alias("payload"))
        for again in (False, True):
            spark.sparkContext.setJobGroup(f"send{n}{again}", "")
            sink(batch, 0)
            jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"send{n}{again}")))
        assert sink.outcomes(spark).filter("outcome = 'delivered'").count() == n
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] == jobs[3] == 0 and jobs[0] == jobs[2] > 0
