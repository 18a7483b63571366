"""Steps whose work or memory must not grow faster than their tables."""

import numpy as np
from pyspark.sql import functions as F

from docloom.functions import similarity
from docloom.operators import discovery, flow, layout, model_io, tables, validators, verify
from docloom.streaming import alerts


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_and_replies_are_not_broadcast(spark):
    """the planner takes computed texts for small, so the joins say that both sides grow."""
    values = spark.createDataFrame([(1, "f", "alpha")], "doc_id long, field string, __v string")
    runs = spark.createDataFrame([(1, "alpha", 1, 0)], "doc_id long, __w string, size int, seq long")
    like = verify._alike(values, runs, 0.85)
    assert "Broadcast" not in plan_of(like)
    assert [r["matched"] for r in like.collect()] == ["alpha"]
    asked = spark.createDataFrame([(1, "k", "p")], "doc_id long, prompt_key string, prompt string")
    replies = spark.createDataFrame([("k", "r")], "prompt_key string, reply string")
    answered = discovery.replay(asked, replies)
    assert "Broadcast" not in plan_of(answered)
    assert answered.first()["reply"] == "r"


def test_likeness_by_letters_first(monkeypatch):
    """pairs without enough letters in common are not compared in order; others have their exact ratio."""
    asked = []

    class Matcher(similarity.SequenceMatcher):
        def ratio(self):
            asked.append((self.a, self.b))
            return super().ratio()

    monkeypatch.setattr(similarity, "SequenceMatcher", Matcher)
    assert similarity._ratio("abcd", "wxyz", 0.85) < 0.85 and asked == []
    assert similarity._ratio("abcdefgh", "abcdefghx", 0.85) == 16 / 17 and len(asked) == 1
    assert similarity._ratio("", "", 0.85) == 1.0


def test_circuit_counts_join_counted_events(spark):
    """events are counted before they meet the rules, with the same counts as the rows that circuit_alerts gives."""
    events = spark.createDataFrame([("a", "t0", "closed", "open"), ("a", "t0", "closed", "open"), ("a", None, "open", "closed"), ("b", "t1", "open", "half_open"), (None, "t0", "closed", "open")], "service_name string, tenant_id string, previous_state string, new_state string")
    rules = spark.createDataFrame([(1, "a", None, True), (2, "a", "t0", True), (3, "a", None, False), (4, "b", None, True)], "rule_id long, service_name string, tenant_id string, enabled boolean")
    counts = alerts.circuit_counts(events, rules)
    rows = alerts.circuit_alerts(events, rules).groupBy("rule_id", "to_state").agg(F.count("*").alias("changes"))
    found = sorted(tuple(r) for r in counts.collect())
    assert found == sorted(tuple(r) for r in rows.collect()) == [(1, "firing", 2), (1, "resolved", 1), (2, "firing", 2)]
    plan = plan_of(counts)
    joined = plan[plan.index("Join") :]
    assert "count" in joined  # an aggregate lies below the join


def test_pages_are_ordered_together():
    """all pages of a batch at once, each as if alone."""
    rng = np.random.default_rng(3)
    page = np.sort(rng.integers(0, 40, 400))
    x0, y0 = rng.integers(0, 30, 400) * 10.0, rng.integers(0, 60, 400) * 5.0
    x1, y1 = x0 + rng.integers(0, 40, 400), y0 + rng.integers(1, 9, 400)
    together = layout.reading_places(page, x0, y0, x1, y1)
    for p in np.unique(page):
        mine = page == p
        assert layout.reading_order(x0[mine], y0[mine], x1[mine], y1[mine]) == np.argsort(together[mine]).tolist()


def test_equal_cells_are_not_compared(spark):
    """only cells that differ reach the likeness, as texts."""
    cells = "table_key long, r long, c int, v string"
    a = spark.createDataFrame([(1, 1, 0, "same"), (1, 1, 1, "long enough text"), (1, 2, 0, "ab")], cells)
    b = spark.createDataFrame([(1, 1, 0, "Same "), (1, 1, 1, "long enough textx"), (1, 2, 0, "xy")], cells)
    out = tables.triangulate(a, b, fuzzy=True)
    assert [(r["cells"], r["mismatches"]) for r in out.collect()] == [(3, 1)]
    assert plan_of(out).count("CASE WHEN") >= 2


def test_fields_and_abstentions_come_from_one_pass(spark):
    """one join and one pass of patterns give what is found and what is missing; lines of other kinds meet no pattern."""
    lines = spark.createDataFrame([(1, 1, 0, "Account Statement of the account balance"), (1, 1, 1, "Opening Balance: 5.5"), (1, 1, 2, "Portfolio ID: PORT-1"), (2, 1, 0, "A letter")], "doc_id long, page int, seq int, text string")
    out = flow.process(lines).outcomes
    found = {(r["doc_id"], r["kind"], r["field"]): r["value"] or r["reason"] for r in out.collect()}
    bank = {f: "ERR_EXTRACT_001" for f in ("account_number", "statement_date", "closing_balance")} | {"opening_balance": "5.5"}
    assert found == {(1, "bank_statement", f): v for f, v in bank.items()} | {(2, "unknown", "document_kind"): "ERR_EXTRACT_002"}
    plan = plan_of(flow.process(lines).outcomes)
    assert plan.count("SortMergeJoin") == 1 and "Union" not in plan


def test_texts_are_redacted_and_parsed_once(spark):
    """filters on what a reply holds do not copy the redaction of the prompt, or the parsing, that made it."""
    pages = spark.createDataFrame([(1, 1, "Order 1 by a@b.cc")], "doc_id long, page long, text string")
    ask = lambda d: d.withColumn("reply", F.concat(F.lit('{"accounts": [{"account_number": "'), F.replace("prompt", F.lit("\n"), F.lit(" ")), F.lit('"}]}')))
    accounts = model_io.accounts_of(ask(model_io.metadata_requests(pages)))
    assert [r["account_number"] for r in accounts.collect()] == ["[metadata] Order 1 by [REDACTED]"]
    plan = plan_of(accounts)
    plan = plan[plan.rindex("Initial Plan") :] if "Initial Plan" in plan else plan
    assert plan.count("[REDACTED]") == 1
    assert plan.count("from_json") == 1


def test_account_checks_are_the_three_together(spark):
    """one grouped step with the failures of the three checks, and no join of its own."""
    accounts = spark.createDataFrame([(1, 10, 15, 2, 7), (2, 10, 99, 3, None), (3, 1, None, 0, 4), (4, None, 1, 0, 0), (4, 0, 1, 1, 0), (None, 0, 1, 1, 0)], "acct_id long, opening long, closing long, total_debits long, total_credits long")
    txns = spark.createDataFrame([(1, 2, None), (1, None, 7), (2, 1, 1), (9, 1, 1), (None, 5, 5)], "acct_id long, debit long, credit long")
    parts = (validators.reconciliation(accounts, txns), validators.completeness(accounts, txns), validators.totals_crosscheck(accounts, txns))
    together = validators.account_checks(accounts, txns)
    rows = lambda d: sorted(map(str, validators.all_failures(d).collect()))
    assert rows(together) == sorted(x for p in parts for x in rows(p)) and together.count() > 5
    assert "Join" not in plan_of(together)


def test_words_are_cut_where_they_meet_values(spark):
    """texts are dealt once; no words or runs are kept or shuffled. Values are found as by trying every run in order."""
    import random
    from difflib import SequenceMatcher

    rng = random.Random(5)
    made = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 5)))
    words = {d: [[made() for _ in range(rng.randint(0, 9))] for _ in range(3)] for d in range(12)}
    texts = spark.createDataFrame([(d, p * 100, rng.choice(["", " "]) + "  ".join(ws)) for d, ps in words.items() for p, ws in enumerate(ps)] + [(99, 0, None)], "doc_id long, seq long, text string")
    values = [(d, f"f{k}", rng.choice([made(), f"{made()} {made()}", f"{made()} {made()} {made()}", ""])) for d in [*words, 99, 100] for k in range(12)]
    rows = {r["doc_id"]: [] for r in texts.select("doc_id").distinct().collect()}
    for r in texts.orderBy("seq").collect():
        rows[r["doc_id"]] += [(r["seq"] + k, w) for k, w in enumerate((r["text"] or "").split("  ") if not (r["text"] or "").startswith(" ") else ["", *r["text"].split()]) if w]

    def best(d, v):
        ws = rows.get(d, [])
        for size in range(1, 6):
            for i in range(len(ws) - size + 1):
                run = " ".join(w for _, w in ws[i : i + size])
                if SequenceMatcher(None, v, run).ratio() >= 0.85:
                    return True, "word" if size == 1 else "run", run, ws[i][0]
        inside = v in " ".join(w for _, w in ws)
        return inside, "text" if inside else "unverifiable", None, ws[0][0] if inside else None

    expected = {(d, f): best(d, v) if v else (False, "no_value", None, None) for d, f, v in values}
    out = verify.verify_values(spark.createDataFrame(values, "doc_id long, field string, value string"), texts, split=True)
    assert {(r["doc_id"], r["field"]): (r["verified"], r["how"], r["matched"], r["seq"]) for r in out.collect()} == expected
    assert {how for _, how, _, _ in expected.values()} == {"word", "run", "text", "unverifiable", "no_value"}
    plan = plan_of(out)
    plan = plan[plan.rindex("Initial Plan") :] if "Initial Plan" in plan else plan
    assert plan.count("Exchange hashpartitioning") <= 3 and "Scan ExistingRDD" in plan and "Window" not in plan


def test_a_reply_is_kept_once(spark, tmp_path):
    """prompts and keys are not carried along with answers; each distinct prompt is asked once, null replies again."""
    cache = discovery.reply_cache(f"{tmp_path}/r")
    served = []

    def ask(asked):
        served.append(sorted(r["prompt"] for r in asked.collect()))
        return asked.withColumn("reply", F.when(asked["prompt"] != "c", F.upper("prompt")))

    port = discovery.remembering(ask, cache)
    calls = lambda *prompts: spark.createDataFrame([(k, p) for k, p in enumerate(prompts)], "doc_id long, prompt string").withColumn("prompt_key", F.sha2("prompt", 256))
    for prompts in ("aabc", "ab", "cad"):
        out = port(calls(*prompts))
        assert out.columns == ["doc_id", "reply"]
        assert sorted((r["doc_id"], r["reply"]) for r in out.collect()) == [(k, None if p == "c" else p.upper()) for k, p in enumerate(prompts)]
    assert served == [["a", "b", "c"], ["c", "d"]]
    assert sorted(r["reply"] for r in cache.read(spark).collect()) == ["A", "B", "D"]
    # a table of known size may be broadcast; adding to it takes no join
    more = spark.createDataFrame([("k", "v")], "prompt_key string, reply string")
    cache.add(more)
    assert cache.read(spark).count() == 4


def test_values_are_read_once_for_their_checks(spark):
    """a value's date and its forms are computed once, no lambda holds the checks, and equal headers take no lambda."""
    fields = spark.createDataFrame([(1, "a", "GB29 NWBK 6016 1331 9268 18"), (1, "b", None), (2, "c", "US0378331006"), (2, "d", "Abc"), (3, "e", "31/12/2003"), (3, "f", "2001-01-01"), (4, "g", "ABCD1234")], "doc_id long, field string, value string")
    bad = validators.identifiers(fields)
    assert sorted((r["field"], r["validator"]) for r in bad.collect()) == [("a", "iban"), ("c", "iban"), ("c", "isin"), ("d", "currency"), ("g", "bic")]
    late = validators.dates(fields, "2003-06-30")
    assert [(r["doc_id"], r["field"], r["error_code"]) for r in late.collect()] == [(3, "e", "ERR_VAL_005")]
    assert plan_of(late).count("initcap") <= plan_of(fields.select(validators.C.try_date(F.col("value")).alias("d"))).count("initcap")
    headers = spark.createDataFrame([(["x", "cr", "debit"],), (["credits", "credit"],), (["credit amount", "z"],), (["z"],), ([],), (None,)], "h array<string>")
    found = headers.select(model_io.header_index(F.col("h"), ("credit", "credits", "cr")).alias("i"))
    assert [r["i"] for r in found.collect()] == [1, 0, 0, None, None, None]
    assert "array_position" in plan_of(found)
    texts = spark.createDataFrame([("a b  a\n c ",), ("  ",), ("",), (None,)], "t string")
    got = texts.select(validators.C.word_count(F.col("t")).alias("n"), validators.C.occurrences(F.col("t"), "a").alias("k")).collect()
    assert [(r["n"], r["k"]) for r in got] == [(4, 2), (0, 0), (0, 0), (None, None)]
