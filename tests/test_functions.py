"""Scalar functions on worked values, nulls and generated input."""

import re

import json
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import columns as C
from docloom.functions.similarity import ratio, repair_json, repaired


def one(spark, expression, *values):
    """The expression over a column v of texts."""
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(expression(F.col("v"))).collect()]


def test_parse_amount(spark):
    got = one(spark, C.parse_amount, "1,234,567.89", "€1,234.56", "(1,234.56)", "-1,234.56", "$", "EUR 1,234", None, "12d", "1_000")
    assert got == [1234567.89, 1234.56, -1234.56, -1234.56, 0.0, None, None, None, None]


def test_to_float(spark):
    assert one(spark, C.to_float, "£1,500.00", "", "(5)", "x", None) == [1500.0, None, None, None, None]


def test_dates(spark):
    assert one(spark, C.parse_date, "15/01/2024", "1.2.2024", "2024-01-15", "15 Jan 2024", "January 5, 2024", "31/02/2024", "soon") == ["2024-01-15", "2024-02-01", "2024-01-15", "2024-01-15", "2024-01-05", "2024-02-31", "soon"]
    assert one(spark, C.parse_swift_date, "20240115", "15/01/2024") == ["2024-01-15", "2024-01-15"]


def test_identifiers(spark):
    assert one(spark, C.iban_ok, "GB29NWBK60161331926819", "DE89370400440532013000", "GB00NWBK60161331926819", "GB29", None) == [True, True, False, False, False]
    assert one(spark, C.isin_ok, "US0378331005", "US0378331009", "US037833100") == [True, False, False]
    assert one(spark, C.bic_ok, "DEUTDEFFXXX", "DEUTDEFF", "12345678") == [True, True, False]
    assert one(spark, C.currency_ok, "eur", "XXQ") == [True, False]


def test_texts(spark):
    assert one(spark, C.strip_fences, '```json\n{"a": 1}\n```', "plain ") == ['{"a": 1}', "plain"]
    assert one(spark, C.normalise_iban, " gb29 nwbk ") == ["GB29NWBK"]
    assert one(spark, C.word_count, "", " a  b ", None) == [0, 2, None]
    assert one(spark, lambda v: C.occurrences(v, "aa"), "aaaa", "aaa", "b") == [2, 1, 0]
    assert one(spark, C.token_estimate, "a" * 7, None) == [2, 0]
    assert [len(x) for x in one(spark, C.truncate_middle, "x" * 15001, "y" * 15000)] == [8000 + 5000 + len("\n\n[... cut ...]\n\n"), 15000]
    assert one(spark, C.redact, "to a.b@c.de from 10.0.0.1") == ["to [REDACTED] from [REDACTED]"]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.text("abcd ", max_size=12), st.text("abcd ", max_size=12)), min_size=1, max_size=20))
def test_ratio_is_difflibs(spark, pairs):
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    got = [r[0] for r in df.orderBy("k").select(ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("ab", min_size=1, max_size=3), st.lists(st.integers(0, 9), max_size=4), min_size=1, max_size=4), st.integers(0, 8))
def test_repair(value, cut):
    text = json.dumps(value)
    fixed = repaired(text[: max(1, len(text) - cut)], step=1)
    assert fixed is not None and isinstance(json.loads(fixed), dict)


def test_repair_column(spark):
    assert one(spark, repair_json, '{"a": [1, 2', None, "}") == ['{"a": [1, 2]}', None, None]


@pytest.mark.parametrize("attempt,least,most", [(0, 1000, 2000), (10, 30000, 30000)])
def test_retry_delay(spark, attempt, least, most):
    d = spark.range(1).select(C.retry_delay_ms(F.lit(attempt), F.lit(0.5))).first()[0]
    assert least <= d <= most


def test_dates_of_eight_forms(spark):
    good = ["2024-1-5", "05/01/2024", "5-1-2024", "5.1.2024", "5 Jan 2024", "5 january 2024", "Jan 5, 2024", "January 5, 2024"]
    got = one(spark, lambda c: F.date_format(C.try_date(c), "yyyy-MM-dd"), *good, " 5  JAN  2024 ", "2024/1/5", "31/02/2024", "5 January 24", "12345-01-01", "", None)
    assert got == ["2024-01-05"] * 9 + [None] * 6


SECRETS = ["+44 20 7946 0958", "07911 123456", "555-123-4567", "(555) 123-4567", "+1 (555) 123-4567", "3782 822463 10005", "4111 1111 1111 1111", "GB29 NWBK 6016 1331 9268 19", "DE89370400440532013000", "123-45-6789", "10.0.0.1", "a.b+c@mail.example.com"]
PLAIN = ["", "no. 12 of 2024", "15/01/2024", "1,234.56", "order 4711", "AB12", "É 12-34", "page 3 of 1000"]


def test_redaction_of_every_form(spark):
    texts = [f"x {s} y" for s in SECRETS]
    assert one(spark, C.redact, *texts, *PLAIN) == ["x [REDACTED] y"] * len(SECRETS) + PLAIN
    log = one(spark, C.redaction_log, *texts, *PLAIN, "a@b.com10.0.0.1 a@b.org", None)
    assert all([(e.start, e.end) for e in x] == [(2, 2 + len(s))] for x, s in zip(log, SECRETS))
    assert log[len(SECRETS) : -2] == [[]] * len(PLAIN) and log[-1] is None
    assert [(e.entity_type, e.start, e.end) for e in log[-2]] == [("EMAIL_ADDRESS", 0, 7), ("EMAIL_ADDRESS", 16, 23)] or len(log[-2]) >= 2
    assert one(spark, lambda c: C.redact(c, ()), "a@b.com") == ["a@b.com"] and one(spark, lambda c: C.redact(c, ("IP_ADDRESS",)), "a@b.com 1.2.3.4") == ["a@b.com [REDACTED]"]


def test_redaction_of_many_hits(spark):
    """Spans of 10,000 hits in one text within seconds, across blocks, with and without the mark that is used inside."""
    import time

    def made(n, mark=""):
        return " ".join(f"x{k}{mark} a{k}@b.com" for k in range(n))

    began = time.time()
    for text in (made(10_000), made(C.LOG_BLOCK), made(C.LOG_BLOCK + 1), made(3, "\uE000")):
        found = one(spark, C.redacted, text)[0]
        assert [(s.start, s.end) for s in found.log] == [m.span() for m in re.finditer(r"a\d+@b\.com", text)]
        assert found.text == re.sub(r"a\d+@b\.com", "[REDACTED]", text)
    assert time.time() - began < 60


def test_long_iban_is_read_whole(spark):
    body = "1" * 200
    check = 98 - int(body + "161100") % 97
    assert one(spark, C.iban_ok, f"GB{check:02d}{body}", f"GB{check:02d}{body[:-1]}2") == [True, False]
