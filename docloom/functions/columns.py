"""Scalar functions as Column expressions; none runs Python."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def to_double(text: Column) -> Column:
    """Null unless the text is a plain number (Java's suffixes and blanks are refused)."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def parse_amount(raw: Column) -> Column:
    """Parentheses or a leading minus make it negative; symbols, commas and blanks go; empty is 0; not a number is null."""
    t = F.trim(raw)
    paren = t.startswith("(") & t.endswith(")")
    t = F.when(paren, F.regexp_replace(t, r"^\(|\)$", "")).otherwise(t)
    minus = t.startswith("-")
    t = F.regexp_replace(F.when(minus, F.substring(t, 2, 2_000_000_000)).otherwise(t), r"[€$£¥₹\s,]", "")
    value = F.when(t == "", F.lit(0.0)).otherwise(to_double(t))
    return F.when((paren | minus) & (value != 0), -value).otherwise(value)


def to_float(raw: Column) -> Column:
    """Symbols, commas and blanks go; empty or not a number is null; parentheses are not a sign."""
    return to_double(F.regexp_replace(raw, r"[€$£¥₹\s,]", ""))


def normalise_iban(raw: Column) -> Column:
    """X3."""
    return F.upper(F.regexp_replace(raw, r"\s+", ""))


def normalise_cell(raw: Column) -> Column:
    """X4."""
    return F.lower(F.trim(F.coalesce(raw, F.lit(""))))


def strip_fences(raw: Column) -> Column:
    """The inside of a Markdown fence, with or without the word json; other text is only trimmed."""
    t = F.trim(raw)
    return F.trim(F.regexp_replace(t, r"(?s)^```(?:json)?\s*\n?(.*?)\n?\s*```$", "$1"))


def parse_date(raw: Column) -> Column:
    """ISO text stays, day/month/year with / - or . is turned (no calendar check), names of months are read, the rest stays."""
    t = F.trim(raw)
    dmy = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})$"
    turned = F.regexp_replace(F.regexp_replace(t, dmy, "$3-0$2-0$1"), r"-0(\d{2})(?=-|$)", "-$1")
    # month first, or day and short month between equal signs, as day month year
    plain = F.regexp_replace(F.regexp_replace(t, r"^([A-Za-z]+)\s+(\d{1,2}),\s+(\d{4})$", "$2 $1 $3"), r"^(\d{1,2})([-/])([A-Za-z]{3})\2(\d{4})$", "$1 $3 $4")
    plain = F.initcap(F.regexp_replace(plain, r"\s+", " "))
    named = F.coalesce(F.try_to_timestamp(plain, F.lit("d MMM yyyy")), F.try_to_timestamp(plain, F.lit("d MMMM yyyy")))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t).when(t.rlike(dmy), turned).otherwise(F.coalesce(F.date_format(named, "yyyy-MM-dd"), t))


def parse_swift_date(raw: Column) -> Column:
    """YYYYMMDD; anything else as by parse_date."""
    t = F.trim(raw)
    return F.when(t.rlike(r"^\d{8}$"), F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).otherwise(parse_date(raw))


# The forms in which a date is read, in this order.
DATE_FORMS = ("yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy")


def try_date(raw: Column) -> Column:
    """A timestamp by the first of eight forms that reads the text, else null; names of months in any case."""
    t = F.initcap(F.regexp_replace(F.trim(raw), r"\s+", " "))
    shaped = t.rlike(r"^(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}([/.\-])\d{1,2}\2\d{4}|\d{1,2} [A-Za-z]+ \d{4}|[A-Za-z]+ \d{1,2}, \d{4})$")
    return F.when(shaped, F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in DATE_FORMS]))


def _digits(text: Column) -> Column:
    """Characters with letters as 10 to 35, joined."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.between("A", "Z"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")


def iban_ok(raw: Column) -> Column:
    """Mod-97 of the rotated code is 1; five characters at least."""
    t = F.upper(F.regexp_replace(raw, r"\s+", ""))
    rotated = _digits(F.concat(F.substring(t, 5, 2_000_000_000), F.substring(t, 1, 4)))
    rest = F.aggregate(F.split(rotated, ""), F.lit(0).cast("bigint"), lambda a, c: (a * 10 + c.cast("bigint")) % 97)
    shaped = (F.length(t) >= 5) & t.rlike(r"^[A-Z0-9]+$")
    return F.coalesce(F.when(shaped, rest == 1), F.lit(False))


def isin_ok(raw: Column) -> Column:
    """Luhn over the expanded digits of a 12-character code."""
    t = F.upper(F.trim(raw))
    d = F.reverse(F.split(_digits(t), ""))
    weighed = F.transform(d, lambda c, i: F.when(i % 2 == 1, F.floor(c.cast("bigint") * 2 / 10) + c.cast("bigint") * 2 % 10).otherwise(c.cast("bigint")))
    total = F.aggregate(weighed, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.coalesce(F.when(t.rlike(r"^[A-Z]{2}[A-Z0-9]{9}\d$"), total % 10 == 0), F.lit(False))


def bic_ok(raw: Column) -> Column:
    """C3."""
    return F.coalesce(F.upper(F.trim(raw)).rlike(r"^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$"), F.lit(False))


def currency_ok(raw: Column) -> Column:
    """C4."""
    return F.coalesce(F.upper(F.trim(raw)).isin(*fixed.CURRENCIES), F.lit(False))


def sha_id(content: Column) -> Column:
    """C5."""
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def token_estimate(text: Column) -> Column:
    """A23."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / fixed.CHARS_PER_TOKEN).cast("bigint")


def truncate_middle(text: Column, limit: int = 15_000, head: int = 8_000, tail: int = 5_000, mark: str = "\n\n[... cut ...]\n\n") -> Column:
    """A text over the limit keeps its head and tail around a mark."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, head), F.lit(mark), F.right(text, F.lit(tail)))).otherwise(text)


def fingerprint_key(institution: Column, label: Column) -> Column:
    """X19, D12."""
    return F.concat(F.replace(F.trim(F.lower(institution)), F.lit(" "), F.lit("_")), F.lit("::"), label)


def occurrences(text: Column, word: str) -> Column:
    """How often the word stands in the text, not overlapping."""
    n = F.floor((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word))
    return F.when(~F.contains(text, F.lit(word)), F.lit(0).cast("bigint")).otherwise(n)


def word_count(text: Column) -> Column:
    """Words between white space; 0 for blank text."""
    return F.size(F.array_remove(F.split(F.trim(text), r"\s+"), ""))


def keyword_density(text: Column, keywords: Sequence[str]) -> Column:
    """Hits (at most three a keyword) by keywords and hundreds of words; ``text`` is lower-cased."""
    hits = reduce(lambda a, b: a + b, [F.least(occurrences(text, k), F.lit(3)) for k in keywords])
    return hits / (F.lit(float(len(keywords))) * F.greatest(word_count(text) / 100.0, F.lit(1.0)))


def penalised(text: Column, score: Column, negatives: Sequence[str]) -> Column:
    """0.01 off for every word found, floored at 0 once."""
    return F.greatest(score - F.lit(fixed.PENALTY) * sum_flags(text, negatives), F.lit(0.0))


def sum_flags(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words])


def confidence_band(c: Column) -> Column:
    """F21."""
    return F.when(c >= 0.90, "high").when(c >= 0.70, "medium").otherwise("low")


#: Hits whose spans are gathered at once.
LOG_BLOCK = 256
# Forms of personal data, by entity; at one place the first that fits wins.
PII = {
    "EMAIL_ADDRESS": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "IBAN_CODE": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "CREDIT_CARD": r"\b(?:\d{4}[ \-]?\d{4}[ \-]?\d{4}[ \-]?\d{1,4}|3[47]\d{2}[ \-]?\d{6}[ \-]?\d{5})\b",
    "US_SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "IP_ADDRESS": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "PHONE_NUMBER": r"\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,4}(?:[ .\-]?\d{2,4}){1,4}\b|(?:\(\d{3}\) ?|\b\d{3}[ .\-])\d{3}[ .\-]\d{4}\b|\b0\d{4}[ \-]?\d{6}\b|\b0\d{2,4}[ \-]\d{3,4}[ \-]?\d{3,4}\b",
}


def pii_pattern(entities: Sequence[str] = tuple(PII)) -> str:
    return "|".join(f"(?:{PII[e]})" for e in entities)


def redact(text: Column, entities: Sequence[str] = tuple(PII)) -> Column:
    """X13 for pattern entities, in one pass over the text; names and places need a recogniser behind a port."""
    return F.regexp_replace(text, pii_pattern(entities), "[REDACTED]") if entities else text


SPANS = "array<struct<entity_type:string,start:int,end:int>>"


def once(value: Column, name: str) -> Column:
    """The value as a column that later filters and uses do not copy: they would compute it again for each."""
    return F.explode(F.array(value)).alias(name)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pieces(text: Column, pattern: str) -> Column:
    """What stands before the first hit, the hit, what stands before the next, ...: one search over texts without the mark that is used."""
    mark = "\uE000"
    at_once = F.split(F.regexp_replace(text, f"({pattern})", f"{mark}$1{mark}"), mark, -1)
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    apart = F.transform(F.split(text, pattern, -1), lambda b, k: F.when(k < F.size(hits), F.array(b, F.get(hits, k))).otherwise(F.array(b)))
    return F.when(F.contains(text, F.lit(mark)), F.flatten(apart)).otherwise(at_once)


def _spans(pieces: Column, entities: Sequence[str]) -> Column:
    """Spans of the hits among pieces: a hit begins where the text before it ends. They are gathered in blocks, as arrays grow by copies."""
    kind = lambda m: F.coalesce(*[F.when(m.rlike(f"^(?:{PII[e]})$"), F.lit(e)) for e in entities])
    n = F.floor(F.size(pieces) / 2).cast("int")

    def step(s: Column, k: Column) -> Column:
        hit = F.get(pieces, k * 2 + 1)
        end = s["at"] + F.length(hit)
        span = F.struct(kind(hit).alias("entity_type"), s["at"].alias("start"), end.alias("end"))
        return F.struct((end + F.length(F.get(pieces, k * 2 + 2))).alias("at"), F.array_append(s["log"], span).alias("log"))

    def block(s: Column, b: Column) -> Column:
        mine = F.aggregate(F.sequence(b * LOG_BLOCK, F.least(n, (b + 1) * LOG_BLOCK) - 1), F.struct(s["at"].alias("at"), F.array().cast(SPANS).alias("log")), step)
        return let(mine, lambda m: F.struct(m["at"].alias("at"), F.array_append(s["logs"], m["log"]).alias("logs")))

    blocks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / LOG_BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.length(F.get(pieces, F.lit(0))).alias("at"), F.array().cast(f"array<{SPANS}>").alias("logs"))
    return F.flatten(F.aggregate(blocks, start, block, lambda s: s["logs"]))


def redacted(text: Column, entities: Sequence[str] = tuple(PII)) -> Column:
    """Struct of the redacted text and its log, from one search over the text; null for null."""
    if not entities:
        return F.when(text.isNotNull(), F.struct(text.alias("text"), F.array().cast(SPANS).alias("log")))
    shown = lambda p: F.array_join(F.transform(p, lambda x, k: F.when(k % 2 == 1, "[REDACTED]").otherwise(x)), "")
    return F.when(text.isNotNull(), let(_pieces(text, pii_pattern(entities)), lambda p: F.struct(shown(p).alias("text"), _spans(p, entities).alias("log"))))


def redaction_log(text: Column, entities: Sequence[str] = tuple(PII)) -> Column:
    """Array of entity_type, start and end (characters from 0 of the text as it was, end exclusive), in order."""
    if not entities:
        return F.array().cast(SPANS)
    return F.when(text.isNotNull(), let(_pieces(text, pii_pattern(entities)), lambda p: _spans(p, entities)))


def retry_delay_ms(attempt: Column, jitter: Column) -> Column:
    """Doubling from one second with up to a second of jitter, at most 30 seconds."""
    return F.least(F.lit(1000.0) * F.pow(F.lit(2.0), attempt) + jitter * 1000, F.lit(30_000.0))
