"""I-Match fingerprints with randomised lexicons (Chowdhury et al., 2002; Kolcz et al., 2004), in DataFrame functions only.

A text's terms are its distinct lower-cased words. The lexicon holds the terms within a band of the inverse document
frequency: at least ``rarest`` documents hold them and at most a ``share`` of all. It is dealt at random (by each term's
hash) into ``PARTS`` sub-lexicons, and each of them thins out in steps, every step keeping half of the terms of the one
before. A fingerprint names the hashes of a text's sorted terms in each part, at three steps that suit its number of
terms, so that a part holds about one term: long texts that share half of their words still agree in some parts.

Form: ``step;parts at step;parts at step + 1;parts at step + 2``, each part as two hexadecimal digits of its number and
four of its hash, parts without terms left out. A text without lexicon terms stands for itself: ``=`` and its MD5.
Likeness: 1 for equal fingerprints; 0 if one stands for itself or their steps lie over two apart; else the share of parts
that agree among those that either has, at the larger step.

Nulls: a null text is the empty text; a null doc_id comes first in the order. Repeated rows each give a row; rows of one
doc_id follow each other by text. An empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

#: A power of two.
PARTS = 64
STEPS = 3
RAREST = 2
SHARE = 0.1
#: Most ranges that documents are dealt into to find each one's successor.
MOST_RANGES = 4096


def terms(text: Column) -> Column:
    """60-bit hashes of the text's distinct words: runs of 0-9, a-z and what lies beyond ASCII, in lower case."""
    words = F.array_distinct(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    number = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 15), 16, 10).cast("bigint")
    return F.transform(F.array_remove(words, ""), number)


def step_of(n: Column, parts: int = PARTS) -> Column:
    """The first step at which a part keeps less than one of n terms on average."""
    return F.size(F.filter(F.array(*[F.lit(parts << k) for k in range(40)]), lambda bound: bound <= n))


def thinned(hashes: Column, step: Column, parts: int = PARTS) -> Column:
    """The terms that are left at a step: those whose hash, less its part, ends in that many zero bits."""
    below = F.call_function("shiftleft", F.lit(1).cast("bigint"), step) - 1
    return F.filter(hashes, lambda t: F.shiftright(t, parts.bit_length() - 1).bitwiseAND(below) == 0)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two fingerprints, see above; null if one is null."""
    x, y = F.split(a, ";"), F.split(b, ";")
    sa, sb = F.get(x, F.lit(0)).try_cast("int"), F.get(y, F.lit(0)).try_cast("int")
    at = F.greatest(sa, sb)
    of = lambda pieces, own: F.array_remove(F.split(F.coalesce(F.get(pieces, 1 + at - own), F.lit("")), ","), "")
    p, q = of(x, sa), of(y, sb)
    number = lambda part: F.substring(part, 1, 2)
    either = F.size(F.array_union(F.transform(p, number), F.transform(q, number)))
    apart = F.greatest(at - sa, at - sb) >= STEPS
    return F.when(a == b, 1.0).when(a.startswith("=") | b.startswith("=") | apart | (either == 0), 0.0).otherwise(F.size(F.array_intersect(p, q)) / either)


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most the key (0 for null), by a search in two steps."""
    width = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    count = lambda values: F.size(F.filter(values, lambda b: b <= key))
    if not bounds:
        return F.lit(0)
    block = count(F.array(*[F.lit(b[0]).cast("bigint") for b in blocks])) - 1
    rest = F.get(F.array(*[F.array(*[F.lit(v).cast("bigint") for v in b]) for b in blocks]), block)
    return F.when(key.isNull() | (block < 0), 0).otherwise(block * width + count(rest))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_id, next_text: each document with the one that follows by doc_id; the first follows the last.

    Documents are dealt into ranges of doc_id whose bounds are ids of the table (quantiles), and each range's first
    document visits the range before it as a guest, so one shuffle of the texts does it and no range is a single task's
    whole table.
    """
    spark = docs.sparkSession
    n = min(MOST_RANGES, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = F.percentile_approx("doc_id", F.array(*[F.lit(k / n) for k in range(1, n)]), F.lit(100 * n)) if n > 1 else F.array()
    found = d.agg(F.min("doc_id").alias("low"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), cuts.alias("cuts")).first()
    first = None if found["nulls"] else found["low"]
    bounds = sorted({int(b) for b in found["cuts"] or () if found["nulls"] or b != first})
    key = F.col("doc_id")
    opens = key.isin(bounds) if len(bounds) <= 64 else F.array_contains(F.array(*[F.lit(b).cast("bigint") for b in bounds]), key)
    place = F.struct(_range_of(key, bounds).alias("at"), F.lit(0).alias("guest"))
    before = F.when(opens, F.struct((_range_of(key, bounds) - 1).alias("at"), F.lit(1).alias("guest")))
    around = F.when(key.eqNullSafe(F.lit(first).cast("bigint")), F.struct(F.lit(len(bounds)).alias("at"), F.lit(2).alias("guest")))
    dealt = d.select("doc_id", "text", F.explode(F.array_compact(F.array(place, before, around))).alias("p"))
    w = Window.partitionBy("p.at").orderBy("p.guest", F.col("doc_id").asc_nulls_first(), "text")
    led = dealt.select("doc_id", "text", "p", F.lead("doc_id").over(w).alias("next_id"), F.lead("text").over(w).alias("next_text"))
    return led.filter("p.guest = 0").drop("p")


def edited(text: Column, following: Column) -> Column:
    """The text with its last half (rounded down) replaced by as many characters of the next one, or all it has."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def lexicon(docs: DataFrame, rarest: int = RAREST, share: float = SHARE) -> DataFrame:
    """t: the terms that at least ``rarest`` documents hold and at most the share of all (but never fewer than ``rarest``)."""
    total = docs.select(F.floor(F.count("*") * share).alias("most"))
    held = docs.select(F.explode(terms(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    return held.filter(F.col("df") >= rarest).join(F.broadcast(total), (F.col("df") <= F.greatest("most", F.lit(rarest)))).select("t")


def fingerprint_documents(docs: DataFrame, rarest: int = RAREST, share: float = SHARE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of documents (doc_id, text)."""
    led = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    hashed = led.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "next_id",
        F.char_length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.md5(F.col("text").cast("binary")).alias("own"), F.md5(F.col("edited").cast("binary")).alias("own_edited"), F.md5(F.col("next_text").cast("binary")).alias("own_next"),
        terms(F.col("text")).alias("a"), terms(F.col("edited")).alias("b"),
    )
    stepped = hashed.withColumns({"step": step_of(F.size("a")), "step_edited": step_of(F.size("b"))})
    kept = stepped.withColumns({"a": thinned(F.col("a"), F.col("step")), "b": thinned(F.col("b"), F.col("step_edited"))})
    # a term's hash and, in two more bits, which of the two texts holds it
    marked = F.concat(
        F.transform(F.array_except("a", "b"), lambda t: F.shiftleft(t, 2) + 1), F.transform(F.array_except("b", "a"), lambda t: F.shiftleft(t, 2) + 2),
        F.transform(F.array_intersect("a", "b"), lambda t: F.shiftleft(t, 2) + 3),
    )
    rows = cut_lineage(kept.withColumn("marked", marked).drop("a", "b"))
    long = rows.select("row", "step", "step_edited", F.explode("marked").alias("m")).select("row", "step", "step_edited", F.shiftright("m", 2).alias("t"), F.col("m").bitwiseAND(3).alias("in"))
    inside = long.join(lexicon(docs, rarest, share), "t")
    part = F.pmod("t", F.lit(PARTS))
    held = lambda bit: F.array_sort(F.collect_list(F.when(F.col("in").bitwiseAND(bit) > 0, F.col("t"))))
    parts = inside.repartition("row").groupBy("row", part.alias("part")).agg(F.first("step").alias("step"), F.first("step_edited").alias("step_edited"), held(1).alias("a"), held(2).alias("b"))

    def name(hashes: str, step: str, more: int) -> Column:
        left = thinned(F.col(hashes), F.col(step) + more)
        digest = F.substring(F.md5(F.array_join(F.transform(left, lambda t: t.cast("string")), ",").cast("binary")), 1, 4)
        return F.when(F.size(left) > 0, F.concat(F.lower(F.lpad(F.hex("part"), 2, "0")), digest))

    named = parts.select("row", *[name(c, s, k).alias(f"{c}{k}") for c, s in (("a", "step"), ("b", "step_edited")) for k in range(STEPS)])
    joined = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    signed = named.groupBy("row").agg(*[joined(f"{c}{k}").alias(f"{c}{k}") for c in "ab" for k in range(STEPS)])

    def printed(c: str, step: str, own: str) -> Column:
        return F.when(F.coalesce(F.col(f"{c}0"), F.lit("")) != "", F.concat_ws(";", F.col(step).cast("string"), *[f"{c}{k}" for k in range(STEPS)])).otherwise(F.concat(F.lit("="), F.col(own)))

    done = rows.drop("marked").join(signed, "row", "left").withColumns({"fingerprint": printed("a", "step", "own"), "edited_fingerprint": printed("b", "step_edited", "own_edited")})
    done = cut_lineage(done.select("doc_id", "next_id", "own", "own_next", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"))
    # the next document by its id and text; ids may be null, texts may repeat under one id
    known = lambda c: F.coalesce(c, F.lit(-(1 << 63)))
    after = done.groupBy(known(F.col("doc_id")).alias("k_id"), F.col("own").alias("k_own")).agg(F.min("fingerprint").alias("next_fingerprint"))
    j = done.join(after, (known(F.col("next_id")) == F.col("k_id")) & (F.col("own_next") == F.col("k_own")), "left")
    near = lambda other: likeness(F.col("fingerprint"), F.col(other))
    return j.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"))
