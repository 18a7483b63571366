"""From blocks and pages to fields, document kinds and sections.

All keys carry (doc_id, page, seq): order is data here, never arrival. Windows run within a document or page.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import columns as C
from docloom.functions import fixed


def page_class(chars: DataFrame, threshold: float = 0.80) -> DataFrame:
    """doc_id, page, coverage, class, of character boxes (doc_id, page, width, height, x0, top, x1, bottom).

    Coverage is the boxes' area by the page's, within 0 and 1; 0 for a page without area.
    """
    area = F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")) * F.greatest(F.lit(0.0), F.col("bottom") - F.col("top"))
    page = F.max("width") * F.max("height")
    ratio = F.when(page > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.sum(area), F.lit(0.0)) / page))).otherwise(F.lit(0.0))
    out = chars.groupBy("doc_id", "page").agg(F.round(ratio, 6).alias("coverage"))
    return out.withColumn("page_class", F.when(F.col("coverage") >= threshold, "DIGITAL").otherwise("SCANNED"))


def page_text(native: DataFrame, ocr: DataFrame, least: int = 50) -> DataFrame:
    """A page's own text, or the recognised one where the own has fewer than ``least`` characters and there is one."""
    j = native.join(ocr.withColumnRenamed("text", "__ocr").hint("merge"), ["doc_id", "page"], "left")
    short = (F.length(F.trim(F.coalesce("text", F.lit("")))) < least) & (F.coalesce("__ocr", F.lit("")) != "")
    return j.select("doc_id", "page", F.when(short, F.col("__ocr")).otherwise(F.coalesce("text", F.lit(""))).alias("text"))


def group_lines(blocks: DataFrame, gap: float = 5.0, separator: str = " ") -> DataFrame:
    """doc_id, page, line, text, x0, y0, x1, y1, of blocks in (page, seq) order.

    A block more than ``gap`` below or above the one before it starts a line.
    """
    w = Window.partitionBy("doc_id", "page").orderBy("seq")
    b = blocks.withColumn("__new", (F.abs(F.col("y0") - F.lag("y0").over(w)) > gap).cast("int"))
    b = b.withColumn("line", F.sum(F.coalesce("__new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return b.groupBy("doc_id", "page", "line").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), separator).alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )


def normalised(value: Column, how: str) -> Column:
    """A field's value as text by its normaliser."""
    return {
        "iban": C.normalise_iban,
        "date": C.parse_date,
        "swift_date": C.parse_swift_date,  # reads other dates too
        "amount": lambda v: C.parse_amount(v).cast("string"),
        "none": lambda v: v,
    }[how](value)


def best_lines(lines: DataFrame, patterns: Mapping[str, Sequence[str]], order: Sequence[str] = ("page", "seq"), text_of: Mapping[str, Column] | None = None, *keep: Column) -> tuple[DataFrame, dict[str, Column]]:
    """One row a document (and the aggregates ``keep``), and by field a struct of its name, its best line b (pattern's place k, order, text v) and pattern p.

    A pattern is run only where the ones before it have not hit in the line, and no pattern where the field's text is null.
    """
    text_of = text_of or {}

    def best_in_line(field: str, tries: Sequence[str]) -> Column:
        text = text_of.get(field, F.col("text"))
        hit = lambda p: F.nullif(F.regexp_extract(text, "(?im)" + p, 1), F.lit(""))
        return reduce(lambda c, kp: c.when(hit(kp[1]).isNotNull(), F.struct(F.lit(kp[0]).alias("k"), *[F.col(c) for c in order], hit(kp[1]).alias("v"))), enumerate(tries), F.when(text.isNull(), None))

    names = list(patterns)
    found = lines.groupBy("doc_id").agg(*keep, *[F.min(best_in_line(f, patterns[f])).alias(f"__{k}") for k, f in enumerate(names)])
    each = {f: F.struct(F.lit(f).alias("field"), F.col(f"__{k}").alias("b"), F.get(F.array(*[F.lit(p) for p in patterns[f]]), F.col(f"__{k}.k")).alias("p")) for k, f in enumerate(names)}
    return found, each


def read_fields(rows: DataFrame, fields: Sequence[str], order: Sequence[str], normalisers: Mapping[str, str], *more: str) -> DataFrame:
    """The columns of ``find_fields``, and ``more``, of rows (doc_id, field, b, p) as ``best_lines`` has them."""
    by_how: dict[str, list[str]] = {}
    for f in fields:
        by_how.setdefault(normalisers.get(f, "none"), []).append(f)
    value = reduce(lambda c, hf: c.when(F.col("field").isin(*hf[1]), normalised(F.col("b.v"), hf[0])), by_how.items(), F)
    # the one-element array keeps the normalisers from being copied into every later use of the value
    rows = rows.select("doc_id", *more, "field", "b", "p", F.explode(F.array(value)).alias("value"))
    return rows.select(
        "doc_id", "field", "value", F.col("b.v").alias("original_string"), F.lit(0.95).alias("confidence"), F.lit("native").alias("source"),
        F.concat(F.lit("pattern:"), F.col("p")).alias("rule"), *[F.col(f"b.{c}").alias(c) for c in order], *more,
    )


def find_fields(
    lines: DataFrame, patterns: Mapping[str, Sequence[str]], order: Sequence[str] = ("page", "seq"), normalisers: Mapping[str, str] | None = None, text_of: Mapping[str, Column] | None = None
) -> DataFrame:
    """doc_id, field, value, original_string, confidence, source, rule, and the order columns of the line.

    Patterns of a field are tried in order and each over all lines in order: the earliest pattern that fits anywhere
    wins, at its first line; group 1 must not be empty. One pass over the lines, each pattern run once a line: a line
    gives each field its best pattern, and an aggregate keeps the least (pattern, line) of a document; nothing is sorted
    or collected. ``text_of`` gives a field another text than the column ``text`` (null: not sought in that line).
    """
    found, each = best_lines(lines, patterns, order, text_of)
    rows = found.select("doc_id", F.explode(F.array(*each.values())).alias("f")).select("doc_id", "f.field", "f.b", "f.p").filter(F.col("b").isNotNull())
    return read_fields(rows, list(patterns), order, normalisers or fixed.NORMALISERS)


def abstentions(docs: DataFrame, found: DataFrame, fields: Sequence[str]) -> DataFrame:
    """doc_id, field, reason for every field that was sought and not found."""
    sought = docs.select("doc_id", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"))
    return sought.join(found.filter(F.col("value").isNotNull()).hint("merge"), ["doc_id", "field"], "left_anti").withColumn("reason", F.lit("ERR_EXTRACT_001"))


def kind_scores(text: Column, keywords: Mapping[str, Sequence[str]], negatives: Mapping[str, Sequence[str]] | None = None, bonus: Mapping[str, Column] | None = None) -> dict[str, Column]:
    """The score of each kind; ``text`` is lower-cased."""
    out = {}
    for kind, words in keywords.items():
        score = C.keyword_density(text, words)
        if bonus and kind in bonus:
            score = score + bonus[kind]
        out[kind] = C.penalised(text, score, negatives[kind]) if negatives and negatives.get(kind) else score
    return out


def best_kind(scores: Sequence[tuple[str, Column]]) -> Column:
    """K7: the kind of the largest score; of equals, the first given."""
    top = F.greatest(*[s for _, s in scores])
    return reduce(lambda c, ks: c.when(ks[1] == top, F.lit(ks[0])), scores, F)


def detect_kind(
    docs: DataFrame,
    keywords: Mapping[str, Sequence[str]] | None = None,
    negatives: Mapping[str, Sequence[str]] | None = None,
    markers: Mapping[str, Sequence[str]] | None = None,
    least: float = fixed.MIN_DENSITY,
    gap: float = fixed.GAP,
) -> DataFrame:
    """X11: doc_id, kind, score of documents (doc_id, text): unknown below ``least`` or without the gap to the second."""
    if keywords is None:
        keywords = {"swift_confirm": fixed.SWIFT_KEYWORDS, "bank_statement": fixed.BANK_KEYWORDS, "custody_statement": fixed.CUSTODY_KEYWORDS}
        negatives = {"swift_confirm": fixed.SWIFT_NEGATIVE, "bank_statement": fixed.BANK_NEGATIVE, "custody_statement": fixed.CUSTODY_NEGATIVE}
        markers = {"swift_confirm": fixed.SWIFT_MARKERS}
    low = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("__t"))
    t = F.col("__t")
    bonus = {k: F.when(C.sum_flags(t, m) >= 2, fixed.SWIFT_BONUS).otherwise(0.0) for k, m in (markers or {}).items()}
    scored = low.select("doc_id", *[s.alias(f"__{k}") for k, s in kind_scores(t, keywords, negatives, bonus).items()])
    ranked = F.sort_array(F.array(*[F.col(f"__{k}") for k in keywords]), asc=False)
    out = scored.withColumn("__r", ranked).withColumn("__best", best_kind([(k, F.col(f"__{k}")) for k in keywords]))
    top, second = F.get("__r", F.lit(0)), F.coalesce(F.get("__r", F.lit(1)), F.lit(0.0))
    known = (top >= least) & ~((second > 0) & (top < F.lit(gap) * second))
    # the one-element array keeps the scores from being copied into every later filter on the kind
    decided = F.struct(F.when(known, F.col("__best")).otherwise("unknown").alias("kind"), F.round(top, 8).alias("score"))
    return out.select("doc_id", F.explode(F.array(decided)).alias("__d")).select("doc_id", "__d.kind", "__d.score")


def page_profiles(pages: DataFrame, keywords: Mapping[str, Sequence[str]]) -> DataFrame:
    """doc_id, page, a score for each kind, and the page's dominant kind (unknown at 0.005 or less)."""
    low = pages.select("doc_id", "page", F.lower(F.coalesce("text", F.lit(""))).alias("__t"))
    out = low.select("doc_id", "page", *[s.alias(k) for k, s in kind_scores(F.col("__t"), keywords).items()])
    out = out.withColumn("top", F.greatest(*[F.col(k) for k in keywords]))
    return out.withColumn("kind", F.when(F.col("top") > fixed.PAGE_DOMINANT, best_kind([(k, F.col(k)) for k in keywords])).otherwise("unknown"))


def sections(profiles: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """doc_id, section, start_page, end_page, kind, confidence.

    A section ends between neighbouring pages of different known kinds that both score above 0.02. Its kind is the one
    with the largest sum of scores (above 0.01), its confidence that kind's mean; for an unknown kind, 0. The only
    page of a document keeps its own kind and best score.
    """
    w = Window.partitionBy("doc_id").orderBy("page")
    known = (F.col("kind") != "unknown") & (F.lag("kind").over(w) != "unknown")
    edge = known & (F.col("kind") != F.lag("kind").over(w)) & (F.col("top") > fixed.PAGE_BOUNDARY) & (F.lag("top").over(w) > fixed.PAGE_BOUNDARY)
    p = profiles.withColumn("__edge", F.coalesce(edge.cast("int"), F.lit(0)))
    p = p.withColumn("section", F.sum("__edge").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__pages", F.count("*").over(Window.partitionBy("doc_id")))
    g = p.groupBy("doc_id", "section").agg(
        F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.max("__pages").alias("__pages"), F.count("*").alias("__n"),
        *[F.sum(k).alias(k) for k in kinds], F.max("top").alias("__top"), F.min("kind").alias("__own"),
    )
    total = F.greatest(*[F.col(k) for k in kinds])
    voted = F.when(total > fixed.SECTION_DOMINANT, best_kind([(k, F.col(k)) for k in kinds])).otherwise("unknown")
    single = F.col("__pages") == 1
    kind = F.when(single, F.col("__own")).otherwise(voted)
    confidence = F.when(single, F.col("__top")).when(voted == "unknown", F.lit(0.0)).otherwise(total / F.col("__n"))
    return g.select("doc_id", F.col("section").cast("bigint").alias("section"), "start_page", "end_page", kind.alias("kind"), F.round(confidence, 8).alias("confidence"))


def relevant_pages(summaries: DataFrame, flags: Sequence[str]) -> DataFrame:
    """pages with any flag set."""
    return summaries.filter(reduce(lambda a, b: a | b, [F.coalesce(F.col(f), F.lit(False)) for f in flags]))


def signature_overlap(a: Column, b: Column, words: int = 20) -> Column:
    """Jaccard of the first words of two header texts, 0 if either has none."""
    x, y = (F.array_distinct(F.slice(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""), 1, words)) for c in (a, b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))
