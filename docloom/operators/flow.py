"""The whole way of documents: order, kind, fields, tables, abstentions, checks, record."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import columns as C
from docloom.functions import fixed
from docloom.shared import checkpointed
from docloom.sources import files
from docloom.sources.keyed import KeyedTable

from . import discovery, documents, fallback, layout, model_io, record, tables, validators


@dataclass
class Extraction:
    """What a run leaves: lazily built tables by doc_id. ``outcomes`` has fields and abstentions with their kinds, from one pass."""

    kinds: DataFrame
    fields: DataFrame
    tables: DataFrame
    abstentions: DataFrame
    failures: DataFrame
    summary: DataFrame
    outcomes: DataFrame


def assemble(blocks: DataFrame, page_tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of the blocks in reading order, and tables stitched across pages."""
    ordered = layout.order_blocks(blocks).drop("seq").withColumnRenamed("reading_seq", "seq")
    lines = documents.group_lines(ordered).withColumn("seq", F.col("line"))
    return lines, tables.stitch_tables(page_tables)


def route_fields(lines: DataFrame, kinds: DataFrame, patterns: Mapping[str, Mapping[str, Sequence[str]]] = fixed.PATTERNS, order: Sequence[str] = ("page", "seq")) -> DataFrame:
    """doc_id, kind, field, reason and the columns of ``find_fields``: each field that a document's kind has, by that kind's patterns.

    One pass for all kinds, fields that are found and those that are not (value null, with a reason): a field sees the
    lines of its kind's documents only. Documents of unknown kind have the field document_kind. Field names differ between kinds.
    """
    routed = kinds.select("doc_id", "kind").hint("merge").join(lines, "doc_id", "left")
    fields = {f: tries for group in patterns.values() for f, tries in group.items()}
    text_of = {f: F.when(F.col("kind") == kind, F.col("text")) for kind, group in patterns.items() for f in group}
    found, each = documents.best_lines(routed, fields, order, text_of, F.max("kind").alias("kind"))
    some = next(iter(each.values()))
    none = F.array(F.struct(F.lit("document_kind").alias("field"), F.when(F.lit(False), some["b"]).alias("b"), F.lit(None).cast("string").alias("p")))
    sought = reduce(lambda c, kf: c.when(F.col("kind") == kf[0], F.array(*[each[f] for f in kf[1]])), patterns.items(), F).otherwise(none)
    rows = found.select("doc_id", "kind", F.explode(sought).alias("f")).select("doc_id", "kind", "f.field", "f.b", "f.p")
    reason = F.when(F.col("value").isNull(), F.when(F.col("field") == "document_kind", "ERR_EXTRACT_002").otherwise("ERR_EXTRACT_001"))
    return documents.read_fields(rows, list(fields), order, fixed.NORMALISERS, "kind").withColumn("reason", reason)


def concatenate(*parts: DataFrame) -> DataFrame:
    """sections' or windows' rows as one table; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def process(lines: DataFrame, page_tables: DataFrame | None = None, as_of: str | None = None, hints: DataFrame | None = None) -> Extraction:
    """Everything about documents from their lines (doc_id, page, seq, text) and tables, for all documents at once.

    A field whose normaliser cannot read its text is an abstention, never a failed run. ``hints`` (doc_id, kind) spare the
    documents whose kind they know the detection.
    """
    unsure = lines if hints is None else lines.join(hints.filter("kind = 'unknown'").select("doc_id"), "doc_id", "left_semi")
    texts = unsure.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "seq", "text"))), lambda x: x["text"]), " ").alias("text"))
    kinds = documents.detect_kind(texts)
    if hints is not None:
        kinds = kinds.unionByName(hints.filter("kind <> 'unknown'").select("doc_id", "kind"), allowMissingColumns=True)
    outcomes = route_fields(lines, kinds)
    fields = outcomes.filter(F.col("value").isNotNull()).drop("kind", "reason")
    missing = outcomes.filter(F.col("value").isNull()).select("doc_id", "field", "reason")
    checks = [validators.identifiers(fields)] + ([validators.dates(fields, as_of)] if as_of else [])
    failures = validators.all_failures(*checks)
    found = fields.limit(0).select("doc_id")
    if page_tables is not None:
        kept = page_tables.join(kinds.select("doc_id", "kind").hint("merge"), "doc_id")
        found = reduce(DataFrame.unionByName, [tables.best_table(kept.filter(F.col("kind") == k), h) for k, h in fixed.TABLE_HEADERS.items()])
    summary = record.confidence_summary(kinds, fields.withColumns({"vlm_used": F.lit(False), "has_data": F.lit(False)}), missing)
    return Extraction(kinds, fields, found, missing, failures, summary, outcomes)


@dataclass
class Run:
    """What the whole way leaves, by doc_id; ``calls`` are the model's calls with their tokens, ``sections`` the parts with their final kinds."""

    kinds: DataFrame
    sections: DataFrame
    fields: DataFrame
    tables: DataFrame
    abstentions: DataFrame
    failures: DataFrame
    calls: DataFrame
    summary: DataFrame


# The fields that a document of unknown kind is asked for.
GENERIC_FIELDS = ("institution", "client_name", "account_number", "statement_date", "opening_balance", "closing_balance")
KEYWORDS = {"bank_statement": fixed.BANK_KEYWORDS, "custody_statement": fixed.CUSTODY_KEYWORDS, "swift_confirm": fixed.SWIFT_KEYWORDS}
FIELDS = ("doc_id", "field", "value", "confidence", "source", "rule", "page", "bbox")


def page_texts(lines: DataFrame) -> DataFrame:
    """doc_id, page, text of lines (doc_id, page, seq, text)."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return lines.groupBy("doc_id", "page").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def by_section(lines: DataFrame, sections: DataFrame) -> DataFrame:
    """Lines (doc_id, page, seq, text) with the section of their page as part of the key: doc_id is {doc_id, section}, pages are numbered from the section's first."""
    at = model_io.section_pages(sections.select("doc_id", "section", "start_page", "end_page"), lines.select("doc_id", "page").distinct())
    return lines.join(at.hint("merge"), ["doc_id", "page"]).select(F.struct("doc_id", "section").alias("doc_id"), (F.col("page") - F.col("start_page") + 1).alias("page"), "seq", "text")


def _of_documents(by_unit: DataFrame) -> DataFrame:
    """doc_id and section as columns of their own again."""
    return by_unit.withColumns({"section": F.col("doc_id.section"), "doc_id": F.col("doc_id.doc_id")})


def joined_sections(fields: DataFrame, abstained: DataFrame, kinds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sections' fields, abstentions and kinds (each with section) as those of their documents.

    A field is that of the first section with a value; an abstention stays if no section has a value; the kind is the
    first known one.
    """
    rest = [c for c in fields.columns if c not in ("doc_id", "section", "field")]
    first = fields.filter(F.col("value").isNotNull()).groupBy("doc_id", "field").agg(F.min_by(F.struct(*rest), "section").alias("b")).select("doc_id", "field", "b.*")
    one = abstained.groupBy("doc_id", "field").agg(F.min_by("reason", "section").alias("reason"))
    kind = kinds.groupBy("doc_id").agg(F.coalesce(F.min_by("kind", F.when(F.col("kind") != "unknown", F.col("section"))), F.lit("unknown")).alias("kind"))
    return first, record.still_open(one, first), kind


def checked(kinds: DataFrame, fields: DataFrame, found_tables: DataFrame, pages: DataFrame, as_of: str | None = None) -> DataFrame:
    """All twelve checks over documents' fields (with page and bbox) and tables.

    A bank statement with an account number is an account: its balances and totals are its fields, its transactions the
    rows of its tables with debit and credit columns.
    """
    number = lambda f: F.max(F.when(F.col("field") == f, C.to_float(F.col("value"))))
    wide = fields.join(kinds.filter("kind = 'bank_statement'").hint("merge"), "doc_id").groupBy("doc_id", "kind").agg(
        number("opening_balance").alias("opening"), number("closing_balance").alias("closing"), number("total_debits").alias("total_debits"), number("total_credits").alias("total_credits"),
        F.max(F.when(F.col("field") == "account_number", F.col("value"))).alias("account_number"),
    )
    wide = checkpointed(wide)
    txns = checkpointed(validators.table_transactions(found_tables))
    accounts = wide.filter(F.col("account_number").isNotNull()).withColumnRenamed("doc_id", "acct_id")
    of_accounts = txns.withColumnRenamed("doc_id", "acct_id").join(accounts.select("acct_id").hint("merge"), "acct_id", "left_semi")
    totals = pages.groupBy("doc_id").agg(F.max("page").alias("total_pages"))
    parts = [
        validators.arithmetic_totals(wide, txns), validators.identifiers(fields), validators.provenance(fields.join(totals.hint("merge"), "doc_id", "left")),
        validators.running_balance(of_accounts), validators.reconciliation(accounts, of_accounts), validators.column_types(of_accounts), validators.completeness(accounts, of_accounts), validators.totals_crosscheck(accounts, of_accounts),
    ]
    return validators.all_failures(*parts, *([validators.dates(fields, as_of)] if as_of else []))


def retried(pages: DataFrame, kinds: DataFrame, fields: DataFrame, abstained: DataFrame, ask: Callable[[DataFrame], DataFrame], tenants: DataFrame, cache: KeyedTable, as_of: str, **budget) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents with more abstentions than fields get one more round: fields, abstentions, kinds, calls after it.

    A diagnosis is asked for; where it recommends auto_discovery, the whole document goes the way of unknown ones, and
    its outcome replaces the first only if it has more fields. There is no third round.
    """
    count = lambda d, n: d.groupBy("doc_id").agg(F.count("*").alias(n))
    both = kinds.select("doc_id").join(count(fields, "fields_extracted").hint("merge"), "doc_id", "left").join(count(abstained.filter(F.col("field").isNotNull()), "fields_abstained").hint("merge"), "doc_id", "left").na.fill(0, ["fields_extracted", "fields_abstained"])
    again = checkpointed(record.needs_retry(both).filter("retry").select("doc_id"))
    answered = ask(discovery.diagnosis_requests(pages.join(again.hint("merge"), "doc_id", "left_semi"), kinds, fields, abstained))
    sent = checkpointed(discovery.diagnosed(answered).filter("strategy = 'auto_discovery'").select("doc_id"))
    second = discovery.discover(pages.join(sent.hint("merge"), "doc_id", "left_semi"), tenants.join(sent.hint("merge"), "doc_id", "left_semi"), ask, cache, as_of, **budget)
    new = checkpointed(fields.limit(0).unionByName(_placed(second.fields)))
    n = lambda d, c: d.groupBy("doc_id").agg(F.count("*").alias(c))
    better = checkpointed(n(new, "__r").join(n(fields, "__f").hint("merge"), "doc_id", "left").filter(F.col("__r") > F.coalesce("__f", F.lit(0))).select("doc_id"))
    pick = lambda old, fresh: old.join(better.hint("merge"), "doc_id", "left_anti").unionByName(fresh.join(better.hint("merge"), "doc_id", "left_semi"))
    return checkpointed(record.keep_better(fields, new)), pick(abstained, second.open), pick(kinds.select("doc_id", "kind"), second.kinds), second.calls


def _placed(model: DataFrame) -> DataFrame:
    """A model's fields with the place that stands for none: the first page and an empty box."""
    return model.select("doc_id", "field", "value", "confidence", "source", "rule", F.lit(1).cast("bigint").alias("page"), F.array(*[F.lit(0.0)] * 4).alias("bbox"))


def run(
    blocks: DataFrame, rail_a: DataFrame, rail_b: DataFrame, ask: Callable[[DataFrame], DataFrame], as_of: str, tenants: DataFrame | None = None, cache: KeyedTable | None = None, **budget
) -> Run:
    """Blocks and two readings of the tables to records, for all documents at once.

    Blocks are put in reading order and lines; pages make sections, and each section has its own kind, fields by that
    kind's patterns, and model fallback. A section of a known kind without any field counts as unknown. Sections of
    unknown kind are asked for six usual fields or, with a schema cache and tenants (doc_id, tenant_id), for what their
    discovered schema names. Then sections are joined, poor documents retried, and all checks run over fields, accounts
    and tables. Tables are those of rail A, rail B's where A found none, stitched; where both have one their cells are
    compared. ``ask`` takes calls (doc_id, prompt, prompt_key, ...) and returns them with reply; ``budget`` goes to the fallback.
    """
    ordered, stitched = assemble(blocks, files.with_fallback(rail_a, rail_b))
    boxed = checkpointed(ordered.select("doc_id", F.col("page").cast("bigint").alias("page"), "seq", "text", F.array("x0", "y0", "x1", "y1").alias("bbox")))
    lines = boxed.drop("bbox")
    pages = checkpointed(page_texts(lines))
    parts = checkpointed(documents.sections(documents.page_profiles(pages, KEYWORDS), list(KEYWORDS)))
    unit_lines = checkpointed(by_section(lines, parts))
    first = process(unit_lines, None, None, parts.select(F.struct("doc_id", "section").alias("doc_id"), "kind"))
    kinds = checkpointed(first.kinds.select("doc_id", "kind"))
    outcomes = checkpointed(first.outcomes.select("doc_id", "field", "value", "confidence", "source", "rule", "page", "seq", "reason"))
    missing = outcomes.filter(F.col("value").isNull()).select("doc_id", "field", "reason")
    native = outcomes.filter(F.col("value").isNotNull()).drop("reason")
    unit_pages = checkpointed(page_texts(unit_lines))
    # a known kind without any field is none
    empty = kinds.filter("kind <> 'unknown'").join(native.select("doc_id").distinct().hint("merge"), "doc_id", "left_anti").withColumn("__empty", F.lit(True))
    routed = checkpointed(kinds.join(empty.select("doc_id", "__empty").hint("merge"), "doc_id", "left").select("doc_id", F.when(F.col("__empty"), "unknown").otherwise(F.col("kind")).alias("kind"), (F.col("kind") == "unknown").alias("unrouted")))
    wanted = missing.filter(F.col("field") != "document_kind").select("doc_id", "field")
    strange = routed.filter("unrouted").select("doc_id")
    found, refused, renamed, calls = None, None, None, None
    if cache is not None and tenants is not None:
        of_unit = strange.withColumn("__d", F.col("doc_id.doc_id")).join(tenants.select(F.col("doc_id").alias("__d"), "tenant_id").hint("merge"), "__d").select("doc_id", "tenant_id")
        seen = discovery.discover(unit_pages.join(strange.hint("merge"), "doc_id", "left_semi"), of_unit, ask, cache, as_of, **budget)
        found, refused, renamed, calls = seen.fields, seen.open, seen.kinds, seen.calls
    else:
        wanted = wanted.unionByName(strange.select("doc_id", F.explode(F.array(*[F.lit(f) for f in GENERIC_FIELDS])).alias("field")))
    got = fallback.run(unit_pages, wanted, ask, **budget)
    model = checkpointed(_placed(got.fields if found is None else got.fields.unionByName(found)))
    # native fields stand where their line stands; the model's take their place if there are both
    start = parts.select(F.struct("doc_id", "section").alias("doc_id"), "start_page")
    placed = _of_documents(native.join(start.hint("merge"), "doc_id").withColumn("page", F.col("page") + F.col("start_page") - 1).join(model.select("doc_id", "field").hint("merge"), ["doc_id", "field"], "left_anti").drop("start_page"))
    placed = placed.join(boxed.select("doc_id", "page", "seq", "bbox").hint("merge"), ["doc_id", "page", "seq"], "left").select("section", *FIELDS)
    unit_fields = checkpointed(placed.unionByName(_of_documents(model).select("section", *FIELDS)))
    # an unknown section that a model found fields for has the kind that it names, else that of a bank statement
    named = model.groupBy("doc_id").agg(F.coalesce(F.max(F.when(F.col("field") == "document_type", F.col("value"))), F.lit("bank_statement")).alias("__named"))
    if renamed is not None:
        named = renamed.select("doc_id", F.col("kind").alias("__named")).join(model.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").unionByName(named.join(renamed.select("doc_id").hint("merge"), "doc_id", "left_anti"))
    now = routed.join(named.hint("merge"), "doc_id", "left").select("doc_id", F.when(F.col("kind") == "unknown", F.coalesce("__named", F.lit("unknown"))).otherwise(F.col("kind")).alias("kind"))
    unit_kinds = checkpointed(_of_documents(now))
    left = got.open if refused is None else got.open.unionByName(refused)
    fields, abstained, doc_kinds = joined_sections(unit_fields, _of_documents(left), unit_kinds)
    fields, abstained, doc_kinds = checkpointed(fields.select(*FIELDS)), checkpointed(abstained), checkpointed(doc_kinds)
    all_calls = _of_documents(got.calls if calls is None else got.calls.unionByName(calls))
    if cache is not None and tenants is not None:
        fields, abstained, doc_kinds, more = retried(pages, doc_kinds, fields, abstained, ask, tenants, cache, as_of, **budget)
        all_calls = all_calls.unionByName(more.withColumn("section", F.lit(None).cast("bigint")))
        abstained, doc_kinds = checkpointed(abstained), checkpointed(doc_kinds)
    pairs = tables.pair_rails(rail_a, rail_b).withColumn("table_key", F.concat_ws(":", "doc_id", "page", "table_seq")).filter(F.col("b_table_seq").isNotNull())
    other = pairs.select("doc_id", "page", F.col("b_table_seq").alias("table_seq"), "table_key").join(rail_b.hint("merge"), ["doc_id", "page", "table_seq"])
    judged = pairs.select("doc_id", "table_key").join(tables.triangulate(tables.cells(pairs, "table_key"), tables.cells(other, "table_key")).hint("merge"), "table_key")
    failures = checked(doc_kinds, fields, stitched, pages, as_of)
    marked = fields.withColumns({"vlm_used": F.col("source") == "vlm", "has_data": F.lit(False)})
    summary = record.confidence_summary(doc_kinds, marked, abstained, judged).join(doc_kinds.hint("merge"), "doc_id")
    return Run(doc_kinds, parts.drop("kind").join(unit_kinds.hint("merge"), ["doc_id", "section"]), fields, stitched, abstained, failures, all_calls, summary)
