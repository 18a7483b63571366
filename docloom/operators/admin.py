"""Operational analytics: usage, cost, logs, alerts, batches, failure patterns, schema performance.

Every read takes the tenant as a parameter (None: all) and time intervals are half-open. Groupings use partial
aggregation; the only windows are over a rule, a tenant or a schema.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Prices a thousand tokens, severities in ascending order, their other spellings.
PRICE_IN, PRICE_OUT = 0.003, 0.015
SEVERITIES = ("debug", "info", "warning", "error", "critical")
SEVERITY_ALIASES = {"warn": "warning", "err": "error", "fatal": "critical", "crit": "critical"}
TERMINAL = ("complete", "failed", "partial")


def for_tenant(df: DataFrame, tenant: str, column: str = "tenant_id") -> DataFrame:
    """the rows of one tenant. Reads on behalf of a tenant go through here; without a tenant there is no read."""
    if not tenant or not isinstance(tenant, str):
        raise ValueError("a tenant's read needs the tenant")
    return df.filter(F.col(column) == tenant)


def usage_filter(df: DataFrame, tenant: str | None = None, job: str | None = None, model: str | None = None, start=None, end=None) -> DataFrame:
    """usage rows of a tenant, job and model within [start, end)."""
    for column, value in (("tenant_id", tenant), ("job_id", job), ("model_id", model)):
        if value is not None:
            df = df.filter(F.col(column) == value)
    if start is not None:
        df = df.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return df if end is None else df.filter(F.col("ts") < F.lit(end).cast("timestamp_ntz"))


def cost(input_tokens: Column, output_tokens: Column, price_in: float = PRICE_IN, price_out: float = PRICE_OUT) -> Column:
    """Cost of summed tokens; never a sum of rounded row costs."""
    return F.round(input_tokens * price_in / 1000 + output_tokens * price_out / 1000, 6)


def usage_totals(df: DataFrame, *keys: str | Column) -> DataFrame:
    """A3, A4: requests, tokens and cost, in total or by key."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("requests"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        cost(F.sum("input_tokens"), F.sum("output_tokens")).alias("estimated_cost"),
    )


def usage_timeseries(df: DataFrame, granularity: str = "day") -> DataFrame:
    """A5, T4: totals by day, week (from Monday) or month, in time order."""
    if granularity not in ("day", "week", "month"):
        raise ValueError("granularity is day, week or month")
    bucket = F.date_format(F.date_trunc(granularity, "ts"), "yyyy-MM-dd").alias("period")
    return usage_totals(df, bucket).orderBy("period")


def share_of_peak(df: DataFrame, value: str = "total_tokens") -> DataFrame:
    """Each bucket in percent of the largest; for aggregated buckets, few by construction."""
    peak = df.agg(F.max(value).alias("peak"))
    return df.join(F.broadcast(peak)).withColumn("percent", F.round(F.coalesce(F.try_divide(F.col(value) * 100.0, F.col("peak")), F.lit(0.0)), 4)).drop("peak")


def history_filter(df: DataFrame, rule: int | None = None, open_only: bool = False, statuses: tuple[str, ...] = (), tenant: str | None = None) -> DataFrame:
    """alert history of a rule, of a tenant, open rows only; or jobs of some statuses."""
    if rule is not None:
        df = df.filter(F.col("rule_id") == rule)
    if tenant is not None:
        df = df.filter(F.col("tenant_id") == tenant)
    if open_only:
        df = df.filter(F.col("resolved_at").isNull())
    return df.filter(F.col("status").isin(*statuses)) if statuses else df


def job_overview(jobs: DataFrame, usage: DataFrame, tenants: DataFrame) -> DataFrame:
    """Each job with its tenant's name and its calls; usage is summed by job before it is joined."""
    spent = usage.groupBy("job_id").agg(F.count("*").alias("calls"), F.sum("total_tokens").alias("tokens"))
    j = jobs.join(spent, "job_id", "left").join(tenants, "tenant_id", "left")
    return j.withColumns({"calls": F.coalesce("calls", F.lit(0)), "tokens": F.coalesce("tokens", F.lit(0))})


def job_relations(jobs: DataFrame, tenants: DataFrame, batches: DataFrame, results: DataFrame, feedback: DataFrame, usage: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Each job (job_id, tenant_id, batch_id, ...) with tenant and batch_status, fields_extracted of its last result
    (created_at), the number and mean rating of feedback, calls and tokens, and the last attempt's delivery_status.

    Tables with many rows a job are reduced to one before they are joined, so that a busy job is not a wide join.
    """
    one = (
        results.groupBy("job_id").agg(F.max_by("fields_extracted", F.struct("created_at", "fields_extracted")).alias("fields_extracted")),
        feedback.groupBy("job_id").agg(F.count("*").alias("feedback"), F.round(F.avg("rating"), 4).alias("rating")),
        usage.groupBy("job_id").agg(F.count("*").alias("calls"), F.sum("total_tokens").alias("tokens")),
        deliveries.groupBy("job_id").agg(F.max_by("status", F.struct("attempt", "status")).alias("delivery_status")),
    )
    out = reduce(lambda d, t: d.join(t, "job_id", "left"), one, jobs)
    out = out.join(tenants.select("tenant_id", "tenant"), "tenant_id", "left").join(batches.select("batch_id", "batch_status"), "batch_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("feedback", "calls", "tokens")})


def users_with_roles(users: DataFrame, roles: DataFrame) -> DataFrame:
    """Users (user_id) with their distinct roles (user_id, tenant_id, role) as a sorted array; empty without any."""
    g = roles.groupBy("user_id").agg(F.array_sort(F.collect_set(F.struct("tenant_id", "role"))).alias("roles"))
    return users.join(g, "user_id", "left").withColumn("roles", F.coalesce("roles", F.array().cast("array<struct<tenant_id:string,role:string>>")))


def rules_with_history(rules: DataFrame, history: DataFrame) -> DataFrame:
    """Rules (rule_id) with firings, open ones and the last time of firing, of history (rule_id, fired_at, resolved_at)."""
    g = history.groupBy("rule_id").agg(F.count("*").alias("firings"), F.count_if(F.col("resolved_at").isNull()).alias("open"), F.max("fired_at").alias("last_fired_at"))
    return rules.join(g, "rule_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("firings", "open")})


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 50, largest: int = 200) -> DataFrame:
    """One page of an ordered list, ties broken by the order given; size within 1..largest."""
    size = min(max(size, 1), largest)
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def page_count(df: DataFrame, size: int = 50) -> DataFrame:
    """K2: rows and pages."""
    return df.agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size).cast("bigint"))


def severity(column: Column) -> Column:
    """F8: usual spellings to five severities; anything else is info."""
    low = F.lower(F.trim(column))
    known = F.when(low.isin(*SEVERITIES), low)
    for alias, name in SEVERITY_ALIASES.items():
        known = known.when(low == alias, F.lit(name))
    return known.otherwise(F.lit("info"))


def severity_rank(column: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), column)


def log_filter(df: DataFrame, minimum: str = "debug", tenant: str | None = None, trace: str | None = None, start=None, end=None) -> DataFrame:
    """Entries of at least a severity, of a tenant and trace, within [start, end) as timestamps."""
    df = df.withColumn("severity", severity(F.col("severity"))).filter(severity_rank(F.col("severity")) >= SEVERITIES.index(minimum) + 1)
    for column, value in (("tenant_id", tenant), ("trace_id", trace)):
        if value is not None:
            df = df.filter(F.col(column) == value)
    if start is not None:
        df = df.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return df if end is None else df.filter(F.col("ts") < F.lit(end).cast("timestamp_ntz"))


def period_start(as_of: Column, period: Column) -> Column:
    """T5: start of the billing week, or of the month for any other period."""
    return F.when(period == "weekly", F.date_trunc("week", as_of)).otherwise(F.date_trunc("month", as_of)).cast("timestamp_ntz")


def budget_alerts(rules: DataFrame, usage: DataFrame, as_of: str) -> DataFrame:
    """A6, J11, ST2: rule_id, used, breached for budget rules (rule_id, tenant_id, threshold_tokens, billing_period).

    Usage is first summed by tenant and period (partial aggregation); rules of all tenants (null) see every sum. Rules
    are a configuration table and may be broadcast by size; the sums are few.
    """
    at = F.lit(as_of).cast("timestamp_ntz")
    sums = []
    for period in ("weekly", "monthly"):
        inside = usage.filter((F.col("ts") >= period_start(at, F.lit(period))) & (F.col("ts") <= at))
        sums.append(inside.groupBy("tenant_id").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("used")).withColumn("period", F.lit(period)))
    spent = sums[0].union(sums[1])
    everyone = spent.groupBy("period").agg(F.sum("used").alias("used")).select(F.lit("*").alias("tenant_id"), "used", "period")
    r = rules.withColumn("period", F.when(F.col("billing_period") == "weekly", "weekly").otherwise("monthly")).withColumn("tenant_id", F.coalesce("tenant_id", F.lit("*")))
    out = r.join(spent.unionByName(everyone), ["tenant_id", "period"], "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return out.select("rule_id", "used", (F.col("used") >= F.col("threshold_tokens")).alias("breached"))


def error_rates(jobs: DataFrame, as_of: str, minutes: int, *keys: str) -> DataFrame:
    """Failed and all jobs of the trailing window, both ends included, and their rate in percent, 0 where there are none."""
    at = F.lit(as_of).cast("timestamp_ntz")
    inside = jobs.filter((F.col("created_at") >= at - F.make_interval(mins=F.lit(minutes))) & (F.col("created_at") <= at))
    rate = F.round(F.coalesce(F.try_divide(F.count_if(F.col("status") == "failed") * 100.0, F.count("*")), F.lit(0.0)), 4)
    return inside.groupBy(*keys).agg(F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("total"), rate.alias("error_rate"))


def error_rate_alerts(rules: DataFrame, jobs: DataFrame, as_of: str) -> DataFrame:
    """ST3: rule_id, failed, total, error_rate, breached for rules (rule_id, tenant_id, threshold_percent, window_minutes).

    A rule without a tenant sees all jobs. Jobs meet the distinct window lengths of their tenant, not the rules, and are
    summed before rules are joined. Breached is a rate above the threshold.
    """
    at = F.lit(as_of).cast("timestamp_ntz")
    r = rules.withColumn("tenant_id", F.coalesce("tenant_id", F.lit("*")))
    windows = r.select("tenant_id", "window_minutes").distinct()
    seen = jobs.filter(F.col("created_at") <= at).select(F.explode(F.array("tenant_id", F.lit("*"))).alias("tenant_id"), "status", "created_at")
    inside = seen.join(windows, "tenant_id").filter(F.col("created_at") >= at - F.make_interval(mins=F.col("window_minutes")))
    sums = inside.groupBy("tenant_id", "window_minutes").agg(F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("total"))
    j = r.join(sums, ["tenant_id", "window_minutes"], "left").withColumns({"failed": F.coalesce("failed", F.lit(0)), "total": F.coalesce("total", F.lit(0))})
    rate = F.coalesce(F.try_divide(F.col("failed") * 100.0, F.col("total")), F.lit(0.0))
    return j.select("rule_id", "failed", "total", F.round(rate, 4).alias("error_rate"), (rate > F.col("threshold_percent")).alias("breached"))


def batch_status(jobs: DataFrame) -> DataFrame:
    """batch_id, jobs, complete, failed, and whether all jobs have ended."""
    return jobs.groupBy("batch_id").agg(
        F.count("*").alias("jobs"),
        F.count_if(F.col("status") == "complete").alias("complete"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.bool_and(F.col("status").isin(*TERMINAL)).alias("finished"),
    )


def feedback_review(feedback: DataFrame, jobs: DataFrame, since: str) -> DataFrame:
    """Corrections by schema and field since a day: how many, their mean confidence, how many critical."""
    recent = feedback.filter(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    joined = recent.join(jobs.select("job_id", "schema_type"), "job_id")
    return joined.groupBy("schema_type", "field_name").agg(
        F.count("*").alias("corrections"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count_if("is_critical").alias("critical")
    )


def latest_failures(df: DataFrame, keep: int = 1000) -> DataFrame:
    """The last failures by time."""
    return df.orderBy(F.desc("ts"), F.desc("id")).limit(keep)


def failure_patterns(df: DataFrame, by_field: int = 3, by_schema: int = 5, by_code: int = 10, least: int = 5) -> DataFrame:
    """Category, subject, failures, priority, of fields of an institution, model failures of a schema, codes.

    Nothing is reported for fewer than ``least`` failures in all.
    """
    field = df.filter(F.col("institution").isNotNull() & F.col("field_name").isNotNull())
    field = field.groupBy(F.concat_ws("/", "institution", "field_name").alias("subject")).agg(F.count("*").alias("failures"))
    field = field.filter(F.col("failures") >= by_field).withColumns({"category": F.lit("field_pattern"), "priority": F.when(F.col("failures") >= 5, "high").otherwise("medium")})
    schema = df.filter(F.col("error_code").isin("ERR_VLM_003", "ERR_EXTRACT_002")).groupBy(F.col("schema_type").alias("subject")).agg(F.count("*").alias("failures"))
    schema = schema.filter(F.col("failures") >= by_schema).withColumns({"category": F.lit("schema_coverage"), "priority": F.lit("high")})
    code = df.groupBy(F.col("error_code").alias("subject")).agg(F.count("*").alias("failures"))
    code = code.filter(F.col("failures") >= by_code).withColumns({"category": F.lit("error_code"), "priority": F.when(F.col("failures") >= 20, "high").otherwise("medium")})
    enough = df.agg((F.count("*") >= least).alias("enough")).filter("enough")
    return field.unionByName(schema).unionByName(code).join(F.broadcast(enough)).drop("enough")


def suggestions(found: DataFrame, keep: int = 50, prefix: int = 50) -> DataFrame:
    """One suggestion (category, description, priority, seq) for each category and first 50 characters of the
    description, the first of equals; of those the last 50. Input: category, description, priority, seq.
    """
    g = found.groupBy("category", F.substring("description", 1, prefix).alias("__start")).agg(F.min(F.struct("seq", "description", "priority")).alias("s"))
    return g.select("category", "s.description", "s.priority", "s.seq").orderBy(F.desc("seq"), F.desc("category")).limit(keep)


def schema_performance(runs: DataFrame, order: str = "ts") -> DataFrame:
    """schema_key, uses, successes, rate, stable (sticky), needs_refinement, of runs (schema_key, extracted, total).

    A run succeeds if at least half of its fields came out. A schema is stable from the first moment that it has 10 uses
    at 0.95 or better, and stays so; it needs refinement at 5 uses or more below 0.70 unless stable.
    """
    ok = F.when(F.coalesce(F.try_divide(F.col("extracted").cast("double"), F.col("total").cast("double")), F.lit(0.0)) >= 0.5, 1).otherwise(0)
    # a busy schema's runs are cut by day: what earlier days sum to is added to the running counts of a day
    r = runs.withColumns({"__ok": ok, "__day": F.coalesce(F.to_date(order), F.lit("0001-01-01").cast("date"))})
    days = r.groupBy("schema_key", "__day").agg(F.count("*").alias("__dn"), F.sum("__ok").alias("__ds"))
    before = Window.partitionBy("schema_key").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    days = days.select("schema_key", "__day", earlier("__dn").alias("__bn"), earlier("__ds").alias("__bs"))
    w = Window.partitionBy("schema_key", "__day").orderBy(order, "id").rowsBetween(Window.unboundedPreceding, 0)
    r = r.join(days, ["schema_key", "__day"])
    r = r.withColumn("__n", F.col("__bn") + F.count("*").over(w)).withColumn("__s", F.col("__bs") + F.sum("__ok").over(w))
    r = r.withColumn("__stable", (F.col("__n") >= 10) & (F.col("__s") / F.col("__n") >= 0.95))
    out = r.groupBy("schema_key").agg(F.count("*").alias("uses"), F.sum("__ok").alias("successes"), F.bool_or("__stable").alias("stable"))
    out = out.withColumn("rate", F.round(F.col("successes") / F.col("uses"), 6))
    return out.withColumn("needs_refinement", (F.col("uses") >= 5) & (F.col("rate") < 0.70) & ~F.col("stable"))


def progress(steps: DataFrame) -> DataFrame:
    """Percent and remaining seconds of jobs, of steps (job_id, seq, kind 'ocr' or 'vlm', total, seconds).

    OCR counts 50 points and model calls 40; packaging stands at 95 and a finished job at 100. The rest of OCR is
    estimated by the mean of its last 20 timings.
    """
    last = Window.partitionBy("job_id", "kind").orderBy(F.desc("seq"))
    s = steps.withColumn("__k", F.row_number().over(last))
    one = lambda kind: F.col("kind") == kind
    agg = s.groupBy("job_id").agg(
        F.count_if(one("ocr")).alias("ocr_done"),
        F.coalesce(F.max(F.when(one("ocr"), F.col("total"))), F.lit(0)).alias("ocr_total"),
        F.count_if(one("vlm")).alias("vlm_done"),
        F.coalesce(F.max(F.when(one("vlm"), F.col("total"))), F.lit(0)).alias("vlm_total"),
        F.coalesce(F.avg(F.when(one("ocr") & (F.col("__k") <= 20), F.col("seconds"))), F.lit(0.0)).alias("mean"),
    )
    share = lambda done, total, points: F.coalesce(F.try_divide(F.least(F.col(done), F.col(total)) * float(points), F.col(total)), F.lit(0.0))
    percent = F.floor(share("ocr_done", "ocr_total", 50) + share("vlm_done", "vlm_total", 40)).cast("bigint")
    eta = F.round(F.greatest(F.col("ocr_total") - F.col("ocr_done"), F.lit(0)) * F.col("mean"), 4)
    return agg.select("job_id", percent.alias("percent"), eta.alias("ocr_eta_seconds"))


def open_history(history: DataFrame) -> DataFrame:
    """The latest unresolved row of each rule."""
    w = Window.partitionBy("rule_id").orderBy(F.desc("fired_at"), F.desc("id"))
    return history.filter(F.col("resolved_at").isNull()).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def allowed(users: DataFrame, grants: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (user_id, tenant_id, permission) with allowed: the role grants it, and the tenant is the user's or the role is admin.

    ``grants`` is a configuration table (role, permission).
    """
    r = requests.join(users, "user_id", "left").join(grants.withColumn("__granted", F.lit(True)), ["role", "permission"], "left")
    member = (F.col("role") == "admin") | F.coalesce(F.array_contains("tenant_ids", F.col("tenant_id")), F.lit(False))
    return r.withColumn("allowed", F.coalesce(F.col("__granted") & member, F.lit(False))).drop("__granted")


def api_key_outcome(requests: DataFrame, tenants: DataFrame) -> DataFrame:
    """requests (api_key) with the tenant whose key hash matches and an error code for unknown or suspended ones."""
    r = requests.withColumn("key_hash", F.sha2("api_key", 256)).join(tenants, "key_hash", "left")
    code = F.when(F.col("tenant_id").isNull(), "ERR_AUTH_001").when(F.col("suspended"), "ERR_AUTH_002")
    return r.withColumn("error_code", code).drop("key_hash")


def rule_errors(config: DataFrame) -> DataFrame:
    """alert rules with the faults of their configuration, joined by '; ' (empty: none)."""
    budget, rate, circuit = (F.col("rule_type") == t for t in ("budget_threshold", "error_rate", "circuit_breaker"))
    checks = F.array(
        F.when(budget & ~F.coalesce(F.col("threshold_tokens") > 0, F.lit(False)), "threshold_tokens must be a positive number"),
        F.when(budget & ~F.coalesce(F.col("billing_period").isin("monthly", "weekly"), F.lit(False)), "billing_period must be monthly or weekly"),
        F.when(rate & ~F.coalesce(F.col("threshold_percent").between(0, 100), F.lit(False)), "threshold_percent must be within 0 and 100"),
        F.when(rate & ~F.coalesce(F.col("evaluation_window_minutes") > 0, F.lit(False)), "evaluation_window_minutes must be positive"),
        F.when(circuit & F.coalesce(F.trim("service_name") == "", F.lit(True)), "service_name is required"),
        F.when(~(budget | rate | circuit), "unknown rule type"),
    )
    target = F.when(F.col("channel") == "email", F.col("target").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")).otherwise(F.col("target").rlike(r"^https?://\S+$"))
    return config.withColumn("errors", F.array_join(F.array_compact(checks), "; ")).withColumn("target_ok", F.coalesce(target, F.lit(False)))


def protection_level(settings: DataFrame) -> DataFrame:
    """tenant_id and high, medium or low by the share of enabled entities (0.8, 0.4)."""
    ratio = F.avg(F.col("enabled").cast("double"))
    return settings.groupBy("tenant_id").agg(F.when(ratio >= 0.8, "high").when(ratio >= 0.4, "medium").otherwise("low").alias("level"))


def effective_redaction(global_: DataFrame, overrides: DataFrame) -> DataFrame:
    """The entities of a (tenant, schema): its override list replaces the tenant's list as a whole.

    Inputs: global_ (tenant_id, entities), overrides (tenant_id, schema_type, entities).
    """
    pairs = overrides.select("tenant_id", "schema_type", F.col("entities").alias("__own"))
    return global_.join(pairs, "tenant_id", "left").select("tenant_id", "schema_type", F.coalesce("__own", "entities").alias("entities"))
