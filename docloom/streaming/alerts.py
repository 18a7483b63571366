"""The alert state machine, over a table of evaluations and as a stateful stream.

idle -> firing when a rule is breached, firing -> resolved when it is no longer, resolved -> idle on the next
evaluation, whatever it says. Entering firing notifies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.shared import checkpointed
from docloom.sources import keyed

STATES = ("idle", "firing", "resolved")
#: Places in STATES after an evaluation that is not breached, and after one that is.
_NEXT = ((0, 2, 0), (1, 1, 0))
_SEGMENT = "at bigint, breached boolean, ends array<int>, sent array<bigint>, evaluations bigint"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each rule's rows of a sorted partition do to a rule that enters idle, firing or resolved; rows are not kept."""
    names = ["rule_id", *[f.split()[0] for f in _SEGMENT.split(", ")]]
    now, schema = None, None

    def rows(segments: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([s[k] for s in segments], t) for k, t in enumerate(schema)], names)

    for batch in batches:
        schema = [batch.schema.field("rule_id").type, pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64()]
        done = []
        for rule, at, breached in zip(*(batch.column(c).to_pylist() for c in ("rule_id", "at", "breached"))):
            if now is None or now[0] != rule:
                if now is not None:
                    done.append(now)
                now = [rule, at, breached, [0, 1, 2], [0, 0, 0], 0]
            ends, sent, after = now[3], now[4], _NEXT[bool(breached)]
            for k in range(3):
                new = after[ends[k]]
                sent[k] += new == 1 != ends[k]
                ends[k] = new
            now[5] += 1
        if done:
            yield rows(done)
    if now is not None:
        yield rows([now])


def alert_summary(evaluations: DataFrame) -> DataFrame:
    """ST1, ST2: rule_id, state after the last evaluation, notifications sent, of evaluations (rule_id, at, breached).

    Evaluations are dealt by ranges of (rule_id, at), so that a busy rule is cut into stretches of time. Each stretch is
    reduced to its effect on each of the three states; a rule's effects, one a partition at most, are composed in order.
    """
    e = evaluations.select("rule_id", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "breached")
    dealt = e.repartitionByRange("rule_id", "at", "breached").sortWithinPartitions("rule_id", "at", "breached")
    rule = evaluations.select("rule_id").schema[0].dataType.simpleString()
    segments = dealt.mapInArrow(_segments, f"rule_id {rule}, {_SEGMENT}")
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("bigint").alias("sent"))

    def compose(acc: Column, s: Column) -> Column:
        return F.struct(F.get(s["ends"], acc["state"]).alias("state"), (acc["sent"] + F.get(s["sent"], acc["state"])).alias("sent"))

    ordered = F.array_sort(F.collect_list(F.struct("at", "breached", "ends", "sent")))
    g = segments.groupBy("rule_id").agg(F.aggregate(ordered, start, compose).alias("a"), F.sum("evaluations").alias("evaluations"))
    return g.select("rule_id", F.get(F.array(*map(F.lit, STATES)), F.col("a.state")).alias("state"), F.col("a.sent").alias("notifications"), "evaluations")


def alert_board(rules: DataFrame, evaluations: DataFrame) -> DataFrame:
    """ST1: rule_id, state, notifications, last_evaluated_at of all rules (rule_id, enabled).

    A disabled rule is not evaluated and stays idle; one that no evaluation names is idle too.
    """
    seen = evaluations.join(rules.filter("enabled").select("rule_id"), "rule_id", "left_semi")
    last = seen.groupBy("rule_id").agg(F.max("at").alias("last_evaluated_at"))
    out = rules.select("rule_id").join(alert_summary(seen).drop("evaluations"), "rule_id", "left").join(last, "rule_id", "left")
    return out.withColumns({"state": F.coalesce("state", F.lit(STATES[0])), "notifications": F.coalesce("notifications", F.lit(0))})


TRANSITION = "rule_id bigint, at timestamp, from_state string, to_state string"
BOARD = "rule_id bigint, state string, notifications bigint, last_evaluated_at timestamp"


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The changes of state of sorted stretches (rule_id, part, state on entering, at, breached); only the state is kept."""
    key, now = None, 0
    for batch in batches:
        out = []
        for rule, part, enters, at, breached in zip(*(batch.column(c).to_pylist() for c in ("rule_id", "part", "enters", "at", "breached"))):
            if (rule, part) != key:
                key, now = (rule, part), enters
            new = _NEXT[bool(breached)][now]
            if new != now:
                out.append((rule, at, STATES[now], STATES[new]))
            now = new
        cols = list(zip(*out)) if out else [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["rule_id", "at", "from_state", "to_state"])


class AlertStream:
    """ST1: the state machine over a stream, as a micro-batch function that is safe to repeat.

    A batch of evaluations (rule_id bigint, at, breached) is dealt by ranges of rule and time, as in ``alert_summary``, so
    that a rule's batch is never one task's. Each stretch's effect on the three states, composed in order from the state
    that the rule had before the batch, gives the state in which each stretch is entered; then stretches give their
    changes. Rules' states are a keyed table with one version a batch, changes are kept under the batch's id: a batch
    that is repeated changes nothing. ``rules`` (rule_id, enabled) is read anew for each batch; rules that are disabled
    or unknown are not evaluated. Evaluations are expected in the order of batches; within one any order will do.
    """

    def __init__(self, path: str, rules: Callable[[SparkSession], DataFrame] | None = None):
        self.states = keyed.KeyedTable(f"{path}/states", BOARD, ["rule_id"])
        self.path, self.rules = f"{path}/changes", rules

    def changes(self, spark: SparkSession) -> DataFrame:
        return keyed.read_parts(spark, self.path, TRANSITION)

    def board(self, spark: SparkSession) -> DataFrame:
        """rule_id, state, notifications, last_evaluated_at of the rules that were evaluated, or of all rules."""
        now = self.states.read(spark)
        if self.rules is None:
            return now
        out = self.rules(spark).select("rule_id").join(now, "rule_id", "left")
        return out.withColumns({"state": F.coalesce("state", F.lit(STATES[0])), "notifications": F.coalesce("notifications", F.lit(0).cast("bigint"))})

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id <= max(self.states.versions(spark), default=-1):
            return
        e = batch.select("rule_id", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "breached")
        if self.rules is not None:
            e = e.join(self.rules(spark).filter("enabled").select("rule_id"), "rule_id", "left_semi")
        dealt = checkpointed(e.repartitionByRange("rule_id", "at", "breached").sortWithinPartitions("rule_id", "at", "breached"))
        segments = dealt.mapInArrow(_segments, f"rule_id bigint, {_SEGMENT}").withColumn("part", F.spark_partition_id())
        before = self.states.read(spark)
        code = F.array_position(F.array(*map(F.lit, STATES)), F.col("state")) - 1
        start = F.struct(F.coalesce(F.first("was"), F.lit(0)).cast("int").alias("state"), F.coalesce(F.first("sent0"), F.lit(0)).cast("bigint").alias("sent"), F.array().cast("array<struct<part:int,enters:int>>").alias("parts"))

        def compose(acc: Column, s: Column) -> Column:
            entered = F.struct(s["part"].alias("part"), acc["state"].alias("enters"))
            return F.struct(F.get(s["ends"], acc["state"]).alias("state"), (acc["sent"] + F.get(s["sent"], acc["state"])).alias("sent"), F.array_append(acc["parts"], entered).alias("parts"))

        ordered = F.array_sort(F.collect_list(F.struct("part", "ends", "sent")))
        known = segments.join(before.select("rule_id", code.alias("was"), F.col("notifications").alias("sent0")), "rule_id", "left")
        run = checkpointed(known.groupBy("rule_id").agg(ordered.alias("__o"), start.alias("__s")).select("rule_id", F.aggregate("__o", F.col("__s"), compose).alias("r")))
        entered = run.select("rule_id", F.explode("r.parts").alias("p")).select("rule_id", "p.part", "p.enters")
        rows = dealt.withColumn("part", F.spark_partition_id()).join(entered, ["rule_id", "part"])
        sorted_ = rows.repartition("rule_id", "part").sortWithinPartitions("rule_id", "part", "at", "breached")
        changes = sorted_.mapInArrow(_changes, "rule_id bigint, at bigint, from_state string, to_state string")
        changes.select("rule_id", F.timestamp_micros("at").alias("at"), "from_state", "to_state").write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        last = dealt.groupBy("rule_id").agg(F.timestamp_micros(F.max("at")).alias("last_evaluated_at"))
        state = F.get(F.array(*map(F.lit, STATES)), F.col("r.state"))
        self.states.merge(run.select("rule_id", state.alias("state"), F.col("r.sent").alias("notifications")).join(last, "rule_id"), batch_id)


def circuit_alerts(events: DataFrame, rules: DataFrame) -> DataFrame:
    """ST4, J12: circuit events (service_name, tenant_id, previous_state, new_state, ts) with the enabled rules of their
    service (and tenant, if the rule names one): closed -> open fires, open -> closed resolves. ``rules`` is static."""
    return _of_rules(_circuit_changes(events), rules)


def circuit_counts(events: DataFrame, rules: DataFrame) -> DataFrame:
    """ST4, J12: rule_id, to_state, changes: how many rows ``circuit_alerts`` has of each rule and state.

    Events are counted by service, tenant and change before they meet the rules, so that rules times events are not made.
    """
    counts = _circuit_changes(events).groupBy("service_name", "tenant_id", "to_state").agg(F.count("*").alias("__n"))
    return _of_rules(counts, rules).groupBy("rule_id", "to_state").agg(F.sum("__n").alias("changes"))


def _circuit_changes(events: DataFrame) -> DataFrame:
    """Events with to_state; those that neither fire nor resolve go."""
    change = F.when((F.col("previous_state") == "closed") & (F.col("new_state") == "open"), "firing").when((F.col("previous_state") == "open") & (F.col("new_state") == "closed"), "resolved")
    return events.withColumn("to_state", change).filter("to_state is not null")


def _of_rules(changes: DataFrame, rules: DataFrame) -> DataFrame:
    """Changes with the enabled rules that they fall under."""
    r = rules.filter("enabled").select("rule_id", "service_name", F.col("tenant_id").alias("__tenant"))
    return changes.join(r, "service_name").filter(F.col("__tenant").isNull() | (F.col("__tenant") == F.col("tenant_id"))).drop("__tenant")
