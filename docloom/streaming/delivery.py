"""Deliveries and alert history as micro-batch functions that are safe to repeat."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.model_io import history_after
from docloom.shared import checkpointed
from docloom.sources import keyed

OUTCOME = "payload_id string, tenant_id string, url string, payload string, outcome string, attempts int"


class DeliverySink:
    """Sends the payloads of micro-batches (payload_id, tenant_id, payload), each once.

    ``send(payload_id, url, payload)`` tells whether the receiver took it; a refused payload is tried again after a pause,
    ``attempts`` times in all. Where it goes is in ``targets`` (tenant_id, enabled, callback_url): a tenant without an
    enabled target or an address has its payloads skipped. Outcomes are kept by payload id, and no payload with an outcome
    is sent again. A batch is one job whose tasks together hold at most about ``wave`` payloads at a time; each task's
    outcomes are there as soon as it ends, whether or not the job does, so a batch that dies midway and is repeated sends
    what its finished tasks have sent no more; only tasks that were cut can reach a receiver twice, under the same payload id.
    """

    def __init__(self, path: str, send: Callable[[str, str, str], bool], targets: DataFrame, attempts: int = 3, pause: Callable[[int], float] | None = None, wave: int = 10_000):
        self.path, self.send, self.targets, self.attempts, self.wave = path, send, targets, attempts, wave
        self.pause = pause

    def outcomes(self, spark: SparkSession) -> DataFrame:
        """payload_id, tenant_id, url, payload, outcome (delivered, refused, not_configured, no_callback_url), attempts; the payload of refused ones only."""
        folders = [f"{self.path}/batch={b}" for b in self._batches(spark)]
        return spark.read.schema(OUTCOME).parquet(*folders) if folders else spark.createDataFrame([], OUTCOME)

    def dead_letters(self, spark: SparkSession) -> DataFrame:
        """Refused payloads, to be looked at or sent by hand."""
        return self.outcomes(spark).filter("outcome = 'refused'").select("payload_id", "tenant_id", "url", "payload", "attempts")

    def _batches(self, spark: SparkSession) -> list[int]:
        place, fs = keyed._files(spark, self.path)
        if not fs.exists(place(self.path)):
            return []
        return sorted(int(s.getPath().getName()[6:]) for s in fs.listStatus(place(self.path)) if s.getPath().getName().startswith("batch="))

    def _sent(self) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        import random

        send, attempts = self.send, self.attempts
        pause = self.pause or (lambda n: min(2.0**n + random.random(), 30.0))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for key, tenant, url, payload, skipped in zip(b["payload_id"], b["tenant_id"], b["url"], b["payload"], b["outcome"]):
                    if skipped is not None:
                        rows.append((key, tenant, url, None, skipped, 0))
                        continue
                    ok, n = False, 0
                    while not ok and n < attempts:
                        if n:
                            time.sleep(pause(n - 1))
                        n += 1
                        ok = bool(send(key, url, payload))
                    rows.append((key, tenant, url, None if ok else payload, "delivered" if ok else "refused", n))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUTCOME.split(", ")])

        return run

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, folder = batch.sparkSession, f"{self.path}/batch={batch_id}"
        if keyed.finished(spark, folder):
            return
        first = batch.groupBy("payload_id").agg(F.min(F.struct("tenant_id", "payload")).alias("p")).select("payload_id", "p.*")
        t = self.targets.select("tenant_id", F.coalesce("enabled", F.lit(False)).alias("__on"), F.nullif(F.trim("callback_url"), F.lit("")).alias("url"))
        why = F.when(~F.coalesce("__on", F.lit(False)), "not_configured").when(F.col("url").isNull(), "no_callback_url")
        all_ = checkpointed(first.join(t, "tenant_id", "left").select("payload_id", "tenant_id", "url", "payload", why.alias("outcome")))
        # so many tasks that those which run at once hold a wave together
        tasks = max(1, math.ceil(all_.count() * spark.sparkContext.defaultParallelism / self.wave))
        new = all_.join(self.outcomes(spark).select("payload_id").hint("merge"), "payload_id", "left_anti")
        done = new.repartition(tasks, "payload_id").mapInPandas(self._sent(), OUTCOME)
        # the second form of commit puts a task's file in its place when the task ends
        done.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(folder)


HISTORY = "rule_id bigint, fired_at timestamp, resolved_at timestamp"


class AlertHistory:
    """ST5, J13: keeps alert history from batches of changes (rule_id, at, to_state) and notifies once for each firing.

    Open rows are a keyed table, written once a batch; rows that a batch closes are that batch's own table. A batch that
    is repeated finds its version and leaves both as they are. Notifications go through a delivery sink, under the rule and
    the time of firing, so that they are not repeated either. What a rule did before is one open row, never its history.
    """

    def __init__(self, path: str, notify: DeliverySink | None = None, tenants: DataFrame | None = None):
        self.open = keyed.KeyedTable(f"{path}/open", HISTORY, ["rule_id", "fired_at"])
        self.closed, self.notify, self.tenants = f"{path}/closed", notify, tenants

    def read(self, spark: SparkSession) -> DataFrame:
        """rule_id, fired_at, resolved_at of all firings so far."""
        return keyed.read_parts(spark, self.closed, HISTORY).unionByName(self.open.read(spark))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        changes = checkpointed(batch.select("rule_id", "at", "to_state"))
        if batch_id > max(self.open.versions(spark), default=-1):
            after = checkpointed(history_after(self.open.read(spark), changes))
            after.filter("resolved_at is not null").write.mode("overwrite").parquet(f"{self.closed}/batch={batch_id}")
            self.open.replace(after.filter("resolved_at is null"), batch_id)
        if self.notify is not None:
            fired = changes.filter("to_state = 'firing'").withColumn("payload_id", F.concat_ws("@", F.col("rule_id").cast("string"), F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
            body = F.to_json(F.struct(F.lit("alert").alias("type"), "rule_id", F.col("at").cast("string").alias("fired_at")))
            of = fired.join(self.tenants, "rule_id", "left") if self.tenants is not None else fired.withColumn("tenant_id", F.lit(None).cast("string"))
            self.notify(of.select("payload_id", "tenant_id", body.alias("payload")), batch_id)
