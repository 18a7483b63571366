"""Event-time aggregates of usage and progress streams, with watermarks for late rows."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from docloom.shared import shared_dir


def event_time(df: DataFrame, column: str = "ts", late: str = "2 days") -> DataFrame:
    """Timestamps without zone are read as UTC; rows later than ``late`` may be dropped by aggregates."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def tumbling(df: DataFrame, size: str, *keys: str) -> DataFrame:
    """Rows and their value by window and key."""
    w = df.groupBy(F.window("ts", size).alias("w"), *keys).agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return w.select(F.col("w.start").alias("start"), *keys, "events", "value")


def sessions(df: DataFrame, gap: str, key: str) -> DataFrame:
    """Runs of rows of a key with pauses shorter than ``gap``."""
    w = df.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("events"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "events")


def progress_counts(df: DataFrame) -> DataFrame:
    """ST7: steps done by job and kind, for the update mode."""
    return df.groupBy("job_id", "kind").agg(F.count("*").alias("done"), F.max("total").alias("total"))


def run_once(stream: DataFrame, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """Runs a stream over all that is there (availableNow) into Parquet in the shared folder, and reads it.

    In the mode complete the last batch's rows replace earlier ones. In the mode update each batch is kept under its id
    and the last row of each of ``keys`` is read.
    """
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys of a row")
    spark: SparkSession = stream.sparkSession
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    elif mode == "update":
        q = stream.writeStream.outputMode(mode).foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(f"{folder}/out/run_once_batch={k}")).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    else:
        q = stream.writeStream.outputMode(mode).foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{folder}/out")).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    if mode == "update":
        rows = spark.read.schema(StructType([*stream.schema.fields, StructField("run_once_batch", LongType())])).parquet(f"{folder}/out")
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "run_once_batch").alias("r"))
        return last.select("r.*")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_batches(stream: DataFrame, each_batch, checkpoint: str) -> None:
    """Hands all that is there, in micro-batches, to ``each_batch`` (frame, batch id), and ends; a later run goes on from there."""
    stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_every(stream: DataFrame, each_batch, checkpoint: str, seconds: int = 60, mode: str = "append"):
    """ST6: the running query that hands each micro-batch to ``each_batch`` (frame, batch id) at a fixed pace."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=f"{seconds} seconds").start()
