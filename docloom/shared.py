"""The folder that driver and executors share, lineage cuts, and numbers in order over whole tables."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a new local folder for a local session, else an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="docloom-")
    return _local[context.applicationId]


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, so that several later steps do not repeat the work that made ``df``."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(os.path.join(shared_dir(df.sparkSession), "checkpoints"))
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: Sequence[Column], name: str = "number") -> DataFrame:
    """Adds gapless numbers from 0 that follow the order over all rows; rows that tie are numbered in any order.

    Rows are sorted by ranges (ties are split by the place of a row in the input, so equal rows may lie in several ranges)
    and kept in the shared folder; each one's place within its range comes with the counts of the ranges before it, a table
    of one row a range. No task sees more than its range.
    """
    at, before = "__at", "__before"
    kept = checkpointed(df.orderBy(*order, F.monotonically_increasing_id()).withColumn(at, F.monotonically_increasing_id()))
    ranges = kept.groupBy(F.shiftright(at, 33).alias("__range")).agg(F.count("*").alias("__n"))
    sums = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    ahead = ranges.select("__range", F.coalesce(sums, F.lit(0)).alias(before))
    joined = kept.join(F.broadcast(ahead), F.shiftright(at, 33) == F.col("__range"))
    return joined.withColumn(name, F.col(before) + F.col(at).bitwiseAND((1 << 33) - 1)).drop(at, before, "__range")
