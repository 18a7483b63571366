"""Helpers that the corpus operators share: ASCII word splitting, shared folders, lineage cuts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.shared import shared_dir

_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = b"abcdefghijklmnopqrstuvwxyz"
#: Lower-cases A-Z and turns every byte outside 0-9, a-z and 0x80-0xFF into a space.
WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
#: Lower-cases A-Z only.
LOWER_TABLE = bytes.maketrans(_UPPER, _LOWER)


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text with A-Z lower-cased; None has none."""
    return text.translate(WORD_TABLE).split() if text else []


def utf8(column: Column | str) -> Column:
    """The column's UTF-8 bytes, so that Python receives them without decoding."""
    return (F.col(column) if isinstance(column, str) else column).cast("string").cast("binary")


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: later steps neither repeat nor depend on the work that made ``df``."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(os.path.join(shared_dir(df.sparkSession), "checkpoints"))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: lineage is cut, and so is what the planner infers from
    the steps before, which a checkpoint keeps and which grows from round to round in long loops."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_sample(df: DataFrame, order: str, total: int, n: int, distinct: str | None = None) -> DataFrame:
    """About the n rows (at most n) with the least values of the hash column ``order``, of a table of ``total`` rows.

    Rows are first thinned to one and a half times n by the hash, so that tasks hand on few rows however many tasks
    there are; below n rows all are kept. With ``distinct``, one row stays for each hash (of that column's first value),
    reduced before it is shuffled.
    """
    share = min(1.0, (1.5 * n + 100) / max(1, total))
    thin = df if share == 1.0 else df.filter(F.pmod(F.col(order), F.lit(1 << 30)) < int(share * (1 << 30)))
    if distinct:
        thin = thin.groupBy(order).agg(F.min(distinct).alias(distinct))
    return thin.orderBy(order).limit(n)
