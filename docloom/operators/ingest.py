"""Ingestion: checks of incoming files, duplicates, the table of what has been seen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import fixed
from docloom.functions.columns import sha_id

MAX_BYTES = 50 * 1024 * 1024
SMALL = 1_000_000


def outcomes(files: DataFrame, max_bytes: int = MAX_BYTES, seen: DataFrame | None = None) -> DataFrame:
    """Files (file_id, tenant_id, arrived, content) with sha, status, error_code and priority.

    The first failing check decides: type, size, duplicate. A duplicate has the content of an earlier good file of its
    tenant, or of one in ``seen`` (tenant_id, sha). The content itself is dropped before anything is shuffled, and copies
    are reduced to the earliest before they meet.
    """
    n = F.octet_length("content")
    checked = files.select(
        *[c for c in files.columns if c != "content"], n.alias("size"), sha_id(F.col("content")).alias("sha"),
        F.when(F.coalesce(F.substring("content", 1, 4) != F.lit(b"%PDF"), F.lit(True)), fixed.REJECTS[0]).when(n > max_bytes, fixed.REJECTS[1]).alias("__early"),
    )
    good = checked.filter(F.col("__early").isNull()).groupBy("tenant_id", "sha").agg(F.min(F.struct("arrived", "file_id")).alias("__first"))
    out = checked.join(good, ["tenant_id", "sha"], "left").withColumn("__old", F.lit(False))
    if seen is not None:
        out = out.drop("__old").join(seen.select("tenant_id", "sha").distinct().withColumn("__old", F.lit(True)), ["tenant_id", "sha"], "left")
    repeat = (F.struct("arrived", "file_id") > F.col("__first")) | F.coalesce("__old", F.lit(False))
    code = F.when(F.col("__early").isNotNull(), F.col("__early")).when(repeat, fixed.REJECTS[2])
    status = F.when(F.col("__early").isNotNull(), "rejected").when(repeat, "duplicate").otherwise("accepted")
    return out.withColumns({"status": status, "error_code": code, "priority": F.when(F.col("size") < SMALL, "high").otherwise("normal")}).drop("__early", "__first", "__old")


def unseen(files: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Files whose key is not in the table of seen ones."""
    return files.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def first_of_each(files: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """U8: the earliest file of each key, by aggregation: a key's copies are reduced where they lie."""
    rest = [c for c in files.columns if c not in (*keys, order)]
    g = files.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("__f"))
    return g.select(*keys, "__f.*")


def upsert(store: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The store with rows of ``new`` in place of those of the same key; the latest by ``order`` stays."""
    rest = [c for c in store.columns if c not in keys and c != order]
    both = store.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    g = both.groupBy(*keys).agg(F.max_by(F.struct(order, *rest), F.struct(order, "__new")).alias("__r"))
    return g.select(*keys, "__r.*").select(*store.columns)
