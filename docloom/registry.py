"""All queries of the reference's operators, by name, with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("admin", "documents", "validation", "flows", "model_io", "services", "fallbacks", "relations")


def _plans() -> list:
    return [importlib.import_module(f"docloom.plans.{m}") for m in MODULES]


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["process_documents"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: q for p in _plans() for name, q in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for p in _plans() for name, s in p.SQL.items()}
