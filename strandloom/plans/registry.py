"""The catalogue of queries of the core library."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from strandloom.plans.catalogue import QUERIES, SQL, Query

MODULES = ("summaries", "lookups", "analytics", "files", "profiles")

for _name in MODULES:
    import_module(f"strandloom.plans.{_name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["sim8_full_novelty"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
