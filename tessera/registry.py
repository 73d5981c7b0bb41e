"""All queries of the engine and their SQL, by name."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from tessera.catalogue import ORACLES, QUERIES, Query

MODULES = (
    "tessera.plans.dashboard",
    "tessera.plans.relational",
    "tessera.plans.rows",
    "tessera.plans.adhoc",
    "tessera.plans.policy_queries",
    "tessera.plans.filter_queries",
    "tessera.operators.detect_queries",
    "tessera.operators.join_queries",
    "tessera.sources.lake_queries",
    "tessera.sources.source_queries",
    "tessera.streaming.stream_queries",
    "tessera.streaming.trigger_queries",
)


def _load() -> None:
    for m in MODULES:
        importlib.import_module(m)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents -> validated spans -> scores -> tiers: the file statistics of the dashboard."""
    from tessera.plans.dashboard import file_stats

    return file_stats(spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
