"""All queries of the engine and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.plans import fact_queries, program_queries, record_queries, series_queries, source_queries, table_queries
from factloom.plans.registry import Query

MODULES = (series_queries, table_queries, program_queries, source_queries, fact_queries, record_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_queries.flagship_growth(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.registry.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.registry.oracles.items()}
