"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeloom.plans import q_aggregates, q_datasets, q_filters, q_joins, q_more, q_ranking, q_retrieval, q_sources, q_streaming, q_text  # noqa: F401
from lakeloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["ret_rrf" if "ret_rrf" in QUERIES else "src_table_scan"](spark, sf_dir)
