"""All queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarmill.plans import file_queries, other_queries, review_queries, split_queries, text_queries  # noqa: F401
from tarmill.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Pooled error rates of clip transcripts against two references."""
    return text_queries.score_totals(spark, d)
