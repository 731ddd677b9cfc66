"""All queries of the library with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiform.plans import base, forms, models, retrieval, tables


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character n-gram retrieval: each query's first-match rank."""
    return retrieval.char_ngram_retrieval(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    assert forms and models and retrieval and tables
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
