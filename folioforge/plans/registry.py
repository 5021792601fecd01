"""All core queries: name -> callable, and name -> the same result in ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioforge.plans import clean_queries, eval_queries, event_queries, judge_queries, link_queries, profile_queries, rank_queries, skew_queries, staging_queries, text_queries
from folioforge.plans.base import Tables

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (skew_queries, clean_queries, profile_queries, text_queries, link_queries, rank_queries, event_queries, eval_queries, judge_queries, staging_queries)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for m in MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out.update(m.SQL)
    return out


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return rank_queries.flagship(Tables(spark, sf))
