"""Profiling of the raw tables: one small frame per metric."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.numeric import bucket_label


def share_of_all(counts: DataFrame, n: str = "n", digits: int = 2) -> DataFrame:
    """Adds ``pct`` of the total. The window spans a grouped result, which is small by construction."""
    return counts.withColumn("pct", F.round(100.0 * F.col(n) / F.sum(n).over(Window.partitionBy()), digits))


def file_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("file"), "n_rows")
        out = row if out is None else out.unionAll(row)
    return out


def overview(ratings: DataFrame) -> DataFrame:
    r = F.col("rating")
    return ratings.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("user_id").alias("n_users"),
        F.count_distinct("work_id").alias("n_works"),
        F.count_if(F.col("user_id").isNull() | F.col("work_id").isNull() | r.isNull()).alias("null_keys"),
        F.count_if(~r.between(0, 5)).alias("out_of_range"),
        F.count_if(r > 0).alias("explicit"),
        F.count_if(F.col("rated_at").isNull()).alias("undated"),
        F.count_if(F.col("loaded_at") > F.col("rated_at") + F.expr("interval 7 days")).alias("late"),
    )


def per_work(ratings: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return ratings.groupBy("work_id").agg(n.alias("n"), (F.sum(F.col("rating").cast("decimal(12,6)")).cast("double") / n).alias("mean"))


def per_user(ratings: DataFrame, works: DataFrame, obscure_below: int = 20) -> DataFrame:
    """(user_id, n, mean, obscure_share, five_share) over work-level ratings."""
    n = F.count(F.lit(1))
    j = ratings.join(works.select("work_id", F.col("n").alias("wn")), "work_id")
    return j.groupBy("user_id").agg(
        n.alias("n"),
        (F.sum(F.col("rating").cast("decimal(12,6)")).cast("double") / n).alias("mean"),
        (F.count_if(F.col("wn") < obscure_below) / n).alias("obscure_share"),
        (F.count_if(F.col("rating") == 5) / n).alias("five_share"),
    )


def bucketed(df: DataFrame, by: str, edges: Sequence[int], aggs: Sequence[Column], label: str) -> DataFrame:
    return df.groupBy(bucket_label(F.col(by), edges).alias(label)).agg(*aggs)


def quantiles(df: DataFrame, col: str, at: Sequence[float]) -> DataFrame:
    """Discrete quantiles, exact: the least value whose cumulative share reaches each point."""
    picks = [F.expr(f"percentile_disc({q}) within group (order by {col})").cast("bigint").alias(f"p{str(q).split('.')[1]}") for q in at]
    return df.agg(F.count(F.lit(1)).alias("n_values"), *picks, F.max(col).alias("greatest"))


def missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows and, for each column, how many are null or blank text."""
    kinds = dict(df.dtypes)
    gone = lambda c: F.count_if(F.col(c).isNull() | (F.trim(F.col(c)) == "") if kinds[c] == "string" else F.col(c).isNull()).alias(f"no_{c}")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[gone(c) for c in cols])


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, n): each frame has one column with one count."""
    out = None
    for name, df in checks.items():
        row = df.select(F.lit(name).alias("check"), F.col(df.columns[0]).cast("long").alias("n"))
        out = row if out is None else out.unionAll(row)
    return out


def require_none(report: DataFrame) -> None:
    """Raises with the names of the violated checks; the report has one row per check."""
    bad = {r["check"]: r["n"] for r in report.filter("n > 0").collect()}
    if bad:
        raise AssertionError(f"violated: {bad}")
