"""Works by how many rated them and how well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def popularity(ratings: DataFrame, m: float = 100.0, digits: int = 9) -> DataFrame:
    """(work_id, n, bayes, bayes_log): ratings, mean drawn to the overall mean by ``m`` ratings, and that times
    ln(1 + n). The overall mean is one row and joins every work."""
    r = F.col("rating").cast("decimal(12,6)")
    per = ratings.groupBy("work_id").agg(F.count(F.lit(1)).alias("n"), F.sum(r).alias("s"))
    mu = per.agg((F.sum("s").cast("double") / F.sum("n")).alias("mu"))
    bayes = (F.col("s").cast("double") + m * F.col("mu")) / (F.col("n") + m)
    return per.crossJoin(F.broadcast(mu)).select("work_id", "n", F.round(bayes, digits).alias("bayes"), F.round(bayes * F.log1p("n"), digits).alias("bayes_log"))


def smoothed_means(ratings: DataFrame, prior: float = 50.0, digits: int = 9) -> DataFrame:
    return popularity(ratings, prior, digits).select("work_id", "n", F.col("bayes").alias("smoothed"))
