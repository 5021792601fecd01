"""Held-out readers and hidden ratings, by hashes that depend on the id alone."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.numeric import draw

#: Stages of readers by the number of their ratings.
BUCKETS = ((20, "20-39"), (40, "40-79"), (80, "80-159"), (160, "160-319"), (320, "320-999"), (1000, "1000+"))


def bucket_of(n: Column, buckets: Sequence[tuple[int, str]] = BUCKETS) -> Column:
    """Stage of a reader; null below the first."""
    out = F.lit(None).cast("string")
    for lo, name in buckets:
        out = F.when(n >= lo, name).otherwise(out)
    return out


def assign_groups(readers: DataFrame, key: str, shares: Mapping[str, float], salt: int = 7) -> DataFrame:
    """Adds ``draw`` and ``grp``: a reader's group depends on its id and the salt, not on who else is there."""
    d, at, label = draw(F.col(key), salt), 0.0, None
    for name, share in shares.items():
        hit = (F.col("draw") >= at) & (F.col("draw") < at + share)
        label = F.when(hit, name) if label is None else label.when(hit, name)
        at += share
    return readers.withColumn("draw", d).withColumn("grp", F.coalesce(label, F.lit("train")))


def hide(ratings: DataFrame, share: float = 0.2, salt: int = 8) -> DataFrame:
    """Adds ``hidden``: of each reader's n ratings, max(1, round(share * n)) drawn by a hash of reader and work."""
    key = draw(F.concat_ws(":", "user_id", "work_id"), salt)
    w = Window.partitionBy("user_id").orderBy(key, "work_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    return ratings.withColumn("hidden", F.row_number().over(w) <= F.greatest(F.lit(1), F.round(share * n)))


def train_rows(ratings: DataFrame, held: DataFrame) -> DataFrame:
    return ratings.join(held.select("user_id"), "user_id", "left_anti").select(*ratings.columns)
