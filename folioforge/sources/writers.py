"""Writers: zstd Parquet with an order-free checksum, and one file per profile and day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checksum(df: DataFrame) -> DataFrame:
    """(n_rows, digest): independent of row order and partitioning."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("digest"))


def write_table(df: DataFrame, path: str, sort: list[str] | None = None) -> dict:
    """Writes the table and gives back its row count and digest as read again."""
    out = df.sortWithinPartitions(*sort) if sort else df
    out.write.mode("overwrite").option("compression", "zstd").parquet(path)
    row = checksum(df.sparkSession.read.parquet(path)).first()
    return {"rows": row["n_rows"], "digest": str(row["digest"]) if row["digest"] is not None else None}


def append_day(df: DataFrame, path: str) -> None:
    """Replaces the (profile, day) partitions that the frame holds and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("profile", "day").parquet(path)
