"""Joins between sources: code bridge, title-and-author match, new keys, id maps and table differences.

All join conditions are equalities on pre-grouped keys, so that the planner never needs a nested loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import author_key, isbn_digits, short_key


def code_bridge(products: DataFrame, editions: DataFrame) -> DataFrame:
    """(parent_asin, work_id): for every distinct product the work that shares its ISBN-10, else its ISBN-13; for those
    sold as e-books the work whose ``kindle_asin`` is the product. Null where there is none. A repeated code stands for
    the greatest work; empty codes match nothing."""
    ed = editions.filter("work_id is not null").select(
        "work_id", isbn_digits(F.col("isbn")).alias("ten"), F.regexp_replace(F.coalesce("isbn13", F.lit("")), "[^0-9]", "").alias("thirteen"), "kindle_asin"
    )

    def by(code: str, name: str) -> DataFrame:
        return ed.filter(F.coalesce(F.col(code), F.lit("")) != "").groupBy(F.col(code)).agg(F.max("work_id").alias(name))

    p = products.select(
        "parent_asin", "source", isbn_digits(F.col("isbn10")).alias("ten"), F.regexp_replace(F.coalesce("isbn13", F.lit("")), "[^0-9]", "").alias("thirteen")
    )
    joined = (
        p.join(by("ten", "w10"), "ten", "left").join(by("thirteen", "w13"), "thirteen", "left")
        .join(by("kindle_asin", "wk").withColumnRenamed("kindle_asin", "k"), F.col("parent_asin") == F.col("k"), "left")
    )
    work = F.when(F.col("source") == "kindle", F.coalesce("wk", "w13")).otherwise(F.coalesce("w10", "w13"))
    return joined.groupBy("parent_asin").agg(F.max(work).alias("work_id"))


def titled_works(works: DataFrame) -> DataFrame:
    """(akey, tkey, work_id): of works with the same keys the most rated, least id."""
    keyed = works.select("work_id", F.coalesce("n", F.lit(-1)).alias("n"), author_key(F.col("author")).alias("akey"), short_key(F.col("title")).alias("tkey"))
    best = keyed.filter("akey <> '' and tkey <> ''").groupBy("akey", "tkey").agg(F.max(F.struct("n", -F.col("work_id"))).alias("b"))
    return best.select("akey", "tkey", (-F.col("b.col2")).alias("work_id"))


def title_match(products: DataFrame, works: DataFrame) -> DataFrame:
    """(parent_asin, work_id): products whose author and short title are those of a work."""
    p = products.select("parent_asin", author_key(F.col("author")).alias("akey"), short_key(F.col("title")).alias("tkey"))
    hit = p.join(titled_works(works), ["akey", "tkey"])
    return hit.groupBy("parent_asin").agg(F.min("work_id").alias("work_id"))


def dense_ids(df: DataFrame, key: str, offset: int, out: str) -> DataFrame:
    """Gap-free ids in the order of a unique key. The order is exact at any size: rows are range-partitioned and the
    partitions' offsets added, no single task sees all of them."""
    from folioforge.operators.skew import numbered
    from folioforge.session import Scratch

    rows = numbered(df, key, [], Scratch(df.sparkSession, "ids"))
    return rows.withColumn(out, F.col("_row") + F.lit(offset + 1)).drop("_row")


def table_changes(old: DataFrame, new: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """(key, change): 'insert', 'update', 'delete' or 'same' of each key, in one full outer join of unique keys."""
    o = old.select(F.col(key), F.lit(True).alias("_o"), *[F.col(c).alias(f"_o_{c}") for c in cols])
    n = new.select(F.col(key), F.lit(True).alias("_n"), *[F.col(c).alias(f"_n_{c}") for c in cols])
    same = F.lit(True)
    for c in cols:
        same = same & F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}"))
    kind = F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "delete").when(same, "same").otherwise("update")
    return o.join(n, key, "full").select(key, kind.alias("change"))


def merged_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table after an upsert of ``new`` into ``old``."""
    kept = old.join(new.select(key), key, "left_anti")
    return kept.select(*old.columns).unionByName(new.select(*old.columns))


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the order. The window keeps one row per key before the shuffle where it can."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
