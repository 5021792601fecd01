"""Items that appear together: a blocked Gram matrix of binary record-by-item data.

Records and items are reduced to distinct pairs, items that no qualifying pair can contain are removed by exact
bounds, and the rest becomes sparse binary rows over dense item numbers, whose transpose-products are summed block by
block (``operators/gram.py``). Counts are then set against what the marginals give by chance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators.gram import coded_products, dense_items
from folioforge.session import Scratch, small_or_plain


def pair_counts(
    df: DataFrame, record: str, item: str, min_count: int = 20, min_lift: float = 0.0, piece_items: int = 2048
) -> DataFrame:
    """(item_a, item_b, n_both, n_a, n_b, n_records, lift), item_a < item_b.

    ``n_both``: records that hold both items; ``lift``: n_both * n_records / (n_a * n_b), the ratio to what
    independence gives. Pairs need n_both >= ``min_count`` (1 at least) and lift >= ``min_lift``.

    Rows with a null record or item do not count; repeats count once; other columns are ignored. An empty table
    gives no rows. Exact: only items are left out that cannot be in a qualifying pair, by n_both <= min(n_a, n_b).
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "cooccur")
    min_count = max(1, min_count)
    pairs = scratch.put(
        df.select(F.col(record).cast("long").alias("r"), F.col(item).cast("long").alias("i")).filter("r is not null and i is not null").distinct()
    )
    n_records = pairs.select("r").distinct().count()
    totals = scratch.put(pairs.groupBy("i").agg(F.count(F.lit(1)).alias("n")))
    # lift >= L and n_both <= min(n_a, n_b) give max(n_a, n_b) <= n_records / L.
    most = n_records / min_lift if min_lift > 0 else float("inf")
    kept = dense_items(totals.filter((F.col("n") >= min_count) & (F.col("n") <= most)), "i", scratch)
    coded = pairs.join(small_or_plain(scratch, kept.select("i", "k"), kept), "i").select("r", "k")
    summed = coded_products(coded, max(1, kept.count()), scratch, least=min_count, piece_items=piece_items).withColumnRenamed("n", "n_both")
    left = kept.select(F.col("k").alias("a"), F.col("i").alias("item_a"), F.col("n").alias("n_a"))
    right = kept.select(F.col("k").alias("b"), F.col("i").alias("item_b"), F.col("n").alias("n_b"))
    out = summed.join(small_or_plain(scratch, left, kept), "a").join(small_or_plain(scratch, right, kept), "b")
    big_int = "decimal(38,0)"
    if min_lift > 0:
        ratio = F.lit(str(min_lift)).cast("decimal(12,6)")
        out = out.filter(
            (F.col("n_both").cast("decimal(19,0)") * F.lit(n_records).cast("decimal(19,0)")).cast(big_int)
            >= (ratio * (F.col("n_a").cast("decimal(13,0)") * F.col("n_b").cast("decimal(12,0)")).cast("decimal(25,0)"))
        )
    return out.select(
        "item_a", "item_b", "n_both", "n_a", "n_b", F.lit(n_records).cast("long").alias("n_records"),
        (F.col("n_both").cast("double") * n_records / (F.col("n_a").cast("double") * F.col("n_b"))).alias("lift"),
    )
