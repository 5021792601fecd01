"""Closed-form item links: the Gram matrix, its inverse and the links are tables of blocks throughout.

The driver holds no matrix; it sees one number of each of the ``n_top`` most rated works (their diagonal cells).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.numeric import half_up
from folioforge.models import blocks
from folioforge.operators import spread
from folioforge.operators.gram import coded_products, dense_items, item_products
from folioforge.session import Scratch, small_or_plain

#: Weights of one to five stars as input of the links.
STAR_INPUT = (-2.0, -1.0, 0.0, 1.0, 2.0)


def normalized_weights(weights: tuple[float, ...]) -> tuple[float, ...]:
    """Weights scaled so that the greatest in size is 2; all zero is an error."""
    most = max(abs(w) for w in weights)
    if most == 0:
        raise ValueError("all star weights are zero")
    return tuple(round(w * 2.0 / most, 6) for w in weights)


def star_weight(r, weights: tuple[float, ...] = STAR_INPUT):
    out = F.lit(None).cast("double")
    for star, w in enumerate(weights, 1):
        out = F.when(half_up(r) == star, F.lit(w)).otherwise(out)
    return out


def top_items(ratings: DataFrame, n_top: int) -> DataFrame:
    """(work_id, n) of the most rated works, ties to the smaller id."""
    return ratings.groupBy("work_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "work_id").limit(n_top)


def coread(ratings: DataFrame, least: int = 1) -> DataFrame:
    """(i, j, n), i < j: readers both works share."""
    return item_products(ratings.select("user_id", "work_id"), "user_id", "work_id", least=least)


class _Fit:
    """Ratings of the ``n_top`` most rated works over dense numbers, their products and block tables."""

    def __init__(self, ratings: DataFrame, n_top: int, values: dict, block: int):
        self.scratch = Scratch(ratings.sparkSession, "links")
        self.block = block
        self.items = dense_items(top_items(ratings, n_top).select("work_id"), "work_id", self.scratch)
        self.n = self.items.count()
        coded = ratings.join(small_or_plain(self.scratch, self.items), "work_id")
        self.rows = self.scratch.put(coded.select(F.col("user_id").cast("long").alias("r"), "k", *[c.cast("double").alias(v) for v, c in values.items()]))

    def products(self, values: list[str], pairs: list[tuple[int, int]]) -> DataFrame:
        return self.scratch.put(coded_products(self.rows, max(1, self.n), self.scratch, values, pairs))

    def own(self, cell) -> DataFrame:
        """(a, b, v): a diagonal cell of each work that anyone rated."""
        return self.rows.groupBy(F.col("k").alias("a")).agg(cell.alias("v")).select("a", F.col("a").alias("b"), "v")

    def table(self, cells: DataFrame, upper: bool) -> DataFrame:
        return blocks.from_cells(cells, self.n, self.scratch, upper, self.block)

    def links(self, full: DataFrame, weigh, topk: int, both: bool) -> DataFrame:
        """(src, dst, w): the strongest cells of the blocks, then of the matrix, with the works' own ids."""
        n, block = self.n, self.block

        def cells(bi: int, bj: int, *data: np.ndarray) -> np.ndarray:
            shape = blocks.width_of(bi, n, block), blocks.width_of(bj, n, block)
            w = weigh(bi, bj, *(d.reshape(shape) for d in data))
            if bi == bj:
                np.fill_diagonal(w, 0.0)
            return w

        best = strongest(blocks.strongest_cells(full, n, topk, cells, both, block), topk, both)
        names = small_or_plain(self.scratch, self.items)
        named = best.join(names.select(F.col("k").alias("src"), F.col("work_id").alias("_s")), "src").join(names.select(F.col("k").alias("dst"), F.col("work_id").alias("_d")), "dst")
        with blocks.few_rows(self.scratch.spark):
            return self.scratch.put(named.select(F.col("_s").alias("src"), F.col("_d").alias("dst"), "w"))


def fit_read(ratings: DataFrame, lam: float = 500.0, n_top: int = 1000, topk: int = 100, block: int = blocks.BLOCK) -> DataFrame:
    """(src, dst, w): links that predict who reads what: off-diagonal of I - P diag(1 / diag P), P = (X'X + lam)^-1."""
    f = _Fit(ratings, n_top, {}, block)
    cells = f.products([], []).select("a", "b", F.col("n").cast("double").alias("v")).unionByName(f.own(F.count(F.lit(1)) + F.lit(lam)))
    swept = blocks.swept(f.table(cells, True), f.n, f.scratch, block)
    d = blocks.diagonal(swept, f.n, block)

    def weigh(bi: int, bj: int, minus_p: np.ndarray) -> np.ndarray:
        return minus_p / -d[None, bj * block : bj * block + minus_p.shape[1]]

    return f.links(blocks.mirrored(swept, f.n, block), weigh, topk, False)


def fit_value(ratings: DataFrame, lam: float = 500.0, n_top: int = 1000, topk: int = 100, weights: tuple[float, ...] = STAR_INPUT, min_user: int = 1, min_support: int = 0, block: int = blocks.BLOCK) -> DataFrame:
    """(src, dst, w): links from weighted stars to rating minus three; kept are the strongest of each target and of each
    source among pairs that at least ``min_support`` readers share."""
    weights = normalized_weights(weights)
    active = ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= min_user).select("user_id")
    values = {"x": star_weight(F.col("rating"), weights), "y": half_up(F.col("rating")) - 3}
    f = _Fit(ratings, n_top, values, block)
    f.rows = f.rows.join(active.select(F.col("user_id").cast("long").alias("r")), "r", "left_semi")
    products = f.products(["x", "y"], [(0, 0), (0, 1), (1, 0)])
    x, y = F.col("x"), F.col("y")
    a = f.table(products.select("a", "b", F.col("s0").alias("v")).unionByName(f.own(F.sum(x * x) + F.lit(lam))).unionByName(f.items.join(f.rows, "k", "left_anti").select(F.col("k").alias("a"), F.col("k").alias("b"), F.lit(lam).alias("v"))), True)
    c = products.select(F.explode(F.array(F.struct("a", "b", F.col("s1").alias("v")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("s2").alias("v")))).alias("e")).select("e.*")
    c = f.table(c.unionByName(f.own(F.sum(x * y))), False)
    size = -(-f.n // block)
    both = blocks.put_blocks(f.scratch, a.unionByName(c.select("bi", (F.col("bj") + size).cast("int").alias("bj"), "data")))
    swept = blocks.swept(both, f.n, f.scratch, block)
    solved = swept.filter(F.col("bj") >= size).select("bi", (F.col("bj") - size).cast("int").alias("bj"), "data")
    ratio = blocks.diagonal(solved, f.n, block) / -blocks.diagonal(swept, f.n, block)
    full = blocks.mirrored(swept.filter(F.col("bj") < size), f.n, block).withColumnRenamed("data", "p").join(solved, ["bi", "bj"])
    if min_support:
        shared = f.table(products.select("a", "b", F.col("n").cast("double").alias("v")), True)
        full = full.join(blocks.mirrored(shared, f.n, block).withColumnRenamed("data", "shared"), ["bi", "bj"])

    def weigh(bi: int, bj: int, minus_p: np.ndarray, s: np.ndarray, shared: np.ndarray | None = None) -> np.ndarray:
        w = s + minus_p * ratio[None, bj * block : bj * block + s.shape[1]]
        return w if shared is None else np.where(shared >= min_support, w, 0.0)

    return f.links(full, weigh, topk, True)


def strongest(links: DataFrame, k: int, both: bool = True) -> DataFrame:
    """Links among the k strongest of their target or, with ``both``, of their source."""
    size = F.desc(F.abs("w"))
    by_dst = F.row_number().over(Window.partitionBy("dst").orderBy(size, "src"))
    if not both:
        return links.withColumn("_d", by_dst).filter(F.col("_d") <= k).drop("_d")
    by_src = F.row_number().over(Window.partitionBy("src").orderBy(size, "dst"))
    return links.withColumn("_d", by_dst).withColumn("_s", by_src).filter((F.col("_d") <= k) | (F.col("_s") <= k)).drop("_d", "_s")


def score(inputs: DataFrame, links: DataFrame, mirrored: bool = False) -> DataFrame:
    """(user_id, work_id, score): sum of input weight x times link weight; a pair of works is one link, with ``mirrored``
    one both ways."""
    return spread.sums(inputs.select("user_id", F.col("work_id").alias("src"), "x"), links, Scratch(inputs.sparkSession, "score"), mirrored)


def similar(links: DataFrame, work_id: int, k: int = 10) -> DataFrame:
    return links.filter((F.col("src") == work_id) & (F.col("w") > 0)).orderBy(F.desc("w"), "dst").limit(k).select(F.col("dst").alias("work_id"), "w")
