"""Ranked lists over (user, item, score) frames, and what is measured on them.

'Not a candidate' is the absence of a row, never a special number.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.numeric import gain, half_up
from folioforge.operators.skew import numbered
from folioforge.session import Scratch, small_or_plain


def top_k(scores: DataFrame, k: int, exclude: DataFrame | None = None, user: str = "user_id", item: str = "work_id") -> DataFrame:
    """First k candidates of each user by score, ties to the smaller item, without the excluded pairs; adds ``rank``.
    The rank filter is pushed into the window, which keeps k rows per user before the shuffle."""
    if exclude is not None:
        scores = scores.join(exclude.select(user, item), [user, item], "left_anti")
    w = Window.partitionBy(user).orderBy(F.desc("score"), item)
    return scores.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def numbered_ranking(scores: DataFrame, scratch: Scratch, item: str = "work_id") -> DataFrame:
    """(place, item, score), written once: items by falling score, ties to the smaller item, from 1. Numbered over range
    partitions, never in one task."""
    ordered = numbered(scores.select(item, "score", (-F.col("score")).alias("_key")), "_key", [item], scratch)
    return scratch.put(ordered.select((F.col("_row") + 1).alias("place"), item, "score"))


def top_unread(read: DataFrame, ranking: DataFrame, k: int, scratch: Scratch, user: str = "user_id", item: str = "work_id") -> DataFrame:
    """(user, item, score, rank): the first k items of one ``numbered_ranking`` that a user has not read, for every user
    of ``read``.

    The places a user has read cut the ranking into unread stretches; only the stretches, or parts of them, up to the
    k-th unread place are opened, so k rows a user meet the ranking, however much the user has read.
    """
    places = small_or_plain(scratch, ranking.select(item, "place"), ranking)
    seen = read.select(user, item).join(places, item).select(user, "place")
    marks = seen.union(read.select(user, F.lit(0).cast("long"))).distinct()
    w = Window.partitionBy(user).orderBy("place")
    unread = F.col("place") - F.row_number().over(w) + 1  # unread places up to this mark
    cut = marks.select(user, "place", unread.alias("before"), F.lead("place").over(w).alias("next")).filter(F.col("before") < k)
    last = F.least(F.col("place") + k - F.col("before"), F.coalesce(F.col("next") - 1, F.lit(1 << 62)))
    opened = cut.filter(last > F.col("place")).select(user, "place", "before", F.explode(F.sequence(F.col("place") + 1, last)).alias("at"))
    rows = opened.select(user, F.col("at").alias("place"), (F.col("before") + F.col("at") - F.col("place")).alias("rank"))
    return rows.join(small_or_plain(scratch, ranking), "place").select(user, item, "score", "rank")


def z_scores(scores: DataFrame, col: str, out: str, user: str = "user_id") -> DataFrame:
    """Population z-score over a user's candidates; the deviation is 1e-9 at least."""
    w = Window.partitionBy(user)
    return scores.withColumn(out, (F.col(col) - F.avg(col).over(w)) / F.greatest(F.stddev_pop(col).over(w), F.lit(1e-9)))


def personal_percentile(scores: DataFrame, user: str = "user_id") -> DataFrame:
    """Adds ``pct``: (candidates above + 1) / candidates of the user; equal scores share a place."""
    above = F.rank().over(Window.partitionBy(user).orderBy(F.desc("score")))
    return scores.withColumn("pct", above / F.count(F.lit(1)).over(Window.partitionBy(user)))


def cutoff_scores(scores: DataFrame, n: int, weight: float, user: str = "user_id") -> DataFrame:
    """``final``: crowd plus weighted taste for the first n of the crowd; the others follow them in crowd order.

    A tie at the n-th place that would make more than n first ones stays outside.
    """
    u = Window.partitionBy(user)
    place = F.rank().over(u.orderBy(F.desc("crowd")))
    tied = F.count(F.lit(1)).over(Window.partitionBy(user, "crowd"))
    s = scores.withColumn("_inside", (place + tied - 1) <= n).withColumn("_s", F.col("crowd") + weight * F.col("taste"))
    floor = F.min(F.when(F.col("_inside"), F.col("_s"))).over(u)
    best_out = F.max(F.when(~F.col("_inside"), F.col("crowd"))).over(u)
    outside = F.col("crowd") + F.coalesce(floor - best_out - 1.0, F.lit(0.0))
    return s.withColumn("final", F.when(F.col("_inside"), F.col("_s")).otherwise(outside)).drop("_inside", "_s")


def author_cap(ranked: DataFrame, top: int, user: str = "user_id") -> DataFrame:
    """Of a ranked list the first max(1, top // 10) items of each author, then the first ``top``; unknown authors
    have no limit."""
    cap = max(1, top // 10)
    place = F.row_number().over(Window.partitionBy(user, "author_id").orderBy("rank"))
    kept = ranked.withColumn("_a", place).filter(F.col("author_id").isNull() | (F.col("_a") <= cap)).drop("_a")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(user).orderBy("rank")).cast("bigint")).filter(F.col("place") <= top)


def list_metrics(top: DataFrame, hidden: DataFrame, k: int = 20) -> DataFrame:
    """(user_id, ndcg, recall, map, low) of each user with hidden ratings; null where a measure has no meaning.

    ``top`` has (user_id, work_id, rank), ``hidden`` (user_id, work_id, rating).
    """
    h = hidden.select("user_id", "work_id", gain(F.col("rating")).alias("g"), (half_up(F.col("rating")) <= 2).cast("int").alias("bad"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("g"), "work_id"))
    ideal = h.withColumn("p", place).groupBy("user_id").agg(
        F.sum(F.when(F.col("p") <= k, F.col("g") / F.log2(F.col("p") + 1)).otherwise(0.0)).alias("idcg"),
        F.count_if(F.col("g") > 0).alias("n_rel"),
        F.sum("bad").alias("n_low"),
    )
    hits = top.filter(F.col("rank") <= k).join(h, ["user_id", "work_id"])
    so_far = F.sum((F.col("g") > 0).cast("int")).over(Window.partitionBy("user_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    got = hits.withColumn("c", so_far).groupBy("user_id").agg(
        F.sum(F.col("g") / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.count_if(F.col("g") > 0).alias("n_hit"),
        F.sum(F.when(F.col("g") > 0, F.col("c") / F.col("rank")).otherwise(0.0)).alias("ap"),
        F.sum("bad").alias("low_hit"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    denom = F.least(F.col("n_rel"), F.lit(k))
    return ideal.join(got, "user_id", "left").select(
        "user_id",
        F.when(F.col("idcg") > 0, F.round(zero("dcg") / F.col("idcg"), 9)).alias("ndcg"),
        F.when(F.col("n_rel") > 0, F.round(zero("n_hit") / denom, 9)).alias("recall"),
        F.when(F.col("n_rel") > 0, F.round(zero("ap") / denom, 9)).alias("map"),
        F.when(F.col("n_low") > 0, F.round(zero("low_hit") / F.col("n_low"), 9)).alias("low"),
    )


def auc_by_group(df: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """(group, n_pos, n_neg, auc) from average ranks, ties shared; null where a class is empty."""
    tied = F.count(F.lit(1)).over(Window.partitionBy(group, score))
    r = F.rank().over(Window.partitionBy(group).orderBy(score)) + (tied - 1) / 2
    ranked = df.withColumn("_r", r)
    pos = F.count_if(F.col(label) == 1)
    neg = F.count_if(F.col(label) == 0)
    u = F.sum(F.when(F.col(label) == 1, F.col("_r")).otherwise(0.0)) - pos * (pos + 1) / 2
    return ranked.groupBy(group).agg(pos.alias("n_pos"), neg.alias("n_neg"), F.round(u / F.nullif(pos * neg, F.lit(0)), 9).alias("auc"))


def reliability(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """(bin, n, promised, actual) over equal-width bins of the promised probability."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 6).alias("promised"), F.round(F.avg(y), 6).alias("actual"))


def probability_losses(df: DataFrame, p: str, y: str, eps: float = 1e-6) -> DataFrame:
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    loss = -(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(loss), 6).alias("log_loss"), F.round(F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))), 6).alias("brier"))


def paired_difference(a: DataFrame, b: DataFrame, key: str, cols: Mapping[str, str]) -> DataFrame:
    """Mean of b minus a over the keys both have, per measure, with the number of pairs and the standard error."""
    j = a.select(key, *[F.col(c).alias(f"a_{c}") for c in cols]).join(b.select(key, *[F.col(c).alias(f"b_{c}") for c in cols]), key)
    aggs = []
    for c, out in cols.items():
        d = F.col(f"b_{c}") - F.col(f"a_{c}")
        aggs += [F.count(d).alias(f"{out}_n"), F.round(F.avg(d), 6).alias(f"{out}_diff"), F.round(F.stddev_samp(d) / F.sqrt(F.count(d)), 6).alias(f"{out}_se")]
    return j.agg(*aggs)


def bootstrap_interval(per_user: DataFrame, col: str, replicates: int = 200, salt: int = 0) -> DataFrame:
    """(n, mean, lo, hi): 95 % interval of the mean from Poisson bootstrap weights, which need no resampling and are
    drawn from a hash of row and replicate; two aggregates, whatever the number of rows. Nulls do not count."""
    x = per_user.filter(F.col(col).isNotNull()).select(F.col(col).alias("x"), F.xxhash64("user_id", F.lit(salt)).alias("h"))
    # Cumulated Poisson(1) probabilities.
    edges = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    u = (F.pmod(F.xxhash64("h", "rep"), F.lit(1 << 30)) / float(1 << 30))
    weight = sum((F.when(u >= e, 1).otherwise(0) for e in edges), F.lit(0))
    reps = x.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", weight)
    means = reps.groupBy("rep").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("m"))
    lo_hi = means.agg(F.expr("percentile(m, 0.025)").alias("lo"), F.expr("percentile(m, 0.975)").alias("hi"))
    return x.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean")).crossJoin(F.broadcast(lo_hi))
