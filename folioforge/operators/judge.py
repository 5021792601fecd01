"""Judging of variants against a base: paired differences by stage, choice under a guard, and a noise control."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.numeric import draw

#: Half the width of a 95 % interval in standard errors.
WIDE = 1.96


def interval(d: Column, digits: int = 6) -> list[Column]:
    """n, diff, lo, hi of the mean of paired differences; nulls do not count, and one pair has no interval."""
    n, mean, se = F.count(d), F.avg(d), F.stddev_samp(d) / F.sqrt(F.count(d))
    return [n.alias("n"), F.round(mean, digits).alias("diff"), F.round(mean - WIDE * se, digits).alias("lo"), F.round(mean + WIDE * se, digits).alias("hi")]


def verdict(lo: Column, hi: Column) -> Column:
    """'better' or 'worse' if the interval leaves out zero, else 'same'."""
    return F.when(lo > 0, "better").when(hi < 0, "worse").otherwise("same")


def paired_by_stage(a: DataFrame, b: DataFrame, col: str, stages: DataFrame, key: str = "user_id") -> DataFrame:
    """(stage, n, diff, lo, hi, verdict): b minus a over the keys both have, for each stage of ``stages`` (key, stage) and
    for all keys."""
    pairs = a.select(key, F.col(col).alias("_a")).join(b.select(key, F.col(col).alias("_b")), key).join(stages, key)
    out = pairs.select("stage", (F.col("_b") - F.col("_a")).alias("_d")).rollup("stage").agg(*interval(F.col("_d")))
    return out.select(F.coalesce("stage", F.lit("all")).alias("stage"), "n", "diff", "lo", "hi", verdict(F.col("lo"), F.col("hi")).alias("verdict"))


def choose(per_key: DataFrame, variant: str, base, measure: str, guard: str, key: str = "user_id") -> DataFrame:
    """(variant, n, diff, lo, hi, guarded, chosen): each variant's paired difference from the base in ``measure``. A variant
    is guarded if its ``guard`` measure is not surely below the base's; chosen is the guarded one with the greatest sure
    gain (lo above zero), ties to the smaller variant, else the base."""
    old = per_key.filter(F.col(variant) == F.lit(base)).select(key, F.col(measure).alias("_m"), F.col(guard).alias("_g"))
    d = per_key.join(old, key).select(variant, (F.col(measure) - F.col("_m")).alias("_d"), (F.col(guard) - F.col("_g")).alias("_e"))
    e, n = F.col("_e"), F.count("_e")
    guarded = F.coalesce(F.round(F.avg(e) + WIDE * F.stddev_samp(e) / F.sqrt(n), 6) >= 0, F.lit(False))
    rows = d.groupBy(variant).agg(*interval(F.col("_d")), guarded.alias("guarded"))
    able = rows.filter(F.col("guarded") & (F.col("lo") > 0)).agg(F.max(F.struct("diff", (-F.col(variant)).alias("v"))).alias("best"))
    best = F.coalesce(-F.col("best.v"), F.lit(base))
    return rows.crossJoin(F.broadcast(able)).select(variant, "n", "diff", "lo", "hi", "guarded", (F.col(variant) == best).alias("chosen"))  # one row


def noise(salt: int, user: str = "user_id", item: str = "work_id") -> Column:
    """A draw from -0.5 to 0.5 for each pair, the same on every run: what stands in for taste in the control."""
    return draw(F.concat_ws(":", user, item), salt) - 0.5


def noise_at(curve: Sequence[tuple[float, float]], hits: float) -> float | None:
    """Quality of the noise control at a number of hits, on straight lines between the (hits, quality) points of its curve;
    None outside them."""
    points = sorted(curve)
    for (h0, q0), (h1, q1) in zip(points, points[1:]):
        if h0 <= hits <= h1:
            return q1 if h1 == h0 else q0 + (q1 - q0) * (hits - h0) / (h1 - h0)
    return points[0][1] if points and points[0][0] == hits else None


def left_out_scores(inputs: DataFrame, links: DataFrame, pair_works: int = 2048) -> DataFrame:
    """(user_id, work_id, score): for each work of a reader's inputs (user_id, work_id, x), unique, what the others say of
    it by ``links`` (src, dst, w). Links have no diagonal, so leaving a work out changes no other term.

    Most readers have few works, and a work that nearly everyone read has links to nearly all: a reader's own pairs are
    formed and looked up among the links. Readers of more than ``pair_works`` works meet the links of each of their works
    instead, so that neither side is squared.
    """
    sized = inputs.join(inputs.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")), "user_id")
    few, many = sized.filter(F.col("_n") <= pair_works), sized.filter(F.col("_n") > pair_works)

    def works(df: DataFrame, name: str, *more: str) -> DataFrame:
        return df.select("user_id", F.col("work_id").alias(name), *more)

    pairs = works(few, "src", "x").join(works(few, "dst"), "user_id").filter("src <> dst").join(links, ["src", "dst"])
    said = works(many, "src", "x").join(links, "src").join(works(many, "dst"), ["user_id", "dst"])
    cols = ["user_id", "dst", "x", "w"]
    own = pairs.select(*cols).unionByName(said.select(*cols))
    return own.groupBy("user_id", F.col("dst").alias("work_id")).agg(F.sum(F.col("x") * F.col("w")).alias("score"))
