"""Column expressions over ratings, ranks and probabilities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Worth of one to five stars in list quality.
STAR_VALUE = {1: -1.0, 2: -0.5, 3: 0.5, 4: 1.0, 5: 2.0}


def half_up(r: Column) -> Column:
    return F.floor(r + 0.5)


def gain(r: Column) -> Column:
    """2 for five stars, 1 for four, 0 below, after rounding half up."""
    return F.when(half_up(r) >= 5, 2.0).when(half_up(r) >= 4, 1.0).otherwise(0.0)


def star_value(r: Column, values: Mapping[int, float] = STAR_VALUE) -> Column:
    out = None
    for star, v in values.items():
        out = F.when(half_up(r) == star, v) if out is None else out.when(half_up(r) == star, v)
    return out


def bucket_label(n: Column, edges: Sequence[int]) -> Column:
    """Label of the half-open bucket between neighbouring edges; null below the first."""
    out = None
    for lo, hi in zip(edges, [*edges[1:], None]):
        hit = (n >= lo) if hi is None else (n >= lo) & (n < hi)
        label = f"{lo}+" if hi is None else f"{lo}-{hi - 1}"
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def draw(key: Column, salt: int | str) -> Column:
    """A number in [0, 1) that depends on the key and the salt only: 52 bits of an MD5."""
    hexa = F.substring(F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string"))), 1, 13)
    return F.conv(hexa, 16, 10).cast("double") / float(1 << 52)


def clipped_logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))


def half_scale(r10: Column) -> Column:
    """Ten-step ratings to five stars, halves upward, at most five."""
    return F.least(F.lit(5), F.ceil(r10 / 2)).cast("int")
