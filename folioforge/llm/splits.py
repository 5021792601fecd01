"""Splits that keep related records together.

Readers are the distinct non-null ids of the records; readers whose account identifier is the same are one
person, found as connected components by hooking and shortcutting. Whole persons are put into splits whose sizes
come as close to the wanted proportions as any choice of whole persons can: person sizes with their
multiplicities are a subset-sum problem, solved with bitsets.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.components import hook_components
from folioforge.session import Scratch, small_or_plain


def identifier(raw: Column) -> Column:
    """A 32-digit hexadecimal identifier as 16 bytes, however it is written (case, blanks, dashes, braces, quotes,
    ``urn:uuid:`` or another ``word:`` prefix); null for a missing value, anything else, and dummies: identifiers
    that use fewer than five different digits or that repeat a shorter stretch."""
    # One pass takes off prefixes and signs, one pattern checks what is left: no expression is worked out twice.
    bare = F.regexp_replace(F.lower(raw), r"^[^0-9a-z]*(?:[a-z_]+[:=/])+|^0x|[^0-9a-z]+", "")
    few = r"(.)\2*+(.)(?:\2|\3)*+(?:(.)(?:\2|\3|\4)*+(?:(.)(?:\2|\3|\4|\5)*+)?)?$"
    good = rf"^(?!(.{{1,16}})\1+$)(?!{few})[0-9a-f]{{32}}$"
    found = F.unhex(F.regexp_extract(bare, good, 0))
    return F.nullif(found, F.lit(b""))


def same_identifier(users: DataFrame, user: str, external: str, scratch: Scratch) -> DataFrame:
    """(user, ident) of the users whose identifier at least one other user has, each row once."""
    known = users.select(F.col(user).alias("user"), identifier(F.col(external)).alias("ident")).filter("user is not null and ident is not null")
    # Only the least and the greatest holder travel, not the rows.
    shared = scratch.put(known.groupBy("ident").agg(F.min("user").alias("lo"), F.max("user").alias("hi")).filter("lo < hi"))
    held = known.join(small_or_plain(scratch, shared.select("ident", "lo"), shared), "ident")
    return scratch.put(held.distinct())


def person_groups(users: DataFrame, user: str, external: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """((user, ident, lo) held in common, (v, group_id) components of those users)."""
    held = same_identifier(users, user, external, scratch)
    return held, hook_components(held, "user", "lo")


def linked_pairs(users: DataFrame, user: str = "user_id", external: str = "external_id") -> DataFrame:
    """(user_a, user_b), user_a < user_b: users of one component that hold the same identifier.

    Pairs are formed inside components and checked against the identifier itself, since a component may also hold
    users joined only through a third one. Repeated rows, missing identifiers and dummies add nothing.
    """
    scratch = Scratch(users.sparkSession, "linked")
    held, groups = person_groups(users, user, external, scratch)
    member = held.join(groups, held["user"] == groups["v"]).select("group_id", "ident", "user")
    a = member.withColumnRenamed("user", "user_a")
    b = member.withColumnRenamed("user", "user_b")
    return a.join(b, ["group_id", "ident"]).filter("user_a < user_b").select("user_a", "user_b").distinct()


def _reach(counts: Mapping[int, int]) -> list[tuple[int, int, int]]:
    """Multiplicities cut into powers of two: (size, how many at once, weight)."""
    items = []
    for size, n in sorted(counts.items(), reverse=True):
        step = 1
        while n:
            take = min(step, n)
            items.append((size, take, size * take))
            n -= take
            step *= 2
    return items


def _pick(items: list[tuple[int, int, int]], start: int, low: int, high: int, target: int) -> tuple[int, list[bool]]:
    """Which items (.., signed weight) lead from total ``start`` to the total nearest to ``target`` (the smaller on a
    tie), and that total; totals stay between ``low`` and ``high``. Bit t - low of an integer says that t is reached."""
    reach, full, masks = 1 << (start - low), (1 << (high - low + 1)) - 1, []
    for _, _, w in items:
        masks.append(reach)
        reach |= (reach << w if w >= 0 else reach >> -w) & full
    best = next(t for d in range(high - low + 1) for t in (target - d, target + d) if low <= t <= high and reach >> (t - low) & 1)
    at, used = best, []
    for (_, _, w), before in zip(reversed(items), reversed(masks), strict=True):
        out = before >> (at - low) & 1
        used.append(not out)
        if not out:
            at -= w
    return best, used[::-1]


def closest_subset(counts: Mapping[int, int], target: int, direct_bits: int = 1 << 23) -> dict[int, int]:
    """How many groups of each size make a total as close to ``target`` as possible (the smaller total on a tie). Exact.

    Where totals up to twice the target fit ``direct_bits``, one bitset holds them all. Beyond, the sizes are filled up in
    turn until the target is passed; some nearest total differs from that filling by at most 3 m + 3 groups, m the
    largest size (the proximity of whole and fractional solutions of one equation), so a bitset of the differences,
    6 m (m + 1) bits however large the target, holds a nearest total too.
    """
    if 2 * target + 2 <= direct_bits:
        taken = dict.fromkeys(counts, 0)
        items = [(s, n, w) for s, n, w in _reach(counts) if w <= 2 * target + 1]
        _, used = _pick(items, 0, 0, 2 * target + 1, target)
        for (size, n, _), yes in zip(items, used, strict=True):
            taken[size] += n if yes else 0
        return taken
    taken, left = dict.fromkeys(counts, 0), target
    for size, n in sorted(counts.items(), reverse=True):
        taken[size] = min(n, left // size)
        left -= size * taken[size]
    most = 3 * max(counts, default=0) + 3
    span = most * max(counts, default=0)
    more = [(s, n, w) for s, n, w in _reach({s: min(most, n - taken[s]) for s, n in counts.items()})]
    less = [(s, -n, -w) for s, n, w in _reach({s: min(most, taken[s]) for s in counts})]
    _, used = _pick(more + less, 0, -span, span, left)
    for (size, n, _), yes in zip(more + less, used, strict=True):
        taken[size] += n if yes else 0
    return taken


def grouped_split(
    readers: DataFrame, groups: DataFrame, shares: Mapping[str, float], seed: int = 7
) -> DataFrame:
    """(user_id, group_id, split) for each row of ``readers`` (user_id, unique).

    ``groups`` (v, group_id) joins readers into persons; a reader without a row there is a person of one. ``shares``
    are proportions of the readers; the last split takes what the others leave. Only the table of person sizes goes
    to the driver (one row per different size).
    """
    scratch = Scratch(readers.sparkSession, "split")
    named = readers.join(groups.withColumnRenamed("v", "user_id"), "user_id", "left").select(
        "user_id", F.coalesce("group_id", "user_id").cast("long").alias("group_id")
    )
    named = scratch.put(named)
    sized = named.groupBy("group_id").agg(F.count(F.lit(1)).alias("size")).withColumn("draw", F.xxhash64("group_id", F.lit(seed)))
    parts = int(readers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Exact numbering inside each size: range-sort by (size, draw), so that the one size most persons have spans all
    # partitions, and add the partitions' offsets.
    placed = scratch.put(
        sized.repartitionByRange(parts, "size", "draw", "group_id")
        .sortWithinPartitions("size", "draw", "group_id")
        .select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("pos"))
    )
    stats = placed.groupBy("part", "size").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    w = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = scratch.put(stats.withColumn("from", F.coalesce(F.sum("n").over(w), F.lit(0))))
    counts = {r["size"]: r["n"] for r in starts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    total = sum(s * n for s, n in counts.items())
    rest, bounds, used = dict(counts), [], dict.fromkeys(counts, 0)
    names = list(shares)
    for name in names[:-1]:
        take = closest_subset(rest, round(total * shares[name]))
        for s, k in take.items():
            if k:
                bounds.append((s, used[s], used[s] + k, name))
            rest[s] -= k
            used[s] += k
    cut = readers.sparkSession.createDataFrame(bounds, "size long, lo long, hi long, split string")
    ranked = placed.join(small_or_plain(scratch, starts.select("part", "size", "first", "from"), starts), ["part", "size"]).withColumn(
        "place", F.col("from") + F.col("pos") - F.col("first")
    )
    # As many rows as different sizes times splits.
    chosen = ranked.join(F.broadcast(cut), (ranked["size"] == cut["size"]) & F.col("place").between(F.col("lo"), F.col("hi") - 1), "left").select(
        "group_id", F.coalesce("split", F.lit(names[-1])).alias("split")
    )
    return named.join(chosen, "group_id").select("user_id", "group_id", "split")
