"""Cleaning of ratings: each rule takes frames and gives frames, and can report what it changed.

Every rule is one declarative plan; counts for the log come from the same plan by conditional aggregates, never from
collected rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from folioforge.functions.numeric import half_up
from folioforge.functions.text import matches_any, series_number, title_key
from folioforge.session import BROADCAST_BYTES, Scratch

#: Title patterns of collections, non-books and adaptations.
COLLECTION_PATTERNS = (
    r"#\s*\d+(\.\d+)?\s*(-|–|—)\s*#?\s*\d+",
    r"box(ed)?[ -]?set|boxset|omnibus|\bbundle\b|\d+[ -]book (set|collection)",
    r"\b(\d|two|three|four|five|six|seven) (books|novels) in one|\d-in-1|\d in 1\b",
)
NONBOOK_PATTERNS = (
    r"sheet music|piano[ /-]vocal|vocal selections|\bfor (soprano|flute|clarinet|violin|trumpet|piano solo)\b",
    r"\bcolou?ring book\b",
    r"\b(19|20)\d\d (wall |desk |day-to-day |engagement )?calendar\b",
    r"\bgreat courses\b",
)
ADAPTATION_PATTERNS = (
    r"graphic novel|\bmanga\b|\bcomic\b|no fear|sparknotes|cliffsnotes|study guide",
    r"oxford bookworms|classic starts|\bretold\b|abridged|adaptation|\bsampler\b",
    r"\bpart (\d+|one|two|three|four|i+)\b|\bvol(ume)?\.? ?\d+",
    r"\d+ ?[-–] ?\d+\)|\d+ book series|\(books? \d|\d+ stories\)|integral|preview",
)


def shape(df: DataFrame, user: str = "user_id", work: str = "work_id") -> DataFrame:
    """(n_rows, n_users, n_works) in one pass."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(user).alias("n_users"), F.count_distinct(work).alias("n_works"))


def valid_rating(lo: float = 0, hi: float = 5) -> Column:
    c = F.col("user_id").isNotNull() & F.col("work_id").isNotNull() & F.col("rating").isNotNull() & ~F.isnan("rating")
    return F.coalesce(c & F.col("rating").between(lo, hi), F.lit(False))


def structural_report(ratings: DataFrame) -> DataFrame:
    """(n_before, n_valid, n_pairs): rows, rows in range with keys, distinct pairs among those."""
    ok = valid_rating()
    pair = F.when(ok, F.struct("user_id", "work_id"))
    return ratings.agg(F.count(F.lit(1)).alias("n_before"), F.count_if(ok).alias("n_valid"), F.count_distinct(pair).alias("n_pairs"))


def structural(ratings: DataFrame) -> DataFrame:
    """Valid rows, of each (user, work) the most informative: highest rating, most editions, latest, by an aggregate
    that collapses repeats before the shuffle."""
    best = F.max(F.struct("rating", "n_editions", "rated_at"))
    return ratings.filter(valid_rating()).groupBy("user_id", "work_id").agg(best.alias("b")).select("user_id", "work_id", "b.rating", "b.n_editions", "b.rated_at")


def to_work_level(ratings: DataFrame, lo: float = 1, hi: float = 5) -> DataFrame:
    """Explicit ratings as one per (user, work): rounded mean, rows behind it, least and greatest."""
    exact = F.col("rating").cast("decimal(10,4)")
    return (
        ratings.filter(valid_rating(lo, hi))
        .groupBy("user_id", "work_id")
        .agg(
            F.round((F.sum(exact).cast("double") / F.count(F.lit(1))), 6).alias("rating"),
            F.count(F.lit(1)).alias("n_editions"),
            F.min("rating").cast("double").alias("rating_min"),
            F.max("rating").cast("double").alias("rating_max"),
        )
    )


def conflict_report(work_level: DataFrame) -> DataFrame:
    return work_level.agg(
        F.count_if(F.col("n_editions") > 1).alias("pairs_repeated"),
        F.count_if(F.col("rating_min") != F.col("rating_max")).alias("pairs_conflicting"),
        F.count_if(F.col("rating_max") - F.col("rating_min") >= 2).alias("pairs_conflict_ge2"),
    )


def best_editions(works: DataFrame, editions: DataFrame) -> DataFrame:
    """The edition that stands for each work: its named best one, else the most rated, least id."""
    e = editions.filter(F.col("title").isNotNull() & F.col("work_id").isNotNull() & F.col("book_id").isNotNull())
    joined = e.join(works.select("work_id", "best_book_id"), "work_id")
    rank = F.struct(
        F.coalesce(F.col("book_id") == F.col("best_book_id"), F.lit(False)).cast("int"), F.coalesce("ratings_count", F.lit(-(1 << 62))), -F.col("book_id"), F.col("updated_at")
    )
    cols = ["book_id", "title", "title_without_series", "language_code", "publication_year"]
    return joined.groupBy("work_id").agg(F.max_by(F.struct(*cols), rank).alias("b")).select("work_id", *[F.col(f"b.{c}") for c in cols])


def build_catalog(works: DataFrame, editions: DataFrame, patterns: Sequence[str] = COLLECTION_PATTERNS) -> DataFrame:
    """Works that have an edition and a title, with the best edition's fields and the collection flag."""
    b = best_editions(works, editions).select(
        "work_id", F.col("book_id").alias("b_book"), F.col("title").alias("b_title"), F.col("title_without_series").alias("b_plain"),
        F.col("language_code").alias("b_lang"), F.col("publication_year").alias("b_year"),
    )
    has = editions.filter("work_id is not null").select("work_id").distinct()
    title = F.coalesce("b_plain", "b_title", "original_title")
    return (
        works.join(has, "work_id", "left_semi")
        .join(b, "work_id", "left")
        .select(
            "work_id",
            F.coalesce("b_book", "best_book_id").alias("best_book_id"),
            title.alias("title"),
            "original_title",
            F.col("b_title").alias("best_edition_title"),
            F.coalesce("publication_year", "b_year").alias("publication_year"),
            F.col("b_lang").alias("language_code"),
            "media_type",
            F.col("gr_ratings_count"),
            matches_any(F.col("b_title"), patterns).alias("is_collection"),
        )
        .filter(F.col("title").isNotNull())
    )


def flag_nonbooks(catalog: DataFrame, patterns: Sequence[str] = NONBOOK_PATTERNS, exceptions: Sequence[int] = ()) -> DataFrame:
    text = F.concat_ws(" | ", F.coalesce("title", F.lit("")), F.coalesce("best_edition_title", F.lit("")))
    hit = matches_any(text, patterns)
    if exceptions:
        hit = hit & ~F.col("work_id").isin(list(exceptions))
    return catalog.withColumn("is_nonbook", hit)


def drop_works(ratings: DataFrame, works: DataFrame) -> DataFrame:
    return ratings.join(works.select("work_id"), "work_id", "left_anti").select(*ratings.columns)


def primary_authors(works: DataFrame, editions: DataFrame, authors: DataFrame) -> DataFrame:
    """(work_id, author_id): the first known author of the work's best edition that has authors."""
    e = editions.filter((F.size(F.coalesce("author_ids", F.array().cast("array<bigint>"))) > 0) & F.col("work_id").isNotNull() & F.col("book_id").isNotNull())
    joined = e.join(works.select("work_id", "best_book_id"), "work_id")
    rank = F.struct(
        F.coalesce(F.col("book_id") == F.col("best_book_id"), F.lit(False)).cast("int"), F.coalesce("ratings_count", F.lit(-(1 << 62))), -F.col("book_id"), F.col("updated_at")
    )
    source = joined.groupBy("work_id").agg(F.max_by("author_ids", rank).alias("ids"))
    placed = source.select("work_id", F.posexplode("ids").alias("pos", "author_id"))
    return placed.join(authors.select("author_id"), "author_id", "left_semi").groupBy("work_id").agg(F.min_by("author_id", "pos").alias("author_id"))


def find_shadows(catalog: DataFrame, primary: DataFrame, ratings: DataFrame, max_share: float = 0.1, patterns: Sequence[str] = ADAPTATION_PATTERNS) -> DataFrame:
    """(shadow_work_id, main_work_id): works of the same title and main author with less than ``max_share`` of the
    most-rated one's ratings, unless a series number tells them apart."""
    counts = ratings.groupBy("work_id").agg(F.count(F.lit(1)).alias("n"))
    text = F.concat_ws(" | ", F.coalesce("title", F.lit("")), F.coalesce("best_edition_title", F.lit("")))
    keyed = (
        catalog.filter(~F.coalesce("is_collection", F.lit(False)) & ~matches_any(text, patterns))
        .join(primary, "work_id")
        .join(counts, "work_id")
        .select("work_id", "author_id", "n", title_key(F.col("title")).alias("key"), series_number(F.col("best_edition_title")).alias("no"))
        .filter("key <> ''")
    )
    lead = keyed.groupBy("key", "author_id").agg(F.max(F.struct("n", -F.col("work_id"), "no")).alias("m"))
    lead = lead.select("key", "author_id", (-F.col("m.col2")).alias("main_work_id"), F.col("m.n").alias("main_n"), F.col("m.no").alias("main_no"))
    both = keyed.join(lead, ["key", "author_id"])
    ok = (F.col("work_id") != F.col("main_work_id")) & ((F.col("no") == F.col("main_no")) | (F.col("no") == "")) & (F.col("n") < max_share * F.col("main_n"))
    return both.filter(ok).select(F.col("work_id").alias("shadow_work_id"), "main_work_id")


def merge_shadows(ratings: DataFrame, merges: DataFrame) -> DataFrame:
    """Ratings of shadow works moved to their main work; two of one reader become the edition-weighted mean."""
    m = merges.groupBy("shadow_work_id").agg(F.min("main_work_id").alias("main_work_id"))
    moved = ratings.join(m, ratings["work_id"] == m["shadow_work_id"], "left").select(
        "user_id", F.coalesce("main_work_id", "work_id").alias("work_id"), F.col("rating").cast("decimal(12,6)").alias("r"), F.col("n_editions").cast("long").alias("k")
    )
    total = F.sum(F.col("r") * F.col("k")).cast("double") / F.sum("k")
    return moved.groupBy("user_id", "work_id").agg(F.round(total, 6).alias("rating"), F.sum("k").alias("n_editions"))


def user_stats(ratings: DataFrame) -> DataFrame:
    """(user_id, n, mean, sd, mode_share) with six digits, so that thresholds decide alike on every run."""
    n = F.count(F.lit(1))
    r = F.col("rating").cast("decimal(12,6)")
    mean = F.sum(r).cast("double") / n
    var = F.sum((r * r).cast("decimal(24,8)")).cast("double") / n - mean * mean
    mode = F.greatest(*[F.count_if(half_up(F.col("rating")) == s) / n for s in range(1, 6)])
    return ratings.groupBy("user_id").agg(
        n.alias("n"), F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.greatest(var, F.lit(0.0))), 6).alias("sd"), F.round(mode, 6).alias("mode_share")
    )


def filter_users(ratings: DataFrame, max_sd: float = 0.2, min_n: int = 10, mode_share: float = 0.9, max_n: int = 3000) -> DataFrame:
    """Ratings of users whose stars vary and who are no bulk accounts."""
    odd = ((F.col("n") >= min_n) & ((F.col("sd") < max_sd) | (F.col("mode_share") >= mode_share))) | (F.col("n") > max_n)
    return ratings.join(user_stats(ratings).filter(odd).select("user_id"), "user_id", "left_anti").select(*ratings.columns)


def user_filter_report(ratings: DataFrame, max_sd: float = 0.2, min_n: int = 10, mode_share: float = 0.9, max_n: int = 3000) -> DataFrame:
    s = user_stats(ratings)
    return s.agg(
        F.count(F.lit(1)).alias("n_users"),
        F.count_if((F.col("n") >= min_n) & (F.col("sd") < max_sd)).alias("low_variance"),
        F.count_if((F.col("n") >= min_n) & (F.col("mode_share") >= mode_share)).alias("monotone"),
        F.count_if(F.col("n") > max_n).alias("hyperactive"),
    )


def kcore(ratings: DataFrame, min_user: int, min_work: int) -> tuple[DataFrame, int]:
    """Rows left when users below ``min_user`` and works below ``min_work`` ratings are removed until none is.

    Pairs are written twice: as they come and after the first pass, which removes most. From then on only counts move:
    a pass reads the pairs of the keys that just fell and takes them from the counts on the other side, which loses
    nothing, as a key falls once and the counts of fallen keys no longer matter. Every pass but the last lets a key
    fall, so the passes end. Gives (rows, passes).
    """
    scratch = Scratch(ratings.sparkSession, "kcore")
    n = F.count(F.lit(1)).alias("c")
    pairs = scratch.put(ratings.select("user_id", "work_id"))
    users = pairs.groupBy("user_id").agg(n).filter(F.col("c") >= min_user).select("user_id")
    kept = pairs.join(users, "user_id", "left_semi")
    works = kept.groupBy("work_id").agg(n).filter(F.col("c") >= min_work).select("work_id")
    alive = scratch.put(kept.join(works, "work_id", "left_semi").select("user_id", "work_id"))
    scratch.drop(pairs)
    least = {"user_id": min_user, "work_id": min_work}
    n_fallen: dict[str, int] = {}

    def counted(df: DataFrame, key: str, c: Column, before: Column) -> DataFrame:
        """(key, c, fell), written; ``n_fallen`` is counted while it is."""
        seen = Observation()
        fell = ((before >= least[key]) & (c < least[key])).alias("fell")
        out = scratch.put(df.select(key, c.alias("c"), fell).observe(seen, F.count_if("fell").alias("n")))
        n_fallen[key] = seen.get.get("n") or 0
        return out

    # In the first pass users were counted before works fell, so a user may fall at once; no work can.
    first = F.lit(1 << 62)
    counts = {k: counted(alive.groupBy(k).agg(n), k, F.col("c"), first) for k in least}
    passes, side, other = 1, "user_id", "work_id"
    fresh = set(least)  # sides whose counts are new since their fallen keys were taken out
    while fresh:
        passes += 1
        if side in fresh and n_fallen[side]:
            fallen = counts[side].filter("fell").select(side)
            some = F.broadcast(fallen) if n_fallen[side] * 16 <= BROADCAST_BYTES else fallen
            # The counts and what is taken from them meet in one aggregate: a join would send a second table in each pass.
            gone = alive.join(some, side, "left_semi").select(other, F.lit(None).cast("long").alias("c"), F.lit(1).alias("d"))
            both = counts[other].select(other, "c", F.lit(0).alias("d")).union(gone).groupBy(other).agg(F.max("c").alias("before"), F.sum("d").alias("d"))
            new = counted(both, other, F.col("before") - F.col("d"), F.col("before"))
            scratch.drop(counts[other])
            counts[other] = new
            fresh.add(other)
        fresh.discard(side)
        side, other = other, side
    counts = {k: c.filter(F.col("c") >= least[k]) for k, c in counts.items()}
    core = ratings.join(counts["user_id"].select("user_id"), "user_id", "left_semi").join(counts["work_id"].select("work_id"), "work_id", "left_semi")
    return core.select(*ratings.columns), passes


def kcore_options(ratings: DataFrame, options: Sequence[tuple[int, int]]) -> DataFrame:
    """One row per (min_user, min_work): what is left, its share and density."""
    total = ratings.agg(F.count(F.lit(1)).alias("total"))
    out = None
    for ku, kw in options:
        core, _ = kcore(ratings, ku, kw)
        row = shape(core).crossJoin(F.broadcast(total)).select(
            F.lit(ku).alias("min_user"), F.lit(kw).alias("min_work"), "n_rows", "n_users", "n_works",
            F.round(F.col("n_rows") / F.col("total"), 6).alias("kept_share"),
            F.round(F.col("n_rows") / F.nullif(F.col("n_users") * F.col("n_works"), F.lit(0)), 9).alias("density"),
        )
        out = row if out is None else out.unionByName(row)
    return out
