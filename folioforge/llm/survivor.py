"""Best representative of each duplicate group: skyline selection.

Records of a group are points; more is better in every criterion. A record that another one matches or beats in
every criterion, and beats in one, is dominated. Layer 1 is what nothing dominates, layer k what only layers below
k dominate. The survivor is the first of layer 1 by the policy, and its null fields are filled from the first
record by (layer, policy) that has a value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.session import Scratch, small_or_plain

PICTURE = r"(?i)^https?://[^/?#\s]+/[^?#\s]*\.(?:jpe?g|png|gif|webp|bmp|tiff?|avif)(?:[?#]\S*)?$"


def latest_rows(df: DataFrame, key: str, when: str, ties: Sequence[str]) -> DataFrame:
    """One row per non-null ``key``: the one with the latest ``when`` (null is earliest), ties by the greatest of
    ``ties`` in turn, nulls lowest; exact repeats collapse. Columns: key, ``when`` and ``ties``.

    An aggregate, so repeats collapse before the shuffle and no key is sorted.
    """
    rank = F.struct(F.col(when), *[F.col(c) for c in ties])
    best = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(rank).alias("_best"))
    return best.select(key, F.col("_best")[when].alias(when), *[F.col("_best")[c].alias(c) for c in ties])


def covers(editions: DataFrame, image: str, work: str, most_works: int) -> DataFrame:
    """(image) of the addresses that are stand-ins: shown by more than ``most_works`` different works."""
    shown = editions.filter(F.col(work).isNotNull() & F.col(image).isNotNull()).select(image, work).distinct()
    return shown.groupBy(image).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most_works).select(image)


def _layers(rows: Column, dims: Sequence[str]) -> Column:
    """Array of (rec, layer) from an array of records that is sorted best first by all criteria.

    In that order a record can only be dominated by one before it, so a fold sees every dominator's layer.
    """

    def beats(a: Column, b: Column) -> Column:
        at_least, more = F.lit(True), F.lit(False)
        for d in dims:
            at_least = at_least & (a[d] >= b[d])
            more = more | (a[d] > b[d])
        return at_least & more

    first = F.slice(rows, 1, 1)
    start = F.transform(first, lambda r: F.struct(r.alias("rec"), F.lit(1).alias("layer")))

    def step(done: Column, r: Column) -> Column:
        over = F.filter(done, lambda d: beats(d["rec"], r))
        layer = F.coalesce(F.array_max(F.transform(over, lambda d: d["layer"])), F.lit(0)) + 1
        return F.concat(done, F.array(F.struct(r.alias("rec"), layer.alias("layer"))))

    return F.aggregate(F.slice(rows, 2, F.size(rows)), start, step)


def skyline_layers(points: DataFrame, key: str, dims: Sequence[str], record: str, layers: int, chunk: int = 32) -> DataFrame:
    """(key, record, dims..., layer) of the records in the first ``layers`` dominance layers of each group, exact.

    Groups above ``chunk`` rows are cut into chunks by a hash of the record; a record's layer in a chunk is never
    above its layer in the group, so a chunk keeps its first ``layers`` layers, and chunks eight times as large
    are formed from what is left until no group has more than one. Work per row is bounded by the chunk; fronts are
    small against groups unless the criteria contradict each other throughout.
    """
    scratch = Scratch(points.sparkSession, "skyline")
    cols = [key, *dims, record]
    # Criteria from a window of counts would sort hot groups in one task; an aggregate and a join do not.
    now = scratch.put(points.select(*cols))
    size = chunk
    while True:
        heavy = scratch.put(now.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > size))
        some_heavy = not heavy.isEmpty()
        if some_heavy:
            cut = now.join(heavy, key, "left").withColumn(
                "_chunk", F.when(F.col("_n").isNotNull(), F.pmod(F.xxhash64(record), F.ceil(F.col("_n") / size).cast("int"))).otherwise(0)
            )
        else:
            cut = now.withColumn("_chunk", F.lit(0))
        rec = F.struct(*[F.col(c) for c in [*dims, record]])
        # sort_array puts the greatest first: by the criteria in turn, which is an order that dominance never breaks.
        gathered = cut.groupBy(key, "_chunk").agg(F.sort_array(F.collect_list(rec), asc=False).alias("_rows"))
        kept = gathered.select(key, F.explode(F.filter(_layers(F.col("_rows"), dims), lambda r: r["layer"] <= layers)).alias("_r"))
        out = kept.select(key, *[F.col(f"_r.rec.{c}").alias(c) for c in [*dims, record]], F.col("_r.layer").alias("layer"))
        if not some_heavy:
            return out
        new = scratch.put(out.drop("layer"))
        scratch.drop(now)
        now, size = new, size * 8


def first_by_policy(layered: DataFrame, key: str, policy: Sequence[Column], record: str) -> DataFrame:
    """(key, record): the first record of the lowest layer by ``policy`` (greatest first, then the least record)."""
    order = F.struct(-F.col("layer"), *policy, -F.col(record))
    return layered.groupBy(key).agg(F.max_by(F.col(record), order).alias(record))


def edition_points(editions: DataFrame, scratch: Scratch, most_works: int = 4) -> DataFrame:
    """Editions as they now stand, one row per ``book_id``, with what the criteria need.

    ``has_cover``: an http(s) address of a picture that no more than ``most_works`` works show. ``rated``:
    ``ratings_count``, -1 where null or negative. ``filled``: how many of the fields hold a value.
    """
    fields = ["work_id", "ratings_count", "image_url", "title", "language_code", "num_pages", "publication_year", "publisher", "isbn13"]
    now = scratch.put(latest_rows(editions, "book_id", "updated_at", fields))
    image = F.trim(F.col("image_url"))
    now2 = now.withColumn("image", F.when(image.rlike(PICTURE), image))
    stand_ins = scratch.put(covers(now2, "image", "work_id", most_works))
    # Addresses of stand-ins are few; the hint depends on the written size all the same.
    marked = now2.join(small_or_plain(scratch, stand_ins.withColumn("_stand_in", F.lit(True)), stand_ins), "image", "left")
    text = ["title", "language_code", "publisher", "isbn13"]
    filled = sum((F.when(F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0, 1).otherwise(0) for c in text), F.lit(0))
    filled = filled + sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in ["num_pages", "publication_year"]), F.lit(0))
    return marked.select(
        "work_id",
        "book_id",
        F.when(F.col("_stand_in").isNull(), F.col("image")).alias("cover"),
        (F.col("image").isNotNull() & F.col("_stand_in").isNull()).cast("int").alias("has_cover"),
        F.when(F.col("ratings_count") >= 0, F.col("ratings_count")).otherwise(F.lit(-1)).cast("long").alias("rated"),
        filled.alias("filled"),
        F.coalesce(F.unix_seconds(F.col("updated_at").cast("timestamp")), F.lit(-(1 << 62))).alias("recency"),
        *[F.when(F.length(F.trim(F.col(c))) > 0, F.col(c)).alias(c) for c in text],
        *[F.when(F.col(c) > 0, F.col(c)).alias(c) for c in ["num_pages", "publication_year"]],
    )


def cover_editions(editions: DataFrame) -> DataFrame:
    """(work_id, book_id): of each non-null work with two editions or more, the edition its cover comes from.

    Criteria are trust in the cover (has one) and in the record (ratings); the policy asks for the cover first,
    then the ratings, then the smallest ``book_id``. Works without any cover have no row.
    """
    scratch = Scratch(editions.sparkSession, "covers")
    points = edition_points(editions, scratch).filter("work_id is not null").select("work_id", "book_id", "has_cover", "rated")
    points = scratch.put(points)
    several = points.groupBy("work_id").agg(F.count(F.lit(1)).alias("n"), F.max("has_cover").alias("c")).filter("n >= 2 and c = 1").select("work_id")
    layered = skyline_layers(points.join(several, "work_id", "left_semi"), "work_id", ["has_cover", "rated"], "book_id", 1)
    return first_by_policy(layered, "work_id", [F.col("has_cover"), F.col("rated")], "book_id")


def surviving_editions(editions: DataFrame) -> DataFrame:
    """One surviving record per non-null work: (work_id, book_id, cover, title, language_code, publisher, isbn13,
    num_pages, publication_year, filled_from).

    Criteria: completeness (fields with a value), recency, trust (ratings). Policy inside a layer: completeness,
    trust, recency, smallest ``book_id``. Null fields come from the first record by (layer, policy) that has them;
    the cover from the most-rated edition with a cover. ``filled_from`` counts the fields taken from other records.

    Layers are found as deep as any field of a group needs: the depth doubles, for the groups that still lack a
    field some record of theirs has, until none does.
    """
    scratch = Scratch(editions.sparkSession, "survivors")
    points = scratch.put(edition_points(editions, scratch).filter("work_id is not null"))
    dims = ["filled", "recency", "rated"]
    fields = ["title", "language_code", "publisher", "isbn13", "num_pages", "publication_year"]
    has = points.groupBy("work_id").agg(*[F.max(F.col(f).isNotNull()).alias(f"any_{f}") for f in fields])
    has = scratch.put(has)
    todo, depth, done = points, 2, None
    while True:
        layered = skyline_layers(todo, "work_id", dims, "book_id", depth)
        full = layered.select("work_id", "book_id", "layer").join(todo, ["work_id", "book_id"])
        order = F.struct(-F.col("layer"), F.col("filled"), F.col("rated"), F.col("recency"), -F.col("book_id"))
        picks = [F.max_by(F.struct(F.col(f).alias("v"), F.col("book_id").alias("b")), F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields]
        best = scratch.put(full.groupBy("work_id").agg(F.max_by("book_id", order).alias("book_id"), *picks))
        lacks = F.lit(False)
        for f in fields:
            lacks = lacks | (F.col(f).isNull() & F.col(f"any_{f}"))
        state = best.join(has, "work_id").withColumn("_lacks", lacks)
        ready = state.filter("not _lacks").select(*best.columns)
        done = ready if done is None else done.unionByName(ready)
        open_works = scratch.put(state.filter("_lacks").select("work_id"))
        if open_works.isEmpty():
            break
        todo = scratch.put(todo.join(open_works, "work_id", "left_semi"))
        depth *= 2
    cover = points.filter("has_cover = 1").groupBy("work_id").agg(F.max_by("cover", F.struct(F.col("rated"), -F.col("book_id"))).alias("cover"))
    others = sum((F.when(F.col(f"{f}.b") != F.col("book_id"), 1).otherwise(0) for f in fields), F.lit(0))
    return done.join(cover, "work_id", "left").select(
        "work_id", "book_id", "cover", *[F.col(f"{f}.v").alias(f) for f in fields], others.alias("filled_from")
    )
