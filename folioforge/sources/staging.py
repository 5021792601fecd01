"""Staging: raw all-text records to typed columns by a declared kind for each, nothing filtered."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from folioforge.functions.text import blank_to_null, to_whole

#: Kinds of staged columns.
WHOLE, NUMBER, TEXT, FLAG, WHOLES, TEXTS = "whole", "number", "text", "flag", "wholes", "texts"

_RAW = {WHOLE: "string", NUMBER: "string", TEXT: "string", FLAG: "string", WHOLES: "array<string>", TEXTS: "array<string>"}

ID_MAP = {"csv_id": "int", "id": "bigint"}
AUTHOR = {"author_id": WHOLE, "name": TEXT, "average_rating": NUMBER, "ratings_count": WHOLE}
WORK = {
    "work_id": WHOLE, "best_book_id": WHOLE, "original_title": TEXT, "title": TEXT, "best_edition_title": TEXT, "publication_year": WHOLE,
    "language_code": TEXT, "media_type": TEXT, "books_count": WHOLE, "gr_ratings_count": WHOLE, "is_collection": FLAG,
}
EDITION = {
    "book_id": WHOLE, "work_id": WHOLE, "title": TEXT, "title_without_series": TEXT, "author_ids": WHOLES, "isbn": TEXT, "isbn13": TEXT, "asin": TEXT,
    "kindle_asin": TEXT, "language_code": TEXT, "country_code": TEXT, "format": TEXT, "is_ebook": FLAG, "num_pages": WHOLE, "publication_year": WHOLE,
    "publisher": TEXT, "ratings_count": WHOLE, "average_rating": NUMBER, "image_url": TEXT, "url": TEXT,
}


def _typed(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == WHOLE:
        return to_whole(c)
    if kind == NUMBER:
        return blank_to_null(c).try_cast("double")
    if kind == FLAG:
        return c == "true"
    if kind == WHOLES:
        return F.transform(c, to_whole)
    return F.transform(c, blank_to_null) if kind == TEXTS else blank_to_null(c)


def raw_schema(kinds: Mapping[str, str]) -> str:
    return ", ".join(f"{name} {_RAW[kind]}" for name, kind in kinds.items())


def staged(raw: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Typed columns of all-text records: blanks are nulls, a number that does not read is null, no row is dropped."""
    return raw.select(*[_typed(name, kind).alias(name) for name, kind in kinds.items()])


def staged_lines(spark: SparkSession, path: str, kinds: Mapping[str, str]) -> DataFrame:
    """``staged`` over JSON lines with declared columns; lines that are no JSON are skipped."""
    return staged(spark.read.schema(raw_schema(kinds)).option("mode", "DROPMALFORMED").json(path), kinds)


def id_map(spark: SparkSession, path: str, key: str, value: str, value_type: str = "bigint") -> DataFrame:
    """(key, value) of a CSV with a header and declared types."""
    return spark.read.schema(f"`{key}` int, `{value}` {value_type}").option("header", True).csv(path)


def staged_products(raw: DataFrame) -> DataFrame:
    """Shop records (author a struct, details a map, categories a list) flat: the author's name, codes and publisher looked
    up by their labels, categories joined by ``|``."""
    def detail(label: str) -> Column:
        return blank_to_null(F.element_at("details", label))

    return raw.select(
        blank_to_null(F.col("parent_asin")).alias("parent_asin"), blank_to_null(F.col("title")).alias("title"), blank_to_null(F.col("author.name")).alias("author"),
        detail("ISBN 10").alias("isbn10"), detail("ISBN 13").alias("isbn13"), detail("Publisher").alias("publisher_raw"), detail("Language").alias("language"),
        F.when(F.size("categories") > 0, F.array_join("categories", "|")).alias("categories"),
    )


#: Headers of the two rating files that an app takes, as (id, rating, title) columns.
FILE_FORMS = {"own": ("work_id", "rating", "title"), "shop": ("Book Id", "My Rating", "Title")}


def rating_file(spark: SparkSession, path: str) -> DataFrame:
    """(form, id, rating, title) of a CSV in one of ``FILE_FORMS``, told by its header; a rating of 0 is none. A header of
    neither form is an error."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    form = next((name for name, cols in FILE_FORMS.items() if set(cols) <= set(raw.columns)), None)
    if form is None:
        raise ValueError(f"no known rating file: {raw.columns}")
    key, rating, title = FILE_FORMS[form]
    r = F.col(f"`{rating}`").try_cast("double")
    return raw.select(F.lit(form).alias("form"), to_whole(F.col(f"`{key}`")).alias("id"), F.when(r > 0, r).alias("rating"), blank_to_null(F.col(f"`{title}`")).alias("title"))


def journal(spark: SparkSession, path: str, defaults: Mapping[str, str]) -> DataFrame:
    """Rows of a journal of dated files (profile=../day=..) whose older files lack columns: files are read with one merged
    schema, and ``defaults`` (column: SQL literal) fill what is missing."""
    rows = spark.read.option("mergeSchema", True).parquet(path)
    for name, value in defaults.items():
        have = F.col(name) if name in rows.columns else F.lit(None)
        rows = rows.withColumn(name, F.coalesce(have, F.expr(value)))
    return rows


def profile_rows(rows: DataFrame, merges: DataFrame, catalogue: DataFrame, core: DataFrame, by: Sequence[str] = ("user_id",)) -> DataFrame:
    """(by.., work_id, kind, rating): what readers' files (by.., work_id, rating, status) say of each work.

    An unfinished book without a rating counts as one star. Works that are shadows become their main work. ``kind`` is
    'rated' (mean of the lines' ratings), 'dnf' (all rated lines unfinished), 'read' (no rating), 'want', or why a line
    does not count: 'no id', 'not in catalogue', 'not in core'; a work rated in one line is rated, and one read in one
    line is read. A rating that is no whole star from 1 to 5 is an error of the file and gives the kind 'bad rating'.
    """
    m = merges.groupBy("shadow_work_id").agg(F.min("main_work_id").alias("_main"))
    dnf = F.coalesce(F.col("status") == "dnf", F.lit(False))
    r = F.when(F.col("rating").isNull() & dnf, F.lit(1.0)).otherwise(F.col("rating").cast("double"))
    moved = rows.join(m, rows["work_id"] == m["shadow_work_id"], "left").select(*by, F.coalesce("_main", "work_id").alias("work_id"), r.alias("r"), dnf.alias("dnf"), F.coalesce(F.col("status") == "want", F.lit(False)).alias("want"))
    known = catalogue.select("work_id", F.lit(True).alias("_in")).join(core.select("work_id", F.lit(True).alias("_core")), "work_id", "left")
    seen = moved.join(known, "work_id", "left")
    kind = (
        F.when(F.col("r").isNotNull() & ~F.col("r").isin(1.0, 2.0, 3.0, 4.0, 5.0), "bad rating").when(F.col("work_id").isNull(), "no id").when(F.col("_in").isNull(), "not in catalogue")
        .when(F.col("_core").isNull(), "not in core").when(F.col("r").isNotNull(), "rated").when(F.col("want"), "want").otherwise("read")
    )
    told = seen.withColumn("kind", kind)
    counts = told.filter(F.col("kind").isin("rated", "read", "want")).groupBy(*by, "work_id").agg(
        F.round(F.avg("r"), 6).alias("rating"), F.min(F.when(F.col("kind") == "rated", F.col("dnf"))).alias("_dnf"), F.max(F.col("kind") == "read").alias("_read")
    )
    named = F.when(F.col("rating").isNotNull(), F.when(F.col("_dnf"), "dnf").otherwise("rated")).when(F.col("_read"), "read").otherwise("want")
    other = told.filter(~F.col("kind").isin("rated", "read", "want")).select(*by, "work_id", "kind", F.lit(None).cast("double").alias("rating")).distinct()
    return counts.select(*by, "work_id", named.alias("kind"), "rating").unionByName(other)


