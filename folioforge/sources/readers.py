"""Readers with declared schemas: nothing is inferred, bad lines are counted, not lost silently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.functions.text import blank_to_null, to_whole

RATINGS_CSV = T.StructType(
    [
        T.StructField("user_id", T.IntegerType()),
        T.StructField("book_id", T.IntegerType()),
        T.StructField("is_read", T.ByteType()),
        T.StructField("rating", T.ByteType()),
        T.StructField("is_reviewed", T.ByteType()),
    ]
)
EDITION_JSON = "book_id string, work_id string, title string, isbn string, language_code string, num_pages string, ratings_count string, authors array<struct<author_id:string,role:string>>, popular_shelves array<struct<name:string,count:string>>, series array<string>"


def typed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a CSV with a header, and ``_bad``: the raw text of a line that does not fit the schema, else null."""
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    return spark.read.schema(full).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)


def csv_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(n_lines, n_rows, n_bad): raw lines without the header, rows that fit, rows that do not."""
    lines = spark.read.text(path).agg((F.count(F.lit(1)) - 1).alias("n_lines"))
    # The condition reads every column (its first part holds for any row): a scan of the bad column alone cannot
    # tell bad lines.
    read = F.xxhash64(*schema.names).cast("string") != ""
    rows = typed_csv(spark, path, schema).agg(F.count_if(read & F.col("_bad").isNull()).alias("n_rows"), F.count_if(read & F.col("_bad").isNotNull()).alias("n_bad"))
    kept = rows
    return lines.crossJoin(F.broadcast(kept))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file with declared nested columns; lines that are no JSON are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def staged_editions(raw: DataFrame, shelves: int = 20) -> DataFrame:
    """Typed editions from all-text JSON: numbers by rounding, blanks to null, the first ``shelves`` shelves."""
    typed = [to_whole(F.col(c)).alias(c) for c in ("book_id", "work_id", "num_pages", "ratings_count")]
    people = F.transform("authors", lambda a: F.struct(to_whole(a["author_id"]).alias("author_id"), blank_to_null(a["role"]).alias("role")))
    top = F.transform(F.slice("popular_shelves", 1, shelves), lambda s: F.struct(s["name"].alias("name"), to_whole(s["count"]).alias("n")))
    return raw.select(*typed, *[blank_to_null(F.col(c)).alias(c) for c in ("title", "isbn", "language_code")], people.alias("authors"), top.alias("shelves"), "series")


def genre_votes(raw: DataFrame, key: str = "book_id", genres: str = "genres") -> DataFrame:
    """(key, genre, votes) from a column of maps."""
    return raw.select(key, F.explode(genres).alias("genre", "votes"))
