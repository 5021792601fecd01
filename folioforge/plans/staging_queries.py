"""Readers and staging over raw files: the tables are written in the form in which such data comes, as CSV or JSON lines
of text, and read back by the library's readers; the SQL states the result from the tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.operators import clean
from folioforge.plans.base import Registry, Tables
from folioforge.plans.clean_queries import CATALOG, CORE, PRIMARY, RW, SHADOWS, core, work_level
from folioforge.session import Scratch
from folioforge.sources import readers, staging, writers

R = Registry()


def _raw(t: Tables, label: str) -> str:
    return f"{Scratch(t.spark, 'raw').root}/{label}"


def _as_text(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).cast("array<string>" if k in (staging.WHOLES, staging.TEXTS) else "string").alias(c) for c, k in kinds.items()])


def _staged_again(t: Tables, df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    path = _raw(t, "lines")
    _as_text(df, kinds).write.json(path)
    return staging.staged_lines(t.spark, path, kinds)


def _sql_of(kinds: dict[str, str], table: str) -> str:
    text = ", ".join(f"nullif(trim({c}), '') as {c}" if k == staging.TEXT else c for c, k in kinds.items())
    return f"select {text} from {table}"


@R.add("s01_csv_report", "select count(*) as n_lines, count(user_id) as n_rows, count(*) - count(user_id) as n_bad from ratings")
def _(t: Tables) -> DataFrame:
    """A null reader is written as a word, which is no number: such lines are counted, not lost."""
    path = _raw(t, "ratings")
    t.ratings.select(F.coalesce(F.col("user_id").cast("string"), F.lit("none")).alias("user_id"), "work_id").coalesce(1).write.option("header", True).csv(path)
    return readers.csv_report(t.spark, path, T.StructType([T.StructField("user_id", T.IntegerType()), T.StructField("work_id", T.LongType())]))


@R.add("s02_id_maps", "select distinct cast(book_id as int) as book_csv_id, work_id from editions where book_id is not null")
def _(t: Tables) -> DataFrame:
    path = _raw(t, "map")
    t.editions.filter("book_id is not null").select(F.col("book_id").alias("book_csv_id"), "work_id").distinct().write.option("header", True).csv(path)
    return staging.id_map(t.spark, path, "book_csv_id", "work_id")


@R.add("s05_staged_editions", _sql_of(staging.EDITION, "editions"))
def _(t: Tables) -> DataFrame:
    return _staged_again(t, t.editions, staging.EDITION)


@R.add("s06_staged_works", _sql_of(staging.WORK, "works"))
def _(t: Tables) -> DataFrame:
    return _staged_again(t, t.works, staging.WORK)


@R.add("s07_staged_authors", _sql_of(staging.AUTHOR, "authors"))
def _(t: Tables) -> DataFrame:
    return _staged_again(t, t.authors, staging.AUTHOR)


@R.add("s08_genre_votes", "select work_id, language_code as genre, cast(count(*) as int) as votes from editions where work_id is not null and language_code is not null group by all")
def _(t: Tables) -> DataFrame:
    """Votes by language stand for votes by genre: maps in JSON, opened into rows."""
    path = _raw(t, "votes")
    per = t.editions.filter("work_id is not null and language_code is not null").groupBy("work_id", "language_code").agg(F.count(F.lit(1)).alias("n"))
    per.groupBy("work_id").agg(F.map_from_entries(F.collect_list(F.struct("language_code", "n"))).alias("genres")).write.json(path)
    return readers.genre_votes(readers.json_lines(t.spark, path, "work_id bigint, genres map<string,int>"), "work_id")


@R.add("s11_staged_products", "select nullif(trim(parent_asin), '') as parent_asin, nullif(trim(title), '') as title, nullif(trim(author), '') as author, nullif(trim(isbn10), '') as isbn10, nullif(trim(isbn13), '') as isbn13, nullif(trim(publisher_raw), '') as publisher_raw, nullif(trim(language), '') as language, categories from az_meta where categories is null or categories <> ''")
def _(t: Tables) -> DataFrame:
    path = _raw(t, "products")
    labels = {"isbn10": "ISBN 10", "isbn13": "ISBN 13", "publisher_raw": "Publisher", "language": "Language"}
    pairs = F.filter(F.array(*[F.struct(F.lit(v).alias("k"), F.col(c).alias("v")) for c, v in labels.items()]), lambda p: p["v"].isNotNull())
    products = t.az_meta.filter("categories is null or categories <> ''")
    products.select("parent_asin", "title", F.struct(F.col("author").alias("name")).alias("author"), F.map_from_entries(pairs).alias("details"), F.split("categories", r"\|").alias("categories")).write.json(path)
    return staging.staged_products(readers.json_lines(t.spark, path, "parent_asin string, title string, author struct<name:string>, details map<string,string>, categories array<string>"))


@R.add("s12_declared_csv", "select user_id, work_id, rating, rated_at from ratings where user_id is not null and work_id is not null and not coalesce(isnan(rating), false)")
def _(t: Tables) -> DataFrame:
    path = _raw(t, "plain")
    rows = t.ratings.filter("user_id is not null and work_id is not null and not coalesce(isnan(rating), false)").select("user_id", "work_id", "rating", "rated_at")
    rows.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
    return t.spark.read.schema(rows.schema).option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)


@R.add("s23_rating_file", "select 'shop' as form, book_id as id, case when ratings_count > 0 then cast(ratings_count as double) end as rating, nullif(trim(title), '') as title from editions")
def _(t: Tables) -> DataFrame:
    """The editions as a file of the shop's form; what the form is shows in the header alone."""
    path = _raw(t, "shop")
    t.editions.select(F.col("book_id").alias("Book Id"), F.col("ratings_count").alias("My Rating"), F.col("title").alias("Title")).write.option("header", True).option("escape", '"').csv(path)
    return staging.rating_file(t.spark, path)


@R.add("s27_journal", "select cast(year(rated_at) as varchar) as profile, strftime(rated_at, '%Y-%m-01') as day, work_id, case when year(rated_at) % 2 = 0 then rating end as chance, case when year(rated_at) % 2 = 0 then 'five' else 'like' end as chance_of from ratings where rated_at is not null and work_id is not null")
def _(t: Tables) -> DataFrame:
    """A journal for each year with a file a month; those of odd years lack the chance's columns."""
    path = _raw(t, "journal")
    rows = t.ratings.filter("rated_at is not null and work_id is not null").select("work_id", F.col("rating").alias("chance"), F.year("rated_at").alias("y"), F.date_format("rated_at", "yyyy-MM-01").alias("day"))
    even = F.col("y") % 2 == 0
    writers.append_day(rows.filter(even).select("work_id", "chance", F.lit("five").alias("chance_of"), F.col("y").cast("string").alias("profile"), "day").repartition("profile"), path)
    writers.append_day(rows.filter(~even).select("work_id", F.col("y").cast("string").alias("profile"), "day").repartition("profile"), path)
    got = staging.journal(t.spark, path, {"chance_of": "'like'"})
    return got.select(F.col("profile").cast("string").alias("profile"), F.date_format(F.col("day").cast("date"), "yyyy-MM-dd").alias("day"), "work_id", "chance", "chance_of")


_STATUS = "case when rating is null and user_id % 3 = 0 then 'dnf' when rating is null and user_id % 3 = 1 then 'want' when rating = 1 then 'dnf' end"


@R.add("s22_profiles", f"""with {CORE}, {CATALOG}, {PRIMARY}, {SHADOWS}, l as (select user_id, coalesce(s.main_work_id, r.work_id) as work_id, {_STATUS} as status, rating from ratings r left join shadows s on s.shadow_work_id = r.work_id where user_id is not null and not coalesce(isnan(rating), false)),
k as (select user_id, work_id, status, case when rating is null and status = 'dnf' then 1.0 else cast(rating as double) end as r, work_id in (select work_id from catalog) as known, work_id in (select work_id from core) as core from l),
d as (select *, case when r is not null and r not in (1, 2, 3, 4, 5) then 'bad rating' when work_id is null then 'no id' when not known then 'not in catalogue' when not core then 'not in core' else 'ok' end as why from k)
select user_id, work_id, case when avg(r) is not null then case when bool_and(status = 'dnf') filter (r is not null and status is not null) and count(*) filter (r is not null and status is null) = 0 then 'dnf' else 'rated' end when bool_or(r is null and status is distinct from 'want') then 'read' else 'want' end as kind, round(avg(r), 6) as rating from d where why = 'ok' group by user_id, work_id
union all select distinct user_id, work_id, why, null from d where why <> 'ok'""")
def _(t: Tables) -> DataFrame:
    c, catalogue = core(t), clean.build_catalog(t.works, t.editions)
    merges = clean.find_shadows(catalogue, clean.primary_authors(t.works, t.editions, t.authors), work_level(t))
    rows = t.ratings.filter("user_id is not null and not coalesce(isnan(rating), false)").select("user_id", "work_id", F.expr(_STATUS).alias("status"), "rating")
    return staging.profile_rows(rows, merges, catalogue.select("work_id").distinct(), c.select("work_id").distinct())


_OUT = f"""with {RW}, {CATALOG}, {PRIMARY}, {SHADOWS}, moved as (select user_id, coalesce(main_work_id, work_id) as work_id from rw left join shadows on shadow_work_id = work_id),
links as (select distinct work_id, a from (select e.work_id, unnest(e.author_ids) as a from editions e where e.work_id in (select work_id from catalog)) where a in (select author_id from authors))
select 'works' as name, count(*) as n_rows from catalog
union all select 'editions', count(*) from editions where work_id in (select work_id from catalog)
union all select 'authors', count(distinct a) from links
union all select 'work_authors', count(*) from links
union all select 'work_languages', count(*) from (select distinct work_id, language_code from editions where language_code is not null and work_id in (select work_id from catalog))
union all select 'work_merges', count(*) from shadows
union all select 'ratings', count(*) from (select distinct user_id, work_id from moved where work_id in (select work_id from catalog))
union all select 'users', count(distinct user_id) from moved where work_id in (select work_id from catalog)"""


def prepared(t: Tables) -> dict[str, DataFrame]:
    """The eight tables that a cleaned data set consists of, in the order of the rules: work level, catalogue, main
    authors, shadows merged, ratings of catalogued works."""
    works = clean.build_catalog(t.works, t.editions)
    ids = works.select("work_id").distinct()
    primary = clean.primary_authors(t.works, t.editions, t.authors)
    rated = work_level(t)
    merges = clean.find_shadows(works, primary, rated)
    editions = t.editions.join(ids, "work_id", "left_semi")
    links = editions.select("work_id", F.explode("author_ids").alias("author_id")).distinct().join(t.authors.select("author_id"), "author_id", "left_semi")
    ratings = clean.merge_shadows(rated, merges).join(ids, "work_id", "left_semi")
    return {
        "works": works,
        "editions": editions,
        "authors": t.authors.join(links.select("author_id").distinct(), "author_id", "left_semi"),
        "work_authors": links,
        "work_languages": editions.filter("language_code is not null").select("work_id", "language_code").distinct(),
        "work_merges": merges,
        "ratings": ratings,
        "users": ratings.select("user_id").distinct(),
    }


@R.add("s15_prepared", _OUT)
def _(t: Tables) -> DataFrame:
    """All eight tables are written; their counts come from what is read again."""
    root = _raw(t, "prepared")
    rows = [(name, writers.write_table(df, f"{root}/{name}")["rows"]) for name, df in prepared(t).items()]
    return t.spark.createDataFrame(rows, "name string, n_rows bigint")


QUERIES, SQL = R.queries, R.sql
