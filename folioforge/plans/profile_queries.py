"""Profiling metrics and validation checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import clean
from folioforge.operators import profile as P
from folioforge.plans.base import Registry, Tables
from folioforge.plans.clean_queries import CATALOG, CORE, RW, core, work_level

R = Registry()
WS = f"{RW}, ws as materialized (select work_id, count(*) as n, sum(cast(rating as decimal(12,6)))::double / count(*) as mean from rw group by 1)"
US = f"""{WS}, us as materialized (select user_id, count(*) as n, sum(cast(rating as decimal(12,6)))::double / count(*) as mean,
  avg((ws.n < 20)::int) as obscure_share, avg((rating = 5)::int) as five_share from rw join ws using (work_id) group by 1)"""


def bucket(col: str, edges: list[int]) -> str:
    parts = [f"when {col} >= {a}" + (f" and {col} < {b} then '{a}-{b - 1}'" if b else f" then '{a}+'") for a, b in zip(edges, [*edges[1:], None])]
    return "case " + " ".join(parts) + " end"


def per_user(t: Tables) -> DataFrame:
    rw = work_level(t)
    return P.per_user(rw, P.per_work(rw))


@R.add("a22_files", "select 'ratings' as file, count(*) as n_rows from ratings union all select 'users', count(*) from users union all select 'works', count(*) from works union all select 'editions', count(*) from editions union all select 'authors', count(*) from authors")
def _(t: Tables) -> DataFrame:
    return P.file_sizes({n: getattr(t, n) for n in ("ratings", "users", "works", "editions", "authors")})


@R.add("a22_overview", """select count(*) as n_rows, count(distinct user_id) as n_users, count(distinct work_id) as n_works,
count(*) filter (user_id is null or work_id is null or rating is null) as null_keys, count(*) filter (rating not between 0 and 5) as out_of_range,
count(*) filter (rating > 0) as explicit, count(*) filter (rated_at is null) as undated, count(*) filter (loaded_at > rated_at + interval 7 day) as late from ratings""")
def _(t: Tables) -> DataFrame:
    return P.overview(t.ratings)


@R.add("w06_rating_shares", "select rating, n_editions, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 2) as pct from ratings group by all")
def _(t: Tables) -> DataFrame:
    return P.share_of_all(t.ratings.groupBy("rating", "n_editions").agg(F.count(F.lit(1)).alias("n")))


@R.add("a22_id_map", "select count(*) as n_rows, count(distinct user_id) as n_users, count(distinct external_id) as n_external from users")
def _(t: Tables) -> DataFrame:
    return t.users.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user_id").alias("n_users"), F.count_distinct("external_id").alias("n_external"))


_ED_COLS = ["work_id", "title", "language_code", "isbn", "isbn13", "publication_year", "publisher", "image_url"]


@R.add("a22_editions_quality", "select count(*) as n_rows, " + ", ".join(
    f"count(*) filter ({c} is null" + ("" if c in ("work_id", "publication_year") else f" or trim({c}) = ''") + f") as no_{c}" for c in _ED_COLS) + " from editions")
def _(t: Tables) -> DataFrame:
    return P.missing(t.editions, _ED_COLS)


@R.add("a22_works_quality", """select count(*) as n_works, count(distinct work_id) as n_ids, count(*) filter (original_title is null) as no_original_title,
count(*) filter (not exists (select 1 from editions e where e.work_id = w.work_id)) as no_editions,
count(*) filter (not exists (select 1 from editions e where e.book_id = w.best_book_id)) as best_missing from works w""")
def _(t: Tables) -> DataFrame:
    has = t.editions.filter("work_id is not null").select("work_id").distinct().withColumn("has", F.lit(1))
    best = t.editions.filter("book_id is not null").select(F.col("book_id").alias("best_book_id")).distinct().withColumn("found", F.lit(1))
    j = t.works.join(has, "work_id", "left").join(best, "best_book_id", "left")
    return j.agg(
        F.count(F.lit(1)).alias("n_works"), F.count_distinct("work_id").alias("n_ids"), F.count_if(F.col("original_title").isNull()).alias("no_original_title"),
        F.count_if(F.col("has").isNull()).alias("no_editions"), F.count_if(F.col("found").isNull()).alias("best_missing"),
    )


@R.add("p08_editions_per_work", f"select {bucket('n', [1, 2, 5, 10, 50, 200])} as editions, count(*) as n_works from (select work_id, count(*) as n from editions where work_id is not null group by 1) group by 1")
def _(t: Tables) -> DataFrame:
    n = t.editions.filter("work_id is not null").groupBy("work_id").agg(F.count(F.lit(1)).alias("n"))
    return P.bucketed(n, "n", [1, 2, 5, 10, 50, 200], [F.count(F.lit(1)).alias("n_works")], "editions")


@R.add("a22_media_type", f"with {WS} select coalesce(w.media_type, '(none)') as media_type, count(*) as n_works, cast(sum(ws.n) as bigint) as n_ratings from works w left join ws using (work_id) group by 1")
def _(t: Tables) -> DataFrame:
    ws = P.per_work(work_level(t))
    return t.works.join(ws, "work_id", "left").groupBy(F.coalesce("media_type", F.lit("(none)")).alias("media_type")).agg(F.count(F.lit(1)).alias("n_works"), F.sum("n").alias("n_ratings"))


@R.add("k01_not_book_top", f"with {WS} select coalesce(w.original_title, w.title) as title, w.media_type, w.work_id, ws.n from works w join ws using (work_id) where w.media_type in ('not a book', 'periodical', 'article') order by ws.n desc, w.work_id limit 8")
def _(t: Tables) -> DataFrame:
    ws = P.per_work(work_level(t))
    odd = t.works.filter(F.col("media_type").isin("not a book", "periodical", "article"))
    return odd.join(ws, "work_id").select(F.coalesce("original_title", "title").alias("title"), "media_type", "work_id", "n").orderBy(F.desc("n"), "work_id").limit(8)


@R.add("a22_author_links", """select count(*) as n_links, count(*) filter (a.author_id is null) as to_missing, (select count(*) from authors where name is null or trim(name) = '') as no_name
from (select unnest(author_ids) as aid from editions) x left join authors a on a.author_id = x.aid""")
def _(t: Tables) -> DataFrame:
    links = t.editions.select(F.explode("author_ids").alias("aid"))
    n = links.join(t.authors, F.col("aid") == F.col("author_id"), "left").agg(F.count(F.lit(1)).alias("n_links"), F.count_if(F.col("author_id").isNull()).alias("to_missing"))
    none = t.authors.agg(F.count_if(F.col("name").isNull() | (F.trim("name") == "")).alias("no_name"))
    return n.crossJoin(F.broadcast(none))


@R.add("k01_languages_rated", f"with {RW} select coalesce(w.language_code, '(none)') as language_code, count(*) as n_ratings from rw join works w using (work_id) group by 1 order by 2 desc, 1 limit 12")
def _(t: Tables) -> DataFrame:
    j = work_level(t).join(t.works.select("work_id", "language_code"), "work_id")
    return j.groupBy(F.coalesce("language_code", F.lit("(none)")).alias("language_code")).agg(F.count(F.lit(1)).alias("n_ratings")).orderBy(F.desc("n_ratings"), "language_code").limit(12)


_UB = [1, 2, 5, 10, 20, 50, 100]


@R.add("a11_user_activity", f"""with {US} select {bucket('n', _UB)} as per_user, count(*) as n_users, cast(sum(n) as bigint) as n_ratings,
round(median(mean), 6) as median_mean, round(median(obscure_share), 6) as median_obscure, round(median(five_share), 6) as median_five from us group by 1""")
def _(t: Tables) -> DataFrame:
    mid = lambda c, a: F.round(F.median(c), 6).alias(a)
    return P.bucketed(per_user(t), "n", _UB, [F.count(F.lit(1)).alias("n_users"), F.sum("n").alias("n_ratings"), mid("mean", "median_mean"), mid("obscure_share", "median_obscure"), mid("five_share", "median_five")], "per_user")


@R.add("a11_user_quantiles", f"with {US} select count(*) as n_values, quantile_disc(n, 0.5) as p5, quantile_disc(n, 0.9) as p9, quantile_disc(n, 0.99) as p99, max(n) as greatest from us")
def _(t: Tables) -> DataFrame:
    return P.quantiles(per_user(t), "n", [0.5, 0.9, 0.99])


@R.add("a11_work_quantiles", f"with {WS} select count(*) as n_values, quantile_disc(n, 0.5) as p5, quantile_disc(n, 0.9) as p9, quantile_disc(n, 0.99) as p99, max(n) as greatest from ws")
def _(t: Tables) -> DataFrame:
    return P.quantiles(P.per_work(work_level(t)), "n", [0.5, 0.9, 0.99])


@R.add("p09_user_variance", f"""with {RW}, s as (select user_id, count(*) as n, round(stddev_pop(rating), 4) as sd, round(avg(rating), 4) as mean from rw group by 1)
select case when sd = 0 then 'a' when sd < 0.2 then 'b' when sd < 0.5 then 'c' else 'd' end as sd_bucket, count(*) as n_users, count(*) filter (mean > 4.9) as all_fives from s where n >= 3 group by 1""")
def _(t: Tables) -> DataFrame:
    s = work_level(t).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.stddev_pop("rating"), 4).alias("sd"), F.round(F.avg("rating"), 4).alias("mean"))
    label = F.when(F.col("sd") == 0, "a").when(F.col("sd") < 0.2, "b").when(F.col("sd") < 0.5, "c").otherwise("d")
    return s.filter("n >= 3").groupBy(label.alias("sd_bucket")).agg(F.count(F.lit(1)).alias("n_users"), F.count_if(F.col("mean") > 4.9).alias("all_fives"))


@R.add("k01_top_users", f"with {US} select user_id, n, round(mean, 6) as mean, round(obscure_share, 6) as obscure_share, round(five_share, 6) as five_share from us order by n desc, user_id limit 12")
def _(t: Tables) -> DataFrame:
    r6 = lambda c: F.round(c, 6).alias(c)
    return per_user(t).select("user_id", "n", r6("mean"), r6("obscure_share"), r6("five_share")).orderBy(F.desc("n"), "user_id").limit(12)


@R.add("p08_work_popularity", f"with {WS} select {bucket('n', [1, 5, 20, 100, 1000])} as per_work, count(*) as n_works, cast(sum(n) as bigint) as n_ratings from ws group by 1")
def _(t: Tables) -> DataFrame:
    return P.bucketed(P.per_work(work_level(t)), "n", [1, 5, 20, 100, 1000], [F.count(F.lit(1)).alias("n_works"), F.sum("n").alias("n_ratings")], "per_work")


@R.add("a23_collection_examples", r"""select work_id, title, gr_ratings_count from works where title like '%, Vol. 1' or title ilike '%SAGA%' order by gr_ratings_count desc nulls last, work_id limit 10""")
def _(t: Tables) -> DataFrame:
    hit = t.works.filter(F.col("title").like("%, Vol. 1") | F.col("title").ilike("%SAGA%"))
    return hit.select("work_id", "title", "gr_ratings_count").orderBy(F.desc_nulls_last("gr_ratings_count"), "work_id").limit(10)


CHECKS_SQL = {
    "ratings unique": "select count(*) - count(distinct (user_id, work_id)) as n from core",
    "ratings in range": "select count(*) from core where rating < 1 or rating > 5 or rating is null",
    "ratings to works": "select count(*) from core r where not exists (select 1 from works w where w.work_id = r.work_id)",
    "ratings to users": "select count(*) from core r where not exists (select 1 from users u where u.user_id = r.user_id)",
    "k-core users": "select count(*) from (select user_id from core group by 1 having count(*) < 5)",
    "k-core works": "select count(*) from (select work_id from core group by 1 having count(*) < 20)",
    "works unique": "select count(*) - count(distinct work_id) from works",
    "works titled": "select count(*) from works where title is null or trim(title) = ''",
    "merges: shadow outside": "select count(*) from work_merges m where exists (select 1 from core c where c.work_id = m.shadow_work_id)",
    "merges to works": "select count(*) from work_merges m where not exists (select 1 from works w where w.work_id = m.main_work_id)",
    "editions unique": "select count(*) - count(distinct book_id) from editions",
    "editions to works": "select count(*) from editions e where not exists (select 1 from works w where w.work_id = e.work_id)",
    "works have editions": "select count(*) from works w where not exists (select 1 from editions e where e.work_id = w.work_id)",
    "users unique and known": "select count(*) - count(distinct user_id) + count(*) filter (external_id is null) from users",
}


@R.add("a21_validation", f"with {CORE} " + " union all ".join(f"select '{k}' as check, cast(({v}) as bigint) as n" for k, v in CHECKS_SQL.items()))
def _(t: Tables) -> DataFrame:
    c, works, users, editions, merges = core(t), t.works, t.users, t.editions, t.work_merges
    rows = F.count(F.lit(1))
    without = lambda a, b, on: a.join(b, on, "left_anti").agg(rows.alias("n"))
    unique = lambda df, *k: df.agg((rows - F.count_distinct(F.struct(*k))).alias("n"))
    below = lambda k, m: c.groupBy(k).agg(rows.alias("c")).filter(F.col("c") < m).agg(rows.alias("n"))
    main = works.select(F.col("work_id").alias("main_work_id"))
    return P.violations({
        "ratings unique": unique(c, "user_id", "work_id"),
        "ratings in range": c.filter("rating < 1 or rating > 5 or rating is null").agg(rows.alias("n")),
        "ratings to works": without(c, works, "work_id"),
        "ratings to users": without(c, users, "user_id"),
        "k-core users": below("user_id", 5),
        "k-core works": below("work_id", 20),
        "works unique": unique(works, "work_id"),
        "works titled": works.filter("title is null or trim(title) = ''").agg(rows.alias("n")),
        "merges: shadow outside": merges.join(c.select(F.col("work_id").alias("shadow_work_id")), "shadow_work_id", "left_semi").agg(rows.alias("n")),
        "merges to works": without(merges, main, "main_work_id"),
        "editions unique": unique(editions, "book_id"),
        "editions to works": without(editions, works, "work_id"),
        "works have editions": without(works, editions, "work_id"),
        "users unique and known": users.agg((rows - F.count_distinct("user_id") + F.count_if(F.col("external_id").isNull())).alias("n")),
    })


@R.add("s14_export_counts", f"with {CATALOG} select count(*) as n_rows, count(distinct work_id) as n_ids, count(title) as n_titles from catalog")
def _(t: Tables) -> DataFrame:
    return clean.build_catalog(t.works, t.editions).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("work_id").alias("n_ids"), F.count("title").alias("n_titles"))


QUERIES, SQL = R.queries, R.sql
