"""Joins between sources, id maps, upserts, set operations and ordered limits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import clean, link
from folioforge.plans.base import Registry, Tables
from folioforge.plans.clean_queries import BEST, CATALOG, KEY, PRIMARY, RW, work_level

R = Registry()
AKEY = r"regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}]+', '', 'g')"


def tkey(c: str) -> str:
    return KEY.format(c=rf"regexp_replace(coalesce({c}, ''), '\s*[:(\[].*$', '')")


AUTHORED = f"""{CATALOG}, {PRIMARY}, authored as materialized (
  select c.work_id, c.title, c.gr_ratings_count as n, a.name as author from catalog c join prim p using (work_id) join authors a using (author_id))"""


def authored(t: Tables) -> DataFrame:
    c = clean.build_catalog(t.works, t.editions).select("work_id", "title", F.col("gr_ratings_count").alias("n"))
    p = clean.primary_authors(t.works, t.editions, t.authors)
    return c.join(p, "work_id").join(t.authors.select("author_id", F.col("name").alias("author")), "author_id").select("work_id", "title", "n", "author")


BRIDGE = r"""ed as materialized (select work_id, regexp_replace(upper(coalesce(isbn, '')), '[^0-9X]', '', 'g') as ten,
  regexp_replace(coalesce(isbn13, ''), '[^0-9]', '', 'g') as thirteen, kindle_asin from editions where work_id is not null),
bridge as materialized (select i.parent_asin, max(case when i.source = 'kindle' then coalesce(ek.work_id, e13.work_id) else coalesce(e10.work_id, e13.work_id) end) as work_id
  from (select parent_asin, source, regexp_replace(upper(coalesce(isbn10, '')), '[^0-9X]', '', 'g') as ten, regexp_replace(coalesce(isbn13, ''), '[^0-9]', '', 'g') as thirteen from az_meta) i
  left join (select ten, max(work_id) as work_id from ed where ten <> '' group by 1) e10 on e10.ten = i.ten
  left join (select thirteen, max(work_id) as work_id from ed where thirteen <> '' group by 1) e13 on e13.thirteen = i.thirteen
  left join (select kindle_asin, max(work_id) as work_id from ed where coalesce(kindle_asin, '') <> '' group by 1) ek on ek.kindle_asin = i.parent_asin
  group by 1)"""
TITLED = f"""{AUTHORED}, tw as materialized (select akey, tkey, arg_max(work_id, (n, -work_id)) as work_id from (
  select work_id, coalesce(n, -1) as n, {AKEY.format(c='author')} as akey, {tkey('title')} as tkey from authored) where akey <> '' and tkey <> '' group by 1, 2),
tm as materialized (select p.parent_asin, min(tw.work_id) as work_id from (select parent_asin, {AKEY.format(c='author')} as akey, {tkey('title')} as tkey from az_meta) p
  join tw using (akey, tkey) group by 1)"""


@R.add("j10_code_bridge", f"with {BRIDGE} select * from bridge")
def _(t: Tables) -> DataFrame:
    return link.code_bridge(t.az_meta, t.editions)


@R.add("j11_title_match", f"with {TITLED} select * from tm")
def _(t: Tables) -> DataFrame:
    return link.title_match(t.az_meta, authored(t))


def _item_works(t: Tables) -> DataFrame:
    """Products with a work by code, else by title; those with neither get a key of their own."""
    by_code = link.code_bridge(t.az_meta, t.editions)
    by_title = link.title_match(t.az_meta, authored(t)).withColumnRenamed("work_id", "t_work")
    j = by_code.join(by_title, "parent_asin", "left")
    old = j.filter("coalesce(work_id, t_work) is not null").select("parent_asin", F.coalesce("work_id", "t_work").alias("work_id"), F.lit(None).cast("string").alias("new_key"))
    keys = t.az_meta.select("parent_asin", F.concat_ws("|", T.author_key(F.col("author")), T.short_key(F.col("title"))).alias("new_key"), T.author_key(F.col("author")).alias("ak"), T.short_key(F.col("title")).alias("tk"))
    keys = keys.filter("ak <> '' and tk <> ''").groupBy("parent_asin").agg(F.min("new_key").alias("new_key"))
    new = j.filter("work_id is null and t_work is null").select("parent_asin").join(keys, "parent_asin").select("parent_asin", F.lit(None).cast("long").alias("work_id"), "new_key")
    return old.unionByName(new)


ITEMS = f"""{BRIDGE}, {TITLED}, items as materialized (
  select b.parent_asin, coalesce(b.work_id, m.work_id) as work_id, cast(null as varchar) as new_key from bridge b left join tm m using (parent_asin) where coalesce(b.work_id, m.work_id) is not null
  union all
  select b.parent_asin, null, k.new_key from bridge b left join tm m using (parent_asin) join (
    select parent_asin, min({AKEY.format(c='author')} || '|' || {tkey('title')}) as new_key from az_meta where {AKEY.format(c='author')} <> '' and {tkey('title')} <> '' group by 1) k using (parent_asin)
  where b.work_id is null and m.work_id is null)"""


@R.add("j12_item_works", f"with {ITEMS} select * from items")
def _(t: Tables) -> DataFrame:
    return _item_works(t)


@R.add("j13_new_work_ids", f"with {ITEMS} select new_key, 100000000 + row_number() over (order by new_key) as work_id, n from (select new_key, count(*) as n from items where new_key is not null group by 1)")
def _(t: Tables) -> DataFrame:
    n = _item_works(t).filter("new_key is not null").groupBy("new_key").agg(F.count(F.lit(1)).alias("n"))
    return link.dense_ids(n, "new_key", 100_000_000, "work_id")


@R.add("j14_known_authors", f"select {AKEY.format(c='name')} as akey, arg_max(author_id, (coalesce(ratings_count, -1), -author_id)) as author_id from authors where {AKEY.format(c='name')} <> '' group by 1")
def _(t: Tables) -> DataFrame:
    k = t.authors.select(T.author_key(F.col("name")).alias("akey"), "author_id", F.coalesce("ratings_count", F.lit(-1)).alias("n")).filter("akey <> ''")
    return k.groupBy("akey").agg(F.max(F.struct("n", -F.col("author_id"))).alias("b")).select("akey", (-F.col("b.col2")).alias("author_id"))


@R.add("w08_new_author_ids", f"""with x as (select distinct {AKEY.format(c='az.author')} as akey from az_meta az), k as (select {AKEY.format(c='name')} as akey, max(author_id) as author_id from authors group by 1)
select x.akey, 100000000 + dense_rank() over (order by x.akey) as author_id from x left join k using (akey) where k.akey is null and x.akey <> ''""")
def _(t: Tables) -> DataFrame:
    x = t.az_meta.select(T.author_key(F.col("author")).alias("akey")).filter("akey <> ''").distinct()
    known = t.authors.select(T.author_key(F.col("name")).alias("akey"))
    return link.dense_ids(x.join(known, "akey", "left_anti"), "akey", 100_000_000, "author_id")


@R.add("j15_match_by_title", f"with {AUTHORED}, k as (select {AKEY.format(c='author')} as akey, {KEY.format(c='title')} as tkey, min(work_id) as work_id, count(*) as n_works from authored group by 1, 2) select * from k where akey <> '' and tkey <> ''")
def _(t: Tables) -> DataFrame:
    a = authored(t).select("work_id", T.author_key(F.col("author")).alias("akey"), T.title_key(F.col("title")).alias("tkey")).filter("akey <> '' and tkey <> ''")
    return a.groupBy("akey", "tkey").agg(F.min("work_id").alias("work_id"), F.count(F.lit(1)).alias("n_works"))


@R.add("j16_external_links", "select a.user_id, b.user_id as other_id from (select distinct user_id, lower(trim(external_id)) as k from users) a join (select lower(trim(external_id)) as k, min(user_id) as user_id from users group by 1) b using (k) where a.user_id <> b.user_id and length(k) = 32")
def _(t: Tables) -> DataFrame:
    k = F.regexp_replace(F.lower("external_id"), "^ +| +$", "")
    a = t.users.select("user_id", k.alias("k")).distinct()
    b = t.users.groupBy(k.alias("k")).agg(F.min("user_id").alias("other_id"))
    return a.join(b, "k").filter("user_id <> other_id and length(k) = 32").select("user_id", "other_id")


@R.add("j17_lateral_main_author", "select w.work_id, x.name from works w, lateral (select a.name from editions e join authors a on a.author_id = e.author_ids[1] where e.work_id = w.work_id order by e.ratings_count desc nulls last, e.book_id, e.updated_at desc limit 1) x")
def _(t: Tables) -> DataFrame:
    a = t.editions.select("work_id", "book_id", "ratings_count", "updated_at", F.get("author_ids", F.lit(0)).alias("author_id")).join(t.authors.select("author_id", "name"), "author_id")
    best = a.groupBy("work_id").agg(F.max_by("name", F.struct(F.coalesce("ratings_count", F.lit(-(1 << 62))), -F.col("book_id"), "updated_at")).alias("name"))
    return t.works.select("work_id").join(best, "work_id")


@R.add("j18_id_map", "select external_id, row_number() over (order by external_id) + 5000 as new_id from (select distinct lower(trim(external_id)) as external_id from users where external_id is not null)")
def _(t: Tables) -> DataFrame:
    ids = t.users.filter("external_id is not null").select(F.lower(F.trim("external_id")).alias("external_id")).distinct()
    return link.dense_ids(ids, "external_id", 5000, "new_id")


@R.add("j19_stale", "select distinct e.book_id from editions e where e.book_id is not null and not exists (select 1 from works w where w.best_book_id = e.book_id)")
def _(t: Tables) -> DataFrame:
    return t.editions.filter("book_id is not null").select("book_id").distinct().join(t.works.select(F.col("best_book_id").alias("book_id")), "book_id", "left_anti")




@R.add("j20_table_changes", """with o as (select book_id, max(title) as title, min(ratings_count) as n from editions where book_id is not null and updated_at < timestamp '2014-01-01' group by 1),
n as (select book_id, max(title) as title, min(ratings_count) as n from editions where book_id is not null and updated_at >= timestamp '2013-01-01' group by 1)
select book_id, case when o.book_id is null then 'insert' when n.book_id is null then 'delete' when o.title is not distinct from n.title and o.n is not distinct from n.n then 'same' else 'update' end as change
from o full join n using (book_id)""")
def _(t: Tables) -> DataFrame:
    e = t.editions.filter("book_id is not null")
    side = lambda df: df.groupBy("book_id").agg(F.max("title").alias("title"), F.min("ratings_count").alias("n"))
    old, new = side(e.filter("updated_at < timestamp_ntz '2014-01-01'")), side(e.filter("updated_at >= timestamp_ntz '2013-01-01'"))
    return link.table_changes(old, new, "book_id", ["title", "n"])


@R.add("j21_unnest_join", "select a.author_id, count(*) as n_editions from editions e, unnest(e.author_ids) as u(aid) join authors a on a.author_id = u.aid group by 1")
def _(t: Tables) -> DataFrame:
    return t.editions.select(F.explode("author_ids").alias("author_id")).join(t.authors.select("author_id"), "author_id").groupBy("author_id").agg(F.count(F.lit(1)).alias("n_editions"))


@R.add("j08_needed_only", f"with {RW} select a.author_id, count(*) as n_works from (select distinct work_id, author_ids[1] as author_id from editions where work_id in (select work_id from rw group by 1 having count(*) >= 50)) a where a.author_id is not null group by 1")
def _(t: Tables) -> DataFrame:
    needed = work_level(t).groupBy("work_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 50").select("work_id")
    a = t.editions.select("work_id", F.get("author_ids", F.lit(0)).alias("author_id")).join(needed, "work_id", "left_semi").distinct()
    return a.filter("author_id is not null").groupBy("author_id").agg(F.count(F.lit(1)).alias("n_works"))


@R.add("j09_work_info", f"with {CATALOG}, {PRIMARY}, every as (select work_id, list_sort(list(distinct a)) as authors from (select work_id, unnest(author_ids) as a from editions where work_id is not null) group by 1) select c.work_id, a.name as author, p.author_id, e.authors, {KEY.format(c='c.title')} as key from catalog c left join prim p using (work_id) left join every e using (work_id) left join authors a on a.author_id = p.author_id")
def _(t: Tables) -> DataFrame:
    c = clean.build_catalog(t.works, t.editions)
    p = clean.primary_authors(t.works, t.editions, t.authors)
    every = t.editions.filter("work_id is not null").select("work_id", F.explode("author_ids").alias("a")).groupBy("work_id").agg(F.array_sort(F.collect_set("a")).alias("authors"))
    j = c.join(p, "work_id", "left").join(every, "work_id", "left").join(t.authors.select("author_id", F.col("name").alias("author")), "author_id", "left")
    return j.select("work_id", "author", "author_id", "authors", T.title_key(F.col("title")).alias("key"))


@R.add("a12_arg_max", "select work_id, arg_max(book_id, (coalesce(ratings_count, -1), -book_id)) as most_rated, arg_min(book_id, (coalesce(num_pages, 100000), book_id)) as shortest from editions where work_id is not null and book_id is not null group by 1")
def _(t: Tables) -> DataFrame:
    e = t.editions.filter("work_id is not null and book_id is not null")
    return e.groupBy("work_id").agg(
        F.max_by("book_id", F.struct(F.coalesce("ratings_count", F.lit(-1)), -F.col("book_id"))).alias("most_rated"), F.min_by("book_id", F.struct(F.coalesce("num_pages", F.lit(100000)), "book_id")).alias("shortest")
    )


@R.add("a13_first_ordered", "select work_id, first(title order by ratings_count desc nulls last, length(title), title) as title, min(publication_year) as year, bool_or(is_ebook) as any_ebook, count(distinct book_id) as n_editions from editions where work_id is not null and title is not null group by 1")
def _(t: Tables) -> DataFrame:
    e = t.editions.filter("work_id is not null and title is not null")
    order = F.struct(-F.coalesce("ratings_count", F.lit(-(1 << 62))), F.length("title"), "title")
    return e.groupBy("work_id").agg(F.min_by("title", order).alias("title"), F.min("publication_year").alias("year"), F.bool_or("is_ebook").alias("any_ebook"), F.count_distinct("book_id").alias("n_editions"))


@R.add("a14_author_lists", "select work_id, list_sort(list(distinct a)) as authors from (select work_id, unnest(author_ids) as a from editions where work_id is not null) group by 1")
def _(t: Tables) -> DataFrame:
    return t.editions.filter("work_id is not null").select("work_id", F.explode("author_ids").alias("a")).groupBy("work_id").agg(F.array_sort(F.collect_set("a")).alias("authors"))


@R.add("a10_language_shares", "select work_id, coalesce(language_code, '') as language_code, count(*) as votes, round(count(*) / sum(count(*)) over (partition by work_id), 6) as share from editions where work_id is not null group by 1, 2")
def _(t: Tables) -> DataFrame:
    v = t.editions.filter("work_id is not null").groupBy("work_id", F.coalesce("language_code", F.lit("")).alias("language_code")).agg(F.count(F.lit(1)).alias("votes"))
    return v.withColumn("share", F.round(F.col("votes") / F.sum("votes").over(Window.partitionBy("work_id")), 6))


@R.add("p17_share_mask", "select work_id, coalesce(max(share) filter (language_code = 'eng'), 0) >= 0.4 as mostly_english from (select work_id, coalesce(language_code, '') as language_code, count(*) / sum(count(*)) over (partition by work_id) as share from editions where work_id is not null group by 1, 2) group by 1")
def _(t: Tables) -> DataFrame:
    e = t.editions.filter("work_id is not null")
    share = F.count_if(F.col("language_code") == "eng") / F.count(F.lit(1))
    return e.groupBy("work_id").agg((share >= 0.4).alias("mostly_english"))


@R.add("w09_meta_dedup", "select parent_asin, source, title from (select *, row_number() over (partition by parent_asin order by source, title nulls last, author nulls last, isbn13 nulls last) as rn from az_meta) where rn = 1")
def _(t: Tables) -> DataFrame:
    return link.first_row(t.az_meta, ["parent_asin"], [F.asc("source"), F.asc_nulls_last("title"), F.asc_nulls_last("author"), F.asc_nulls_last("isbn13")]).select("parent_asin", "source", "title")


@R.add("w10_distinct_on", "select distinct on (work_id) work_id, book_id, image_url from editions where image_url is not null and work_id is not null order by work_id, ratings_count desc nulls last, book_id, updated_at desc, image_url")
def _(t: Tables) -> DataFrame:
    e = t.editions.filter("image_url is not null and work_id is not null")
    return link.first_row(e, ["work_id"], [F.desc_nulls_last("ratings_count"), F.asc("book_id"), F.desc("updated_at"), F.asc("image_url")]).select("work_id", "book_id", "image_url")


@R.add("x27_covers", f"with {RW} select * from (select distinct on (e.work_id) e.work_id, e.image_url from editions e where e.image_url like 'http%' and e.work_id in (select work_id from rw) order by e.work_id, e.ratings_count desc nulls last, e.book_id, e.updated_at desc, e.image_url)")
def _(t: Tables) -> DataFrame:
    e = t.editions.filter(F.col("image_url").like("http%")).join(work_level(t).select("work_id").distinct(), "work_id", "left_semi")
    return link.first_row(e, ["work_id"], [F.desc_nulls_last("ratings_count"), F.asc("book_id"), F.desc("updated_at"), F.asc("image_url")]).select("work_id", "image_url")


@R.add("x08_titles_by_popularity", f"with {AUTHORED}, {RW} select a.work_id, a.title, a.author, count(*) as n from authored a join rw using (work_id) group by all order by n desc, a.work_id limit 200")
def _(t: Tables) -> DataFrame:
    return work_level(t).join(authored(t).select("work_id", "title", "author"), "work_id").groupBy("work_id", "title", "author").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "work_id").limit(200)


@R.add("x09_russian_editions", r"select work_id, arg_max(title, (coalesce(ratings_count, -1), -book_id, updated_at)) as title from editions where work_id is not null and (language_code = 'rus' or isbn13 like '9785%') and regexp_matches(title, '[А-Яа-яЁё]') group by 1")
def _(t: Tables) -> DataFrame:
    e = t.editions.filter("work_id is not null").filter((F.col("language_code") == "rus") | F.col("isbn13").like("9785%")).filter(F.col("title").rlike("[А-Яа-яЁё]"))
    return e.groupBy("work_id").agg(F.max_by("title", F.struct(F.coalesce("ratings_count", F.lit(-1)), -F.col("book_id"), "updated_at")).alias("title"))


@R.add("s10_union_sources", "select 'works' as source, title from works where title is not null union all select 'products', title from az_meta where title is not null")
def _(t: Tables) -> DataFrame:
    side = lambda df, n: df.filter("title is not null").select(F.lit(n).alias("source"), "title")
    return side(t.works, "works").unionByName(side(t.az_meta, "products"))


@R.add("u02_union_by_name", "select work_id, title, publication_year, null::varchar as parent_asin from works union all select null, title, null, parent_asin from az_meta")
def _(t: Tables) -> DataFrame:
    return t.works.select("work_id", "title", "publication_year").unionByName(t.az_meta.select("title", "parent_asin"), allowMissingColumns=True)


@R.add("u03_distinct", "select distinct user_id, work_id from ratings")
def _(t: Tables) -> DataFrame:
    return t.ratings.select("user_id", "work_id").distinct()


@R.add("u04_shelf_difference", "select distinct user_id, work_id from ratings where rating = 0 and user_id is not null and work_id is not null and (user_id, work_id) not in (select user_id, work_id from ratings where rating >= 1 and user_id is not null and work_id is not null)")
def _(t: Tables) -> DataFrame:
    r = t.ratings.filter("user_id is not null and work_id is not null")
    return r.filter("rating = 0").select("user_id", "work_id").distinct().join(r.filter("rating >= 1").select("user_id", "work_id"), ["user_id", "work_id"], "left_anti")


@R.add("u05_common_readers", "select user_id from ratings where work_id % 2 = 0 and rating >= 4 intersect select user_id from ratings where work_id % 2 = 1 and rating <= 2")
def _(t: Tables) -> DataFrame:
    a = t.ratings.filter("work_id % 2 = 0 and rating >= 4").select("user_id")
    return a.intersect(t.ratings.filter("work_id % 2 = 1 and rating <= 2").select("user_id"))


@R.add("k06_page", f"with {RW} select work_id, count(*) as n from rw group by 1 order by n desc, work_id limit 50 offset 100")
def _(t: Tables) -> DataFrame:
    return work_level(t).groupBy("work_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "work_id").offset(100).limit(50)


@R.add("k05_least_by_hash", "select user_id from (select distinct user_id from users where user_id is not null) order by md5('3:' || cast(user_id as varchar)), user_id limit 100")
def _(t: Tables) -> DataFrame:
    u = t.users.filter("user_id is not null").select("user_id").distinct()
    return u.orderBy(F.md5(F.concat(F.lit("3:"), F.col("user_id").cast("string"))), "user_id").limit(100)


@R.add("k09_null_order", "select work_id, row_number() over (order by publication_year desc nulls last, work_id) as place from works")
def _(t: Tables) -> DataFrame:
    years = t.works.select("work_id", (-F.coalesce("publication_year", F.lit(-(1 << 30)))).alias("key"))
    from folioforge.operators.skew import numbered
    from folioforge.session import Scratch

    return numbered(years, "key", ["work_id"], Scratch(t.spark, "order")).select("work_id", (F.col("_row") + 1).alias("place"))


@R.add("s16_items_from_ratings", "select c.work_id, c.n_ratings, w.title, w.publication_year from (select work_id, count(*) as n_ratings from ratings where work_id is not null group by 1) c left join works w using (work_id)")
def _(t: Tables) -> DataFrame:
    c = t.ratings.filter("work_id is not null").groupBy("work_id").agg(F.count(F.lit(1)).alias("n_ratings"))
    return c.join(t.works.select("work_id", "title", "publication_year"), "work_id", "left")


@R.add("s17_missing_works", "select count(*) as n_rows, count(distinct work_id) as n_works from ratings r where work_id is not null and not exists (select 1 from works w where w.work_id = r.work_id)")
def _(t: Tables) -> DataFrame:
    gone = t.ratings.filter("work_id is not null").join(t.works, "work_id", "left_anti")
    return gone.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("work_id").alias("n_works"))


@R.add("s25_profile_links", "select count(*) as n_rows, count(w.work_id) as n_matched, count(*) - count(w.work_id) as n_unmatched from az_meta z left join (select title, min(work_id) as work_id from works group by 1) w on w.title = z.title")
def _(t: Tables) -> DataFrame:
    w = t.works.filter("title is not null").groupBy("title").agg(F.min("work_id").alias("work_id"))
    return t.az_meta.join(w, "title", "left").agg(F.count(F.lit(1)).alias("n_rows"), F.count("work_id").alias("n_matched"), F.count_if(F.col("work_id").isNull()).alias("n_unmatched"))


@R.add("s13_scan", "select work_id, title from works where publication_year between 2000 and 2010 and language_code = 'eng'")
def _(t: Tables) -> DataFrame:
    return t.works.filter("publication_year between 2000 and 2010 and language_code = 'eng'").select("work_id", "title")


@R.add("a15_group_by_all", "select language_code, media_type, count(*) as n, cast(sum(books_count) as bigint) as n_books from works group by all")
def _(t: Tables) -> DataFrame:
    return t.works.groupBy("language_code", "media_type").agg(F.count(F.lit(1)).alias("n"), F.sum("books_count").cast("bigint").alias("n_books"))


@R.add("m43_funnel", f"with {BRIDGE} select z.language, count(*) as n_products, count(b.work_id) as n_bridged from (select distinct parent_asin, language from az_meta) z join bridge b using (parent_asin) group by 1")
def _(t: Tables) -> DataFrame:
    b = link.code_bridge(t.az_meta, t.editions)
    return t.az_meta.select("parent_asin", "language").distinct().join(b, "parent_asin").groupBy("language").agg(F.count(F.lit(1)).alias("n_products"), F.count("work_id").alias("n_bridged"))


QUERIES, SQL = R.queries, R.sql
