"""Comparisons, labels and held-out selections on top of lists and cores, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import numeric as N
from folioforge.models import popularity as pop
from folioforge.operators import clean, rank
from folioforge.plans.base import Registry, Tables
from folioforge.plans.clean_queries import CORE, RW, core, kcore_sql, work_level
from folioforge.plans.rank_queries import POP, SPLIT, TOPPOP, parts, sql_draw, top_popular
from folioforge.session import Scratch

R = Registry()


def rows_() -> Column:
    return F.count(F.lit(1))



@R.add("m28_new_works", f"""with {SPLIT}, {POP}, fresh as (select p.work_id, p.bayes_log, row_number() over (order by p.bayes_log desc, p.work_id) as place from pop p join works w using (work_id) where w.publication_year > 2012)
select f.work_id, f.place, count(h.user_id) as n_hidden, round(avg(h.rating), 6) as mean_hidden from fresh f left join hid h using (work_id) where f.place <= 50 group by 1, 2""")
def _(t: Tables) -> DataFrame:
    train, _, hid = parts(t)
    fresh = pop.popularity(train).join(t.works.filter("publication_year > 2012").select("work_id"), "work_id", "left_semi").orderBy(F.desc("bayes_log"), "work_id").limit(50)
    placed = fresh.withColumn("place", F.row_number().over(Window.orderBy(F.desc("bayes_log"), "work_id")).cast("bigint"))
    return placed.join(hid, "work_id", "left").groupBy("work_id", "place").agg(F.count("user_id").alias("n_hidden"), F.round(F.avg("rating"), 6).alias("mean_hidden"))


@R.add("m32_common_readers", f"""with {CORE}, {kcore_sql('rw', 3, 10, 12, 'wide')}, common as (select distinct user_id from core intersect select distinct user_id from wide)
select count(*) as n_ratings, count(distinct user_id) as n_readers, round(sum(cast(rating as decimal(12,6)))::double / count(*), 6) as mean from wide where user_id in (select user_id from common)""")
def _(t: Tables) -> DataFrame:
    rw = work_level(t)
    wide = clean.kcore(rw, 3, 10)[0]
    common = core(t).select("user_id").intersect(wide.select("user_id"))
    mean = F.sum(F.col("rating").cast("decimal(12,6)")).cast("double") / rows_()
    return wide.join(common, "user_id", "left_semi").agg(rows_().alias("n_ratings"), F.count_distinct("user_id").alias("n_readers"), F.round(mean, 6).alias("mean"))


@R.add("m36_second_holdout", f"""with {RW}, c as (select r.user_id, count(*) filter (w.publication_year <= 2010) as n_old, count(*) filter (w.publication_year > 2010) as n_new from rw r join works w using (work_id) group by 1)
select user_id, n_old, n_new from c where n_old >= 4 and n_new >= 2 order by {sql_draw(11, 'cast(user_id as varchar)')}, user_id limit 200""")
def _(t: Tables) -> DataFrame:
    year = F.col("publication_year")
    c = work_level(t).join(t.works.select("work_id", "publication_year"), "work_id").groupBy("user_id").agg(F.count_if(year <= 2010).alias("n_old"), F.count_if(year > 2010).alias("n_new"))
    return c.filter("n_old >= 4 and n_new >= 2").orderBy(N.draw(F.col("user_id"), 11), "user_id").limit(200)


@R.add("x17_hits", f"with {TOPPOP} select h.user_id, count(*) as n_hidden, count(t.work_id) as hits, count(t.work_id) filter (floor(h.rating + 0.5) >= 5) as liked from hid h left join top t on t.user_id = h.user_id and t.work_id = h.work_id group by 1")
def _(t: Tables) -> DataFrame:
    train, inp, hid = parts(t)
    top = top_popular(t, inp, pop.popularity(train)).select("user_id", "work_id", F.lit(1).alias("hit"))
    j = hid.join(top, ["user_id", "work_id"], "left")
    return j.groupBy("user_id").agg(rows_().alias("n_hidden"), F.count("hit").alias("hits"), F.count_if(F.col("hit").isNotNull() & (N.half_up(F.col("rating")) >= 5)).alias("liked"))


@R.add("x21_lifted", f"""with {SPLIT}, {POP}, p as (select work_id, row_number() over (order by n desc, work_id) as by_count, row_number() over (order by bayes desc, work_id) as by_taste from pop)
select work_id, by_count, by_taste, by_taste < by_count as lifted, by_taste <= 20 as bold from p""")
def _(t: Tables) -> DataFrame:
    every = pop.popularity(parts(t)[0])

    def place(by: str, name: str) -> DataFrame:
        placed = rank.numbered_ranking(every.select("work_id", F.col(by).cast("double").alias("score")), Scratch(t.spark, "lifted"))
        return placed.select("work_id", F.col("place").alias(name))

    p = place("n", "by_count").join(place("bayes", "by_taste"), "work_id")
    return p.select("*", (F.col("by_taste") < F.col("by_count")).alias("lifted"), (F.col("by_taste") <= 20).alias("bold"))


@R.add("x22_labels", f"with {CORE} select user_id, work_id, case when rating >= 4.5 then 'loved' when rating <= 2 then 'low' else 'read' end || ' (' || cast(cast(floor(rating + 0.5) as int) as varchar) || ')' as label from core")
def _(t: Tables) -> DataFrame:
    kind = F.when(F.col("rating") >= 4.5, "loved").when(F.col("rating") <= 2, "low").otherwise("read")
    return core(t).select("user_id", "work_id", F.format_string("%s (%d)", kind, N.half_up(F.col("rating"))).alias("label"))


@R.add("x23_side_by_side", f"""with {SPLIT}, {POP}, a as (select work_id, row_number() over (order by n desc, work_id) as place from pop qualify place <= 30), b as (select work_id, row_number() over (order by bayes desc, work_id) as place from pop qualify place <= 30)
select coalesce(a.work_id, b.work_id) as work_id, a.place as old_place, b.place as new_place from a full join b using (work_id)""")
def _(t: Tables) -> DataFrame:
    p = pop.popularity(parts(t)[0])

    def first(by: str, name: str) -> DataFrame:
        top = p.orderBy(F.desc(by), "work_id").limit(30)
        return top.select("work_id", F.row_number().over(Window.orderBy(F.desc(by), "work_id")).cast("bigint").alias(name))

    return first("n", "old_place").join(first("bayes", "new_place"), "work_id", "full")


@R.add("x26_journal_ratings", """with m as (select shadow_work_id, min(main_work_id) as main_work_id from work_merges where main_work_id is not null and shadow_work_id is not null group by 1)
select r.user_id, coalesce(m.main_work_id, r.work_id) as work_id, r.rated_at, r.loaded_at, greatest(r.rating, 1.0::float) as rating from ratings r left join m on m.shadow_work_id = r.work_id
where r.user_id is not null and r.work_id is not null and r.rating between 0.5 and 5""")
def _(t: Tables) -> DataFrame:
    m = t.work_merges.filter("main_work_id is not null and shadow_work_id is not null").groupBy("shadow_work_id").agg(F.min("main_work_id").alias("main_work_id"))
    r = t.ratings.filter("user_id is not null and work_id is not null and rating between 0.5 and 5")
    return r.join(m, F.col("work_id") == F.col("shadow_work_id"), "left").select("user_id", F.coalesce("main_work_id", "work_id").alias("work_id"), "rated_at", "loaded_at", F.greatest("rating", F.lit(1.0).cast("float")).alias("rating"))


@R.add("x24_by_stage", f"with {CORE}, n as (select user_id, count(*) as n, sum(cast(rating as decimal(12,6)))::double / count(*) as mean from core group by 1) select coalesce(case when n >= 20 then '20+' when n >= 10 then '10-19' else '5-9' end, 'all') as stage, count(*) as n_readers, round(avg(mean), 6) as mean from n group by rollup (case when n >= 20 then '20+' when n >= 10 then '10-19' else '5-9' end)")
def _(t: Tables) -> DataFrame:
    n = core(t).groupBy("user_id").agg(rows_().alias("n"), (F.sum(F.col("rating").cast("decimal(12,6)")).cast("double") / rows_()).alias("mean"))
    stage = F.when(F.col("n") >= 20, "20+").when(F.col("n") >= 10, "10-19").otherwise("5-9")
    r = n.select(stage.alias("s"), "mean").rollup("s").agg(rows_().alias("n_readers"), F.round(F.avg("mean"), 6).alias("mean"))
    return r.select(F.coalesce("s", F.lit("all")).alias("stage"), "n_readers", "mean")


@R.add("m30_features", f"""with {SPLIT}, {POP}, u as (select user_id, count(*) as n_read, sum(cast(rating as decimal(12,6)))::double / count(*) as mean_u from inp group by 1)
select h.user_id, h.work_id, u.n_read, round(u.mean_u, 6) as mean_u, p.n as n_work, round(p.bayes - u.mean_u, 6) as gap, floor(h.rating + 0.5)::int as label, case when {sql_draw(5, "cast(h.user_id as varchar) || ':' || cast(h.work_id as varchar)")} < 0.1 then 10.0 else 1.0 end::double as weight
from hid h join u using (user_id) join pop p using (work_id)""")
def _(t: Tables) -> DataFrame:
    train, inp, hid = parts(t)
    u = inp.groupBy("user_id").agg(rows_().alias("n_read"), (F.sum(F.col("rating").cast("decimal(12,6)")).cast("double") / rows_()).alias("mean_u"))
    p = pop.popularity(train).select("work_id", F.col("n").alias("n_work"), "bayes")
    weight = F.when(N.draw(F.concat_ws(":", "user_id", "work_id"), 5) < 0.1, 10.0).otherwise(1.0)
    j = hid.join(u, "user_id").join(p, "work_id")
    return j.select("user_id", "work_id", "n_read", F.round("mean_u", 6).alias("mean_u"), "n_work", F.round(F.col("bayes") - F.col("mean_u"), 6).alias("gap"), N.half_up(F.col("rating")).cast("int").alias("label"), weight.alias("weight"))


QUERIES, SQL = R.queries, R.sql
