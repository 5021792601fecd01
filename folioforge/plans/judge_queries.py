"""Judging queries: paired comparisons by stage, a guarded choice, the noise control, leave-one-out, and name keys."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import numeric as N
from folioforge.functions import text as T
from folioforge.models import links
from folioforge.models import popularity as pop
from folioforge.operators import judge, rank
from folioforge.plans.base import Registry, Tables
from folioforge.plans.rank_queries import CAND, METRICS, POP, SPLIT, candidates, marked, parts, sql_draw, top_popular
from folioforge.session import Scratch

R = Registry()

_STAR = "case floor(rating + 0.5) when 1 then -1.0 when 2 then -0.5 when 3 then 0.5 when 4 then 1.0 when 5 then 2.0 end"
_LEVELS = (0.0, 1.0, 2.0, 4.0, 8.0)


def _second(sql: str) -> str:
    """The CTEs of the list's measures once more, for the list by mean instead of popularity."""
    own = sql[len(f"{SPLIT}, {POP}") :].replace("bayes_log", "bayes")
    return re.sub(r"\b(ranked|top|g|ideal|got|metrics)\b", r"\1_b", own)


def _interval(d: str, n: str = "n") -> str:
    se = f"stddev_samp({d}) / sqrt(count({d}))"
    return f"count({d}) as {n}, round(avg({d}), 6) as diff, round(avg({d}) - 1.96 * {se}, 6) as lo, round(avg({d}) + 1.96 * {se}, 6) as hi"


@R.add("x18_paired_by_stage", f"""with {METRICS}{_second(METRICS)},
s as (select distinct user_id, case when n >= 160 then '160+' when n >= 40 then '40-159' else 'under 40' end as stage from marked),
d as (select s.stage, b.ndcg - a.ndcg as d from metrics a join metrics_b b using (user_id) join s using (user_id)),
r as (select coalesce(stage, 'all') as stage, {_interval('d')} from d group by rollup (stage))
select *, case when lo > 0 then 'better' when hi < 0 then 'worse' else 'same' end as verdict from r""")
def _(t: Tables) -> DataFrame:
    """Whether a list by smoothed mean is better than one by popularity, by readers' stages."""
    train, inp, hid = parts(t)
    p = pop.popularity(train)
    by_mean = rank.numbered_ranking(p.select("work_id", F.col("bayes").alias("score")), Scratch(t.spark, "mean"))
    old = rank.list_metrics(top_popular(t, inp, p), hid)
    new = rank.list_metrics(rank.top_unread(inp, by_mean, 20, Scratch(t.spark, "mean")), hid)
    stage = F.when(F.col("n") >= 160, "160+").when(F.col("n") >= 40, "40-159").otherwise("under 40")
    return judge.paired_by_stage(old, new, "ndcg", marked(t).select("user_id", stage.alias("stage")).distinct())


def _picked(c: DataFrame, score, k: int = 3) -> DataFrame:
    """(w, user_id, quality, hits): stars' worth and fives among each reader's first k candidates, by variant."""
    place = F.row_number().over(Window.partitionBy("w", "user_id").orderBy(F.desc(F.round(score, 9)), "work_id"))
    first = c.withColumn("r", place).filter(F.col("r") <= k)
    return first.groupBy("w", "user_id").agg(F.avg(N.star_value(F.col("rating"))).alias("quality"), F.count_if(N.half_up(F.col("rating")) >= 5).alias("hits"))


def _variants(c: DataFrame, levels) -> DataFrame:
    return c.withColumn("w", F.explode(F.array(*[F.lit(x) for x in levels])))


_PICKED = """per as (select w, user_id, avg({star}) as quality, count(*) filter (floor(rating + 0.5) >= 5) as hits from (
  select *, row_number() over (partition by w, user_id order by round({score}, 9) desc, work_id) as r from cand, (select unnest({levels}) as w)) where r <= 3 group by 1, 2)"""


@R.add("m16_choice", f"""with {CAND}, {_PICKED.format(star=_STAR, score="score + w * bayes", levels=list(_LEVELS))},
d as (select p.w, p.quality - o.quality as d, p.hits - o.hits as e from per p join per o on o.user_id = p.user_id and o.w = 0),
r as (select w, {_interval('d')}, coalesce(round(avg(e) + 1.96 * stddev_samp(e) / sqrt(count(e)), 6) >= 0, false) as guarded from d group by w)
select *, w = coalesce((select min_by(w, (-diff, w)) from r where guarded and lo > 0), 0) as chosen from r""")
def _(t: Tables) -> DataFrame:
    per = _picked(_variants(candidates(t), _LEVELS), F.col("score") + F.col("w") * F.col("bayes"))
    return judge.choose(per, "w", 0.0, "quality", "hits")


@R.add("m17_noise_curve", f"""with {CAND}, {_PICKED.format(star=_STAR, score=f"score + w * ({sql_draw(11, "cast(user_id as varchar) || ':' || cast(work_id as varchar)")} - 0.5)", levels=list(_LEVELS))}
select w, round(avg(hits), 6) as hits, round(avg(quality), 6) as quality from per group by w""")
def _(t: Tables) -> DataFrame:
    """Hits and quality when noise takes the place of taste; ``judge.noise_at`` reads the curve."""
    per = _picked(_variants(candidates(t), _LEVELS), F.col("score") + F.col("w") * judge.noise(11))
    return per.groupBy("w").agg(F.round(F.avg("hits"), 6).alias("hits"), F.round(F.avg("quality"), 6).alias("quality"))


@R.add("m19_left_out", f"""with {SPLIT}, l as (select a.work_id as src, b.work_id as dst, count(*) as w from train a join train b on a.user_id = b.user_id and a.work_id <> b.work_id group by 1, 2 having count(*) >= 5)
select i.user_id, i.work_id, cast(sum(cast(j.rating * l.w as decimal(20,6))) as double) as score from inp i join inp j on j.user_id = i.user_id and j.work_id <> i.work_id join l on l.src = j.work_id and l.dst = i.work_id group by 1, 2""")
def _(t: Tables) -> DataFrame:
    train, inp, _ = parts(t)
    once = links.coread(train, 5)
    both = once.select(F.explode(F.array(F.struct(F.col("i").alias("src"), F.col("j").alias("dst")), F.struct(F.col("j").alias("src"), F.col("i").alias("dst")))).alias("e"), "n")
    scores = judge.left_out_scores(inp.select("user_id", "work_id", F.col("rating").alias("x")), both.select("e.src", "e.dst", F.col("n").cast("double").alias("w")))
    return scores.select("user_id", "work_id", F.round("score", 6).alias("score"))


def _key_sql(c: str) -> str:
    words = rf"list_filter(regexp_split_to_array(strip_accents(lower(regexp_replace(coalesce({c}, ''), '\s*[:(\[].*$', ''))), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    return f"(select array_to_string(case when len(w) > 1 and w[1] in ('the', 'a', 'an') then w[2:] else w end, ' ') from (select {words} as w))"


def _latin_sql(c: str) -> str:
    out = f"lower({c})"
    for letter, text in T.LATIN.items():
        out = f"replace({out}, '{letter}', '{text}')"
    return out


@R.add("f10_name_keys", f"select author_id::bigint as id, {_key_sql('name')} as key, string_split({_key_sql('name')}, ' ')[-1] as surname, {_latin_sql('name')} as latin from authors union all select name_id, {_key_sql('name')}, string_split({_key_sql('name')}, ' ')[-1], {_latin_sql('name')} from known_names")
def _(t: Tables) -> DataFrame:
    names = t.authors.select(F.col("author_id").cast("bigint").alias("id"), "name").union(t.known_names.select(F.col("name_id").cast("bigint"), "name"))
    c = F.col("name")
    return names.select("id", T.compare_key(c).alias("key"), T.surname(c).alias("surname"), T.latin(c).alias("latin"))


@R.add("f11_best_match", f"""with p as (select parent_asin, {_key_sql('title')} as key, string_split({_key_sql('author')}, ' ') as people, length(coalesce(publisher_raw, '')) as n from az_meta where parent_asin is not null),
w as (select w.work_id, {_key_sql('w.title')} as key, string_split({_key_sql('a.name')}, ' ')[-1] as last from works w join (select work_id, min(author_ids[1]) as author_id from editions where work_id is not null group by 1) e using (work_id) join authors a using (author_id))
select w.work_id, arg_max(p.parent_asin, (p.n, p.parent_asin)) as parent_asin, count(*) as n_matches from w join p on p.key = w.key and list_contains(p.people, w.last) where w.key <> '' and w.last <> '' group by 1""")
def _(t: Tables) -> DataFrame:
    """Of the products with a work's title and the surname of its author the one that says most of its publisher."""
    p = t.az_meta.filter("parent_asin is not null").select("parent_asin", T.compare_key(F.col("title")).alias("key"), F.explode(F.array_distinct(F.split(T.compare_key(F.col("author")), " "))).alias("last"), F.length(F.coalesce("publisher_raw", F.lit(""))).alias("n"))
    first = t.editions.filter("work_id is not null").groupBy("work_id").agg(F.min(F.get("author_ids", 0)).alias("author_id"))
    w = t.works.join(first, "work_id").join(t.authors, "author_id").select("work_id", T.compare_key(F.col("title")).alias("key"), T.surname(F.col("name")).alias("last")).filter("key <> '' and last <> ''")
    return w.join(p, ["key", "last"]).groupBy("work_id").agg(F.max_by("parent_asin", F.struct("n", "parent_asin")).alias("parent_asin"), F.count(F.lit(1)).alias("n_matches"))


QUERIES, SQL = R.queries, R.sql
