"""Splits, models, ranked lists and their measures over the rating core, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import numeric as N
from folioforge.functions import text as T
from folioforge.models import chance, explain, factors, knn, links
from folioforge.models import popularity as pop
from folioforge.operators import clean, listing, rank, series, split
from folioforge.plans import title_sql as S
from folioforge.plans.base import Registry, Tables
from folioforge.plans.clean_queries import CATALOG, CORE, KEY, PRIMARY, SERIES_NO, core, work_level
from folioforge.session import Scratch

R = Registry()
HELD = {"test": 0.1, "val": 0.1}
#: Works that links are fitted over, and links kept of each (the reference's sizes).
WIDTH, LINKS = 30_000, 100
#: Factors and alternating rounds (the reference's).
FACTORS, TASTE_ROUNDS, IMPLICIT_ROUNDS = 64, 10, 15


def sql_draw(salt: int, key: str) -> str:
    return f"(cast(('0x' || substr(md5('{salt}:' || {key}), 1, 13)) as bigint) / 4503599627370496.0)"


SPLIT = f"""{CORE}, readers as materialized (select user_id, count(*) as n from core group by 1),
grouped as materialized (select *, case when draw < 0.1 then 'test' when draw < 0.2 then 'val' else 'train' end as grp from (select user_id, n, {sql_draw(7, 'cast(user_id as varchar)')} as draw from readers)),
marked as materialized (select c.user_id, c.work_id, c.rating, g.grp, g.n,
  row_number() over (partition by c.user_id order by {sql_draw(8, "cast(c.user_id as varchar) || ':' || cast(c.work_id as varchar)")}, c.work_id) <= greatest(1, round(0.2 * g.n)) as hidden
  from core c join grouped g using (user_id)),
train as materialized (select user_id, work_id, rating from marked where grp = 'train'),
inp as materialized (select user_id, work_id, rating from marked where grp = 'test' and not hidden),
hid as materialized (select user_id, work_id, rating from marked where grp = 'test' and hidden)"""
POP = """mu as (select sum(cast(rating as decimal(12,6)))::double / count(*) as mu from train),
pop as materialized (select work_id, n, round((s + 100.0 * mu) / (n + 100.0), 9) as bayes, round((s + 100.0 * mu) / (n + 100.0) * ln(1 + n), 9) as bayes_log
  from (select work_id, count(*) as n, sum(cast(rating as decimal(12,6)))::double as s from train group by 1), mu)"""
TOPPOP = f"""{SPLIT}, {POP}, ranked as materialized (select work_id, row_number() over (order by bayes_log desc, work_id) as r, bayes_log as score from pop),
top as materialized (select user_id, work_id, score, row_number() over (partition by user_id order by score desc, work_id) as rank from (
  select i.user_id, p.work_id, p.score from (select user_id, count(*) as n from inp group by 1) i join ranked p on p.r <= 20 + i.n
  where not exists (select 1 from inp x where x.user_id = i.user_id and x.work_id = p.work_id)) qualify rank <= 20)"""


def marked(t: Tables) -> DataFrame:
    def make() -> DataFrame:
        c = core(t).select("user_id", "work_id", "rating")
        readers = c.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
        return split.hide(c).join(split.assign_groups(readers, "user_id", HELD), "user_id")

    return t.shared("marked", ("ratings",), make)


def parts(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = marked(t)
    cols = ["user_id", "work_id", "rating"]
    return m.filter("grp = 'train'").select(*cols), m.filter("grp = 'test' and not hidden").select(*cols), m.filter("grp = 'test' and hidden").select(*cols)


def ranking(t: Tables, popularity: DataFrame) -> tuple[DataFrame, Scratch]:
    scratch = Scratch(t.spark, "ranking")
    return rank.numbered_ranking(popularity.select("work_id", F.col("bayes_log").alias("score")), scratch), scratch


def top_popular(t: Tables, inputs: DataFrame, popularity: DataFrame, k: int = 20) -> DataFrame:
    """(user_id, work_id, score, rank): the first k unread works of each reader by popularity."""
    placed, scratch = ranking(t, popularity)
    return rank.top_unread(inputs, placed, k, scratch)


def flagship(t: Tables) -> DataFrame:
    """Twenty unread works for every reader of the core by smoothed popularity."""
    c = core(t)
    return top_popular(t, c, pop.popularity(c)).select("user_id", "work_id", "rank", "score")


@R.add("k03_unread_popular", f"""with {CORE}, train as (select * from core), {POP}, ranked as materialized (select work_id, row_number() over (order by bayes_log desc, work_id) as r, bayes_log as score from pop)
select user_id, work_id, rank, score from (select i.user_id, p.work_id, p.score, row_number() over (partition by i.user_id order by p.score desc, p.work_id) as rank
from (select user_id, count(*) as n from core group by 1) i join ranked p on p.r <= 20 + i.n where not exists (select 1 from core x where x.user_id = i.user_id and x.work_id = p.work_id)) where rank <= 20""")
def _(t: Tables) -> DataFrame:
    return flagship(t)


@R.add("m01_groups", f"with {SPLIT} select user_id, n, grp, round(draw, 12) as draw from grouped")
def _(t: Tables) -> DataFrame:
    readers = core(t).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return split.assign_groups(readers, "user_id", HELD).select("user_id", "n", "grp", F.round("draw", 12).alias("draw"))


@R.add("m38_bucket_sizes", f"with {CORE}, b as (select case when n >= 1000 then '1000+' when n >= 320 then '320-999' when n >= 160 then '160-319' when n >= 80 then '80-159' when n >= 40 then '40-79' when n >= 20 then '20-39' end as bucket from (select user_id, count(*) as n from core group by 1)) select bucket, count(*) as n_readers from b group by 1")
def _(t: Tables) -> DataFrame:
    n = core(t).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(split.bucket_of(F.col("n")).alias("bucket")).agg(F.count(F.lit(1)).alias("n_readers"))


@R.add("m02_hide", f"with {SPLIT} select user_id, work_id, hidden from marked")
def _(t: Tables) -> DataFrame:
    return split.hide(core(t)).select("user_id", "work_id", "hidden")


@R.add("j07_train_rows", f"with {SPLIT} select user_id, work_id, rating from core c where not exists (select 1 from grouped g where g.user_id = c.user_id and g.grp <> 'train')")
def _(t: Tables) -> DataFrame:
    c = core(t).select("user_id", "work_id", "rating")
    held = split.assign_groups(c.select("user_id").distinct(), "user_id", HELD).filter("grp <> 'train'")
    return split.train_rows(c, held)


@R.add("a16_popularity", f"with {SPLIT}, {POP} select * from pop")
def _(t: Tables) -> DataFrame:
    return pop.popularity(parts(t)[0])


@R.add("a17_smoothed_means", f"with {SPLIT}, mu as (select sum(cast(rating as decimal(12,6)))::double / count(*) as mu from train) select work_id, n, round((s + 50.0 * mu) / (n + 50.0), 9) as smoothed from (select work_id, count(*) as n, sum(cast(rating as decimal(12,6)))::double as s from train group by 1), mu")
def _(t: Tables) -> DataFrame:
    return pop.smoothed_means(parts(t)[0])


@R.add("x16_item_baselines", f"with {SPLIT} select w.work_id, coalesce(x.n, 0) as n, round(coalesce(x.m, (select sum(cast(rating as decimal(12,6)))::double / count(*) from train)), 6) as mean from (select distinct work_id from core) w left join (select work_id, count(*) as n, sum(cast(rating as decimal(12,6)))::double / count(*) as m from train group by 1) x using (work_id)")
def _(t: Tables) -> DataFrame:
    train = parts(t)[0]
    r = F.sum(F.col("rating").cast("decimal(12,6)")).cast("double") / F.count(F.lit(1))
    per = train.groupBy("work_id").agg(F.count(F.lit(1)).alias("n"), r.alias("m"))
    works = core(t).select("work_id").distinct()
    return works.join(per, "work_id", "left").crossJoin(F.broadcast(train.agg(r.alias("all_m")))).select("work_id", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("m", "all_m"), 6).alias("mean"))


@R.add("x14_centred", f"with {CORE} select user_id, work_id, round(rating - sum(cast(rating as decimal(12,6))) over (partition by user_id)::double / count(*) over (partition by user_id), 9) as c from core")
def _(t: Tables) -> DataFrame:
    return knn.centred(core(t)).select("user_id", "work_id", F.round("c", 9).alias("c"))


@R.add("x15_negative_mask", f"with {CORE} select work_id, count(*) filter (rating <= 2) as n_negative, count(*) as n from core group by 1")
def _(t: Tables) -> DataFrame:
    return core(t).groupBy("work_id").agg(F.count_if(F.col("rating") <= 2).alias("n_negative"), F.count(F.lit(1)).alias("n"))


@R.add("j22_coread", f"with {CORE} select a.work_id as i, b.work_id as j, count(*) as n from core a join core b on a.user_id = b.user_id and a.work_id < b.work_id group by 1, 2 having count(*) >= 5")
def _(t: Tables) -> DataFrame:
    return links.coread(core(t), 5)


_Z = """z as materialized (select c.user_id, c.work_id, (c.rating - m.mean_u) / sqrt(ln(1 + greatest(m.n_u, 1))) as z, c.rating - m.mean_u as c from train c
  join (select user_id, count(*) as n_u, sum(cast(rating as decimal(12,6)))::double / count(*) as mean_u from train group by 1) m using (user_id)),
norms as materialized (select work_id, sqrt(cast(sum(cast(round(z * z, 15) as decimal(28,15))) as double)) as norm from z group by 1),
sims as materialized (select d.i, d.j, round(d.dot / a.norm / b.norm * (d.n / (d.n + 10.0)), 9) as sim from (
  select a.work_id as i, b.work_id as j, cast(sum(cast(round(a.z * b.z, 15) as decimal(28,15))) as double) as dot, count(*) as n from z a join z b on a.user_id = b.user_id and a.work_id < b.work_id group by 1, 2) d
  join norms a on a.work_id = d.i join norms b on b.work_id = d.j where a.norm > 0 and b.norm > 0),
nbrs as materialized (select * from (select work_id, other_id, sim, row_number() over (partition by work_id order by abs(sim) desc, other_id) as place from (
  select i as work_id, j as other_id, sim from sims union all select j, i, sim from sims) where sim <> 0) where place <= 30)"""


@R.add("m07_knn_neighbours", f"with {SPLIT}, {_Z} select work_id, other_id, sim, place from nbrs")
def _(t: Tables) -> DataFrame:
    return knn.neighbours(parts(t)[0], 30, 10.0)


@R.add("m07_knn_lists", f"""with {SPLIT}, {POP}, {_Z}, scored as (select c.user_id, n.work_id, cast(sum(cast(round(c.c * n.sim, 15) as decimal(28,15))) as double) as s
from (select user_id, work_id, rating - sum(cast(rating as decimal(12,6))) over (partition by user_id)::double / count(*) over (partition by user_id) as c from inp) c join nbrs n on n.other_id = c.work_id group by 1, 2),
final as (select s.user_id, s.work_id, round(s.s + 1e-6 * p.n / (select max(n) from pop), 9) as score from scored s join pop p using (work_id) where not exists (select 1 from inp x where x.user_id = s.user_id and x.work_id = s.work_id))
select user_id, work_id, score, row_number() over (partition by user_id order by score desc, work_id) as rank from final qualify rank <= 20""")
def _(t: Tables) -> DataFrame:
    train, inp, _ = parts(t)
    return knn.top_lists(inp, knn.neighbours(train, 30, 10.0), pop.popularity(train), 20).select("user_id", "work_id", "score", "rank")


METRICS = f"""{TOPPOP}, g as materialized (select user_id, work_id, case when floor(rating + 0.5) >= 5 then 2.0 when floor(rating + 0.5) >= 4 then 1.0 else 0.0 end as g, (floor(rating + 0.5) <= 2)::int as bad from hid),
ideal as (select user_id, sum(case when p <= 20 then g / log2(p + 1) else 0 end) as idcg, count(*) filter (g > 0) as n_rel, sum(bad) as n_low from (select *, row_number() over (partition by user_id order by g desc, work_id) as p from g) group by 1),
got as (select user_id, sum(g / log2(rank + 1)) as dcg, count(*) filter (g > 0) as n_hit, sum(case when g > 0 then c / rank else 0.0 end) as ap, sum(bad) as low_hit from (
  select t.user_id, t.rank, g.g, g.bad, sum((g.g > 0)::int) over (partition by t.user_id order by t.rank rows unbounded preceding) as c from top t join g using (user_id, work_id)) group by 1),
metrics as materialized (select user_id, case when idcg > 0 then round(coalesce(dcg, 0) / idcg, 9) end as ndcg, case when n_rel > 0 then round(coalesce(n_hit, 0) / least(n_rel, 20), 9) end as recall,
  case when n_rel > 0 then round(coalesce(ap, 0) / least(n_rel, 20), 9) end as map, case when n_low > 0 then round(coalesce(low_hit, 0) / n_low, 9) end as low from ideal left join got using (user_id))"""


def metrics(t: Tables) -> DataFrame:
    train, inp, hid = parts(t)
    return rank.list_metrics(top_popular(t, inp, pop.popularity(train)), hid)


@R.add("m22_list_metrics", f"with {METRICS} select * from metrics")
def _(t: Tables) -> DataFrame:
    return metrics(t)


@R.add("w19_map_summary", f"with {METRICS} select count(*) as n, round(avg(ndcg), 6) as ndcg, round(avg(recall), 6) as recall, round(avg(map), 6) as map, round(avg(low), 6) as low from metrics")
def _(t: Tables) -> DataFrame:
    m = metrics(t)
    return m.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("ndcg", "recall", "map", "low")])


@R.add("a24_coverage", f"with {TOPPOP} select count(distinct work_id) as n_shown, round(count(distinct work_id) / (select count(*) from pop), 9) as coverage from top")
def _(t: Tables) -> DataFrame:
    train, inp, _ = parts(t)
    p = pop.popularity(train)
    return top_popular(t, inp, p).agg(F.count_distinct("work_id").alias("n_shown")).crossJoin(F.broadcast(p.agg(F.count(F.lit(1)).alias("n")))).select("n_shown", F.round(F.col("n_shown") / F.col("n"), 9).alias("coverage"))


@R.add("a25_bootstrap")
def _(t: Tables) -> DataFrame:
    return rank.bootstrap_interval(metrics(t), "recall")


# Scores that both sides can form: the reader's hidden and read works by popularity, as candidates of one list.
CAND = f"{SPLIT}, {POP}, cand as materialized (select m.user_id, m.work_id, m.rating, p.bayes, p.n as pn, p.bayes_log as score from marked m join pop p using (work_id) where m.grp = 'test')"


def candidates(t: Tables) -> DataFrame:
    m = marked(t)
    p = pop.popularity(m.filter("grp = 'train'"))
    return m.filter("grp = 'test'").select("user_id", "work_id", "rating").join(p.select("work_id", "bayes", F.col("n").alias("pn"), F.col("bayes_log").alias("score")), "work_id")


@R.add("w11_z_scores", f"with {CAND} select user_id, work_id, round((score - avg(score) over (partition by user_id)) / greatest(stddev_pop(score) over (partition by user_id), 1e-9), 6) as z from cand where user_id in (select user_id from cand group by 1 having count(*) > 1)")
def _(t: Tables) -> DataFrame:
    c = candidates(t)
    several = c.groupBy("user_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("user_id")
    return rank.z_scores(c.join(several, "user_id", "left_semi"), "score", "z").select("user_id", "work_id", F.round("z", 6).alias("z"))


@R.add("w12_personal_percentile", f"with {CAND} select user_id, work_id, round(rank() over (partition by user_id order by score desc) / count(*) over (partition by user_id), 9) as pct from cand")
def _(t: Tables) -> DataFrame:
    return rank.personal_percentile(candidates(t)).select("user_id", "work_id", F.round("pct", 9).alias("pct"))


@R.add("w13_auc", f"""with {CAND}, r as (select user_id, (floor(rating + 0.5) >= 5)::int as y, rank() over (partition by user_id order by score) + (count(*) over (partition by user_id, score) - 1) / 2 as r from cand)
select user_id, count(*) filter (y = 1) as n_pos, count(*) filter (y = 0) as n_neg, round((sum(case when y = 1 then r else 0 end) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2) / nullif(count(*) filter (y = 1) * count(*) filter (y = 0), 0), 9) as auc from r group by 1""")
def _(t: Tables) -> DataFrame:
    c = candidates(t).withColumn("y", (N.half_up(F.col("rating")) >= 5).cast("int"))
    return rank.auc_by_group(c, "user_id", "score", "y")


@R.add("w17_cutoff", f"""with {CAND}, p as (select *, rank() over (partition by user_id order by score desc) + count(*) over (partition by user_id, score) - 1 <= 5 as inside, score + 2.0 * bayes as s from cand)
select user_id, work_id, round(case when inside then s else score + coalesce(min(case when inside then s end) over (partition by user_id) - max(case when not inside then score end) over (partition by user_id) - 1.0, 0.0) end, 6) as final from p""")
def _(t: Tables) -> DataFrame:
    c = candidates(t).select("user_id", "work_id", F.col("score").alias("crowd"), F.col("bayes").alias("taste"))
    return rank.cutoff_scores(c, 5, 2.0).select("user_id", "work_id", F.round("final", 6).alias("final"))


@R.add("m33_author_cap", f"""with {PRIMARY}, {TOPPOP}, a as (select t.user_id, t.work_id, t.rank, p.author_id, row_number() over (partition by t.user_id, p.author_id order by t.rank) as k from top t left join prim p using (work_id))
select user_id, work_id, author_id, row_number() over (partition by user_id order by rank) as place from a where author_id is null or k <= 1 qualify place <= 10""")
def _(t: Tables) -> DataFrame:
    train, inp, _ = parts(t)
    a = clean.primary_authors(t.works, t.editions, t.authors)
    return rank.author_cap(top_popular(t, inp, pop.popularity(train)).join(a, "work_id", "left"), 10).select("user_id", "work_id", "author_id", "place")


def book_rows(t: Tables) -> DataFrame:
    """Titles, and then authors, are written before words and keys are formed over them: as one plan it is the largest of
    its queries in the driver, and each mention of a title repeats how the title is chosen."""
    scratch = Scratch(t.spark, "book-parts")
    titles = scratch.put(clean.build_catalog(t.works, t.editions).select("work_id", "title", "original_title", "best_edition_title", F.col("is_collection").alias("collection")))
    a = clean.primary_authors(t.works, t.editions, t.authors)
    every = t.editions.filter("work_id is not null").select("work_id", F.explode("author_ids").alias("a")).groupBy("work_id").agg(F.array_sort(F.collect_set("a")).alias("authors"))
    # A main author comes from an edition's authors, so every work that has one is in ``every``.
    people = scratch.put(every.join(a, "work_id", "left"))
    no = T.series_number(F.col("best_edition_title"))
    later = T.is_later_volume(F.col("title")) | (no.try_cast("double") >= 2)
    names = F.filter(F.transform(F.array("title", "original_title", "best_edition_title"), T.name_words), lambda n: n.isNotNull())
    books = titles.join(people, "work_id", "left").select(
        "work_id", T.title_key(F.col("title")).alias("key"), no.alias("no"), "collection", F.coalesce(later, F.lit(False)).alias("later"), "author_id", "authors", names.alias("names")
    )
    out = scratch.put(books)
    scratch.drop(titles)
    scratch.drop(people)
    return out


def books_and_twins(t: Tables) -> tuple[DataFrame, DataFrame]:
    sources = ("works", "editions", "authors")
    books = t.shared("books", sources, lambda: book_rows(t))
    return books, t.shared("same-works", sources, lambda: listing.same_works(books, Scratch(t.spark, "same")))


#: Books and the relation of works that are one work, stated as a condition on all pairs of works with a main author.
BOOKS = f"""{CATALOG}, {PRIMARY}, everyone as materialized (select work_id, list_distinct(flatten(list(author_ids))) as authors from editions where work_id is not null and author_ids is not null group by 1),
bk as materialized (select c.work_id, p.author_id, list_distinct(list_append(coalesce(e.authors, []), p.author_id)) as people, {KEY.format(c='c.title')} as key, {SERIES_NO.format(c='c.best_edition_title')} as no, c.is_collection as coll,
  {S.later_volume('c.title')} or coalesce(try_cast({SERIES_NO.format(c='c.best_edition_title')} as double) >= 2, false) as later,
  list_filter([{S.name_words('c.title')}, {S.name_words('c.original_title')}, {S.name_words('c.best_edition_title')}], lambda n: n is not null and len(n) > 0) as names
  from catalog c left join prim p using (work_id) left join everyone e using (work_id)),
twins as materialized (select a.work_id, b.work_id as other_id from bk a join bk b on a.work_id <> b.work_id and a.author_id is not null and b.author_id is not null
  and (list_contains(b.people, a.author_id) or list_contains(a.people, b.author_id)) and (a.no = b.no or a.no = '' or b.no = '' or a.coll or b.coll)
  and ((a.key <> '' and b.key <> '' and (a.key = b.key or (b.coll and contains(' ' || b.key || ' ', ' ' || a.key || ' ')) or (a.coll and contains(' ' || a.key || ' ', ' ' || b.key || ' '))))
    or len(list_filter(a.names, lambda n: len(list_filter(b.names, lambda m: list_has_all(m, n) or list_has_all(n, m))) > 0)) > 0))"""


@R.add("m33_list_rules", f"""with recursive {SPLIT}, {POP}, {BOOKS},
asked as materialized (select distinct user_id from inp),
cand as materialized (select a.user_id, p.work_id, row_number() over (partition by a.user_id order by p.bayes_log desc, p.work_id) as rank
  from asked a, pop p where not exists (select 1 from inp x where x.user_id = a.user_id and x.work_id = p.work_id)),
old as materialized (select distinct i.user_id, w.other_id as work_id from inp i join twins w using (work_id)),
why as materialized (select c.user_id, c.work_id, c.rank, b.author_id, case when o.work_id is not null then 'rated already' when b.coll then 'collection' when b.later then 'later volume' end as why,
  coalesce(w.others, []) as others from cand c left join bk b using (work_id) left join old o on o.user_id = c.user_id and o.work_id = c.work_id
  left join (select work_id, list(other_id) as others from twins group by 1) w on w.work_id = c.work_id),
fold(user_id, rank, work_id, removed, shown, people) as (
  select user_id, 0::bigint, null::bigint, 'start', []::bigint[], []::bigint[] from asked
  union all
  select f.user_id, c.rank, c.work_id, r.removed, case when r.removed is null then list_append(f.shown, c.work_id) else f.shown end,
         case when r.removed is null and c.author_id is not null then list_append(f.people, c.author_id) else f.people end
  from fold f join why c on c.user_id = f.user_id and c.rank = f.rank + 1,
       lateral (select case when c.why is not null then c.why when list_has_any(f.shown, c.others) then 'same work' when len(list_filter(f.people, lambda p: p = c.author_id)) >= 2 then 'author limit' end as removed) r
  where len(f.shown) < 20)
select user_id, work_id, case when removed is null then len(shown) end as place, removed from fold where rank > 0""")
def _(t: Tables) -> DataFrame:
    train, inp, _ = parts(t)
    books, same = books_and_twins(t)
    placed, scratch = ranking(t, pop.popularity(train))

    def order(readers: DataFrame | None, n: int) -> DataFrame:
        read = inp if readers is None else inp.join(readers, "user_id", "left_semi")
        return rank.top_unread(read, placed, n, scratch).select("user_id", "work_id", "rank")

    return listing.pick_top(order, inp, books, same, 20, scratch)


@R.add("m34_sections", f"""with {TOPPOP}, s as (select t.user_id, t.work_id, case when w.publication_year >= 2015 then 'new' when w.media_type = 'book' then 'book' else 'other' end as section, t.rank from top t join works w using (work_id))
select user_id, section, work_id, row_number() over (partition by user_id, section order by rank) as place from s qualify place <= 5""")
def _(t: Tables) -> DataFrame:
    train, inp, _ = parts(t)
    w = t.works.select("work_id", F.when(F.col("publication_year") >= 2015, "new").when(F.col("media_type") == "book", "book").otherwise("other").alias("section"))
    s = top_popular(t, inp, pop.popularity(train)).join(w, "work_id")
    place = F.row_number().over(Window.partitionBy("user_id", "section").orderBy("rank")).cast("bigint")
    return s.withColumn("place", place).filter("place <= 5").select("user_id", "section", "work_id", "place")


_SERIES = f"sb as materialized ({S.series_rows('works', 'work_id', 'best_edition_title')})"


@R.add("j24_exclusion", f"with {SPLIT}, {_SERIES} select user_id, work_id from inp union select i.user_id, b.work_id from inp i join sb a using (work_id) join sb b on b.series = a.series")
def _(t: Tables) -> DataFrame:
    return series.exclusion(parts(t)[1], series.series_bridge(t.works, "best_edition_title"))


@R.add("x12_without_started", f"with {SPLIT}, {_SERIES}, ex as (select i.user_id, b.work_id from inp i join sb a using (work_id) join sb b on b.series = a.series) select user_id, work_id, rating from hid h where not exists (select 1 from ex where ex.user_id = h.user_id and ex.work_id = h.work_id)")
def _(t: Tables) -> DataFrame:
    _, inp, hid = parts(t)
    ex = series.exclusion(inp, series.series_bridge(t.works, "best_edition_title"))
    return series.without_started(hid, ex).select("user_id", "work_id", "rating")


@R.add("j25_same_work", f"with {BOOKS} select distinct work_id, other_id from twins")
def _(t: Tables) -> DataFrame:
    return books_and_twins(t)[1]


@R.add("x20_rated_already", f"with {TOPPOP}, {BOOKS} select distinct t.user_id, t.work_id from top t join twins w on w.work_id = t.work_id join inp i on i.user_id = t.user_id and i.work_id = w.other_id")
def _(t: Tables) -> DataFrame:
    train, inp, _ = parts(t)
    # The lists are written first: with the ranking in it the last plan is twice as large in the driver.
    lists = Scratch(t.spark, "lists").put(top_popular(t, inp, pop.popularity(train)).select("user_id", "work_id"))
    return listing.rated_already(lists, inp, books_and_twins(t)[1])


@R.add("j26_paired", f"""with {METRICS}, rnd as (select user_id, round({sql_draw(3, 'cast(user_id as varchar)')} * 0.1, 6) as recall from metrics)
select count(m.recall - r.recall) as recall_n, round(avg(m.recall - r.recall), 6) as recall_diff, round(stddev_samp(m.recall - r.recall) / sqrt(count(m.recall - r.recall)), 6) as recall_se from rnd r join metrics m using (user_id)""")
def _(t: Tables) -> DataFrame:
    m = metrics(t)
    base = m.select("user_id", F.round(N.draw(F.col("user_id"), 3) * 0.1, 6).alias("recall"))
    return rank.paired_difference(base, m, "user_id", {"recall": "recall"})


@R.add("a20_reliability", f"with {CAND}, p as (select rank() over (partition by user_id order by score desc) / count(*) over (partition by user_id) as p, (floor(rating + 0.5) >= 5)::int as y from cand) select cast(least(floor(p * 10), 9) as int) as bin, count(*) as n, round(avg(p), 6) as promised, round(avg(y), 6) as actual from p group by 1")
def _(t: Tables) -> DataFrame:
    c = rank.personal_percentile(candidates(t)).withColumn("y", (N.half_up(F.col("rating")) >= 5).cast("int"))
    return rank.reliability(c, "pct", "y")


@R.add("m26_losses", f"with {CAND}, p as (select least(greatest(bayes / 5, 1e-6), 1 - 1e-6) as q, bayes / 5 as p, (floor(rating + 0.5) >= 4)::int as y from cand) select count(*) as n, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) as log_loss, round(avg((p - y) * (p - y)), 6) as brier from p")
def _(t: Tables) -> DataFrame:
    c = candidates(t).select((F.col("bayes") / 5).alias("p"), (N.half_up(F.col("rating")) >= 4).cast("int").alias("y"))
    return rank.probability_losses(c, "p", "y")


@R.add("m27_rmse", f"with {CAND} select count(*) as n, round(sqrt(avg((rating - bayes) * (rating - bayes))), 6) as rmse from cand")
def _(t: Tables) -> DataFrame:
    e = F.col("rating") - F.col("bayes")
    return candidates(t).agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"))


@R.add("m29_rank_bands", f"with {SPLIT}, {POP}, r as (select work_id, row_number() over (order by n desc, work_id) as r from pop) select case when r <= 100 then '1-100' when r <= 300 then '101-300' when r is null then 'unseen' else '301+' end as band, count(*) as n_hidden, round(count(*) / (select count(*) from hid), 6) as share from hid left join r using (work_id) group by 1")
def _(t: Tables) -> DataFrame:
    train, _, hid = parts(t)
    r = rank.numbered_ranking(pop.popularity(train).select("work_id", F.col("n").alias("score")), Scratch(t.spark, "bands")).select("work_id", F.col("place").alias("r"))
    band = F.when(F.col("r") <= 100, "1-100").when(F.col("r") <= 300, "101-300").when(F.col("r").isNull(), "unseen").otherwise("301+")
    total = hid.agg(F.count(F.lit(1)).alias("all"))
    return hid.join(r, "work_id", "left").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n_hidden")).crossJoin(F.broadcast(total)).select("band", "n_hidden", F.round(F.col("n_hidden") / F.col("all"), 6).alias("share"))


@R.add("m16_variants", f"""with {CAND}, v as (select unnest([0.0, 1.0, 3.0]) as w), s as (select v.w, c.user_id, c.work_id, c.rating, row_number() over (partition by v.w, c.user_id order by c.score + v.w * c.bayes desc, c.work_id) as r from cand c, v)
select w, round(avg(case floor(rating + 0.5) when 1 then -1.0 when 2 then -0.5 when 3 then 0.5 when 4 then 1.0 when 5 then 2.0 end), 6) as quality, count(*) as n from s where r <= 3 group by 1""")
def _(t: Tables) -> DataFrame:
    c = candidates(t).withColumn("w", F.explode(F.array(F.lit(0.0), F.lit(1.0), F.lit(3.0))))
    place = F.row_number().over(Window.partitionBy("w", "user_id").orderBy(F.desc(F.col("score") + F.col("w") * F.col("bayes")), "work_id"))
    return c.withColumn("r", place).filter("r <= 3").groupBy("w").agg(F.round(F.avg(N.star_value(F.col("rating"))), 6).alias("quality"), F.count(F.lit(1)).alias("n"))


@R.add("w22_top_per_bucket", f"with {CORE}, n as (select user_id, count(*) as n from core group by 1), b as (select user_id, n, least(n // 10, 3) as bucket from n) select bucket, user_id, n from (select *, row_number() over (partition by bucket order by md5('4:' || cast(user_id as varchar)), user_id) as r from b) where r <= 25")
def _(t: Tables) -> DataFrame:
    n = core(t).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", F.least(F.floor(F.col("n") / 10), F.lit(3)))
    w = Window.partitionBy("bucket").orderBy(F.md5(F.concat(F.lit("4:"), F.col("user_id").cast("string"))), "user_id")
    return n.withColumn("r", F.row_number().over(w)).filter("r <= 25").select("bucket", "user_id", "n")


@R.add("a18_book_table", f"""with {CORE} select c.work_id, count(*) as n, round(sum(cast(c.rating as decimal(12,6)))::double / count(*), 6) as mean, round(count(*) filter (floor(c.rating + 0.5) = 5) / count(*), 6) as five_share,
max(w.publication_year) as year, count(*) filter (floor(c.rating + 0.5) = 1) as s1, count(*) filter (floor(c.rating + 0.5) = 2) as s2, count(*) filter (floor(c.rating + 0.5) = 3) as s3, count(*) filter (floor(c.rating + 0.5) = 4) as s4, count(*) filter (floor(c.rating + 0.5) = 5) as s5
from core c left join works w using (work_id) group by 1""")
def _(t: Tables) -> DataFrame:
    c = core(t).withColumn("star", N.half_up(F.col("rating")))
    stars = c.groupBy("work_id").pivot("star", [1, 2, 3, 4, 5]).agg(F.count(F.lit(1))).fillna(0)
    n = F.count(F.lit(1))
    base = c.groupBy("work_id").agg(n.alias("n"), F.round(F.sum(F.col("rating").cast("decimal(12,6)")).cast("double") / n, 6).alias("mean"), F.round(F.count_if(F.col("star") == 5) / n, 6).alias("five_share"))
    j = base.join(stars, "work_id").join(t.works.select("work_id", F.col("publication_year").alias("year")), "work_id", "left")
    return j.select("work_id", "n", "mean", "five_share", "year", *[F.col(str(s)).alias(f"s{s}") for s in range(1, 6)])


@R.add("a19_star_usage", f"with {CORE}, u as (select user_id, count(*) filter (floor(rating + 0.5) = 5) / count(*) as five from core group by 1) select count(*) as n, round(avg(five), 6) as mean, round(quantile_cont(five, 0.25), 6) as q1, round(quantile_cont(five, 0.5), 6) as q2, round(quantile_cont(five, 0.75), 6) as q3 from u")
def _(t: Tables) -> DataFrame:
    u = core(t).groupBy("user_id").agg((F.count_if(N.half_up(F.col("rating")) == 5) / F.count(F.lit(1))).alias("five"))
    q = lambda p, a: F.round(F.expr(f"percentile(five, {p})"), 6).alias(a)
    return u.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("five"), 6).alias("mean"), q(0.25, "q1"), q(0.5, "q2"), q(0.75, "q3"))


@R.add("x13_known_median", f"with {SPLIT}, {POP}, ranked as (select work_id, n, row_number() over (order by bayes_log desc, work_id) as r from pop) select round(median(n), 6) as median_n, count(*) as n_works from ranked where r <= 100")
def _(t: Tables) -> DataFrame:
    return pop.popularity(parts(t)[0]).orderBy(F.desc("bayes_log"), "work_id").limit(100).agg(F.round(F.median("n"), 6).alias("median_n"), F.count(F.lit(1)).alias("n_works"))


@R.add("x11_unknown_columns", "select count(*) as n_unknown from (select distinct work_id from ratings where work_id is not null) r where not exists (select 1 from works w where w.work_id = r.work_id)")
def _(t: Tables) -> DataFrame:
    return t.ratings.filter("work_id is not null").select("work_id").distinct().join(t.works, "work_id", "left_anti").agg(F.count(F.lit(1)).alias("n_unknown"))


@R.add("m11_normalized_weights", "select * from (values (1, -2.0::double), (2, -1.0), (3, 0.0), (4, 1.0), (5, 2.0)) t(star, w)")
def _(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(list(enumerate(links.normalized_weights((-4.0, -2.0, 0.0, 2.0, 4.0)), 1)), "star int, w double")


@R.add("w21_strongest_links", f"""with {SPLIT}, c as (select a.work_id as src, b.work_id as dst, cast(count(*) as double) as w from train a join train b on a.user_id = b.user_id and a.work_id <> b.work_id group by 1, 2)
select src, dst, w from c qualify row_number() over (partition by dst order by w desc, src) <= 5 or row_number() over (partition by src order by w desc, dst) <= 5""")
def _(t: Tables) -> DataFrame:
    c = links.coread(parts(t)[0])
    w = F.col("n").cast("double").alias("w")
    both = c.select(F.col("i").alias("src"), F.col("j").alias("dst"), w).union(c.select(F.col("j"), F.col("i"), w))
    return links.strongest(both, 5)


@R.add("j23_link_scores", f"""with {SPLIT}, c as (select a.work_id as src, b.work_id as dst, count(*) as w from train a join train b on a.user_id = b.user_id and a.work_id <> b.work_id group by 1, 2 having count(*) >= 10)
select i.user_id, c.dst as work_id, sum(case floor(i.rating + 0.5) when 1 then -2.0 when 2 then -1.0 when 3 then 0.0 when 4 then 1.0 else 2.0 end * c.w)::double as score from inp i join c on c.src = i.work_id group by 1, 2""")
def _(t: Tables) -> DataFrame:
    train, inp, _ = parts(t)
    c = links.coread(train, 10).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("n").alias("w"))
    return links.score(_inputs(inp), c, mirrored=True)


@R.add("k07_similar", f"""with {CORE}, c as (select b.work_id, count(*) as n from core a join core b on a.user_id = b.user_id and a.work_id <> b.work_id where a.work_id = (select min(work_id) from core) group by 1) select work_id, cast(n as double) as w from c order by n desc, work_id limit 10""")
def _(t: Tables) -> DataFrame:
    c = core(t).select("user_id", "work_id")
    first = c.agg(F.min("work_id").alias("work_id"))
    near = c.join(F.broadcast(first), "work_id", "left_semi").select("user_id", F.col("work_id").alias("seed"))
    n = c.join(near, "user_id").filter("work_id <> seed").groupBy("work_id").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return n.orderBy(F.desc("w"), "work_id").limit(10)


@R.add("m08_read_links")
def _(t: Tables) -> DataFrame:
    return links.fit_read(parts(t)[0], 50.0, WIDTH, LINKS)


@R.add("m10_value_links")
def _(t: Tables) -> DataFrame:
    return links.fit_value(parts(t)[0], 50.0, WIDTH, LINKS, min_support=3)


@R.add("m13_taste")
def _(t: Tables) -> DataFrame:
    mu, items = factors.fit_taste(parts(t)[0], FACTORS, 0.05, TASTE_ROUNDS)
    return items.select(F.col("id").alias("work_id"), (F.lit(mu) + F.col("theta")[0]).alias("usual"))


@R.add("m05_implicit")
def _(t: Tables) -> DataFrame:
    return factors.fit_implicit(parts(t)[0], FACTORS, 1.0, 0.1, IMPLICIT_ROUNDS).select(F.col("id").alias("work_id"), "theta")


def _inputs(inp: DataFrame) -> DataFrame:
    return inp.select("user_id", "work_id", links.star_weight(F.col("rating")).alias("x"))


@R.add("m14_layers")
def _(t: Tables) -> DataFrame:
    train, inp, _ = parts(t)
    crowd = links.score(_inputs(inp), links.fit_value(train, 50.0, WIDTH, LINKS)).join(inp, ["user_id", "work_id"], "left_anti")
    mu, items = factors.fit_taste(train, FACTORS, 0.05, TASTE_ROUNDS)
    taste = factors.taste_scores(factors.fold_in_taste(inp, mu, items), mu, items, crowd.select("user_id", "work_id"))
    both = rank.z_scores(crowd.join(taste, ["user_id", "work_id"]), "score", "crowd")
    both = rank.z_scores(both.select("user_id", "work_id", "crowd", F.col("taste").alias("t")), "t", "taste")
    final = rank.cutoff_scores(both, 100, 3.0).select("user_id", "work_id", F.col("final").alias("score"))
    return rank.top_k(final, 20)


@R.add("m12_mix")
def _(t: Tables) -> DataFrame:
    train, inp, _ = parts(t)
    ease = links.score(_inputs(inp), links.fit_read(train, 50.0, WIDTH, LINKS)).join(inp, ["user_id", "work_id"], "left_anti").withColumnRenamed("score", "e")
    items = factors.fit_implicit(train, FACTORS, 1.0, 0.1, IMPLICIT_ROUNDS)
    als = factors.factor_scores(factors.fold_in_implicit(inp, items, negative_weight=0.5), items, ease.select("user_id", "work_id")).withColumnRenamed("score", "a")
    z = rank.z_scores(rank.z_scores(ease.join(als, ["user_id", "work_id"]), "e", "ze"), "a", "za")
    return rank.top_k(z.select("user_id", "work_id", (0.5 * F.col("za") + 0.5 * F.col("ze")).alias("score")), 20)


@R.add("m24_reasons")
def _(t: Tables) -> DataFrame:
    train, inp, _ = parts(t)
    fitted = links.fit_value(train, 50.0, WIDTH, LINKS)
    top = rank.top_k(links.score(_inputs(inp), fitted), 10, inp)
    return explain.reasons(explain.link_parts(_inputs(inp), fitted, top))


@R.add("m25_chance")
def _(t: Tables) -> DataFrame:
    c = rank.personal_percentile(candidates(t))
    w = Window.partitionBy("user_id")
    like = (N.half_up(F.col("rating")) >= 5).cast("int")
    obs = c.withColumn("y", like).withColumn("k_like", F.sum("y").over(w) - F.col("y")).withColumn("n_rated", F.count(F.lit(1)).over(w) - 1).filter("n_rated > 0")
    f = chance.features(obs, 10.0, 0.33)
    coef = chance.fit_logistic(f, ["x1", "x2"], "y")
    return f.select("user_id", "work_id", chance.predict(coef, F.col("x1"), F.col("x2")).alias("chance"))


QUERIES, SQL = R.queries, R.sql
