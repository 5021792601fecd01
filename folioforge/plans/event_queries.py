"""Event windows, snapshots and journals over the event table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.plans.base import Registry, Tables
from folioforge.streaming import events as E

R = Registry()


@R.add("e01_hourly", "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(cast(sum(cast(value as decimal(18,4))) as double), 4) as total from events group by 1, 2")
def _(t: Tables) -> DataFrame:
    return E.hourly_counts(t.events)


@R.add("e02_sessions", """with l as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as before from events),
s as (select *, sum(case when before is null or ts >= before + interval 30 minute then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as k from l)
select user_id, min(ts) as start, count(*) as n from s group by user_id, k""")
def _(t: Tables) -> DataFrame:
    return E.sessions(t.events)


@R.add("w14_place_in_section", "select user_id, event_type, event_id, row_number() over (partition by user_id, event_type order by ts, event_id) as place from events")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return t.events.select("user_id", "event_type", "event_id", F.row_number().over(w).cast("bigint").alias("place"))


@R.add("w15_first_appearance", "select user_id, event_type, arg_min(event_id, (ts, event_id)) as first_event, min(ts) as first_ts from events group by 1, 2")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"), F.min("ts").alias("first_ts"))


@R.add("w18_rank_change", """with d as (select user_id, cast(ts as date) as day, count(*) as n from events group by 1, 2), r as (select *, row_number() over (partition by day order by n desc, user_id) as place from d)
select user_id, day, place, lag(place) over (partition by user_id order by day) is null as is_new, lag(place) over (partition by user_id order by day) - place as gained from r""")
def _(t: Tables) -> DataFrame:
    d = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    r = d.withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("n"), "user_id")).cast("bigint"))
    last = F.lag("place").over(Window.partitionBy("user_id").orderBy("day"))
    return r.select("user_id", "day", "place", last.isNull().alias("is_new"), (last - F.col("place")).alias("gained"))


@R.add("k08_latest_two", "select user_id, day from (select user_id, day, row_number() over (partition by user_id order by day desc) as r from (select distinct user_id, cast(ts as date) as day from events)) where r <= 2")
def _(t: Tables) -> DataFrame:
    d = t.events.select("user_id", F.to_date("ts").alias("day")).distinct()
    return d.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("day")))).filter("r <= 2").select("user_id", "day")


@R.add("m40_journal_shares", "select event_type, count(*) as n, round(count(*) filter (value >= 10) / count(*), 6) as high, round(count(*) filter (value < 2) / count(*), 6) as low from events group by 1")
def _(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    return t.events.groupBy("event_type").agg(n.alias("n"), F.round(F.count_if(F.col("value") >= 10) / n, 6).alias("high"), F.round(F.count_if(F.col("value") < 2) / n, 6).alias("low"))


QUERIES, SQL = R.queries, R.sql
