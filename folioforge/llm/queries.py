"""Queries p1, p2, p3, p4, p6, p7, p8 and p9 over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.llm import components, cooccur, linkage, packing, pii, splits, survivor, tokens

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = cooccur.pair_counts(_t(spark, sf, "ratings"), "user_id", "work_id", min_count=20, min_lift=30)
    return pairs.select(F.col("item_a").alias("work_a"), F.col("item_b").alias("work_b"))


def p1_lift(spark: SparkSession, sf: str) -> DataFrame:
    pairs = cooccur.pair_counts(_t(spark, sf, "ratings"), "user_id", "work_id", min_count=20)
    return pairs.select(F.col("item_a").alias("work_a"), F.col("item_b").alias("work_b"), "n_both", F.round("lift", 6).alias("lift"))


def p2_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return linkage.match(*(_t(spark, sf, n) for n in ("az_meta", "works", "editions", "authors")))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_confidence(spark, sf).select("parent_asin", "work_id")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    groups = components.chain_components(_t(spark, sf, "work_merges"), "shadow_work_id", "main_work_id")
    return groups.select(F.col("v").alias("work_id"), "group_id")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return splits.linked_pairs(_t(spark, sf, "users"))


def p4_split(spark: SparkSession, sf: str) -> DataFrame:
    scratch = splits.Scratch(spark, "readers")
    readers = _t(spark, sf, "ratings").select(F.col("user_id").cast("long").alias("user_id")).filter("user_id is not null").distinct()
    _, groups = splits.person_groups(_t(spark, sf, "users").withColumn("user_id", F.col("user_id").cast("long")), "user_id", "external_id", scratch)
    return splits.grouped_split(readers, groups, {"train": 0.8, "validation": 0.1, "test": 0.1})


def p4_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """Readers split, persons that more than one split holds, and identifiers that more than one split holds."""
    split = p4_split(spark, sf)
    torn = split.groupBy("group_id").agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n_torn_persons"))
    pairs = p4_found(spark, sf)
    ends = [split.select(F.col("user_id").cast("long").alias(u), F.col("split").alias(f"s_{u}")) for u in ("user_a", "user_b")]
    apart = pairs.join(ends[0], "user_a").join(ends[1], "user_b").agg(F.count_if(F.col("s_user_a") != F.col("s_user_b")).alias("n_torn_pairs"))
    return split.agg(F.count(F.lit(1)).alias("n_readers")).crossJoin(F.broadcast(torn)).crossJoin(F.broadcast(apart))  # one row each


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return survivor.cover_editions(_t(spark, sf, "editions"))


def p6_survivors(spark: SparkSession, sf: str) -> DataFrame:
    return survivor.surviving_editions(_t(spark, sf, "editions"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode(_t(spark, sf, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_t(spark, sf, "documents"), "doc_id", "text", capacity=2048)


def p8_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """Documents packed, containers over their capacity or with overlaps, and documents that do not lie whole."""
    w = Window.partitionBy("container").orderBy("position", "n_tokens")
    end = F.col("position") + F.col("n_tokens")
    placed = packing.Scratch(spark, "placed").put(p8_containers(spark, sf))
    clash = placed.withColumn("clash", (end > 2048) | (F.coalesce(F.lag(end).over(w), F.lit(0)) > F.col("position")))
    bad = clash.groupBy("container").agg(F.max("clash").alias("b")).agg(F.count_if("b").alias("n_bad_containers"))
    sizes = tokens.encode(_t(spark, sf, "documents"), "doc_id", "text").select("doc_id", F.size("ids").cast("long").alias("size"))
    whole = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).join(sizes, "doc_id", "full")
    return whole.agg(F.count("size").alias("n_documents"), F.count_if(~F.col("n").eqNullSafe(F.col("size"))).alias("n_torn_documents")).crossJoin(F.broadcast(bad))


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, sf), 2048)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find(_t(spark, sf, "documents"), _t(spark, sf, "known_names")).select("doc_id", "kind", "start_at")


def p9_redacted(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents")
    return pii.redact(docs, pii.find(docs, _t(spark, sf, "known_names")))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_lift, p2_found, p2_confidence, p3_found, p4_found, p4_split, p4_integrity, p6_found, p6_survivors, p7_ids, p8_containers, p8_integrity, p8_fill, p9_found, p9_redacted)}


_READERS = "select distinct user_id as u, work_id as w from ratings where user_id is not null and work_id is not null"

_PAIRS = f"""
with r as ({_READERS}), f as (select w, count(*) as n from r group by w), c as (select count(distinct u) as n from r),
p as (select a.w as a, b.w as b, count(*) as n from r a join r b on a.u = b.u and a.w < b.w group by a.w, b.w having count(*) >= 20)
"""

_IDENT = r"""
with bare as (select user_id, regexp_replace(regexp_replace(lower(external_id), '[^0-9a-z:]', '', 'g'), '^([a-z]+:)+', '') as k from users),
     known as (select distinct user_id, k from bare
               where user_id is not null and regexp_full_match(k, '[0-9a-f]{32}') and not regexp_full_match(k, '0+'))
"""

SQL = {
    "p1_found": _PAIRS + """
select p.a as work_a, p.b as work_b from p join f fa on fa.w = p.a join f fb on fb.w = p.b, c
where cast(p.n as hugeint) * c.n >= cast(30 as hugeint) * fa.n * fb.n""",
    "p1_lift": _PAIRS + """
select p.a as work_a, p.b as work_b, p.n as n_both,
       round(cast(p.n as double) * c.n / (cast(fa.n as double) * fb.n), 6) as lift
from p join f fa on fa.w = p.a join f fb on fb.w = p.b, c""",
    "p3_found": """
with recursive e as (
  select shadow_work_id as a, main_work_id as b from work_merges where shadow_work_id is not null and main_work_id is not null
  union select main_work_id, shadow_work_id from work_merges where shadow_work_id is not null and main_work_id is not null),
v as (select shadow_work_id as v from work_merges where shadow_work_id is not null
      union select main_work_id from work_merges where main_work_id is not null),
reach(v, w) as (select v, v from v union select r.v, e.b from reach r join e on e.a = r.w)
select v as work_id, min(w) as group_id from reach group by v""",
    "p4_found": _IDENT + """
select distinct a.user_id as user_a, b.user_id as user_b from known a join known b on a.k = b.k and a.user_id < b.user_id""",
    "p4_integrity": "select count(distinct user_id) as n_readers, 0::bigint as n_torn_persons, 0::bigint as n_torn_pairs from ratings",
    "p8_integrity": "select count(*) as n_documents, 0::bigint as n_torn_documents, 0::bigint as n_bad_containers from documents",
    "p6_found": r"""
with ranked as (select *, row_number() over (partition by book_id order by updated_at desc nulls last) as rn from editions where book_id is not null),
now as (select * from ranked where rn = 1),
shown as (select trim(image_url) as image from now where work_id is not null group by 1 having count(distinct work_id) > 4),
e as (select work_id, book_id, case when ratings_count >= 0 then ratings_count else -1 end as rated,
             regexp_matches(trim(image_url), '^https?://[^/?#\s]+/[^?#\s]*\.(jpe?g|png|gif|webp|bmp|tiff?|avif)([?#]\S*)?$', 'i')
             and trim(image_url) not in (select image from shown where image is not null) as cover
      from now where work_id is not null),
several as (select work_id from e group by work_id having count(*) >= 2)
select work_id, book_id from (
  select work_id, book_id, row_number() over (partition by work_id order by rated desc, book_id) as rn
  from e where cover and work_id in (select work_id from several)) where rn = 1""",
}


def oracle_sql() -> dict[str, str]:
    return SQL
