"""p5: per-key results although a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioforge.operators import skew


def _ratings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/ratings.parquet")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return skew.heavy_keys(_ratings(spark, sf), ["user_id", "work_id"], 0.01).select("field_name", "key_id")


def p5_per_work(spark: SparkSession, sf: str) -> DataFrame:
    return skew.per_key_results(_ratings(spark, sf), "work_id", "user_id", "rating")


def p5_per_reader(spark: SparkSession, sf: str) -> DataFrame:
    return skew.per_key_results(_ratings(spark, sf), "user_id", "work_id", "rating")


QUERIES = {f.__name__: f for f in (p5_found, p5_per_work, p5_per_reader)}

SQL = {
    "p5_found": """
with k as (select 'user_id' as field_name, cast(user_id as bigint) as key_id from ratings
           union all select 'work_id', work_id from ratings)
select field_name, key_id from k where key_id is not null group by field_name, key_id
having count(*) * 100 >= (select count(*) from ratings)""",
}
for _key, _partner, _name in (("work_id", "user_id", "p5_per_work"), ("user_id", "work_id", "p5_per_reader")):
    SQL[_name] = f"""
select cast({_key} as bigint) as key_id, count(*) as n_rows, count(distinct {_partner}) as n_partners,
       round(avg(case when not isnan(rating) then cast(rating as double) end), 6) as mean_value
from ratings where {_key} is not null group by {_key}"""
