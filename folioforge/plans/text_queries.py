"""String, code and null functions over the catalogue tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import numeric as N
from folioforge.functions import text as T
from folioforge.plans import title_sql as S
from folioforge.plans.base import Registry, Tables
from folioforge.plans.clean_queries import KEY, SERIES_NO

R = Registry()


@R.add("p01_blank_to_null", "select work_id, nullif(trim(title), '') as title, nullif(trim(media_type), '') as media_type, nullif(trim(language_code), '') as language_code from works")
def _(t: Tables) -> DataFrame:
    return t.works.select("work_id", *[T.blank_to_null(F.col(c)).alias(c) for c in ("title", "media_type", "language_code")])


@R.add("p02_to_whole", "select parent_asin, isbn13, cast(round(try_cast(nullif(trim(isbn13), '') as double)) as bigint) as code, cast(round(try_cast(nullif(trim(isbn10), '') as double)) as bigint) as ten from az_meta")
def _(t: Tables) -> DataFrame:
    return t.az_meta.select("parent_asin", "isbn13", T.to_whole(F.col("isbn13")).alias("code"), T.to_whole(F.col("isbn10")).alias("ten"))


@R.add("p03_valid_rows", "select count(*) as n_rows, count(*) filter (user_id is not null and work_id is not null and rating between 0 and 5) as n_valid from ratings")
def _(t: Tables) -> DataFrame:
    ok = F.col("user_id").isNotNull() & F.col("work_id").isNotNull() & F.col("rating").between(0, 5)
    return t.ratings.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(ok).alias("n_valid"))


@R.add("p11_like_escape", r"select book_id, title from editions where title like '%100\%%' escape '\' or title ilike 'the %ferry%' or title not like '% %'")
def _(t: Tables) -> DataFrame:
    return t.editions.filter(F.expr(r"title like '%100!%%' escape '!'") | F.col("title").ilike("the %ferry%") | ~F.col("title").like("% %")).select("book_id", "title")


@R.add("p12_distinct_from", "select work_id, title is distinct from original_title as changed, title is not distinct from best_edition_title as same_best from works")
def _(t: Tables) -> DataFrame:
    return t.works.select("work_id", (~F.col("title").eqNullSafe(F.col("original_title"))).alias("changed"), F.col("title").eqNullSafe(F.col("best_edition_title")).alias("same_best"))


_SUM13 = " + ".join(f"cast(substr(c, {i}, 1) as int) * {1 if i % 2 else 3}" for i in range(1, 14))
_SUM12 = " + ".join(f"cast(substr(b, {i}, 1) as int) * {1 if i % 2 else 3}" for i in range(1, 13))


@R.add("p13_isbn_valid", f"""with c as (select book_id, updated_at, regexp_replace(upper(coalesce(isbn13, '')), '[^0-9X]', '', 'g') as c from editions)
select book_id, updated_at, c as code, case when regexp_full_match(c, '97[89][0-9]{{10}}') then (({_SUM13}) % 10) = 0 else false end as is_valid from c""")
def _(t: Tables) -> DataFrame:
    code = T.isbn_digits(F.col("isbn13"))
    return t.editions.select("book_id", "updated_at", code.alias("code"), T.is_isbn13(code).alias("is_valid"))


@R.add("f13_isbn10_to_13", f"""with c as (select book_id, updated_at, regexp_replace(upper(coalesce(isbn, '')), '[^0-9X]', '', 'g') as ten from editions),
b as (select *, '978' || substr(ten, 1, 9) as b from c)
select book_id, updated_at, case when regexp_full_match(ten, '[0-9]{{9}}[0-9X]') then b || cast((10 - ({_SUM12}) % 10) % 10 as varchar) end as code from b""")
def _(t: Tables) -> DataFrame:
    return t.editions.select("book_id", "updated_at", T.isbn10_to_13(T.isbn_digits(F.col("isbn"))).alias("code"))


@R.add("p14_reader_status", """select user_id, work_id, rated_at, loaded_at, case when rating is null then 'want' when rating = 0 then 'unrated' when rating < 0 or rating > 5 then 'rejected'
when rating <> floor(rating) then 'half' else 'rated' end as status from ratings""")
def _(t: Tables) -> DataFrame:
    r = F.col("rating")
    status = F.when(r.isNull(), "want").when(r == 0, "unrated").when((r < 0) | (r > 5), "rejected").when(r != F.floor(r), "half").otherwise("rated")
    return t.ratings.select("user_id", "work_id", "rated_at", "loaded_at", status.alias("status"))


@R.add("p15_skip_reasons", """select reason, count(*) as n_rows from (select case when r.work_id is null then 'no id' when w.work_id is null then 'not in catalogue'
when w.gr_ratings_count is null or w.gr_ratings_count < 20 then 'not in core' end as reason from ratings r left join works w on w.work_id = r.work_id) group by 1""")
def _(t: Tables) -> DataFrame:
    w = t.works.select(F.col("work_id").alias("w_id"), "gr_ratings_count")
    reason = F.when(F.col("work_id").isNull(), "no id").when(F.col("w_id").isNull(), "not in catalogue").when(F.coalesce("gr_ratings_count", F.lit(0)) < 20, "not in core")
    return t.ratings.join(w, F.col("work_id") == F.col("w_id"), "left").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


@R.add("p16_later_volume", f"select work_id, {S.later_volume('best_edition_title')} as is_later from works")
def _(t: Tables) -> DataFrame:
    return t.works.select("work_id", T.is_later_volume(F.col("best_edition_title")).alias("is_later"))


@R.add("f01_string_basics", "select author_id, lower(trim(name)) as lowered, length(name) as n, replace(name, ' ', '_') as joined, split_part(trim(name), ' ', 1) as head, len(string_split(trim(name), ' ')) as n_parts, trim(name) || '!' as marked from authors")
def _(t: Tables) -> DataFrame:
    name = F.col("name")
    return t.authors.select(
        "author_id", F.lower(F.trim(name)).alias("lowered"), F.length(name).cast("bigint").alias("n"), F.replace(name, F.lit(" "), F.lit("_")).alias("joined"),
        F.split_part(F.trim(name), F.lit(" "), F.lit(1)).alias("head"), F.size(F.split(F.trim(name), " ")).cast("bigint").alias("n_parts"), F.concat(F.trim(name), F.lit("!")).alias("marked"),
    )


@R.add("f02_title_key", f"select book_id, updated_at, {KEY.format(c='title')} as key from editions")
def _(t: Tables) -> DataFrame:
    return t.editions.select("book_id", "updated_at", T.title_key(F.col("title")).alias("key"))


@R.add("f03_series_number", f"select book_id, updated_at, {SERIES_NO.format(c='title')} as no from editions")
def _(t: Tables) -> DataFrame:
    return t.editions.select("book_id", "updated_at", T.series_number(F.col("title")).alias("no"))


@R.add("f04_author_key", r"select author_id, regexp_replace(lower(coalesce(name, '')), '[^\p{L}]+', '', 'g') as key from authors")
def _(t: Tables) -> DataFrame:
    return t.authors.select("author_id", T.author_key(F.col("name")).alias("key"))


@R.add("f05_short_key", "select parent_asin, title, " + KEY.format(c=r"regexp_replace(coalesce(title, ''), '\s*[:(\[].*$', '')") + " as key from az_meta")
def _(t: Tables) -> DataFrame:
    return t.az_meta.select("parent_asin", "title", T.short_key(F.col("title")).alias("key"))


@R.add("f06_unescape", """select parent_asin, replace(replace(replace(replace(replace(title, '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as title from az_meta""")
def _(t: Tables) -> DataFrame:
    return t.az_meta.select("parent_asin", T.unescape(F.col("title")).alias("title"))


@R.add("f07_category", "select parent_asin, categories, case when categories like 'Kindle%' then split_part(categories, '|', 3) else split_part(categories, '|', 2) end as category from az_meta")
def _(t: Tables) -> DataFrame:
    return t.az_meta.select("parent_asin", "categories", T.category_of(F.col("categories")).alias("category"))


@R.add("f08_name_words", f"select work_id, {S.name_words('title')} as words from works where title is not null")
def _(t: Tables) -> DataFrame:
    return t.works.filter("title is not null").select("work_id", T.name_words(F.col("title")).alias("words"))


@R.add("f09_series_names", S.series_rows("editions", "book_id, updated_at, title", "title"))
def _(t: Tables) -> DataFrame:
    return t.editions.select("book_id", "updated_at", "title", F.explode(T.series_names(F.col("title"))).alias("series")).distinct()


_TRIGRAMS = "list_distinct(list_transform(range(1, length({w}) + 2), lambda i: substr('  ' || {w} || ' ', i, 3)))"


@R.add("f12_word_search", rf"""with q as (select {_TRIGRAMS.format(w="'merchant'")} as q),
w as (select work_id, title, unnest(list_filter(regexp_split_to_array(lower(title), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) as word from works where title is not null)
select work_id, title, max(round(len(list_intersect(q, t)) / len(list_distinct(list_concat(q, t))), 6)) as score from (select work_id, title, {_TRIGRAMS.format(w="word")} as t from w), q group by 1, 2 having score >= 0.5""")
def _(t: Tables) -> DataFrame:
    return t.works.select("work_id", "title", F.round(T.word_similarity(F.lit("merchant"), F.col("title")), 6).alias("score")).filter("score >= 0.5")


@R.add("f14_large_cover", "select book_id, updated_at, regexp_replace(image_url, '([0-9]+)[sm]\\.jpg$', '\\1l.jpg') as image_url from editions where image_url is not null")
def _(t: Tables) -> DataFrame:
    return t.editions.filter("image_url is not null").select("book_id", "updated_at", F.regexp_replace("image_url", r"([0-9]+)[sm]\.jpg\z", "$1l.jpg").alias("image_url"))


@R.add("f15_least_year", "select parent_asin, publisher_raw, list_min(list_filter(list_transform(regexp_extract_all(coalesce(publisher_raw, ''), '((19|20)\\d{2})', 1), lambda y: cast(y as int)), lambda y: y between 1900 and 2026)) as year from az_meta")
def _(t: Tables) -> DataFrame:
    return t.az_meta.select("parent_asin", "publisher_raw", T.least_year(F.col("publisher_raw"), 2026).alias("year"))


@R.add("f16_dates", "select work_id, user_id, rated_at, loaded_at, cast(rated_at as date) as day, try_cast(strftime(rated_at, '%Y') as int) as year, date_diff('day', cast(rated_at as date), cast(loaded_at as date)) as lag_days from ratings")
def _(t: Tables) -> DataFrame:
    return t.ratings.select(
        "work_id", "user_id", "rated_at", "loaded_at", F.to_date("rated_at").alias("day"), F.year("rated_at").alias("year"), F.date_diff(F.to_date("loaded_at"), F.to_date("rated_at")).cast("bigint").alias("lag_days")
    )


@R.add("f17_math", "select work_id, user_id, rated_at, loaded_at, ceil(rating) as up, floor(rating + 0.5) as half_up, round(cast(rating as double) / 3, 6) as third, greatest(least(rating, 5), 1) as clipped from ratings")
def _(t: Tables) -> DataFrame:
    r = F.col("rating")
    return t.ratings.select(
        "work_id", "user_id", "rated_at", "loaded_at", F.ceil(r).cast("float").alias("up"), N.half_up(r).cast("float").alias("half_up"), F.round(r.cast("double") / 3, 6).alias("third"),
        F.greatest(F.least(r, F.lit(5).cast("float")), F.lit(1).cast("float")).alias("clipped"),
    )


@R.add("f18_logs", "select work_id, round(ln(1 + greatest(coalesce(gr_ratings_count, 0), 0)), 9) as log1p, round(log10(10 + greatest(coalesce(gr_ratings_count, 0), 0)), 9) as log10, round(1 / log2(2 + greatest(coalesce(gr_ratings_count, 0), 0)), 9) as discount, round(sqrt(greatest(coalesce(gr_ratings_count, 0), 0)), 9) as root from works")
def _(t: Tables) -> DataFrame:
    n = F.greatest(F.coalesce("gr_ratings_count", F.lit(0)), F.lit(0))
    return t.works.select("work_id", F.round(F.log1p(n), 9).alias("log1p"), F.round(F.log10(10 + n), 9).alias("log10"), F.round(1 / F.log2(2 + n), 9).alias("discount"), F.round(F.sqrt(n), 9).alias("root"))


@R.add("f19_arrays", "select book_id, updated_at, unnest(author_ids) as author_id, generate_subscripts(author_ids, 1) as place, len(author_ids) as n, array_to_string(author_ids[1:2], ',') as lead from editions")
def _(t: Tables) -> DataFrame:
    lead = F.array_join(F.slice("author_ids", 1, 2).cast("array<string>"), ",")
    return t.editions.select("book_id", "updated_at", F.posexplode("author_ids").alias("p", "author_id"), F.size("author_ids").cast("bigint").alias("n"), lead.alias("lead")).select(
        "book_id", "updated_at", "author_id", (F.col("p") + 1).cast("bigint").alias("place"), "n", "lead"
    )


@R.add("f20_list_contains", "select count(*) filter (list_contains(author_ids, 1)) as n_one, count(*) filter (list_contains(string_split(coalesce(publisher, ''), ' '), 'Press')) as n_press from editions")
def _(t: Tables) -> DataFrame:
    press = F.array_contains(F.split(F.coalesce("publisher", F.lit("")), " "), "Press")
    return t.editions.agg(F.count_if(F.array_contains("author_ids", F.lit(1).cast("long"))).alias("n_one"), F.count_if(press).alias("n_press"))


@R.add("f21_structs", "select work_id, s.y as year, s.l as language_code from (select work_id, struct_pack(y := publication_year, l := language_code) as s from works)")
def _(t: Tables) -> DataFrame:
    s = t.works.select("work_id", F.struct(F.col("publication_year").alias("y"), F.col("language_code").alias("l")).alias("s"))
    return s.select("work_id", F.col("s.y").alias("year"), F.col("s.l").alias("language_code"))


@R.add("f23_json", "select event_id, cast(json_extract_string(props, '$.k') as int) as k from events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k int").k.alias("k"))


@R.add("f22_maps", "select cast(json_extract_string(props, '$.k') as int) as k, count(*) as n_events from events group by 1")
def _(t: Tables) -> DataFrame:
    m = t.events.select(F.explode(F.map_entries(F.from_json("props", "map<string,int>"))).alias("e"))
    return m.filter("e.key = 'k'").groupBy(F.col("e.value").alias("k")).agg(F.count(F.lit(1)).alias("n_events"))


@R.add("f24_draw", "select distinct user_id, round(cast(('0x' || substr(md5('7:' || cast(user_id as varchar)), 1, 13)) as bigint) / 4503599627370496.0, 12) as draw from users where user_id is not null")
def _(t: Tables) -> DataFrame:
    return t.users.filter("user_id is not null").select("user_id", F.round(N.draw(F.col("user_id"), 7), 12).alias("draw")).distinct()


@R.add("f25_nulls", "select work_id, coalesce(original_title, title, '?') as name, nullif(language_code, '') as lang, media_type is null as no_type from works")
def _(t: Tables) -> DataFrame:
    return t.works.select("work_id", F.coalesce("original_title", "title", F.lit("?")).alias("name"), F.nullif(F.col("language_code"), F.lit("")).alias("lang"), F.col("media_type").isNull().alias("no_type"))


@R.add("f26_display", "select work_id, case when title is not null and original_title is not null and title <> original_title then title || ' / ' || original_title else coalesce(title, original_title) end as shown from works")
def _(t: Tables) -> DataFrame:
    return t.works.select("work_id", T.display_title(F.col("title"), F.col("original_title")).alias("shown"))


QUERIES, SQL = R.queries, R.sql
