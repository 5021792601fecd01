"""SQL of the title parsers, stated from their definitions with list functions."""

from __future__ import annotations

from folioforge.functions import text as T


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_EDGE = "' ,;:&-' || chr(9)"


def name_words(title: str) -> str:
    words = rf"list_filter(regexp_split_to_array(replace(strip_accents(lower(regexp_replace({title}, '\s*\([^)]*\)\s*$', ''))), '&', ' & '), '[^\p{{L}}\p{{N}}&]+'), lambda w: w <> '')"
    begins = " or ".join(
        f"(w[i - {back}] in ('and', '&') and i > {back} and w[i - {back} + {gap + 1}] = 'other' and coalesce(w[i - {back} + {gap + 2}], '') in {_in(T.OTHER_PIECES)})" for gap in (0, 1) for back in range(gap + 3)
    )
    kept = f"list_filter(range(1, len(w) + 1), lambda i: not coalesce({begins}, false))"
    return f"(select list_sort(list_distinct(list_filter(list_transform({kept}, lambda i: w[i]), lambda x: x <> '&' and x not in {_in(T.STOP_WORDS)}))) from (select {words} as w))"


def numbered_groups(title: str) -> str:
    inside = f"list_transform(string_split(coalesce({title}, ''), '(')[2:], lambda g: case when contains(g, ')') then split_part(g, ')', 1) end)"
    return f"list_transform(list_filter({inside}, lambda g: g is not null and contains(g, '#')), lambda g: string_split(g, '#'))"


def series_rows(table: str, keys: str, title: str) -> str:
    """Query of (keys, series): distinct names of the series of each row of the table."""
    return rf"""select distinct {keys}, series from (
  select {keys}, trim(array_to_string(w[list_position(list_transform(w, lambda x: trim(x, {_EDGE}) not in ('', 'and', 'part')), true):], ' '), {_EDGE}) as series from (
    select {keys}, string_split(lower(trim(case when i > 1 then regexp_replace(g[i], '^[\d.\s–-]+', '') else g[i] end, {_EDGE})), ' ') as w from (
      select {keys}, g, unnest(range(1, len(g))) as i from (select {keys}, unnest({numbered_groups(title)}) as g from {table})))
  where list_contains(list_transform(w, lambda x: trim(x, {_EDGE}) not in ('', 'and', 'part')), true))
where regexp_matches(series, '\p{{L}}')"""


def later_volume(title: str) -> str:
    t = f"rtrim(coalesce({title}, ''))"
    tail = "string_split(t, '(')[-1]"
    parts = f"case when contains(t, '(') and strpos({tail}, ')') = length({tail}) then string_split(split_part({tail}, ')', 1), '#')[2:] else [] end"
    digits = "list_transform(w, lambda x: regexp_extract(x, '^(" + "|".join(T.VOLUME_WORDS) + ")([0-9]+)$', 2))"
    return rf"""(select (len(n) > 0 and list_min(n) >= 2) or len(list_filter(range(2, len(w) + 1), lambda i:
    coalesce(case when w[i] in {_in(T.VOLUME_WORDS)} then case when regexp_full_match(coalesce(w[i + 1], ''), '[0-9]+') then cast(w[i + 1] as double) >= 2 else coalesce(w[i + 1], '') in {_in(T.LATER_NUMBERS)} end
                  when d[i] <> '' then cast(d[i] as double) >= 2 end, false))) > 0
  from (select w, {digits} as d, list_filter(list_transform(parts, lambda p: try_cast(regexp_extract(p, '^\s*(\d+(\.\d+)?)', 1) as double)), lambda x: x is not null) as n
    from (select {parts} as parts, regexp_split_to_array(lower(t), '[^\p{{L}}\p{{N}}]+') as w from (select {t} as t))))"""
