"""Column expressions over titles, names and codes. All run in the JVM; none is a Python UDF."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The five basic entities of HTML.
ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
#: Words that carry no meaning in a title, in five languages, and marks of an edition.
STOP_WORDS = (
    "the a an and or of in on at to for with from by s de la el los las del y e le les du des et un une l d "
    "der die das den dem und ein eine einer il lo gli di complete collected selected essential illustrated annotated unabridged edition"
).split()


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def to_whole(c: Column) -> Column:
    """Text to a whole number, fractions rounded half up; null where it is no number."""
    return F.round(blank_to_null(c).try_cast("double")).cast("bigint")


def without_tail_paren(title: Column) -> Column:
    return F.regexp_replace(title, r"\s*\([^)]*\)\s*\z", "")


def title_key(title: Column) -> Column:
    """Letters and digits of any script in lower case, single blanks between, last parenthesis dropped."""
    return F.trim(F.regexp_replace(F.lower(without_tail_paren(title)), r"[^\p{L}\p{N}]+", " "))


def short_key(title: Column) -> Column:
    """``title_key`` of what stands before the first colon or bracket."""
    return title_key(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s*[:(\[].*\z", ""))


def author_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}]+", "")


def series_number(title: Column) -> Column:
    """Text of the number in a last ``... #n)``; empty where there is none."""
    return F.regexp_extract(F.coalesce(title, F.lit("")), r"#\s*(\d+(?:\.\d+)?)\s*\)\s*\z", 1)


def matches_any(text: Column, patterns: Sequence[str]) -> Column:
    """Whether the lower-cased text matches one of the patterns; false for null, and for no pattern at all."""
    if not patterns:
        return F.lit(False)
    return F.coalesce(F.lower(text).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def unescape(text: Column) -> Column:
    """The five basic HTML entities as characters; the ampersand last, so nothing is unescaped twice."""
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def category_of(path: Column) -> Column:
    """The category below the shop's top level in a ``|``-separated path."""
    return F.when(path.like("Kindle%"), F.split_part(path, F.lit("|"), F.lit(3))).otherwise(F.split_part(path, F.lit("|"), F.lit(2)))


def _bare_letters() -> tuple[str, str]:
    """Lower-case letters that Unicode takes apart into one base letter and marks, and their bases."""
    marked, bare = [], []
    for code in range(0xC0, 0x2000):
        c = chr(code)
        base = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]
        if len(base) == 1 and base[0] != c == c.lower() and c.isalpha():
            marked.append(c)
            bare.append(base[0])
    return "".join(marked), "".join(bare)


_MARKED, _BARE = _bare_letters()


def without_marks(text: Column) -> Column:
    """Lower-case letters without accents and other marks, whether written as one character or as several."""
    return F.regexp_replace(F.translate(text, _MARKED, _BARE), r"\p{Mn}+", "")


#: What a book is said to hold besides its title piece ("and other stories").
OTHER_PIECES = "stories tales poems writings works plays essays".split()


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value formed once a row: each mention of a column repeats its whole expression, in the
    plan as well as in the work."""
    return F.get(F.transform(F.array(value), use), 0)


def name_words(title: Column) -> Column:
    """Distinct meaningful words of a title without accents, sorted. ``and other stories`` (one word may stand between
    ``and`` and ``other``) says nothing of the book and goes."""
    spaced = F.replace(without_marks(F.lower(without_tail_paren(title))), F.lit("&"), F.lit(" & "))
    return _bound(F.filter(F.split(spaced, r"[^\p{L}\p{N}&]+"), lambda w: w != ""), _kept_words)


def _kept_words(words: Column) -> Column:
    def at(i: Column) -> Column:
        return F.coalesce(F.get(words, i), F.lit(""))

    def begins(i: Column, gap: int) -> Column:
        """Whether a joining word stands at i and ``other <pieces>`` after it and ``gap`` words."""
        return at(i).isin("and", "&") & (at(i + gap + 1) == "other") & at(i + gap + 2).isin(OTHER_PIECES)

    def covered(i: Column) -> Column:
        out = F.lit(False)
        for gap in (0, 1):
            for back in range(gap + 3):
                out = out | begins(i - back, gap)
        return out

    kept = F.filter(words, lambda w, i: ~covered(i) & (w != "&") & ~w.isin(STOP_WORDS))
    return F.array_sort(F.array_distinct(kept))


def _numbered_groups(title: Column) -> Column:
    """The innermost parentheses of a title that hold number signs, each cut at them."""
    pieces = F.split(F.coalesce(title, F.lit("")), r"\(")
    inside = F.transform(pieces, lambda g, i: F.when((i > 0) & F.contains(g, F.lit(")")), F.substring_index(g, ")", 1)))
    return F.transform(F.filter(inside, lambda g: F.contains(g, F.lit("#"))), lambda g: F.split(g, "#"))


_EDGE = " ,;:&-\t"


def series_names(title: Column) -> Column:
    """Names of the series in parentheses that hold a ``#n``: the text before each number, in lower case.

    ``(Dark-Hunter #10, Dream-Hunter #1)`` gives both. A number without a name of its own continues the series before
    it and adds none; leading ``and`` and ``part`` are no part of a name, and what follows the last number names
    nothing.
    """
    heads = F.transform(
        _numbered_groups(title), lambda g: F.transform(F.slice(g, 1, F.size(g) - 1), lambda p, i: F.when(i > 0, F.regexp_replace(p, r"^[\d.\s–-]+", "")).otherwise(p))
    )

    def name(part: Column) -> Column:
        words = F.split(F.lower(F.btrim(part, F.lit(_EDGE))), " ")
        told = F.transform(words, lambda w: ~F.btrim(w, F.lit(_EDGE)).isin("", "and", "part"))
        first = F.array_position(told, True)
        return F.when(first > 0, F.btrim(F.array_join(F.slice(words, F.greatest(first, F.lit(1)).cast("int"), F.size(words)), " "), F.lit(_EDGE))).otherwise("")

    return F.array_distinct(F.filter(F.transform(F.flatten(heads), name), lambda n: n.rlike(r"\p{L}")))


#: Words before a volume's number, and numbers from the second on in words and Roman figures.
VOLUME_WORDS = "vol volume part book".split()
LATER_NUMBERS = "two three four five six seven eight nine ten ii iii iv v vi vii viii ix x".split()


def is_later_volume(title: Column) -> Column:
    """Whether a title names a volume from the second on: all numbers of the parenthesis at its end are 2 or more, or
    one of ``VOLUME_WORDS`` that is not the title's first word comes before such a number."""
    t = F.rtrim(F.coalesce(title, F.lit("")))
    tail = F.substring_index(t, "(", -1)
    closed = F.contains(t, F.lit("(")) & (F.instr(tail, ")") == F.length(tail))
    last = F.when(closed, F.split(F.substring_index(tail, ")", 1), "#"))
    numbers = F.transform(F.slice(last, 2, 1000), lambda p: F.regexp_extract(p, r"^\s*(\d+(?:\.\d+)?)", 1).try_cast("double"))
    numbers = F.filter(numbers, lambda n: n.isNotNull())
    by_sign = _bound(numbers, lambda n: F.coalesce((F.size(n) > 0) & (F.array_min(n) >= 2), F.lit(False)))

    def numbered(words: Column) -> Column:
        def number_at(w: Column, i: Column) -> Column:
            joined = F.regexp_extract(w, rf"^(?:{'|'.join(VOLUME_WORDS)})(\d+)$", 1)
            return F.when((i > 0) & w.isin(VOLUME_WORDS), F.get(words, i + 1)).when((i > 0) & (joined != ""), joined)

        return F.transform(words, number_at)

    later = F.exists(_bound(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), numbered), lambda n: F.coalesce(F.when(n.rlike(r"^\d+$"), n.try_cast("double") >= 2).otherwise(n.isin(LATER_NUMBERS)), F.lit(False)))
    return by_sign | later


def least_year(text: Column, last: int) -> Column:
    """Least plausible year (1900 to ``last``) written in a text."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"((?:19|20)\d{2})"), F.lit(1)), lambda y: y.cast("int"))
    return F.array_min(F.filter(found, lambda y: (y >= 1900) & (y <= last)))


def isbn_digits(code: Column) -> Column:
    """Digits and X of a code in upper case; empty for null."""
    return F.regexp_replace(F.upper(F.coalesce(code, F.lit(""))), "[^0-9X]", "")


def _weighted(digits: Column, n: int) -> Column:
    places = F.sequence(F.lit(1), F.lit(n))
    return F.aggregate(places, F.lit(0), lambda s, i: s + F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 1).otherwise(3))


def isbn10_to_13(ten: Column) -> Column:
    """13 digits for ten (the check digit worked out anew); null for anything else."""
    return F.get(
        F.transform(
            F.filter(F.array(ten), lambda t: t.rlike(r"^\d{9}[\dX]$")),
            lambda t: F.concat(F.lit("978"), F.substring(t, 1, 9), F.pmod(-_weighted(F.concat(F.lit("978"), F.substring(t, 1, 9)), 12), F.lit(10)).cast("string")),
        ),
        F.lit(0),
    )


def is_isbn13(code: Column) -> Column:
    """Thirteen digits that start with 978 or 979 and whose check digit is right."""
    return F.coalesce(code.rlike(r"^97[89]\d{10}$") & (F.pmod(_weighted(F.when(code.rlike(r"^\d{13}$"), code), 13), F.lit(10)) == 0), F.lit(False))


def trigrams(word: Column) -> Column:
    """Distinct three-character pieces of a word padded with two blanks before and one after."""
    padded = F.concat(F.lit("  "), F.lower(word), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two words, 0 to 1."""
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def word_similarity(query: Column, text: Column) -> Column:
    """Best trigram similarity of the query to a word of the text."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
    return F.coalesce(F.array_max(F.transform(words, lambda w: trigram_similarity(query, w))), F.lit(0.0))


def display_title(local: Column, original: Column) -> Column:
    """``local / original`` where both exist and differ, else whichever exists."""
    return F.when(local.isNotNull() & original.isNotNull() & (local != original), F.concat_ws(" / ", local, original)).otherwise(F.coalesce(local, original))


def compare_key(text: Column) -> Column:
    """Words and digits before the first colon or bracket, without case, accents, signs and a leading English article."""
    head = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*[:(\[].*\z", "")
    words = F.filter(F.split(without_marks(F.lower(head)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_join(F.filter(words, lambda w, i: (i > 0) | ~w.isin("the", "a", "an") | (F.size(words) == 1)), " ")


def surname(name: Column) -> Column:
    return F.substring_index(compare_key(name), " ", -1)


#: Russian letters in Latin, for comparing names.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia",
}


def latin(text: Column) -> Column:
    """Russian letters of a lower-cased text in Latin; single ones in one pass, the others by replacement."""
    single = {c: v for c, v in LATIN.items() if len(v) == 1}
    gone = "".join(c for c, v in LATIN.items() if not v)
    out = F.translate(F.lower(text), "".join(single) + gone, "".join(single.values()))
    for c, v in LATIN.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(c), F.lit(v))
    return out
