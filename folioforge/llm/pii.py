"""Personal information inside free text: bootstrapped contextual extraction.

One pass over the texts takes candidates with the words around them: emails and addresses by form, number-like runs
with their shape, pairs of capitalised words. Seeds (forms that suggest a kind, names of the known list) induce lexical
patterns, the contexts they stand in. Spark scores the graph of patterns and instances in rounds, always against all
occurrences and by a lower confidence bound, so that more text never makes a weak pattern strong: a context is trusted
by its share of seeds; a shape or a name part is learned from trusted contexts, judged by what they say without it, and
contexts can turn over what a form suggests. Rounds end when no shape and no name part is new.
"""

from __future__ import annotations

import bisect
import re as plain_re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex as re
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.session import Scratch, small_or_plain

#: Known names at most; a list above is refused.
KNOWN_LIMIT = 100_000

MASK = "\x01"
GAP = r"(?:[ \t\u00a0\u202f]+|[ \t\u00a0]*(?:\r\n|\n|\r)[ \t\u00a0]*)"  # blanks or one line break
AT = rf"(?:{GAP}?@{GAP}?|{GAP}?[(\[{{]{GAP}?at{GAP}?[)\]}}]{GAP}?|{GAP}at{GAP})"
DOT = rf"(?:\.|{GAP}?[(\[{{]{GAP}?dot{GAP}?[)\]}}]{GAP}?|{GAP}dot{GAP})"
EMAIL = re.compile(rf"(?<![\w.+@-])[\w][\w.+-]*{AT}[\w][\w-]*(?:{DOT}[\w][\w-]*)*{DOT}[^\W\d_]{{2,}}(?![\w@])", re.I)

CAP = r"[\p{Lu}][\p{L}\p{M}'’-]*"
EN_STREET = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Court|Ct|Close|Drive|Dr|Square|Sq|Terrace|Way|Place|Row|Gardens|Crescent|Boulevard|Blvd)"
EN_CAPS = EN_STREET.upper()
ADDRESS = re.compile(
    "|".join(
        (
            rf"(?<![\w#.,-])[1-9]\d{{0,4}}[ ]?[A-Za-z]?{GAP}(?:[NSEW]\.?{GAP})?(?!AND\b|LAMPS\b){CAP}{GAP}(?:{EN_STREET}|{EN_CAPS})(?!\w|{GAP}(?i:market)\b)",
            rf"(?<!\w)\p{{Lu}}[\p{{L}}-]*(?i:straße|strasse|stra.?e|str\.|platz|weg|gasse|allee|ufer|damm){GAP}\d{{1,4}}(?:[ ]?[a-zA-Z])?(?!\w)",
            rf"(?<!\w)(?i:am|im|an der|auf der|zum|zur){GAP}{CAP}{GAP}\d{{1,4}}(?:[ ]?[a-z])?(?=[,.\s<]*(?:\d{{5}}|$|[.<\r\n]))",
            rf"(?<![\w#])\d{{1,4}}(?:{GAP}?(?i:bis|ter|quater))?,?{GAP}(?i:rue|place|chemin|avenue|av\.|impasse|quai|allée|all.e|boulevard|bd|cours|square|route|passage)(?!\w){GAP}(?:(?i:de la|de l['’]|des|du|de|d['’]|la|le|les){GAP}?)?[\p{{Lu}}Éé][\p{{L}}'’-]*",
            rf"(?<!\w)(?i:calle|c/|plaza|pza\.|avenida|avda\.|av\.|paseo|camino|ronda){GAP}?(?:(?i:de{GAP}los|de{GAP}las|de{GAP}la|del|de){GAP})?{CAP}(?:{GAP}{CAP})?,?{GAP}(?:n\.?º{GAP}?)?\d{{1,4}}(?!\w)",
            rf"(?<!\w)(?i:ул\.|улица|пер\.|переулок|пр\.|проспект|пр-т|площадь|пл\.|наб\.|набережная|бульвар|б-р|шоссе|тракт){GAP}?{CAP},?{GAP}(?:(?i:д\.|дом){GAP}?)?\d{{1,4}}",
            rf"(?<!\w){CAP}{GAP}(?i:ул\.|улица|пер\.|переулок|пр\.|проспект|пр-т|площадь|пл\.|наб\.|набережная|бульвар|б-р|шоссе),?{GAP}(?:(?i:д\.|дом){GAP}?)?\d{{1,4}}",
        )
    )
)

DIGIT = r"[0-9OolISB|]"
RUN = re.compile(
    rf"(?<![\w.,:$€£@#/+-])(?:[(]?[+][ ]?)?[(]?(?:{DIGIT}|[A-Z]{{1,3}}(?=-?\d)|[A-Z]{{2}}(?=\s\d\d\s))(?:{DIGIT}|[A-Z](?![a-z])|(?:[ .()/-]|[ ]?№[ ]?|[)]{GAP}|[ ][(]|{GAP})(?={DIGIT}|[(№A-Z])(?![A-Z]+[a-km-np-z])){{4,}}(?![\w@]|[.,]\d|:\d)"
)
SHAPES_PHONE = re.compile(
    "|".join(
        (
            r"\(?\+\d{1,3}\)?[ ()./-]?[\d ()./-]{6,}\d",
            r"(?:1[ .-])?\(?[2-9]\d\d\)?[ .-]+\d{3}[ .-]\d{4}",
            r"\d{3}-\d{4}|555 \d{4}",
            r"0\d{4} \d{6}|0\d{3} \d{3} \d{4}",
            r"(?!\d{4} \d{6}$)\(?0\d{2,3}\)?[ /]+\d{5,8}|\(?0\d{2,3}\)?[ /-]\d{5}[ -]\d{3}|00\d{2}[ /]\d{2,3}[ /]\d{4,9}(?:[ -]\d{3})?",
            r"0\d(?:[ .]\d\d){4}",
            r"[89]00[ -]\d{3}[ -]\d{3}",
            r"8[ -]?\(\d{3}\)[ ]?\d{3}-?\d{2}-?\d{2}|8 \d{3} \d{3} \d\d \d\d",
        )
    )
)
SHAPES_ID = re.compile(
    "|".join(
        (
            r"\d{3}-\d{2}-\d{4}|(?:000|666|9\d\d) \d{2} \d{4}",
            r"[A-Z]-\d{3}-\d{3}-\d{2}",
            r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]",
            r"\d{2}\.\d{3}\.\d{3}-[A-Z]|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]",
            r"\d{2} \d{2} ?№ ?\d{6}|\d{4} ?№ ?\d{6}",
            r"[12] \d\d \d\d \d\d \d{3} \d{3} \d\d|\d \d\d \d\d \d\d \d{3} \d{3} \d\d",
            r"[A-Z]\d{2}[A-Z]\d{2}[A-Z]\d{2}|[A-Z]\d{3}[A-Z]{2}\d{3}|\d{2}[A-Z]{2}\d{5}|[A-Z]{3}\d{6}|[A-Z]\d{8}",
        )
    )
)
NOT_PERSONAL = re.compile(r"\d{3}-\d-\d{4}-\d{4}-\d{1,2}|\d\d?-\d\d?-\d{2,4}|\d{1,4}/\d{1,4}.*|\d+\.\d+\.\d+.*")
#: The number words of the languages, as said in telephone numbers.
NUMBER_WORDS = "oh zero one two three four five six seven eight nine double null eins zwei zwo drei vier fünf sechs sieben acht neun zéro un deux trois quatre cinq sept huit neuf cero uno dos tres cuatro cinco seis siete ocho nueve ноль один два три четыре пять шесть семь восемь девять".split()
_NW = "(?:" + "|".join(sorted(NUMBER_WORDS, key=len, reverse=True)) + ")"
SPOKEN = re.compile(rf"(?<!\w){_NW}(?:[,-]?{GAP}{_NW}){{5,}}(?!\w)", re.I)

TOKEN = r"\p{Lu}[\p{L}\p{M}’0|]*[\p{L}\p{M}0|](?:-\p{Lu}[\p{L}\p{M}0|]+)*"
PAIR = re.compile(rf"(?<![\w@.+-])({TOKEN})(?:,?{GAP})(?=((?:\p{{Lu}}\.{GAP}?)?)({TOKEN})(?!\w|@))")
WORD = re.compile(r"[\w'’]+|[^\w\s]")
TAG = re.compile(r"<[^<>\r\n]{0,60}>|\{[^{}\r\n]{0,30}\}")
LABEL = re.compile(r"^\s*(?:[-–—]\s*)?\p{Lu}[\p{Lu} .'-]{1,24}:\s+|^\s*(?:\.\.\.|…|[-–—])\s*")

_LOOKS = str.maketrans({"O": "0", "o": "0", "l": "1", "I": "1", "|": "1", "S": "5", "B": "8"})


#: Bytes of the characters that a single-byte reading of UTF-8 shows.
_BYTE = {chr(b): b for b in range(0x80, 0x100)} | {bytes([b]).decode("cp1252"): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_STRETCH = plain_re.compile("[" + "".join(map(plain_re.escape, _BYTE)) + "]{2,}")


def _utf8_spans(text: str) -> tuple[str, list[int]]:
    """Text in which UTF-8 bytes shown as single-byte letters are read right, and each character's place before."""
    out: list[str] = []
    place: list[int] = []
    done = 0
    for m in _STRETCH.finditer(text):
        i, j = m.span()
        out.append(text[done:i])
        place.extend(range(done, i))
        raw = bytes([_BYTE[c] for c in m.group()])
        at, n = 0, j - i
        while at < n:
            b = raw[at]
            k = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
            if k and at + k <= n:
                try:
                    out.append(raw[at : at + k].decode("utf-8"))
                    place.append(i + at)
                    at += k
                    continue
                except UnicodeDecodeError:
                    pass
            out.append(text[i + at])
            place.append(i + at)
            at += 1
        done = j
    out.append(text[done:])
    place.extend(range(done, len(text)))
    return "".join(out), place


_BROKEN = plain_re.compile(r"[ÂÃÄÅÐÑâ][\u0080-¿Œ-™]")
_HIGH = plain_re.compile(r"[À-ÿ]")
_CYR = str.maketrans({chr(b): bytes([b]).decode("cp1251") for b in range(0xC0, 0x100)} | {"¸": "ё", "¨": "Ё", "¹": "№"})


def readable(text: str) -> tuple[str, list[int] | None]:
    """The text with wrong encodings read right, and for each character its place in the text as stored (None: same)."""
    if text.isascii():
        return text, None
    place: list[int] | None = None
    for _ in range(2):
        if not _BROKEN.search(text):
            break
        new, back = _utf8_spans(text)
        if len(new) == len(text):
            break
        place = back if place is None else [place[i] for i in back]
        text = new
    high = len(_HIGH.findall(text))
    if high > 20 and 5 * high > len(text) and high > 0.5 * sum(map(str.isalpha, text)):
        text = text.translate(_CYR)
    return text, place


_AT = plain_re.compile(r"@|[(\[{]\s*at\s*[)\]}]|\bdot\b", plain_re.I)
#: Stems of the words that ``ADDRESS`` asks for, in lower case with every gap as one blank; a stretch without any of
#: them holds no address.
_STREET = (
    " street| st| road| rd| avenue| ave| lane| ln| court| ct| close| drive| dr| square| sq| terrace| way| place| row| gardens| crescent| boulevard| blvd"
    "|straße|stra|str.|platz|weg|gasse|allee|ufer|damm|am |im |zum |zur |der "
    "|rue |place |chemin |avenue |av.|impasse |quai |all|boulevard |bd |cours |square |route |passage "
    "|calle|c/|plaza|pza|avenida|avda|paseo|camino|ronda|ул|пер|пр|площ|пл.|наб|бульв|б-р|шоссе|тракт"
).split("|")
_PLAIN_PART = plain_re.compile(r"[\w.+-]+")
_SPELT = plain_re.compile(r"\bdot\b|[(\[{]", plain_re.I)
_MISREAD = plain_re.compile(r"[ol|]|\d[OISB]\d")
_LETTERED = plain_re.compile(r"[OolI|]")
_LINE_END = plain_re.compile(r"\r\n|\n|\r")
_BRACKETED = plain_re.compile(r"[(\[{]\s*at\s*[)\]}]")
_DIGIT = plain_re.compile(r"\d")
_AT = plain_re.compile(r"@|[(\[{]\s*at\s*[)\]}]|\bdot\b", plain_re.I)
_SPOKEN_TOKENS = {w + tail for w in NUMBER_WORDS for tail in ("", ",", "-")}


def masked(text: str) -> str:
    """The text with cue numbers and times replaced by as many mask signs."""
    out: list[str] = []
    done, arrow, returns = 0, text.find("->"), "\r" in text
    while arrow >= 0:
        start = text.rfind("\n", done, arrow) + 1
        if returns:
            start = max(start, text.rfind("\r", done, arrow) + 1)
        start = start or done
        stop = text.find("\n", arrow)
        if returns and (r := text.find("\r", arrow, stop if stop >= 0 else len(text))) >= 0:
            stop = r
        stop = len(text) if stop < 0 else stop
        # The line before the times, if it is only a number.
        end = start - (2 if text[start - 2 : start] == "\r\n" else 1)
        if end > done:
            first = text.rfind("\n", done, end) + 1
            if returns:
                first = max(first, text.rfind("\r", done, end) + 1)
            first = first or done
            if text[first:end].strip("\ufeff \t").isdigit():
                start = first
        out += (text[done:start], MASK * (stop - start))
        done = stop
        arrow = text.find("->", stop)
    out.append(text[done:])
    return "".join(out)


_BLANK_LINE = plain_re.compile("\x01|\n[ \t]*\n|\r\n[ \t]*\r\n|\r[ \t]*\r(?!\n)")


def _blocks(marks: Iterator, text: str) -> list[tuple[int, int]]:
    """The stretches between mask signs and blank lines that hold a mark. No pattern of this module crosses either,
    so a search inside these stretches finds what a search of the whole text would, however long a piece is."""
    out: list[tuple[int, int]] = []
    end = 0
    for m in marks:
        i = m.start()
        if i < end:
            continue
        lo = max(end, text.rfind(MASK, end, i) + 1)
        for sep in ("\n\n", "\r\n\r\n", "\r\r"):
            if (k := text.rfind(sep, lo, i)) >= 0:
                lo = k + len(sep)
        stop = _BLANK_LINE.search(text, i)
        end = stop.start() if stop else len(text)
        out.append((lo, end))
    return out


def _matches(pattern: re.Pattern, text: str, blocks: list[tuple[int, int]]) -> Iterator:
    for i, j in blocks:
        yield from pattern.finditer(text, i, j)


def _street(part: str) -> bool:
    return any(map(" ".join(part.lower().split()).__contains__, _STREET))


def _context(text: str, start: int, end: int, unlabelled: bool = True) -> tuple[str, str]:
    """Up to three words before and two after, inside the cue and the sentence; ^ and $ where there is none. A speaker's
    label at the start of a line is no context, unless ``unlabelled`` is false."""
    left = text[max(0, start - 60) : start]
    cut = max(left.rfind(MASK), left.rfind("\n\n"), left.rfind("\r\n\r\n"))
    left = TAG.sub(" ", left[cut + 1 :])
    lines = _LINE_END.split(left)
    if unlabelled and len(lines) > 1 and LABEL.match(lines[-1]):
        lines = lines[-1:]
    left = " ".join(lines)
    if unlabelled:
        left = LABEL.sub("", left)
    words = WORD.findall(left.lower())
    for i in range(len(words) - 1, -1, -1):
        if words[i] in ".!?" and not (i and len(words[i - 1]) < 4 and i == len(words) - 1):
            words = words[i + 1 :]
            break
    right = text[end : end + 60]
    cut = right.find(MASK)
    right = right[: cut if cut >= 0 else None]
    for stop in ("\r\n\r\n", "\n\n"):
        right = right.split(stop)[0]
    after = WORD.findall(TAG.sub(" ", right).lower())
    return " ".join(["^", *words][-3:]), " ".join([*after, "$"][:2])


def fold(word: str) -> str:
    """A name part without case, accents and the usual misreadings; equal for a part and its misread forms."""
    w = word.lower().replace("’", "'").removesuffix("'s")
    w = "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c) or c == "̆")
    for a, b in (("vv", "w"), ("rn", "m"), ("0", "o"), ("1", "l"), ("|", "l"), ("li", "h"), ("i", "l"), ("c", "e")):
        w = w.replace(a, b)
    return w


def shape(raw: str) -> str:
    return _DIGIT.sub("9", " ".join(raw.split()))


def scan(text: str, parts: frozenset[str]) -> Iterator[tuple]:
    """(kind, start, end, shape or first name part, second part, left, right) of a text's candidates.

    ``kind`` is what the form suggests: 'email', 'address', 'phone', 'id_number', 'other' (a number of a form that
    nothing personal has), 'number' (undecided) or 'pair' (two capitalised words). Places are code points of the text
    as stored.
    """
    plain, place = readable(text)
    body = masked(plain)

    def at(i: int, j: int) -> tuple[int, int]:
        return (i, j) if place is None else (place[i], place[j] if j < len(place) else len(text))

    taken: list[tuple[int, int]] = []

    def free(i: int, j: int) -> bool:
        return all(j <= a or i >= b for a, b in taken)

    low = body.lower()
    for m in _matches(EMAIL, body, _blocks(_AT.finditer(body), body)) if "@" in low or "dot" in low or _BRACKETED.search(low) else ():
        if "@" in m.group() or _SPELT.search(m.group()):
            taken.append(m.span())
            yield ("email", *at(*m.span()), _PLAIN_PART.sub("w", m.group()), "", *_context(body, *m.span()))
    digits = _blocks(_DIGIT.finditer(body), body)
    for m in _matches(ADDRESS, body, [x for x in digits if _street(body[slice(*x)])]):
        if free(*m.span()):
            taken.append(m.span())
            yield ("address", *at(*m.span()), "street", "", *_context(body, *m.span()))
    # Of the words of a spoken number at least those between the first and the last stand alone or before a sign.
    for m in SPOKEN.finditer(body) if sum(map(_SPOKEN_TOKENS.__contains__, low.split())) >= 4 else ():
        taken.append(m.span())
        yield ("phone", *at(*m.span()), "spoken", "", *_context(body, *m.span()))
    for m in _matches(RUN, body, digits):
        i, j = m.span()
        raw = m.group()
        n_digits = sum(c.isdigit() for c in raw)
        if n_digits < 3 or sum(c.isdigit() for c in raw.translate(_LOOKS)) < 5 or not free(i, j):
            continue
        bare = " ".join(raw.split())
        if bare.count("(") != bare.count(")"):
            continue
        read = bare.translate(_LOOKS) if _MISREAD.search(bare) else bare
        left, right = _context(body, i, j)
        if left == "^":
            left, right = _context(body, i, j, False)
        if SHAPES_ID.fullmatch(bare):
            kind = "id_number"
        elif SHAPES_PHONE.fullmatch(read) or SHAPES_PHONE.fullmatch(bare.translate(_LOOKS)) and _LETTERED.search(bare):
            kind = "phone"
        elif NOT_PERSONAL.fullmatch(bare):
            kind = "other"
        else:
            kind = "number"
        yield (kind, *at(i, j), shape(read), "", left, right)
    for m in PAIR.finditer(body):
        a, b = m.group(1), m.group(3)
        fa, fb = fold(a), fold(b)
        loud = a.isupper() and b.isupper()
        if loud and not any(map(str.islower, body[max(0, m.start() - 20) : m.start()] + body[m.end() + len(m.group(2)) + len(b) :][:20])) and not (parts.intersection(fa.split("-")) or parts.intersection(fb.split("-"))):
            continue
        end = m.end() + len(m.group(2)) + len(b)
        for tail in ("'s", "’s"):
            if b.endswith(tail):
                end -= 2
        if not free(m.start(), end):
            continue
        left, right = _context(body, m.start(), end)
        yield ("pair", *at(m.start(), end), fa, fb, left, right)


_SCHEMA = "{key} long, kind string, start_at long, end_at long, a string, b string, l string, r string"


def candidates(df: DataFrame, key: str, text: str, parts: frozenset[str]) -> DataFrame:
    """One row per candidate of ``scan``. The folded known names go along with the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t:
                    for row in scan(t, parts):
                        cols[0].append(k)
                        for c, v in zip(cols[1:], row, strict=True):
                            c.append(v)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[key, "kind", "start_at", "end_at", "a", "b", "l", "r"])

    return df.select(F.col(key).cast("long").alias(key), F.col(text).alias("_text")).mapInArrow(run, _SCHEMA.format(key=key))


def _keys(df: DataFrame) -> DataFrame:
    """Each instance with its patterns: both sides, three words before, two words before, two words after."""
    l2 = F.regexp_replace("l", r"^\S+ (?=\S+ \S+$)", "")
    three = F.when(F.col("l") != l2, F.concat(F.lit("M:"), "l"))
    return df.withColumn(
        "p", F.explode(F.array(F.concat(F.lit("B:"), l2, F.lit(" | "), "r"), three, F.concat(F.lit("L:"), l2), F.concat(F.lit("R:"), "r")))
    ).filter("p is not null and not p in ('L:^', 'R:$', 'B:^ | $', 'R:. $', 'L:', 'R:')")


def _bound(hits: Column, n: Column, sign: int, z: float = 1.28) -> Column:
    """Lower (sign -1) or upper (sign 1) end of the Wilson interval of a share, nine in ten on that side."""
    p, zz = hits / n, z * z
    return (p + zz / (2 * n) + sign * z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)


FORMED = ("email", "address", "phone", "id_number")


def form_kinds(cands: DataFrame, key: str, scratch: Scratch, trust: float = 0.4) -> DataFrame:
    """(key, kind, start_at, end_at) of emails, addresses, phones and identity numbers.

    The graph's edges are counted once as (pattern, shape, n); rounds work on these counts. A pattern speaks for a kind
    if the lower bound of the kind's share among all its occurrences, undecided ones included, reaches ``trust``. For
    the judgement of a shape, its own occurrences are left out of its patterns: nine in ten such votes for one kind,
    from three in ten of its edges by the lower bound, give an undecided shape that kind, or turn over the one its form
    suggests. Each shape turns once, so the rounds end.
    """
    found = scratch.put(cands.filter("kind <> 'pair'").withColumn("s", F.concat_ws("|", "kind", "a")))
    edges = scratch.put(_keys(found).groupBy("p", "s").agg(F.count(F.lit(1)).alias("n")))
    # Emails and addresses are words, told by their form, and negative seeds are no one's; only other numbers turn.
    kinds = scratch.put(found.select("s", F.when(F.col("kind") != "number", F.col("kind")).alias("k"), F.col("kind").isin("email", "address", "other").alias("turned")).distinct())
    sizes = edges.groupBy("s").agg(F.sum("n").alias("size"))

    def told(kinds: DataFrame) -> DataFrame:
        """Edges with their shape's kind and, for each kind, its count in the pattern."""
        now = edges.join(small_or_plain(scratch, kinds), "s")
        totals = now.groupBy("p").agg(
            F.sum("n").alias("n_all"), *(F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"n_{k}") for k in (*FORMED, "other"))
        )
        return now.join(totals, "p")

    def verdict(own: Column) -> Column:
        """The kind a pattern speaks for; ``own`` is what is left out of its counts."""
        n = F.col("n_all") - own
        out = F.lit(None).cast("string")
        for k in (*FORMED, "other"):
            hits = F.col(f"n_{k}") - F.when(F.col("k") == k, own).otherwise(0)
            out = F.when((hits >= 2) & (_bound(hits, n, -1) >= (trust if k != "other" else 0.8)), F.lit(k)).otherwise(out)
        return F.when(n > 0, out)

    while True:
        votes = told(kinds).withColumn("vote", verdict(F.col("n"))).filter("vote in ('phone', 'id_number', 'other')").groupBy("s", "vote").agg(F.sum("n").alias("n"))
        best = votes.groupBy("s").agg(F.max(F.struct("n", "vote")).alias("b"), F.sum("n").alias("total")).join(sizes, "s")
        clear = best.filter((F.col("b.n") >= 0.9 * F.col("total")) & (_bound(F.col("b.n"), F.col("size"), -1) >= 0.3)).select("s", F.col("b.vote").alias("vote"), F.col("b.n").alias("n"))
        turn = kinds.join(clear, "s").filter("not turned and not vote <=> k")
        # Undecided shapes take their kind together; of shapes that would turn over, which may stand against each other,
        # only the best supported one does in a round.
        one = turn.filter("k is not null").orderBy(F.col("n").desc(), "s").limit(1)
        turn = turn.filter("k is null").unionByName(one).select("s", "vote")
        new = scratch.put(
            kinds.join(turn, "s", "left").select("s", F.coalesce("vote", "k").alias("k"), (F.col("turned") | F.col("vote").isNotNull()).alias("turned"), F.col("vote").isNotNull().alias("moved"))
        )
        scratch.drop(kinds)
        moved = new.filter("moved").limit(1).count()
        kinds = new.drop("moved")
        kinds._scratch_path = new._scratch_path
        if not moved:
            break
    judged = told(kinds)
    # A shape with a kind gives way only to what its patterns say without it; one without takes the pattern's kind.
    v = F.when(F.col("k").isNull(), verdict(F.lit(0))).otherwise(verdict(F.col("n")))
    says = scratch.put(judged.select("p", "s", F.col("n_all").alias("w"), v.alias("v")).filter("v in ('phone', 'id_number', 'other')"))
    heard = _keys(found).select(key, "start_at", "end_at", "p", "s").join(small_or_plain(scratch, says), ["p", "s"])
    rank = F.when(F.col("p").startswith("B:"), 2).when(F.col("p").startswith("M:"), 1).otherwise(0)
    heard = heard.groupBy(key, "start_at", "end_at", "s").agg(F.max_by("v", F.struct(rank, F.col("w"), F.col("v"))).alias("v"))
    named = found.select(key, "start_at", "end_at", "s").join(small_or_plain(scratch, kinds.select("s", "k"), kinds), "s").join(heard, [key, "start_at", "end_at", "s"], "left")
    # Words of the form of an email or an address give way only to surroundings of other things, as do forms of other
    # things to none; any other number is what its surroundings say.
    kind = F.when(F.col("k") == "other", F.col("k")).when(F.col("k").isin("email", "address") & ~F.col("v").eqNullSafe(F.lit("other")), F.col("k")).otherwise(F.coalesce("v", "k"))
    return named.withColumn("kind", kind).filter(F.col("kind").isin(*FORMED)).select(key, "kind", "start_at", "end_at")


def name_pairs(cands: DataFrame, known: list[tuple[str, str]], key: str, scratch: Scratch) -> DataFrame:
    """(key, kind, start_at, end_at, score) of the pairs that are a person's given and family name, in either order.

    A pair is whole if one part is a given and the other a family name. Patterns are trusted by the lower bound of the
    share of whole pairs in them and count against a pair if the upper bound is low. A part is learned if the lower
    bound of its pairs in trusted patterns among all its pairs with a fitting part is high, from two patterns and two
    partners at least; a pair that crosses a whole one counts against it. Parts only join while rounds go on; at the end
    all learned ones are judged again.
    """
    spark = cands.sparkSession
    pairs = scratch.put(cands.filter("kind = 'pair'").select(key, "start_at", "end_at", "a", "b", "l", "r"))
    seeds = spark.createDataFrame(sorted({(fold(w), t) for w, t in known}), "w string, t string")
    lex = scratch.put(seeds)
    whole = (F.col("ga") & F.col("fb")) | (F.col("fa") & F.col("gb"))
    some = F.col("ga") | F.col("fb") | F.col("fa") | F.col("gb")

    def marked(lexicon: DataFrame) -> DataFrame:
        """Pairs with ga, fa, gb, fb (a part of the first or second word is a given or a family name), whole, some, and
        crossed: it shares a word with a whole pair and is none."""
        types = lexicon.groupBy("w").agg(F.max(F.col("t") == "given").alias("g"), F.max(F.col("t") == "family").alias("f"))
        words = pairs.select(F.explode(F.array("a", "b")).alias("word")).distinct()
        flags = scratch.put(
            words.select("word", F.explode(F.split("word", "-")).alias("w")).join(types, "w").groupBy("word").agg(F.max("g").alias("g"), F.max("f").alias("f"))
        )
        fa = small_or_plain(scratch, flags.select(F.col("word").alias("a"), F.col("g").alias("ga"), F.col("f").alias("fa")), flags)
        fb = small_or_plain(scratch, flags.select(F.col("word").alias("b"), F.col("g").alias("gb"), F.col("f").alias("fb")), flags)
        out = pairs.join(fa, "a", "left").join(fb, "b", "left").fillna(False, subset=["ga", "fa", "gb", "fb"])
        row = Window.partitionBy(key).orderBy("start_at", "end_at")
        out = out.withColumns({"whole": whole, "some": some})
        before = F.coalesce(F.lag("whole").over(row) & (F.lag("end_at").over(row) > F.col("start_at")), F.lit(False))
        after = F.coalesce(F.lead("whole").over(row) & (F.lead("start_at").over(row) < F.col("end_at")), F.lit(False))
        return out.withColumn("crossed", ~F.col("whole") & (before | after))

    def scored(now: DataFrame) -> DataFrame:
        """Each pair with ``good``: 2 if its whole surroundings are trusted, 1 if a side is and nothing speaks against
        it, -1 if its surroundings speak against it, else 0; and ``sure``: both sides are strongly trusted."""
        keyed = _keys(now)
        stats = keyed.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_if("whole").alias("hits"), F.count_distinct(F.when(F.col("whole"), F.concat_ws(" ", "a", "b"))).alias("names"))
        v = F.when((F.col("names") >= 2) & (_bound(F.col("hits"), F.col("n"), -1) >= 0.1), 1).when(_bound(F.col("hits"), F.col("n"), 1) < 0.1, -1)
        said = scratch.put(stats.select("p", v.alias("v"), (_bound(F.col("hits"), F.col("n"), -1) >= 0.3).alias("strong")).filter("v is not null"))
        both = F.col("p").startswith("B:")
        heard = keyed.select(key, "start_at", "end_at", "p").join(small_or_plain(scratch, said), "p").groupBy(key, "start_at", "end_at").agg(
            F.max(F.when(both, F.col("v"))).alias("vb"), F.max("v").alias("most"), F.min("v").alias("least"), F.max(F.when(both & (F.col("v") > 0), F.col("strong"))).alias("sure")
        )
        good = F.when(F.col("vb") > 0, 2).when(F.col("least") < 0, -1).when(F.col("most") > 0, 1).otherwise(0)
        return now.join(heard, [key, "start_at", "end_at"], "left").withColumns({"good": good, "sure": F.coalesce("sure", F.lit(False))})

    def learned(judged: DataFrame) -> DataFrame:
        """(w, t) of the parts that trusted patterns give beside a known part."""
        as_family = F.when(F.col("ga"), F.col("b")).when(F.col("gb"), F.col("a"))
        as_given = F.when(F.col("fa"), F.col("b")).when(F.col("fb"), F.col("a"))
        ways = F.array(F.struct(as_family.alias("word"), F.lit("family").alias("t")), F.struct(as_given.alias("word"), F.lit("given").alias("t")))
        rows = judged.filter("some").select("a", "b", "l", "r", "good", "crossed", F.explode(ways).alias("x")).select("*", "x.word", "x.t").filter("word is not null")
        rows = rows.withColumn("ok", (F.col("good") > 0) & ~F.col("crossed")).withColumn("w", F.explode(F.split("word", "-"))).filter(F.length("w") > 2)
        other = F.when(F.col("word") == F.col("a"), F.col("b")).otherwise(F.col("a"))
        stats = rows.groupBy("w", "t").agg(
            F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("hits"), F.count_distinct(F.when(F.col("ok"), F.concat_ws("|", "l", "r"))).alias("places"), F.count_distinct(F.when(F.col("ok"), other)).alias("partners")
        )
        return stats.filter((F.col("places") >= 2) & (F.col("partners") >= 2) & (_bound(F.col("hits"), F.col("n"), -1) >= 0.25)).select("w", "t")

    while True:
        got = scratch.put(learned(scored(scratch.put(marked(lex)))))
        if not got.join(lex, ["w", "t"], "left_anti").limit(1).count():
            break
        lex = scratch.put(lex.union(got).distinct())
    lex = scratch.put(seeds.union(got).distinct())
    judged = scored(scratch.put(marked(lex)))
    score = (
        F.when(F.col("whole") & (F.col("good") >= 0), 2 + F.col("good")).when(F.col("some") & ~F.col("crossed") & (F.col("good") > 0), F.col("good")).when(~F.col("some") & ~F.col("crossed") & F.col("sure"), 1)
    )
    return judged.withColumn("score", score).filter("score is not null").select(key, F.lit("name").alias("kind"), "start_at", "end_at", "score")


def _apart(pieces: DataFrame, key: str) -> DataFrame:
    """Of overlapping pieces of one text, the first in the order of kinds, score, length and place. The pieces of one
    text gather in one row: they are fewer than its characters."""
    order = F.when(F.col("kind") == "email", 0).when(F.col("kind") == "address", 1).when(F.col("kind") == "name", 3).otherwise(2)
    row = F.struct(order.alias("o"), (-F.col("score")).alias("s"), (F.col("start_at") - F.col("end_at")).alias("n"), "start_at", "end_at", "kind")
    lists = pieces.groupBy(key).agg(F.array_sort(F.collect_set(row)).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(4)]
            for k, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                starts: list[int] = []
                ends: list[int] = []
                for x in rows:
                    i = bisect.bisect_left(starts, x["end_at"])
                    if i and ends[i - 1] > x["start_at"]:
                        continue
                    starts.insert(i, x["start_at"])
                    ends.insert(i, x["end_at"])
                    for c, v in zip(cols, (k, x["kind"], x["start_at"], x["end_at"]), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=[key, "kind", "start_at", "end_at"])

    return lists.mapInArrow(run, f"`{key}` long, kind string, start_at long, end_at long")


def find(df: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, start_at, end_at): one row per piece of personal information, places in code points from 0.

    Whole texts are read; cue numbers and times never count. Null and empty texts have none. Repeated rows of one
    key give each place once. Of overlapping pieces the first in the order email, address, phone and identity number,
    name holds, then the better supported, the longer, the earlier. Other columns are ignored, whatever their names.
    ``known`` is a list by nature (``known_names``): it goes to the driver and with the tasks, and a list above
    ``KNOWN_LIMIT`` names is refused.
    """
    scratch = Scratch(df.sparkSession, "pii")
    names = [(r[0], r[1]) for r in known.filter("name is not null and name_type in ('given', 'family')").select("name", "name_type").distinct().limit(KNOWN_LIMIT + 1).collect()]
    if len(names) > KNOWN_LIMIT:
        raise ValueError(f"more than {KNOWN_LIMIT} known names")
    cands = scratch.put(candidates(df, key, text, frozenset(fold(n) for n, _ in names)))
    formed = form_kinds(cands, key, scratch).withColumn("score", F.lit(0))
    return _apart(formed.unionByName(name_pairs(cands, names, key, scratch)), key)


def redact(df: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): each text with the pieces of ``found`` replaced by [KIND]; everything else as it was.

    Null and empty texts stay as they are. Pieces of one text gather with it (bounded by the text's length).
    """
    spans = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_at", "end_at", "kind"))).alias("_spans"))
    joined = df.select(F.col(key).cast("long").alias(key), F.col(text).alias("_text")).join(spans, key, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, spans_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if t and spans_:
                    parts, at = [], 0
                    for s in spans_:
                        if s["start_at"] >= at:
                            parts += [t[at : s["start_at"]], f"[{s['kind'].upper()}]"]
                            at = s["end_at"]
                    t = "".join(parts) + t[at:]
                out.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, text])

    return joined.select(key, "_text", "_spans").mapInArrow(run, f"`{key}` long, `{text}` string")
