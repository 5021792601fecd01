"""Matching products of one source to books of another without a common key: soft-logic linkage.

Titles, authors and ISBNs of both sides are read into comparable forms. Works with the same title and author are one
book. Candidate pairs (product, book) come from four equi-join blocks: the same ISBN, the same title with an author
of the same initial (or no author), the same family name with three letters in a row of the title, and the same initial
with a family name of at most one edit or swap. Each pair is a variable in
[0, 1] under weighted hinge-loss rules:

- ISBN and title agree -> match; title and author agree -> match; title agrees, author unknown, title unambiguous -> match
- different volume, sets and writings about the book, another author, another subtitle -> no match; a prior against
- exclusivity: the matches of one product add up to 1 at most
- transitivity: products with the same title and author match alike

The convex sum of hinges is minimised by alternating directions: every rule group keeps its own copy of the
variables, solved in closed form, and the copies are drawn to a consensus. Rules couple only products of one title
and author, so each such cluster is solved where it lies, many at a time; copies with equal evidence share one
variable with a weight. The value reached is the confidence.
"""

from __future__ import annotations

import html
import re as plain_re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.session import Scratch, small_or_plain

#: Words that make a title name a series, and what sellers add to titles.
SERIES = r"(?:saga|inquiry|cycle|mysteries|mystery|chronicles|trilogy|series|novels)"
EDITION = r"(?:kindle|english|large print|paperback|hardcover|hardback|reissue|reprint|audio ?book|audio cd|unabridged|mass market|edition|ebook|e-book)"
GENERIC = r"(?:a novel|a novel of [\p{L} ]+|novel|stories|a memoir|memoir|an untold history|the complete edition|a family in [\p{L} ]+|a biography|essays|poems)"
SALES = r"(?:(?:bestselling fiction){e<=3}|a bestseller|the bestseller)"
ABOUT = re.compile(
    r"^(?:summary|analysis|study guide|review|guide|notes|workbook|companion|summary and analysis)\b(?: of| to| for)?[ :]|^(?:summary|analysis|study guide)\b"
    r"|\b(?:conversation starters|trivia quiz book|trivia book|quiz book|study guide|companion|workbook|coloring book|colouring book|sheet music|calendar|cliffsnotes|sparknotes|summary)\s*$"
)
SET = re.compile(r"\b(?:box(?:ed)? ?set|complete collection|collection set|omnibus|bundle|\d-book|books? \d+ ?(?:-|–|to|&) ?\d+|volumes? \d+ ?(?:-|–|to|&) ?\d+|complete series|complete saga)\b")
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12, "xiii": 13, "xiv": 14, "xv": 15, "xvi": 16, "xvii": 17, "xviii": 18, "xix": 19, "xx": 20}
NUMBER = r"(\d{1,3}|[ivx]{1,5})"
VOLUME = re.compile(rf"^(.*\b{SERIES})[ ,:(\[-]*(?:vol(?:ume)?|book|part|no|number|#)?[ .#]*{NUMBER}[ )\]]*$")
PREFIXED = re.compile(rf"^(.*\b{SERIES})[ ,]*(?:vol(?:ume)?|book|part|no|#)?[ .#]*{NUMBER} ?[:-] (.{{4,}})$")
NUMBERED = re.compile(rf"^(.{{4,}}?)[ ,:(\[]+(?:vol(?:ume)?|book|part|v[a-z]{{2}})[ .#]*{NUMBER}[ )\]]*$")
LED = re.compile(r"^[\p{L}' ]{6,40} \d{1,2} ?: (.{4,})$")
TAGGED = re.compile(rf"^(.{{4,}}?) ?(?:[:(\[-]|\s-) ?([^:(\[]*\b{SERIES})[ ,]*(?:vol(?:ume)?|book|part|no|#)?[ .#]*{NUMBER}[ )\]]*$")


def plain(text: str | None) -> str:
    """Lower case without accents, entities, quotes around and doubled blanks."""
    t = text or ""
    while "&" in t and (new := html.unescape(t.replace("&QUOT;", "&quot;"))) != t:
        t = new
    t = t.lower()
    if not t.isascii():
        t = t.replace("’", "'").replace("‘", "'").replace("“", '"').replace("”", '"')
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c) or c == "\u0306")
        t = unicodedata.normalize("NFC", t)
    return " ".join(t.split()).strip(" \t\"'")


_SIMPLE = plain_re.compile(r"[^\W\d_]+(?:['’]s)?(?: [^\W\d_]+(?:['’]s)?)*")
_MARKED = plain_re.compile(rf"\b(?:summary|analysis|guide|review|notes|workbook|companion|starters|book|sheet|calendar|set|collection|omnibus|bundle|complete|edition|{SERIES[3:-1]})\b")
_EDITED = plain_re.compile(EDITION)
_NAMED = plain_re.compile(SERIES)
_CUT = re.compile(r"\s*[\[(:-]?\s*[^\[(]{0,12}(?<=[\[(][^\[(]{0,12})(?:\.\.\.|…)$|[ :,(-]*(?:\.\.\.|…)$")
_BRACKETED = re.compile(rf"\s*[(\[][^()\[\]]*\b{EDITION}\b[^()\[\]]*[)\]]\s*")
_TRAILING = re.compile(rf"\s*[-:,]\s*(?:{EDITION}|{SALES})\s*$")
_BEFORE_ARTICLE = re.compile(rf"\s*[:,-]\s*(?:{EDITION}|{SALES})\s*,\s*(the|a|an)$")
_ARTICLE_LAST = plain_re.compile(r"^(.*), (?:the|a|an|he|te|th)$")
_ARTICLE_FIRST = plain_re.compile(r"^(?:the|a|an|he|te|th) (?=\S)")
_SUBTITLED = re.compile(rf"^(.{{3,}}?)\s*[:(-]\s*({GENERIC})[)\s]*$")
_NOT_WORDS = plain_re.compile(r"[^\w' ,]|_")


def title_form(title: str | None) -> tuple[str, str, int, int, int]:
    """(core, subtitle, volume, kind, cut): comparable title, generic subtitle, volume number or 0, kind (0 a book, 1 a
    writing about one, 2 a set), and 1 if the title was cut off."""
    t = plain(title)
    cut = 0
    if _SIMPLE.fullmatch(t) and not _MARKED.search(t):
        head, _, rest = t.partition(" ")
        return (rest if rest and head in ("the", "a", "an", "he", "te", "th") else t).replace("'", ""), "", 0, 0, 0
    if t.endswith(("...", "…")):
        cut, t = 1, _CUT.sub("", t)
    kind = 0 if not (_MARKED.search(t) or "-book" in t or "books " in t) else 1 if ABOUT.search(t) else 2 if SET.search(t) else 0
    if _EDITED.search(t) or "best" in t or "fiction" in t:
        for _ in range(3):
            t = _BRACKETED.sub(" ", t).strip()
            t = _TRAILING.sub("", t).strip()
            t = _BEFORE_ARTICLE.sub(r", \1", t)
    t = _ARTICLE_LAST.sub(r"\1", t)
    volume, subtitle = 0, ""
    named = _NAMED.search(t) is not None
    if not named and t.isascii() and not any(map(str.isdigit, t)):
        pass
    elif named and (m := PREFIXED.match(t)):
        t = m.group(3)
    elif m := LED.match(t):
        t = m.group(1)
    elif named and (m := TAGGED.match(t)):
        t = m.group(1)
    elif m := (VOLUME.match(t) if named else None) or NUMBERED.match(t):
        volume = int(m.group(2)) if m.group(2).isdigit() else ROMAN.get(m.group(2), 0)
        t = m.group(1)
    t = _ARTICLE_LAST.sub(r"\1", t.strip(" :,-"))
    if m := _SUBTITLED.match(t):
        t, subtitle = m.group(1), m.group(2)
        t = _ARTICLE_LAST.sub(r"\1", t)
    core = " ".join(_NOT_WORDS.sub(" ", t.replace("&", " and ")).replace("'", "").split()).strip(" ,")
    return _ARTICLE_FIRST.sub("", core), subtitle, volume, kind, cut


_SIGN = plain_re.compile(r"\s*(?:[:(\[]|\s-\s)")
_JOINED = re.compile(r"(?<=\p{Ll})(?=\p{Lu})")


def title_head(title: str | None) -> str:
    """Comparable title of what stands before the first colon, bracket or dash; empty where nothing or no more stands."""
    m = _SIGN.search(t := plain(title))
    return title_form(t[: m.start()])[0] if m and m.start() >= 4 else ""


def author_form(author: str | None) -> tuple[str, str]:
    """(family, given) of the first author named; empty for none. A name without blank or comma is parted where a capital
    follows a small letter."""
    if author and "," not in author and not any(map(str.isspace, author.strip())):
        author = _JOINED.sub(" ", author)
    a = plain(author)
    a = re.sub(r"\((?:author|editor|writer)\)", "", a)
    a = re.sub(r"^(?:by|ba|bv|hy|b y)\s+", "", a.strip())
    a = re.sub(r"^(?:dr|prof|sir|mr|mrs|ms)\.?\s+", "", a).strip()
    if "," in a:
        first, rest = (x.strip() for x in a.split(",", 1))
        if " " in first:
            a = first
        elif rest:
            a = f"{rest.split(',')[0]} {first}"
    words = [w.strip(".") for w in re.split(r"[\s]+", re.sub(r"[^\p{L}\s.'-]", " ", a)) if w.strip(".")]
    if not words:
        return "", ""
    if len(words) == 1 and "." in a:
        parts = [w for w in a.split(".") if w]
        words = parts if len(parts) > 1 else words
    return words[-1], words[0] if len(words) > 1 else ""


def _forms(df: DataFrame, key: str, kind: str, title: str, author: str | None) -> DataFrame:
    """(key, core, sub, vol, about, cut, family, given, head)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str | None, tuple[str, str]] = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            titles = [title_form(t) for t in texts]
            authors = []
            for a in batch.column(2).to_pylist():
                if a not in memo:
                    if len(memo) > 100_000:
                        memo.clear()
                    memo[a] = author_form(a)
                authors.append(memo[a])
            cols = [batch.column(0)]
            cols += [pa.array([t[i] for t in titles], pa.string() if i < 2 else pa.int32()) for i in range(5)]
            cols += [pa.array([a[i] for a in authors], pa.string()) for i in range(2)]
            cols.append(pa.array([title_head(t) for t in texts], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[key, "core", "sub", "vol", "about", "cut", "family", "given", "head"])

    chosen = df.select(F.col(key), F.col(title).alias("_t"), (F.col(author) if author else F.lit(None).cast("string")).alias("_a"))
    return chosen.mapInArrow(run, f"{key} {kind}, core string, sub string, vol int, about int, cut int, family string, given string, head string")


def isbn13(raw: Column) -> Column:
    """13 digits of an ISBN written in any way, ISBN-10 converted; null for anything else, wrong check digits and dummies."""
    bare = F.regexp_replace(F.upper(F.trim(raw)), r"\.0$|^ISBN(?:-?1[03])?:?|[\s\-]", "")

    def weighted(x: Column, n: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda sum_, i: sum_ + F.substring(x, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 1).otherwise(3))

    def of(s: Column) -> Column:
        body = F.concat(F.lit("978"), F.substring(s, 1, 9))
        check = F.pmod(-weighted(body, 12), F.lit(10)).cast("string")
        return F.when(s.rlike(r"^97[89]\d{10}$"), s).when(s.rlike(r"^\d{9}[\dX]$"), F.concat(body, check))

    def sound(x: Column) -> Column:
        return F.when((F.pmod(weighted(x, 13), F.lit(10)) == 0) & ~F.substring(x, 4, 9).rlike(r"^(\d)\1*$"), x)

    # Lambda variables hold each step's value, so that no expression is repeated.
    return F.get(F.transform(F.transform(F.filter(F.array(bare), lambda s: F.length(s).isin(10, 13)), of), sound), F.lit(0))


def _near(a: Column, b: Column) -> Column:
    """Similarity of two words from the edit distance, 1 equal."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def _grams(core: Column, family: Column, volume: Column) -> Column:
    """A row for each three letters in a row of a title without blanks, hashed with family name and volume. Titles that
    the rules can call alike share one however their blanks stand: each edit spoils three at most."""
    bare = F.translate(core, " ,", "")
    places = F.sequence(F.lit(1), F.greatest(F.length(bare) - 2, F.lit(1)))
    return F.explode(F.array_distinct(F.transform(places, lambda i: F.xxhash64(family, volume, F.substring(bare, i, F.lit(3))))))


def _less_one(family: Column, given: Column, volume: Column) -> Column:
    """A row for a family name and each form of it without one letter, hashed with initial and volume; names one edit or
    one swap apart share one."""
    less = F.transform(F.sequence(F.lit(1), F.length(family)), lambda i: F.concat(F.substring(family, F.lit(1), i - 1), F.substring(family, i + 1, F.length(family))))
    return F.explode(F.transform(F.array_distinct(F.concat(F.array(family), less)), lambda x: F.xxhash64(x, F.substring(given, 1, 1), volume)))


def evidence(pairs: DataFrame) -> DataFrame:
    """Adds title (t), author (a: -1 unknown), subtitle and volume agreement to candidate pairs."""
    whole = F.when(F.col("p_core") == F.col("core"), 1.0).otherwise(_near(F.col("p_core"), F.col("core")))
    begun = (F.col("p_cut") == 1) & (F.length("p_core") >= 4) & F.expr("startswith(core, p_core)")
    t = F.when(begun, F.greatest(F.lit(0.97), whole)).otherwise(whole)
    family = _near(F.col("p_family"), F.col("family"))
    same_initial = F.substring("p_given", 1, 1) == F.substring("given", 1, 1)
    given = F.when((F.length("p_given") <= 1) | (F.length("given") <= 1), F.when(same_initial, 0.9).otherwise(0.0)).otherwise(_near(F.col("p_given"), F.col("given")))
    a = F.when((F.col("p_family") == "") | (F.col("family") == ""), -1.0).otherwise(F.least(family, F.greatest(given, F.when(same_initial, 0.6).otherwise(0.0))))
    headed = (F.col("p_head") == F.col("core")) & (F.col("core") != "") & (a >= 0.9)
    t = F.when(headed, F.greatest(F.lit(0.93), t)).otherwise(t)
    sub = F.when((F.col("p_sub") == "") | (F.col("sub") == ""), 0.5).otherwise(_near(F.col("p_sub"), F.col("sub")))
    return pairs.select("*", t.alias("t"), a.alias("a"), sub.alias("s"), (F.col("p_vol") == F.col("vol")).alias("same_vol"))


RULES = ("isbn_title", "title_author", "title_only", "not_about", "not_volume", "not_author", "not_subtitle", "not_title", "prior")
WEIGHTS = {"isbn_title": 4.0, "title_author": 3.0, "title_only": 2.0, "not_about": 9.0, "not_volume": 9.0, "not_author": 6.0, "not_subtitle": 0.5, "not_title": 6.0, "prior": 1.0}


def rule_values(e: DataFrame) -> DataFrame:
    """Truth of each rule's body in [0, 1]."""
    ramp = lambda x, lo, hi: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / (hi - lo)))
    t, a = ramp(F.col("t"), 0.70, 0.92), ramp(F.col("a"), 0.50, 0.80)
    known = F.col("a") >= 0
    return e.select(
        "*",
        F.when(F.col("isbn"), ramp(F.col("t"), 0.45, 0.75)).otherwise(0.0).alias("isbn_title"),
        F.when(known, F.greatest(F.lit(0.0), t + a - 1)).otherwise(0.0).alias("title_author"),
        F.when(~known & F.col("alone"), ramp(F.col("t"), 0.9, 0.97)).otherwise(0.0).alias("title_only"),
        (F.col("p_about") > 0).cast("double").alias("not_about"),
        (~F.col("same_vol")).cast("double").alias("not_volume"),
        F.when(known, ramp(F.lit(0.7) - F.col("a"), 0.0, 0.3)).otherwise(0.0).alias("not_author"),
        ramp(F.lit(0.5) - F.col("s"), 0.0, 0.3).alias("not_subtitle"),
        ramp(F.lit(0.8) - F.col("t"), 0.0, 0.25).alias("not_title"),
        F.lit(1.0).alias("prior"),
    )


def _prox_unary(v: np.ndarray, up_w: np.ndarray, up_s: np.ndarray, down: np.ndarray, rho: float) -> np.ndarray:
    """argmin over [0, 1] of sum_k up_w[k] * max(0, up_s[k] - y) + down * y + rho/2 (y - v)^2, exactly."""
    best = np.clip(v - down / rho, 0.0, 1.0)

    def cost(y: np.ndarray) -> np.ndarray:
        return (up_w * np.maximum(0.0, up_s - y)).sum(axis=0) + down * y + rho / 2 * (y - v) ** 2

    value = cost(best)
    order = np.sort(up_s, axis=0)
    # Minimum of a convex piecewise quadratic: at a kink or at a piece's own vertex.
    for k in range(len(up_s)):
        for y in (order[k], np.clip(v + ((up_s > order[k] - 1e-12) * up_w).sum(axis=0) / rho - down / rho, 0.0, 1.0)):
            c = cost(y)
            better = c < value
            best, value = np.where(better, y, best), np.where(better, c, value)
    c = cost(np.clip(v + up_w.sum(axis=0) / rho - down / rho, 0.0, 1.0))
    return np.where(c < value, np.clip(v + up_w.sum(axis=0) / rho - down / rho, 0.0, 1.0), best)


def _prox_exclusive(v: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Projection of each group (sorted ids) onto {y >= 0, sum y <= 1}."""
    y = np.maximum(v, 0.0)
    sums = np.bincount(group, y)
    over = sums > 1.0
    if not over.any():
        return y
    order = np.lexsort((-v, group))
    g, s = group[order], v[order]
    start = np.concatenate([[True], g[1:] != g[:-1]])
    place = np.arange(len(g)) - np.maximum.accumulate(np.where(start, np.arange(len(g)), 0))
    cum = np.cumsum(s)
    base = np.where(start, cum - s, 0.0)
    first = np.flatnonzero(start)
    cum -= base[first][np.cumsum(start) - 1]
    theta = (cum - 1.0) / (place + 1)
    good = s - theta > 0
    tau = np.zeros(len(sums))
    last = np.full(len(sums), -1)
    np.maximum.at(last, g[good], np.flatnonzero(good))
    has = last >= 0
    tau[has] = theta[last[has]]
    return np.where(over[group], np.maximum(v - tau[group], 0.0), y)


def solve(up_w: np.ndarray, up_s: np.ndarray, down: np.ndarray, product: np.ndarray, tie: np.ndarray, weight: np.ndarray, steps: int = 60, rho: float = 2.0) -> np.ndarray:
    """Consensus ADMM over the variables; ``product`` and ``tie`` number the exclusivity and transitivity groups."""
    n = len(down)
    z = np.clip((up_w * up_s).sum(axis=0) / np.maximum(up_w.sum(axis=0), 1e-9), 0, 1)
    u = np.zeros((3, n))
    mass = np.bincount(tie, weight)
    for _ in range(steps):
        y0 = _prox_unary(z - u[0], up_w, up_s, down, rho)
        y1 = _prox_exclusive(z - u[1], product)
        v2 = z - u[2]
        y2 = (np.bincount(tie, v2 * weight) / mass)[tie]
        new = np.clip((y0 + u[0] + y1 + u[1] + y2 + u[2]) / 3, 0, 1)
        for k, y in enumerate((y0, y1, y2)):
            u[k] += y - new
        moved = np.abs(new - z).max() if n else 0.0
        z = new
        if moved < 1e-4:
            break
    return z


def _admm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Solves whole clusters; a cluster's rows are adjacent, several batches are taken together."""
    ups = [r for r in RULES if not r.startswith("not_") and r != "prior"]
    downs = [r for r in RULES if r.startswith("not_") or r == "prior"]
    held: list[pa.RecordBatch] = []
    rows = 0

    def flush(table: pa.Table) -> pa.RecordBatch:
        col = lambda c: table.column(c).to_numpy()
        up_w = np.array([np.full(table.num_rows, WEIGHTS[r]) for r in ups])
        up_s = np.array([col(r) for r in ups])
        up_w = np.where(up_s > 0, up_w, 0.0)
        down = sum(WEIGHTS[r] * col(r) for r in downs)
        _, product = np.unique(col("pid"), return_inverse=True)
        _, tie = np.unique(np.stack([col("cluster"), col("book")]), axis=1, return_inverse=True)
        y = solve(up_w, up_s, down, product.ravel(), tie.ravel(), col("copies").astype(float))
        return pa.RecordBatch.from_arrays([table.column("pid").combine_chunks(), table.column("book").combine_chunks(), pa.array(y)], names=["pid", "book", "confidence"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= 50_000:
            table = pa.Table.from_batches(held)
            c = table.column("cluster").to_numpy()
            cut = int(np.searchsorted(c, c[-1]))
            if cut:
                yield flush(table.slice(0, cut).combine_chunks())
                held = table.slice(cut).combine_chunks().to_batches()
                rows = table.num_rows - cut
    if rows:
        yield flush(pa.Table.from_batches(held).combine_chunks())


def match(
    products: DataFrame, works: DataFrame, editions: DataFrame, authors: DataFrame, least: float = 0.5
) -> DataFrame:
    """(parent_asin, work_id, confidence): the work each product is a printing of, one row per matched product.

    Products without ``parent_asin`` are ignored; of repeated ones the most complete row counts. Null, empty and
    very long titles and authors are values like others (an empty title matches nothing by title). Of a book's works
    that share title and author the one with the ISBN is named, else the one with the same subtitle, no collection,
    the most ratings, the least id. Other columns are ignored, whatever their names. Empty tables give no rows.
    """
    spark = products.sparkSession
    scratch = Scratch(spark, "linkage")
    # Products: one row each, the most complete one, read once.
    filled = sum((F.when(F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 3, 1).otherwise(0) for c in ("title", "author", "isbn10", "isbn13")), F.lit(0))
    rank = F.struct(filled.alias("n"), F.length(F.coalesce("title", F.lit(""))).alias("l"), "title", "author", "isbn10", "isbn13")
    best = products.filter("parent_asin is not null").groupBy("parent_asin").agg(F.max(rank).alias("r"), F.max(isbn13(F.col("isbn13"))).alias("i13"), F.max(isbn13(F.col("isbn10"))).alias("i10"))
    flat = best.select("parent_asin", "r.title", "r.author", F.coalesce("i13", "i10").alias("i"), F.col("i10").alias("j"))
    forms = _forms(flat.select("parent_asin", "title", "author"), "parent_asin", "string", "title", "author")
    p_forms = scratch.put(forms)
    codes = scratch.put(flat.select("parent_asin", F.explode(F.array_distinct(F.array("i", "j"))).alias("code")).filter("code is not null"))
    p = scratch.put(
        p_forms.withColumn("pid", F.xxhash64("parent_asin")).select(
            "parent_asin", "pid", F.col("core").alias("p_core"), F.col("sub").alias("p_sub"), F.col("vol").alias("p_vol"), F.col("about").alias("p_about"),
            F.col("cut").alias("p_cut"), F.col("family").alias("p_family"), F.col("given").alias("p_given"), F.col("head").alias("p_head"),
        )
    )
    # Books: works by main author, title and volume.
    ed = editions.filter("work_id is not null")
    main = ed.select("work_id", F.col("author_ids")[0].alias("author_id")).filter("author_id is not null").groupBy("work_id", "author_id").count()
    main = main.groupBy("work_id").agg(F.max_by("author_id", F.struct("count", -F.col("author_id"))).alias("author_id"))
    titled = works.select("work_id", *[F.when(F.length(F.trim(F.col(c))) > 0, F.col(c)).alias(c) for c in ("title", "original_title", "best_edition_title")], "is_collection", "gr_ratings_count")
    named = titled.select("work_id", F.coalesce("title", "original_title", "best_edition_title").alias("title"), F.coalesce("is_collection", F.lit(False)).alias("coll"), F.coalesce("gr_ratings_count", F.lit(0)).alias("n"))
    untitled = ed.filter(F.length(F.trim("title")) > 0).join(named.filter("title is null").select("work_id"), "work_id", "left_semi").groupBy("work_id").agg(F.max("title").alias("e_title"))
    full = (
        named.join(untitled, "work_id", "left").join(main, "work_id", "left").join(authors.select("author_id", F.col("name").alias("author")), "author_id", "left")
        .select("work_id", F.coalesce("title", "e_title").alias("title"), "author", "coll", "n")
    )
    full = scratch.put(full)
    w_forms = _forms(full, "work_id", "long", "title", "author").filter("about <> 1")
    w = scratch.put(w_forms.withColumn("book", F.xxhash64("core", "vol", "family", "given")).join(full.select("work_id", "coll", "n"), "work_id"))
    books = scratch.put(
        w.filter("core <> ''").groupBy("book").agg(
            *[F.first(c).alias(c) for c in ("core", "vol", "family", "given")], F.min("sub").alias("sub"), F.count(F.lit(1)).alias("works")
        )
    )
    # Blocks.
    w_codes = ed.select("work_id", F.explode(F.array(isbn13(F.col("isbn13")), isbn13(F.col("isbn")))).alias("code")).filter("code is not null")
    hit = scratch.put(w_codes.join(small_or_plain(scratch, codes), "code").select("parent_asin", "work_id").distinct())
    by_code = hit.join(w.select("work_id", "book"), "work_id").join(p.select("parent_asin", "pid"), "parent_asin").select("pid", "book").distinct()
    # A title all of whose books have one author stands for that author where the product names none.
    titles = books.groupBy("core", "vol").agg(F.count(F.lit(1)).alias("m"), F.first("book").alias("only"))
    initial = lambda c: F.substring(c, 1, 1)
    by_title = (
        p.filter("p_core <> '' and p_family <> ''").select("pid", F.col("p_core").alias("core"), F.col("p_vol").alias("vol"), initial("p_given").alias("g"))
        .join(books.select("core", "vol", initial("given").alias("g"), "book"), ["core", "vol", "g"]).select("pid", "book")
    )
    alone = (
        p.filter("p_core <> '' and p_family = ''").select("pid", F.col("p_core").alias("core"), F.col("p_vol").alias("vol"))
        .join(titles.filter("m = 1"), ["core", "vol"]).select("pid", F.col("only").alias("book"))
    )
    # Products whose title and whole author are those of a book need no likeness search: no other book can be nearer. This
    # also keeps a busy author's exact copies out of the gram block.
    settled = (
        p.filter("p_core <> '' and p_family <> '' and p_given <> ''").select("pid", F.col("p_core").alias("core"), F.col("p_vol").alias("vol"), F.col("p_family").alias("family"), F.col("p_given").alias("given"))
        .join(books.select("core", "vol", "family", "given").distinct(), ["core", "vol", "family", "given"], "left_semi").select("pid")
    )
    by_name = (
        p.filter("p_core <> '' and p_family <> ''").join(settled, "pid", "left_anti").select("pid", _grams(F.col("p_core"), F.col("p_family"), F.col("p_vol")).alias("gram"))
        .join(books.filter("family <> ''").select("book", _grams(F.col("core"), F.col("family"), F.col("vol")).alias("gram")), "gram").select("pid", "book")
    )
    # Typos in title and family name at once.
    by_likeness = (
        p.filter("p_core <> '' and p_family <> ''").join(settled, "pid", "left_anti").select("pid", _less_one(F.col("p_family"), F.col("p_given"), F.col("p_vol")).alias("form"))
        .join(books.filter("family <> ''").select("book", _less_one(F.col("family"), F.col("given"), F.col("vol")).alias("form")), "form").select("pid", "book")
    )
    # A tail that no form of title knows: what stands before it is the whole title of a book by the same author.
    by_head = (
        p.filter("p_head not in ('', p_core) and p_family <> ''").select("pid", F.col("p_head").alias("core"), F.col("p_vol").alias("vol"), F.col("p_family").alias("family"), initial("p_given").alias("g"))
        .join(books.select("core", "vol", "family", initial("given").alias("g"), "book"), ["core", "vol", "family", "g"]).select("pid", "book")
    )
    found = scratch.put(
        by_code.withColumn("isbn", F.lit(True)).withColumn("alone", F.lit(False))
        .unionByName(by_title.unionByName(by_name).unionByName(by_likeness).unionByName(by_head).withColumn("isbn", F.lit(False)).withColumn("alone", F.lit(False)))
        .unionByName(alone.withColumn("isbn", F.lit(False)).withColumn("alone", F.lit(True)))
        .groupBy("pid", "book").agg(F.max("isbn").alias("isbn"), F.max("alone").alias("alone"))
    )
    scored = rule_values(evidence(found.join(p.drop("parent_asin"), "pid").join(books, "book")))
    # Pairs whose rules against outweigh all rules for it at any value stay at 0 and couple nothing.
    gain = sum((F.col(r) * WEIGHTS[r] for r in RULES if not r.startswith("not_") and r != "prior"), F.lit(0.0))
    live = scored.filter(gain > 0).withColumn("cluster", F.xxhash64("p_core", "p_vol", "p_family", "p_given", "p_sub", "p_about"))
    evid = ["cluster", "book", *RULES]
    live = scratch.put(live.select("pid", *evid))
    # Products with the same candidates and evidence are one variable with a weight.
    sign = live.groupBy("pid", "cluster").agg(F.md5(F.to_json(F.sort_array(F.collect_list(F.struct("book", *RULES))))).alias("h"), F.count(F.lit(1)).alias("k"))
    reps = scratch.put(sign.groupBy("cluster", "h", "k").agg(F.min("pid").alias("rep"), F.count(F.lit(1)).alias("copies")))
    rows = live.join(reps.select(F.col("rep").alias("pid"), "copies"), "pid").select("pid", "cluster", "book", "copies", *RULES)
    solved = rows.repartition("cluster").sortWithinPartitions("cluster", "pid").mapInArrow(_admm, "pid long, book long, confidence double")
    rep_of = sign.join(reps, ["cluster", "h", "k"]).select("pid", "rep")
    chosen = (
        solved.filter(F.col("confidence") >= least).groupBy(F.col("pid").alias("rep")).agg(F.max_by(F.struct("book", "confidence"), F.struct("confidence", "book")).alias("b"))
        .join(rep_of, "rep").select("pid", "b.book", "b.confidence").join(p.select("pid", "parent_asin", "p_sub"), "pid")
    )
    with_code = hit.withColumn("coded", F.lit(1))
    order = F.struct(
        F.coalesce("coded", F.lit(0)).alias("c"), (F.col("sub") == F.col("p_sub")).cast("int").alias("s"), (~F.col("coll")).cast("int").alias("o"), F.col("n").alias("n"), -F.col("work_id")
    )
    return (
        chosen.join(w.select("book", "work_id", "sub", "coll", "n"), "book").join(with_code, ["parent_asin", "work_id"], "left")
        .groupBy("parent_asin").agg(F.max_by("work_id", order).alias("work_id"), F.round(F.max("confidence"), 4).alias("confidence"))
    )
