import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioforge.llm import components, cooccur, linkage, packing, pii, splits, survivor, tokens


# --- items that appear together ---------------------------------------------------------------------------------


def brute_pairs(rows, least):
    sets = defaultdict(set)
    for r, i in rows:
        if r is not None and i is not None:
            sets[r].add(i)
    n = Counter(p for s in sets.values() for p in itertools.combinations(sorted(s), 2))
    return {p: c for p, c in n.items() if c >= least}


@pytest.mark.parametrize("piece", [2048, 5])
def test_pair_counts_equal_brute_force(spark, piece):
    rnd = random.Random(1)
    rows = [(rnd.randrange(60), rnd.randrange(25)) for _ in range(900)] + [(None, 1), (1, None), (1, 1), (1, 1)]
    rows += [(999, i) for i in range(25)]  # one record with every item
    df = spark.createDataFrame([(r, i, "x") for r, i in rows], "user_id long, work_id long, k string")
    got = {(x.item_a, x.item_b): x.n_both for x in cooccur.pair_counts(df, "user_id", "work_id", 3, piece_items=piece).collect()}
    assert got == brute_pairs(rows, 3)


def test_pair_lift_is_a_ratio_and_empty_is_empty(spark):
    df = spark.createDataFrame([(r, i) for r in range(10) for i in ((1, 2) if r < 3 else (3,))], "r long, i long")
    x = cooccur.pair_counts(df, "r", "i", 2, 3.0).first()
    assert (x.item_a, x.item_b, x.n_both, x.n_records) == (1, 2, 3, 10) and x.lift == pytest.approx(3 * 10 / 9)
    assert cooccur.pair_counts(df, "r", "i", 2, 3.5).count() == 0
    assert cooccur.pair_counts(df.limit(0), "r", "i", 2).count() == 0


# --- components ---------------------------------------------------------------------------------------------------


def union_find(pairs):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        for v in (a, b):
            if v is not None:
                root(v)
        if a is not None and b is not None and root(a) != root(b):
            up[max(root(a), root(b))] = min(root(a), root(b))
    return {v: root(v) for v in up}


def shapes():
    rnd = random.Random(4)
    chain = list(zip(range(100, 160), range(101, 161)))
    ring = [(200 + i, 200 + (i + 1) % 17) for i in range(17)]
    star = [(300, 300 + i) for i in range(1, 40)]
    dense = list(itertools.combinations(range(400, 412), 2))
    hairy = dense[:30] + [(411, 500), (500, 501), (501, 502), (405, 510)]
    tree = [(i, 2 * i) for i in range(600, 640)] + [(i, 2 * i + 1) for i in range(600, 640)]
    noise = [(rnd.randrange(2000, 2300), rnd.randrange(2000, 2300)) for _ in range(200)]
    dirty = [(1, 1), (None, 5), (7, None), (None, None), (9, 8), (8, 9), (8, 9)]
    return chain + ring + star + hairy + tree + noise + dirty


@pytest.mark.parametrize("solve", ["chain", "hook"])
def test_components_equal_union_find(spark, solve):
    pairs = shapes()
    df = spark.createDataFrame(pairs, "a long, b long").withColumn("v", F.lit(0)).withColumn("group_id", F.lit("clash"))
    if solve == "chain":
        got = {r.v: r.group_id for r in components.chain_components(df, "a", "b").collect()}
        assert got == union_find(pairs)
    else:
        got = {r.v: r.group_id for r in components.hook_components(df, "a", "b").collect()}
        want = union_find(pairs)
        assert got == {v: g for v, g in want.items() if any(v in p and p[0] != p[1] and None not in p for p in pairs)}


CORE4 = [(50, 51), (50, 52), (50, 53), (51, 52), (51, 53), (52, 53)]


def path(*vs):
    return list(zip(vs, vs[1:]))


@pytest.mark.parametrize(
    "pairs",
    [path(1, 10, 11, 2)] + [CORE4 + path(50, *range(60, 60 + n - 1), 3) for n in (3, 5, 9)] + [path(1, 10, 11, 2) + path(20, 21, 22, 23, 24, 20)],
    ids=["path4", "tail3", "tail5", "tail9", "path4_ring5"],
)
def test_chain_ends_are_found_when_no_least_falls(spark, pairs):
    df = spark.createDataFrame(pairs, "a long, b long")
    assert {r.v: r.group_id for r in components.chain_components(df, "a", "b").collect()} == union_find(pairs)


def test_components_of_nothing(spark):
    df = spark.createDataFrame([], "a long, b long")
    assert components.chain_components(df, "a", "b").count() == 0


# --- splits -------------------------------------------------------------------------------------------------------


def test_closest_subset_is_the_best_there_is():
    rnd = random.Random(5)
    for _ in range(30):
        counts = {s: rnd.randrange(1, 5) for s in rnd.sample(range(1, 12), 3)}
        target = rnd.randrange(0, 40)
        got = splits.closest_subset(counts, target)
        totals = {sum(s * k for s, k in zip(counts, pick)) for pick in itertools.product(*[range(n + 1) for n in counts.values()])}
        assert all(0 <= got[s] <= counts[s] for s in counts)
        assert abs(sum(s * k for s, k in got.items()) - target) == min(abs(t - target) for t in totals)


def test_closest_subset_is_exact_beyond_the_direct_bitset():
    rnd = random.Random(12)
    for _ in range(300):
        counts = {rnd.randrange(1, 9): rnd.randrange(1, 40) for _ in range(rnd.randrange(1, 5))}
        target = rnd.randrange(sum(s * n for s, n in counts.items()) + 3)
        near, far = (splits.closest_subset(counts, target, direct_bits=b) for b in (1 << 23, 0))
        assert all(0 <= far[s] <= n for s, n in counts.items())
        assert sum(s * n for s, n in near.items()) == sum(s * n for s, n in far.items())


def test_linked_pairs_and_split(spark):
    a, b = "9a5122ac3664de2aa5956582c405fff9", "ff43bf19b4fa34e6f347517a9439d0cb"
    users = [(1, a), (2, f" {a.upper()} "), (3, f"urn:uuid:{b[:8]}-{b[8:12]}-{b[12:16]}-{b[16:20]}-{b[20:]}"), (4, "{" + b + "}"), (5, "0" * 32), (6, "0" * 32), (7, None), (8, "n/a"), (9, "n/a"), (1, a), (None, a)]
    df = spark.createDataFrame(users, "user_id long, external_id string")
    assert {(r.user_a, r.user_b) for r in splits.linked_pairs(df).collect()} == {(1, 2), (3, 4)}
    readers = spark.range(1, 101).withColumnRenamed("id", "user_id")
    _, groups = splits.person_groups(df, "user_id", "external_id", splits.Scratch(spark, "t"))
    got = splits.grouped_split(readers, groups, {"train": 0.8, "validation": 0.1, "test": 0.1})
    rows = {r.user_id: r.split for r in got.collect()}
    assert len(rows) == 100 and rows[1] == rows[2] and rows[3] == rows[4]
    assert Counter(rows.values()) == {"train": 80, "validation": 10, "test": 10}


# --- survivors ------------------------------------------------------------------------------------------------------


def brute_layers(points):
    layer = {}
    left = dict(points)
    k = 1
    while left:
        beats = lambda a, b: all(x >= y for x, y in zip(a, b)) and a != b
        front = [i for i, p in left.items() if not any(beats(q, p) for q in left.values())]
        for i in front:
            layer[i] = k
            del left[i]
        k += 1
    return layer


@pytest.mark.parametrize("n", [1, 20, 150])
def test_layers_equal_peeling(spark, n):
    rnd = random.Random(n)
    pts = {i: (rnd.randrange(4), rnd.randrange(6), rnd.randrange(6)) for i in range(n)}
    df = spark.createDataFrame([(1, *p, i) for i, p in pts.items()], "g long, a int, b int, c int, rec long")
    got = {r.rec: r.layer for r in survivor.skyline_layers(df, "g", ["a", "b", "c"], "rec", 3, chunk=16).collect()}
    assert got == {i: k for i, k in brute_layers(pts).items() if k <= 3}


EDITIONS = "book_id long, work_id long, title string, language_code string, num_pages int, publication_year int, publisher string, isbn13 string, ratings_count long, image_url string, updated_at timestamp_ntz"


def test_covers_and_survivors(spark):
    import datetime as dt

    d = lambda k: dt.datetime(2020, 1, k)
    rows = [
        (1, 10, "A", None, None, 2000, None, None, 5, "http://x.example/1.jpg", d(1)),
        (1, 10, "A", None, None, 2000, None, None, 90, None, d(2)),  # the later snapshot holds: no cover
        (2, 10, None, "eng", 100, None, "P", None, 7, "https://x.example/2.png?s=1", d(1)),
        (3, 10, "C", None, None, None, None, "978", -1, "http://x.example/3.jpg", d(3)),
        (4, 11, "D", None, None, None, None, None, 3, "http://x.example/4.jpg", d(1)),  # alone: no row
        (5, None, "E", None, None, None, None, None, 3, "http://x.example/5.jpg", d(1)),
    ] + [(100 + w, 200 + w // 2, "S", None, None, None, None, None, 1, "http://x.example/none.jpg", d(1)) for w in range(12)]
    df = spark.createDataFrame(rows, EDITIONS)
    assert {(r.work_id, r.book_id) for r in survivor.cover_editions(df).collect()} == {(10, 2)}
    s = {r.work_id: r for r in survivor.surviving_editions(df).collect()}
    assert set(s) == {10, 11, *range(200, 206)}
    assert (s[10].title, s[10].language_code, s[10].num_pages, s[10].publication_year, s[10].isbn13) == (s[10].title, "eng", 100, 2000, "978")
    assert s[10].title in ("A", "C") and s[10].cover == "https://x.example/2.png?s=1"
    assert survivor.cover_editions(df.limit(0)).count() == 0


# --- tokens and packing -----------------------------------------------------------------------------------------------


def test_tokens_equal_the_public_encoder(spark):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(3)
    alphabet = "abc déñжя\n\t 1234.,!?'…\U0001f600​<|endoftext|>"
    texts = ["", None, " ", "<|endoftext|>", "it's  fine\r\n\r\n", "a" * 5000, "﻿1\n"] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(400))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in tokens.encode(df, "doc_id", "text").collect()}
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}


def test_packing_places_everything_once(spark):
    rnd = random.Random(6)
    words = "river lantern coat bridge captain letter widow engine soup sky".split()
    texts = [" ".join(rnd.choices(words, k=rnd.randrange(0, 50))) for _ in range(400)] + ["word " * 700, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack(df, "doc_id", "text", capacity=64, window=400).collect()
    sizes = {r.doc_id: len(r.ids) for r in tokens.encode(df, "doc_id", "text").collect()}
    by_doc, by_box = defaultdict(int), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id] += r.n_tokens
        by_box[r.container].append((r.position, r.n_tokens))
        assert (r.piece > 0) <= (sizes[r.doc_id] > 64)
    assert dict(by_doc) == sizes
    for spans in by_box.values():
        end = 0
        for start, n in sorted(spans):
            assert start >= end
            end = start + n
        assert end <= 64
    assert sorted(by_box) == list(range(len(by_box)))
    assert sum(sizes.values()) / (64 * len(by_box)) > 0.85


def test_hilbert_neighbours_touch():
    import numpy as np

    cells = np.array(list(itertools.product(range(8), repeat=3))) << (packing.BITS - 3)
    key = packing.hilbert_key(cells)
    assert len(set(key.tolist())) == len(cells)
    path = (cells >> (packing.BITS - 3))[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# --- personal information ----------------------------------------------------------------------------------------------


def test_forms_are_found_and_times_are_not():
    text = "1\r\n00:01:02,681 --> 00:01:04,574\r\nTel. 555-0153, ask @night_owl38\r\n\r\n2\n00:01:05,000 -> 00:01:06,000\nI live at 91 Alderwood Lane. arlo_47 at pochta dot test\n"
    found = {(r[0], text[r[1] : r[2]]) for r in pii.scan(text, frozenset()) if r[0] in ("email", "address", "phone", "id_number")}
    assert found == {("phone", "555-0153"), ("address", "91 Alderwood Lane"), ("email", "arlo_47 at pochta dot test")}
    for bare in ("Invoice 5371.969.58", "The safe? 49-49-49.", "It was 12-05-1998, a Tuesday.", "Take Road 14 to Zanomgate.", "He paid $24,876 for that.", "ISBN 978-0-6586-6586-49"):
        assert not [r for r in pii.scan(bare, frozenset()) if r[0] in ("email", "address", "phone", "id_number")]


@pytest.mark.parametrize("email", ["arlo_47{at}pochta.test", "arlo_47 ( at ) pochta.test"])
def test_emails_in_any_brackets_are_found(email):
    text = f"Write to {email} today"
    assert [text[r[1] : r[2]] for r in pii.scan(text, frozenset()) if r[0] == "email"] == [email]


@pytest.mark.parametrize("gap", [" ", "\t", "\u00a0", "\u202f", "\r", "\r\n", "\n"])
def test_addresses_with_any_gap_and_of_any_length_are_found(gap):
    for want in (f"12{gap}Mill{gap}St", f"12{gap}{'Mill' * 60}{gap}Street"):
        text = f"1\n00:00:01,000 --> 00:00:02,000\nWe live at {want}.\n\n2\n00:00:03,000 --> 00:00:04,000\nNo. 7.\n"
        assert [text[r[1] : r[2]] for r in pii.scan(text, frozenset()) if r[0] == "address"] == [want]
    assert not [r for r in pii.scan("We met 0n Larch Street, remember?", frozenset()) if r[0] == "address"]


def test_emails_and_spoken_numbers_of_any_length_are_found():
    mail, spoken = "a" * 300 + "@" + "b" * 200 + ".test", ", ".join(["five"] * 40)
    text = f"Write to {mail} or say {spoken}."
    assert {(r[0], text[r[1] : r[2]]) for r in pii.scan(text, frozenset()) if r[0] != "pair"} == {("email", mail), ("phone", spoken)}


def _cues(lines):
    return [(i, f"1\n00:00:01,000 --> 00:00:02,000\n{t}\n") for i, t in enumerate(lines)]


def test_noise_is_not_learned_however_often_it_comes(spark):
    given, family = ["Marta", "Ilse", "Jonas", "Klara"], ["Wexarholt", "Calunmark", "Brinorfell", "Tarnuswyk"]
    lines = [f"Kennen Sie {g} {f}?" for g in given for f in family] + [f"Paging {g} {f}, please." for g in given for f in family]
    real = len(lines)
    lines += [f"Ask {g}. Winter comes." for g in given for _ in range(80)] + [f"The {f} Ferry doesn't run." for f in family for _ in range(80)]
    lines += [f"Ask {g} {f}. Or not." for g in given for f in family[:1]] + ["Paging Odette Quenasbrook, please."]
    docs = spark.createDataFrame(_cues(lines), "doc_id long, text string")
    known = spark.createDataFrame([(i, n, k) for i, (n, k) in enumerate([(g, "given") for g in given[:3]] + [(f, "family") for f in family[:3]])], "name_id int, name string, name_type string")
    names = {(r.doc_id, lines[r.doc_id][r.start_at - 32 : r.end_at - 32]) for r in pii.find(docs, known).filter("kind = 'name'").collect()}
    pairs = [(g, f) for g in given for f in family]
    want = {(i, " ".join(p)) for i, p in enumerate(pairs * 2)} | {(i + real + 640, f"{g} {family[0]}") for i, g in enumerate(given)} | {(len(lines) - 1, "Odette Quenasbrook")}
    assert names == want


def test_surroundings_turn_over_and_decide_numbers(spark):
    lines = [f"Паспорт {i:02d} {i:02d} № {123400 + i}." for i in range(30)] + [f"Паспорт {1000 + i} {223400 + i}." for i in range(20)] + [f"Паспорт {1000000000 + i}." for i in range(5)]
    lines += [f"Engine no. {i}/{i} B" for i in range(1000, 1040)] + [f"Serial {5550000000 + i}, made well." for i in range(40)]
    docs = spark.createDataFrame(_cues(lines), "doc_id long, text string")
    known = spark.createDataFrame([], "name_id int, name string, name_type string")
    found = {r.doc_id: r.kind for r in pii.find(docs, known).collect()}
    assert found == dict.fromkeys(range(55), "id_number")


def test_overlapping_pieces_are_settled(spark):
    rows = [(1, "name", 0, 9, 3), (1, "name", 5, 14, 4), (1, "name", 12, 20, 2), (1, "email", 40, 50, 0), (1, "phone", 45, 60, 0), (1, "phone", 60, 70, 0), (2, "name", 0, 9, 1)]
    df = spark.createDataFrame(rows, "k long, kind string, start_at long, end_at long, score int")
    assert {tuple(r) for r in pii._apart(df, "k").collect()} == {(1, "name", 5, 14), (1, "email", 40, 50), (1, "phone", 60, 70), (2, "name", 0, 9)}


def test_places_count_in_the_text_as_stored():
    clean_text = "Schön, schreib an ilse@pochta.test."
    broken = clean_text.encode("utf-8").decode("cp1252")
    (kind, start, end, *_), = [r for r in pii.scan(broken, frozenset()) if r[0] == "email"]
    assert broken[start:end] == "ilse@pochta.test" and start == clean_text.index("ilse") + 1


def test_names_are_learned_from_context(spark):
    given, family = ["Marta", "Ilse", "Jonas", "Klara"], ["Wexarholt", "Calunmark", "Brinorfell", "Tarnuswyk"]
    lines = [f"My name is {g} {f}." for g in given for f in family] + [f"The {g} Prize goes to Berlin." for g in given for _ in range(4)]
    lines += ["My name is Odette Quenasbrook."]
    docs = spark.createDataFrame([(i, f"1\n00:00:01,000 --> 00:00:02,000\n{t}\n") for i, t in enumerate(lines)] + [(900, None), (901, "")], "doc_id long, text string")
    known = spark.createDataFrame([(i, n, k) for i, (n, k) in enumerate([(g, "given") for g in given[:3]] + [(f, "family") for f in family[:3]])], "name_id int, name string, name_type string")
    found = pii.find(docs, known)
    names = {r.doc_id for r in found.filter("kind = 'name'").collect()}
    assert names == set(range(16)) | {len(lines) - 1}
    red = {r.doc_id: r.text for r in pii.redact(docs, found).collect()}
    assert red[0] == "1\n00:00:01,000 --> 00:00:02,000\nMy name is [NAME].\n" and red[900] is None and red[901] == ""


# --- linkage --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "title, want",
    [
        ("A SECRET REGIMENT FOR IMKE (KINDLE EDITION)", ("secret regiment for imke", "", 0, 0, 0)),
        ("Thornavhaven Cycle II", ("thornavhaven cycle", "", 2, 0, 0)),
        ("Ulmimoor Cycle (Vol 1)", ("ulmimoor cycle", "", 1, 0, 0)),
        ("Tarnarstead Inquiry 3: The Wooden Observatory", ("wooden observatory", "", 0, 0, 0)),
        ("Hollow Violin: Bestselling Fiction, The", ("hollow violin", "", 0, 0, 0)),
        ("&amp;quot;Feral Storm&amp;quot;", ("feral storm", "", 0, 0, 0)),
        ("The Copper Garden: A Novel", ("copper garden", "a novel", 0, 0, 0)),
        ("Summary of The Wexivfield Vineyard", ("summary of the wexivfield vineyard", "", 0, 1, 0)),
        ("The Mirror 3-Book Box Set", ("mirror 3 book box set", "", 0, 2, 0)),
        (None, ("", "", 0, 0, 0)),
    ],
)
def test_title_forms(title, want):
    assert linkage.title_form(title) == want


def test_author_forms():
    assert linkage.author_form("Rudovnick, Yvo") == ("rudovnick", "yvo")
    assert linkage.author_form("by Dr. Klara Pöliwénd (Author)") == ("poliwend", "klara")
    assert linkage.author_form("Dietmar Orlessen, Lasse Dremanlow") == ("orlessen", "dietmar")
    assert linkage.author_form(None) == ("", "")


def test_matching_prefers_the_same_book(spark):
    works = [(1, "The Broken Mirror", 9, False), (2, "The Broken Mirror", 4, False), (3, "Aldmoor Saga, Vol. 1", 5, False), (4, "Aldmoor Saga, Vol. 2", 5, False), (5, None, 1, False)]
    w = spark.createDataFrame([(i, t, None, None, c, n) for i, t, n, c in works], "work_id long, title string, original_title string, best_edition_title string, is_collection boolean, gr_ratings_count long")
    e = spark.createDataFrame([(1, [1], "9780306406157", None, "The Broken Mirror"), (2, [2], None, None, "The Broken Mirror"), (3, [1], None, None, "x"), (4, [1], None, None, "x"), (5, [2], None, None, "A Lost Tower")], "work_id long, author_ids array<long>, isbn13 string, isbn string, title string")
    a = spark.createDataFrame([(1, "Klara Holm"), (2, "Jonas Berg")], "author_id long, name string")
    az = [("P1", "THE BROKEN MIRROR (Kindle Edition)", "Holm, Klara", None, None), ("P2", "Broken Mirror, The", "J. Berg", None, None), ("P3", "The Broken Mirorr", None, "0306406152", None),
          ("P4", "Summary of The Broken Mirror", "Klara Holm", None, None), ("P5", "Aldmoor Saga: Book 2", "Klara Holm", None, None), ("P6", "The Broken Mirror", "Ivo Stein", None, None),
          ("P7", "A Lost Tower", "Jonas Berg", None, None), ("P8", "Other Thing", "X Y", "0306406152", None), ("P9", None, None, None, None), (None, "The Broken Mirror", "Klara Holm", None, None)]
    p = spark.createDataFrame(az, "parent_asin string, title string, author string, isbn10 string, isbn13 string")
    got = {r.parent_asin: r.work_id for r in linkage.match(p, w, e, a).collect()}
    assert got == {"P1": 1, "P2": 2, "P3": 1, "P5": 4, "P7": 5}


def test_titles_with_typos_and_shifted_blanks_are_candidates(spark):
    works = [(1, "Sunken Storm", 1), (2, "The Lamp of Halosmouth", 2), (3, "Yvos Anatomy", 1), (4, "Red Wolf", 3)]
    w = spark.createDataFrame([(i, t, None, None, False, 1) for i, t, _ in works], "work_id long, title string, original_title string, best_edition_title string, is_collection boolean, gr_ratings_count long")
    e = spark.createDataFrame([(i, [a], None, None, t) for i, t, a in works], "work_id long, author_ids array<long>, isbn13 string, isbn string, title string")
    a = spark.createDataFrame([(1, "Tamsin Rudarhurst"), (2, "Alban Hölemvik"), (3, "Jonas Berg")], "author_id long, name string")
    az = [("P1", "The SunkenS torm", "Tamsin Rudarhurst"), ("P2", "The Lamp of Halesmouth", "Alban Hölémvik"), ("P3", "Yvosanatomy", "Rudarhurst, Tamsin"), ("P4", "Red Wulf", "Jonas Berg"),
          ("P5", "The Lamp of Winter", "Alban Hölemvik"), ("P6", "The SunkenS torm", "Ivo Stein"), ("P7", "Sunken Strom", "T. Rudarhusrt")]
    p = spark.createDataFrame([(*x, None, None) for x in az], "parent_asin string, title string, author string, isbn10 string, isbn13 string")
    assert {r.parent_asin: r.work_id for r in linkage.match(p, w, e, a).collect()} == {"P1": 1, "P2": 2, "P3": 3, "P4": 4, "P7": 1}


def test_titles_with_unknown_tails_and_joined_names_are_found(spark):
    works = [(1, "The Salt Atlas", 1), (2, "The Salt Atlas Returns", 1), (3, "Red Wolf", 2)]
    w = spark.createDataFrame([(i, t, None, None, False, 1) for i, t, _ in works], "work_id long, title string, original_title string, best_edition_title string, is_collection boolean, gr_ratings_count long")
    e = spark.createDataFrame([(i, [a], None, None, t) for i, t, a in works], "work_id long, author_ids array<long>, isbn13 string, isbn string, title string")
    a = spark.createDataFrame([(1, "Silvan Caligvik"), (2, "Henrik Havokcairn")], "author_id long, name string")
    az = [("P1", "The Salt Atlas: A Nvel", "S. Caligvik"), ("P2", "The Salt Atlas (Larg Prnt)", "Silvan Caligvik"), ("P3", "Red Wolf", "HenrikHavokcairn"), ("P4", "The Salt Atlas Returns: A Nvel", "Silvan Caligvik"),
          ("P5", "The Salt Atlas: Box Set", "Silvan Caligvik"), ("P6", "The Salt Atlas: A Nvel", "Ivo Stein"), ("P7", "The Salt Atlas: Tarngate Journal 2019", None)]
    p = spark.createDataFrame([(*x, None, None) for x in az], "parent_asin string, title string, author string, isbn10 string, isbn13 string")
    assert {r.parent_asin: r.work_id for r in linkage.match(p, w, e, a).collect()} == {"P1": 1, "P2": 1, "P3": 3, "P4": 2}
    assert linkage.title_head("A: B") == "" and linkage.title_head(None) == "" and linkage.author_form("HENRIKHAVOK") == ("henrikhavok", "")


def test_exclusivity_projection_and_prox():
    import numpy as np

    y = linkage._prox_exclusive(np.array([0.9, 0.8, 0.2, 0.4]), np.array([0, 0, 1, 1]))
    assert y[:2].sum() == pytest.approx(1.0) and y[0] - y[1] == pytest.approx(0.1) and list(y[2:]) == [0.2, 0.4]
    v, up_w, up_s, down = np.array([0.3]), np.array([[2.0], [1.0]]), np.array([[1.0], [0.5]]), np.array([0.4])
    got = linkage._prox_unary(v, up_w, up_s, down, 2.0)[0]
    grid = np.linspace(0, 1, 100001)
    cost = 2 * np.maximum(0, 1 - grid) + np.maximum(0, 0.5 - grid) + 0.4 * grid + (grid - 0.3) ** 2
    assert got == pytest.approx(grid[cost.argmin()], abs=1e-4)


def test_queries_have_names():
    from folioforge.llm import queries

    assert {f"p{n}_found" for n in (1, 2, 3, 4, 6, 9)} | {"p7_ids", "p8_containers"} <= set(queries.queries())
    assert set(queries.oracle_sql()) <= set(queries.queries())
