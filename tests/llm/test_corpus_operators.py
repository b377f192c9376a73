import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import frequency, matching, mixing, packing, pii, tokens

# ---- problem 2
POSTING = "book_id string, term string, chunk_id string, hit_count int, indexed_at timestamp_ntz, extra string"


def brute_counts(rows):
    last = {}
    for b, t, c, n, at, _ in rows:
        t = (t or "").strip(" \t　").lower()
        if t and n is not None and n >= 1:
            k = (b, c, t)
            last[k] = max(last.get(k, (datetime.min, 0)), (at or datetime.min, n))
    hits, seen = Counter(), Counter()
    for (_, _, t), (_, n) in last.items():
        hits[t] += n
        seen[t] += 1
    return {t: (hits[t], seen[t]) for t in hits}, len({k[:2] for k in last})


def test_term_counts_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(1)
    at = datetime(2025, 1, 1)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice(["the", "The ", " the", "x%d" % rnd.randrange(40), None, " ", "　雾"]), rnd.choice(["c1", "c2", "c3", "c4", None]), rnd.choice([1, 2, 3, 0, -1, None]), rnd.choice([None, at, at + timedelta(days=1)]), "e") for _ in range(600)]
    df = spark.createDataFrame(rows, POSTING)
    want, n = brute_counts(rows)
    for flush in (1 << 20, 3):
        monkeypatch.setattr(frequency, "FLUSH_TERMS", flush)
        counts, total = frequency.term_counts(df)
        assert {r["term"]: (r["hits"], r["records"]) for r in counts.collect()} == want and total == n
    marks = {r["term"]: r["verdict"] for r in frequency.verdicts(df).collect()}
    assert marks == {t: "rare" if h < 3 else "common" if s > 0.15 * n else None for t, (h, s) in want.items()}


def test_dictionary_is_dense_and_empty_is_empty(spark):
    df = spark.createDataFrame([(f"t{k % 50}",) for k in range(300)], "term string").repartition(5)
    assert sorted(r["id"] for r in frequency.dictionary(df).collect()) == list(range(50))
    assert frequency.verdicts(spark.createDataFrame([], POSTING)).count() == 0


# ---- problem 3
BOOKS = [
    ("b1", "The Quiet Harbour of Segruvoar", "Ysolde Gregruvoar", 1), ("b1-2", "The Quiet Harbour of Segruvoar_final", None, 1), ("b2", "A River for Sozaveick, Vol. 1", "Fenwin Bruponeis", 1), ("b3", "A River for Sozaveick, Vol. 2", "Fenwin Bruponeis", 1),
    ("b4", "在杳屿翠的钟表里", "澹台甲屿", 1), ("b5", "在杳屿翠的钟表里", "郏黍 编", 1), ("b6", "Тепобеск и паром, том 1", "ФЕНВИН ВОРАБЕСК", 1), ("b7", None, None, 1), ("b8", "Le Carnet Fêlé de Thitabrueth", "Quillan Kitotâick", 1), ("b9", "", "x", 1),
]
ENTRIES = [
    (1, "《THE QUIET HARBUOR of Segruvoar》 (revised edition)", "Gregruvoar, Ysolde"), (2, "a river for sozaveick II", "F. Bruponeis"), (3, "A River for Sozaveick, Volume 3", "Fenwin Bruponeis"), (4, "在杳屿翠的钟表里：一部长篇", "澹台甲屿 著"), (5, "Тепoбеск и пaром. книга 1", "автор Фенвин Ворабеск"),
    (6, "Le Carnet Fele de Thitabrueth.epub", None), (7, "Something Else", "Ysolde Gregruvoar"), (8, None, "x"), (9, "", None), (1, "《THE QUIET HARBUOR of Segruvoar》 (revised edition)", "Gregruvoar, Ysolde"), (10, "在杳屿翠的钟表里", "笪某"),
]


def test_matches(spark):
    b = spark.createDataFrame(BOOKS, "book_id string, title string, author string, score int")
    e = spark.createDataFrame(ENTRIES, "entry_id bigint, weread_title string, weread_author string")
    got = matching.link(e, ("entry_id", "weread_title", "weread_author"), b, ("book_id", "title", "author")).collect()
    assert {(r["entry_id"], r["book_id"]) for r in got} == {(1, "b1"), (1, "b1-2"), (2, "b3"), (4, "b4"), (5, "b6"), (6, "b8")}
    assert all(0.2 <= r["confidence"] <= 1 for r in got)
    assert matching.link(e, ("entry_id", "weread_title", "weread_author"), b.where("false"), ("book_id", "title", "author")).count() == 0
    assert matching.link(e.where("false"), ("entry_id", "weread_title", "weread_author"), b, ("book_id", "title", "author")).count() == 0


def test_candidates_lose_nothing_above_the_floor(spark):
    rnd = random.Random(3)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k * 7 % 26)}xyz{k}" for k in range(60)]
    make = lambda n, s: spark.createDataFrame([(f"{s}{k}", " ".join(rnd.sample(words, 4)), rnd.choice([None, "Ann " + rnd.choice(words)])) for k in range(n)], "id string, title string, author string")
    _, left = matching.forms(make(40, "l"), "id", "title", "author")
    _, right = matching.forms(make(80, "r"), "id", "title", "author")
    got = {(r["l"], r["r"]): (r["score"], r["self"]) for r in matching.candidates(left, right).collect()}
    lt = {r["form"]: {x["t"]: x["w"] for x in r["term"]} for r in left.collect()}
    rt = {r["form"]: {x["t"]: x["w"] for x in r["term"]} for r in right.collect()}
    cores = {r["form"]: r["core"] for r in right.collect()}
    n, mean = len(rt), sum(map(len, rt.values())) / len(rt)
    df = Counter(t for x in rt.values() for t in x)
    rare = {t: np.log(1 + (n - c + 0.5) / (c + 0.5)) ** matching.RARITY for t, c in df.items()}
    gain = {(f, t): w * (matching.K1 + 1) / (w + matching.K1 * (1 - matching.B + matching.B * len(x) / mean)) * rare[t] for f, x in rt.items() for t, w in x.items()}
    top = {}
    for (_, t), v in gain.items():
        top[t] = max(top.get(t, 0), v)
    less = lambda t: {t, *(t[:k] + t[k + 1 :] for k in range(2, len(t)))} if t[1] == "w" and len(t) >= 7 else set()
    unknown = np.log(1 + (n + 0.5) / 0.5) ** matching.RARITY
    slips = 0
    for a, x in lt.items():
        met, own = {}, 0.0
        for t in x:
            near = {u for u in df if u != t and less(u) & less(t)}
            slips += len(near)
            for u in near:
                met[u] = max(met.get(u, 0), matching.SLIP)
            if t in df:
                met[t] = 1.0
            if t[0] == "t":
                own += max([top[u] for u in near | {t} if u in top], default=unknown)
        full = {r: sum(f * gain[r, u] for u, f in met.items() if u in y) for r, y in rt.items()}
        kept = {r: x for r, x in full.items() if x >= matching.FLOOR * own * 1.000001 and x > 0}
        work = {}
        for r, x in kept.items():
            work[cores[r]] = max(work.get(cores[r], 0), x)
        least = sorted(work.values(), reverse=True)[: matching.TOP_K][-1] if work else 0
        for r, x in kept.items():
            if work[cores[r]] > least or len(work) <= matching.TOP_K:
                assert (a, r) in got and got[a, r][0] == pytest.approx(x) and got[a, r][1] == pytest.approx(own)
    assert slips


def test_curve_is_fitted_on_garbled_records_of_known_origin(spark):
    rnd = random.Random(6)
    words = [f"{a}{b}{c}" for a in ("lor", "mav", "tin", "gre") for b in ("an", "ib", "ul") for c in ("eth", "ock", "ash", "im")]
    books = spark.createDataFrame([(f"b{k}", " ".join(rnd.sample(words, 4)), f"{rnd.choice(words)} {rnd.choice(words)}") for k in range(400)], "id string, title string, author string")
    _, forms = matching.forms(books, "id", "title", "author")
    asked, origin = matching.probes(forms, 300)
    works = matching.candidates(asked, forms).groupBy("l", "core").agg(F.max("score").alias("score"), F.first("self").alias("self")).toPandas()
    fit, held = {k: v for k, v in origin.items() if k % 2}, {k: v for k, v in origin.items() if not k % 2}
    w = matching.fit_curve(works[works["l"].isin(fit)], fit)
    test = works[works["l"].isin(held)]
    for own in (True, False):  # with their own work in the index, and without it
        x = matching._features(test if own else test[test["core"] != test["l"].map(held)])
        p = 1 / (1 + np.exp(-(x["gap"] * w[0] + x["share"] * w[1] + w[2])))
        right = (x["core"] == x["l"].map(held)) == (p >= 0.5)
        assert right.mean() > 0.93 and abs(p.mean() - (x["core"] == x["l"].map(held)).mean()) < 0.06
    assert w[0] > 0 and w[1] > 0


@pytest.mark.parametrize("raw,core,volume", [("The Salt River, Vol. 3 (revised edition)", "the salt river", 3), ("沉没的庚竹紫（三）（精校）", "沉没的庚竹紫", 3), ("X of Y II.epub", "x of y", 2), ("Harbour, The", "the harbour", 0), ("The Last Archive (1)", "the last archive", 0), ("在里第２册", "在里", 2), ("A: a novel, Vol. 2", "a", 2)])
def test_title_forms(raw, core, volume):
    assert matching.title_form(matching.fold_many([raw])[0]) == (core, volume)


def test_likeness():
    a = lambda s: matching.author_forms(matching.fold_many([s])[0])
    assert matching.author_likeness(a("Ilbert Zellick"), a("Zellick, I.")) > 0.8 and matching.author_likeness(a("Ilbert Zellick"), a("Calder Brimsey")) == 0 and matching.author_likeness([], a("x y")) == 0.5
    assert matching.title_likeness("a ferry for x", "a river for x") == 0 and matching.title_likeness("the amber lantern", "the ambr lantern") > 0.9 and matching.title_likeness("琥珀甲", "琥珀乙") == 0


# ---- problem 8
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=120))
def test_packing_holds_every_item_once(sizes):
    z = np.array(sizes, np.int64)
    bins = packing.pack_sizes(z, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(z)))
    assert all(z[b].sum() <= 100 for b in bins)
    assert len(bins) <= max(1, len([b for b in packing.first_layout(z, 100) if b])) if len(z) else not bins


def fewest(sizes, capacity):
    """Least number of containers, by trying every layout."""
    best = [len(sizes)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for n in range(len(rooms)):
            if rooms[n] >= sizes[k] and rooms[n] not in rooms[:n]:
                place(k + 1, [*rooms[:n], rooms[n] - sizes[k], *rooms[n + 1 :]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best[0]


def test_local_search_saves_containers_and_comes_near_the_optimum():
    rnd, saved, over = random.Random(4), 0, 0
    for _ in range(150):
        z = np.array([rnd.randint(3, 12) for _ in range(11)])
        first, found = packing.first_layout(z, 20), packing.pack_sizes(z, 20)
        saved += len(first) - len(found)
        over += len(found) - fewest(z.tolist(), 20)
    assert saved >= 10 and over <= 8
    z = np.array([rnd.randint(1, 110) for _ in range(4000)])  # far more than forty items in a container of the larger size
    for cap in (256, 5000):
        first, found = packing.first_layout(z, cap), packing.pack_sizes(z, cap)
        assert len(found) < len(first) or len(first) == -(-int(z.sum()) // cap)
        assert len(found) <= 1.004 * z.sum() / cap + 1 and sorted(i for b in found for i in b) == list(range(len(z)))


def test_local_search_empties_a_container():
    z = np.array([6, 4, 5, 5, 7, 3, 6, 4])
    start = [[0, 2], [1, 3], [4, 7], [5, 6]]  # fills 11 of 12, 9, 11, 9
    assert len(packing.improve(z, start, 12)) == 4  # 40 tokens need 4
    z = np.array([5, 5, 4, 3, 3, 4])
    assert len(packing.improve(z, [[0, 2], [1, 5], [3, 4]], 12)) == 2  # one for one and moves


def test_pack_rows(spark):
    items = spark.createDataFrame([(k, s, "x") for k, s in enumerate([5, 25, 10, 0, None, 7, 7])] + [(None, 3, "x"), (6, 7, "x")], "doc_id bigint, n_tokens bigint, bin_id string")
    caps = spark.createDataFrame([(1, 10), (2, 30), (3, None), (4, 0)], "capacity_id int, max_tokens int")
    for shard in (5000, 2):
        rows = packing.pack(items, "doc_id", "n_tokens", caps, shard=shard).collect()
        assert {r["capacity_id"] for r in rows} == {1, 2}
        for cap, most in ((1, 10), (2, 30)):
            own = [r for r in rows if r["capacity_id"] == cap]
            fill = Counter()
            for r in own:
                fill[r["bin_id"]] += r["n_tokens"]
            assert max(fill.values()) <= most
            total = Counter()
            for r in own:
                total[r["doc_id"]] += r["n_tokens"]
            assert total == Counter({0: 5, 1: 25, 2: 10, 3: 0, 5: 7, 6: 14})
            split = {r["doc_id"] for r in own if r["piece_no"]}
            assert split == ({1} if cap == 1 else set())
            for d in split:
                parts = sorted((r["begin_token"], r["n_tokens"]) for r in own if r["doc_id"] == d)
                assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
    assert packing.summary(packing.pack(items, "doc_id", "n_tokens", caps), caps).count() == 2
    assert packing.pack(items.where("false"), "doc_id", "n_tokens", caps).count() == 0 and packing.pack(items, "doc_id", "n_tokens", caps.where("false")).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "a b", 9), (2, "", 9), (3, None, 9), (4, "雾" * 5000, 9)], "doc_id bigint, text string, n_tokens int")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df, ["doc_id"]).collect()}
    assert got[1] == 2 and got[2] == 0 and 3 not in got and got[4] >= 5000


# ---- problem 9
def test_mixture(spark):
    rnd = random.Random(5)
    vocab = {"a": ["river", "boat", "tide"], "b": ["lamp", "shelf", "ink"], "c": ["stone"], "z": ["other"]}
    rows, n = [], 0
    for s, k in (("a", 300), ("b", 120), ("c", 60), ("z", 80)):
        for _ in range(k):
            n += 1
            rows.append((n, " ".join(rnd.choice(vocab[s]) for _ in range(rnd.randint(5, 60))) + f" {n}", s, "x"))
    rows += [(1000 + k, " ".join(rnd.choice(vocab["b"]) for _ in range(30)) + f" {k}", None, "x") for k in range(10)]
    rows += [(2000, rows[0][1], "a", "x"), (2001, rows[0][1], None, "x"), (2002, None, "a", "x"), (2003, "", "a", "x"), (None, "no id", "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.1, 4), ("gone", 0.1, 2), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    used, shares = mixing.mixture(docs, targets)
    got = {r["source"]: r for r in shares.collect()}
    assert set(got) == {"a", "b", "c", "gone"} and got["gone"]["tokens"] == 0
    for s, want in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert got[s]["actual_share"] == pytest.approx(want / 0.9, abs=0.005)
    most = {"a": 2, "b": 3, "c": 4}
    copies = used.collect()
    assert all(1 <= r["copies"] <= most[r["source"]] for r in copies) and len({r["doc_id"] for r in copies}) == len(copies)
    by_text = Counter()
    text = {r[0]: r[1] for r in rows}
    for r in copies:
        by_text[text[r["doc_id"]]] += r["copies"]
    assert by_text[rows[0][1]] <= 2
    assert {r["source"] for r in copies if 1000 <= r["doc_id"] < 1010} <= {"b"}  # the classifier knows where they belong
    empty = mixing.mixture(docs, targets.where("false"))
    assert empty[0].count() == 0 and empty[1].count() == 0
    none = mixing.mixture(docs.where("false"), targets)
    assert none[0].count() == 0 and {r["actual_share"] for r in none[1].collect()} == {0.0}


def test_half_of_the_sources_unknown(spark):
    rnd = random.Random(9)
    vocab = {"a": "river boat tide harbour ferry oar".split(), "b": "lamp shelf ink paper desk quill".split(), "c": "stone hill road bridge gate wall".split()}
    rows = [(n, " ".join(rnd.choice(vocab[s]) for _ in range(rnd.randint(10, 80))) + f" {n}", s if n % 2 else None) for n, s in enumerate(rnd.choices("abc", [5, 3, 2], k=1200))]
    rows += [(5000 + n, " ".join(rnd.choice(vocab["a"] + vocab["b"]) for _ in range(40)) + f" {n}", None) for n in range(150)]  # memberships in between
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.4, 2), ("b", 0.35, 2), ("c", 0.25, 3)], "source string, target_share double, max_repeats int")
    used, shares = mixing.mixture(docs, targets)
    got = {r["source"]: r for r in shares.collect()}
    whole = sum(r["expected_tokens"] for r in got.values())
    for s, want in (("a", 0.4), ("b", 0.35), ("c", 0.25)):
        assert got[s]["expected_tokens"] / whole == pytest.approx(want, rel=0.01)
        assert got[s]["actual_share"] == pytest.approx(want, rel=0.01) and got[s]["tokens"] == pytest.approx(got[s]["expected_tokens"], rel=0.01)
    copies = {r["doc_id"]: r["copies"] for r in used.collect()}
    assert all(n <= 3 for n in copies.values()) and len({copies.get(5000 + n, 0) for n in range(150)}) > 1  # each text has a rate and a draw of its own


def test_draw_meets_the_fractions(spark):
    rnd = random.Random(2)
    rows = [(f"{n:05d}", n, rnd.randint(1, 40), "ab"[n % 2], None, n % 3, f, rnd.random() / f) for n, f in enumerate(rnd.choice([0.1, 0.5, 0.9]) for _ in range(3000))]
    df = spark.createDataFrame(rows, "key string, doc_id bigint, n_tokens bigint, domain string, p array<double>, base int, frac double, v double")
    got = mixing.draw(df).collect()
    assert all(r["copies"] - r["base"] in (0, 1) for r in got)
    for d in "ab":
        own = [r for r in got if r["domain"] == d]
        assert sum((r["copies"] - r["base"]) * r["n_tokens"] for r in own) == pytest.approx(sum(r["frac"] * r["n_tokens"] for r in own), rel=1e-3)
        for f in (0.1, 0.5, 0.9):
            part = [r["copies"] - r["base"] for r in own if r["frac"] == f]
            assert sum(part) / len(part) == pytest.approx(f, abs=0.07)


def test_classifier_on_held_out_rows():
    rnd = random.Random(2)
    vocab = {"a": "river boat tide harbour ferry", "b": "lamp shelf ink paper desk"}
    make = lambda s: " ".join(rnd.choice(vocab[s].split()) for _ in range(20))
    names, prior, like = mixing.fit_classifier([make(s) for s in "ab" * 40], list("ab" * 40))
    encode = tokens.encoding().encode_ordinary
    right = 0
    for s in "ab" * 50:
        h = np.bincount(np.array(encode(make(s)), np.int64) * 2654435761 % 4294967291 % mixing.FEATURES, minlength=mixing.FEATURES)
        right += names[int(np.argmax(prior + like @ h))] == s
    assert right >= 98


# ---- problem 10
PEOPLE = [f"{g} {f}" for g in ("Ilbert", "Thyra", "Calder", "Isaveth") for f in ("Gregruvoar", "Zozuhuen", "Flidimaick", "Bruponeis")] + [f"{g} {f}" for g in ("Фенвин", "Мирел") for f in ("Дабивоск", "Лепавоск", "Зенинеск")] + [s + x for s in ("佴", "澹台", "亓官", "缑", "霧峰", "砂渡") for x in ("晏岫", "杏", "霏梅", "灯也", "荷")]
RUNNING = ["the old ferryman sold a lamp near the mill, and dear readers came home. Der Lehrer kaufte die Mühle und das Fass. старый паромщик искал узкое окно. 灰衣的客人在里屋归还了一段关于果园的话，请把书寄给他，昨天来过。有事找他或者写信。" * 3]
LEX = pii.fit_lexicon(PEOPLE, RUNNING, ["Brimsey", "Iskander-Lohm"])
ITEMS = [
    ("email", "fen+books@desk.mill.test"), ("email", "fen＠post.example"), ("email", "fen (at) mail.ferry.example"), ("email", "fen at mail dot ferry dot example"), ("email", "FEN_A @ POST.EXAMPLE"), ("email", "a.b [at] shelf.invalid"),
    ("phone", "+49 30 23125727"), ("phone", "(303) 555-0118"), ("phone", "303.555.0189"), ("phone", "07700 900872"), ("phone", "555-0139 ext. 12"), ("phone", "06 39 98 70 85"), ("phone", "01.99.00.87.89"), ("phone", "500 00 00 51"), ("phone", "+34 500 000 185"), ("phone", "+7 (000) 555-47-80"), ("phone", "8 000 555 59 31"), ("phone", "（000）55509796"), ("phone", "１２００５５５４３８４"), ("phone", "００-００５５-8573"), ("phone", "+86 120 0555 2291"),
    ("id_number", "X00492988"), ("id_number", "964-49-1845"), ("id_number", "QQ 08 99 13 C"), ("id_number", "9 84 07 99 334 326 17"), ("id_number", "984079952992967"), ("id_number", "00076199-T"), ("id_number", "X-0083352-R"), ("id_number", "000.106.814-21"), ("id_number", "000-299-686 44"), ("id_number", "00 00 928213"), ("id_number", "990101196503135607"), ("id_number", "L0X005211"), ("id_number", "TZ0087418"),
    ("address", "Flat 7, 296 Chalk Lane, Grabraoraull QX8 1ZZ"), ("address", "208 Lantern Street, Apt. 4, Mabrethaum, ZZ 00588"), ("address", "P.O. Box 98, Moleoreick, ZZ 00025"), ("address", "Mühlenstraße 198a, 00738 Thopamoor"), ("address", "Am Alten Turm 70, 00429 Grolazeane"), ("address", "153 bis, rue du Phare, 00305 Kusebrien"), ("address", "184 quai du Moulin, 00557 Palaheona"), ("address", "Calle del Farol 39, 2.º B, 00724 Telabreell"), ("address", "Avda. del Reloj 170, 00459 Tusathiost"), ("address", "Rua do Farol, 282, 0021-916 Momineane"), ("address", "ул. Мельничная, д. 42, кв. 76, г. Топудоино"),
    ("name", "Ilbert Gregruvoar"), ("name", "Zozuhuen, Thyra"), ("name", "Calder R. Flidimaick"), ("name", "THYRA ZOZUHUEN"), ("name", "Ilbert Unknownname"), ("name", "Фенвин Дабивоск"), ("name", "Flidimaick Iskander-Lohm"),
]


@pytest.mark.parametrize("kind,item", ITEMS)
def test_items(kind, item):
    for text in (f"The old {item} is here.", f"Ask\n{item}\n", f"({item})", f"end: {item}."):
        a = text.index(item)
        assert pii.find_items(text, LEX, {}) == [(kind, a, a + len(item))], text


@pytest.mark.parametrize("text,found", [("请把书寄给佴晏岫，地址是汀兰省兰汀市镜子巷28弄107号。", [("name", "佴晏岫"), ("address", "汀兰省兰汀市镜子巷28弄107号")]), ("我们搬到了岩丙市河沿区镜子路213号4单元401室。", [("address", "岩丙市河沿区镜子路213号4单元401室")]), ("〒000-9555 苔原市灯町2-73-6の砂渡滩子に送ること。", [("address", "〒000-9555 苔原市灯町2-73-6"), ("name", "砂渡滩子")]), ("昨天亓官杏来过", [("name", "亓官杏")]), ("有事找缑杏或者fen@reader.test。", [("name", "缑杏"), ("email", "fen@reader.test")])])
def test_east_asian_items(text, found):
    assert [(k, text[a:b]) for k, a, b in pii.find_items(text, LEX, {})] == found


@pytest.mark.parametrize("text", ["ISBN 000-7-8012-7781-2, order 2024-0615-29", "pages 120-167, 2024-06-18 and 12.06.2024", "It cost 1.260,66 or 1 780,00", "Mark it as @ch46", "Shelf code 68-44-1077", "Mr. Brimsey and Dr. Iskander-Lohm met Ilbert in Gregruvoar", "Der Lehrer kaufte die Mühle", "", "version 6.83.3"])
def test_no_items(text):
    assert pii.find_items(text, LEX, {}) == []


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="0123456789", min_size=2, max_size=20))
def test_feistel_is_a_permutation(digits):
    made = pii.feistel(b"k", digits)
    assert len(made) == len(digits) and pii.unfeistel(b"k", made) == digits


def test_feistel_on_a_whole_domain():
    assert len({pii.feistel(b"k", str(n).zfill(3)) for n in range(1000)}) == 1000
    assert pii.feistel(b"k", "12345678") != pii.feistel(b"other", "12345678")
    days = {pii.permute_date(b"k", d.strftime("%Y%m%d")) for d in (datetime(1990, 1, 1) + timedelta(days=x) for x in range(400))}
    assert len(days) == 400 and all(datetime.strptime(d, "%Y%m%d") for d in days)


def test_pseudonyms_keep_their_format():
    p = pii.pseudonym(b"k", "+49 30 23125727")
    assert p.startswith("+49 ") and len(p) == 15 and p != "+49 30 23125727"
    body = "11010519491231002"
    own = pii.pseudonym(b"k", body + pii._check18(body), "id_number")
    assert len(own) == 18 and own[17] == pii._check18(own[:17]) and datetime.strptime(own[6:14], "%Y%m%d")


SAME = [("+1 555 123 4567", "+15551234567"), ("+1 555 123 4567", "(555) 123-4567"), ("+44 7700 900872", "07700 900872"), ("+44 (0)7700 900872", "+447700900872"), ("+7 000 555 59 31", "8 000 555 59 31")]


@pytest.mark.parametrize("a,b", SAME)
def test_spellings_of_one_number_are_linked(a, b):
    def national(x):
        return pii.phone_parts(pii.pseudonym(b"k", x))[1]

    assert national(a) == national(b) != pii.phone_parts(a)[1]
    assert pii.pseudonym(b"k", a).startswith(a[: a.find(" ")] if a[0] == "+" else "")


VALID = ["529.982.247-25", "52998224725", "112-233-445 95", "12345678-Z", "X-1234567-L", "255 08 14 168 025 38".replace(" ", ""), "11010519491231002X", "123 456 782", "501 964 843"]


@pytest.mark.parametrize("value", VALID)
def test_check_digits_stay_right(value):
    bare = lambda v: "".join(c for c in v if c.isalnum())
    made = pii.pseudonym(b"k", value, "id_number")
    assert pii.checked(bare(value)) and pii.checked(bare(made)) and made != value and len(made) == len(value)
    assert [c.isdigit() for c in made[:-1]] == [c.isdigit() for c in value[:-1]]
    assert bare(made) == bare(pii.pseudonym(b"k", bare(value), "id_number"))


def test_figures_are_no_identity_numbers():
    for text in ("It cost 100 200 300 in all", "lot 1234 5678 9012 was sold", "row 20 24 123456 of the list", "the invoice 123 456 789"):
        assert pii.find_items(text, LEX, {}) == []
    for text in ("My passport 20 24 123456 is here", "Documento: 100 200 300", "code 1234 5678 9018 here", "000 197 816"):
        assert [k for k, _, _ in pii.find_items(text, LEX, {})] == ["id_number"], text
    assert pii.find_items("990101199913105607 is no date", LEX, {}) == []


def test_tags_and_long_items():
    tag = lambda kind, v: pii.placeholder(kind, v, b"k")
    assert tag("email", "Fen (at) mail.ferry.example") == tag("email", "fen@mail.ferry.example") == tag("email", "fen at mail dot ferry dot example")
    assert tag("name", "Zozuhuen, Thyra") == tag("name", "THYRA ZOZUHUEN") != tag("name", "Thyra Other") and len(tag("name", "a b")) == 39
    long = "x" * 400 + "@" + "y" * 300 + ".example"
    assert pii.find_items(f"to {long} now", LEX, {}) == [("email", 3, 3 + len(long))]


def test_names_in_scripts_without_capitals():
    people = [f"{g} {f}" for g in ("आरव", "मीरा", "เทียนชัย", "มาลีวัน") for f in (("शर्मा", "वर्मा", "सिन्हा") if g[0] < "\u0e00" else ("ใจดีงาม", "รักเรียน", "ทองสุข"))]
    lex = pii.fit_lexicon(people, ["नदी के पास"], [])
    for text, name in (("कल मीरा वर्मा आई", "मीरा वर्मा"), ("เมื่อวานมาลีวัน ทองสุขมาที่นี่", "มาลีวัน ทองสุข")):
        a = text.index(name)
        assert pii.find_items(text, lex, {}) == [("name", a, a + len(name))]
    assert pii.find_items("मीरा नदी के पास", lex, {}) == []


def test_masked_rows(spark):
    docs = spark.createDataFrame([(1, "Call 303-555-0118 now. Ilbert Gregruvoar", "z"), (2, "Or 303-555-0118, Ilbert Gregruvoar", "z"), (3, None, "z"), (4, "", "z")], "doc_id bigint, text string, items string")
    people = spark.createDataFrame([(p,) for p in PEOPLE] + [(None,)], "author string")
    lex = pii.learn(people, "author", docs, "text")
    got = {r["doc_id"]: r for r in pii.masked(docs, ["doc_id"], "text", lex, b"k").collect()}
    first = got[1]["masked_text"].split()
    assert got[1]["masked_text"].startswith("Call [PHONE ") and first[2] in got[2]["masked_text"] and got[1]["items"] == got[2]["items"] == 2
    assert got[3]["masked_text"] is None and got[4]["masked_text"] == "" and got[3]["items"] == 0
    rows = pii.items(docs, ["doc_id"], "text", lex, b"k").where(F.col("doc_id") == 1).collect()
    assert [(r["pii_kind"], r["begin_off"], r["end_off"]) for r in rows] == [("phone", 5, 17), ("name", 23, 40)]
    assert pii.items(docs.where("false"), ["doc_id"], "text", lex, b"k").count() == 0


def test_lexicon_covers_all_rows_and_whole_texts(spark, monkeypatch):
    people = spark.createDataFrame([(p,) for p in PEOPLE], "author string")
    docs = spark.createDataFrame([(k, "the lamp " * 500 + f"harbour Dr. Brimsey {'岸' * 12}") for k in range(40)], "doc_id bigint, text string")
    monkeypatch.setattr(pii, "FIT_PEOPLE", 2)
    lex = pii.learn(people, "author", docs, "text")
    assert lex.given >= {"ilbert", "thyra", "calder", "isaveth", "фенвин"} and {"gregruvoar", "brimsey"} <= lex.family and {"澹台", "砂渡", "佴"} <= lex.surname
    assert "harbour" in lex.common and "岸" in lex.usual


ALONE = [
    "9 Chalk Lane, Grabraor 12345", "9 Chalk Lane, Grabraor, 12345", "9 Chalk Lane, Grabraor, ZZ 00588", "9 Chalk Lane, Grabraor QX8 1ZZ", "P.O. Box 98, Moleoreick 00025", "Am Turm 70, 00429 Grolazeane", "153, rue du Phare, 00305 Kusebrien", "Calle del Farol 39, 00724 Telabreell", "Rua do Farol, 282, 0021-916 Momineane", "ул. Мельничная, д. 42", "ул. Мельничная, д.42", "岩丙市镜子路213号",
    "000-9555苔原市灯町2-73-6", "000-9555 苔原市灯町2-73-6", "〒000-9555 苔原市灯町2-73-6",
]


@pytest.mark.parametrize("item", ALONE)
def test_every_form_of_address_is_found_alone(item):
    assert pii._ADDRESS.fullmatch(item) and pii._STREET.search(item)
    assert [(k, a, b) for k, a, b in pii.find_items(item, LEX, {}) if k == "address"] == [("address", 0, len(item))]


def test_classifier_is_fitted_on_whole_texts(spark, monkeypatch):
    rows = [(k, "same " * 900 + ("river boat tide " if k % 2 else "lamp shelf ink ") * 40, "ab"[k % 2]) for k in range(20)]
    docs = spark.createDataFrame([(k, f"{t}{k}", s) for k, t, s in rows], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    fitted = []
    fit = mixing.fit_classifier
    monkeypatch.setattr(mixing, "fit_classifier", lambda texts, *rest: fitted.extend(texts) or fit(texts, *rest))
    mixing.mixture(docs, targets)
    assert sorted(fitted) == sorted(r["text"] for r in docs.collect())
