from datetime import datetime

from lectern.operators import link as L
from lectern.operators import state as P

BOOK = "book_id string, title string, author string"
EXT = "ext_id int, title string, author string"


def decide(spark, ext, books):
    b = spark.createDataFrame(books, BOOK)
    rows = L.decisions(L.scores(spark.createDataFrame([(0, *ext)], EXT), b), b).collect()
    return (rows[0]["action"], rows[0]["score"]) if rows else ("no-match", 0.0)


def test_link_goldens(spark):
    assert decide(spark, ("薄雾[无限]", None), [("薄雾", "薄雾", None)]) == ("linked", 0.95)
    assert decide(spark, ("Fog", None), [("fog-tales", "Fog Tales", None)]) == ("pending", 0.75)
    assert decide(spark, ("Fog", "A"), [("fog-tales", "Fog Tales", "A")]) == ("pending", 0.83)
    assert decide(spark, ("Fog Tales", "A"), [("fogtales", "Fog", "A")]) == ("linked", 0.88)
    assert decide(spark, ("fogtales", None), [("fogtales", "Rain", None)]) == ("no-match", 0.05)
    assert decide(spark, ("薄雾", None), [("x", "薄雾", None)]) == ("pending", 0.9)
    assert decide(spark, ("!!", None), [("x", "??", None)]) == ("no-match", 0.0)


def test_included_equals_brute_force(spark):
    short = ["a", "ab", "abc", "bcd", "xyz", "zz", "abcd", "雾", "城雾"]
    long = ["abcd", "zabc", "xyzz", "薄城雾", "b", "ab"]
    got = {(r["s"], r["l"]) for r in L.included(spark.createDataFrame([(s,) for s in short], "s string"), spark.createDataFrame([(x,) for x in long], "l string")).collect()}
    assert got == {(s, x) for s in short for x in long if s in x}


def test_scores_have_a_small_plan(spark):
    ext = spark.createDataFrame([(1, "Fog Tales", "A"), (2, "fog", None), (3, "x", None), (4, None, None), (5, "rain", None), (5, "rain", None)], EXT)
    b = spark.createDataFrame([("fogtales", "Fog", "A"), ("r", "Rain x", None), ("x", "??", None), ("r", "rain", None), ("rain", "Rain", None)], BOOK)
    got = L.scores(ext, b)
    # every exchange of a plan is a stage the driver plans anew: once 58 before it runs
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") < 30
    want = {(1, "fogtales", 0.88), (2, "fogtales", 0.9), (3, "r", 0.75), (3, "x", 0.05), (5, "r", 0.9), (5, "rain", 0.95)}
    rows = [(r["ext_id"], r["book_id"], r["score"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_equal_scores_by_title(spark):
    ext = spark.createDataFrame([(1, "fog", "A")], EXT)
    b = spark.createDataFrame([("a", "fog", "A"), ("b", "Fog", "A")], BOOK)
    scored = L.scores(ext, b)
    assert L.decisions(scored, b).first()["book_id"] == "b"
    assert L.decisions(scored, b, collation="zh").first()["book_id"] == "a"


def test_keyed_rows(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("l", 1, "c")], "k string, at int, v string")
    last = L.last_by_key(df, "k", "at")
    assert {(r["k"], r["v"]) for r in last.collect()} == {("k", "b"), ("l", "c")}
    new = spark.createDataFrame([("l", 3, "n")], "k string, at int, v string")
    assert {(r["k"], r["v"]) for r in L.upsert(last, new, "k").collect()} == {("k", "b"), ("l", "n")}
    assert [r["k"] for r in L.remove(last, new, "k").collect()] == ["k"]


UPDATES = "update_id bigint, book_id string, last_chunk_id string, next_chunk_id string, status string, current_themes array<string>, note_path string, last_read_at timestamp_ntz, received_at timestamp_ntz"


def test_progress(spark):
    t = [datetime(2025, 1, d) for d in (1, 2, 3, 4)]
    rows = [(1, "b1", "ch000", None, "reading", [" a ", "", None], None, t[0], t[0]), (2, "b2", None, None, "", None, None, t[1], t[1]), (3, "b1", "", "ch002", None, None, None, t[2], t[2]), (3, "b1", "", "ch002", None, None, None, t[2], t[2]), (4, None, "x", None, None, None, None, t[3], t[3])]
    p = P.latest_progress(spark.createDataFrame(rows, UPDATES))
    got = {r["book_id"]: r for r in p.collect()}
    assert (got["b1"]["last_chunk_id"], got["b1"]["next_chunk_id"], got["b1"]["status"], got["b1"]["current_themes"]) == ("ch000", "ch002", "reading", ["a"])
    assert got["b2"]["status"] is None and [r["book_id"] for r in P.recent_books(p).collect()] == ["b1", "b2"]
    c = spark.createDataFrame([("b1", "ch002", "t", 2, 9), ("b1", "ch005", "u", 5, 9)], "book_id string, chunk_id string, title string, ord int, char_count int")
    assert {(r["book_id"], r["chunk_id"], r["found"]) for r in P.resume(p, c).collect()} == {("b1", "ch002", True), ("b2", None, False)}
    asked = spark.createDataFrame([("b1", "ch005")], "book_id string, chunk_id string")
    assert [r["title"] for r in P.resume(p.where("book_id = 'b1'"), c, asked).collect()] == ["u"]


def test_notes(spark):
    md = "# T\n\n## 快速恢复区\ncontent at once\n\n## b\r\n\r\nx\n\ny\n\n### z\n"
    got = P.note_sections(spark.createDataFrame([(1, md), (2, None), (3, "no heading")], "id int, text string"), ["id"]).collect()
    assert [(r["id"], r["heading"], r["content"]) for r in got] == [(1, P.RECOVERY, "content at once"), (1, "b", "x\n\ny\n\n### z")]
    e = spark.createDataFrame([("n", 2, "h2", "c2"), ("n", 1, "h1", "c1"), ("n", 3, "h3", "x" * 20_001)], "k string, at int, heading string, content string")
    assert P.append_entries(e, ["k"], ["at"]).first()["content"] == "### h1\n\nc1\n\n### h2\n\nc2"
    books = spark.createDataFrame([("b", None, "A")], BOOK)
    skeleton = P.note_skeleton(books)
    assert [r["heading"] for r in skeleton.orderBy("ordinal").collect()] == list(P.SECTIONS)
    new = spark.createDataFrame([("b", "当前理解", "u"), ("b", "own", "o")], "book_id string, heading string, content string")
    merged = {r["heading"]: (r["ordinal"], r["content"]) for r in P.upsert_section(skeleton, new).collect()}
    assert merged["当前理解"] == (1, "u") and merged["own"] == (6, "o") and len(merged) == 7
    assert P.note_markdown(skeleton, books).first()["markdown"].startswith("# b\n\n## 阅读恢复区\n\n- localBookId: b\n")
