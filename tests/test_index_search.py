import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import index as I
from lectern.operators import search as S


@pytest.fixture(scope="module")
def fog(spark):
    rows = [("b", "ch000", 0, "fog fog city"), ("b", "ch001", 1, "fog city city"), ("b", "ch002", 2, "rain"), ("b", "ch003", 3, None)]
    return spark.createDataFrame(rows, "book_id string, chunk_id string, ord int, text string")


def found(df):
    return [(r["chunk_id"], r["score"]) for r in df.orderBy(F.desc("score"), "ord").collect()]


def test_default_ratio_prunes_all(fog):
    c = fog.where("text IS NOT NULL")
    kept = I.pruned(I.term_counts(c), c)
    assert kept.count() == 0
    got = S.keyword_search(S.one_query(fog.sparkSession, "fog"), I.postings(kept), c, indexed_only=False)
    assert found(got) == [("ch000", 6), ("ch001", 6)]


def test_full_ratio(fog):
    kept = I.pruned(I.term_counts(fog), fog, max_ratio=1.0)
    p = {(r["term"], r["chunk_id"]): (r["count"], r["rank"]) for r in I.postings(kept).collect()}
    assert p == {("fog", "ch000"): (2, 1), ("fog", "ch001"): (1, 2), ("city", "ch001"): (2, 1), ("city", "ch000"): (1, 2)}
    words = {r["chunk_id"]: r["keywords"] for r in I.back_fill(fog, I.keywords(kept)).collect()}
    assert words == {"ch000": ["fog", "city"], "ch001": ["city", "fog"], "ch002": [], "ch003": []}
    assert found(S.keyword_search(S.one_query(fog.sparkSession, "fog"), I.postings(kept), fog)) == [("ch000", 8), ("ch001", 6)]


def test_caps(fog):
    kept = I.pruned(I.term_counts(fog), fog, max_ratio=1.0)
    assert I.postings(kept, most=1).count() == 2
    with pytest.raises(ValueError):
        I.build(fog, max_chunk_ratio=2)
    with pytest.raises(ValueError):
        I.build(fog, ngram_sizes=(4,))
    assert I.build(fog.where("false").withColumn("title", F.lit("")).withColumn("section_title", F.lit("")).withColumn("chunk_path", F.lit("")).withColumn("char_count", F.lit(0)))["postings"].count() == 0


def test_exact_order_and_case(spark):
    rows = [("b", "ch000", 0, "KEY"), ("b", "ch001", 1, "KEY KEY  KEY"), ("c", "ch000", 0, "Fog")]
    c = spark.createDataFrame(rows, "book_id string, chunk_id string, ord int, text string")
    q = S.one_query(spark, "KEY")
    assert found(S.exact_search(q, c.where("book_id = 'b'"), limit=1, one_book=True)) == [("ch000", 105)]
    assert found(S.exact_search(q, c)) == [("ch001", 115), ("ch000", 105)]
    assert S.exact_search(S.one_query(spark, " "), c).count() == 0
    none = spark.createDataFrame([], "query_id int, book_id string")
    assert S.fallback_hits(S.one_query(spark, "FOG"), c, none).count() == 0


def test_highlight(spark):
    c = spark.createDataFrame([("b", "ch000", 0, "aa\nbb cc"), ("b", "ch001", 1, "bb cc"), ("c", "ch000", 0, "bb cc")], "book_id string, chunk_id string, ord int, text string")
    h = spark.createDataFrame([(1, "aa bb", "b"), (2, "bb cc", "b"), (3, "zz", "b"), (4, None, "b"), (5, "bb cc", None)], "query_id int, query string, book_id string")
    assert sorted((r["query_id"], r["chunk_id"]) for r in S.highlight_context(h, c).collect()) == [(1, "ch000"), (2, "ch000")]


def test_highlights_meet_chunks_by_their_parts(spark):
    r = random.Random(5)
    words = ["a", "bb", "灯笼", "c\U00020000d", "winter", "é", "archive"]
    texts = {(b, f"ch{n}"): "  ".join(r.choices(words, k=r.randint(1, 60))) for b in "xyz" for n in range(30)}
    cut_ = lambda t: t[(at := r.randrange(len(t))) : at + r.choice((1, 2, 5, 9, 11, 12, 13, 20, 31, 48, 70))]
    asked = [(n, cut_(texts[r.choice(list(texts))]), r.choice("xyz")) for n in range(400)] + [(400, "灯笼", "x"), (400, "nowhere", "x"), (401, "nowhere to be found, at any size", "y")]
    chunks = spark.createDataFrame([(b, c, int(c[2:]) // 2, t) for (b, c), t in texts.items()], "book_id string, chunk_id string, ord int, text string")
    got = S.highlight_context(spark.createDataFrame(asked, "query_id int, query string, book_id string"), chunks)
    flat = {k: " ".join(t.split()) for k, t in texts.items()}
    want = {}
    for n, q, book in asked:
        at = [(int(c[2:]) // 2, c, 100 + 5 * t.count(p)) for (b, c), t in flat.items() if b == book and (p := " ".join(q.split())) and p in t]
        want |= {n: min(at)} if at else {}
    assert {x["query_id"]: (x["ord"], x["chunk_id"], x["score"]) for x in got.collect()} == want and len(want) > 200
    # no join pairs all highlights with all chunks of a book
    keys = re.findall(r"Join \[([^\]]*)\], \[", got._jdf.queryExecution().executedPlan().toString())
    assert keys and all("," in k for k in keys)


def test_live_keeps_the_last_delivery(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 2, "c"), ("l", None, "d"), (None, 1, "e")], "k string, at int, v string")
    assert {(r["k"], r["v"]) for r in I.live(df, ["k"], "at").collect()} == {("k", "c"), ("l", "d"), (None, "e")}


def test_latest_delivery_of_files(spark, tmp_path):
    rows = [("b", "1", 1, "old"), ("b", "1", 3, "new"), ("b", "1", 2, "mid"), ("b", "2", None, "x"), ("b", "2", 5, "y"), (None, "3", 1, "p"), (None, "3", 2, "q"), ("b", "4", 7, "same"), ("b", "4", 7, "same"), ("b", "5", None, None)]
    df = spark.createDataFrame(rows, "book_id string, chunk_id string, at int, text string")
    want = {("b", "1", "new"), ("b", "2", "y"), (None, "3", "q"), ("b", "4", "same"), ("b", "5", None)}
    df.repartition(3).write.parquet(f"{tmp_path}/t")
    for source in (df, spark.read.parquet(f"{tmp_path}/t")):
        got = I.live(source, ["book_id", "chunk_id"], "at").collect()
        assert len(got) == 5 and {(r["book_id"], r["chunk_id"], r["text"]) for r in got} == want
    plan = I.live(spark.read.parquet(f"{tmp_path}/t"), ["book_id", "chunk_id"], "at")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan or "Broadcast" in plan  # no text is shuffled


def test_more_queries_than_a_block(spark):
    chunks = spark.createDataFrame([("b", "1", 0, "alpha 7 beta"), ("b", "2", 1, "beta 399 gamma"), ("c", "1", 0, None)], "book_id string, chunk_id string, ord int, text string")
    queries = spark.createDataFrame([(n, f"{n} " + ("beta" if n == 7 else "gamma")) for n in range(450)], "query_id int, query string")
    assert {(r["query_id"], r["chunk_id"]) for r in S.exact_hits(queries, chunks).collect()} == {(7, "1"), (9, "2"), (99, "2"), (399, "2")}
    none = spark.createDataFrame([(3, "b")], "query_id int, book_id string")
    got = S.fallback_hits(queries, chunks, none)
    assert {r["query_id"] for r in got.collect()} == set(range(450)) - {3}
    assert S.fallback_hits(queries.where("false"), chunks, none).count() == 0 and S.exact_hits(queries.where("false"), chunks).count() == 0
