from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.operators import segment as G


def test_sections(one):
    got = one(G.sections, "前言\n第一章：雾\n甲\n第二章：书房\n乙\n丙")
    assert [(s["title"], s["text"]) for s in got] == [("片段 1", "前言"), ("第一章：雾", "甲"), ("第二章：书房", "乙\n丙")]
    assert [(s["title"], s["text"]) for s in one(G.sections, "Chapter 1\nChapter 2\nx")] == [("Chapter 2", "x")]
    assert one(G.sections, None) == [] and one(G.sections, " \n ") == []


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["第一章：雾", "Chapter 2", "text here.", "", "  ", "## h", "1. one", "甲。乙", "x"]), max_size=8).map("\n".join), min_size=6, max_size=6))
def test_both_section_rules_agree(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", G.sections(F.col("t")).alias("s")).collect()
    for r in rows:
        assert [(s["title"], s["text"]) for s in r["s"]] == G.text_sections(texts[r["i"]])


def test_parts(one):
    assert one(lambda c: G.hard_parts(c, 3), "abcdefgh") == ["abc", "def", "gh"]
    assert one(G.sentence_parts, "甲。乙！丙") == ["甲。", "乙！", "丙"]
    assert one(lambda c: G.hard_parts(c, 3), "") == []


def test_merges():
    small = G.merge_small([("A", "a" * 100), ("B", "b" * 150), ("C", "c" * 450), ("D", "d" * 20)], 500, 300)
    assert [len(t) for _, t in small] == [258, 450, 20]
    n, parts = G.chunk_parts([("A", "a" * 100), ("B", "b" * 150), ("C", "c" * 450), ("D", "d" * 20)], 500, 300)
    assert n == 3 and [(t, len(b)) for t, _, b in parts] == [("A", 258), ("C", 478)]
    n, parts = G.chunk_parts([("X", "x" * 520), ("Y", "y" * 300)], 500, 300)
    assert [(t, len(b)) for t, _, b in parts] == [("X Part 1", 500), ("X Part 2", 328)]


def test_ids(spark):
    got = spark.createDataFrame([(7,), (1000,)], "n int").select(G.chunk_id(F.col("n")).alias("v")).collect()
    assert [r["v"] for r in got] == ["ch007", "ch1000"]


words = st.text(alphabet="ab。！ \n雾", min_size=1, max_size=400)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.just("T"), words), max_size=6))
def test_chunks_keep_the_text_within_the_limit(found):
    _, parts = G.chunk_parts(found, 500, 300)
    bare = lambda s: "".join(c for line in s.split("\n") if not line.startswith("## ") for c in line if not c.isspace())
    assert all(0 < len(b) <= 500 for *_, b in parts)
    assert "".join(bare(b) for *_, b in parts) == "".join("".join(t.split()) for _, t in found)


def test_segment_links_and_edges(spark):
    books = spark.createDataFrame([("a", "Chapter 1\n" + "x" * 900 + "\n\n" + "y" * 900), ("b", None), ("c", ""), ("d", "short")], "book_id string, text string")
    rows = G.segment(books, max_chars=1000).orderBy("book_id", "ord").collect()
    assert [(r["book_id"], r["chunk_id"], r["prev_id"], r["next_id"]) for r in rows] == [("a", "ch000", None, "ch001"), ("a", "ch001", "ch000", None), ("d", "ch000", None, None)]
    assert rows[0]["title"] == "Chapter 1 Part 1" and rows[0]["char_count"] == 900
    assert G.segment(books.where("false")).count() == 0


def test_limits():
    import pytest

    assert G.limits() == (4000, 1400) and G.limits(1000, 200) == (1000, 300)
    with pytest.raises(ValueError):
        G.limits(100)


def test_sample_book(spark):
    text = "第一章：雾\n\n清晨的城里有一层很薄的雾。人们穿过街口时，像从一页纸走到另一页纸。\n\n第二章：书房\n\n她把书摊开，决定只读一小段。这样故事不会一下子淹没她。\n"
    r = G.segment(spark.createDataFrame([("s", text)], "book_id string, text string"), max_chars=1000, min_chars=200).collect()
    assert len(r) == 1 and r[0]["title"] == "第一章：雾" and r[0]["char_count"] == 73 and r[0]["word_count"] == 59
    assert r[0]["chunk_hash"] == "83b7248374de36b3991f26c62ead736e1d083bec5b6ccb41ee883b2249997660"
