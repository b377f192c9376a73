from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import tokens as K
from lectern.functions.names import author_form, safe_book_id, title_form
from lectern.operators import segment as G


def test_clean_text(one):
    assert one(T.clean_text, "a \t\r\n\t b\0\n\n\n\nc  d") == "a\nb\n\nc d"
    assert one(T.clean_text, None) == "" and one(T.clean_text, "　\xa0x﻿") == "x"


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="a \t\r\n\0\xa0　雾x", max_size=30), min_size=8, max_size=8))
def test_clean_text_agrees_with_the_batch_rule_and_is_idempotent(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.clean_text(F.col("t")).alias("c"), T.clean_text(T.clean_text(F.col("t"))).alias("cc")).collect()
    for r in rows:
        assert r["c"] == G.clean(texts[r["i"]]) == r["cc"]


def test_chapter_titles(one):
    for yes in ("第一章：雾", "Chapter IV", "chapter 3: Fog", "1. item", "## h2", "Chapter IVx"):
        assert one(T.is_chapter_title, yes), yes
    for no in ("第一章。", "plain", "#x", "x", "## " + "y" * 79, None):
        assert not one(T.is_chapter_title, no), no


def test_counts(one):
    assert one(T.count_words, "清晨city的かな") == 6
    assert one(lambda c: T.occurrences(T.inline(c), F.lit("aa aa")), "aa aa  aa") == 1
    assert one(lambda c: T.occurrences(c, F.lit("aa")), "aaaa") == 2
    assert one(lambda c: T.occurrences(c, F.lit("")), "x") == 0
    assert one(T.misdecode_score, "") == 1000 and one(T.misdecode_score, "�Ã\x01") == 42


def test_search_preview(one):
    mid = one(lambda c: T.search_preview(c, F.lit("KEY"), F.array(F.lit("KEY")), 100), "x" * 300 + "KEY" + "y" * 300)
    assert mid == "……" + "x" * 50 + "KEY" + "y" * 47 + "……"
    head = one(lambda c: T.search_preview(c, F.lit("KEY"), F.array(F.lit("KEY")), 80), "0123456789KEY" + "z" * 200)
    assert head == ("0123456789KEY" + "z" * 200)[:80] + "……"
    assert one(lambda c: T.search_preview(c, F.lit("q"), F.array(F.lit("r")), 80), "abc") == "abc"
    assert one(lambda c: T.search_preview(c, F.lit("q"), F.array(F.lit("r")), 80), None) == ""


def test_query_tokens(one):
    assert one(K.query_tokens, "Fog city-life 雾 书房") == ["fog", "city-life", "书房"]
    assert one(K.query_tokens, "清晨的") == ["清晨的", "清晨", "晨的"]
    assert one(K.query_tokens, "the") == ["the"] and one(K.query_tokens, None) == []
    weights = [one(K.token_weight, t) for t in ("fog", "清晨的", "清晨")]
    assert weights == [2, 2, 1]


def test_metadata(one):
    got = one(lambda c: T.infer_metadata(c, F.lit("/x/stem.md")), '---\ntitle: "T"\nauthor: A\n---\nbody')
    assert (got["title"], got["author"]) == ("T", "A")
    assert one(T.strip_front_matter, '---\ntitle: "T"\nauthor: A\n---\nbody') == "body"
    got = one(lambda c: T.infer_metadata(c, F.lit("a\\stem.txt")), "书名：《雾》\n作者：第一章\nBy Someone")
    assert (got["title"], got["author"]) == ("雾", "Someone")
    assert one(lambda c: T.infer_metadata(c, F.lit("a\\stem.txt")), None)["title"] == "stem"


def test_names():
    assert safe_book_id("  Fog_ Tales: II ") == "fog-tales-ii"
    assert title_form("薄雾[无限]") == "薄雾" and title_form("《薄雾（上）》.epub") == "薄雾上" and title_form(None) == ""
    assert title_form("薄雾epub") == "薄雾" and title_form("薄雾全集") == "薄雾全集" and title_form("A全集B") == "ab"
    assert author_form("作者：Ａ 君") == "a君"
