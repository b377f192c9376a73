"""Registered queries of the corpus-preparation operators: ``pN_...`` for problem N."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import cutting, encodings, frequency, glyphs, markup, matching, mixing, packing, pii, sentences, tokens
from lectern.runtime import cut, ship, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_clean_chunks(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_pages(table(spark, d, "chunks"), ["book_id", "chunk_id"], "book_id", "text", latest="loaded_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_clean_chunks(spark, d).where("pieces > 0").select("book_id", "chunk_id").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return frequency.verdicts(table(spark, d, "postings")).where("verdict IS NOT NULL").select("term", "verdict")


def p2_term_counts(spark: SparkSession, d: str) -> DataFrame:
    return frequency.verdicts(table(spark, d, "postings"))


def p3_matches(spark: SparkSession, d: str) -> DataFrame:
    return matching.link(table(spark, d, "book_map"), ("entry_id", "weread_title", "weread_author"), table(spark, d, "books"), ("book_id", "title", "author"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_matches(spark, d).select("entry_id", "book_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return glyphs.alike_pairs(table(spark, d, "book_map"), "entry_id", "weread_title", table(spark, d, "books"), "book_id", "title")


def p4_titles(spark: SparkSession, d: str) -> DataFrame:
    books = table(spark, d, "books").select(F.lit("books").alias("origin"), F.col("book_id").alias("id"), "title")
    entries = table(spark, d, "book_map").select(F.lit("book_map").alias("origin"), F.col("entry_id").cast("string").alias("id"), F.col("weread_title").alias("title"))
    return glyphs.with_form(books.unionByName(entries), "title", "title_form")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    sample = table(spark, d, "sentence_sample").select("book_id", "chunk_id").distinct()
    asked = table(spark, d, "chunks").select("book_id", "chunk_id", "text").join(sample, ["book_id", "chunk_id"], "left_semi")
    return sentences.sentences(asked, ["book_id", "chunk_id"]).select("book_id", "chunk_id", "end_off").distinct()


def p5_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "chunks"), ["book_id", "chunk_id"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pieces(spark, d).where("piece_no = 1").select("book_id", "chunk_id")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return cutting.chunk_pieces(table(spark, d, "chunks"), table(spark, d, "import_profiles"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_restored(spark, d).select("book_id", "chunk_id", "field").distinct()


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    return encodings.damaged(table(spark, d, "chunks"), ["book_id", "chunk_id"], ["text", "preview"])


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = cut(tokens.token_counts(table(spark, d, "documents"), ["doc_id"]), "sizes")
    return packing.pack(sizes, "doc_id", "n_tokens", table(spark, d, "pack_capacities"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.summary(p8_containers(spark, d), table(spark, d, "pack_capacities"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


#: The key of the pseudonyms; a real one comes from a secret store.
PII_KEY = b"example key, replace"


def _names(spark: SparkSession, d: str) -> pii.Lexicon:
    return pii.learn(table(spark, d, "books"), "author", table(spark, d, "documents"), "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.items(table(spark, d, "documents"), ["doc_id"], "text", _names(spark, d), PII_KEY).drop("placeholder")


def p10_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.masked(table(spark, d, "documents"), ["doc_id"], "text", _names(spark, d), PII_KEY)


def _shipped(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {n: _shipped(f) for n, f in sorted(globals().items()) if n[0] == "p" and n[1].isdigit()}
