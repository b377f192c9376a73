"""Inverted index: term counts, pruning, capped postings, keywords, summaries."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import clean_text, let, preview
from lectern.functions.tokens import index_terms
from lectern.runtime import cut

#: Defaults of an index build.
DEFAULTS = {"min_term_length": 2, "min_total_count": 2, "max_preview": 160, "max_term_chunks": 50, "max_chunk_ratio": 0.6, "ngram_sizes": (2,)}
KEY = ["book_id", "chunk_id"]


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The same for narrow rows: one aggregate over whole rows, combined before its shuffle; ties go to the greater row."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*(F.col(c) for c in order), *(F.col(c) for c in rest if c not in order))
    return df.groupBy(*keys).agg(F.max(ranked).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def live(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The latest delivery of each key by ``order``; nulls are oldest, ties go to the row that is last in the files.

    No text is shuffled: keys, order and place of each row (file and row
    number) are aggregated, and the few rows that a later delivery replaced are
    taken out by an anti-join on their place, whose table is small and
    broadcast while it stays under the session's threshold.  A DataFrame that isn't a scan
    of files has no places; there :func:`latest` is used.
    """
    try:
        placed = df.select("*", F.struct("_metadata.row_index", F.xxhash64("_metadata.file_path").alias("file")).alias("_at"))
    except AnalysisException:
        return latest(df, keys, *order)
    row = F.struct(*(F.col(c) for c in order), "_at")
    narrow = placed.select(*keys, row.alias("_r"))
    again = narrow.groupBy(*keys).agg(F.max("_r").alias("_best"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), "_best")
    same = [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)]
    old = cut(narrow.join(cut(again, "again"), reduce(and_, same)).where("_r._at <> _best._at").select("_r._at.*"), "old")
    return placed.join(old.select(F.struct("row_index", "file").alias("_at")), "_at", "left_anti").select(*df.columns)


def counted_terms(text: Column, *, min_length: int = 2, sizes: tuple[int, ...] = (2,)) -> Column:
    """``array<struct<term, count>>`` of one text. Counted inside the row: sorted, then by where a new term begins."""

    def of_sorted(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | (F.element_at(t, i) != F.element_at(t, F.greatest(i - 1, F.lit(1)))))
        return let(starts, lambda b: F.transform(b, lambda i, k: F.struct(F.element_at(t, i).alias("term"), (F.coalesce(F.try_element_at(b, k + 2), F.size(t) + 1) - i).cast("long").alias("count"))))

    none = F.array().cast("array<struct<term:string,count:bigint>>")
    return let(F.array_sort(index_terms(text, min_length=min_length, sizes=sizes)), lambda t: F.when(F.size(t) > 0, of_sorted(t)).otherwise(none))


def term_counts(chunks: DataFrame, *, min_length: int = 2, sizes: tuple[int, ...] = (2,)) -> DataFrame:
    """``book_id, chunk_id, term, count``; chunks without text have no term. Nothing is shuffled: a chunk's terms are counted in its row."""
    each = chunks.where("text IS NOT NULL").select(*KEY, F.explode(counted_terms(clean_text(F.col("text")), min_length=min_length, sizes=sizes)).alias("t"))
    return each.select(*KEY, "t.term", "t.count")


def pruned(counts: DataFrame, chunks: DataFrame, *, min_total: int = 2, max_ratio: float = 0.6) -> DataFrame:
    """Counts of the terms a book keeps: at least ``min_total`` hits, in at most the ``max_ratio`` of its chunks (one at least)."""
    size = chunks.groupBy("book_id").agg(F.countDistinct("chunk_id").alias("n"))
    stats = counts.groupBy("book_id", "term").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("df"))
    kept = stats.join(size, "book_id").where((F.col("total") >= min_total) & (F.col("df") <= F.greatest(F.lit(1), F.floor(F.col("n") * max_ratio)))).select("book_id", "term")
    return counts.join(kept, ["book_id", "term"], "left_semi")


def postings(kept: DataFrame, *, most: int = 50) -> DataFrame:
    """``book_id, term, chunk_id, count, rank``: the ``most`` chunks with the highest count of each term."""
    w = Window.partitionBy("book_id", "term").orderBy(F.desc("count"), "chunk_id")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("book_id", "term", "chunk_id", "count", "rank")


def keywords(kept: DataFrame, *, most: int = 10, collation: str | None = None) -> DataFrame:
    """``book_id, chunk_id, keywords``: the most frequent kept terms of each chunk, ties by term (binary order unless a collation is named)."""
    by = F.col("term") if collation is None else F.collate(F.col("term"), collation)
    w = Window.partitionBy(*KEY).orderBy(F.desc("count"), by, "term")
    top = kept.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    return top.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "term"))), lambda x: x["term"]).alias("keywords"))


def back_fill(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """Chunks with their ``keywords`` replaced; chunks without indexed terms get an empty list."""
    return chunks.drop("keywords").join(words, KEY, "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def chunk_index(chunks: DataFrame, kept: DataFrame, *, max_preview: int = 160) -> DataFrame:
    """Summary of each chunk: preview, its 20 most frequent terms and how many it has."""
    n = kept.groupBy(*KEY).agg(F.count(F.lit(1)).alias("term_count"))
    top = keywords(kept, most=20).withColumnRenamed("keywords", "terms")
    base = chunks.select(*KEY, "title", "section_title", "chunk_path", "char_count", preview(F.col("text"), max_preview).alias("preview"))
    return base.join(top, KEY, "left").join(n, KEY, "left").select(*base.columns, F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), F.coalesce("term_count", F.lit(0)).alias("term_count"))


def build(chunks: DataFrame, **options) -> dict[str, DataFrame]:
    """All tables of an index: ``postings``, ``chunk_index``, ``keywords``, ``summary``."""
    o = DEFAULTS | options
    if not 0 < o["max_chunk_ratio"] <= 1:
        raise ValueError("max_chunk_ratio must be above 0 and at most 1")
    if not set(o["ngram_sizes"]) <= {2, 3}:
        raise ValueError("ngram_sizes may hold 2 and 3")
    if o["max_preview"] < 40:
        raise ValueError("max_preview must be 40 or more")
    counts = cut(term_counts(chunks, min_length=o["min_term_length"], sizes=tuple(dict.fromkeys(o["ngram_sizes"]))), "counts")
    kept = cut(pruned(counts, chunks, min_total=o["min_total_count"], max_ratio=o["max_chunk_ratio"]), "kept")
    rows = postings(kept, most=o["max_term_chunks"])
    return {
        "postings": rows,
        "chunk_index": chunk_index(chunks, kept, max_preview=o["max_preview"]),
        "keywords": keywords(kept, collation="zh"),
        "summary": rows.groupBy("book_id").agg(F.countDistinct("term").alias("term_count"), F.count(F.lit(1)).alias("posting_count")),
    }
