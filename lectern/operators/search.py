"""Keyword search with two-stage ranking and fallback, exact search, highlights.

Queries are a DataFrame ``(query_id, query)``, so one plan answers one query
or many.  Windows are by query and book; the one by query alone, which picks
the best over all books, sees at most ``limit`` rows of a book, and each task
hands on its own best ``limit`` only.  Query sets are asked in blocks of a
bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.grams import EXACT, bit_set, fitting, holding, keyed
from lectern.functions.text import clean_text, inline, occurrences, search_preview
from lectern.functions.tokens import query_tokens, token_weight
from lectern.runtime import cut

#: Limits and score steps of a search.
LIMIT, MAX_PREVIEW, BOOST, EXACT_BASE, EXACT_STEP = 10, 220, 4, 100, 5
QUERY = ["query_id", "book_id"]


def one_query(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(0, text)], "query_id int, query string")


def tokens(queries: DataFrame) -> DataFrame:
    """``query_id, query, pos, token, weight``."""
    return queries.select("query_id", "query", F.posexplode(query_tokens(F.col("query"))).alias("pos", "token")).withColumn("weight", token_weight(F.col("token")))


def indexed_hits(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """``query_id, query, book_id, chunk_id, score, matched``: sums of count times weight over the postings of the tokens."""
    t = tokens(queries)
    hit = postings.select("book_id", "term", "chunk_id", "count").join(t, F.col("term") == F.col("token"))
    return hit.groupBy("query_id", "query", "book_id", "chunk_id").agg(
        F.sum(F.col("count") * F.col("weight")).alias("score"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("matched"),
    )


def _ranked(hits: DataFrame, within: list[str], most: int, *first) -> DataFrame:
    w = Window.partitionBy(*within).orderBy(*first, F.desc("score"), F.desc(F.size("matched")), "ord", "book_id", "chunk_id")
    return hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def keyword_search(queries: DataFrame, postings: DataFrame, chunks: DataFrame, *, limit: int = LIMIT, max_preview: int = MAX_PREVIEW, indexed_only: bool = True) -> DataFrame:
    """``query_id, book_id, chunk_id, ord, score, matched, preview`` of the best ``limit`` chunks of each query.

    In every book the ``max(5 * limit, 20)`` best by index score are read,
    those whose text holds the query as it stands gain ``BOOST``, and they are
    ranked again.  A book the index misses altogether is scanned.  Books
    without an index take part only if ``indexed_only`` is false.
    """
    meta = chunks.select("book_id", "chunk_id", "ord")
    hits = indexed_hits(queries, postings).join(meta, ["book_id", "chunk_id"])
    # late materialisation: the chunks still in the race are written down, so that Spark knows how few
    # they are and can join their bodies without shuffling every text
    first = cut(_ranked(hits, QUERY, max(5 * limit, 20)), "ranked")
    body = chunks.select("book_id", "chunk_id", F.col("text").alias("body"))
    read = first.join(body, ["book_id", "chunk_id"], "left")
    boosted = read.withColumn("score", F.col("score") + F.when(F.contains(clean_text(F.col("body")), F.col("query")) & (F.col("query") != ""), BOOST).otherwise(0))
    missed = fallback_hits(queries, chunks, first.select(*QUERY).distinct(), postings.select("book_id").distinct() if indexed_only else None)
    both = boosted.select("query_id", "query", "book_id", "chunk_id", "ord", F.col("score").cast("long").alias("score"), "matched", "body").unionByName(missed)
    per_book = _ranked(both, QUERY, limit)
    best = _ranked(per_book, ["query_id"], limit)
    return best.select("query_id", "book_id", "chunk_id", "ord", "score", "matched", search_preview(F.col("body"), F.col("query"), F.col("matched"), max_preview).alias("preview"))


def fallback_hits(queries: DataFrame, chunks: DataFrame, found: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """Scan of the books that ``found(query_id, book_id)`` has no hit in: 4 for the whole query plus the weight of each token a text holds.

    Each chunk learns which queries its book already answered (one row per
    book) and is asked the others of a block; no pairs of books and queries are made.
    """
    scope = chunks if books is None else chunks.join(books, "book_id", "left_semi")
    hit = found.groupBy("book_id").agg(F.collect_set("query_id").alias("answered"))
    scan = scope.select("book_id", "chunk_id", "ord", clean_text(F.col("text")).alias("body")).join(hit, "book_id", "left")
    out = []
    for block in _blocks(queries.select("query_id", "query", query_tokens(F.col("query")).alias("tokens")).where(F.size("tokens") > 0)):
        asked = F.array(*(F.struct(F.lit(r["query_id"]).alias("query_id"), F.lit(r["query"]).alias("query"), F.array(*map(F.lit, r["tokens"])).alias("tokens")) for r in block))
        weights = F.create_map(*(x for t in sorted({t for r in block for t in r["tokens"]}) for x in (F.lit(t), token_weight(F.lit(t)))))
        open_ = F.filter(asked, lambda q: F.contains(F.col("body"), q["query"]) | F.exists(q["tokens"], lambda t: F.contains(F.col("body"), t)))
        q = scan.select("*", F.explode(F.filter(open_, lambda x: ~F.coalesce(F.array_contains(F.col("answered"), x["query_id"]), F.lit(False)))).alias("q"))
        have = F.filter(F.col("q.tokens"), lambda t: F.contains(F.col("body"), t))
        rows = q.select("book_id", "chunk_id", "ord", "body", "q.query_id", "q.query", have.alias("have"))
        score = F.when(F.contains(F.col("body"), F.col("query")), BOOST).otherwise(0) + F.aggregate("have", F.lit(0), lambda acc, t: acc + F.element_at(weights, t))
        out.append(rows.select("query_id", "query", "book_id", "chunk_id", "ord", score.cast("long").alias("score"), F.when(F.size("have") > 0, F.col("have")).otherwise(F.array("query")).alias("matched"), "body"))
    if not out:
        return scan.select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), F.lit("").alias("query"), "book_id", "chunk_id", "ord", F.lit(0).cast("long").alias("score"), F.array(F.lit("")).alias("matched"), "body").where("false")
    return reduce(DataFrame.unionByName, out)


#: Queries of a block, at most; a block is part of the plan.
BLOCK = 200


def _blocks(queries: DataFrame) -> Iterator[list[Row]]:
    """A stated query set in blocks of a bounded size."""
    rows = queries.toLocalIterator()
    while block := list(islice(rows, BLOCK)):
        yield block


def exact_hits(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks whose text holds the query, white space aside: score 100 plus 5 for each occurrence.

    Every chunk is asked the queries of one block after the other.
    """
    c = chunks.where("text IS NOT NULL").select("book_id", "chunk_id", "ord", inline(F.col("text")).alias("body"))
    q = queries.withColumn("_q", inline(F.col("query"))).where("_q <> ''")
    kind = queries.schema["query_id"].dataType
    blocks = [F.array(*(F.struct(F.lit(r["query_id"]).cast(kind).alias("query_id"), F.lit(r["query"]).alias("query"), F.lit(r["_q"]).alias("_q")) for r in block)) for block in _blocks(q)]
    asked = [c.select("*", F.explode(F.filter(b, lambda x: F.contains(F.col("body"), x["_q"]))).alias("q")).select("book_id", "chunk_id", "ord", "body", "q.*") for b in blocks]
    pairs = reduce(DataFrame.unionByName, asked) if asked else c.join(q, F.lit(False)).select("book_id", "chunk_id", "ord", "body", "query_id", "query", "_q")
    return pairs.select("query_id", "query", "book_id", "chunk_id", "ord", (EXACT_BASE + EXACT_STEP * occurrences(F.col("body"), F.col("_q"))).cast("long").alias("score"), F.array("query").alias("matched"), "body")


def exact_search(queries: DataFrame, chunks: DataFrame, *, limit: int = LIMIT, max_preview: int = MAX_PREVIEW, one_book: bool = False) -> DataFrame:
    """Exact search: within a book the first ``limit`` chunks in order; over all books these are then ranked by score."""
    hits = exact_hits(queries, chunks)
    w = Window.partitionBy(*QUERY).orderBy("ord", "chunk_id")
    first = hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")
    best = first if one_book else _ranked(first, ["query_id"], limit)
    return best.select("query_id", "book_id", "chunk_id", "ord", "score", "matched", search_preview(F.col("body"), F.col("query"), F.col("matched"), max_preview).alias("preview"))


def highlight_context(highlights: DataFrame, chunks: DataFrame, *, max_preview: int = 260) -> DataFrame:
    """The first chunk, in order, of its book that holds each highlight ``(query_id, query, book_id)``.

    Highlights aren't compared with all chunks of their book: the parts of each
    text are looked up in a bit set of the passages, and the chunks left meet
    theirs by an equi-join on the part (see ``functions.grams``).  A short
    passage is its part; longer ones are verified in the text.
    """
    asked = highlights.select("query_id", "book_id", inline(F.col("query")).alias("_q")).where("_q <> '' AND book_id IS NOT NULL")
    passages = cut(asked.select("book_id", "_q").distinct(), "passages")
    bits = fitting(passages.count())
    spots = cut(keyed(passages, "book_id", "_q", bits), "spots")
    sizes = sorted(r["_size"] for r in spots.select("_size").distinct().collect())
    bodies = chunks.where("text IS NOT NULL AND book_id IS NOT NULL").select("book_id", "chunk_id", "ord", inline(F.col("text")).alias("body"))
    near = cut(holding(bodies, "book_id", "body", sizes, bit_set(spots, bits), bits), "near")
    place = F.min(F.struct("ord", "chunk_id")).alias("p")
    short = near.select("book_id", "ord", "chunk_id", F.explode("_parts").alias("_q")).groupBy("book_id", "_q").agg(place).join(spots.where(F.col("_size") <= EXACT).select("book_id", "_q"), ["book_id", "_q"])
    held = near.select("book_id", "ord", "chunk_id", "body", F.explode("_keys").alias("_key")).join(spots.where(F.col("_size") > EXACT).select("book_id", "_key", "_q"), ["book_id", "_key"]).where(F.contains("body", "_q"))
    long = held.groupBy("book_id", "_q").agg(place)
    first = short.select("book_id", "_q", "p").unionByName(long).select("book_id", "_q", F.col("p.ord").alias("ord"), F.col("p.chunk_id").alias("_c"))
    # several texts under one id: the one that stands first
    w = Window.partitionBy(*QUERY).orderBy("ord", "_c", "_q")
    best = asked.join(first, ["book_id", "_q"]).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("query_id", "book_id", "_q", "ord", "_c")
    text = near.select(F.col("book_id").alias("_b"), "chunk_id", F.col("ord").alias("_o"), "body")
    read = best.join(text, (F.col("book_id") == F.col("_b")) & F.col("_c").eqNullSafe(F.col("chunk_id")) & F.col("ord").eqNullSafe(F.col("_o")) & F.contains("body", "_q")).dropDuplicates(QUERY)
    score = (EXACT_BASE + EXACT_STEP * occurrences(F.col("body"), F.col("_q"))).cast("long")
    return read.select("query_id", "book_id", "chunk_id", "ord", score.alias("score"), search_preview(F.col("body"), F.col("_q"), F.array("_q"), max_preview).alias("preview"))


#: Fixed value: the place of a chunk the manifest doesn't know.
LAST = 2**31 - 1


def chunk_entries(manifest: DataFrame, index: DataFrame) -> DataFrame:
    """All chunks of manifest and index (full outer join by book and chunk), the index's value first where it says something.

    ``manifest`` has ``title, section_title, chunk_path, char_count, preview,
    ord``, ``index`` all but ``ord``.  A chunk without a title is named by its
    id, one the manifest doesn't know comes last.
    """
    text, cols = ("title", "section_title", "chunk_path", "preview"), ("title", "section_title", "chunk_path", "char_count", "preview")
    m = manifest.select("book_id", "chunk_id", *(F.col(c).alias(f"m_{c}") for c in cols), F.col("ord").alias("m_ord"))
    i = index.select("book_id", "chunk_id", *(F.col(c).alias(f"i_{c}") for c in cols))
    said = lambda c: F.coalesce(*(F.when(F.col(f"{side}_{c}") != ("" if c in text else 0), F.col(f"{side}_{c}")) for side in "im"))
    x = m.join(i, ["book_id", "chunk_id"], "full_outer")
    return x.select("book_id", "chunk_id", F.coalesce(said("title"), "chunk_id").alias("chunk_title"), said("section_title").alias("section_title"), said("chunk_path").alias("chunk_path"), F.coalesce(said("char_count"), F.lit(0)).alias("char_count"), F.coalesce("m_ord", F.lit(LAST)).alias("ord"), F.coalesce(said("preview"), F.lit("")).alias("preview"))
