"""Registered queries of the document library, each over its whole tables."""

from __future__ import annotations

import html
import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import names as N
from lectern.functions import text as T
from lectern.functions import tokens as K
from lectern.operators import index as I
from lectern.operators import link as L
from lectern.operators import search as S
from lectern.operators import segment as G
from lectern.operators import state as P
from lectern.runtime import cut, ship, table
from lectern.sources.decode import decoded
from lectern.sources.epub import epub_rows
from lectern.sources.html import html_text

Query = Callable[[SparkSession, str], DataFrame]
KEY = ["book_id", "chunk_id"]
#: The questions the registered searches ask.
KEYWORDS, BOTH, PHRASE, MISSED = "quiet lantern", "灯笼 winter archive", "a lantern that nobody wanted", "untied the 港口"
#: The head a book's file may have, in SQL: front matter, Chinese labels or English ones, by the length of its id.
HEADED = """CASE length(book_id) % 3 WHEN 0 THEN '---' || chr(10) || 'title: "' || coalesce(title, '') || '"' || chr(10) || 'author: ' || coalesce(author, '') || chr(10) || '---' || chr(10) || coalesce(source_path, '')
WHEN 1 THEN '书名：《' || coalesce(title, '') || '》' || chr(10) || '作者：' || coalesce(author, '') || chr(10) || coalesce(source_path, '') ELSE 'Title: ' || coalesce(title, '') || chr(10) || 'By ' || coalesce(author, '') || chr(10) || coalesce(source_path, '') END"""
#: Highlights, in SQL: those of readers, and a passage of every twentieth chunk of a book.
SPOTS = """SELECT CAST(doc_id AS VARCHAR(20)) AS doc_id, book_id, text FROM documents WHERE doc_kind = 'highlight' AND book_id IS NOT NULL
UNION ALL SELECT DISTINCT book_id || ' ' || chunk_id, book_id, substring(text, 31, 60) FROM chunks WHERE ord % 20 = 0 AND length(text) > 100"""


def _largest(chunks: DataFrame) -> str | None:
    """The book with the most chunks (ties: the first id); single-book queries are asked of it."""
    row = chunks.where("book_id IS NOT NULL").groupBy("book_id").count().orderBy(F.desc("count"), "book_id").first()
    return row and row["book_id"]


def _chunks(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Latest delivery of each chunk, with the asked columns only."""
    want = list(dict.fromkeys([*KEY, *(cols or ("title", "section_title", "ord", "chunk_path", "text", "char_count")), "loaded_at"]))
    return I.live(table(spark, d, "chunks").select(*want), KEY, "loaded_at").drop("loaded_at")


def _books(spark: SparkSession, d: str) -> DataFrame:
    return I.latest(table(spark, d, "books"), ["book_id"], "imported_at")


def _joined(c):
    return F.array_join(c, "|")


# ---- text functions
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


def inline_preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"), T.preview(F.col("text"), 160).alias("long_preview"))


def count_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.count_words(F.col("text")).cast("long").alias("words"))


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, "text").select(*KEY, T.content_hash(F.col("text")).alias("chunk_hash"))


def misdecode_score(spark: SparkSession, d: str) -> DataFrame:
    s = T.misdecode_score(F.col("text"))
    return _chunks(spark, d, "text").select(*KEY, s.cast("long").alias("score"), (s >= 20).alias("misdecoded"))


def chapter_titles(spark: SparkSession, d: str) -> DataFrame:
    lines = _chunks(spark, d, "text").select(*KEY, F.posexplode(F.split(T.clean_text(F.col("text")), "\n")).alias("line_no", "line"))
    return lines.where(T.is_chapter_title(F.col("line"))).select(*KEY, F.col("line_no").cast("long").alias("line_no"), "line", T.normalize_title(F.col("line")).alias("title"))


def truncated_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.truncated(F.col("text"), 400).alias("t")).select("doc_id", "t.text", "t.truncated")


def file_stems(spark: SparkSession, d: str) -> DataFrame:
    return _books(spark, d).select("book_id", T.file_stem(F.col("source_path")).alias("stem"))


def html_headings(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, "text").select(*KEY, T.html_heading(F.col("text")).alias("heading"))


def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, "text").select(*KEY, html_text(F.col("text")).alias("plain"))


def skippable_names(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d, "title").select(*KEY, T.skippable_name(F.regexp_replace(F.coalesce("title", F.lit("")), " ", "-")).alias("skipped"))


def document_metadata(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.infer_metadata(F.col("text"), F.col("book_id")).alias("m")).select("doc_id", "m.title", "m.author")


def header_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Title, author and body of files that name them in front matter or in their first lines."""
    b = _books(spark, d).select("book_id", "source_path", F.expr(HEADED.replace("chr(10)", "char(10)")).alias("text"))
    return b.select("book_id", T.infer_metadata(F.col("text"), F.col("source_path")).alias("m"), T.strip_front_matter(F.col("text")).alias("body")).select("book_id", "m.title", "m.author", "body")


def decoded_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every document written in UTF-8, with and without its mark, and in UTF-16, read back by the charset detection."""
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text", F.explode(F.array(*map(F.lit, ("UTF-8", "UTF-8-BOM", "UTF-16LE-BOM")))).alias("codec"))
    data = F.when(F.col("codec") == "UTF-8", F.encode("text", "UTF-8")).when(F.col("codec") == "UTF-8-BOM", F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).otherwise(F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
    return t.select("doc_id", "codec", decoded(data).alias("decoded"))


def _epub_of(doc_id: int, heading: str | None, author: str | None, body: str) -> bytes:
    """A small EPUB of one text: a cover, navigation, a style sheet, a missing item, two chapters."""
    esc = html.escape
    items = {"cover": ("cover.xhtml", "application/xhtml+xml", ""), "nav": ("n.xhtml", "application/xhtml+xml", "nav"), "css": ("s.css", "text/css", ""), "c1": ("c1.xhtml", "application/xhtml+xml", ""), "c2": ("sub\\part2.xhtml", "", "")}
    listed = "".join(f'<item id="{k}" href="{h}" media-type="{m}" properties="{p}"/>' for k, (h, m, p) in items.items())
    by = f"<dc:creator>{esc(author)}</dc:creator>" if author else ""
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>')
        z.writestr("OEBPS/p.opf", f'<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Doc {doc_id}</dc:title>{by}</metadata><manifest>{listed}</manifest><spine>{"".join(f'<itemref idref="{k}"/>' for k in ("cover", "nav", "gone", "css", "c1", "c2"))}</spine></package>')
        z.writestr("OEBPS/cover.xhtml", "<p>cover</p>")
        z.writestr("OEBPS/n.xhtml", "<p>nav</p>")
        z.writestr("OEBPS/c1.xhtml", f"<html><head><style>x</style></head><body>{f'<h2>{esc(heading)}</h2>' if heading else ''}<p>{esc(body)}</p></body></html>")
        z.writestr("OEBPS/sub/part2.xhtml", "<ul><li>a</li></ul>")
    return buf.getvalue()


def epub_sections(spark: SparkSession, d: str) -> DataFrame:
    """Every document written as an EPUB and read back: container, package, spine, headings, text."""
    t = table(spark, d, "documents").where("text <> ''").select("doc_id", "doc_kind", "source", T.inline(F.col("text")).alias("body"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": [f"doc-{i}.epub" for i in b["doc_id"]], "content": [_epub_of(*x) for x in b[["doc_id", "doc_kind", "source", "body"]].itertuples(index=False, name=None)]})

    return epub_rows(t.mapInPandas(write, "path string, content binary")).withColumn("section_no", F.col("section_no").cast("long"))


def html_like(spark: SparkSession, d: str) -> DataFrame:
    """Whether a document of each kind counts as HTML under each of some media types."""
    types = F.explode(F.array(F.lit("text/HTML; charset=utf-8"), F.lit("application/xhtml+xml"), F.lit("image/svg+xml"), F.lit(""), F.lit(None).cast("string"))).alias("media")
    return table(spark, d, "documents").select("doc_kind", types).distinct().select("doc_kind", "media", T.html_like(F.concat(F.col("media"), F.when(F.col("media") == "image/svg+xml", F.col("doc_kind")).otherwise(""))).alias("html"))


def safe_file_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "books").select("book_id", F.concat("title", F.lit('?:"a<b>|*. .')).alias("title")).distinct().select("book_id", "title", T.safe_file_name(F.col("title")).alias("name"), T.metadata_value(F.concat(F.lit(" “《"), "title", F.lit("》” "))).alias("value"))


def front_matter_stripped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.strip_front_matter(F.col("text")).alias("body"))


def safe_book_ids(spark: SparkSession, d: str) -> DataFrame:
    return _books(spark, d).select("book_id", N.book_id_of(F.col("title")).alias("safe_id"), N.title_key(F.col("title")).alias("title_key"), N.author_key(F.col("author")).alias("author_key"))


# ---- segmentation
def split_sections(spark: SparkSession, d: str) -> DataFrame:
    return G.section_rows(_chunks(spark, d, "text"), KEY).select(*KEY, F.col("section_no").cast("long").alias("section_no"), "title", "text")


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", F.posexplode(G.sentence_parts(T.clean_text(F.col("text")))).alias("n", "part"))
    return x.select("doc_id", F.col("n").cast("long").alias("n"), "part")


def hard_split(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", F.posexplode(G.hard_parts(T.clean_text(F.col("text")), 300)).alias("n", "part"))
    return x.select("doc_id", F.col("n").cast("long").alias("n"), "part")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("book_id"), "text")


def segment_documents(spark: SparkSession, d: str) -> DataFrame:
    return G.segment(_texts(spark, d), max_chars=1000).select("book_id", "chunk_id", "title", "section_title", "ord", "text", "char_count", "word_count", "preview", "chunk_hash", "prev_id", "next_id", "initial_chunks")


def chunk_links(spark: SparkSession, d: str) -> DataFrame:
    return G.links(_chunks(spark, d, "ord"))


def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.stats(_chunks(spark, d, "char_count")).select("book_id", *(F.col(c).cast("long").alias(c) for c in ("chunk_count", "total_chars", "average_chunk_chars", "min_chunk_chars", "max_chunk_chars")))


def short_chunks(spark: SparkSession, d: str) -> DataFrame:
    return G.short_chunks(_chunks(spark, d, "text"), 300).select("book_id", F.col("short_chunks").cast("long").alias("short_chunks"))


# ---- index
def _counts(spark: SparkSession, d: str, *cols: str) -> tuple[DataFrame, DataFrame]:
    c = _chunks(spark, d, *cols)
    return c, cut(I.term_counts(c), "counts")


def term_counts(spark: SparkSession, d: str) -> DataFrame:
    return I.term_counts(_chunks(spark, d, "text"))


def postings_pruned(spark: SparkSession, d: str) -> DataFrame:
    c, t = _counts(spark, d, "text")
    return I.pruned(t, c)


def postings_top50(spark: SparkSession, d: str) -> DataFrame:
    return I.postings(postings_pruned(spark, d)).select("book_id", "term", "chunk_id", "count", F.col("rank").cast("long").alias("rank"))


def chunk_keywords(spark: SparkSession, d: str) -> DataFrame:
    return I.keywords(postings_pruned(spark, d)).select(*KEY, _joined("keywords").alias("keywords"))


def keyword_back_fill(spark: SparkSession, d: str) -> DataFrame:
    c, t = _counts(spark, d, "ord", "text")
    return I.back_fill(c.select(*KEY, "ord"), I.keywords(I.pruned(t, c))).select(*KEY, F.col("ord").cast("long").alias("ord"), F.size("keywords").cast("long").alias("n_keywords"), _joined("keywords").alias("keywords"))


def chunk_index(spark: SparkSession, d: str) -> DataFrame:
    c, t = _counts(spark, d)
    x = I.chunk_index(c, I.pruned(t, c))
    return x.select(*KEY, "preview", F.col("term_count").cast("long").alias("term_count"), _joined("terms").alias("terms"))


def index_summary(spark: SparkSession, d: str) -> DataFrame:
    p = postings_top50(spark, d)
    return p.groupBy("book_id").agg(F.countDistinct("term").alias("term_count"), F.count(F.lit(1)).alias("posting_count"))


def postings_valid(spark: SparkSession, d: str) -> DataFrame:
    """Delivered postings as a search reads them: the last revision of each entry, valid ones only."""
    p = I.latest(table(spark, d, "postings").where("term IS NOT NULL AND chunk_id IS NOT NULL"), ["book_id", "term", "chunk_id"], "indexed_at")
    return p.where("hit_count > 0").select("book_id", "term", "chunk_id", F.col("hit_count").cast("long").alias("count"))


# ---- search
def query_tokens(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "book_map").select("entry_id", F.col("weread_title").alias("query")).where("query IS NOT NULL").distinct()
    x = q.select("entry_id", "query", F.posexplode(K.query_tokens(F.col("query"))).alias("pos", "token"))
    return x.select("entry_id", "query", F.col("pos").cast("long").alias("pos"), "token", K.token_weight(F.col("token")).cast("long").alias("weight"))


def _search(spark: SparkSession, d: str, query: str, **options) -> DataFrame:
    c, t = _counts(spark, d, "ord", "text")
    rows = S.keyword_search(S.one_query(spark, query), cut(I.postings(I.pruned(t, c)), "postings"), c, **options)
    return rows.select("book_id", "chunk_id", F.col("ord").cast("long").alias("ord"), "score", _joined("matched").alias("matched"), "preview")


def keyword_search_all(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, KEYWORDS)


def keyword_search_mixed(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, BOTH, limit=25)


def keyword_search_book(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d, "ord", "text")
    c = c.where(F.col("book_id") == F.lit(_largest(c)))
    rows = S.keyword_search(S.one_query(spark, KEYWORDS), cut(I.postings(I.pruned(I.term_counts(c), c)), "postings"), c)
    return rows.select("book_id", "chunk_id", F.col("ord").cast("long").alias("ord"), "score", _joined("matched").alias("matched"), "preview")


def keyword_fallback(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d, "ord", "text")
    none = spark.createDataFrame([], "query_id int, book_id string")
    hits = S.fallback_hits(S.one_query(spark, MISSED), c, none)
    return hits.select("book_id", "chunk_id", F.col("ord").cast("long").alias("ord"), "score", _joined("matched").alias("matched"))


def exact_search_all(spark: SparkSession, d: str) -> DataFrame:
    return S.exact_search(S.one_query(spark, PHRASE), _chunks(spark, d, "ord", "text")).select("book_id", "chunk_id", F.col("ord").cast("long").alias("ord"), "score", "preview")


def exact_search_book(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d, "ord", "text")
    c = c.where(F.col("book_id") == F.lit(_largest(c)))
    return S.exact_search(S.one_query(spark, PHRASE), c, one_book=True).select("book_id", "chunk_id", F.col("ord").cast("long").alias("ord"), "score", "preview")


def occurrence_count(spark: SparkSession, d: str) -> DataFrame:
    n = T.occurrences(T.inline(F.col("text")), F.lit("the"))
    return table(spark, d, "documents").select("doc_id", F.coalesce(n, F.lit(0)).cast("long").alias("n")).where("n > 0")


def highlight_context(spark: SparkSession, d: str) -> DataFrame:
    for name in ("documents", "chunks"):
        table(spark, d, name).createOrReplaceTempView(name)
    h = spark.sql(SPOTS).select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"), "book_id")
    return S.highlight_context(h, _chunks(spark, d, "ord", "text")).select(F.col("query_id").alias("doc_id"), "book_id", "chunk_id", F.col("ord").cast("long").alias("ord"), "score", "preview")


# ---- progress, notes, books
def progress_latest(spark: SparkSession, d: str) -> DataFrame:
    return P.latest_progress(table(spark, d, "progress_updates")).withColumn("current_themes", _joined("current_themes"))


def recent_books(spark: SparkSession, d: str) -> DataFrame:
    return P.recent_books(P.latest_progress(table(spark, d, "progress_updates")), 20)


def resume_books(spark: SparkSession, d: str) -> DataFrame:
    x = P.resume(P.latest_progress(table(spark, d, "progress_updates")), _chunks(spark, d, "title", "ord", "char_count"))
    return x.select("book_id", "chunk_id", "title", F.col("ord").cast("long").alias("ord"), F.col("char_count").cast("long").alias("char_count"), "last_read_at", "found")


def list_books(spark: SparkSession, d: str) -> DataFrame:
    return P.book_list(_books(spark, d), P.latest_progress(table(spark, d, "progress_updates")))


def index_status(spark: SparkSession, d: str) -> DataFrame:
    return _books(spark, d).groupBy(F.coalesce(F.when(F.col("index_status") != "", F.col("index_status")), F.lit("not_built")).alias("index_status")).agg(F.count(F.lit(1)).alias("books"))


def book_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The first 300 chunks of every book; the rank is limited before the shuffle."""
    c = _chunks(spark, d, "title", "section_title", "ord", "chunk_path", "char_count", "preview", "keywords")
    x = c.withColumn("_n", F.row_number().over(Window.partitionBy("book_id").orderBy("ord", "chunk_id"))).where("_n <= 300")
    return x.select("book_id", "chunk_id", "title", "section_title", F.col("ord").cast("long").alias("ord"), "chunk_path", F.col("char_count").cast("long").alias("char_count"), "preview", _joined(F.slice("keywords", 1, 20)).alias("keywords"))


def note_sections(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").where("doc_kind = 'note'")
    return P.note_sections(n, ["doc_id"]).select("doc_id", F.col("section_no").cast("long").alias("section_no"), "heading", "content")


def note_append(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "documents").where("doc_kind IN ('highlight', 'note') AND book_id IS NOT NULL").select("book_id", "doc_id", F.concat(F.lit("note "), F.col("doc_id").cast("string")).alias("heading"), T.inline(F.col("text")).alias("content"))
    return P.append_entries(e, ["book_id"], ["doc_id"])


def note_markdown_normal(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# n\r\n\r\n## 快速恢复区\r\n"), "text", F.lit("\n## 快速恢复区\n x  \n\n"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", P.normal_markdown(t).alias("markdown"))


def progress_deciding(spark: SparkSession, d: str) -> DataFrame:
    """The state of each book from its deciding updates alone: the same as from the whole log."""
    return P.latest_progress(P.deciding_updates(table(spark, d, "progress_updates"))).withColumn("current_themes", _joined("current_themes"))


def chunk_entries(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the manifests and of the delivered index together; the index's values come from its postings and the first delivery of a chunk."""
    first = table(spark, d, "chunks").groupBy("book_id", "chunk_id").agg(F.min(F.struct(F.coalesce("loaded_at", F.lit("9999-01-01").cast("timestamp_ntz")).alias("at"), F.coalesce("preview", F.lit("")).alias("preview"))).alias("f"))
    posted = table(spark, d, "postings").where("book_id IS NOT NULL AND chunk_id IS NOT NULL AND hit_count > 0").select("book_id", "chunk_id").distinct()
    index = posted.join(first, ["book_id", "chunk_id"], "left").select("book_id", "chunk_id", F.lit("").alias("title"), F.lit(None).cast("string").alias("section_title"), F.concat(F.lit("index/"), "chunk_id").alias("chunk_path"), F.lit(0).alias("char_count"), "f.preview")
    return S.chunk_entries(_chunks(spark, d, "title", "section_title", "chunk_path", "char_count", "preview", "ord"), index).withColumn("ord", F.col("ord").cast("long")).withColumn("char_count", F.col("char_count").cast("long"))


def _notes(spark: SparkSession, d: str) -> DataFrame:
    """The notes of all books after each got what its reader does last, and a section of its own for each theme."""
    b = P.note_skeleton(_books(spark, d))
    p = P.latest_progress(table(spark, d, "progress_updates")).where("book_id IS NOT NULL")
    new = p.select("book_id", F.lit(P.SECTIONS[1]).alias("heading"), F.coalesce("status", F.lit("")).alias("content"))
    own = p.select("book_id", F.explode(F.array_distinct("current_themes")).alias("t")).select("book_id", F.concat(F.lit("theme "), F.col("t")).alias("heading"), F.col("t").alias("content"))
    known = _books(spark, d).select("book_id")
    return P.upsert_section(b, new.unionByName(own).join(known, "book_id", "left_semi"))


def note_upserts(spark: SparkSession, d: str) -> DataFrame:
    return _notes(spark, d).select("book_id", "heading", F.col("ordinal").cast("long").alias("ordinal"), "content")


def note_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every note as one document, as it is read with a limit of 400 characters."""
    return P.note_markdown(_notes(spark, d), _books(spark, d)).select("book_id", T.truncated(F.col("markdown"), 400).alias("t")).select("book_id", "t.text", "t.truncated")


def note_skeletons(spark: SparkSession, d: str) -> DataFrame:
    return P.note_skeleton(_books(spark, d)).select("book_id", "heading", F.col("ordinal").cast("long").alias("ordinal"), "content")


# ---- links
def _external(spark: SparkSession, d: str) -> DataFrame:
    e = L.last_by_key(table(spark, d, "book_map").select("entry_id", "weread_title", "weread_author", "received_at"), "entry_id", "received_at")
    return e.select(F.col("entry_id").alias("ext_id"), F.col("weread_title").alias("title"), F.col("weread_author").alias("author"))


def link_scores(spark: SparkSession, d: str) -> DataFrame:
    return L.scores(_external(spark, d), _books(spark, d)).select("ext_id", "book_id", "score", _joined("matched_by").alias("matched_by"))


def link_decisions(spark: SparkSession, d: str) -> DataFrame:
    b = _books(spark, d)
    return L.decisions(L.scores(_external(spark, d), b), b).select("ext_id", "action", "book_id", "score", F.size("candidates").alias("candidates"))


def link_dedupe(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "book_map").where("weread_book_id IS NOT NULL").select("weread_book_id", "entry_id", "weread_title", "updated_at", "received_at")
    return L.last_by_key(m, "weread_book_id", "updated_at", "received_at", "entry_id").select("weread_book_id", "entry_id", "weread_title", "updated_at")


def link_remaining(spark: SparkSession, d: str) -> DataFrame:
    """Entries left after those of books with reading progress are taken out, by exact title."""
    read = table(spark, d, "progress_updates").select("book_id").distinct().join(_books(spark, d), "book_id").select(F.col("title").alias("weread_title")).where("weread_title IS NOT NULL").distinct()
    m = table(spark, d, "book_map").select("entry_id", "weread_title").where("weread_title IS NOT NULL").distinct()
    return L.remove(m, read, "weread_title").select("entry_id", "weread_title")


def _linked(spark: SparkSession, d: str) -> DataFrame:
    """External records whose title is that of a book, as links."""
    m = table(spark, d, "book_map").select(F.col("weread_book_id").alias("ext_id"), F.col("weread_title").alias("ext_title"), "weread_author")
    return m.join(_books(spark, d).select(F.col("title").alias("ext_title"), "book_id"), "ext_title").select("ext_id", "ext_title", "weread_author", "book_id").distinct()


def link_resolved(spark: SparkSession, d: str) -> DataFrame:
    """The local book of every external record: by id, else by title; of the others those marked pending wait."""
    links = _linked(spark, d).where("ext_id IS NOT NULL").groupBy("ext_id").agg(F.min(F.struct("book_id", "ext_title")).alias("x")).select("ext_id", "x.book_id", "x.ext_title")
    wanted = table(spark, d, "book_map").select("weread_book_id", "weread_title").distinct().select(F.xxhash64("weread_book_id", "weread_title").alias("query_id"), F.col("weread_book_id").alias("ext_id"), F.col("weread_title").alias("title"))
    pending = table(spark, d, "book_map").where("status = 'pending'").select(F.col("weread_book_id").alias("ext_id"), F.col("weread_title").alias("ext_title"))
    found = L.resolve(wanted, links, pending)
    return wanted.join(found, "query_id").select("ext_id", "title", "book_id", "mapping")


def link_open(spark: SparkSession, d: str) -> DataFrame:
    """External records left to score once those linked before are taken out, by key."""
    m = table(spark, d, "book_map").select("entry_id", L.link_key(F.col("weread_book_id"), F.col("weread_title"), F.col("weread_author")).alias("key")).distinct()
    done = _linked(spark, d).select(L.link_key(F.col("ext_id"), F.col("ext_title"), F.col("weread_author")).alias("key")).distinct()
    return L.remove(m, done, "key").select("entry_id", "key")


def link_keys(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "book_map").select("entry_id", "weread_book_id", "weread_title", "weread_author").distinct()
    return m.select("entry_id", L.link_key(F.col("weread_book_id"), F.col("weread_title"), F.col("weread_author")).alias("link_key"))


_QUERIES = (
    clean_text, inline_preview, count_words, content_hash, misdecode_score, chapter_titles, truncated_text, file_stems, html_headings, html_to_text, skippable_names, document_metadata, header_metadata, decoded_texts, epub_sections, html_like, safe_file_names, front_matter_stripped, safe_book_ids,
    split_sections, sentence_split, hard_split, segment_documents, chunk_links, chunk_stats, short_chunks,
    term_counts, postings_pruned, postings_top50, chunk_keywords, keyword_back_fill, chunk_index, index_summary, postings_valid,
    query_tokens, keyword_search_all, keyword_search_mixed, keyword_search_book, keyword_fallback, exact_search_all, exact_search_book, occurrence_count, highlight_context,
    progress_latest, recent_books, resume_books, list_books, index_status, book_manifest, note_sections, note_append, note_markdown_normal, note_upserts, note_documents, note_skeletons, progress_deciding, chunk_entries,
    link_scores, link_decisions, link_dedupe, link_remaining, link_resolved, link_open, link_keys,
)


def _shipped(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {f.__name__: _shipped(f) for f in _QUERIES}
