"""Reading a file-backed library folder: one directory per book, JSON state and Markdown notes.

Layout: ``reading/books/<id>/{manifest.json, search-index.json, chunks/*.md}``,
``reading/progress.json``, ``reading/book-map.json``, ``reading/notes/<id>.md``
(``reading/`` may be the folder itself).  Files are scanned in parallel; a file
that can't be parsed gives a warning row and nothing else.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.segment import clean
from lectern.operators.state import note_sections

Rows = Iterator[tuple]


def instant(value: object) -> datetime | None:
    """UTC time of an ISO string; None where it can't be read."""
    try:
        t = datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    except ValueError:
        return None
    return t.astimezone(UTC).replace(tzinfo=None) if t.tzinfo else t


def _number(x: object) -> int | None:
    return int(x) if isinstance(x, (int, float)) else None


def _text(x: object) -> str | None:
    return x if isinstance(x, str) else None


def manifest_rows(path: str, data: dict) -> Rows:
    """The chunk rows of a manifest, each with the book's columns."""
    stats = data.get("chunkStats") or {}
    index = data.get("index") or {}
    book = (_text(data.get("bookId")), _text(data.get("title")), _text(data.get("author")), _text(data.get("sourceType")), _text(data.get("sourcePath")), _text(data.get("sourceHash")), instant(data.get("importedAt")), _number(data.get("maxChars")), _number(data.get("minChars")), _number(data.get("sectionCount")), _number(data.get("totalChars")), _number(data.get("initialChunkCount")), _number(data.get("chunkCount")), _number(stats.get("averageChars")), _number(stats.get("minChunkChars")), _number(stats.get("maxChunkChars")), _text(index.get("status")) or "not_built", instant(index.get("updatedAt")))
    chunks = data.get("chunks") or []
    if not chunks:  # the book without a chunk
        yield (*book, *([None] * 13))
    for k, c in enumerate(chunks):
        words = [w for w in c.get("keywords") or [] if isinstance(w, str)]
        yield (*book, _text(c.get("id")), _text(c.get("title")), _text(c.get("sectionTitle")), _number(c.get("order")) if _number(c.get("order")) is not None else k, (_text(c.get("path")) or "").replace("\\", "/"), _number(c.get("charCount")), _number(c.get("wordCount")), _text(c.get("preview")), _text(c.get("chunkHash")), words, _text(c.get("summary")), _text(c.get("prevId")), _text(c.get("nextId")))


def posting_rows(path: str, data: dict) -> Rows:
    """Postings in either encoding: ``[chunkId, count]`` or ``{chunkId, count}``; entries without an id or a positive count are left out."""
    book = _text(data.get("bookId")) or re.sub(r".*/([^/]+)/[^/]+\Z", r"\1", path)
    for term, entries in (data.get("terms") or {}).items():
        rank = 0
        for e in entries or []:
            cid, n = (e[0], e[1]) if isinstance(e, list) and len(e) > 1 else (e.get("chunkId"), e.get("count")) if isinstance(e, dict) else (None, None)
            if cid and isinstance(n, (int, float)) and n > 0:
                rank += 1
                yield book, term, str(cid), int(n), rank


def progress_rows(path: str, data: dict) -> Rows:
    recent = [x.get("localBookId") if isinstance(x, dict) else x for x in data.get("recentBooks") or []]
    place = {b: len(recent) - k for k, b in reversed(list(enumerate(recent)))}
    for book, e in (data.get("books") or {}).items():
        themes = [t.strip() for t in e.get("currentThemes") or [] if isinstance(t, str) and t.strip()] if isinstance(e.get("currentThemes"), list) else []
        yield book, _text(e.get("lastChunkId")), _text(e.get("nextChunkId")), _text(e.get("status")), _text(e.get("notePath")), _text(e.get("lastPath")), _text(e.get("nextPath")), _text(e.get("lastSectionTitle")), _text(e.get("title")), _text(e.get("author")), themes, instant(e.get("lastReadAt")), place.get(book, 0)


def link_rows(path: str, data: dict) -> Rows:
    for kind in ("links", "pending"):
        for e in data.get(kind) or []:
            cand = [(c.get("localBookId"), float(c.get("score") or 0), [m for m in c.get("matchedBy") or []]) for c in e.get("candidates") or []]
            yield kind, _text(e.get("wereadBookId")), _text(e.get("wereadTitle")), _text(e.get("wereadAuthor")), _text(e.get("localBookId")), float(e.get("score") or 0), _text(e.get("status")), list(e.get("matchedBy") or []), [{"book_id": a, "score": s, "matched_by": m} for a, s, m in cand], instant(e.get("updatedAt"))


_BOOK = "book_id string, title string, author string, source_type string, source_path string, source_hash string, imported_at timestamp_ntz, max_chars int, min_chars int, section_count int, total_chars bigint, initial_chunk_count int, chunk_count int, average_chunk_chars int, min_chunk_chars int, max_chunk_chars int, index_status string, index_updated_at timestamp_ntz"
_CHUNK = "chunk_id string, chunk_title string, section_title string, ord int, chunk_path string, char_count int, word_count int, preview string, chunk_hash string, keywords array<string>, summary string, prev_id string, next_id string"
_POSTING = "book_id string, term string, chunk_id string, count bigint, rank int"
_PROGRESS = "book_id string, last_chunk_id string, next_chunk_id string, status string, note_path string, last_path string, next_path string, last_section_title string, title string, author string, current_themes array<string>, last_read_at timestamp_ntz, recency_seq bigint"
_LINK = "kind string, ext_id string, ext_title string, ext_author string, book_id string, score double, status string, matched_by array<string>, candidates array<struct<book_id:string,score:double,matched_by:array<string>>>, updated_at timestamp_ntz"


def _parsed(files: DataFrame, rows: Callable[[str, dict], Rows], schema: str) -> DataFrame:
    names = T._parse_datatype_string(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for path, data in zip(b["path"], b["content"]):
                try:
                    out += list(rows(path, json.loads(bytes(data).decode("utf-8-sig"))))
                except (ValueError, AttributeError, TypeError):
                    continue  # named by warnings()
            frame = pd.DataFrame(out, columns=names)
            for c in frame.columns:
                if f"{c} int" in schema or f"{c} bigint" in schema:
                    frame[c] = frame[c].astype("Int64")
            yield frame

    return files.mapInPandas(run, schema)


def _scan(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Files of one kind; none is an empty table, but a file that can't be read is an error."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{pattern}")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where):
        return spark.createDataFrame([], "path string, content binary")
    return spark.read.format("binaryFile").load(f"{root}/{pattern}").select("path", "content")


def read_folder(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Tables ``books, chunks, postings, progress, notes, links, pending`` of a file-backed library."""
    per_chunk = _parsed(_scan(spark, root, "books/*/manifest.json"), manifest_rows, f"{_BOOK}, {_CHUNK}")
    book_cols = T._parse_datatype_string(_BOOK).names
    books = per_chunk.select(*book_cols).dropDuplicates(["book_id"])
    bodies = _scan(spark, root, "books/*/chunks/*.md").select(F.regexp_extract("path", r"/books/([^/]+)/chunks/", 1).alias("book_id"), F.concat(F.lit("chunks/"), F.regexp_extract("path", r"([^/]+)\z", 1)).alias("chunk_path"), F.decode("content", "UTF-8").alias("raw"))

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["book_id", "chunk_path"]].assign(text=[clean(re.sub(r"\A#\s+.+\n*", "", clean(x))) for x in b["raw"]])

    text = bodies.mapInPandas(strip, "book_id string, chunk_path string, text string")
    cols = T._parse_datatype_string(_CHUNK).names
    chunks = per_chunk.where("chunk_id IS NOT NULL").select("book_id", *cols).withColumnRenamed("chunk_title", "title").join(text, ["book_id", "chunk_path"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    notes = _scan(spark, root, "notes/*.md").select(F.regexp_extract("path", r"([^/]+)\.md\z", 1).alias("book_id"), F.decode("content", "UTF-8").alias("text"))
    links = _parsed(_scan(spark, root, "book-map.json"), link_rows, _LINK)
    return {
        "books": books,
        "chunks": chunks,
        "postings": _parsed(_scan(spark, root, "books/*/search-index.json"), posting_rows, _POSTING),
        "progress": _parsed(_scan(spark, root, "progress.json"), progress_rows, _PROGRESS),
        "notes": note_sections(notes, ["book_id"]).select("book_id", "heading", F.col("section_no").alias("ordinal"), "content"),
        "links": links.where("kind = 'links'").drop("kind", "candidates"),
        "pending": links.where("kind = 'pending'").select("ext_id", "ext_title", "ext_author", "candidates", "updated_at"),
    }


def warnings(spark: SparkSession, root: str) -> DataFrame:
    """``path, problem`` of JSON files that can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bad = []
            for path, data in zip(b["path"], b["content"]):
                try:
                    if not isinstance(json.loads(bytes(data).decode("utf-8-sig")), dict):
                        bad.append((path, "no JSON object"))
                except ValueError as e:
                    bad.append((path, str(e)[:200]))
            yield pd.DataFrame(bad, columns=["path", "problem"])

    files = _scan(spark, root, "books/*/*.json").unionByName(_scan(spark, root, "*.json"))
    return files.mapInPandas(run, "path string, problem string")
