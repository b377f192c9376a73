"""The library: one folder of Parquet tables and the calls a reader makes on it.

Tables are written by bucket of their key.  A change writes new versions of the
buckets it touches and switches them by a pointer file, so a plan never reads
the files it replaces, a reader sees either state whole, and the call for one
book reads and writes one bucket.
Every method returns a DataFrame (or a small result object) and checks its
arguments first.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.names import book_id_of
from lectern.functions.text import search_preview, truncated
from lectern.operators import index as I
from lectern.operators import link as L
from lectern.operators import search as S
from lectern.operators import segment as G
from lectern.operators import state as P
from lectern.runtime import ship
from lectern.sources import files

#: Caps of replies.
MAX_MANIFEST_CHUNKS, MANIFEST_CHUNKS, RAW_CHARS, NOTE_CHARS, HIGHLIGHTS, INDEX_WARNING = 1000, 300, 200_000, 12_000, 5, 10 << 20
#: Buckets of a table by its key, and tasks that write one bucket of a large table.
BUCKETS, SPREAD = 64, 8
STATE_VARIABLE = "READING_STATE_DIR"

BOOKS = "book_id string, title string, author string, source_type string, source_path string, source_hash string, imported_at timestamp_ntz, max_chars int, min_chars int, section_count int, total_chars bigint, initial_chunk_count int, chunk_count int, average_chunk_chars int, min_chunk_chars int, max_chunk_chars int, index_status string, index_updated_at timestamp_ntz, index_options string"
CHUNKS = "book_id string, chunk_id string, title string, section_title string, ord int, chunk_path string, text string, char_count int, word_count int, preview string, chunk_hash string, keywords array<string>, summary string, prev_id string, next_id string"
POSTINGS = "book_id string, term string, chunk_id string, count bigint, rank int"
CHUNK_INDEX = "book_id string, chunk_id string, title string, section_title string, chunk_path string, char_count int, preview string, terms array<string>, term_count bigint"
PROGRESS = "book_id string, last_chunk_id string, next_chunk_id string, status string, note_path string, last_path string, next_path string, last_section_title string, title string, author string, current_themes array<string>, last_read_at timestamp_ntz, recency_seq bigint"
NOTES = "book_id string, heading string, ordinal int, content string"
LINKS = "key string, ext_id string, ext_title string, ext_author string, book_id string, score double, status string, matched_by array<string>, updated_at timestamp_ntz"
PENDING = "key string, ext_id string, ext_title string, ext_author string, candidates array<struct<book_id:string,score:double,matched_by:array<string>>>, updated_at timestamp_ntz"
TABLES = {"books": BOOKS, "chunks": CHUNKS, "postings": POSTINGS, "chunk_index": CHUNK_INDEX, "progress": PROGRESS, "notes": NOTES, "links": LINKS, "pending": PENDING}


@dataclass
class Result:
    """Outcome of a call that changes state."""

    ok: bool = True
    action: str = ""
    values: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def check_book_id(book_id: str | None) -> str:
    if not book_id or re.search(r"[/\\\0]", book_id):
        raise ValueError("book_id is required and may hold no slash, back slash or NUL")
    return book_id


def bucket_of(key: Column) -> Column:
    """Bucket of a row by its key; :meth:`Library._in` computes the same on the driver."""
    return F.pmod(F.crc32(F.coalesce(key, F.lit("")).cast("binary")), F.lit(BUCKETS)).cast("int")


def safe_join(base: str, *parts: str) -> str:
    """A path under ``base``; one that leads out of it is refused."""
    root = os.path.normpath(base)
    path = os.path.normpath(os.path.join(root, *(p.replace("\\", "/") for p in parts)))
    if path != root and not path.startswith(root.rstrip("/") + "/"):
        raise ValueError("the path leads out of the library")
    return path


def _scope(book_id: str | None, every: bool) -> str | None:
    if bool(book_id) == bool(every):
        raise ValueError("give either book_id or every=True")
    return check_book_id(book_id) if book_id else None


class Library:
    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        beside = os.path.join(os.path.dirname(os.getcwd()), "reading-state")
        root = root or os.environ.get(STATE_VARIABLE) or (beside if os.path.isdir(beside) else None)
        if not root:
            raise ValueError(f"give a root folder, set {STATE_VARIABLE} or make a folder reading-state beside the working one")
        self.spark, self.root = spark, root.rstrip("/")
        ship(spark)

    # ---- tables
    def _pointer(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/CURRENT")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def table(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """The current version of a table, or of some of its buckets; empty, with its schema, before anything was written."""
        parts = self._parts(name)
        paths = [f"{self.root}/{name}/{v}/_b={b}" for b, v in sorted(parts.items()) if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(T._parse_datatype_string(TABLES[name])).parquet(*paths)

    def write(self, name: str, df: DataFrame) -> None:
        """A new version of a whole table."""
        self._switch(name, self._stored(name, df))

    def _stored(self, name: str, df: DataFrame) -> dict[int, str]:
        """Writes rows by bucket of their key; a large bucket is spread over several tasks. Returns ``{bucket: version}``."""
        version = uuid.uuid4().hex
        schema = T._parse_datatype_string(TABLES[name])
        out = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema), bucket_of(F.col(schema.names[0])).alias("_b"))
        if name in ("chunks", "postings", "chunk_index"):
            out = out.repartition("_b", F.pmod(F.xxhash64("book_id", "chunk_id"), F.lit(SPREAD))).sortWithinPartitions("_b", "book_id")
        out.write.partitionBy("_b").parquet(f"{self.root}/{name}/{version}")
        fs, path = self._pointer(name)
        made = [f.getPath().getName() for f in fs.listStatus(path.getParent().suffix(f"/{version}")) if f.isDirectory()]
        return {int(m.removeprefix("_b=")): version for m in made if m.startswith("_b=")}

    def _switch(self, name: str, parts: dict[int, str]) -> None:
        """The pointer is renamed into place, so that it names the old parts or the new ones, never half of them.

        The parts before stay for readers that still use them; older ones are removed.
        """
        fs, path = self._pointer(name)
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        fresh = hadoop.Path(f"{self.root}/{name}/NEXT-{uuid.uuid4().hex}")
        used = {*self._parts(name).items(), *parts.items()}
        stream = fs.create(fresh, True)
        try:
            stream.writeUTF(json.dumps(parts))
        finally:
            stream.close()
        how = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        how[0] = getattr(hadoop, "Options$Rename").OVERWRITE
        full = fs.makeQualified(path)
        hadoop.FileContext.getFileContext(full.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(fresh), full, how)
        versions = {v for _, v in used}
        for f in fs.listStatus(path.getParent()):
            version = f.getPath().getName()
            if f.isDirectory() and version not in versions:
                fs.delete(f.getPath(), True)
            elif f.isDirectory():
                for g in fs.listStatus(f.getPath()):
                    part = g.getPath().getName()
                    if part.startswith("_b=") and (int(part.removeprefix("_b=")), version) not in used:
                        fs.delete(g.getPath(), True)

    def _parts(self, name: str) -> dict[int, str]:
        """``{bucket: version}`` of a table, as its pointer says."""
        fs, path = self._pointer(name)
        if not fs.exists(path):
            return {}
        stream = fs.open(path)
        try:
            return {int(b): v for b, v in json.loads(stream.readUTF()).items()}
        finally:
            stream.close()

    def _replace(self, name: str, new: DataFrame, keys: list[str] = ["book_id"], gone: DataFrame | None = None) -> None:  # noqa: B006
        """Rows of the same keys replaced (and those of the keys ``gone`` removed); only the buckets of these keys are written."""
        new = self._checkpointed(new.select(*T._parse_datatype_string(TABLES[name]).names))
        named = (new if gone is None else new.select(*keys).unionByName(gone.select(*keys))).select(*keys).distinct()
        touched = {r["b"] for r in named.select(bucket_of(F.col(keys[0])).alias("b")).distinct().collect()}
        if touched:
            old = self._parts(name)
            kept = self.table(name, touched).join(named, keys, "left_anti")
            self._switch(name, {b: v for b, v in old.items() if b not in touched} | self._stored(name, kept.unionByName(new)))

    def _remove(self, name: str, gone: DataFrame, keys: list[str] = ["book_id"]) -> None:  # noqa: B006
        self._replace(name, self.spark.createDataFrame([], TABLES[name]), keys, gone)

    # ---- import
    def import_books(self, path: str, *, title: str | None = None, author: str | None = None, book_id: str | None = None, max_chars: int | None = None, min_chars: int | None = None, build_index: bool = False, now: datetime | None = None) -> DataFrame:
        """Imports every supported file under ``path``; returns the new manifest rows.

        ``title``, ``author`` and ``book_id`` beat what the file says and are
        allowed for a single file only.  A book imported again replaces its
        chunks, and its index counts as not built.
        """
        most, least = G.limits(max_chars, min_chars)
        files.check(self.spark, path)
        found = files.books(self.spark, path).where("error IS NULL")
        n = found.count()
        if not n:
            raise ValueError(f"no readable book of kind {', '.join(files.KINDS)} under {path}")
        if n > 1 and (title or author or book_id):
            raise ValueError("title, author and book_id are for one file")
        when = F.lit(now or datetime.now(UTC).replace(tzinfo=None))
        name = F.coalesce(F.lit(title), F.when(F.col("title") != "", F.col("title")))
        own_id = F.lit(check_book_id(book_id)) if book_id else book_id_of(name)
        base = found.select(F.col("path").alias("source_path"), F.col("kind").alias("source_type"), name.alias("title"), F.coalesce(F.lit(author), "author").alias("author"), own_id.alias("book_id"), "original", F.size("sections").alias("section_count"))
        base = base.withColumn("book_id", F.when(F.col("book_id") != "", F.col("book_id")).otherwise(F.concat(F.lit("book-"), F.substring(F.sha2("source_path", 256), 1, 12))))
        base = I.latest(base, ["book_id"], "source_path")
        parts = G.segment(base, max_chars=most, min_chars=least, text="original")
        chunks = self._checkpointed(parts)
        size = chunks.groupBy("book_id").agg(F.first("initial_chunks").alias("initial_chunk_count"))
        made = base.join(G.stats(chunks).drop("total_chars"), "book_id").join(size, "book_id").select(
            "book_id", "title", "author", "source_type", "source_path", F.sha2("original", 256).alias("source_hash"), when.alias("imported_at"), F.lit(most).alias("max_chars"), F.lit(least).alias("min_chars"), "section_count",
            F.length("original").cast("bigint").alias("total_chars"), "initial_chunk_count", "chunk_count", "average_chunk_chars", "min_chunk_chars", "max_chunk_chars", F.lit("not_built").alias("index_status"), F.lit(None).cast("timestamp_ntz").alias("index_updated_at"), F.lit(None).cast("string").alias("index_options"),
        )
        books = self._checkpointed(made)
        ids = books.select("book_id")
        self._replace("chunks", chunks.drop("initial_chunks"))
        self._replace("books", books)
        for name_ in ("postings", "chunk_index"):
            self._remove(name_, ids)
        if build_index:
            self._build(self.table("chunks").join(ids, "book_id", "left_semi"), now)
        return self.table("books").join(ids, "book_id", "left_semi")

    def _checkpointed(self, df: DataFrame) -> DataFrame:
        from lectern.runtime import cut

        return cut(df, "import")

    def adopt(self, folder: str) -> dict[str, int]:
        """Takes over a file-backed library folder; returns the rows of each table."""
        from lectern.sources.folder import read_folder

        found = read_folder(self.spark, folder)
        key = L.link_key(F.col("ext_id"), F.col("ext_title"), F.col("ext_author")).alias("key")
        for name, df in found.items():
            df = df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in T._parse_datatype_string(TABLES[name]) if f.name not in df.columns and f.name != "key"})
            self.write(name, df.select(key, "*") if name in ("links", "pending") else df)
        return {name: self.table(name).count() for name in found}

    def find_book(self, book_id: str | None = None, source_path: str | None = None, title: str | None = None) -> DataFrame:
        """The imported book that fits best: by id, else by source path, else by title, else the newest."""
        b = self.table("books")
        rank = F.when(F.col("book_id") == F.lit(book_id), 0).when(F.col("source_path") == F.lit(source_path), 1).when(F.col("title") == F.lit(title), 2).otherwise(3)
        return b.orderBy(rank, F.desc_nulls_last("imported_at"), "book_id").limit(1)

    def build_index(self, book_id: str | None = None, *, every: bool = False, now: datetime | None = None, **options) -> DataFrame:
        """Builds the index of one book or all; returns ``book_id, term_count, posting_count, bytes, warning``.

        A book in which no term is kept comes out with 0; the options of the
        build are kept with the book.  ``warning`` names an index over 10 MiB
        (as compact JSON, about) and one without terms.
        """
        one = _scope(book_id, every)
        chunks = self.table("chunks") if one is None else self.table("chunks").where(F.col("book_id") == one)
        if one is not None and chunks.isEmpty():
            raise ValueError(f"no book {one}")
        return self._build(chunks, now, **options)

    def _build(self, chunks: DataFrame, now: datetime | None = None, **options) -> DataFrame:
        """Index of the books these chunks belong to, in one plan."""
        built = I.build(chunks, **options)
        self._replace("postings", built["postings"])
        self._replace("chunk_index", built["chunk_index"])
        done = chunks.select("book_id").distinct()
        filled = I.back_fill(chunks, built["keywords"])
        self._replace("chunks", filled)
        marked = self.table("books").join(done, "book_id", "left_semi").withColumn("index_status", F.lit("built")).withColumn("index_options", F.lit(json.dumps(I.DEFAULTS | options))).withColumn("index_updated_at", F.lit(now or datetime.now(UTC).replace(tzinfo=None)))
        self._replace("books", marked)
        entry = F.length("chunk_id") + F.length(F.col("count").cast("string")) + 6
        per = self.table("postings").groupBy("book_id", "term").agg(F.count(F.lit(1)).alias("n"), F.sum(entry).alias("b")).groupBy("book_id").agg(F.count(F.lit(1)).alias("t"), F.sum("n").alias("p"), F.sum(F.col("b") + F.length("term") + 5).alias("b"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
        warn = F.when(zero("t") == 0, "no term is kept").when(F.col("b") > INDEX_WARNING, F.concat(F.lit("the index has about "), F.round(F.col("b") / (1 << 20), 1).cast("string"), F.lit(" MiB")))
        return done.join(per, "book_id", "left").select("book_id", zero("t").alias("term_count"), zero("p").alias("posting_count"), zero("b").alias("bytes"), warn.alias("warning"))

    def build_summary(self, built: DataFrame) -> dict[str, int]:
        """Counters of a build: books with an index, books without a kept term, warnings."""
        r = built.agg(F.count_if(F.col("term_count") > 0).alias("succeeded"), F.count_if(F.col("term_count") == 0).alias("failed"), F.count("warning").alias("warnings")).first()
        return r.asDict()

    def problems(self, book_id: str | None = None) -> DataFrame:
        """``book_id, chunk_id, problem``: what a search leaves out or can't show, found by joins of the tables."""
        c, p = self._in("chunks", book_id), self._in("postings", book_id).select("book_id", "chunk_id").distinct()
        b = self.table("books") if book_id is None else self._in("books", book_id)
        none = F.lit(None).cast("string").alias("chunk_id")
        return (
            b.where("index_status <> 'built'").select("book_id", none, F.lit("not indexed").alias("problem"))
            .unionByName(c.where("text IS NULL").select("book_id", "chunk_id", F.lit("no text").alias("problem")))
            .unionByName(p.join(c.select("book_id", "chunk_id"), ["book_id", "chunk_id"], "left_anti").select("book_id", "chunk_id", F.lit("posting without chunk").alias("problem")))
            .unionByName(b.join(c.select("book_id").distinct(), "book_id", "left_anti").select("book_id", none, F.lit("no chunks").alias("problem")))
        )

    # ---- search
    def _in(self, name: str, book_id: str | None) -> DataFrame:
        return self.table(name) if book_id is None else self.table(name, {zlib.crc32(book_id.encode()) % BUCKETS}).where(F.col("book_id") == book_id)

    def search(self, query: str, book_id: str | None = None, *, every: bool = False, limit: int = S.LIMIT, max_preview: int = S.MAX_PREVIEW, include_text: bool = False) -> DataFrame:
        """Keyword search. Over all books those without an index are left out (see ``unindexed``); one book is scanned if it has none. ``include_text`` adds a longer ``text_preview``."""
        one = _scope(book_id, every)
        if limit < 1 or max_preview < 80:
            raise ValueError("limit must be 1 or more, max_preview 80 or more")
        found = S.keyword_search(S.one_query(self.spark, query), self._in("postings", one), self._in("chunks", one), limit=limit, max_preview=max_preview, indexed_only=one is None)
        return self._described(found, query, max_preview if include_text else 0)

    def search_exact(self, query: str, book_id: str | None = None, *, every: bool = False, limit: int = S.LIMIT, max_preview: int = S.MAX_PREVIEW, include_text: bool = False) -> DataFrame:
        """Exact search in one book or all; ``include_text`` as in :meth:`search`."""
        one = _scope(book_id, every)
        return self._described(S.exact_search(S.one_query(self.spark, query), self._in("chunks", one), limit=limit, max_preview=max_preview, one_book=one is not None), query, max_preview if include_text else 0).withColumn("exact", F.lit(True))

    def _described(self, hits: DataFrame, query: str = "", text: int = 0) -> DataFrame:
        """Hits with their book and with what index and manifest know of the chunk, the index first."""
        key = ["book_id", "chunk_id"]
        own = hits.select(*key).distinct()
        c = S.chunk_entries(self.table("chunks").join(own, key, "left_semi"), self.table("chunk_index").join(own, key, "left_semi")).drop("ord", "preview")
        b = self.table("books").select("book_id", "title", "author")
        x = hits.join(c, key, "left").join(b, "book_id", "left")
        more = []
        if text:
            x = x.join(self.table("chunks").select(*key, "text"), key, "left")
            more = [search_preview(F.col("text"), F.lit(query), F.col("matched"), max(2 * text, 400)).alias("text_preview")]
        return x.select("book_id", "title", "author", "chunk_id", "chunk_title", "section_title", "chunk_path", "score", "matched", F.coalesce(F.when(F.col("preview") != "", F.col("preview")), "chunk_path").alias("preview"), "char_count", "ord", *more).orderBy(F.desc("score"), F.desc(F.size("matched")), "ord", "book_id")

    def unindexed(self) -> DataFrame:
        """Books a search over all books leaves out."""
        return self.table("books").where("index_status <> 'built'").select("book_id", "title", "index_status")

    # ---- reading
    def get_chunk(self, book_id: str, chunk_id: str | None = None, path: str | None = None) -> DataFrame:
        """One chunk by id or path, with its book."""
        check_book_id(book_id)
        if not chunk_id and not path:
            raise ValueError("give chunk_id or path")
        if path:
            safe_join(self.root, path)
        hit = self._in("chunks", book_id).where((F.col("chunk_id") == F.lit(chunk_id)) | (F.col("chunk_path") == F.lit((path or "").replace("\\", "/")))).orderBy("ord").limit(1)
        return hit.join(self.table("books").select("book_id", F.col("title").alias("book_title"), "author"), "book_id", "left")

    def manifest(self, book_id: str, *, max_chunks: int = MANIFEST_CHUNKS, include_preview: bool = False, include_raw: bool = False) -> tuple[DataFrame, DataFrame, list[str]]:
        """``(book row, chunk rows, warnings)``; no text is read.

        With ``include_raw`` the book row has ``raw``, the manifest as JSON, unless it is over 200,000 characters.
        """
        check_book_id(book_id)
        if not 1 <= max_chunks <= MAX_MANIFEST_CHUNKS:
            raise ValueError(f"max_chunks must be 1 to {MAX_MANIFEST_CHUNKS}")
        book = self._in("books", book_id)
        row = book.first()
        if row is None:
            raise ValueError(f"no book {book_id}")
        cols = ["chunk_id", "title", "section_title", "ord", "chunk_path", "char_count", "word_count", F.slice("keywords", 1, 20).alias("keywords"), "prev_id", "next_id", *(["preview"] if include_preview else [])]
        warnings = [f"only the first {max_chunks} of {row['chunk_count']} chunks"] if (row["chunk_count"] or 0) > max_chunks else []
        if include_raw:
            size = self._in("chunks", book_id).drop("text").agg(F.sum(F.length(F.to_json(F.struct(*(c for c in self.table("chunks").columns if c != "text")))) + 1)).first()[0] or 0
            if size + len(json.dumps(row.asDict(), default=str, ensure_ascii=False)) > RAW_CHARS:
                warnings.append(f"the raw manifest is over {RAW_CHARS} characters and left out")
                book = book.withColumn("raw", F.lit(None).cast("string"))
            else:
                every = [r.asDict() for r in self._in("chunks", book_id).drop("text").orderBy("ord").collect()]
                book = book.withColumn("raw", F.lit(json.dumps(row.asDict() | {"chunks": every}, default=str, ensure_ascii=False)))
        return book, self._in("chunks", book_id).orderBy("ord").limit(max_chunks).select(*cols), warnings

    def list_books(self, *, include_progress: bool = True, include_index_status: bool = True, include_stats: bool = False) -> DataFrame:
        """Books by last reading, import and title; progress, index status and chunk statistics as asked."""
        listed = P.book_list(self.table("books"), self.table("progress"))
        gone = [*([] if include_progress else ["reading_status", "last_read_at"]), *([] if include_index_status else ["index_status"])]
        if include_stats:
            listed = listed.join(self.table("books").select("book_id", "chunk_count", "total_chars", "average_chunk_chars", "min_chunk_chars", "max_chunk_chars"), "book_id", "left").orderBy(*P.list_order())
        return listed.drop(*gone)

    # ---- progress
    def progress(self, book_id: str | None = None) -> DataFrame:
        t = self.table("progress")
        return P.recent_books(t).join(t.drop("last_read_at", "recency_seq"), "book_id") if book_id is None else t.where(F.col("book_id") == check_book_id(book_id))

    def update_progress(self, book_id: str, *, last_chunk_id: str | None = None, next_chunk_id: str | None = None, status: str | None = None, note_path: str | None = None, last_path: str | None = None, next_path: str | None = None, last_section_title: str | None = None, title: str | None = None, author: str | None = None, current_themes: list[str] | None = None, last_read_at: datetime | None = None) -> DataFrame:
        """Upsert of one book: given fields replace old ones, the book becomes the most recent."""
        check_book_id(book_id)
        for path in (note_path, last_path, next_path):
            if path:
                safe_join(self.root, path)
        old = self.table("progress")
        seq = (old.agg(F.max("recency_seq")).first()[0] or 0) + 1
        mine = self._in("progress", book_id)
        had = mine.first()
        themes = None if current_themes is None else [t.strip() for t in current_themes if isinstance(t, str) and t.strip()]
        row = (book_id, last_chunk_id, next_chunk_id, status, note_path or (None if had and had["note_path"] else f"notes/{book_id}.md"), last_path, next_path, last_section_title, title, author, themes, last_read_at or datetime.now(UTC).replace(tzinfo=None), seq)
        self._replace("progress", P.merge_progress(mine, self.spark.createDataFrame([row], PROGRESS)))
        return self.progress(book_id)

    def resume(self, book_id: str | None = None, *, chunk_id: str | None = None, read_chunk: bool = True) -> dict[str, DataFrame | str]:
        """Where to read on: progress, note sections and the chunk of a book (the most recent one by default)."""
        p = self.table("progress")
        if book_id is None:
            last = P.recent_books(p, 1).first()
            if last is None:
                raise ValueError("nothing has been read yet")
            book_id = last["book_id"]
        own = self.progress(check_book_id(book_id))
        if own.isEmpty():
            raise ValueError(f"no progress for {book_id}")
        asked = self.spark.createDataFrame([(book_id, chunk_id)], "book_id string, chunk_id string") if chunk_id else None
        at = P.resume(own, self._in("chunks", book_id), asked)
        out: dict[str, DataFrame | str] = {"book_id": book_id, "progress": own, "position": at, "notes": self.read_note(book_id)}
        if read_chunk:
            out["chunk"] = self._in("chunks", book_id).join(at.select("chunk_id"), "chunk_id", "left_semi")
        return out

    # ---- notes
    def read_note(self, book_id: str, sections: tuple[str, ...] = P.DEFAULT_SECTIONS) -> DataFrame:
        """The asked sections of a note; empty where there is no note."""
        return self._in("notes", check_book_id(book_id)).where(F.col("heading").isin(*dict.fromkeys(sections))).orderBy("ordinal")

    def read_full_note(self, book_id: str, max_chars: int = NOTE_CHARS) -> DataFrame:
        md = P.note_markdown(self._in("notes", check_book_id(book_id)), self._in("books", book_id))
        return md.select("book_id", truncated(F.col("markdown"), max_chars).alias("t")).select("book_id", "t.text", "t.truncated")

    def update_note(self, book_id: str, *, quick_recovery: dict[str, object] | None = None, current_understanding: str | None = None, next_entry: str | None = None, append_section: str | None = None, append_content: str | None = None, append_heading: str | None = None, now: datetime | None = None) -> DataFrame:
        """Sections replaced (recovery, understanding, next entry), then one entry appended; a missing note is made first."""
        check_book_id(book_id)
        if bool(append_section) != bool(append_content):
            raise ValueError("append_section and append_content come together")
        if append_section and append_section not in P.APPEND_SECTIONS:
            raise ValueError(f"append_section must be one of {', '.join(P.APPEND_SECTIONS)}")
        if append_content and len(append_content) > P.APPEND_LIMIT:
            raise ValueError(f"append_content may have {P.APPEND_LIMIT} characters")
        stamp = (now or datetime.now(UTC).replace(tzinfo=None)).isoformat()
        notes, book = self.table("notes"), self._in("books", book_id)
        own = notes.where(F.col("book_id") == book_id)
        if own.isEmpty():
            source = book if not book.isEmpty() else self.spark.createDataFrame([(book_id, None, None)], "book_id string, title string, author string")
            own = P.note_skeleton(source.select("book_id", "title", "author"))
        rows = {r["heading"]: (r["ordinal"], r["content"]) for r in own.collect()}
        new: dict[str, str] = {}
        if quick_recovery is not None:
            b = book.first()
            given = {"localBookId": book_id, "localTitle": (b and b["title"]) or book_id, "author": (b and b["author"]) or "", "noteUpdatedAt": stamp} | {k: v for k, v in quick_recovery.items()}
            text = lambda v: "" if v is None else ", ".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)
            new[P.RECOVERY] = "\n".join(f"- {k}: {text(given.get(k))}" for k in [*P.RECOVERY_KEYS, *(k for k in given if k not in P.RECOVERY_KEYS)])
        if current_understanding is not None:
            new[P.SECTIONS[1]] = current_understanding.strip()
        if next_entry is not None:
            new[P.SECTIONS[2]] = next_entry.strip()
        if append_section:
            old = new.get(append_section, rows.get(append_section, (0, ""))[1] or "").strip()
            entry = f"### {append_heading or f'{stamp} · {book_id}'}\n\n{append_content.strip()}"
            new[append_section] = f"{old}\n\n{entry}" if old else entry
        for h, c in new.items():
            rows[h] = (rows[h][0] if h in rows else 1 + max((o for o, _ in rows.values()), default=-1), c)
        made = self.spark.createDataFrame([(book_id, h, o, c) for h, (o, c) in rows.items()], NOTES)
        self._replace("notes", made)
        return self.read_note(book_id, P.SECTIONS)

    # ---- links
    def link_external(self, title: str | None = None, *, ext_id: str | None = None, author: str | None = None, book_id: str | None = None, confirm: bool = False, now: datetime | None = None) -> Result:
        """Links an external record: an existing link is reused, a confirmed one stored, else scored and linked, left pending or refused."""
        if not title and not ext_id:
            raise ValueError("give a title or an external id")
        books = self.table("books")
        if books.isEmpty():
            raise ValueError("the library is empty")
        one = self.spark.createDataFrame([(ext_id, title, author)], "ext_id string, title string, author string")
        key = one.select(L.link_key(F.col("ext_id"), F.col("title"), F.col("author"))).first()[0]
        links = self.table("links")
        when = now or datetime.now(UTC).replace(tzinfo=None)

        def store(target: str, score: float, how: list[str]) -> Result:
            row = self.spark.createDataFrame([(key, ext_id, title, author, target, score, "linked", how, when)], LINKS)
            self._replace("links", row, ["key"])
            self._remove("pending", row, ["key"])
            return Result(action="linked", values={"book_id": target, "score": score, "matched_by": how})

        if confirm:
            if not book_id or books.where(F.col("book_id") == check_book_id(book_id)).isEmpty():
                raise ValueError("confirming needs the book_id of a local book")
            return store(book_id, 1.0, ["manualConfirm"])
        had = links.where(F.col("key") == key).first()
        if had is not None:
            return Result(action="reused", values={"book_id": had["book_id"], "score": had["score"]})
        ask = self.spark.createDataFrame([(0, title, author)], "ext_id int, title string, author string")
        got = L.decisions(L.scores(ask, books), books, collation="zh").first()
        if got is None or got["action"] == "no-match":
            return Result(action="no-match", values={"score": got["score"] if got else 0.0})
        if got["action"] == "linked":
            how = L.scores(ask, books).where(F.col("book_id") == got["book_id"]).first()["matched_by"]
            return store(got["book_id"], got["score"], how)
        row = self.spark.createDataFrame([(key, ext_id, title, author, got["candidates"], when)], PENDING)
        self._replace("pending", row, ["key"])
        return Result(action="pending", values={"candidates": [c.asDict() for c in got["candidates"]]})

    def link_many(self, external: DataFrame, *, now: datetime | None = None) -> DataFrame:
        """Links a table of external records ``(ext_id, title, author)`` in one plan; returns ``key, ext_id, ext_title, action, book_id, score``.

        Records linked before are reused and not scored again (an anti-join on
        the key); of equal keys one record counts.
        """
        books, when = self.table("books"), F.lit(now or datetime.now(UTC).replace(tzinfo=None))
        keyed = external.select(L.link_key(F.col("ext_id"), F.col("title"), F.col("author")).alias("key"), "ext_id", "title", "author").dropDuplicates(["key"])
        had = self.table("links").select("key", "book_id", "score")
        asked = self._checkpointed(keyed.join(had, "key", "left_anti"))
        scored = self._checkpointed(L.scores(asked.select(F.col("key").alias("ext_id"), "title", "author"), books))
        d = L.decisions(scored, books, collation="zh").withColumnRenamed("ext_id", "key")
        how = scored.select(F.col("ext_id").alias("key"), "book_id", "matched_by")
        named = asked.select("key", "ext_id", F.col("title").alias("ext_title"), F.col("author").alias("ext_author"))
        made = self._checkpointed(named.join(d, "key", "left").join(how, ["key", "book_id"], "left").withColumn("action", F.coalesce("action", F.lit("no-match"))))
        fresh = made.where("action = 'linked'").select("key", "ext_id", "ext_title", "ext_author", "book_id", "score", F.lit("linked").alias("status"), "matched_by", when.alias("updated_at"))
        self._replace("links", fresh, ["key"])
        waiting = made.where("action = 'pending'").select("key", "ext_id", "ext_title", "ext_author", "candidates", when.alias("updated_at"))
        self._replace("pending", waiting, ["key"], made)
        reused = keyed.join(had, "key").select("key", "ext_id", F.col("title").alias("ext_title"), F.lit("reused").alias("action"), "book_id", "score")
        return made.select("key", "ext_id", "ext_title", "action", "book_id", F.coalesce("score", F.lit(0.0)).alias("score")).unionByName(reused)

    def pending_links(self) -> DataFrame:
        return self.table("pending")

    def find_highlight(self, text: str, *, book_id: str | None = None, title: str | None = None, ext_id: str | None = None, limit: int = HIGHLIGHTS, include_chunk: bool = False, max_preview: int = 260) -> Result:
        """The chunk a highlight stands in, by local book or through the links; ``include_chunk`` adds the first chunk itself."""
        mapping = "given"
        if book_id is None:
            want = self.spark.createDataFrame([(0, ext_id, title)], "query_id int, ext_id string, title string")
            r = L.resolve(want, self.table("links"), self.table("pending")).first()
            mapping, book_id = r["mapping"], r["book_id"]
            if mapping == "pending":
                return Result(action="pending", warnings=["the book isn't confirmed yet"])
            if book_id is None:
                raise ValueError("no local book for this highlight")
        hits = self.search_exact(text, check_book_id(book_id), limit=limit, max_preview=max_preview).orderBy("ord").collect()
        more = {"chunk": self.get_chunk(book_id, hits[0]["chunk_id"]).first().asDict()} if include_chunk and hits else {}
        return Result(action=mapping, values={"book_id": book_id, "hits": hits, "chunk_id": hits[0]["chunk_id"] if hits else None} | more, warnings=[] if hits else ["the text stands in no chunk"])

    def report(self, hits: DataFrame, most: int = 50) -> str:
        """Hits as text, for a terminal."""
        rows = hits.limit(most).collect()
        return "\n\n".join(f"{n}. {r['book_id']} / {r['title']}\n   {r['chunk_id']} {r['chunk_title']} (score {r['score']})\n   {r['preview']}" for n, r in enumerate(rows, 1)) or "no hits"

