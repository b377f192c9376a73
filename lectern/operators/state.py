"""Reading progress and sectioned notes as keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import WS, let, normalize_list, trim_ws

#: Sections of a note, those shown by default, those that can be appended to.
RECOVERY, LEGACY_RECOVERY = "阅读恢复区", "快速恢复区"
SECTIONS = (RECOVERY, "当前理解", "下次入口", "摘录与想法", "段落共读记录", "交叉关联")
DEFAULT_SECTIONS, APPEND_SECTIONS, EMPTY = SECTIONS[:3], SECTIONS[3:], "暂无。"
#: Keys of the recovery block, in order.
RECOVERY_KEYS = ("localBookId", "localTitle", "wereadTitle", "author", "lastChunkId", "nextChunkId", "lastPath", "nextPath", "lastSectionTitle", "lastReadAt", "noteUpdatedAt", "currentThemes", "currentMode")
APPEND_LIMIT = 20_000
FIELDS = ("last_chunk_id", "next_chunk_id", "status", "note_path")


def _given(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def _current_name(heading: Column) -> Column:
    return F.when(heading == LEGACY_RECOVERY, RECOVERY).otherwise(heading)


def latest_progress(updates: DataFrame) -> DataFrame:
    """State of each book: of every field the last value that was given, themes normalised.

    Later means by ``last_read_at``, then arrival, then id.  Re-delivered
    updates change nothing.  A field never given stays null.
    """
    u = updates.where("book_id IS NOT NULL").withColumn("_at", F.struct("last_read_at", "received_at", "update_id")).withColumn("current_themes", F.when(F.col("current_themes").isNotNull(), normalize_list(F.col("current_themes"))))
    last = [F.max_by(c, F.when(_given(c), F.col("_at"))).alias(c) for c in FIELDS]
    themes = F.max_by("current_themes", F.when(F.col("current_themes").isNotNull(), F.col("_at"))).alias("current_themes")
    return u.groupBy("book_id").agg(*last, themes, F.max("last_read_at").alias("last_read_at"), F.max("_at").alias("_at")).select("book_id", *FIELDS, F.coalesce("current_themes", F.array().cast("array<string>")).alias("current_themes"), "last_read_at", F.col("_at.update_id").alias("recency_seq"))


def recent_books(progress: DataFrame, most: int | None = None) -> DataFrame:
    """Books by recency, most recent first: ``rank, book_id``."""
    ranked = progress.select("book_id", "last_read_at", "recency_seq").orderBy(F.desc_nulls_last("last_read_at"), F.desc("recency_seq"), "book_id")
    return ranked.limit(most) if most else ranked


def merge_progress(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keyed merge of two progress tables: a given new field wins, an absent one keeps the old value."""
    cols = [c for c in old.columns if c != "book_id"]
    o, n = old.select("book_id", *(F.col(c).alias(f"o_{c}") for c in cols)), new.select("book_id", *(F.col(c).alias(f"n_{c}") for c in cols))
    return o.join(n, "book_id", "full_outer").select("book_id", *(F.coalesce(f"n_{c}", f"o_{c}").alias(c) for c in cols))


def resume(progress: DataFrame, chunks: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Where to read on: the asked chunk, else the next, else the last one of each book, with its row where it exists."""
    p = progress.select("book_id", "last_chunk_id", "next_chunk_id", "last_read_at")
    p = p.join(asked.select("book_id", F.col("chunk_id").alias("_asked")), "book_id", "left") if asked is not None else p.withColumn("_asked", F.lit(None).cast("string"))
    target = F.coalesce(*(F.when(_given(c), F.col(c)) for c in ("_asked", "next_chunk_id", "last_chunk_id")))
    c = chunks.select("book_id", F.col("chunk_id").alias("_cid"), "title", "ord", "char_count")
    t = p.withColumn("chunk_id", target)
    return t.join(c, (t["book_id"] == c["book_id"]) & (t["chunk_id"] == c["_cid"]), "left").select(t["book_id"], "chunk_id", "title", "ord", "char_count", "last_read_at", c["_cid"].isNotNull().alias("found"))


def list_order() -> list[Column]:
    return [F.desc_nulls_last("last_read_at"), F.desc_nulls_last("imported_at"), F.collate(F.coalesce("title", F.lit("")), "zh"), F.col("book_id")]


def book_list(books: DataFrame, progress: DataFrame) -> DataFrame:
    """Books with their progress, by last reading, import and title (Chinese collation); no text is read."""
    x = books.join(progress.select("book_id", F.col("status").alias("reading_status"), "last_read_at"), "book_id", "left")
    return x.select("book_id", "title", "author", "imported_at", F.coalesce(F.when(F.col("index_status") != "", F.col("index_status")), F.lit("not_built")).alias("index_status"), "reading_status", "last_read_at").orderBy(*list_order())


def note_sections(notes: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, section_no, heading, content`` of Markdown notes: from each ``## `` line to the next. Text before the first is left out."""

    def of_lines(lines: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.element_at(lines, i).rlike(r"^##\s+\S"))
        return let(heads, lambda h: of_heads(lines, h))

    def of_heads(lines: Column, heads: Column) -> Column:
        return F.transform(
            heads,
            lambda i, k: F.struct(
                _current_name(trim_ws(F.regexp_replace(F.element_at(lines, i), r"^##\s+", ""))).alias("heading"),
                trim_ws(F.array_join(F.slice(lines, i + 1, F.coalesce(F.try_element_at(heads, k + 2), F.size(lines) + 1) - i - 1), "\n")).alias("content"),
            ),
        )

    parts = let(F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r\n?", "\n"), "\n"), of_lines)
    return notes.select(*keys, F.posexplode(parts).alias("section_no", "p")).select(*keys, "section_no", "p.heading", "p.content")


def append_entries(entries: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``keys, content, refused``: entries ``(heading, content)`` of each key joined in order, as ``### heading`` blocks.

    Content over 20,000 characters is refused and counted (null content counts
    as empty); a key all of whose entries are refused has empty content.
    """
    block = F.concat(F.lit("### "), F.coalesce("heading", F.lit("")), F.lit("\n\n"), F.coalesce("content", F.lit("")))
    ok = F.coalesce(F.length("content"), F.lit(0)) <= APPEND_LIMIT
    kept = F.collect_list(F.when(ok, F.struct(*order, block.alias("_b"))))
    return entries.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(kept), lambda x: x["_b"]), "\n\n").alias("content"), F.count_if(~ok).alias("refused"))


def normal_markdown(c: Column) -> Column:
    """Line ends as line feeds, no white space at the end but one line feed; the first legacy heading gets its present name."""
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n"), WS + r"+\z", "")
    at = F.regexp_instr(flat, F.lit(rf"(?m)^## {LEGACY_RECOVERY}$"))
    named = F.when(at > 0, F.concat(F.substring(flat, F.lit(1), at - 1), F.lit(f"## {RECOVERY}"), F.substring(flat, at + len(f"## {LEGACY_RECOVERY}"), F.length(flat)))).otherwise(flat)
    return F.concat(named, F.lit("\n"))


def deciding_updates(updates: DataFrame) -> DataFrame:
    """The updates that decide the state of their book: at most one for each field. The state of these is the state of all."""
    at = F.struct("last_read_at", "received_at", "update_id")
    row = F.struct(*updates.columns)
    u = updates.where("book_id IS NOT NULL")
    picks = [F.max_by(row, F.when(_given(c), at)) for c in FIELDS] + [F.max_by(row, F.when(F.col("current_themes").isNotNull(), at)), F.max_by(row, at)]
    return u.groupBy("book_id").agg(F.array_distinct(F.array_compact(F.array(*picks))).alias("_r")).select(F.explode("_r").alias("_r")).select("_r.*")


def note_skeleton(books: DataFrame) -> DataFrame:
    """The rows of a new note: six sections, the recovery block filled from the book."""
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("book_id"))
    values = {"localBookId": F.col("book_id"), "localTitle": title, "author": F.coalesce("author", F.lit(""))}
    body = {RECOVERY: recovery_block(values), SECTIONS[1]: F.lit(EMPTY), SECTIONS[2]: F.lit(EMPTY)}
    rows = F.array(*(F.struct(F.lit(h).alias("heading"), F.lit(k).alias("ordinal"), body.get(h, F.lit("")).alias("content")) for k, h in enumerate(SECTIONS)))
    return books.select("book_id", F.explode(rows).alias("r")).select("book_id", "r.*")


def recovery_block(values: dict[str, Column]) -> Column:
    """``- key: value`` lines in the fixed order, then the extra keys; keys that aren't given stay blank."""
    keys = [*RECOVERY_KEYS, *(k for k in values if k not in RECOVERY_KEYS)]
    return F.concat_ws("\n", *(F.concat(F.lit(f"- {k}: "), F.coalesce(values.get(k, F.lit("")).cast("string"), F.lit(""))) for k in keys))


def upsert_section(notes: DataFrame, new: DataFrame) -> DataFrame:
    """``(book_id, heading, ordinal, content)`` rows replaced by key; an unknown heading goes to the end of its note."""
    last = notes.groupBy("book_id").agg(F.max("ordinal").alias("_last"))
    own = notes.select("book_id", "heading", F.col("ordinal").alias("_own"))
    placed = new.select("book_id", "heading", "content").join(own, ["book_id", "heading"], "left").join(last, "book_id", "left")
    w = Window.partitionBy("book_id", F.col("_own").isNull()).orderBy("heading")
    fresh = placed.select("book_id", "heading", F.coalesce("_own", F.coalesce("_last", F.lit(-1)) + F.row_number().over(w)).cast("int").alias("ordinal"), "content")
    return notes.join(fresh.select("book_id", "heading"), ["book_id", "heading"], "left_anti").unionByName(fresh)


def note_markdown(notes: DataFrame, books: DataFrame) -> DataFrame:
    """``book_id, markdown``: the note as one document."""
    block = F.concat(F.lit("## "), F.col("heading"), F.when(F.col("content") != "", F.concat(F.lit("\n\n"), F.col("content"))).otherwise(""))
    body = notes.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("body"))
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("book_id"))
    return body.join(books.select("book_id", title.alias("t")).dropDuplicates(["book_id"]), "book_id", "left").select("book_id", F.concat(F.lit("# "), F.coalesce("t", "book_id"), F.lit("\n\n"), F.col("body"), F.lit("\n")).alias("markdown"))
