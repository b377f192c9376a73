"""Segmentation of book texts: sections, small-section merge, splitting, tiny-chunk merge, chunk rows.

Everything that depends on order within one text is done inside the row (array
functions or one Arrow batch), so a long book never becomes a sort of its
lines, and no text is shuffled.
"""

from __future__ import annotations


import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import CHAPTER_PATTERNS, UNTITLED, WS, clean_text, count_words, is_chapter_title, let, normalize_title, preview, trim_ws

#: Limits of an import.
MAX_CHARS, MIN_CHARS_FLOOR, MIN_CHARS_SHARE, MAX_CHARS_FLOOR, TINY_FLOOR = 4000, 300, 0.35, 500, 120
_SENTENCE_END = "(?<=[。！？!?；;])"


def limits(max_chars: int | None = None, min_chars: int | None = None) -> tuple[int, int]:
    """Checked size limits of an import: defaults filled in, the smaller one clamped."""
    most = MAX_CHARS if max_chars is None else int(max_chars)
    if most < MAX_CHARS_FLOOR:
        raise ValueError(f"max_chars must be {MAX_CHARS_FLOOR} or more")
    least = int(most * MIN_CHARS_SHARE) if min_chars is None else int(min_chars)
    return most, max(MIN_CHARS_FLOOR, least)


def sections(text: Column) -> Column:
    """``array<struct<title, text>>``: a chapter title starts a section; what stands before the first is a section of its own; empty ones vanish."""

    def of_lines(lines: Column) -> Column:
        n = F.size(lines)
        titles = F.filter(F.sequence(F.lit(1), n), lambda i: is_chapter_title(trim_ws(F.element_at(lines, i))))

        def of_starts(starts: Column) -> Column:
            def section(start: Column, k: Column) -> Column:
                end = F.coalesce(F.try_element_at(starts, k + 2), n + 1)
                body = trim_ws(F.array_join(F.slice(lines, start + 1, F.greatest(end - start - 1, F.lit(0))), "\n"))  # the lines are clean already
                title = F.when(start == 0, f"{UNTITLED} 1").otherwise(normalize_title(trim_ws(F.element_at(lines, F.greatest(start, F.lit(1))))))
                return F.struct(title.alias("title"), body.alias("text"))

            return F.transform(starts, section)

        return let(F.concat(F.array(F.lit(0)), titles), of_starts)

    return F.filter(let(F.split(clean_text(text), "\n"), of_lines), lambda s: F.length(s["text"]) > 0)


def section_rows(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, section_no, title, text``."""
    return df.select(*keys, F.posexplode(sections(F.col(text))).alias("section_no", "s")).select(*keys, "section_no", "s.title", "s.text")


def sentence_parts(text: Column) -> Column:
    """Pieces after each of ``。！？!?；;``, trimmed; blanks dropped."""
    return F.filter(F.transform(F.split(text, _SENTENCE_END + WS + "*"), trim_ws), lambda p: p != "")


def hard_parts(text: Column, size: int) -> Column:
    """Fixed windows, trimmed; blanks dropped."""

    def windows(t: Column) -> Column:
        n = F.length(t)
        cuts = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size)), lambda s: trim_ws(F.substring(t, s + 1, F.lit(size))))
        return F.when(n > 0, cuts).otherwise(F.array().cast("array<string>"))

    return F.filter(let(text, windows), lambda p: p != "")


# ---- the folds below run once per text, inside an Arrow batch
_TRIM = "".join(chr(c) for c in (9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))


def clean(text: str) -> str:
    """The same rule as ``functions.text.clean_text``, for use inside a batch."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", text)
    text = re.sub(r"[ \t]{2,}", " ", re.sub(r"[ \t]*\n[ \t]*", "\n", text))
    return re.sub(r"\n{3,}", "\n\n", text).strip(_TRIM)


_TITLE = re.compile("|".join(f"(?:{p})" for p in CHAPTER_PATTERNS).replace(r"\z", r"\Z").replace("(?i:Chapter)", "[Cc][Hh][Aa][Pp][Tt][Ee][Rr]"))


def text_sections(text: str | None) -> list[tuple[str, str]]:
    """The same sections as :func:`sections`, for use inside a batch."""
    out: list[tuple[str, list[str]]] = [(f"{UNTITLED} 1", [])]
    for line in clean(text or "").split("\n"):
        bare = line.strip(_TRIM)
        if 2 <= len(bare) <= 80 and not re.search("[。；;]", bare) and _TITLE.match(bare):
            out.append((re.sub(r"^#{1,3}\s+", "", bare).strip(_TRIM) or UNTITLED, []))
        else:
            out[-1][1].append(line)
    joined = ((title, "\n".join(lines).strip(_TRIM)) for title, lines in out)
    return [(title, body) for title, body in joined if body]


def _pack(parts: list[str], most: int, glue: str, oversized) -> list[str]:
    """Greedy packing in order; a part over the limit is handed to ``oversized``."""
    out: list[str] = []
    held: str | None = None
    for p in parts:
        if len(p) > most:
            out += [held] if held else []
            held = None
            out += oversized(p)
        elif held and len(held) + len(glue) + len(p) <= most:
            held += glue + p
        else:
            out += [held] if held else []
            held = p
    return out + ([held] if held else [])


def _windows(text: str, most: int) -> list[str]:
    return [w for w in (text[k : k + most].strip(_TRIM) for k in range(0, len(text), most)) if w]


def _by_sentence(text: str, most: int) -> list[str]:
    parts = [p for p in (x.strip(_TRIM) for x in re.split(r"(?<=[。！？!?；;])", text)) if p]
    return _pack(parts, most, "", lambda p: _windows(p, most)) if len(parts) > 1 else _windows(text, most)


def split_long(text: str, most: int) -> list[str]:
    """Paragraphs packed up to the limit; longer ones by sentence, then by window."""
    text = clean(text)
    if len(text) <= most:
        return [text]
    return _pack([p for p in (x.strip(_TRIM) for x in re.split(r"\n{2,}", text)) if p], most, "\n\n", lambda p: _by_sentence(p, most))


def _headed(title: str, body: str) -> str:
    return clean(f"## {title}\n\n{body}")


def merge_small(parts: list[tuple[str, str]], most: int, least: int) -> list[tuple[str, str]]:
    """A section under ``least`` takes in the next one, under a heading, while both fit."""
    out: list[tuple[str, str]] = []
    for title, text in parts:
        title, text = re.sub(r"^#{1,3}\s+", "", title).strip(_TRIM) or UNTITLED, clean(text)
        if not text:
            continue
        extra = f"## {title}\n\n{text}"
        if out and len(out[-1][1]) < least and len(out[-1][1]) + len(extra) + 2 <= most:
            out[-1] = (out[-1][0], clean(f"{out[-1][1]}\n\n{extra}"))
        else:
            out.append((title, text))
    return out


def merge_tiny(parts: list[tuple[str, str, str]], most: int, least: int) -> list[tuple[str, str, str]]:
    """A tiny chunk joins the one before, else the one after it (which then takes its title), while the limit holds.

    ``parts`` are ``(title, section title, body)``; what a merge makes is looked at again.
    """
    tiny = max(TINY_FLOOR, least // 2)
    done: list[tuple[str, str, str]] = []
    todo = list(reversed(parts))
    while todo:
        title, section, body = todo.pop()
        if len(clean(body)) < tiny:
            if done:
                joined = clean(f"{done[-1][2]}\n\n{_headed(title, body)}")
                if len(joined) <= most:
                    done[-1] = (*done[-1][:2], joined)
                    continue
            if todo:
                joined = clean(f"{body}\n\n{_headed(todo[-1][0], todo[-1][2])}")
                if len(joined) <= most:
                    todo[-1] = (title, section, joined)
                    continue
        done.append((title, section, body))
    return done


def chunk_parts(found: list[tuple[str, str]], most: int, least: int) -> tuple[int, list[tuple[str, str, str]]]:
    """``(initial number of chunks, final chunks)`` of the sections of one text."""
    first: list[tuple[str, str, str]] = []
    for title, text in merge_small(found, most, least):
        pieces = split_long(text, most)
        for n, p in enumerate(pieces):
            first.append((f"{title} Part {n + 1}" if len(pieces) > 1 else title, title, clean(p)))
    return len(first), merge_tiny(first, most, least)


_CHUNK = "title string, section_title string, ord int, text string, initial_chunks int, last int"


def segment(books: DataFrame, *, max_chars: int = MAX_CHARS, min_chars: int | None = None, text: str = "text") -> DataFrame:
    """Chunk rows of ``books(book_id, text)``: ids, links, counts, previews and hashes filled in.

    Null and empty texts give no chunk.
    """
    most, least = limits(max_chars, min_chars)
    rows = books.select("book_id", F.col(text).alias("s"))
    kind = dict(rows.dtypes)["book_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for book, found in zip(b["book_id"], b["s"]):
                initial, parts = chunk_parts(text_sections(found), most, least)
                out += [(book, t, s, n, body, initial, len(parts) - 1) for n, (t, s, body) in enumerate(parts)]
            yield pd.DataFrame(out, columns=["book_id", "title", "section_title", "ord", "text", "initial_chunks", "last"])

    return chunk_columns(rows.mapInPandas(run, f"book_id {kind}, {_CHUNK}"))


def chunk_id(ord_: Column) -> Column:
    return F.format_string("ch%03d", ord_)


def chunk_columns(parts: DataFrame) -> DataFrame:
    """The derived columns of chunks. Ordinals are dense and the last one is known, so the neighbours' ids follow row by row."""
    body = F.col("text")
    return parts.select(
        "book_id", chunk_id(F.col("ord")).alias("chunk_id"), "title", "section_title", "ord", F.concat(F.lit("chunks/"), chunk_id(F.col("ord")), F.lit(".md")).alias("chunk_path"), "text",
        F.length(body).alias("char_count"), count_words(body).alias("word_count"), preview(body).alias("preview"), F.sha2(body, 256).alias("chunk_hash"),
        F.array().cast("array<string>").alias("keywords"), F.lit(None).cast("string").alias("summary"),
        F.when(F.col("ord") > 0, chunk_id(F.col("ord") - 1)).alias("prev_id"), F.when(F.col("ord") < F.col("last"), chunk_id(F.col("ord") + 1)).alias("next_id"), "initial_chunks",
    )


def links(chunks: DataFrame) -> DataFrame:
    """``book_id, chunk_id, prev_id, next_id`` by the order of the chunks."""
    w = Window.partitionBy("book_id").orderBy("ord", "chunk_id")
    return chunks.select("book_id", "chunk_id", F.lag("chunk_id").over(w).alias("prev_id"), F.lead("chunk_id").over(w).alias("next_id"))


def stats(chunks: DataFrame, size: Column | None = None) -> DataFrame:
    """Per book: chunk count, total, mean (half up), least and most characters; an unknown size counts as 0."""
    n = F.coalesce(F.col("char_count") if size is None else size, F.lit(0))
    return chunks.groupBy("book_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.sum(n).alias("total_chars"), F.floor(F.avg(n) + 0.5).alias("average_chunk_chars"), F.min(n).alias("min_chunk_chars"), F.max(n).alias("max_chunk_chars"))


def short_chunks(chunks: DataFrame, least: int) -> DataFrame:
    return chunks.groupBy("book_id").agg(F.count_if(F.coalesce(F.length("text"), F.lit(0)) < least).alias("short_chunks"))


