"""Text functions, Column -> Column, inside whole-stage code generation.

Lengths and offsets are Unicode code points throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space class of the library's text rules (wider than Java's ``\s``).
WS = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: Word and ideograph patterns.
ASCII_WORD = r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?"
HAN_RUN = r"\p{IsHan}+"
CJK_CHAR = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
#: What makes a line a chapter title.
CHAPTER_PATTERNS = (
    r"^#{1,3}\s+.+\z",
    r"^第[一二三四五六七八九十百千万零〇0-9]+[章节回篇卷部].*\z",
    r"^[一二三四五六七八九十百千万零〇0-9]+[、.．]\s*.+\z",
    r"^(?i:Chapter)\s+[0-9IVXLCDMivxlcdm]+(?:\s*[:：]\s*.+|\s+.+)?\z",
)
#: Fixed value: the title of a piece that has none.
UNTITLED = "片段"
#: Scores of characters that a wrong charset leaves behind.
MISDECODED = (("\\x{fffd}", 30), ("\\x{0000}", 20), ("[\\x{0001}-\\x{0008}\\x{000b}\\x{000c}\\x{000e}-\\x{001f}]", 10), ("[锟斤拷ÃÂÐÑÊÖÎ]", 2))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` and its lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def clean_text(c: Column) -> Column:
    """Line ends, control characters, spaces around and runs of spaces, blank lines; trimmed. Null gives ''."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    c = F.regexp_replace(c, r"[ \t]*\n[ \t]*", "\n")
    c = F.regexp_replace(c, r"[ \t]{2,}", " ")
    return trim_ws(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def inline(c: Column) -> Column:
    """All white space as single spaces, trimmed. Null gives ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{WS}+", " "))


def preview(c: Column, most: int = 120) -> Column:
    return F.substring(inline(c), 1, most)


def count_words(c: Column) -> Column:
    """ASCII words plus ideographs and kana."""
    c = F.coalesce(c, F.lit(""))
    return F.regexp_count(c, F.lit(ASCII_WORD)) + F.regexp_count(c, F.lit(CJK_CHAR))


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences; an empty part occurs nowhere."""
    n = F.length(part)
    return F.when(n > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / n).cast("int")).otherwise(0)


def normalize_title(c: Column) -> Column:
    bare = trim_ws(F.regexp_replace(F.coalesce(c, F.lit("")), r"^#{1,3}\s+", ""))
    return F.when(bare == "", UNTITLED).otherwise(bare)


def content_hash(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def is_chapter_title(line: Column) -> Column:
    """2 to 80 characters, no sentence end, and one of the title patterns. Null is no title."""
    hit = line.rlike(CHAPTER_PATTERNS[0])
    for p in CHAPTER_PATTERNS[1:]:
        hit = hit | line.rlike(p)
    return F.coalesce(F.length(line).between(2, 80) & ~line.rlike("[。；;]") & hit, F.lit(False))


def misdecode_score(c: Column) -> Column:
    """How much a text looks wrongly decoded; empty text scores 1000."""
    c = F.coalesce(c, F.lit(""))
    score = sum((F.regexp_count(c, F.lit(p)) * w for p, w in MISDECODED), F.lit(0))
    return F.when(c == "", 1000).otherwise(score)


def search_preview(text: Column, query: Column, matched: Column, most: int) -> Column:
    """The part of ``text`` around the first hit of the query, else of the first matched term, else its head."""
    def around(source: Column) -> Column:
        q = inline(query)
        at = F.when(q == "", F.lit(1)).otherwise(F.call_function("instr", source, q))
        first = F.filter(F.transform(matched, lambda t: F.call_function("instr", source, t)), lambda p: p > 0)
        return let(F.when(at > 0, at).otherwise(F.coalesce(F.try_element_at(first, F.lit(1)), F.lit(0))), lambda pos: window(source, pos))

    def window(source: Column, pos: Column) -> Column:
        start = F.greatest(F.lit(0), pos - 1 - most // 2)
        end = F.least(F.length(source), start + most)
        cut = F.concat(F.when(start > 0, "……").otherwise(""), F.substring(source, start + 1, F.lit(most)), F.when(end < F.length(source), "……").otherwise(""))
        return F.when(source == "", "").when(pos > 0, cut).otherwise(F.substring(source, 1, most))

    return let(inline(text), around)


#: Names of documents that aren't part of the reading text.
SKIPPED_WORDS, SKIPPED_TITLES = "cover|nav|toc|titlepage|copyright|contents", "目录|封面|版权"


def skippable_name(c: Column) -> Column:
    """Names of covers, tables of contents and the like."""
    c = F.lower(F.coalesce(c, F.lit("")))
    return c.rlike(SKIPPED_TITLES) | c.rlike(rf"^(?:{SKIPPED_WORDS})[-_]?\d*\z") | c.rlike(rf"(?:^|[-_])(?:{SKIPPED_WORDS})(?:[-_]|\z)")


def html_like(media_type: Column) -> Column:
    m = F.lower(F.coalesce(media_type, F.lit("")))
    return (m == "") | m.contains("application/xhtml+xml") | m.contains("text/html")


def file_stem(path: Column) -> Column:
    """File name without folder and extension; back slashes count as slashes."""
    name = F.regexp_extract(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), r"([^/]*)\z", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")


def metadata_value(c: Column) -> Column:
    """Trimmed, outer quotes removed; null if empty or longer than 120."""
    v = trim_ws(F.regexp_replace(F.regexp_replace(trim_ws(c), "^[\"'“‘《]+", ""), "[\"'”’》]+\\z", ""))
    return F.when((v != "") & (F.length(v) <= 120), v)


#: What no author begins with; lines that name a title or an author; keys of front matter.
NO_AUTHOR = r"^(?:第[一二三四五六七八九十百千万零〇0-9]+[章节回篇卷部]|(?i:Chapter)\s+)"
TITLE_LINES = (r"^(?:书名|标题)\s*[:：]\s*(.+)\z", r"(?i)^Title\s*:\s*(.+)\z")
AUTHOR_LINES = (r"^(?:作者|著者)\s*[:：]\s*(.+)\z", r"(?i)^Author\s*:\s*(.+)\z", r"(?i)^By\s+(.+)\z")
FRONT_TITLE, FRONT_AUTHOR = r"(?i)^title\s*:\s*(.+)\z", r"(?i)^author\s*:\s*(.+)\z"


def valid_author(c: Column) -> Column:
    return c.isNotNull() & (F.length(c) <= 80) & ~is_chapter_title(c) & ~c.rlike(NO_AUTHOR)


def _first(lines: Column, pick) -> Column:
    return F.try_element_at(F.filter(F.transform(lines, pick), lambda v: v.isNotNull()), F.lit(1))


def _group(line: Column, pattern: str) -> Column:
    return F.when(line.rlike(pattern), F.regexp_extract(line, pattern, 1))


def infer_metadata(text: Column, path: Column) -> Column:
    """``struct(title, author)`` from front matter or the first 30 lines; the title defaults to the file stem."""
    title_of = lambda x: metadata_value(F.coalesce(*(_group(x, p) for p in TITLE_LINES)))
    author_of = lambda x: metadata_value(F.coalesce(*(_group(x, p) for p in AUTHOR_LINES)))

    def of_lines(lines: Column) -> Column:
        end = F.array_position(F.slice(lines, 2, 29), "---")
        front = F.when((F.try_element_at(lines, F.lit(1)) == "---") & (end > 1), F.slice(lines, F.lit(2), (end - 1).cast("int"))).otherwise(F.array().cast("array<string>"))
        title_fm = _first(front, lambda x: metadata_value(_group(x, FRONT_TITLE)))
        author_fm = _first(front, lambda x: metadata_value(_group(x, FRONT_AUTHOR)))
        title = F.coalesce(title_fm, _first(lines, title_of), file_stem(path))
        author = F.coalesce(author_fm, _first(lines, lambda x: F.when(valid_author(author_of(x)), author_of(x))))
        return F.struct(title.alias("title"), author.alias("author"))

    return let(F.transform(F.slice(F.split(clean_text(text), "\n"), 1, 30), trim_ws), of_lines)


def strip_front_matter(text: Column) -> Column:
    """The text without a leading ``---`` block that closes within 50 lines."""

    def of_lines(lines: Column) -> Column:
        end = F.array_position(F.transform(F.slice(lines, 2, 49), trim_ws), "---")
        rest = F.array_join(F.slice(lines, (end + 2).cast("int"), F.size(lines)), "\n")
        return F.when((trim_ws(F.try_element_at(lines, F.lit(1))) == "---") & (end > 0), clean_text(rest)).otherwise(F.array_join(lines, "\n"))

    return let(F.split(clean_text(text), "\n"), of_lines)


def html_heading(html: Column) -> Column:
    """Text of the first h1 to h3, tags stripped; '' without one."""
    return clean_text(F.regexp_replace(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>", 1), r"<[^>]*>", ""))


def normalize_list(c: Column) -> Column:
    """Entries trimmed, blanks and nulls dropped; null gives an empty list."""
    return F.coalesce(F.filter(F.transform(c, trim_ws), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def truncated(c: Column, most: int = 12_000) -> Column:
    """``struct(text, truncated)``."""
    c = F.coalesce(c, F.lit(""))
    return F.struct(F.substring(c, 1, most).alias("text"), (F.length(c) > most).alias("truncated"))


def safe_file_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1F]', "_"), r"[. ]+\z", "")
