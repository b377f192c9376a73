"""Problem 4: one form for text that looks the same.

Method: Arrow text is copied to numpy code-point arrays; folding is a gather
through lookup tables with expansion offsets, and marks are composed
vectorially.  No string function is called for a single row.

The form keeps case, accents, marks and words.  It removes invisible
characters and outer spaces, turns every kind of space into U+0020, folds
width and presentation forms, maps look-alike letters of Cyrillic, Greek and
CJK to one representative, and composes (NFC order).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters drawn alike, each with its representative.
LOOKALIKES = {
    # Cyrillic small
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    # Cyrillic capital
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W",
    # Greek small
    "ν": "v", "ο": "o", "ι": "i", "ρ": "p", "α": "a", "υ": "u", "ϲ": "c", "ϳ": "j",
    # Greek capital
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    # Latin
    "ı": "i", "ɑ": "a", "ɡ": "g", "ſ": "f",
    # kana and ideographs
    "ニ": "二", "ロ": "口", "エ": "工", "タ": "夕", "ト": "卜", "ハ": "八", "カ": "力", "ー": "一", "へ": "ヘ", "べ": "ベ", "ぺ": "ペ",
    # signs
    "‐": "-", "‑": "-", "−": "-", "′": "'", "’": "'", "‘": "'", "ʼ": "'", "‚": ",", "․": ".", "∶": ":", "ː": ":", "꞉": ":", "⁄": "/", "∕": "/", "∣": "|", "ǀ": "|", "·": "・", "•": "・",
}

#: Kinds of compatibility decomposition that leave the look unchanged.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>"}
#: Invisible characters beside the categories Cf and Cc.
INVISIBLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
#: Spacing forms of marks, which aren't folded to space plus mark.
SPACING = {0xA8, 0xAF, 0xB4, 0xB8, 0x2017, *range(0x02D8, 0x02DE), 0x037A, 0x0384, *range(0x1FBD, 0x1FC1), *range(0x1FCD, 0x1FD0), *range(0x1FDD, 0x1FE0), 0x1FED, 0x1FEE, 0x1FEF, 0x1FFD, 0x1FFE, 0x203E, *range(0xFE49, 0xFE50)}

_TOP = 0x110000


def _fold(cp: int, depth: int = 0) -> list[int]:
    """Full decomposition of one code point into the representatives of its look."""
    ch = chr(cp)
    cat = unicodedata.category(ch)
    if cat in ("Zs", "Zl", "Zp") or ch in "\t\n\v\f\r\x85":
        return [0x20]
    if cat in ("Cf", "Cc") or cp in _INVISIBLE:
        return []
    d = unicodedata.decomposition(ch)
    if 0xAC00 <= cp < 0xD7A4:
        return [ord(x) for x in unicodedata.normalize("NFD", ch)]
    if d and cp not in SPACING and depth < 6:
        kind, _, rest = d.partition(" ") if d.startswith("<") else ("", "", d)
        if not kind or kind in SAME_LOOK:
            return [y for x in rest.split() for y in _fold(int(x, 16), depth + 1)]
    return [ord(LOOKALIKES[ch])] if ch in LOOKALIKES else [cp]


_INVISIBLE = set(INVISIBLE)


@lru_cache(1)
def tables() -> dict[str, np.ndarray]:
    """Lookup tables by code point, built once per process from the character database."""
    size, start = np.ones(_TOP, np.uint8), np.arange(_TOP, dtype=np.int32)
    ccc = np.zeros(_TOP, np.uint8)
    flat: list[int] = []
    pairs: dict[int, int] = {}
    for cp in (*range(0x3400), *range(0xA640, 0xABFF), *range(0xAC00, 0xD7A4), *range(0xF900, 0x10000), *range(0x10000, 0x12000), *range(0x16A00, 0x17000), *range(0x1BC00, 0x1BD00), *range(0x1D000, 0x1F300), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE01F0)):
        ch = chr(cp)
        ccc[cp] = unicodedata.combining(ch)
        f = _fold(cp)
        if f != [cp]:
            size[cp], start[cp] = len(f), -1 - len(flat)
            flat += f
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and len(d.split()) == 2 and unicodedata.normalize("NFC", ch) == ch:
            a, b = (int(x, 16) for x in d.split())
            pairs.setdefault((ord(LOOKALIKES.get(chr(a), chr(a))) << 21) | b, cp)
    for lead in range(19):  # conjoining jamo, by the standard's arithmetic
        for vowel in range(21):
            lv = 0xAC00 + (lead * 21 + vowel) * 28
            pairs[((0x1100 + lead) << 21) | (0x1161 + vowel)] = lv
            for tail in range(1, 28):
                pairs[(lv << 21) | (0x11A7 + tail)] = lv + tail
    keys = np.array(sorted(pairs), np.int64)
    return {"size": size, "start": start, "flat": np.array(flat, np.uint32), "ccc": ccc, "keys": keys, "made": np.array([pairs[k] for k in keys.tolist()], np.uint32)}


def to_points(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a whole Arrow string column, and each row's start among them (nulls are empty)."""
    col = col.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), lead[offsets - offsets[0]]


def to_arrow(cp: np.ndarray, rows: np.ndarray) -> pa.Array:
    """The reverse of :func:`to_points`."""
    width = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
    ends = np.concatenate(([0], np.cumsum(width)))[rows]
    data = cp.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    return pa.LargeStringArray.from_buffers(len(rows) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def _keep(cp: np.ndarray, rows: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return cp[keep], np.concatenate(([0], np.cumsum(keep)))[rows]


def _expand(cp: np.ndarray, rows: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    size, start = t["size"][cp].astype(np.int64), t["start"][cp]
    ends = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat(np.arange(len(cp)), size)
    step = np.arange(ends[-1]) - ends[at]
    own = start[at]
    out = np.where(own < 0, t["flat"][np.clip(-1 - own + step, 0, len(t["flat"]) - 1)], own)
    return out.astype(np.uint32), ends[rows]


def _row_of(rows: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(rows) - 1), np.diff(rows))


def _order(cp: np.ndarray, rows: np.ndarray, t: dict) -> np.ndarray:
    """Canonical order: runs of marks stably sorted by combining class."""
    ccc = t["ccc"][cp]
    if not ccc.any():
        return cp
    new = ccc == 0
    new[rows[:-1][np.diff(rows) > 0]] = True
    return cp[np.lexsort((np.arange(len(cp)), ccc, np.cumsum(new)))]


def _compose(cp: np.ndarray, rows: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of starter and unblocked mark become one code point, until none is left."""
    cp = cp.copy()
    while len(cp):
        n, ccc, row = len(cp), t["ccc"][cp], _row_of(rows)
        place = np.arange(n)
        last = np.maximum.accumulate(np.where(ccc == 0, place, -1))
        prev = np.concatenate(([-1], last[:-1]))  # last starter before each place
        ok = (prev >= 0) & (row[np.maximum(prev, 0)] == row)
        before = np.concatenate(([0], ccc[:-1]))
        ok &= (prev == place - 1) | ((before > 0) & (before < ccc))
        key = (cp[np.maximum(prev, 0)].astype(np.int64) << 21) | cp
        found = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
        ok &= t["keys"][found] == key
        at = np.flatnonzero(ok)
        if not len(at):
            break
        _, first = np.unique(prev[at], return_index=True)  # one mark for each starter and pass
        at = at[first]
        at = at[~np.isin(prev[at], at)]  # its starter isn't itself taken in this pass
        cp[prev[at]] = t["made"][found[at]]
        keep = np.ones(n, bool)
        keep[at] = False
        cp, rows = _keep(cp, rows, keep)
    return cp, rows


def _strip(cp: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    solid = np.concatenate(([0], np.cumsum(cp != 0x20)))
    row = _row_of(rows)
    seen = solid[1:] - solid[rows[:-1]][row]  # solid characters of the row up to here
    whole = solid[rows[1:]][row] - solid[rows[:-1]][row]
    left = seen > 0
    right = (whole - seen > 0) | (cp != 0x20)
    return _keep(cp, rows, left & right)


def one_form(col: pa.Array) -> pa.Array:
    """Canonical form of an Arrow string column; null stays null."""
    t = tables()
    cp, rows = to_points(col)
    cp, rows = _expand(cp, rows, t)
    cp = _order(cp, rows, t)
    cp, rows = _compose(cp, rows, t)
    # composed letters whose base is a look-alike were built on the representative
    cp, rows = _strip(cp, rows)
    out = to_arrow(cp, rows)
    return out if not col.null_count else pa.compute.if_else(col.is_null(), pa.scalar(None, pa.string()), out)


def with_form(df: DataFrame, column: str, to: str) -> DataFrame:
    """``df`` and its ``column`` in one form as ``to`` (replaced where it exists).

    Null gives null; empty or invisible text gives the empty string; texts of
    any length are taken whole; all other columns pass unchanged.
    """
    schema = df.drop(to).withColumn(to, F.lit(None).cast("string")).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = one_form(b.column(b.schema.get_field_index(column)))
            yield pa.RecordBatch.from_arrays([made if n == to else b.column(b.schema.get_field_index(n)) for n in names], names=names)

    return df.mapInArrow(run, schema)


def alike_pairs(left: DataFrame, left_id: str, left_text: str, right: DataFrame, right_id: str, right_text: str) -> DataFrame:
    """``(left_id, right_id)`` whose texts are different strings of one form.

    Work is done once per distinct text: each side is reduced to its distinct
    strings before folding, forms are joined by equality, and ids are attached
    last, so re-delivered rows and popular texts cost nothing in the fold.
    Null texts and texts without a visible character match nothing.
    """
    def side(df: DataFrame, key: str, text: str, tag: str) -> tuple[DataFrame, DataFrame]:
        ids = df.select(F.col(key).alias(f"{tag}_id"), F.col(text).alias(f"{tag}_text")).where(f"{tag}_text IS NOT NULL AND {tag}_id IS NOT NULL").distinct()
        return ids, with_form(ids.select(f"{tag}_text").distinct(), f"{tag}_text", "form").where("form <> ''")

    (a_ids, a), (b_ids, b) = side(left, left_id, left_text, "a"), side(right, right_id, right_text, "b")
    texts = a.join(b.hint("merge"), "form").where("a_text <> b_text").select("a_text", "b_text")
    return texts.join(a_ids.hint("merge"), "a_text").join(b_ids.hint("merge"), "b_text").select(F.col("a_id").alias(left_id), F.col("b_id").alias(right_id)).distinct()
