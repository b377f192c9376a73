"""Problem 6: oversized texts cut into pieces under a limit, at natural boundaries, with overlap.

Method: the offsets of a text's tokens are prefix sums of token lengths; the
places where a cut is natural form one sorted array per strength.  Each step
takes the last boundary under the limit by binary search, then steps back by
the overlap; without any boundary the cut is hard.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.index import live

#: Tokens: blank-line gaps, other space runs, words, runs of closing signs, single signs.
_TOKEN = regex.compile(r"\s*\n\s*\n\s*|\s+|[\p{L}\p{M}\p{N}_]+|[.!?。！？…।॥]+[\p{Pe}\p{Pf}\"'”’」』》）]*|[^\p{L}\p{M}\p{N}_\s]")
#: What ends a sentence, a clause.
_STOP, _PAUSE = set(".!?。！？…।॥"), set(",;:，、；：،—")
#: Scripts written without spaces: a cut between two of their letters is a word-level boundary.
_DENSE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
_EXTEND = regex.compile(r"[\p{M}‍︀-️]")


def boundaries(text: str) -> list[np.ndarray]:
    """Sorted cut offsets, strongest kind first: paragraph, line, sentence, clause, word."""
    kinds: list[list[int]] = [[], [], [], [], []]
    tokens = _TOKEN.findall(text)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
    for k, (tok, end) in enumerate(zip(tokens, ends.tolist())):
        if tok[0].isspace():
            if tok.count("\n") > 1:
                kinds[0].append(end)
            elif "\n" in tok:
                kinds[1].append(end)
            before = tokens[k - 1][0] if k else ""
            kinds[2 if before in _STOP else 3 if before in _PAUSE else 4].append(end)
        elif tok[0] in _STOP and tok[0] not in ".":
            kinds[2].append(end)
        elif tok[0] in _PAUSE:
            kinds[3].append(end)
        elif len(tok) > 1 and _DENSE.match(tok):
            kinds[4].extend(range(end - len(tok) + 1, end + 1))
        elif _DENSE.match(tok):
            kinds[4].append(end)
    return [np.array(x, np.int64) for x in kinds]


def cut_points(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """``[begin, end)`` of each piece: none longer than ``limit``, each beginning ``overlap`` before the last end.

    A kind of boundary is used if its last place under the limit leaves the
    piece at least half full; else the next weaker kind is tried, then any
    boundary that makes progress, then a hard cut that spares combining marks.
    """
    n = len(text)
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    if n <= limit:
        return [(0, n)] if n else []
    kinds = [x.tolist() for x in boundaries(text)]
    out, begin = [], 0
    while n - begin > limit:
        top, low = begin + limit, begin + overlap + 1
        end = 0
        for least in (max(low, begin + limit // 2), low):
            for marks in kinds:
                k = bisect_right(marks, top)
                if k and marks[k - 1] >= least:
                    end = marks[k - 1]
                    break
            if end:
                break
        if end and _EXTEND.match(text[end]):
            end = 0
        if not end:
            end = top
            while end > low and _EXTEND.match(text[end]):
                end -= 1
            end = top if end <= low else end
        out.append((begin, end))
        begin = end - overlap
    return [*out, (begin, n)]


def pieces(df: DataFrame, keys: list[str], text: str = "text", limit: str = "max_chars", overlap: str = "overlap_chars") -> DataFrame:
    """``keys, piece_no, begin_off, end_off, piece`` of every row whose text is longer than its limit.

    Rows within the limit, and those with a null text or limit, give nothing;
    a null or negative overlap counts as 0 and one of ``limit`` or more as
    ``limit - 1``.  A limit below 1 counts as 1.
    """
    over = df.select(*keys, F.col(text).alias("_text"), F.col(limit).cast("int").alias("_limit"), F.coalesce(F.col(overlap), F.lit(0)).cast("int").alias("_overlap")).where("length(_text) > _limit")
    types = dict(over.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for *key, t, lim, lap in b[[*keys, "_text", "_limit", "_overlap"]].itertuples(index=False, name=None):
                rows += [(*key, no, i, j, t[i:j]) for no, (i, j) in enumerate(cut_points(t, int(lim), int(lap)))]
            yield pd.DataFrame(rows, columns=[*keys, "piece_no", "begin_off", "end_off", "piece"])

    return over.mapInPandas(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "piece_no int, begin_off int, end_off int, piece string"]))


def chunk_pieces(chunks: DataFrame, profiles: DataFrame) -> DataFrame:
    """Pieces of the oversized chunks; a chunk loaded again is cut once, as it was loaded last.

    ``chunks.char_count`` is never consulted.  ``profiles`` has one row per
    import profile, so Spark's own size check lets it broadcast.  Chunks no
    longer than the smallest limit leave first; of the others the latest
    delivery is told by keys and times, and no text is shuffled.
    """
    limits = profiles.select("import_profile", "max_chars", "overlap_chars").dropDuplicates(["import_profile"])
    least = limits.agg(F.min("max_chars")).first()[0]
    long = chunks.select("book_id", "chunk_id", "import_profile", "text", "loaded_at").where(F.length("text") > (1 << 31) - 1 if least is None else F.length("text") > least)
    last = live(long, ["book_id", "chunk_id"], "loaded_at").join(limits, "import_profile").where("length(text) > max_chars")
    return pieces(last, ["book_id", "chunk_id"])
