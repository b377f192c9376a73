"""Problem 3: records of two tables that describe the same thing, without a shared key.

Method: cross-table retrieval.  The right side is an inverted index over all
attributes scored by BM25; each left record asks it with exact pruning; a work
stays if it is the nearest of the record and the record is among the nearest of
the work; the confidence comes from the gap to the best different work, and
from the share of the possible score, through a fitted logistic curve.  An
exact check of volume, authors and spelling follows.

The curve is fitted on truth that is known by construction: a bounded sample
of right records is garbled (letters swapped or lost, authors shortened, turned
round or left out) and asked with the left ones in the same pass, once with
its own work in the index and once as if that weren't there.

Pruning is exact: a pair below ``FLOOR`` of what the asking record's title
could score at most can't be a match, so terms are taken rarest first until
the rest together can't reach that floor.  Only these essential terms generate
candidates (no pair above the floor is lost), and a candidate is scored in
full only if its essential part plus the most the rest can add reaches it.
Words unknown to the index count in the highest possible score, so a record
without a counterpart asks for next to nothing.

The index holds words, and pairs of signs for scripts without spaces.  A word
also meets, at ``SLIP`` of its weight, the index words one slip of the pen
away: these are found once for each distinct word, by shared one-letter
deletions.  Rarity enters
with the power ``RARITY``, so common words carry little of a score.

No table here is broadcast: each grows with the data, and the files of a
written one are far smaller than the table in memory, so every join merges.

Both sides are first reduced to their distinct forms (folded title, volume,
authors), so copies, re-deliveries and popular titles are matched once.  A work
is all forms of one title: its volumes and copies score alike and are no rivals.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.glyphs import one_form
from lectern.runtime import bounded_sample, cut

K1, B = 1.2, 0.5
#: Power of a term's rarity in its weight.
RARITY = 3
#: Share of a title's highest possible score below which no pair is considered.
FLOOR = 0.4
#: Weight of a term that is met with a slip.
SLIP = 0.6
#: Share at which an unknown pair of signs counts in the highest possible score, as one slip spoils up to three.
SPOILT = 0.4
#: Works looked at for each record. Only a nearest work is accepted, so any number above 1 loses none.
TOP_K = 12
#: Right records that are garbled to fit the confidence curve, at most; each is asked twice.
PROBES = 1_000

#: Letters that still look alike once capitals are folded.
_LOW = str.maketrans("кмтнвεακτιυχоοд", "kmthbeaktiuxooд")
#: What imports leave behind at the end of a title.
_LEFTOVER = re.compile(r"(?:_?(?:full|final|copy|new|v\d+))?\.(?:epub|txt|md|pdf|mobi|azw3)$|_(?:full|final|copy|new)$|(?<=\S) ?\(\d{1,2}\)$")
#: Words of an edition or a genre, in folded form.
GENRES = "a novel|novel|illustrated|roman|romance|novela|novelle|erzählung|poman|roman|повесть|роман|сборник|一部长篇|长篇小说|长篇|小説|長編小説|长编|उपन्यास|นวนิยาย"
_VOLUME = re.compile(
    r"[\s,.:;\-]*[(\[]?\b(?:volume|vol|book|band|bd|buch|teil|tome|tomo|libro|livro|livre|part|tom|toм|ч|чactь|khига|kниra|kниga|knига|khura|kh\w+a|भाग|เล่ม)\b\.?\s*([0-9]{1,3}|[ivx]{1,5}|[一二三四五六七八九十]{1,3})[)\]]?\s*$"
    r"|[\s]*(?:第\s*)([0-9一二三四五六七八九十]{1,3})\s*[册卷部巻集]$|\s*[卷巻册]\s*([0-9一二三四五六七八九十]{1,3})$|\s*\(([0-9一二三四五六七八九十上中下]{1,3})\)$|\s+(i{1,3}|iv|vi{0,3}|ix|x)$"
)
_NUMBER = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10, "上": 1, "中": 2, "下": 3}
_BRACKET = re.compile(r"\s*(?:\([^()]*\)|\[[^\[\]]*\]|【[^【】]*】|〔[^〔〕]*〕)\s*")
_PLAIN_VOLUME = re.compile(r"[(\[](?:(?:vol|volume|book|band|bd|tome|tomo|tom)\.? ?)?(?:[0-9]{1,3}|[ivx]{1,5}|[一二三四五六七八九十上中下]{1,3})[)\]]")
_ROLE = re.compile(r"\((?:author|auteur|autor|autora|hrsg\.?|ed\.?|eds\.?|coct\.?|сост\.?|著|编|編|译)\)|^(?:by|von|par|por|de|abtop|автор|author|作者)\s*[:.]?\s+|^作者\s*:\s*|\s*[著编編译訳]$|\s(?:著|编|編|译|訳)(?=$|\s)")
_DENSE = re.compile(r"[㐀-鿿぀-ヿ฀-๿]")
_WORD = re.compile(r"[^\W_]+(?:[̀-ͯ][^\W_]*)*")
#: Articles and joining words, which carry no weight in comparing titles word by word.
SMALL = set("the a an of and for der die das und eine ein für von le la les un une de du des et pour el los las y para o os as uma um e do da dos das и для в на".split())


def fold_many(values: list[str | None]) -> list[str]:
    """Comparison form: one look, no case, no accents on letters, single spaces."""
    out = []
    for s in one_form(pa.array(values, pa.string())).to_pylist():
        if not s:
            out.append("")
            continue
        s = unicodedata.normalize("NFD", s.lower())
        s = re.sub("[̀-ͯ]", "", s).translate(_LOW)
        out.append(" ".join(unicodedata.normalize("NFC", s).split()))
    return out


@lru_cache(1)
def _genre() -> re.Pattern:
    words = sorted({w for w in fold_many(GENRES.split("|")) if w}, key=len, reverse=True)
    return re.compile(r"\s*[:\-–—]\s*(?:" + "|".join(map(re.escape, words)) + r")\b\s*|\s*[:\-–—]\s*(?:" + "|".join(map(re.escape, (w for w in words if _DENSE.search(w)))) + ")")


def title_form(folded: str) -> tuple[str, int]:
    """``(core title, volume)`` of a folded title; volume 0 where none is named."""
    s = folded.strip("《》«»\"“”「」『』 ")
    for _ in range(3):
        s = _LEFTOVER.sub("", s).strip("《》«»\"“” ")
    s = _genre().sub(" ", s).strip()
    volume = 0
    for _ in range(4):
        m = _VOLUME.search(s)
        if m and m.start() > 0 and not volume:
            v = next(g for g in m.groups() if g)
            volume = int(v) if v.isdigit() else _NUMBER.get(v, 0) or (10 + _NUMBER.get(v[-1], 0) if v[0] == "十" else 0)
            s = s[: m.start()].strip("《》«» ,.:;-")
            continue
        b = next((b for b in _BRACKET.finditer(s) if not _PLAIN_VOLUME.fullmatch(b.group().strip())), None)
        if b and b.group().strip() != s:
            s = (s[: b.start()] + " " + s[b.end() :]).strip()
            s = _LEFTOVER.sub("", s).strip("《》«» ")
            s = _genre().sub(" ", s).strip()
            continue
        break
    if m := re.fullmatch(r"(.+), (the|a|an|der|die|das|le|la|les|el|los|las|o|a|os|as)", s):
        s = f"{m[2]} {m[1]}"
    return " ".join(s.split()), volume


def author_forms(folded: str) -> list[tuple[str, ...]]:
    """Each author as a sorted tuple of name parts."""
    out = []
    for part in re.split(r"[;、/]| & | and | und | et (?=\w{3})", folded):
        part = re.sub(r"【[^】]*】|\[[^\]]*\]|〔[^〕]*〕", " ", part)
        part = _ROLE.sub(" ", _ROLE.sub(" ", part.strip())).strip(" .,:")
        words = tuple(sorted(_WORD.findall(part)))
        if words:
            out.append(words)
    return sorted(set(out))


def terms(core: str, authors: list[tuple[str, ...]]) -> dict[str, float]:
    """Weighted terms of a form: words, and pairs of neighbouring signs of scripts without spaces."""
    out: dict[str, float] = {}

    def add(field: str, word: str) -> None:
        dense = _DENSE.search(word)
        for r in ([word] if len(word) < 2 else [word[k : k + 2] for k in range(len(word) - 1)]) if dense else [word]:
            key = f"{field}{'c' if dense else 'w'}{r}"
            out[key] = out.get(key, 0) + 1.0

    for w in _WORD.findall(core):
        add("t", w)
    for a in authors:
        for w in a:
            add("a", w)
    return out


def skipped_pairs(core: str) -> list[str]:
    """Pairs of signs with one between them, as terms: what a slip makes of neighbours."""
    return sorted({f"tc{w[k]}{w[k + 2]}" for w in _WORD.findall(core) if _DENSE.search(w) for k in range(len(w) - 2)})


def _distance(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions, or ``most + 1`` once it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, rows[-2][j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        rows.append(row)
    return rows[-1][-1]


def _slips(word: str) -> int:
    return 0 if len(word) < 4 else 1 if len(word) < 8 else 2


def title_likeness(a: str, b: str) -> float:
    """1 for equal titles, near 1 with slips of the pen, 0 where a word differs."""
    if a == b:
        return 1.0
    heads = [re.split(r"\s*[:：]\s*", s, maxsplit=1) for s in (a, b)]
    if len(heads[0]) != len(heads[1]) and (len(heads[0][0]) > 3 or _DENSE.search(a)) and heads[0][0] == heads[1][0]:
        return 0.8  # one side leaves the subtitle out
    if _DENSE.search(a + b):
        x, y = (re.sub(r"[\W_]+", "", s) for s in (a, b))
        if x == y:
            return 1.0
        if min(len(x), len(y)) < 4:
            return 0.0
        d = _distance(x, y, 2)
        if d > (1 if len(x) < 12 else 2):
            return 0.0
        if len(x) == len(y) and sorted(x) != sorted(y):
            return 0.0  # another sign, not a slip
        return 1 - d / max(len(x), len(y))
    d = _distance(a, b, 2)
    if d <= (1 if len(a) < 16 else 2) and not (set(re.findall(r"\d+", a)) ^ set(re.findall(r"\d+", b))):
        return 1 - d / max(len(a), len(b))
    u, v = ([w for w in _WORD.findall(s) if w not in SMALL] or _WORD.findall(s) for s in (a, b))
    if len("".join(u)) > len("".join(v)):
        u, v = v, u
    if "".join(u) == "".join(v):
        return 0.99
    left, total, off = list(v), sum(map(len, v)), 0
    for w in sorted(u, key=len, reverse=True):
        best = min(((_distance(w, x, _slips(max(w, x, key=len))), k) for k, x in enumerate(left)), default=(9, 0))
        if not left or best[0] > _slips(max(w, left[best[1]], key=len)):
            d = _distance("".join(u), "".join(v), 2)  # a word split or joined by a slip
            return 1 - d / max(total, 1) if d <= 1 else 0.0
        off += best[0]
        left.pop(best[1])
    if any(len(x) > 2 for x in left):
        return 0.0
    return max(0.0, 1 - (off + 0.5 * len(left)) / max(total, 1)) if off <= 3 else 0.0


def author_likeness(a: list[tuple[str, ...]], b: list[tuple[str, ...]]) -> float:
    """1 if an author of one side is one of the other's (any order, initials, slips), 0 if not, 0.5 if a side names none."""
    if not a or not b:
        return 0.5
    best = 0.0
    for x in a:
        for y in b:
            s, t = (x, y) if len(x) <= len(y) else (y, x)
            if _DENSE.search("".join(s + t)):
                p, q = "".join(s), "".join(t)
                best = max(best, 1.0 if p == q or re.sub(r"(.)\1", r"\1", p) == re.sub(r"(.)\1", r"\1", q) else 0.0)
                continue
            left, good, long = list(t), True, 0
            for w in sorted(s, key=len, reverse=True):
                hit = next((k for k, z in enumerate(left) if w == z or (len(w) == 1 and z[0] == w) or (len(z) == 1 and w[0] == z) or len(w) > 3 and _distance(w, z, _slips(w)) <= _slips(w)), None)
                if hit is None:
                    good = False
                    break
                long += min(len(w), len(left[hit])) > 2
                left.pop(hit)
            if good and long:
                best = max(best, 1.0 if len(s) == len(t) else 0.9)
    return best


_FORM = "form long, core string, volume int, authors array<array<string>>, term array<struct<t:string,w:double>>, skip array<string>"


def forms(records: DataFrame, key: str, title: str, author: str) -> tuple[DataFrame, DataFrame]:
    """``(membership: id, form)`` and ``(form, core, volume, authors, term, skip)`` of one side.

    Records without any title are left out; a missing author is no author.
    """
    rows = records.select(F.col(key).alias("id"), F.col(title).alias("title"), F.col(author).alias("author")).where("id IS NOT NULL AND title IS NOT NULL").distinct()
    kind = dict(rows.dtypes)["id"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            t = [title_form(s) for s in fold_many(b["title"].tolist())]
            a = [author_forms(s) for s in fold_many([x if isinstance(x, str) else None for x in b["author"]])]
            yield pd.DataFrame({"id": b["id"], "core": [x[0] for x in t], "volume": [x[1] for x in t], "authors": [[list(n) for n in x] for x in a]})

    folded = cut(rows.mapInPandas(fold, f"id {kind}, core string, volume int, authors array<array<string>>").where("core <> ''").withColumn("form", F.xxhash64("core", "volume", "authors")), "folded")

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(term=[[{"t": t, "w": w} for t, w in terms(c, [tuple(x) for x in a]).items()] for c, a in zip(b["core"], b["authors"])], skip=[skipped_pairs(c) for c in b["core"]])

    distinct = folded.select("form", "core", "volume", "authors").dropDuplicates(["form"]).mapInPandas(weigh, _FORM)
    return folded.select("id", "form").distinct(), cut(distinct, "forms")


def slips(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``(t, u)``: terms of ``asked(t)`` and different terms of ``known(t)`` that share a one-letter deletion; words of five letters or more."""

    def shorter(df: DataFrame, name: str) -> DataFrame:
        w = F.col("_w")
        cut_ = F.concat(F.array(w), F.transform(F.sequence(F.lit(3), F.length(w)), lambda k: F.concat(F.substring(w, F.lit(1), k - 1), F.substring(w, k + 1, F.length(w)))))
        return df.where("substring(t, 2, 1) = 'w' AND length(t) >= 7").select(F.col("t").alias("_w")).select(w.alias(name), F.explode(F.array_distinct(cut_)).alias("v"))

    return shorter(asked, "t").join(shorter(known, "u").hint("merge"), "v").where("t <> u").select("t", "u").distinct()


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(l, r, core, score, self)``: of each left form the right forms of its ``TOP_K`` best works by BM25 (ties with the last included), exactly.

    ``self`` is the highest score the title of the left form could reach,
    ``core`` the title of the right form.
    """
    post = right.select("form", F.size("term").alias("len"), F.explode("term").alias("x")).select("form", "len", F.col("x.t").alias("t"), F.col("x.w").alias("w"))
    n, mean = right.agg(F.count(F.lit(1)), F.avg(F.size("term"))).first()
    if not n:
        return left.select(F.col("form").alias("l"), F.col("form").alias("r"), F.lit("").alias("core"), F.lit(0.0).alias("score"), F.lit(0.0).alias("self")).where("false")
    gain = F.col("w") * (K1 + 1) / (F.col("w") + K1 * (1 - B + B * F.col("len") / F.lit(float(mean))))
    rarity = F.pow(F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)), RARITY)
    stats = cut(post.groupBy("t").agg(F.count(F.lit(1)).alias("df"), F.max(gain).alias("gain")).select("t", "df", rarity.alias("rarity"), (F.col("gain") * rarity).alias("top")), "stats")
    index = cut(post.join(stats.select("t", "rarity").hint("merge"), "t").select("t", F.col("form").alias("r"), (gain * F.col("rarity")).alias("s")), "index")

    own = left.select(F.col("form").alias("l"), F.explode("term").alias("x")).select("l", F.col("x.t").alias("t"))
    skip = left.select(F.col("form").alias("l"), F.explode("skip").alias("t"))
    near = cut(slips(own.select("t").distinct(), stats.select("t")), "slips")
    # which index terms each left term meets, and how well
    met = own.select("l", "t", F.col("t").alias("u"), F.lit(1.0).alias("f")).unionByName(own.join(near.hint("merge"), "t").select("l", "t", "u", F.lit(SLIP).alias("f")))
    met = met.join(stats.select(F.col("t").alias("u"), "df", "top").hint("merge"), "u", "left")
    unknown = math.log(1 + (n + 0.5) / 0.5) ** RARITY
    best_of = met.groupBy("l", "t").agg(F.max("top").alias("most")).groupBy("l").agg(F.sum(F.when(F.col("t").startswith("t"), F.coalesce("most", F.when(F.col("t").startswith("tc"), unknown * SPOILT).otherwise(unknown))).otherwise(0.0)).alias("self"))
    across = skip.select("l", F.col("t").alias("u"), F.lit(SLIP).alias("f")).join(stats.select(F.col("t").alias("u"), "df", "top").hint("merge"), "u")
    asked = met.where("top IS NOT NULL").select("l", "u", "f", "df", "top").unionByName(across.select("l", "u", "f", "df", "top")).groupBy("l", "u").agg(F.max("f").alias("f"), F.first("df").alias("df"), F.first("top").alias("top"))
    asked = asked.withColumn("most", F.col("f") * F.col("top")).join(best_of.hint("merge"), "l")
    tail = Window.partitionBy("l").orderBy(F.desc("df"), "u").rowsBetween(Window.unboundedPreceding, 0)
    asked = cut(asked.withColumn("rest", F.sum("most").over(tail)).select("l", F.col("u").alias("t"), "f", "self", "most", (F.col("rest") >= FLOOR * F.col("self")).alias("essential")), "asked")
    bounds = asked.groupBy("l").agg(F.first("self").alias("self"), F.coalesce(F.sum(F.when(~F.col("essential"), F.col("most"))), F.lit(0.0)).alias("slack"))
    part = asked.where("essential").select("l", "t", "f").join(index.hint("merge"), "t").groupBy("l", "r").agg(F.sum(F.col("f") * F.col("s")).alias("s"))
    open_ = cut(part.join(bounds.hint("merge"), "l").where(F.col("s") + F.col("slack") >= FLOOR * F.col("self")), "open")
    # the rest of the score, for the candidates that can still reach the floor
    lq = asked.where("NOT essential").groupBy("l").agg(F.collect_list(F.struct("t", "f")).alias("lt"))
    rv = index.groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct("t", "s"))).alias("rv"))
    more = F.aggregate("lt", F.lit(0.0), lambda acc, x: acc + x["f"] * F.coalesce(F.try_element_at("rv", x["t"]), F.lit(0.0)))
    full = open_.join(lq.hint("merge"), "l", "left").join(rv.hint("merge"), "r").withColumn("score", F.col("s") + F.coalesce(more, F.lit(0.0)))
    scored = full.where(F.col("score") >= FLOOR * F.col("self")).select("l", "r", "score", "self").join(right.select(F.col("form").alias("r"), "core").hint("merge"), "r")
    scored = scored.withColumn("work", F.max("score").over(Window.partitionBy("l", "core")))
    best = Window.partitionBy("l").orderBy(F.desc("work"))
    return scored.withColumn("k", F.dense_rank().over(best)).where(F.col("k") <= TOP_K).select("l", "r", "core", "score", "self")


def garbled(core: str, volume: int, authors: list[tuple[str, ...]], rnd: random.Random) -> tuple[str, int, list[tuple[str, ...]]]:
    """A record of the same work as another source may hold it."""
    signs = list(core)
    for _ in range(rnd.choice((0, 0, 1, 1, 2)) if len(signs) > 6 else 0):
        k = rnd.randrange(1, len(signs) - 1)
        if rnd.random() < 0.5:
            signs[k], signs[k + 1 :] = (signs[k + 1], [signs[k], *signs[k + 2 :]]) if k + 1 < len(signs) else (signs[k], [])
        else:
            del signs[k]
    how = rnd.random()
    if how < 0.3:
        authors = []
    elif how < 0.5:
        authors = [tuple(sorted([a[0][:1], *a[1:]])) for a in authors]
    return " ".join("".join(signs).split()), volume, authors


def probes(right: DataFrame, most: int) -> tuple[DataFrame, dict[int, str]]:
    """Garbled forms of a bounded sample of ``right``, numbered -1, -2, ..., and the title each was made from."""
    rows, origin = [], {}
    for r in bounded_sample(right.select("form", "core", "volume", "authors"), most, "form").collect():
        rnd = random.Random(r["form"])
        for _ in range(2):
            core, volume, authors = garbled(r["core"], r["volume"], [tuple(a) for a in r["authors"]], rnd)
            if core:
                origin[-len(rows) - 1] = r["core"]
                rows.append((-len(rows) - 1, core, volume, [list(a) for a in authors], list(terms(core, authors).items()), skipped_pairs(core)))
    return right.sparkSession.createDataFrame(rows, _FORM), origin


def _features(works: pd.DataFrame) -> pd.DataFrame:
    """``gap`` and ``share`` of works ``(l, core, score, self)``: the gap is that to the best other work of the record."""
    w = works.sort_values(["l", "score"], ascending=[True, False], kind="stable")
    first, second = w.groupby("l")["score"].transform("max"), w.groupby("l")["score"].transform(lambda x: x.iloc[1] if len(x) > 1 else 0.0)
    rival = np.where(w.groupby("l").cumcount() == 0, second, first)
    return w.assign(gap=(w["score"] - rival) / w["score"].clip(lower=1e-9), share=np.minimum(w["score"] / w["self"].clip(lower=1e-9), 1.0))


def fit_curve(works: pd.DataFrame, origin: dict[int, str]) -> np.ndarray:
    """Weights of gap and share (last: intercept), from the works the probes met, with and without their own."""
    if not len(works):
        return np.array([4.0, 4.0, -3.0])
    own = works["core"] == works["l"].map(origin)
    seen = _features(works).assign(y=lambda x: (x["core"] == x["l"].map(origin)).astype(float))
    apart = _features(works[~own]).assign(y=0.0)
    both = pd.concat([seen, apart])
    return _fit_logistic(both[["gap", "share"]].to_numpy(), both["y"].to_numpy())


def _fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights (last: intercept) of a ridge-penalised logistic regression, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 1e-2 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-8:
            break
    return w


def link(left: DataFrame, left_cols: tuple[str, str, str], right: DataFrame, right_cols: tuple[str, str, str], *, least: float = 0.2, mutual: float = 0.4) -> DataFrame:
    """``(left id, right id, score, confidence)`` of the matching records.

    A pair needs a confidence of ``least`` or more (the exact check decides among
    the doubtful ones); its work must be the nearest
    of the record, and the record's share at least ``mutual`` times the best share any
    record reaches with this work (several records may describe one work).
    A left record can match several right ones only where these are the same
    work (copies), or where it names no author and works share a title.  Null
    or empty titles match nothing; a missing author
    neither speaks for nor against a pair.
    """
    l_ids, l_forms = forms(left, *left_cols)
    r_ids, r_forms = forms(right, *right_cols)
    asked, origin = probes(r_forms, PROBES)
    found = cut(candidates(l_forms.unionByName(asked), r_forms), "found")
    works = found.groupBy("l", "core").agg(F.max("score").alias("score"), F.first("self").alias("self"))
    w = fit_curve(works.where(F.col("l").between(-len(origin), -1)).toPandas(), origin)
    # the gap to the best other work of the record, and how near the record is among those of the work
    per_l, per_r = Window.partitionBy("l").orderBy(F.desc("score"), "core"), Window.partitionBy("core")
    ranked = works.where(~F.col("l").between(-len(origin), -1)).withColumn("n", F.row_number().over(per_l)).where("n <= 2").withColumn("second", F.lead("score").over(per_l))
    near = ranked.withColumn("first", F.max("score").over(Window.partitionBy("l"))).where(F.col("score") >= F.col("first"))
    rival = F.when(F.col("n") == 1, F.coalesce("second", F.lit(0.0))).otherwise(F.col("first"))
    near = near.withColumn("gap", (F.col("score") - rival) / F.col("score")).withColumn("share", F.least(F.col("score") / F.col("self"), F.lit(1.0)))
    confidence = 1 / (1 + F.exp(-(F.col("gap") * float(w[0]) + F.col("share") * float(w[1]) + float(w[2]))))
    near = near.withColumn("confidence", confidence).withColumn("best", F.max("share").over(per_r))
    near = near.where((F.col("confidence") >= least) & (F.col("share") >= mutual * F.col("best"))).select("l", "core", "confidence")
    a = l_forms.select(F.col("form").alias("l"), F.col("core").alias("lc"), F.col("volume").alias("lv"), F.col("authors").alias("la"))
    b = r_forms.select(F.col("form").alias("r"), F.col("volume").alias("rv"), F.col("authors").alias("ra"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            t = np.array([title_likeness(p, q) for p, q in zip(x["lc"], x["core"])])
            w = np.array([author_likeness([tuple(n) for n in p], [tuple(n) for n in q]) for p, q in zip(x["la"], x["ra"])])
            # a title without its subtitle is enough only together with the author
            same = (t > 0.7) & (w > 0) & (x["lv"] == x["rv"]).to_numpy() & ((t != 0.8) | (w > 0.5)) if len(x) else np.zeros(0, bool)
            yield x.loc[same, ["l", "r", "score", "confidence"]].assign(author=w[same])

    pairs = found.join(near.hint("merge"), ["l", "core"]).join(a.hint("merge"), "l").join(b.hint("merge"), "r")
    kept = pairs.select("l", "r", "score", "confidence", "lc", "core", "lv", "rv", "la", "ra").mapInPandas(check, "l long, r long, score double, confidence double, author double").drop("author")
    return kept.join(l_ids.withColumnRenamed("id", left_cols[0]).hint("merge"), kept["l"] == l_ids["form"]).drop("form").join(r_ids.withColumnRenamed("id", right_cols[0]).hint("merge"), kept["r"] == r_ids["form"]).select(left_cols[0], right_cols[0], "score", "confidence").groupBy(left_cols[0], right_cols[0]).agg(F.max("score").alias("score"), F.max("confidence").alias("confidence"))
