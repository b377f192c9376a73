"""Problem 7: text that was decoded with the wrong character encoding.

Method: characters are mapped back to the bytes of the legacy encoding they
were read with; a byte-structure automaton finds the maximal well-formed
multibyte spans, and only those spans are decoded.  Spans must also be
plausible (their characters belong to written language and fit better than
what stands there), because clean text can be well-formed by accident.

Three families of routes:

* bytes of UTF-8 read as a single-byte set (once or several times over);
* bytes of UTF-8, GB18030, Big5 or Shift-JIS read as another multibyte set or
  as Western text;
* single-byte Thai read as Western text: the order of signs in a syllable is
  the structure the spans are tested by;
* single-byte Cyrillic or Western text read as another single-byte set.  Such
  bytes have no multibyte structure, so segments are judged by letter
  frequency and by the place of capitals.

Characters that only a failed decoding leaves behind (U+FFFD, C1 controls,
private use, code points never assigned) are reported although nothing can be
regained from them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Single-byte sets through which UTF-8 is commonly misread, likeliest first.
THROUGH = ("cp1252", "cp437", "mac_roman", "cp1251", "cp874", "cp850", "koi8_r", "cp866", "cp1250", "iso8859_9")
#: Russian letters from frequent to rare.
RUSSIAN = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"
#: Signs that may follow a capital letter in clean text.
ORDINARY = set("”“»«…–—’‘„‚›‹\xa0")

_NEVER = re.compile("[�\x80-\x84\x86-\x9f-\U000f0000-\U0010ffff]")
_NON_ASCII = re.compile(r"[^\x00-\x7f]")
_UTF8 = rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
_UTF8_RUN = re.compile(b"(?:[\x00-\x7f]|" + _UTF8 + b")+")
_UTF8_ROW = re.compile(b"(?:[\xe0-\xef][\x80-\xbf]{2}){2}|(?:[\xc2-\xdf][\x80-\xbf]){5}|\xf0[\x90-\xbf][\x80-\xbf]{2}")
_LATIN = re.compile("[A-Za-z]")
_UTF8_ONE = re.compile(b"[\x00-\x7f]|" + _UTF8)
_KANA = re.compile("[ぁ-ヿ]")
_BOXES = re.compile("[─-╿▀-▟]")
_HAN = re.compile("[㐀-鿿豈-﫿-]")


def _byte_of(codec: str) -> dict[str, int]:
    """Character to byte of a single-byte set; bytes it leaves undefined stand for themselves."""
    out = {}
    for b in range(0x80, 0x100):
        if codec == "cp1252":
            out[chr(b)] = b  # Latin-1 as well
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


@lru_cache(1)
def _single() -> list[tuple[str, dict[str, int], re.Pattern]]:
    """The automaton for UTF-8 spans of each single-byte set, over the set's own characters."""
    out = []
    for codec in THROUGH:
        back = _byte_of(codec)
        cls = lambda a, z, back=back: "[" + "".join(re.escape(c) for c, b in back.items() if a <= b <= z) + "]"
        tail = cls(0x80, 0xBF)
        out.append((codec, back, re.compile(f"(?:{cls(0xC2, 0xDF)}{tail}|{cls(0xE0, 0xEF)}{tail}{{2}}|{cls(0xF0, 0xF4)}{tail}{{3}})+")))
    return out


@lru_cache(1)
def _possible() -> re.Pattern:
    """A lead and a tail of some set, box-drawing sets aside: without such a pair there is no span to look for."""
    pairs = []
    for codec, back, _ in _single():
        if codec not in ("cp866", "koi8_r"):
            lead, tail = ("".join(re.escape(c) for c, b in back.items() if a <= b <= z) for a, z in ((0xC2, 0xF4), (0x80, 0xBF)))
            pairs.append(f"[{lead}][{tail}]")
    return re.compile("|".join(pairs))


@lru_cache(65536)
def _usual(ch: str) -> int:
    """2: in everyday use in some language; 1: written language; 0: neither."""
    o = ord(ch)
    if o < 0x80:
        return 2
    if o < 0x100 or 0x2010 <= o <= 0x203A or o in (0x20AC, 0x2122, 0x2116, 0x2190, 0x2192):
        return 2 if o >= 0xA0 else 0
    if o < 0x180 or 0x410 <= o <= 0x451 or 0x0E01 <= o <= 0x0E5B or 0x0900 <= o <= 0x097F or 0x3041 <= o <= 0x30FF or 0x3000 <= o <= 0x3011:
        return 2 if unicodedata.category(ch) != "Cn" else 0
    if 0xFF01 <= o <= 0xFF5E:
        return 2
    if 0x4E00 <= o <= 0x9FFF:
        try:
            return 2 if 0xB0 <= ch.encode("gb2312")[0] <= 0xD7 else 1
        except UnicodeEncodeError:
            try:
                return 2 if 0xA4 <= ch.encode("big5")[0] <= 0xC6 else 1
            except UnicodeEncodeError:
                return 1 if o < 0x9FA6 else 0
    if 0x370 <= o < 0x400 or 0x400 <= o < 0x460 or 0x180 <= o < 0x250 or 0x300 <= o < 0x370 or 0xAC00 <= o < 0xD7A4 or 0x5D0 <= o < 0x5EB or 0x620 <= o < 0x653 or 0x1E00 <= o < 0x1F00 or 0x2190 <= o < 0x2300:
        return 1 if unicodedata.category(ch) != "Cn" else 0
    return 0


def _plain(s: str) -> float:
    """Share of everyday characters among those beyond ASCII."""
    wide = [c for c in s if c > "\x7f"]
    return sum(_usual(c) == 2 for c in wide) / len(wide) if wide else 1.0


def _single_spans(text: str, used: set[str]) -> list[tuple[int, int, str]]:
    """Spans of UTF-8 read through a single-byte set. ``used``: sets through which other parts of the text were misread."""
    best: list[tuple[int, int, str]] = []
    by = ""
    boxed = bool(_BOXES.search(text))
    if not boxed and not _possible().search(text):
        return best
    for codec, back, auto in _single():
        if codec in ("cp866", "koi8_r") and not boxed:
            continue
        found, strong, sure = [], False, codec in used
        for m in auto.finditer(text):
            raw = m.group()
            try:
                made = bytes(back[c] for c in raw).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if codec in ("cp866", "koi8_r") and not _BOXES.search(raw):
                continue
            use = [_usual(c) for c in made]
            if 0 in use or any(c < "\xa0" and c > "\x7f" for c in made) and len(made) < 2:
                if not (codec == "cp1252" and min(map(ord, made)) >= 0x80 and _again(made)):
                    continue
            if codec in ("cp874", "koi8_r", "cp866", "cp1250", "iso8859_9", "cp850") and len(made) < (3 if codec == "cp874" else 2) and not (sure and codec != "cp874" or _NEVER.search(raw)):
                if codec not in ("cp1250", "iso8859_9", "cp850") or raw[0].isalpha() and raw[1:2].isalpha():
                    continue
            if codec == "cp1251" and len(made) == 1 and made.isalpha() and not ("Ѐ" <= made <= "ӿ"):
                # a Cyrillic pair that happens to spell one Western letter
                if not sure or re.search("[Ѐ-ӿ]", text[max(0, m.start() - 2) : m.start()] + text[m.end() : m.end() + 2]):
                    continue
            odd = (any(c not in ORDINARY for c in raw[1:]) or raw == "Ã\xa0" and not text[max(0, m.start() - 1) : m.start()].isalpha()) and not (len(made) == 1 and codec == "mac_roman" and raw[0] == "√" and made not in "áéíóúàèìòùâêîôûäëïöüãõñçßÁÉÍÓÚÀÈÂÊÔÄÖÜÃÕÑÇœæ")
            found.append((m.start(), m.end(), made, odd))
            strong |= odd
        if strong or sure:
            kept = [x[:3] for x in found if x[3] or strong or sure]
            if sum(e - s for s, e, _ in kept) > sum(e - s for s, e, _ in best):
                best, by = kept, codec
    if best:
        used.add(by)
    return best


def _again(made: str) -> bool:
    """Whether a decoded span is itself garbled text."""
    return bool(_single()[0][2].search(made))


def _multi_spans(text: str, codec: str) -> list[tuple[int, int, str]]:
    """Spans of UTF-8 that were read as a multibyte set."""
    out = []
    # among ideographs only a row of well-formed sequences can mean anything
    strict = codec == "gb18030" and len(_LATIN.findall(text)) < 3 * len(_HAN.findall(text))
    for m in re.finditer(r"[^\x00-\x7f]+", text):
        run = m.group()
        if not _HAN.search(run) and codec != "cp932":
            continue
        if strict and not _UTF8_ROW.search(run.encode(codec, "replace")):
            continue
        at, raw = [0], bytearray()
        for ch in run:
            try:
                raw += ch.encode(codec)
            except UnicodeEncodeError:
                raw += b"\xff"
            at.append(len(raw))
        place = {b: k for k, b in enumerate(at)}
        for span in _UTF8_RUN.finditer(bytes(raw)):
            edges = [span.start(), *(span.start() + x.end() for x in _UTF8_ONE.finditer(span.group()))]
            edges = [e for e in edges if e in place]
            if len(edges) < 2:
                continue
            a, b = edges[0], edges[-1]
            made, src = bytes(raw[a:b]).decode("utf-8"), run[place[a] : place[b]]
            begin, end = m.start() + place[a], m.start() + place[b]
            wide = [c for c in made if c > "\x7f"]
            if not wide or min(_usual(c) for c in wide) == 0:
                continue
            if all("\xa0" <= c < "ʰ" or "‐" <= c <= "›" for c in wide):
                near = text[max(0, begin - 1) : begin] + text[end : end + 1]
                if _HAN.search(near) or _KANA.search(near):
                    continue  # part of a longer word of ideographs or kana
                outside = text[max(0, begin - 60) : begin] + text[end : end + 60]
                if not sum(c.isascii() and c.isalpha() for c in outside) > 3 * len(_HAN.findall(outside)) + 3 * (not re.search("[A-Za-z]", near)):
                    continue
            elif len(wide) < 2 or _plain(made) <= _plain(src) and not (len(wide) > 3 and _plain(made) == 1.0 and codec == "cp932"):
                continue
            out.append((begin, end, made))
    return out


_GB_PAIRS = re.compile(r"(?:[\xa1-\xf7][\xa1-\xfe]){2,}|(?:[\xa1\xa3][\xa1-\xfe])+(?![\xa1-\xfe])|(?:[\x81-\xfe][\x40-\x7e\x80-\xfe]){4,}")
_SJIS_PAIRS = re.compile(r"(?:[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]|[\xa6-\xdf]){3,}")


#: Bytes of Thai, the order of signs in its syllables, its rare letters and its marks: together as strict as a multibyte structure.
_THAI_BYTES = re.compile("[\xa1-\xda\xdf-\xfb]{8,}")
_THAI_RARE, _THAI_MARKS = re.compile("[ฃฅฆฌฎฏฐฑฒฤฦฬฮฯๅ๎๐-๙]"), re.compile("[ัิ-ฺ็-๎]")
_THAI_SYLLABLE = re.compile("[เ-ไ]?[ก-ฮ][ัิ-ฺ็]?[่-๎]?[ะาำๅฯๆ]?|[๐-๙]")
_WEST = re.compile("[\x80-\xff€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{3}|[‚ƒŠŽ„†‡\x80-\x9f][^\\s]|[¡£][\xa1-\xfe]")


@lru_cache(1)
def _western() -> tuple[dict[int, int], dict[int, int]]:
    latin = {ord(c): b for c, b in _byte_of("cp1252").items()}
    return latin, {b: b for b in range(0x80)}


def _western_spans(text: str) -> list[tuple[int, int, str]]:
    """East Asian or Cyrillic bytes that were read as Western text."""
    if not _WEST.search(text):
        return []
    raw = text.translate(_western()[0])
    out: list[tuple[int, int, str]] = []
    for m in _THAI_BYTES.finditer(raw):
        made = m.group().encode("latin-1").decode("cp874", "replace")
        if sum(len(x.group()) for x in _THAI_SYLLABLE.finditer(made)) >= 0.97 * len(made) and len(_THAI_RARE.findall(made)) <= 0.08 * len(made) and len(_THAI_MARKS.findall(made)) >= 0.1 * len(made):
            out.append((m.start(), m.end(), made))
    if 2 * sum(b - a for a, b, _ in out) > sum("\xa1" <= c <= "\xff" for c in raw):
        return out
    out = []
    for m in _GB_PAIRS.finditer(raw):
        made = m.group().encode("latin-1").decode("gbk", "replace")
        if "�" not in made and sum(_usual(c) == 2 and c > " " for c in made) >= 0.75 * len(made) and (len(made) > 1 or not re.search("[A-Za-z]", text[max(0, m.start() - 2) : m.start()] + text[m.end() : m.end() + 2])) and (len(made) > 2 or _HAN.search(text) or out):
            out.append((m.start(), m.end(), made))
    if out:
        return out
    for m in _SJIS_PAIRS.finditer(raw):
        span = m.group()
        made = span.encode("latin-1").decode("cp932", "replace")
        kana = len(re.findall("[ぁ-ゖァ-ヺ、。「」]", made))
        if "�" not in made[:-1] and kana >= 2 and kana + len(_HAN.findall(made)) >= 0.8 * len(made):
            out.append((m.start(), m.end(), made))
    if out:
        return out
    for m in re.finditer("[À-ÿ¸¨]{3,}(?:[ ,.\\-\xa0]*[À-ÿ¸¨]+)*", text):
        made = m.group().encode("cp1252", "replace").decode("cp1251", "replace")
        if len(re.findall("[а-яё]", made)) >= 3 and _russian(made) > 0.0:
            out.append((m.start(), m.end(), made))
    return out


_FREQ = {c: 1.0 - 1.7 * k / len(RUSSIAN) for k, c in enumerate(RUSSIAN)}
_CYRILLIC = re.compile("[Ѐ-ӿ─-╿▀-▟■∙°√≈≤≥÷№¤]")


def _russian(s: str) -> float:
    """Mean fit of the letters of ``s`` to Russian: frequent letters, capitals at word starts only."""
    total = n = 0
    before = " "
    for c in s:
        low = c.lower()
        if low in _FREQ:
            n += 1
            total += _FREQ[low] - (0 if c == low else 0.15 if not before.isalpha() else 1.0)
        elif c > "\x7f" and c not in ORDINARY:
            n += 1
            total -= 1.5
        before = c
    return total / n if n else 0.0


_SUSPECT = re.compile("[а-яё][А-ЯЁ]|[А-ЯЁ]{3}|[─-╿▀-▟∙ЂЃЄЅІЇЈЉЊЋЌЎЏђѓєѕіїјљњћќўџҐґ]")
_SEGMENT = re.compile(r"[^\n.!?]+[.!?]*")
#: Fixed values: (read as, written in) of single-byte Cyrillic.
CYRILLIC_ROUTES = (("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("koi8_r", "cp866"), ("cp866", "koi8_r"), ("mac_cyrillic", "cp1251"), ("iso8859_5", "cp1251"))


def _cyrillic_spans(text: str) -> list[tuple[int, int, str]]:
    """Segments of single-byte Cyrillic read as another Cyrillic set, and Western letters read as Cyrillic."""
    out: list[tuple[int, int, str]] = []
    if _SUSPECT.search(text):
        for m in _SEGMENT.finditer(text):
            seg = m.group()
            if len(_CYRILLIC.findall(seg)) < 4 or not _SUSPECT.search(seg):
                continue
            now, best = _russian(seg), None
            for wrong, true in CYRILLIC_ROUTES:
                try:
                    made = seg.encode(wrong).decode(true)
                except UnicodeError:
                    continue
                s = _russian(made)
                if s > now + 0.45 and s > 0.05 and (best is None or s > best[0]):
                    best = (s, made)
            if best:
                out.append((m.start(), m.end(), best[1]))
    if out:
        return out
    if re.search("[A-Za-z][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-z]|[«—\"][ЎЇї][A-Za-z]", text):
        for line in re.finditer(r"[^\n]+", text):
            s = line.group()
            if len(re.findall("[A-Za-z]", s)) <= 2 * len(re.findall("[Ѐ-ӿ]", s)) or not re.search("[A-Za-z][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-z]", s):
                continue
            for m in re.finditer("[Ѐ-ӿ]+", s):
                try:
                    made = m.group().encode("cp1251").decode("cp1252")
                except UnicodeError:
                    continue
                if all(c.isalpha() or c in "¡¿ºª" for c in made) and len(made) <= 3:
                    out.append((line.start() + m.start(), line.start() + m.end(), made))
    return out


def _big5_spans(text: str) -> list[tuple[int, int, str]]:
    """Big5 read as GBK: private-use characters stand where its signs were."""
    out = []
    for m in re.finditer("[^\x00-\x7f]{2,}", text):
        run = m.group()
        if not re.search("[-]", run):
            continue
        try:
            made = run.encode("gb18030").decode("big5")
        except UnicodeError:
            continue
        if _plain(made) >= 0.6 and _plain(made) > _plain(run):
            out.append((m.start(), m.end(), made))
    return out


_LOST_SPACE = re.compile(r"(?<![^\s(«“\"'])Ã (?=[^\W\d])|(?<![^\s(«“\"'])Â(?= )")


def restore(text: str) -> tuple[str, int, bool]:
    """``(text with every regainable span restored, number of spans, whether anything is lost for good)``."""
    if not _NON_ASCII.search(text):
        return text, 0, False
    spans, used = 0, set()
    seen = {text}
    while True:  # text can be garbled any number of times over
        found = _single_spans(text, used)
        if found and sum(b - a for a, b, _ in found) < 0.7 * len(_NON_ASCII.findall(text)):
            other = _western_spans(text)
            if sum(b - a for a, b, _ in other) > sum(b - a for a, b, _ in found):
                found = other
        if not found and _HAN.search(text):
            found = _big5_spans(text) or _multi_spans(text, "gb18030") or (_multi_spans(text, "big5") if spans or _NEVER.search(text) else [])
        if not found and re.search("[｡-ﾟ繧縺]", text):
            found = _multi_spans(text, "cp932")
        if not found:
            found = _western_spans(text) or _cyrillic_spans(text)
        if not found:
            break
        spans += len(found)
        parts, at = [], 0
        for a, b, made in found:
            parts += [text[at:a], made]
            at = b
        text = "".join([*parts, text[at:]])
        if text in seen:
            break
        seen.add(text)
    lost = len(_LOST_SPACE.findall(text))
    if lost:
        text, spans = _LOST_SPACE.sub(lambda m: "à " if m.group()[0] == "Ã" else "", text), spans + lost
    return text, spans, bool(_NEVER.search(text))


def damaged(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``keys, field, restored, spans, lost`` of each affected value.

    One row per field whose value holds wrongly decoded characters; ``lost``
    tells that some can't be regained.  Null and clean values give no row.
    ASCII values never reach Python.
    """
    types = dict(df.dtypes)
    long = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("_f")).select(*keys, "_f.field", "_f.value").where("value RLIKE '[^\\\\x00-\\\\x7f]'")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [restore(v) for v in b["value"]]
            b = b.assign(restored=[g[0] for g in got], spans=[g[1] for g in got], lost=[g[2] for g in got])
            yield b.loc[(b["spans"] > 0) | b["lost"], [*keys, "field", "restored", "spans", "lost"]]

    return long.mapInPandas(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "field string, restored string, spans int, lost boolean"]))
