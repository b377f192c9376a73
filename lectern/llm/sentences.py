"""Problem 5: sentence boundaries across languages and scripts.

Method: the standard character properties for sentence breaks (terminators of
all scripts, closers, continuers, case) with abbreviation suppression by
language and handling of closing quotes.  The language of a paragraph is told by
its script and, in Latin script, by its function words; one too short to tell
takes the language of the whole text, and a text without any function word may
hold the abbreviations of every Latin language.  On top of the standard rules:

* a blank line ends a sentence, a single line break does not; a heading line
  (``#`` to ``######``) is one unit;
* a quotation and its attribution are one sentence, in caseless scripts by
  the verb of saying that closes the next clause;
* a bracket opened inside a sentence doesn't end it, nor do dots before a
  continuation;
* Thai has no terminators: a space ends a sentence unless it touches a digit
  or a Latin letter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Abbreviations before a name, by language.
BEFORE_NAME = {
    "en": "Mr Mrs Ms Dr Prof St Rev Hon Gen Col Capt Lt Sgt Fr Messrs Mt",
    "fr": "M MM Mme Mmes Mlle Dr Me Mgr Pr St Ste",
    "de": "Hr Hrn Fr Dr Prof St Ing Dipl",
    "es": "Sr Sra Srta Sres Dr Dra D Dña Ud Uds Prof Sto Sta",
    "pt": "Sr Sra Srta Dr Dra D Prof Profa Sto Sta",
    "ru": "г-н г-жа проф акад им ул св д-р",
    "hi": "डॉ श्री प्रो पं कु सुश्री",
}
#: Abbreviations before a number, by language.
BEFORE_NUMBER = {
    "en": "No Nos p pp vol vols ch chs sect sec fig figs art para pt ed eq n v",
    "fr": "p pp vol chap art fig no n sect par t éd",
    "de": "S Nr Nrn Bd Bde Abs Abb Art Kap Tab Z Hs Jh",
    "es": "p pp pág págs núm núms vol cap art fig ed",
    "pt": "p pp pág págs núm n vol cap art fig ed",
    "ru": "с стр гл т п рис табл вып №",
    "hi": "पृ सं खं अ",
}
#: Abbreviations that never end a sentence, by language.
INSIDE = {
    "en": "e.g i.e cf viz vs ca approx",
    "fr": "cf c.-à-d env p.ex",
    "de": "z.B d.h u.a vgl bzw ca evtl ggf s.o s.u z.T i.d.R",
    "es": "p.ej cf aprox",
    "pt": "p.ex cf aprox",
    "ru": "т.е напр ср см",
    "hi": "",
}
#: Months after the ordinal of a day.
MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember"
#: Verbs of saying that close an attribution in scripts without capitals.
SAYING = "说 道 問 问 喊 叫 答 想 低声说 喊道 问道 说道 叫道 答道 回答 चिल्लाया चिल्लाई पूछा कहा बोला बोली बोले"

#: Function words that tell a language of Latin script; after an abbreviation such a word, capitalised, begins a sentence.
FUNCTION_WORDS = {
    "en": "the and of to in was with that his her he she it they then but at on for from when after is are were this",
    "fr": "le la les et des une est dans que qui sur avec du elle il au pas pour puis mais un ce",
    "de": "der die das und ein eine nicht mit den dem ist er sie es im zu auf von dann aber als",
    "es": "el la los las y una que del con en por un se al su pero entonces lo",
    "pt": "o a os as e uma que do da com em não um ao na no mas depois se",
}
#: Titles that texts of other scripts write in Latin letters.
BORROWED = "Mr Mrs Ms Dr Prof St"


def _lists(*langs: str) -> tuple[frozenset[str], frozenset[str], frozenset[str], frozenset[str]]:
    """Abbreviations before a name, before a number and inside a sentence, and the words that begin one."""
    own = [frozenset(w for x in langs for w in table.get(x, "").split()) for table in (BEFORE_NAME, BEFORE_NUMBER, INSIDE)]
    opening = frozenset(w for x in langs for w in FUNCTION_WORDS.get(x, "").split() if len(w) > 1 and w not in ("no", "la", "le", "el", "da", "do", "du", "des", "del", "von", "zu", "al"))
    return own[0] | frozenset(BORROWED.split() if not set(langs) & set(FUNCTION_WORDS) else ()), own[1], own[2], opening


_OF = {lang: _lists(lang) for lang in ("en", "fr", "de", "es", "pt", "ru", "hi", "zh", "ja", "th")} | {"latin": _lists(*FUNCTION_WORDS)}
_VOTES: dict[str, list[str]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words.split():
        _VOTES.setdefault(_w, []).append(_lang)
_SCRIPTS = (("ru", regex.compile(r"\p{Cyrillic}")), ("hi", regex.compile(r"\p{Devanagari}")), ("ja", regex.compile(r"[\p{Hiragana}\p{Katakana}]")), ("zh", regex.compile(r"\p{Han}")), ("th", regex.compile(r"\p{Thai}")))
_LATIN_WORD = regex.compile(r"\p{Latin}+")


def language(text: str, least: int = 1) -> str | None:
    """Language of a text, or None where fewer than ``least`` votes tell it. A vote of a word shared by languages is shared."""
    words = _LATIN_WORD.findall(text)
    latin = sum(map(len, words))
    for lang, script in _SCRIPTS:
        n = len(script.findall(text))
        if n * (8 if lang == "ja" else 2) > latin and n >= least and (lang != "ja" or n * 8 > len(_SCRIPTS[3][1].findall(text))):
            return lang
    votes: dict[str, float] = {}
    for w in words:
        for lang in _VOTES.get(w.lower(), ()):
            votes[lang] = votes.get(lang, 0) + 1 / len(_VOTES[w.lower()])
    best = sorted(votes.items(), key=lambda x: -x[1])[:2]
    if not best or best[0][1] < least or len(best) > 1 and best[0][1] < 1.3 * best[1][1] and least > 1:
        return None
    return best[0][0]


_MONTH = regex.compile(r"\s+(?:" + "|".join(MONTHS.split()) + r")\b")

_PARAGRAPH = regex.compile(r"\n[^\S\n]*(?:\n\s*)")
_HEADING = regex.compile(r"(?m)^[^\S\n]*#{1,6}[^\S\n]+.*$")
#: Terminators and what may close after them; an opening form closes only where no letter follows.
_END = regex.compile(
    r"(?P<term>[\p{SB=STerm}\p{SB=ATerm}…‥]+)(?P<close>(?:[\p{Pe}\p{Pf}\"'”’」』]|[“‘«](?![\p{L}\p{N}])|[   ]»(?![\p{L}\p{N}¿¡])|[*_]+(?![\p{L}\p{N}]))*)"
)
_WORD = regex.compile(r"[\p{L}\p{M}№][\p{L}\p{M}.\-]*\Z")
_SPACED = regex.compile(r"(?:[\p{L}\p{M}]{1,2}\.[  ]){1,2}[\p{L}\p{M}]{1,3}\Z")
_SAID = regex.compile(r"[\s]*[^\s,，;；:：。！？!?।॥…“”「」『』\"][^,，;；:：。！？!?।॥…“”「」『』\"]{0,60}?(?:" + "|".join(sorted(SAYING.split(), key=len, reverse=True)) + r")[。！？!?।॥]")
_THAI = regex.compile(r"\p{Thai}")
_CASELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Devanagari}]")
_DASH = regex.compile(r"\s*[—–―-]\s*")
_OPEN = {"（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "〈": "〉"}
_BRACKETS = regex.compile(r"[)\]）】》〉]")


def _abbreviated(text: str, start: int, dot: int, after: str, sep: bool, lists: tuple[frozenset[str], ...]) -> bool:
    """Whether the full stop at ``dot`` belongs to an abbreviation that doesn't end the sentence."""
    names, numbers, inner, opening = lists
    head = text[max(start, dot - 24) : dot]
    if m := _SPACED.search(head):
        whole = m.group().replace(" ", "").replace(" ", "")
        if whole in inner:
            return True
    m = _WORD.search(head)
    if not m:
        if regex.search(r"(?:^|[\s\[(])\d{1,2}\Z", head):
            line = text.rfind("\n", 0, dot) + 1
            if regex.fullmatch(r"[\s#>*+\-]*(?:\[\^\w+\]:\s*)?\d{1,3}", text[max(line, start) : dot]):
                return True  # the number of a list item or heading
            return bool(_MONTH.match(text, dot + 1))
        return False
    word = m.group().lstrip(".")
    if word in inner or word in numbers and after.isnumeric():
        return True
    if word in names and (after.isupper() or _CASELESS.match(after)):
        nxt = _LATIN_WORD.search(text, dot)
        return not (nxt and after.isupper() and nxt.group().lower() in opening)
    if len(word) == 1 and after.isalpha():
        rest = text[dot + 1 : dot + 8].lstrip()
        if word.islower() and regex.match(r"\p{L}{1,3}\.", rest):
            return True  # first part of a spaced abbreviation
        return word.isupper() and after.isupper() and sep and word != "I"
    return False


def _breaks(text: str, begin: int, end: int, lists: Callable[[int, int], tuple[frozenset[str], ...]]) -> list[int]:
    """Ends of sentences within one paragraph or heading, its own end not included."""
    out: list[int] = []
    if _THAI.search(text, begin, end) and len(_THAI.findall(text, begin, end)) * 2 > end - begin:
        for m in regex.finditer(r"[^\S\n]+", text, pos=begin, endpos=end):
            a, b = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            if m.start() > begin and m.end() < end and not any(c.isdigit() or "A" <= c.upper() <= "Z" or "À" <= c <= "ɏ" for c in (a, b) if c):
                out.append(m.start())
        return out
    at = begin
    for m in _END.finditer(text, pos=begin, endpos=end):
        stop = m.end()
        if stop >= end:
            break
        term, close, after = m["term"], m["close"], text[stop]
        spaces = regex.match(r"\s*", text[stop:end]).end()
        nxt = text[stop + spaces] if stop + spaces < end else ""
        if not nxt:
            break
        if after in ",;:，；：、" or nxt in ",;，；、":
            continue
        dots = set(term) <= {".", "．"}
        if "…" in term or "‥" in term or dots and len(term) > 1:
            if _CASELESS.match(nxt) or nxt.islower() or nxt.isdigit() or not spaces and nxt.isalpha():
                continue
        elif dots:
            if not close and not spaces and (nxt.isalnum() or nxt in "_/\\@-"):
                continue
            if nxt.islower():
                continue
            if not close and _abbreviated(text, at, m.start(), nxt, bool(spaces), lists(begin, end)):
                continue
        elif nxt.islower() and (spaces or close or not _CASELESS.match(text[m.start() - 1])):
            continue
        if d := _DASH.match(text, stop):  # speech, dash, attribution
            rest = text[d.end() : d.end() + 1]
            if rest.islower():
                continue
        if close and (b := _BRACKETS.findall(close)):
            opener = next(o for o, c in _OPEN.items() if c == b[-1])
            where = text.rfind(opener, at, m.start())
            if where > at and text[at:where].strip():
                continue  # the bracket opened inside the sentence
            if b[-1] in "》〉":
                continue
        if close and not spaces and nxt in "とっ" and close[-1] in "」』”’":
            continue
        if close and close[-1] in "”’」』\"" and _CASELESS.match(nxt) and _SAID.match(text, stop, min(end, stop + 90)):
            continue
        out.append(stop)
        at = stop + spaces
    return out


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """``[begin, end)`` of every sentence, white space excluded."""
    units: list[tuple[int, int]] = []
    at = 0
    for m in _PARAGRAPH.finditer(text):
        units.append((at, m.start()))
        at = m.end()
    units.append((at, len(text)))
    ends: list[tuple[int, int]] = []
    for a, b in units:
        pos = a
        for h in _HEADING.finditer(text, pos=a, endpos=b):
            ends += [(pos, h.start()), (h.start(), -h.end())]
            pos = h.end()
        ends.append((pos, b))
    told: dict[tuple[int, int], tuple[frozenset[str], ...]] = {}

    def lists(a: int, b: int) -> tuple[frozenset[str], ...]:
        if (a, b) not in told:
            if (0, 0) not in told:
                told[0, 0] = _OF[language(text) or "latin"]
            own = language(text[a:b], 3)
            told[a, b] = _OF[own] if own else told[0, 0]
        return told[a, b]

    out: list[tuple[int, int]] = []
    for a, b in ends:
        cuts = [-b] if b < 0 else [*_breaks(text, a, b, lists), b]
        for c in cuts:
            piece = text[a:c]
            lead = len(piece) - len(piece.lstrip())
            body = piece.strip()
            if body:
                out.append((a + lead, a + lead + len(body)))
            a = c
    return out


def sentences(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, sentence_no, begin_off, end_off, sentence``: the sentences of every row.

    Null and blank texts have no sentence; very long texts are taken whole.
    Rows are independent, so nothing is shuffled.
    """
    rows = df.select(*keys, F.col(text).alias("_text")).where("_text IS NOT NULL")
    types = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for *key, t in b[[*keys, "_text"]].itertuples(index=False, name=None):
                out += [(*key, no, i, j, t[i:j]) for no, (i, j) in enumerate(sentence_spans(t))]
            yield pd.DataFrame(out, columns=[*keys, "sentence_no", "begin_off", "end_off", "sentence"])

    return rows.mapInPandas(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "sentence_no int, begin_off int, end_off int, sentence string"]))
