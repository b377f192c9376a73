"""Problem 10: personal information inside free text.

Method: every item becomes a typed placeholder; numbers (and the dates inside
identity numbers) are permuted by a keyed Feistel network within their own
format, so equal values stay linked across documents without being shown.
Different spellings of one value are linked as well: a phone number is permuted
as its national digits, whatever its separators, country code or trunk digit; a
valid check digit is taken off before and computed anew after.  E-mails,
addresses and names, which have no numeric format, carry a keyed tag of their
plain form.  One operator, :func:`protected`, finds the items, validates the
numbers and makes the placeholders; the list of items is one of its results.

Finding: e-mails (plain and disguised), postal addresses, phone numbers and
identity numbers by their formats; personal names by a lexicon learned from a
table of people (given names, family names, surnames of Chinese and Japanese)
and a character model of name-like words fitted on it.  Digits in groups of
three or four, which figures and orders share, count as an identity number only
with a leading zero, a word for such a number before them or, if they aren't
grouped like a figure, a right check digit.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from datetime import date, timedelta
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.runtime import bounded_sample, cut

#: Names and documents on which the character model is fitted, at most.
FIT_PEOPLE, FIT_DOCUMENTS = 20_000, 1_000
#: A word belongs to running text if it stands in one text of so many, at least.
RUNNING_IN = 1_000

# ---------------------------------------------------------------- formats
_WIDE = {0xFF10 + k: 0x30 + k for k in range(10)} | {ord(a): ord(b) for a, b in zip("（）－＋＠．　", "()-+@. ")}
_L, _R = r"(?<![A-Za-z0-9@])(?<![0-9][-./,])(?<!\+)", r"(?![A-Za-z0-9]|[-./,][0-9])"
_EXT = r"(?: ?(?:ext\.?|extension|x|доб\.|poste|App\.|Durchwahl|ramal|转|内线) ?\d{1,6})?"
_PHONE = re.compile(
    rf"{_L}(?:\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{1,5}}(?:[ .-]?\d{{2,8}}){{1,4}}"  # with country code
    r"|\(\d{2,5}\) ?\d{3,8}(?:[ .-]\d{2,5}){0,2}"  # area code in brackets
    r"|\d{3}([-.])\d{3}\1\d{4}"
    r"|0\d{2,4}[ -]\d{3,6}(?:[ -]\d{3,4})?"
    r"|0\d([ .-])\d{2}(?:\2\d{2}){3}"
    r"|\d{3}(?: \d{2}){3}"
    r"|8[ -]?\(?\d{3}\)?[ -]\d{3}[ -]\d{2}[ -]\d{2}"
    r"|0\d{1,3}-\d{2,4}-\d{4}|1\d{2}-\d{4}-\d{4}"
    rf"|1[2-9]\d{{9}}){_EXT}{_R}"
    rf"|{_L}\d{{3}}-\d{{4}} (?:ext\.?|extension|x|доб\.|poste|App\.) ?\d{{1,6}}{_R}"
)
_ID = re.compile(
    rf"{_L}(?:\d{{17}}[\dXx]"  # eighteen places, date of birth inside
    r"|[1-9] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}"
    r"|\d{3}([- ])\d{2}\1\d{4}"
    r"|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"
    r"|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]"
    r"|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{3} \d{3} \d{3}(?! ?\d)"
    r"|\d{3}-\d{3}-\d{3} \d{2}|\d{2} \d{2} \d{6}|\d{4} \d{4} \d{4}"
    rf"|[A-Z]{{1,2}}\d{{7,8}}|[A-Z]\d[A-Z]\d{{6}}){_R}"
)
_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?:@| @ | ?[\(\[{<] ?(?:at|AT) ?[\)\]}>] ?)(?:[A-Za-z0-9-]+(?:\.| ?[\(\[] ?(?:dot|DOT) ?[\)\]] ?))+[A-Za-z]{2,24}(?![A-Za-z0-9-])"
    r"|(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]* (?:at|AT) (?:[A-Za-z0-9-]+ (?:dot|DOT) )+[A-Za-z]{2,24}(?![A-Za-z0-9-])"
)
_TOWN = r"[A-ZÀ-Þ][\w'’-]+"
_CAPS = r"(?: [A-ZÀ-Þ][\w'’-]+){1,3}"
_CODE = r"(?:,? [A-Z]{1,2}\d[\dA-Z]? ?\d[A-Z]{2}|,? [A-Z]{2} \d{5}(?:-\d{4})?|,? \d{5})"
_FLAT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite|#) ?\w+"
_HAN = r"[㐀-鿿]"
_NAME_HAN = r"[^\W\d_A-Za-z是了到在于往给住址的和为叫从去回搬寄到个这那把被将]"
_ADDRESS = re.compile(
    rf"(?<![\w.,])(?:{_FLAT}, )?\d{{1,5}}[a-zA-Z]?{_CAPS} ?(?<= )?(?:Street|Lane|Row|Road|Avenue|Drive|Court|Close|Place|Square|Way|Terrace|Walk|Hill|St\.|Rd\.|Ave\.)(?:, {_FLAT})?, {_TOWN}{_CODE}"
    rf"|\bP\.? ?O\.? Box \d+, {_TOWN}{_CODE}"
    rf"|(?<![\w-])(?:An der |In der |Auf dem |Zum |Zur |Am |Im )?[A-ZÄÖÜ][\wß.-]*(?: [A-ZÄÖÜ][\wß-]+){{0,2}} \d{{1,4}} ?[a-z]?, (?:D-)?\d{{5}} {_TOWN}"
    rf"|(?<![\w.,])\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?:rue|quai|avenue|boulevard|bd|place|chemin|impasse|allée|cours|route|passage|square)\b(?: (?:du|des|de la|de|la|le))?(?: (?:de )?[ld]['’])?(?: ?[A-ZÀ-Þ][\w'’-]+){{1,3}}, \d{{5}} {_TOWN}"
    rf"|\b(?:Calle|C/|Avda\.|Avenida|Plaza|Paseo|Camino|Ronda|Travesía|Carrera)(?: (?:del|de la|de los|de las|de))?{_CAPS},? \d{{1,4}}(?:, \d{{1,2}}\.?[ºª°]\.? ?[A-Z0-9]?)?, \d{{5}} {_TOWN}"
    rf"|\b(?:Rua|Travessa|Avenida|Av\.|Largo|Praça|Alameda|Estrada)(?: (?:do|da|dos|das|de))?{_CAPS},? \d{{1,4}}(?:, \d{{1,2}}\.?[ºª°]\.? ?\w*)?, \d{{4,5}}-\d{{3}} {_TOWN}"
    r"|(?:\b\d{6}, )?(?:\bг\. ?[А-ЯЁ][\w-]+, )?\b(?:ул|пр|просп|пр-т|пер|наб|бул|пл|ш)\. ?[А-ЯЁ][\w-]+(?: [А-ЯЁ][\w-]+)?, д\. ?\d+\w?(?:, (?:к|корп|стр)\. ?\d+)?(?:, кв\. ?\d+)?(?:, (?:г|с|пос|дер)\. ?[А-ЯЁ][\w-]+)?(?:, \d{6}\b)?"
    rf"|(?:{_NAME_HAN}{{2,3}}省)?(?:{_NAME_HAN}{{2,3}}[市县])(?:{_HAN}{{1,3}}[区县])?{_HAN}{{1,4}}?(?:路|街|巷|大道|胡同)(?:\d+弄)?\d+号(?:楼)?(?:\d+(?:单元|栋|幢|座))?(?:\d+室)?"
    rf"|〒? ?\d{{3}}-\d{{4}} ?(?:{_HAN}{{1,3}}[都道府県])?{_HAN}{{1,4}}[市区町村郡][{_HAN[1:-1]}ヶヵ]{{0,8}}?\d+(?:-\d+){{0,2}}(?:号)?"
)
#: What every address holds, by form; all begin with a digit or the postal sign, so that the search runs from one to the next.
_STREET = re.compile(rf"[\d〒](?:(?<=〒)|\d{{4}} [A-ZÀ-Þ]|\d{{3}}-\d{{3}} |\d{{2}}-\d{{4}} ?{_HAN}|[A-Z]{{2}}|\d{{4}}(?<=[\w'’,-] \d{{5}})|(?<=д\. \d)|(?<=д\.\d)|号)")
_DIGITS = re.compile(r"[0-9]+")
_AT = re.compile(r"@|[\(\[{<] ?(?:at|AT) ?[\)\]}>]| (?:at|AT) (?=[A-Za-z0-9-]+ (?:dot|DOT) )")


def _numbers(pattern: re.Pattern, text: str) -> Iterator[re.Match]:
    """Matches of a number pattern, tried only where a run of digits or the sign or letters before it begin."""
    at = 0
    for m in _DIGITS.finditer(text):
        s = m.start()
        if s < at:
            continue
        for k in (s - 3, s - 2, s - 1, s):
            if k >= at and (k == s or text[k] in "+(" and k == s - 1 or "A" <= text[k] <= "Z"):
                hit = pattern.match(text, k)
                if hit and hit.end() > s:
                    yield hit
                    at = hit.end()
                    break


def _emails(text: str) -> Iterator[re.Match]:
    """Matches of the e-mail pattern around each sign or word for at, begun where the local part begins."""
    at = 0
    for m in _AT.finditer(text):
        if m.start() < at:
            continue
        k = m.start() - (m.start() > at and text[m.start() - 1] == " ")
        end = k
        while k > at and text[k - 1] in _LOCAL:
            k -= 1
        while k < end and not text[k].isalnum():
            k += 1
        hit = _EMAIL.match(text, k) if k < end else None
        if hit and hit.end() > m.end():
            yield hit
            at = hit.end()


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


# ---------------------------------------------------------------- names
_CAP = re.compile(r"(?<![\w@.'’-])[A-ZÀ-ÖØ-ÞА-ЯЁ](?:[\w]+(?:['’-][A-ZÀ-ÖØ-ÞА-ЯЁ]?\w+)*)(?![\w@])")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_RUNNING = re.compile(r"(?<![\w'’-])[^\W\d_A-ZÀ-ÞА-ЯЁ]{2,}(?![\w'’-])")
#: German nouns stand after an article or an inflected word.
_NOUN = re.compile(r"(?<![\w'’-])(?:der|die|das|den|dem|des|ein|eine|einen|einem|einer|am|im|zum|zur|[a-zäöü]+(?:en|es|er|te|ge|he|ne|re)) ([A-ZÄÖÜ][a-zäöüß]+)(?![\w'’-])")
#: Forms of address, after which a family name stands.
_TITLED = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Sr|Sra|Dra|M|Mme)\. ([A-ZÀ-Þ](?:[^\W\d_]|['’-])+)")
#: Scripts without capitals whose names are two words: Devanagari (words between spaces) and Thai (words run on).
_PLAIN_NAME = re.compile(r"[\u0900-\u0963]+|[\u0e00-\u0e4e]+")


#: Function words that may follow a name without a space.
_PARTICLES = "或者来是在的和与及把被向对说给从到自又也都就因为借住写寄找"


@dataclass
class Lexicon:
    given: set[str] = field(default_factory=set)
    family: set[str] = field(default_factory=set)
    surname: set[str] = field(default_factory=set)  # of Chinese and Japanese
    pool: set[str] = field(default_factory=set)  # characters of given names
    odds: dict[str, float] = field(default_factory=dict)
    common: frozenset[str] = frozenset()  # words of running text
    usual: frozenset[str] = frozenset()  # ideographs of running text

    def like(self, word: str) -> bool:
        """Whether the character model takes a word for a name."""
        w = f"^{word.lower()}$"
        return len(word) > 3 and sum(self.odds.get(w[k : k + 3], -0.4) for k in range(len(w) - 2)) > 1.5

    def kind(self, word: str) -> int:
        """1 given, 2 family, 4 name-like, 8 no word of running text, as bits."""
        w = word.lower()
        return (w in self.given) | (w in self.family) << 1 | self.like(word) << 2 | (w not in self.common) << 3


def name_parts(name: str) -> list[tuple[str, str, str]]:
    """``(kind, head, tail)``: the halves of a two-part name, or the ways to part a Chinese or Japanese one."""
    parts = _TOKEN.findall(name)
    if len(parts) == 2 and parts[0][0].isupper() and "," not in name:
        return [("two", parts[0].lower(), parts[1].lower())]
    if len(words := name.split()) == 2 and all(map(_PLAIN_NAME.fullmatch, words)):
        return [("two", words[0], words[1])]
    if parts and re.match(_HAN, parts[0]) and 2 <= len(parts[0]) <= 5:
        return [("han", parts[0][:k], parts[0][k:]) for k in (1, 2) if len(parts[0]) > k]
    return []


def text_words(text: str) -> set[str]:
    """Words of running text in one text."""
    return {w for w in _RUNNING.findall(text) if w[0] < "԰"} | {w.lower() for w in _NOUN.findall(text)}


def fit_lexicon(people: list[str], texts: list[str], families: list[str], heads: dict[str, dict[str, set[str]]] | None = None, words: set[str] | None = None, signs: Counter[str] | None = None) -> Lexicon:
    """Lexicon of a list of full names and a list of texts.

    ``heads`` (tails by kind and head), ``words`` and ``signs`` are counted from
    them unless given; both lists then serve the character model only.
    """
    split = [x for name in people for x in name_parts(name)]
    if heads is None:
        heads = {}
        for kind, a, b in split:
            heads.setdefault(kind, {}).setdefault(a, set()).add(b)
    plain = {w for t in texts for w in text_words(t)}
    if words is None:
        words = plain
    if signs is None:
        signs = Counter(c for t in texts for c in re.findall(_HAN, t))
    first, heads, lex = heads.get("two", {}), heads.get("han", {}), Lexicon()
    latin = {w for kind, a, b in split if kind == "two" for w in (a, b)}
    lex.given = {a for a, bs in first.items() if len(bs) >= 3}
    lex.family = {f.lower() for f in families if f.lower() not in lex.given} | {b for a in lex.given for b in first[a] if b not in lex.given}
    two = {h for h, rest in heads.items() if len(h) == 2 and len(rest) >= 3}
    one = {h for h, rest in heads.items() if len(h) == 1 and len(rest) >= 3}
    tails = Counter(x[-1] for h in two for x in heads[h])
    # a two-character head counts unless its second character also serves in given names of the first
    lex.surname = {h for h in two if h[0] not in one or all(len(x) > 1 or x in tails for x in heads[h]) and len([x for x in heads[h[0]] if x[0] == h[1]]) > 0.5 * len(heads[h[0]])}
    lex.surname |= {h for h in two if h[0] in one and len([x for x in heads[h[0]] if x[0] == h[1]]) >= 3 and h[1] not in {x[-1] for k in one - {h[0]} for x in heads[k]}}
    lex.surname |= {h for h in one if any(not any(h + x[:1] == t for t in two & lex.surname) for x in heads[h])}
    lex.pool = {c for h in lex.surname for x in heads.get(h, ()) if len(x) <= 2 for c in x}
    least = max(10, 2e-4 * sum(signs.values()))
    lex.usual = frozenset(c for c, n in signs.items() if n >= least and c not in lex.pool) | frozenset(_PARTICLES)
    lex.common = frozenset(words)
    yes, no = Counter(), Counter()
    for w in latin:
        yes.update(f"^{w}$"[k : k + 3] for k in range(len(w)))
    for w in plain:
        no.update(f"^{w}$"[k : k + 3] for k in range(len(w)))
    ty, tn = sum(yes.values()) + 1, sum(no.values()) + 1
    lex.odds = {g: math.log((yes[g] + 0.5) / ty) - math.log((no[g] + 0.5) / tn) for g in yes | no}
    return lex


def _names(text: str, lex: Lexicon, cache: dict[str, int], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    caps: list[tuple[int, int, int]] = []
    for m in _CAP.finditer(text):
        w = m.group()
        k = cache.get(w)
        if k is None:
            k = cache[w] = lex.kind(w)
        if k:
            caps.append((m.start(), m.end(), k))
    skip = -1
    for (a, b, k1), (c, d, k2) in zip(caps, caps[1:]):
        if a < skip:
            continue
        gap = text[b:c]
        if not gap or len(gap) > 8 or (gap != " " and gap not in (", ", "\xa0") and not re.fullmatch(r",? (?:[A-ZА-ЯЁ]\. ?){1,2}", gap)):
            continue
        comma = gap[0] == ","
        if comma:  # family name, given name
            ok = k2 & 1 and not k1 & 1 and (k1 & 6 or not re.match(r" [A-ZÀ-ÞА-ЯЁ]", text[d : d + 2])) or k1 & 6 and k2 & 4 and not k1 & 1
        else:
            ok = k1 & 1 or k2 & 2 and k1 & 5 or k2 & 1 and k1 & 6 or k1 & 4 and k2 & 4 or k1 & 2 and k2 & 4
        if not ok and not comma:  # one name-like word, and one that is no word of running text
            ok = k1 == 12 and k2 == 8 or k1 == 8 and k2 == 12
            ok = ok and text[a:b].isupper() == text[c:d].isupper()
        elif ok and (k1 == 8 and not k2 & 1 or k2 == 8 and not k1 & 1):
            ok = 0
        if not ok:
            continue
        if not comma and re.search(r"(?:^|[^\w])(?:Mr|Mrs|Ms|Dr|Prof|St|Sr|Sra|Dra|M|Mme)\. $", text[max(0, a - 7) : a]) and not k1 & 1:
            continue
        if any(a < y and x < d for x, y in taken):
            continue
        end = d
        if comma and (m := re.match(r" [A-ZА-ЯЁ]\.(?![\w])", text[d : d + 4])):
            end = d + m.end()
        found.append((a, end))
        skip = d
    found += [(a, b) for a, b in _plain_names(text, lex) if not any(a < y and x < b for x, y in taken)]
    if lex.surname and _EAST.search(text):
        kana = bool(_KANA.search(text))
        at = 0
        while at < len(text) - 1:
            m = lex.surname_re.search(text, at)
            if not m:
                break
            a, b = m.span()
            at = b
            if kana:
                g = re.compile(r"[㐀-鿿]{1,3}").match(text, b)
                if not g or len(m.group()) < 2 or g.group()[0] in "市町村県区郡駅":
                    continue
                e = g.end()
            else:
                e = b
                while e < len(text) and e - b < 2 and (text[e] in lex.pool or _EAST.match(text[e]) and text[e] not in lex.usual):
                    e += 1
                if e == b and text[b + 1 : b + 2] and text[b + 1] in lex.pool and _EAST.match(text[b]):
                    e = b + 2
                if e == b or text[e : e + 1] and text[e] in "市县镇村省河湖岭港路街巷":
                    continue
            if any(a < y and x < e for x, y in taken):
                continue
            found.append((a, e))
            at = e
    return found


def _plain_names(text: str, lex: Lexicon) -> Iterator[tuple[int, int]]:
    """Given and family name side by side in Devanagari or Thai; in Thai other words may run on before and after."""
    words = list(_PLAIN_NAME.finditer(text))
    for m, n in zip(words, words[1:]):
        if text[m.end() : n.start()] not in (" ", "\xa0"):
            continue
        a, b = m.group(), n.group()
        if a[0] < "\u0e00":
            if a in lex.given and b in lex.family:
                yield m.start(), n.end()
            continue
        head = next((k for k in range(len(a)) if a[k:] in lex.given), None)
        tail = next((k for k in range(len(b), 0, -1) if b[:k] in lex.family), None)
        if head is not None and tail:
            yield m.start() + head, n.start() + tail


_EAST, _KANA = re.compile(r"[㐀-鿿]"), re.compile(r"[ぁ-ヺ]")


def find_items(text: str, lex: Lexicon, cache: dict[str, int]) -> list[tuple[str, int, int]]:
    """``(kind, begin, end)`` of every item, in order and without overlap."""
    out: list[tuple[str, int, int]] = []
    taken: list[tuple[int, int]] = []
    plain = text.translate(_WIDE) if _FULL.search(text) else text

    def take(kind: str, spans: Iterator[re.Match]) -> None:
        for m in spans:
            a, b = m.span()
            if not any(a < y and x < b for x, y in taken):
                taken.append((a, b))
                out.append((kind, a, b))

    if "@" in plain or "at" in plain or "AT" in plain:
        take("email", _emails(plain))
    if _STREET.search(plain):
        take("address", _ADDRESS.finditer(plain))
    take("phone", (m for m in _numbers(_PHONE, plain) if m.group()[0] == "+" and sum(c.isdigit() for c in m.group()) <= 18))
    take("id_number", (m for m in _numbers(_ID, plain) if _valid_id(plain, m) and not _called(plain, m)))
    take("phone", (m for m in _numbers(_PHONE, plain) if 7 <= sum(c.isdigit() for c in m.group()) <= 18))
    out += [("name", a, b) for a, b in _names(text, lex, cache, taken)]
    return sorted(out, key=lambda x: x[1])


_FULL = re.compile(r"[０-９＠（－＋]")
_CALLS = re.compile(r"(?i)(?:tel|phone|call|ring|телефон|звоните|teléfono|telefone|appelez|rufen|nummer ist|电话|電話|fon)[^\w]{0,4}\w{0,6}[^\w]{0,3}$")


def _called(text: str, m: re.Match) -> bool:
    """Nine digits in threes are a phone number where a word for calling stands before them."""
    return bool(re.fullmatch(r"\d{3} \d{3} \d{3}", m.group())) and bool(_CALLS.search(text[max(0, m.start() - 16) : m.start()]))


#: Words before an identity, tax or passport number.
_CUES = re.compile(r"(?i)(?:\bid\b|identity|passport|card number|tax|licen[cs]e|social security|ausweis|steuer|formular|reçu|identité|passeport|fiscal|documento|recibo|dni|nif|nie|cpf|паспорт|квитанц|снилс|инн|证件|身份证|护照|税号|身分証|控え|旅券|番号|पहचान|आधार|पासपोर्ट|บัตร|ประจำตัว|หนังสือเดินทาง)[^\n.!?。！？]{0,40}$")


def _valid_id(text: str, m: re.Match) -> bool:
    """Whether a match has what its format asks for: a date inside eighteen places; more than bare groups of digits."""
    flat = re.sub(r"[ .\-]", "", m.group())
    if len(flat) == 18 and flat[:17].isdigit():
        return _day(flat[6:14]) is not None
    if re.fullmatch(r"\d{3} \d{3} \d{3}|\d{4} \d{4} \d{4}|\d{2} \d{2} \d{6}", m.group()):
        return flat[0] == "0" or len(flat) == 12 and checked(flat) is not None or bool(_CUES.search(text[max(0, m.start() - 60) : m.start()]))
    return True


# ---------------------------------------------------------------- pseudonyms
def _round(key: bytes, r: int, n: int, value: int, mod: int) -> int:
    return int.from_bytes(blake2b(f"{r}|{n}|{value}".encode(), key=key, digest_size=16).digest(), "big") % mod


def feistel(key: bytes, digits: str, rounds: int = 10) -> str:
    """A keyed permutation of the digit strings of one length (alternating unbalanced Feistel network)."""
    n = len(digits)
    if n < 2:
        return str((int(digits) + _round(key, 0, n, 0, 10)) % 10) if digits else ""
    u = n // 2
    a, b = digits[:u], digits[u:]
    for r in range(rounds):
        mod = 10 ** len(a)
        c = str((int(a) + _round(key, r, n, int(b), mod)) % mod).zfill(len(a))
        a, b = b, c
    return a + b


def unfeistel(key: bytes, digits: str, rounds: int = 10) -> str:
    """The inverse of :func:`feistel` for two digits or more."""
    n = len(digits)
    u = n // 2 if rounds % 2 == 0 else n - n // 2
    a, b = digits[:u], digits[u:]
    for r in reversed(range(rounds)):
        mod = 10 ** len(b)
        c = str((int(b) - _round(key, r, n, int(a), mod)) % mod).zfill(len(b))
        a, b = c, a
    return a + b


_DAY0, _DAYS = date(1900, 1, 1), 54_000


def _day(ymd: str) -> int | None:
    try:
        n = (date(int(ymd[:4]), int(ymd[4:6]), int(ymd[6:])) - _DAY0).days
    except ValueError:
        return None
    return n if 0 <= n < _DAYS else None


def permute_date(key: bytes, ymd: str) -> str:
    """A valid date ``YYYYMMDD`` permuted among the days from 1900 to 2047 (by cycle walking)."""
    n = _day(ymd)
    if n is None:
        return feistel(key, ymd)
    while True:
        n = int(feistel(key, str(n).zfill(5)))
        if n < _DAYS:
            return (_DAY0 + timedelta(days=n)).strftime("%Y%m%d")


def _weighted(body: str, weights: Iterable[int]) -> int:
    return sum(int(c) * w for c, w in zip(body, weights))


def _check18(body: str) -> str:
    return "10X98765432"[_weighted(body, (pow(2, 17 - k, 11) for k in range(17))) % 11]


def _mod11(body: str, weights: range) -> str:
    r = 11 - _weighted(body, weights) % 11
    return "0" if r > 9 else str(r)


def _luhn(body: str) -> str:
    return str(-sum(sum(divmod(int(c) * (2 - k % 2), 10)) for k, c in enumerate(reversed(body))) % 10)


#: Check signs by form of the number: (pattern of the bare number, places of the check at its end, check of what stands before it).
CHECKS = (
    (re.compile(r"\d{17}[\dX]"), 1, _check18),
    (re.compile(r"\d{15}"), 2, lambda b: f"{97 - int(b) % 97:02d}"),
    (re.compile(r"\d{12}"), 1, lambda b: _mod11(b, [*range(6, 1, -1), *range(7, 1, -1)])),
    (re.compile(r"\d{11}"), 2, lambda b: (a := _mod11(b, range(10, 1, -1))) + _mod11(b + a, range(11, 1, -1))),
    (re.compile(r"\d{11}"), 2, lambda b: f"{_weighted(b, range(9, 0, -1)) % 101 % 100:02d}"),
    (re.compile(r"\d{9}"), 1, _luhn),
    (re.compile(r"\d{9}"), 1, lambda b: _mod11(b, range(9, 1, -1))),
    (re.compile(r"\d{8}[A-Z]|[XYZ]\d{7}[A-Z]"), 1, lambda b: "TRWAGMYFPDXBNJZSQVHLCKE"[int(b.replace("X", "0").replace("Y", "1").replace("Z", "2")) % 23]),
)


def checked(flat: str) -> tuple[int, Callable[[str], str]] | None:
    """``(places, check)`` of the first scheme by which the check signs of a bare number are right."""
    for form, n, check in CHECKS:
        if form.fullmatch(flat) and check(flat[:-n]) == flat[-n:]:
            return n, check
    return None


def _id_pseudonym(key: bytes, flat: str) -> str:
    """A bare identity number, letters in place, digits permuted; a right check stays right."""
    scheme = checked(flat)
    body = flat[: -scheme[0]] if scheme else flat
    if len(flat) == 18 and body[:17].isdigit():
        made = feistel(key, body[:6]) + permute_date(key, body[6:14]) + feistel(key, body[14:17]) + ("" if scheme else feistel(key, body[17:]) if body[17:].isdigit() else body[17:])
    else:
        digits = iter(feistel(key, re.sub(r"\D", "", body)))
        made = "".join(next(digits) if c.isdigit() else c for c in body)
    return made + scheme[1](made) if scheme else made


#: Country codes of two digits; 1 and 7 have one digit, all others three.
_TWO = {"20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", *map(str, range(43, 50)), *map(str, range(51, 59)), *map(str, range(60, 67)), "81", "82", "84", "86", *map(str, range(90, 96)), "98"}
_EXTENSION = re.compile(r"(?i)(?:ext\.?|extension|x|доб\.|poste|App\.|Durchwahl|ramal|转|内线) ?\d{1,6}$")


def phone_parts(flat: str) -> tuple[str, str, str]:
    """``(digits before, national digits, extension)`` of a phone number: country code and trunk digit come before."""
    ext = _EXTENSION.search(flat)
    main = flat[: ext.start()] if ext else flat
    digits, lead = re.sub(r"\D", "", main), ""
    if main.lstrip()[:1] == "+":
        lead = digits[: 1 if digits[0] in "17" else 2 if digits[:2] in _TWO else 3]
        if digits[len(lead) : len(lead) + 1] == "0" and "(0)" in main:
            lead += "0"
    elif digits[:1] == "0" or len(digits) == 11 and digits[0] in "81" and not main.startswith("1"):
        lead = digits[0]
    return lead, digits[len(lead) :], re.sub(r"\D", "", ext.group()) if ext else ""


def pseudonym(key: bytes, value: str, kind: str = "phone") -> str:
    """The value with its digits permuted; separators, letters and length stay."""
    flat = value.translate(_WIDE)
    if kind == "phone":
        lead, national, ext = phone_parts(flat)
        made = lead + feistel(key, national) + (feistel(key, ext) if ext else "")
        signs = iter(made)
        return "".join(next(signs) if c.isdigit() else c for c in flat)
    bare = re.sub(r"[^0-9A-Za-z]", "", flat).upper()
    signs = iter(_id_pseudonym(key, bare))
    return "".join(next(signs) if c.isascii() and c.isalnum() else c for c in flat)


def plain_form(kind: str, value: str) -> str:
    """One form for the spellings of an e-mail, address or name."""
    v = " ".join(value.translate(_WIDE).casefold().split())
    if kind == "email":
        v = re.sub(r" ?[\(\[{<] ?at ?[\)\]}>] ?| at | ?@ ?", "@", v)
        return re.sub(r" ?[\(\[] ?dot ?[\)\]] ?| dot ", ".", v)
    if kind == "name" and not _EAST.search(v):
        return " ".join(sorted(v.replace(",", " ").split()))
    return v


def placeholder(kind: str, value: str, key: bytes) -> str:
    """``[KIND value]``: a pseudonym in format for numbers, a keyed tag of 16 bytes for the rest."""
    tag = pseudonym(key, value, kind) if kind in ("phone", "id_number") else blake2b(f"{kind} {plain_form(kind, value)}".encode(), key=key, digest_size=16).hexdigest()
    return f"[{'ID' if kind == 'id_number' else kind.upper()} {tag}]"


def protect(text: str, lex: Lexicon, cache: dict[str, int], key: bytes) -> tuple[str, list[tuple[str, int, int, str]]]:
    """``(text with placeholders, items with their placeholders)``."""
    items = [(kind, a, b, placeholder(kind, text[a:b], key)) for kind, a, b in find_items(text, lex, cache)]
    parts, at = [], 0
    for _, a, b, made in items:
        parts += [text[at:a], made]
        at = b
    return "".join([*parts, text[at:]]), items


# ---------------------------------------------------------------- Spark
def learn(people: DataFrame, name: str, documents: DataFrame, text: str) -> Lexicon:
    """The name lexicon, counted over all people and all documents.

    Heads with three tails or more, words that stand in one text of
    ``RUNNING_IN``, ideographs, and family names that stand three times or more
    with a form of address are kept.  Only the names and the (whole) texts of the
    character model are a bounded sample.
    """
    names = people.select(F.trim(name).alias("n")).where("length(n) >= 2").distinct()
    sample = [r[0] for r in bounded_sample(names, FIT_PEOPLE, "n").collect()]

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([x for n in b["n"] for x in name_parts(n)], columns=["kind", "head", "tail"])

    heads: dict[str, dict[str, set[str]]] = {}
    for r in names.mapInPandas(part, "kind string, head string, tail string").groupBy("kind", "head").agg(F.collect_set("tail").alias("tails")).where("size(tails) >= 3").collect():
        heads.setdefault(r["kind"], {})[r["head"]] = set(r["tails"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen, signs, titled = Counter(), Counter(), Counter()
            for t in b["t"]:
                seen.update(text_words(t))
                signs.update(_EAST.findall(t))
                titled.update(_TITLED.findall(t))
            rows = [("text", "", len(b)), *((kind, w, n) for kind, c in (("word", seen), ("sign", signs), ("family", titled)) for w, n in c.items())]
            yield pd.DataFrame(rows, columns=["kind", "w", "n"])

    texts = documents.select(F.col(text).alias("t")).where("t IS NOT NULL")
    counts = cut(texts.mapInPandas(count, "kind string, w string, n long").groupBy("kind", "w").agg(F.sum("n").alias("n")), "words")
    whole = sum(r["n"] for r in counts.where("kind = 'text'").collect())
    kept = counts.where((F.col("kind") == "sign") | (F.col("kind") == "word") & (F.col("n") * RUNNING_IN >= F.lit(whole)) | (F.col("kind") == "family") & (F.col("n") >= 3)).collect()
    some = [r[0] for r in bounded_sample(texts, FIT_DOCUMENTS, "t", whole=whole).collect()]
    of = lambda kind: {r["w"]: r["n"] for r in kept if r["kind"] == kind}
    return fit_lexicon(sample, some, sorted(of("family")), heads, set(of("word")), Counter(of("sign")))


def _surname_re(lex: Lexicon) -> re.Pattern:
    return re.compile("|".join(sorted(map(re.escape, lex.surname), key=lambda s: (-len(s), s))) or r"(?!)")


Lexicon.surname_re = property(lambda self: self.__dict__.setdefault("_re", _surname_re(self)))  # type: ignore[attr-defined]


def protected(documents: DataFrame, keys: list[str], text: str, lex: Lexicon, key: bytes) -> DataFrame:
    """``keys, masked_text, items``: every text with typed placeholders, and its items ``(pii_kind, begin_off, end_off, placeholder)`` in order.

    A null text stays null and has no items; nothing is shuffled.
    """
    rows = documents.select(*keys, F.col(text).alias("_text"))
    types = dict(rows.dtypes)
    names = ("pii_kind", "begin_off", "end_off", "placeholder")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, int] = {}
        for b in batches:
            done = [protect(t, lex, cache, key) if isinstance(t, str) else (None, []) for t in b["_text"]]
            if len(cache) > 500_000:
                cache.clear()
            yield b[keys].assign(masked_text=[d[0] for d in done], items=[[dict(zip(names, x)) for x in d[1]] for d in done])

    return rows.mapInPandas(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "masked_text string, items array<struct<pii_kind:string,begin_off:int,end_off:int,placeholder:string>>"]))


def items(documents: DataFrame, keys: list[str], text: str, lex: Lexicon, key: bytes) -> DataFrame:
    """``keys, pii_kind, begin_off, end_off, placeholder``: one row per item of :func:`protected`."""
    return protected(documents, keys, text, lex, key).select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), F.explode("items").alias("_i")).select(*(F.col(f"_k{n}").alias(k) for n, k in enumerate(keys)), "_i.*")


def masked(documents: DataFrame, keys: list[str], text: str, lex: Lexicon, key: bytes) -> DataFrame:
    """``keys, masked_text, items``: every text of :func:`protected`, and how many items it has."""
    return protected(documents, keys, text, lex, key).select(*keys, "masked_text", F.size("items").alias("items"))
