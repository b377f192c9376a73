"""Problem 1: markup residue in text: HTML, Markdown, wiki and LaTeX to clean text.

Method: site template removal.  Each page is parsed into one tree of elements,
whatever notation they are written in: HTML tags as they stand, and the signs
of Markdown, wiki text and LaTeX, which are first translated to tags of the
same tree.  Every element subtree is hashed bottom-up; the hashes are counted
per host in Spark, once for each page; subtrees that recur across many pages
of their host are deleted before the page is rendered.  A page holds markup if
its tree has an element.

Rendering keeps structure: headings become ``## title`` lines, list items
``- item`` or ``1. item`` lines, table rows tab-separated lines; code blocks
keep their lines (indented by four spaces) and formulas their TeX source.
Headings, code and formulas are content and never counted as templates.

Parsing, hashing and rendering are single passes with explicit stacks, so
neither deep nor long pages are a problem.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.index import live
from lectern.runtime import cut

#: Element names taken as markup.
TAGS = set(
    "a abbr address article aside audio b bdi bdo big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark math meta nav noscript object ol optgroup option p picture pre q ref references rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr nowiki gallery poem".split()
)
#: Elements without content.
VOID = {"area", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr"}
#: Elements whose content isn't text.
DROPPED = {"script", "style", "head", "noscript", "template", "svg", "iframe", "object", "select", "ref"}
#: Elements on lines of their own.
BLOCKS = {"p", "div", "section", "article", "aside", "header", "footer", "nav", "main", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "caption", "blockquote", "figure", "figcaption", "form", "body", "html", "center", "address", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "hr"}
#: Elements that can be part of a template: blocks that are no heading, what belongs to a site's frame, and wiki templates.
PARTS = BLOCKS - {"html", "body", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "hr"} | {"head", "style", "script", "nav", "header", "footer", "aside", "x-gone", "x-line", "a"}
#: LaTeX commands without arguments that are markup by themselves.
BARE = "item noindent indent par newline linebreak newpage clearpage pagebreak maketitle tableofcontents centering raggedright bigskip medskip smallskip hfill vfill hline toprule midrule bottomrule ldots dots quad qquad LaTeX TeX appendix bfseries itshape footnotesize small large Large"
#: LaTeX commands whose argument isn't text.
MUTE = {"label", "ref", "cite", "citep", "citet", "pageref", "eqref", "input", "include", "includegraphics", "usepackage", "documentclass", "bibliography", "bibliographystyle", "vspace", "hspace", "index", "url", "pagestyle", "setlength"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!DOCTYPE[^>]*>|<\?xml[^>]*>|<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s[^<>]*?|\s*=[^<>]*)?)\s*/?>", re.S | re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_CODE = re.compile(r"^(`{3,}|~{3,})[^\n`]*\n(.*?)(?:\n?^\1[`~]*[ \t]*$|\Z)|\\begin\{(verbatim\*?|lstlisting|minted)\}(?:\[[^\]]*\])?(?:\{[^}]*\})?\n?(.*?)\n?\\end\{\3\}|<pre\b[^>]*>(.*?)</pre\s*>|<syntaxhighlight\b[^>]*>(.*?)</syntaxhighlight>", re.S | re.M | re.I)
_MATH = re.compile(r"\\begin\{((?:equation|align|gather|multline|displaymath|eqnarray|math)\*?)\}(.*?)\\end\{\1\}|\\\[(.*?)\\\]|\\\((.*?)\\\)|\$\$(.+?)\$\$|(?<![\\$\w])\$(?=\S)((?:[^$\n\\]|\\.)*?(?:[\\^_={}]|(?<=\$)[A-Za-z](?=\$))(?:[^$\n\\]|\\.)*?)(?<=\S)\$(?![\w$])|<math\b[^>]*>(.*?)</math>", re.S)
_HOLD = re.compile("\x02(\\d+)\x03")
#: Names like ``__init__`` are names, not bold words; those of the language's own objects, plus the usual ones of a module.
_DUNDER = {n for t in (object, type, int, float, str, dict, set, list, Exception, staticmethod, type(print), type(lambda: 0), type(x for x in ())) for n in dir(t) if n.startswith("__")} | {"__main__", "__file__", "__all__", "__version__", "__enter__", "__exit__", "__path__", "__author__"}


@dataclass
class Node:
    tag: str
    attrs: str = ""
    plain: bool = False  # white space inside stays as it is
    parent: int = -1
    kids: list = field(default_factory=list)  # texts, and numbers of nodes
    leaf: str = ""  # what a code block, formula or single sign stands for
    seal: int = 0
    size: int = 0  # characters of text inside
    fixed: bool = False  # holds code or a formula


class Page:
    """The text of a page with its markup set aside as numbered tags, then its tree."""

    def __init__(self, text: str) -> None:
        self.tags: list[tuple] = []  # (how, tag, attributes or leaf, plain)
        self.text = self._read(re.sub("[\x02-\x07]", "", text))
        self.nodes = self._tree()

    def tag(self, how: str, tag: str, rest: str = "", plain: bool = True) -> str:
        self.tags.append((how, tag, rest, plain))
        return f"\x02{len(self.tags) - 1}\x03"

    def element(self, tag: str, inner: str, attrs: str = "") -> str:
        return self.tag("open", tag, attrs) + inner + self.tag("close", tag)

    def gone(self, m: re.Match) -> str:
        """An element that has no text of its own (a label, a category, a bare command)."""
        return self.tag("leaf", "x-gone", m.group())

    def _read(self, text: str) -> str:
        def code(m: re.Match) -> str:
            body = next((g for g in (m[2], m[4], m[5], m[6]) if g is not None), "")
            if m[5] is not None:
                body = html.unescape(re.sub(r"</?[A-Za-z][^<>]*>", "", body))
            return f"\n{self.tag('leaf', 'x-code', body.strip(chr(10)))}\n"

        def formula(m: re.Match) -> str:
            body = next((g for g in m.groups()[1:] if g is not None), "").strip()
            if not body:
                return m.group()
            made = self.tag("leaf", "x-formula", " ".join(body.split()))
            return f"\n{made}\n" if m[2] is not None or m[3] is not None or m[5] is not None else made

        def html_tag(m: re.Match) -> str:
            name = (m[2] or "").lower()
            if not m[2]:
                return self.tag("leaf", "x-gone", m.group(), False)
            if name not in TAGS:
                return m.group()
            return self.tag("close" if m[1] else "void" if name in VOID or m.group().endswith("/>") else "open", name, m[3] or "", False)

        text = _MATH.sub(formula, _CODE.sub(code, text))
        if "<" in text:
            text = _TAG.sub(html_tag, text)
        tex = "\\" in text and re.search(r"\\[A-Za-z]+\*?[\[{]", text)
        text = _WIKI_LIST.sub(lambda m: self.tag("void", "x-item"), text)
        for sign, rule, make in _BLOCK_RULES:
            if sign is None or sign in text:
                text = rule.sub(lambda m, make=make: make(self, m), text)
        if tex:
            text = _COMMENT.sub(self.gone, text)
        text = _BULLET.sub(lambda m: _items(self, m), text)
        for sign, rule, make in _INLINE_RULES:
            if sign in text:
                text = rule.sub(lambda m, make=make: make(self, m), text)

        def entity(m: re.Match) -> str:
            made = html.unescape(m.group())
            return made if made == m.group() else self.tag("leaf", "x-sign", made)

        return _ENTITY.sub(entity, text)

    def _tree(self) -> list[Node]:
        nodes = [Node("#page", plain=True)]
        stack = [0]
        at = 0

        def close(k: int) -> None:
            del stack[k:]

        def add(node: Node) -> int:
            node.parent = stack[-1]
            nodes.append(node)
            nodes[stack[-1]].kids.append(len(nodes) - 1)
            return len(nodes) - 1

        for m in _HOLD.finditer(self.text):
            if m.start() > at:
                nodes[stack[-1]].kids.append(self.text[at : m.start()])
            at = m.end()
            how, tag, rest, plain = self.tags[int(m[1])]
            heading = _HEAD.fullmatch(tag)
            if how == "close":
                for k in range(len(stack) - 1, 0, -1):
                    name = nodes[stack[k]].tag
                    if name == tag or heading and _HEAD.fullmatch(name):
                        close(k)
                        break
                else:
                    add(Node("x-gone", leaf=tag))
                continue
            if how == "open" and tag in _IMPLIED:  # whose end tag may be left out
                for k in range(len(stack) - 1, 0, -1):
                    name = nodes[stack[k]].tag
                    if name in _IMPLIED[tag]:
                        close(k)
                        break
                    if name in ("ul", "ol", "table", "dl", "div", "blockquote"):
                        break
            n = add(Node(tag, rest if how != "leaf" else "", plain, leaf=rest if how == "leaf" else ""))
            if how == "open":
                stack.append(n)
        nodes[stack[-1]].kids.append(self.text[at:])
        return nodes

    def seals(self) -> None:
        """Hashes of all subtrees, bottom-up: name, attributes, and the hashes or texts of the children."""
        for node in reversed(self.nodes):
            h = xxhash.xxh64(node.tag)
            h.update(" ".join(sorted(node.attrs.split())).lower() + "\x01" + " ".join(node.leaf.split()))
            node.size, node.fixed = len(node.leaf), node.tag in ("x-code", "x-formula")
            for k in node.kids:
                if isinstance(k, int):
                    kid = self.nodes[k]
                    h.update(kid.seal.to_bytes(8, "little"))
                    node.size += kid.size
                    node.fixed |= kid.fixed
                else:
                    h.update(" ".join(k.split()))
                    node.size += len(k)
                h.update("\x01")
            node.seal = h.intdigest()


_HEAD = re.compile("h[1-6]")
#: Elements that end when one of these begins.
_IMPLIED = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "p": {"p"}}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def subtree_hashes(text: str, least: int = 8) -> list[int]:
    """Distinct hashes of the element subtrees that could be part of a template, after a 0 for the page; a page without markup has none."""
    if not _SIGNS.search(text):
        return []
    page = Page(text)
    if len(page.nodes) == 1:
        return []
    page.seals()
    return [0, *sorted({_signed(n.seal) for n in page.nodes[1:] if n.tag in PARTS and n.size >= least and not n.fixed})]


def _rendered(page: Page, drop: set[int]) -> tuple[str, int]:
    """``(text, subtrees deleted)`` of a tree, in one walk. \\x05 eats the white space before and after it."""
    out: list[str] = []
    removed = 0
    if drop:
        page.seals()
    # (node, next child, tight: white space is single spaces, depth of lists, number of list items)
    stack: list[list] = [[0, 0, False, 0, 0]]
    while stack:
        top = stack[-1]
        node = page.nodes[top[0]]
        if top[1] == len(node.kids):
            out.append(_close(node, page.nodes[node.parent].tag if node.parent >= 0 else "", len(stack) > 1 and stack[-2][2]))
            stack.pop()
            continue
        k = node.kids[top[1]]
        top[1] += 1
        if isinstance(k, str):
            out.append(re.sub(r"\s+", " ", k) if top[2] or not node.plain else k)
            continue
        kid = page.nodes[k]
        if drop and _signed(kid.seal) in drop:
            removed += 1
            out.append("\n\n")
        elif kid.leaf:
            out.append(_leaf(kid))
        elif kid.tag in DROPPED or kid.tag == "x-gone":
            continue
        elif kid.tag == "br":
            out.append(" " if top[2] else "\n")
        elif kid.tag == "img":
            alt = re.search(r"alt\s*=\s*[\"']([^\"']*)", kid.attrs)
            out.append(alt[1] if alt else "")
        elif kid.tag == "x-item":
            out.append("- ")
        else:
            if kid.tag == "li":
                top[4] += 1
            tight = top[2] or kid.tag in ("td", "th") or bool(_HEAD.fullmatch(kid.tag))
            start = int(m[1]) - 1 if kid.tag == "ol" and (m := re.search(r"start\s*=\s*[\"']?(\d+)", kid.attrs)) else 0
            # what stands inside an HTML element has the white space of HTML
            kid.plain = kid.plain and (node.plain or node.tag == "#page")
            out.append(_open(kid, node.tag, top[2], top[3], top[4]))
            stack.append([k, 0, tight, top[3] + (kid.tag in ("ul", "ol")), start])
    return "".join(out), removed


def _leaf(node: Node) -> str:
    if node.tag == "x-code":
        return "\n" + "\n".join("\x04   " + x for x in node.leaf.split("\n")) + "\n"
    return {"x-formula": node.leaf, "x-sign": node.leaf, "x-inline": node.leaf, "x-line": "\x07"}.get(node.tag, "")


def _open(node: Node, parent: str, tight: bool, depth: int, number: int) -> str:
    if tight or node.tag in ("td", "th"):
        return " " if tight and node.tag in BLOCKS else ""
    if node.tag == "li":
        return "\n" + "\x04 " * max(0, depth - 1) + (f"{number}. " if parent == "ol" else "- ") + "\x05"
    if node.tag == "tr":
        return "\n\x05"
    if _HEAD.fullmatch(node.tag):
        return "\n\n## \x05"
    return "\n\n\x05" if node.tag in BLOCKS and node.tag not in ("ul", "ol", "table", "dl") else "\n\n" if node.tag in BLOCKS else ""


def _close(node: Node, parent: str, tight: bool) -> str:
    if tight:
        return " " if node.tag in BLOCKS else ""
    if node.tag in ("td", "th"):
        return "\t"
    if node.tag in ("li", "tr"):
        return "\x06"
    return "\x06\n\n" if node.tag in BLOCKS else ""


#: The sign before a LaTeX command; after a drive letter it begins a path.
_TEX = r"\\(?<!\b[A-Za-z]:\\)(?<!\\\\)"


def _as(tag: str, *groups: int):
    """The first group that matched becomes the inner text of an element."""
    return lambda page, m: page.element(tag, next((m[g] for g in groups if m[g] is not None), ""))


def _heading(page: Page, m: re.Match) -> str:
    return "\n\n" + page.element("h2", next(g for g in m.groups() if g is not None).strip()) + "\n\n"


def _gone(page: Page, m: re.Match) -> str:
    return page.gone(m)


def _gone_line(page: Page, m: re.Match) -> str:
    """Markup on a line of its own: the line goes with it."""
    return page.tag("leaf", "x-line", m.group()) + "\n"


def _environment(page: Page, m: re.Match) -> str:
    tag = {"itemize": "ul", "enumerate": "ol", "description": "ul", "quote": "blockquote", "quotation": "blockquote"}.get(m[2], "section")
    return f"\n{page.tag('open' if m[1] == 'begin' else 'close', tag, '')}\n"


def _file(page: Page, m: re.Match) -> str:
    parts = [p for p in m[1].split("|")[1:] if not re.fullmatch(r"\s*(?:thumb|thumbnail|frame|frameless|border|left|right|center|none|\d+px|upright.*)\s*", p)]
    return page.element("x-figure", parts[-1] if parts else "")


def _quote(page: Page, m: re.Match) -> str:
    return page.element("x-quote", "\n".join(line[1:].lstrip(" \t") for line in m.group().split("\n")))


def _said(page: Page, m: re.Match) -> str:
    return page.element("x-quote", " — ".join(x.strip() for x in m[1].split("|")))


def _note(page: Page, m: re.Match) -> str:
    return f" ({page.element('x-note', m[1])})"


def _verbatim(page: Page, m: re.Match) -> str:
    return page.tag("leaf", "x-inline", m[2])


def _strong(page: Page, m: re.Match) -> str:
    return m.group() if m.group() in _DUNDER else page.element("b", m[1])


def _items(page: Page, m: re.Match) -> str:
    return re.sub(r"(?m)^([ \t]*)[-*+•][ \t]+", lambda x: x[1] + page.tag("void", "x-item"), m.group())


#: (a sign without which the rule can't match, rule, what its matches become)
_BLOCK_RULES: list[tuple] = [
    # LaTeX structure
    ("\\", re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?(?:\[[^\]]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}"), _heading),
    ("\\", re.compile(r"^[ \t]*\\item(?:\[([^\]]*)\])?[ \t]*", re.M), lambda page, m: page.tag("open", "li", "") + (m[1] + " " if m[1] else "")),
    ("\\", re.compile(r"\\(begin|end)\{([A-Za-z]+)\*?\}(?:\[[^\]]*\])?(?:\{[^}]*\})?"), _environment),
    # wiki structure
    ("=", re.compile(r"^={2,6}[ \t]*([^=\n].*?)[ \t]*={2,6}[ \t]*$|^=[ \t]+([^=\n]+?)[ \t]+=[ \t]*$", re.M), _heading),
    ("|", re.compile(r"^\{\|.*$\n?|^\|\}[ \t]*$\n?|^\|-+[^|\n]*$\n?", re.M), _gone_line),
    (None, re.compile(r"^\|\+[ \t]*|^![ \t]+(?=\S)", re.M), _gone),
    ("__", re.compile(r"^__[A-Z]{3,}__[ \t]*$|__(?:NOTOC|TOC|FORCETOC|NOEDITSECTION|NOINDEX|INDEX)__", re.M), _gone),
    ("[[", re.compile(r"\[\[(?:Category|Kategorie|Catégorie|Categoría|Categoria|Категория|分类|カテゴリ)\s*:[^\[\]]*\]\]\n?", re.I), _gone_line),
    ("[[", re.compile(r"\[\[(?:File|Image|Datei|Fichier|Archivo|Ficheiro|Файл|文件|ファイル)\s*:[^|\[\]]*((?:\|[^|\[\]]*)*)\]\]", re.I), _file),
    # Markdown structure
    (None, re.compile(r"^(?!(?:\x02\d+\x03|\s)*$)(?![#>|])(.{1,200})\n(?:={3,}|-{3,})[ \t]*$", re.M), _heading),
    ("#", re.compile(r"^[ \t]{0,3}(?:#|#{3,6})[ \t]+(.+?)[ \t]*#*[ \t]*$", re.M), _heading),
    ("--", re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|[ \t]*(?::?-+:?[ \t]*)?$\n?", re.M), _gone_line),
    ("[^", re.compile(r"^\[\^[^\]\n]{1,20}\]:[ \t]*", re.M), _gone),
    ("[", re.compile(r"^\[[^\]^\n]{1,40}\]:[ \t]+\S+(?:[ \t]+[\"'(].*)?$\n?", re.M), _gone_line),
    (">", re.compile(r"^>[ \t]?(?![\d\s]).*(?:\n>.*)*", re.M), _quote),
]
_INLINE_RULES: list[tuple] = [
    ("`", re.compile(r"(`+)(?=[^`])([^\n]*?[^`\n])\1(?!`)(?!'(?!'))"), lambda page, m: page.tag("leaf", "x-inline", m[2]) if "''" not in m[2] else m.group()),
    ("![", re.compile(r"!\[([^\]\n]*)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)"), _as("x-figure", 1)),
    ("](", re.compile(r"\[([^\[\]\n]+)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)"), _as("a", 1)),
    ("[^", re.compile(r"\[\^[^\]\n]{1,20}\]"), _gone),
    ("<", re.compile(r"<((?:https?|ftp|mailto):[^<>\s]+)>"), _as("a", 1)),
    ("[[", re.compile(r"\[\[[^|\[\]\n]*\|([^\[\]\n]*)\]\]"), _as("a", 1)),
    ("[[", re.compile(r"\[\[([^|\[\]\n]+)\]\]"), _as("a", 1)),
    ("[", re.compile(r"\[(?:https?|ftp)://[^\s\[\]]+\s+([^\[\]\n]+)\]"), _as("a", 1)),
    ("{{", re.compile(r"\{\{\s*(?:quote|cquote|blockquote|quotation|lang|nowrap|nihongo)\s*\|((?:[^{}]|\n)*)\}\}", re.I), _said),
    ("{{", re.compile(r"\{\{[^{}]*\}\}"), _gone),
    ("``", re.compile(r"``(?=[^\s`])([^`\n]+?)''(?!')"), lambda page, m: page.element("q", f"“{m[1]}”")),
    ("'''''", re.compile(r"'{5}(?=\S)(.+?)(?<=\S)'{5}", re.S), _as("b", 1)),
    ("'''", re.compile(r"(?<!')'''(?!')(?=\S)(.+?)(?<=\S)'''(?!')", re.S), _as("b", 1)),
    ("''", re.compile(r"(?<!')''(?!')(?=\S)(.+?)(?<=[^\s'])''(?!')", re.S), _as("i", 1)),
    ("***", re.compile(r"\*\*\*(?=[^\s*])([^*]+?)(?<=[^\s*])\*\*\*"), _as("b", 1)),
    ("**", re.compile(r"\*\*(?=[^\s*])((?:(?!\n\n)[^*])+?)(?<=[^\s*])\*\*"), _as("b", 1)),
    ("*", re.compile(r"(?<![A-Za-z0-9*\\])\*(?=[^\s*])((?:(?!\n\n)[^*])+?)(?<=[^\s*])\*(?![A-Za-z0-9*])"), _as("i", 1)),
    ("__", re.compile(r"(?<![A-Za-z0-9_])__(?=[^\s_])((?:(?!\n\n)[^_])+?)(?<=[^\s_])__(?![A-Za-z0-9_])"), _strong),
    ("_", re.compile(r"(?<![A-Za-z0-9_\\])_(?=[^\s_])((?:(?!\n\n)[^_])+?)(?<=[^\s_])_(?![A-Za-z0-9_])"), _as("i", 1)),
    ("~~", re.compile(r"~~(?=[^\s~])([^~\n]+?)(?<=[^\s~])~~"), _as("s", 1)),
    ("\\", re.compile(_TEX + r"(?:" + "|".join(sorted(MUTE, key=len, reverse=True)) + r")\*?(?:\[[^\]]*\])?\{[^{}]*\}"), _gone),
    ("\\", re.compile(_TEX + r"footnote(?:\[[^\]]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}"), _note),
    ("\\", re.compile(_TEX + r"href\{[^{}]*\}\{((?:[^{}]|\{[^{}]*\})*)\}"), _as("a", 1)),
    ("\\", re.compile(_TEX + r"[A-Za-z]+\*?(?:\[[^\]]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}"), _as("x-span", 1)),
    ("\\", re.compile(_TEX + r"(?:" + "|".join(BARE.split()) + r")(?![A-Za-z\\])[ \t]*"), _gone),
    ("\\\\", re.compile(r"(?<=[ \w.!?。！？\x03])\\\\(?:\[[^\]]*\])?[ \t]*$", re.M), _gone),
]
_BULLET = re.compile(r"(?:(?<=\n\n)|\A|(?<=\n\n\n))[ \t]*[-*+•][ \t]+(?=\S).*(?:\n[ \t]*[-*+•][ \t]+(?=\S).*)*")
_WIKI_LIST = re.compile(r"^[*#:;]{1,4}[ \t]*(?=\[\[|''|\{\{)", re.M)
_COMMENT = re.compile(r"^%[ \t].*$\n?", re.M)
#: A text without any of these signs, in the places where they mark something up, holds no markup.
SIGNS = r"(?m)<[A-Za-z/!?]|&[#A-Za-z]|[\\`{]|\*\S|^[ \t]*[-*+•][ \t]+\S|_\S|\[\[|\]\(|\[\^|\[(?:https?|ftp):|^\[[^\]\n]{1,40}\]:|^[ \t]*[|!]|==|^=[ \t]|~~|\$\S|^[ \t]*#|^>|''|-{2,}"
_SIGNS = re.compile(SIGNS)


def clean(text: str, drop: set[int] | frozenset[int] = frozenset()) -> tuple[str, int, int]:
    """``(clean text, elements of markup found, template subtrees removed)``."""
    if not _SIGNS.search(text):
        return text, 0, 0
    page = Page(text)
    found = len(page.nodes) - 1
    if not found:
        return text, 0, 0
    body, removed = _rendered(page, set(drop))
    body = re.sub("\x07\n?", "", body)
    # table rows of Markdown and wiki
    if "|" in body and re.search(r"(?m)^\|", body):
        body = re.sub(r"(?m)^\|(.*?)\|?[ \t]*$", lambda m: "\t".join(c.strip() for c in re.split(r"\|\|?", m[1])), body)
    body = re.sub(r"\s*\x06", "", re.sub(r"\x05(?:[ \t\n]|\x05)*", "", body))
    body = re.sub(r"[ \t]+(?=\n|\Z)", "", body)
    body = re.sub(r"(?<=[^\s\x04])[ \xa0]{2,}", " ", body)
    return re.sub(r"\n{3,}", "\n\n", body).strip("\n").replace("\x04", " "), found, removed


def templates(pages: DataFrame, host: str, keys: list[str], text: str, *, least_pages: int = 5, share: float = 0.02) -> DataFrame:
    """``(host, drop)``: hashes of the subtrees on at least ``share`` of a host's pages with markup, and on ``least_pages`` of them.

    A page is one ``keys``, however often it was delivered: deliveries are told
    apart from pages by a hash of the keys, which is counted once.  A subtree
    that stands on one page only is settled before the shuffle by page.  A host
    can have at most ``1 / share`` times its subtrees per page, so the arrays
    stay short however many pages a host has.
    """
    some = pages.select(F.col(host).alias("host"), F.xxhash64(*keys).alias("page"), F.col(text).alias("text")).where("text IS NOT NULL AND host IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [subtree_hashes(t) for t in b["text"]]
            n = [len(x) for x in found]
            yield pd.DataFrame({"host": np.repeat(b["host"].to_numpy(), n), "page": np.repeat(b["page"].to_numpy(), n), "hash": np.array([h for x in found for h in x], np.int64)})

    kind = some.select("host").schema.simpleString()[7:-1].replace(":", " ")
    seen = some.where(F.col("text").rlike(SIGNS)).mapInPandas(run, f"{kind}, page long, hash long")
    counts = cut(seen.distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages), "subtrees")
    sizes = counts.where("hash = 0").select("host", F.col("n").alias("pages"))
    often = counts.where("hash <> 0").join(sizes, "host").where(F.col("n") >= share * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("hash").alias("drop"))


def clean_pages(pages: DataFrame, keys: list[str], host: str, text: str, *, latest: str | None = None, **limits: float) -> DataFrame:
    """``keys, clean_text, pieces, removed`` for every page with a text.

    ``pieces`` is the number of markup elements found, ``removed`` the number of
    template subtrees deleted.  Null texts give no row, texts without markup
    come out unchanged with 0 pieces.  With ``latest`` a page delivered again
    gives one row, that of the greatest value of this column; else one row for
    each delivery.  The table of templates is written first,
    so Spark knows its size: under the session's threshold it is broadcast and
    no page text is shuffled, else the join is by host, skewed hosts split.
    """
    want = list(dict.fromkeys([*keys, host, text, *([latest] if latest else [])]))
    pages = pages.select(*want)
    if latest:
        pages = live(pages, keys, latest)
    known = cut(templates(pages, host, keys, text, **limits), "templates")
    rows = pages.select(*keys, F.col(host).alias("_host"), F.col(text).alias("_text")).where("_text IS NOT NULL")
    rows = rows.join(known.select(F.col("host").alias("_host"), "drop"), "_host", "left").select(*keys, "_text", "drop")
    types = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [clean(t, set(d) if d is not None else frozenset()) for t, d in zip(b["_text"], b["drop"])]
            yield b[keys].assign(clean_text=[g[0] for g in got], pieces=[g[1] for g in got], removed=[g[2] for g in got])

    return rows.mapInPandas(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "clean_text string, pieces int, removed int"]))
