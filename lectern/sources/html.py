"""HTML to text.

Contract: img, script and style are skipped; block elements stand on lines of
their own, paragraphs and headings apart by a blank line; list items begin
with ``* ``; character references are decoded; white space is collapsed except
in ``pre``; nothing is upper-cased and link targets are left out.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from lectern.operators.segment import clean

_SKIP = {"script", "style", "head", "template"}
_APART = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "blockquote", "pre", "section", "article", "div"}
_LINE = {"li", "tr", "br", "dt", "dd", "hr", "header", "footer", "nav", "aside", "figure", "figcaption", "caption"}


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip = self.pre = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skip += tag in _SKIP
        self.pre += tag == "pre"
        if tag in _APART:
            self.parts.append("\n\n")
        elif tag in _LINE:
            self.parts.append("\n")
        if tag == "li":
            self.parts.append("* ")

    def handle_endtag(self, tag: str) -> None:
        self.skip -= tag in _SKIP and self.skip > 0
        self.pre -= tag == "pre" and self.pre > 0
        if tag in _APART:
            self.parts.append("\n\n")
        elif tag in ("td", "th"):
            self.parts.append(" ")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append(data if self.pre else re.sub(r"[ \t\n\f\r]+", " ", data))


def to_text(html: str | None) -> str:
    if not html:
        return ""
    p = _Text()
    p.feed(html)
    p.close()
    return clean("".join(p.parts))


def html_text(html: Column) -> Column:
    return arrow_udf(lambda col: pa.array([to_text(x) for x in col.to_pylist()], pa.string()), "string")(html)
