"""EPUB files: container, package, spine and documents, one row per section."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from lectern.functions.text import SKIPPED_TITLES, SKIPPED_WORDS
from lectern.operators.segment import clean
from lectern.sources.html import to_text

_SKIPPED = re.compile(rf"{SKIPPED_TITLES}|^(?:{SKIPPED_WORDS})[-_]?\d*$|(?:^|[-_])(?:{SKIPPED_WORDS})(?:[-_]|$)")
_HEADING = re.compile(r"<h[1-3][^>]*>(.*?)</h[1-3]>", re.I | re.S)


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _all(root: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (e for e in root.iter() if _local(e) == name)


def skipped(item: dict[str, str]) -> bool:
    """Documents that aren't HTML, and those for navigation, covers and the like."""
    media = item.get("media-type", "").lower()
    if media and "application/xhtml+xml" not in media and "text/html" not in media:
        return True
    stem = posixpath.splitext(posixpath.basename(item.get("href", "").replace("\\", "/")))[0].lower()
    return bool(re.search(r"\bnav\b", item.get("properties", "").lower()) or any(x and _SKIPPED.search(x) for x in (item.get("id", "").lower(), stem)))


def read_epub(data: bytes) -> dict:
    """``{title, author, sections: [(title, text)]}``; ValueError where the file is no usable EPUB."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())

        def text_of(name: str) -> str:
            return z.read(name).decode("utf-8", "replace") if name in names else ""

        container = text_of("META-INF/container.xml")
        if not container:
            raise ValueError("no container in the EPUB")
        package = next((e.get("full-path", "") for e in _all(ElementTree.fromstring(container), "rootfile")), "")
        source = text_of(package)
        if not source:
            raise ValueError("no package in the EPUB")
        root = ElementTree.fromstring(source)
        first = lambda name: next((t for e in _all(root, name) if (t := "".join(e.itertext()).strip())), None)
        by_id = {e.get("id", ""): dict(e.attrib) for e in _all(root, "item")}
        spine = [e.get("idref", "") for e in _all(root, "itemref")]
        if not spine:
            raise ValueError("the EPUB has an empty spine")
        found = []
        for ref in spine:
            item = by_id.get(ref)
            if item is None or skipped(item):
                continue
            href = item.get("href", "").replace("\\", "/")
            page = text_of(posixpath.join(posixpath.dirname(package), href) if posixpath.dirname(package) else href)
            body = to_text(page)
            if body:
                m = _HEADING.search(page)
                title = (clean(to_text(m[1])) if m else "") or posixpath.splitext(posixpath.basename(href))[0]
                found.append((title, body))
        if not found:
            raise ValueError("the EPUB has no text")
        return {"title": first("title"), "author": first("creator"), "sections": found}


def epub_rows(files: DataFrame) -> DataFrame:
    """``path, title, author, section_no, section_title, text, error`` of ``binaryFile`` rows.

    A file that can't be read gives one row with its error instead of failing the job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, data in zip(b["path"], b["content"]):
                try:
                    e = read_epub(bytes(data))
                    out += [(path, e["title"], e["author"], n, t, x, None) for n, (t, x) in enumerate(e["sections"])]
                except (ValueError, zipfile.BadZipFile, ElementTree.ParseError, KeyError) as x:
                    out.append((path, None, None, None, None, None, str(x)))
            frame = pd.DataFrame(out, columns=["path", "title", "author", "section_no", "section_title", "text", "error"])
            yield frame.astype({"section_no": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, title string, author string, section_no int, section_title string, text string, error string")
