"""Bytes to text: byte-order marks, strict UTF-8, else the legacy decoding that looks best."""

from __future__ import annotations

import codecs
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

#: Legacy encodings tried in order.
LEGACY = ("gb18030", "gbk", "utf-16-le")
_BAD = ((re.compile("�"), 30), (re.compile("\0"), 20), (re.compile("[\x01-\x08\x0b\x0c\x0e-\x1f]"), 10), (re.compile("[锟斤拷ÃÂÐÑÊÖÎ]"), 2))


def score(text: str) -> int:
    """The same scale as ``functions.text.misdecode_score``."""
    return sum(len(p.findall(text)) * w for p, w in _BAD) if text else 1000


def decode(data: bytes | None) -> str:
    """Text of a file.

    Unlike a rule that mistrusts accented capitals, valid UTF-8 without
    control characters is always taken as UTF-8.  Null bytes give ''.
    """
    if not data:
        return ""
    if data.startswith(codecs.BOM_UTF8):
        return data[3:].decode("utf-8")
    if data.startswith(codecs.BOM_UTF16_LE):
        return data[2:].decode("utf-16-le", "replace")
    try:
        text = data.decode("utf-8")
        if not re.search("[\0-\x08\x0b\x0c\x0e-\x1f�]", text):
            return text
    except UnicodeDecodeError:
        pass
    return min((data.decode(e, "replace") for e in LEGACY), key=score)


def decoded(content: Column) -> Column:
    return arrow_udf(lambda col: pa.array([decode(x) for x in col.to_pylist()], pa.string()), "string")(content)


