"""Which texts may hold one of many passages: parts of fixed sizes, hashed by numpy and looked up in one bit set.

A passage is known by its first ``size_of`` code points; every place of a text
is asked for each size in use.  Sizes up to ``EXACT`` are those of the whole
passage, so that the part found is the passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Passages up to EXACT code points are looked up whole, longer ones by their longest beginning of one of these sizes.
EXACT, SIZES = 11, (12, 16, 20, 24, 32, 48)
#: Bits of the set for each passage, tests of a part, and the largest set (as powers of two: 4 KB and 64 MB).
BITS, TESTS, LEAST, MOST = 64, 4, 15, 29
#: Code points hashed at once.
STEP = 1 << 20
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_TESTS = tuple(pow(0xBF58476D1CE4E5B9, 2 * n + 1, 1 << 64) for n in range(TESTS))


def size_of(passage: Column) -> Column:
    n = F.length(passage)
    return F.when(n <= EXACT, n).otherwise(F.array_max(F.filter(F.array(*map(F.lit, SIZES)), lambda k: k <= n)))


def _u(n: int) -> np.uint64:
    return np.uint64(n % (1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _u(32))) * _u(_MIX)
    return (x ^ (x >> _u(29))) * _u(_MIX)


class _Hashes:
    """Hash of the part of any size at every place of a run of code points."""

    def __init__(self, text: str) -> None:
        self.known = {1: _mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + _u(_BASE))}

    def __getitem__(self, size: int) -> np.ndarray:
        if size not in self.known:
            a = 1 << ((size - 1).bit_length() - 1)
            head, tail = self[a], self[size - a]
            n = max(0, len(self.known[1]) - size + 1)
            self.known[size] = head[:n] * _u(pow(_BASE, size - a, 1 << 64)) + tail[a : a + n]
        return self.known[size]


def _keys(hashes: np.ndarray, group: np.ndarray, size: int) -> np.ndarray:
    return _mix(hashes ^ (group + np.array([size * _BASE % (1 << 64)], np.uint64)))


def _slots(keys: np.ndarray, test: int, bits: int) -> np.ndarray:
    return (keys * _u(_TESTS[test])) >> _u(64 - bits)


def keyed(passages: DataFrame, group: str, text: str, bits: int) -> DataFrame:
    """``passages`` with ``_size`` and ``_key`` of each, and its places in the set, ``_slots``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups = b.column("_group").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            sizes = b.column("_size").to_pylist()
            keys = np.concatenate([_keys(_Hashes(t[:k])[k], groups[n : n + 1], k) for n, (t, k) in enumerate(zip(b.column(text).to_pylist(), sizes))] or [np.empty(0, np.uint64)])
            slots = np.stack([_slots(keys, n, bits) for n in range(TESTS)], axis=1).astype(np.int64)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * TESTS, pa.int32()), pa.array(slots.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(group), b.column(text), b.column("_size"), pa.array(keys.view(np.int64)), rows], names=[group, text, "_size", "_key", "_slots"])

    sized = passages.select(group, text, size_of(F.col(text)).cast("int").alias("_size"), F.xxhash64(group).alias("_group"))
    return sized.mapInArrow(run, f"{group} {sized.schema[group].dataType.simpleString()}, {text} string, _size int, _key bigint, _slots array<bigint>")


def bit_set(passages: DataFrame, bits: int) -> np.ndarray:
    """The set of the ``_slots`` of all passages; the driver receives its ``2 ** bits`` bits and no more."""
    slot = passages.select(F.explode("_slots").alias("s"))
    parts = slot.groupBy(F.shiftright("s", 15).alias("n")).agg(F.bitmap_construct_agg(F.col("s").bitwiseAND(F.lit(32767))).alias("b"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts.toLocalIterator():
        out[r["n"] * 4096 : (r["n"] + 1) * 4096] = np.frombuffer(r["b"], np.uint8)
    return out


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Rows and texts, about ``STEP`` code points at a time; longer texts in pieces that overlap."""
    rows, parts, n = [], [], 0
    for row, t in enumerate(texts):
        for at in range(0, len(t), STEP):
            part = t[at : at + STEP + SIZES[-1] - 1]
            if n + len(part) > 2 * STEP:
                yield rows, parts
                rows, parts, n = [], [], 0
            rows.append(row)
            parts.append(part)
            n += len(part)
    if parts:
        yield rows, parts


def _found(texts: list[str], groups: np.ndarray, sizes: list[int], found: np.ndarray, bits: int) -> tuple[dict[int, set[int]], dict[int, set[str]]]:
    keys: dict[int, set[int]] = {}
    parts: dict[int, set[str]] = {}
    for rows, pieces in _pieces(texts):
        run = "".join(pieces)
        lengths = np.array([len(p) for p in pieces])
        ends = np.cumsum(lengths)
        of = np.repeat(np.arange(len(pieces)), lengths)
        left = ends[of] - np.arange(len(run))
        group, h = groups[np.array(rows)][of], _Hashes(run)
        for size in sizes:
            x = _keys(h[size], group[: max(0, len(run) - size + 1)], size)
            at = np.arange(len(x))
            for test in range(TESTS):
                s = _slots(x, test, bits)
                hit = np.flatnonzero((found[(s >> _u(3)).astype(np.int64)] >> (s & _u(7)).astype(np.uint8)) & 1)
                x, at = x[hit], at[hit]
            whole = left[at] >= size
            for i, key in zip(at[whole].tolist(), x[whole].view(np.int64).tolist()):
                row = rows[of[i]]
                if size <= EXACT:
                    parts.setdefault(row, set()).add(run[i : i + size])
                else:
                    keys.setdefault(row, set()).add(key)
    return keys, parts


def holding(texts: DataFrame, group: str, text: str, sizes: list[int], found: np.ndarray, bits: int) -> DataFrame:
    """The rows of ``texts`` that may hold a passage of their ``group``, with ``_keys`` of long parts and ``_parts``, short ones themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups = b.column("_group").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            keys, parts = _found(b.column(text).to_pylist(), groups, sizes, found, bits)
            rows = sorted(keys.keys() | parts.keys())
            kept = b.drop_columns(["_group"]).take(pa.array(rows, pa.int64()))
            lists = [pa.array([sorted(x.get(r, ())) for r in rows], pa.list_(kind)) for x, kind in ((keys, pa.int64()), (parts, pa.string()))]
            yield pa.RecordBatch.from_arrays([*kept.columns, *lists], names=[*kept.schema.names, "_keys", "_parts"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    return texts.withColumn("_group", F.xxhash64(group)).mapInArrow(run, f"{schema}, _keys array<bigint>, _parts array<string>")


def fitting(n: int) -> int:
    """Power of two of the bits for ``n`` passages."""
    return min(MOST, max(LEAST, (BITS * max(n, 1) - 1).bit_length()))


