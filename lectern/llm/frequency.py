"""Problem 2: how often every distinct term occurs, and in how many records.

Method: a global integer dictionary, terms encoded through it, count arrays
accumulated block by block and summed by identifier range.

Shape of the plan
-----------------
1. Postings are hashed by record, so that deduplication, the number of records
   and the per-block accumulation all happen on one shuffle.  A block is one
   such partition; records never straddle blocks.
2. Each block codes its own terms 0..k-1 and adds occurrences and record
   presence into two arrays with ``bincount``.  It emits one row per distinct
   term of the block, so a term that holds a third of all rows leaves a block
   as a single row: no later shuffle sees a hot key.
3. The distinct terms get dense identifiers: position within their partition
   plus the partition's offset (one number per partition reaches the driver).
4. Block partials are encoded by joining on the term, moved by identifier
   range, and added into dense arrays of ``RANGE`` slots.  A task holds one
   pair of arrays per range it owns, whatever the number of blocks.

The dictionary grows with the data, so the joins with it merge and never
broadcast it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.runtime import cut

#: Identifiers per count array; two int64 arrays of a range take 1 MB.
RANGE = 1 << 16
#: A block hands on what it has once it holds this many distinct terms.
FLUSH_TERMS = 1 << 20

#: What counts as an outer space of a term.
_OUTER = "".join(map(chr, (*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))


def normal_term(c: Column) -> Column:
    """Without outer spaces and in lower case."""
    return F.lower(F.btrim(c, F.lit(_OUTER)))


def live_postings(postings: DataFrame) -> DataFrame:
    """One row per (record, term): the latest delivery of each, blank and non-positive ones dropped.

    Rows of one record and term with equal ``indexed_at`` are settled by the
    larger hit_count; a null ``indexed_at`` is older than any other.
    """
    kept = (
        postings.select("book_id", "chunk_id", normal_term(F.col("term")).alias("term"), "hit_count", "indexed_at")
        .where("term <> '' AND hit_count >= 1")
        .repartition("book_id", "chunk_id")
    )
    return kept.groupBy("book_id", "chunk_id", "term").agg(F.max(F.struct("indexed_at", "hit_count")).alias("last")).select("book_id", "chunk_id", "term", F.col("last.hit_count").cast("long").alias("hits"))


def _block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count arrays of one block, whose rows come record by record. A row without a term carries the block's number of records."""
    code: dict[str, int] = {}
    hits, seen = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
    records, last = 0, None
    out = ["term", "hits", "records"]

    def partial() -> pa.RecordBatch:
        n = len(code)
        return pa.RecordBatch.from_arrays([pa.array(list(code), pa.string()), pa.array(hits[:n]), pa.array(seen[:n])], names=out)

    for b in batches:
        local = b.column(0).dictionary_encode()
        names = local.dictionary.to_pylist()
        to_block = np.fromiter((code.setdefault(t, len(code)) for t in names), np.int64, len(names))
        if len(code) > len(hits):
            grow = max(len(code), 2 * len(hits)) - len(hits)
            hits, seen = np.pad(hits, (0, grow)), np.pad(seen, (0, grow))
        ids = to_block[local.indices.to_numpy(zero_copy_only=False)]
        # every row is one (record, term), so presence is the number of rows
        hits[: len(code)] += np.bincount(ids, weights=b.column(1).to_numpy(zero_copy_only=False), minlength=len(code)).astype(np.int64)[: len(code)]
        seen[: len(code)] += np.bincount(ids, minlength=len(code))[: len(code)]
        rec = b.column(2).to_numpy(zero_copy_only=False)
        if len(rec):
            records += int((rec[1:] != rec[:-1]).sum()) + (rec[0] != last)
            last = rec[-1]
        if len(code) >= FLUSH_TERMS:
            yield partial()
            code.clear()
            hits[:], seen[:] = 0, 0
    if code:
        yield partial()
    if records:
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([0], pa.int64()), pa.array([int(records)], pa.int64())], names=out)


def _sum_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds encoded partials into one dense array pair per identifier range."""
    arrays: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        ids = b["id"].to_numpy()
        for r in np.unique(ids // RANGE):
            at = ids // RANGE == r
            hits, seen = arrays.setdefault(int(r), (np.zeros(RANGE, np.int64), np.zeros(RANGE, np.int64)))
            np.add.at(hits, ids[at] % RANGE, b["hits"].to_numpy()[at])
            np.add.at(seen, ids[at] % RANGE, b["records"].to_numpy()[at])
    for r, (hits, seen) in arrays.items():
        slot = np.flatnonzero(seen)
        yield pd.DataFrame({"id": r * RANGE + slot, "hits": hits[slot], "records": seen[slot]})


def dictionary(terms: DataFrame) -> DataFrame:
    """``(term, id)`` with dense identifiers 0..n-1 for the distinct values of ``terms.term``."""
    placed = cut(terms.select("term").distinct().select("term", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("mid")), "terms")
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts = dict(zip([p for p, _ in sizes], np.cumsum([0, *(n for _, n in sizes)]).tolist()))
    offset = F.create_map(*(F.lit(x) for p in starts.items() for x in (int(p[0]), int(p[1]))))[F.col("part")] if starts else F.lit(0)
    return placed.select("term", (offset.cast("long") + F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))).alias("id"))


def term_counts(postings: DataFrame) -> tuple[DataFrame, int]:
    """``(term, hits, records)`` over the whole collection, and the number of records that keep a row.

    Nulls in the keys are keys of their own; an empty table gives an empty
    result and 0 records; other columns of the input are ignored.
    """
    live = live_postings(postings)
    live = live.sortWithinPartitions("book_id", "chunk_id")  # which the aggregate has done already
    blocks = cut(live.select("term", "hits", F.xxhash64("book_id", "chunk_id").alias("record")).mapInArrow(_block_counts, "term string, hits long, records long"), "blocks")
    total = blocks.where("term IS NULL").agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    partial = blocks.where("term IS NOT NULL")
    words = dictionary(partial)
    encoded = partial.join(words.hint("merge"), "term").select("id", "hits", "records")
    summed = encoded.repartition(F.expr(f"id div {RANGE}")).mapInPandas(_sum_ranges, "id long, hits long, records long")
    return summed.join(words.hint("merge"), "id").select("term", "hits", "records"), total


def verdicts(postings: DataFrame, *, min_hits: int = 3, max_share: float = 0.15) -> DataFrame:
    """Every term with its counts and ``verdict``: ``rare``, ``common`` or null.

    A term that is both (possible in tiny collections only) is ``rare``.
    """
    counts, total = term_counts(postings)
    return counts.withColumn("verdict", F.when(F.col("hits") < min_hits, "rare").when(F.col("records") > max_share * F.lit(total), "common"))
