"""Problem 8: items of varying length into containers of fixed capacity, with little room wasted.

Method: swap-based local search.  Items are first laid into containers as they
come (large ones first, each into the fullest container that takes it).  Then
the emptiest container is drained: its items are moved to underfull containers,
exchanged one for one for a smaller item, or exchanged for two items that are
smaller together.  Every step takes from the emptier and gives to the fuller
one, so the sum of squared fills grows; containers empty and vanish until no
step is left or the volume allows no fewer.

Items are spread over shards by a hash, so a shard has about ``SHARD`` items
however many there are, and each shard and capacity is one independent task.
What the shards leave in underfull containers is then packed once more, many
shards together.  An item is split only if it exceeds the capacity: into full
containers, and a rest that is packed with the others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.runtime import cut

#: Items of a shard, about.
SHARD = 5_000


def first_layout(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items over half a container first, each into the fullest container that takes it, else in the order they come; items of size 0 take no room."""
    bins: list[list[int]] = []
    at: dict[int, list[int]] = {}  # containers by the room they have left
    have = 0  # bit r is set where a container has room r
    for i in np.argsort(sizes * 2 <= capacity, kind="stable").tolist():
        s = int(sizes[i])
        fits = have >> s
        if fits:
            left = s + (fits & -fits).bit_length() - 1
            b = at[left].pop()
            if not at[left]:
                have &= ~(1 << left)
            bins[b].append(i)
        else:
            left, b = capacity, len(bins)
            bins.append([i])
        at.setdefault(left - s, []).append(b)
        have |= 1 << (left - s)
    return bins


class _Search:
    """Containers under local search. Items are numbered by size, so that sizes are one sorted array."""

    def __init__(self, sizes: np.ndarray, bins: list[list[int]], capacity: int) -> None:
        self.order = np.argsort(sizes, kind="stable")
        self.size = sizes[self.order].astype(np.int64)
        place = np.empty(len(sizes), np.int64)
        place[self.order] = np.arange(len(sizes))
        self.bins = [[int(place[i]) for i in b] for b in bins]
        self.home = np.empty(len(sizes), np.int64)
        for b, own in enumerate(self.bins):
            self.home[own] = b
        self.room = np.array([capacity - int(self.size[own].sum()) for own in self.bins], np.int64)
        self.free = self.room[self.home]  # room beside each item
        self.capacity, self.pairs = capacity, None
        self.open = np.flatnonzero(self.room > 0)

    def shift(self, out: list[int], src: int, back: list[int], dst: int) -> None:
        """``out`` from ``src`` to ``dst``, ``back`` the other way."""
        for items, a, b in ((out, src, dst), (back, dst, src)):
            for i in items:
                self.bins[a].remove(i)
                self.bins[b].append(i)
                self.home[i] = b
        gain = int(self.size[out].sum() - self.size[back].sum()) if back else int(self.size[out].sum())
        self.room[src] += gain
        self.room[dst] -= gain
        self.free[self.bins[src]], self.free[self.bins[dst]] = self.room[src], self.room[dst]
        self.pairs = None

    def two(self, s: int, src: int) -> tuple[int, int, int] | None:
        """The two items of one container, smaller together than ``s``, whose place ``s`` can take; the pair with the least sum."""
        if self.pairs is None:
            live = np.flatnonzero(self.free > 0)
            by = live[np.argsort(self.home[live], kind="stable")]  # by container, then by size
            self.pairs = by, self.home[by], self.size[by], self.free[by], self.home[by] * (2 * self.capacity + 1) + self.size[by]
        by, home, size, free, key = self.pairs
        k = np.searchsorted(key, key - size + np.maximum(s - free - size, 0))
        k += k == np.arange(len(by))  # not with itself
        other = np.minimum(k, len(by) - 1)
        total = size + size[other]
        ok = (k < len(by)) & (home[other] == home) & (home != src) & (total < s) & (total >= s - free)
        hit = np.flatnonzero(ok)
        if not len(hit):
            return None
        j = int(hit[np.argmin(total[hit])])
        return int(home[j]), int(by[j]), int(by[other[j]])

    def step(self, src: int) -> bool:
        """One move or exchange out of ``src`` that makes a fuller container fuller."""
        own = sorted(self.bins[src], reverse=True)
        dst = self.open[(self.room[self.open] > 0) & (self.room[self.open] < self.capacity) & (self.open != src)]
        room, here = self.room[dst], int(self.room[src])
        most = int(room.max(initial=0))
        if most <= 0:
            return False
        for i in own:
            s = int(self.size[i])
            fits = np.flatnonzero((room >= s) & (room < here + s)) if s <= most else ()
            if len(fits):
                self.shift([i], src, [], int(dst[fits[np.argmin(room[fits])]]))
                return True
        for i in own:
            s = int(self.size[i])
            a, b = np.searchsorted(self.size, [s - most, s])
            z = self.size[a:b]
            ok = np.flatnonzero((z + self.free[a:b] >= s) & (self.home[a:b] != src) & (self.free[a:b] < self.room[src] + s - z))
            if len(ok):
                j = int(a + ok[0])  # sizes are sorted: the first is the smallest
                self.shift([i], src, [j], int(self.home[j]))
                return True
        for i in own:
            pair = self.two(int(self.size[i]), src)
            if pair and self.room[pair[0]] < self.room[src] + self.size[i] - self.size[pair[1]] - self.size[pair[2]]:
                self.shift([i], src, list(pair[1:]), pair[0])
                return True
        return False


def improve(sizes: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Local search until no container can be drained further; the number of containers never grows."""
    bins = [b for b in bins if b]
    if len(bins) < 2:
        return bins
    some = np.flatnonzero(sizes)  # the others take no room anywhere
    place = np.cumsum(sizes > 0) - 1
    x = _Search(sizes[some], [[int(place[i]) for i in b if sizes[i]] for b in bins], capacity)
    count, least = sum(map(bool, x.bins)), max(1, -(-int(sizes.sum()) // capacity))
    moved = True
    while moved and count > least:
        moved = False
        x.open = np.flatnonzero(x.room > 0)  # a full container stays full in a pass
        for src in x.open[np.argsort(-x.room[x.open], kind="stable")].tolist():
            if count <= least or not x.bins[src] or x.room[src] <= 0:
                continue
            while x.bins[src] and x.step(src):
                moved = True
            count -= not x.bins[src]
    out = [some[x.order[b]].tolist() for b in x.bins if b] or [[]]
    out[0] += np.flatnonzero(sizes == 0).tolist()
    return out


def pack_sizes(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers (lists of positions) for items none of which exceeds the capacity."""
    return improve(sizes, first_layout(sizes, capacity), capacity) if len(sizes) else []


def _packed(rows: DataFrame, by: list[str], key: str, kind: str, first: int) -> DataFrame:
    """Every group of ``rows`` (``capacity_id, cap, shard, k, piece, at, s``) packed for itself; container ids begin at ``first`` shards."""
    out = f"capacity_id int, cap int, shard int, bin_id long, `{key}` {kind}, piece_no int, begin_token long, n_tokens long, fill long"

    def run(_: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["u", "k", "piece"], kind="stable")
        sizes, cap = b["s"].to_numpy(np.int64), int(b["cap"].iloc[0])
        bins = pack_sizes(sizes, cap)
        where, fill = np.empty(len(b), np.int64), np.empty(len(b), np.int64)
        for n, own in enumerate(bins):
            where[own], fill[own] = n, sizes[own].sum()
        no = b["shard"].to_numpy(np.int64)
        return pd.DataFrame({"capacity_id": b["capacity_id"], "cap": b["cap"], "shard": b["shard"], "bin_id": where + (int(no.min()) + first << 32), key: b["k"], "piece_no": b["piece"], "begin_token": b["at"], "n_tokens": sizes, "fill": fill})

    return rows.groupBy(*by).applyInPandas(run, out)


def pack(items: DataFrame, key: str, size: str, capacities: DataFrame, *, shard: int = SHARD) -> DataFrame:
    """``capacity_id, bin_id, key, piece_no, begin_token, n_tokens``: every item in a container of each capacity.

    Repeated keys are separate items; null keys or sizes are left out, and so
    are capacities that are null or below 1.  ``capacities`` is a list of
    parameters (``capacity_id, max_tokens``) that the driver reads.
    """
    rows = items.select(F.col(key).alias("k"), F.col(size).cast("long").alias("s")).where("k IS NOT NULL AND s IS NOT NULL")
    shards = max(1, -(-rows.count() // shard))
    kind = dict(rows.dtypes)["k"]
    caps = sorted({(r["capacity_id"], r["max_tokens"]) for r in capacities.select("capacity_id", "max_tokens").where("capacity_id IS NOT NULL AND max_tokens >= 1").collect()})
    out = ["capacity_id", "bin_id", key, "piece_no", "begin_token", "n_tokens"]
    if not caps:
        return items.sparkSession.createDataFrame([], f"capacity_id int, bin_id long, `{key}` {kind}, piece_no int, begin_token long, n_tokens long")
    each = F.explode(F.array(*(F.struct(F.lit(int(i)).alias("capacity_id"), F.lit(int(c)).alias("cap")) for i, c in caps))).alias("c")
    u = F.xxhash64("k", "s")
    spread = rows.select("k", "s", u.alias("u"), F.pmod(u, F.lit(shards)).cast("int").alias("shard"), each).select("k", "s", "u", "shard", "c.*")
    # what exceeds a container: full pieces, each a container of its own, and a rest to be packed
    full = F.when(F.col("s") > F.col("cap"), F.ceil(F.col("s") / F.col("cap")).cast("int") - 1).otherwise(0)
    spread = spread.withColumn("piece", full).withColumn("at", F.col("piece") * F.col("cap").cast("long"))
    whole = spread.where("piece > 0").select("capacity_id", "k", "u", F.explode(F.sequence(F.lit(0), F.col("piece") - 1)).alias("n"), "cap")
    whole = whole.select("capacity_id", F.bitwise_not(F.monotonically_increasing_id()).alias("bin_id"), F.col("k").alias(key), F.col("n").alias("piece_no"), (F.col("n") * F.col("cap").cast("long")).alias("begin_token"), F.col("cap").cast("long").alias("n_tokens"))
    rest = spread.select("capacity_id", "cap", "shard", "k", "u", "piece", "at", (F.col("s") - F.col("at")).alias("s"))
    first = cut(_packed(rest, ["capacity_id", "cap", "shard"], key, kind, 0), "packed")
    # containers a shard left underfull, of many shards together: about ``shard`` items a task again
    left = first.where("fill < cap")
    done = first.where("fill >= cap")
    if shards > 1:
        groups = max(1, -(-left.count() // (shard * len(caps))))
        again = left.select("capacity_id", "cap", F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int").alias("shard"), F.col(key).alias("k"), F.xxhash64(key, "n_tokens").alias("u"), F.col("piece_no").alias("piece"), F.col("begin_token").alias("at"), F.col("n_tokens").alias("s"))
        left = _packed(again, ["capacity_id", "cap", "shard"], key, kind, shards)
    return done.select(out).unionByName(left.select(out)).unionByName(whole.select(out))


def summary(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per capacity: containers, the fewest possible by volume, tokens and the share of room used."""
    per = packed.groupBy("capacity_id").agg(F.countDistinct("bin_id").alias("bins"), F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"))
    return per.join(capacities, "capacity_id").select("capacity_id", "max_tokens", "pieces", "tokens", "bins", F.ceil(F.col("tokens") / F.col("max_tokens")).alias("fewest_bins"), (F.col("tokens") / (F.col("bins") * F.col("max_tokens"))).alias("fill"))
