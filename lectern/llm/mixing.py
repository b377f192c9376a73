"""Problem 9: mixing sources to target shares of all tokens.

Method: soft-membership mixing.  A classifier fitted on labelled rows predicts
the domain posteriors of rows whose source is unknown; a text of known source
belongs to that source alone.  Projected-gradient least squares, with
distributed gradient sums, fits a nonnegative rate of use for each text, so
that the expected token totals by domain match the targets.

Each text then gets its own whole copies: the floor of its rate, and one more
with the probability of the fraction (a hash of the text decides).  A factor on
these probabilities, one for each domain and close to 1, is set from
histograms so that the copies hold the expected tokens of the fit.

Equal texts are one text: they share one number of copies.  Texts of one known
source all follow the same path under the gradient, so they enter it as one
pre-aggregated row; only texts of unknown source enter row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.tokens import VOCABULARY, encoding
from lectern.runtime import bounded_sample, cut

#: Labelled rows on which the classifier is fitted, at most; features it hashes token ids to.
FIT_ROWS, FEATURES = 6_000, 4_096
#: Gradient steps before the total is lowered, and the miss (share of the total) at which they end.
STEPS, NEAR = 40, 1e-4


def fit_classifier(texts: list[str], labels: list[str], path: str = VOCABULARY) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Multinomial naive Bayes over hashed token ids: ``(domains, log priors, log likelihoods)``."""
    names = sorted(set(labels))
    place = {n: k for k, n in enumerate(names)}
    counts = np.zeros((len(names), FEATURES))
    prior = np.zeros(len(names))
    encode = encoding(path).encode_ordinary
    for t, y in zip(texts, labels):
        prior[place[y]] += 1
        np.add.at(counts[place[y]], np.array(encode(t), np.int64) * 2654435761 % 4294967291 % FEATURES, 1)
    smooth = 1.0 + 50.0 * (counts.sum(0) + 1) / (counts.sum() + FEATURES)
    like = np.log(counts + smooth) - np.log((counts + smooth).sum(1, keepdims=True))
    return names, np.log((prior + 1) / (prior + 1).sum()), like


def _texts(documents: DataFrame, model: tuple, domains: list[str], path: str) -> DataFrame:
    """``doc_id, source, key, n_tokens, p``: size of every row, and posteriors where the source is unknown."""
    names, prior, like = model
    where = np.array([domains.index(n) if n in domains else len(domains) for n in names], int)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(path).encode_ordinary
        for b in batches:
            sizes, ps = [], []
            for t, known in zip(b["text"], b["source"].notna()):
                ids = encode(t)
                sizes.append(len(ids))
                if known or not names:
                    ps.append(None)
                    continue
                h = np.bincount(np.array(ids, np.int64) * 2654435761 % 4294967291 % FEATURES, minlength=FEATURES)
                z = prior + like @ h / max(1.0, len(ids)) * min(len(ids), 50)  # long texts aren't over-sure
                p = np.exp(z - z.max())
                out = np.zeros(len(domains) + 1)
                np.add.at(out, where, p / p.sum())
                ps.append(out)
            yield b[["doc_id", "source", "key"]].assign(n_tokens=sizes, p=ps)

    rows = documents.select("doc_id", "source", "text", F.md5("text").alias("key")).where("text IS NOT NULL AND text <> '' AND doc_id IS NOT NULL")
    return rows.mapInPandas(run, "doc_id long, source string, key string, n_tokens long, p array<double>")


def _most(p: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    """Whole copies a text may be used for: the repeats its memberships allow."""
    return np.floor(p @ repeats + 1e-6)


def _rate(p: np.ndarray, most: np.ndarray, path: list[np.ndarray]) -> np.ndarray:
    """Rates after the steps so far: each step moves along the gradient and is projected onto [0, most]."""
    r = np.minimum(1.0, most)
    for step in path:
        r = np.clip(r + p @ step, 0.0, most)
    return r


def fit_rates(sums, have: np.ndarray, share: np.ndarray, repeats: np.ndarray, total: float | None) -> tuple[list[np.ndarray], float, np.ndarray]:
    """``(steps, total, expected tokens by domain)`` of the projected gradient.

    ``sums(steps)`` gives the expected tokens of the soft texts at the rates of
    these steps, what a unit step would move, and their tokens at the most
    copies.  The total defaults to the most at which each domain that has
    tokens could hold its share; where memberships overlap so that the
    targets can't be met together, it is lowered until they can.
    """
    one = np.eye(len(have))
    e, a, most = sums([])
    most = most + have * repeats
    present = most > 0
    if not present.any():
        return [], 0.0, np.zeros(len(have))
    whole = total or float((most[present] / share[present]).min())
    steps: list[np.ndarray] = []
    while True:
        for _ in range(STEPS):
            expected = e + have * _rate(one, repeats, steps)
            miss = np.where(present, share * whole - expected, 0.0)
            if np.abs(miss).max() <= NEAR * whole:
                return steps, whole, expected
            steps.append(np.where(a + have > 0, miss / np.maximum(a + have, 1e-9), 0.0))
            e, a, _ = sums(steps)
        if total or np.abs(miss)[present].max() <= 0.01 * (share * whole)[present].min():
            return steps, whole, e + have * _rate(one, repeats, steps)
        whole *= 0.97


def mixture(documents: DataFrame, targets: DataFrame, *, total_tokens: float | None = None, path: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, source, copies, n_tokens)`` of the texts used, and ``(source, target_share, max_repeats, expected_tokens, tokens, actual_share)``.

    A text of unknown source is named by its likeliest domain; in the shares it
    counts for each domain by its membership.  ``expected_tokens`` are those of
    the fit, ``tokens`` those reached.  Null, empty and unidentified texts are
    not used.  A source without texts reaches share 0, and the others divide
    the rest in proportion.  Texts of sources without a target are never used.
    ``total_tokens`` as in :func:`fit_rates`.
    """
    goal = sorted((r["source"], float(r["target_share"]), int(r["max_repeats"])) for r in targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").collect())
    domains = [g[0] for g in goal]
    share, repeats = np.array([g[1] for g in goal]), np.array([g[2] for g in goal], float)
    spark = documents.sparkSession
    if not goal:
        return spark.createDataFrame([], "doc_id long, source string, copies int, n_tokens long"), spark.createDataFrame([], "source string, target_share double, max_repeats int, expected_tokens double, tokens double, actual_share double")
    labelled_rows = documents.where("source IS NOT NULL AND text IS NOT NULL").select("doc_id", "source", "text")
    sample = bounded_sample(labelled_rows, FIT_ROWS, "doc_id").collect()
    model = fit_classifier([r["text"] for r in sample], [r["source"] for r in sample], path)
    read = cut(_texts(documents, model, domains, path), "sizes")
    # one row per text: its smallest id, and the source of its smallest id that has one
    texts = read.groupBy("key").agg(F.min(F.struct("doc_id", "n_tokens")).alias("first"), F.min(F.when(F.col("source").isNotNull(), F.struct("doc_id", "source"))).alias("known"), F.first("p", ignorenulls=True).alias("p"))
    texts = cut(texts.select("key", F.col("first.doc_id").alias("doc_id"), F.col("first.n_tokens").alias("n_tokens"), F.col("known.source").alias("source"), F.when(F.col("known").isNull(), F.slice("p", 1, len(domains))).alias("p")).where("source IS NOT NULL OR p IS NOT NULL"), "texts")
    labelled = {r["source"]: float(r["t"]) for r in texts.where(F.col("source").isin(domains)).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    have = np.array([labelled.get(d, 0.0) for d in domains])
    soft = texts.where("source IS NULL").select("n_tokens", "p")
    k = len(domains)

    def sums(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            e, a, top = np.zeros(k), np.zeros(k), np.zeros(k)
            for b in batches:
                if len(b):
                    p, t = np.stack(b["p"].to_numpy()), b["n_tokens"].to_numpy(float)
                    most = _most(p, repeats)
                    e += (_rate(p, most, steps) * t) @ p
                    a += t @ (p * p)
                    top += (most * t) @ p
            yield pd.DataFrame({"d": range(k), "e": e, "a": a, "top": top})

        out = np.zeros((3, k))
        for x in soft.mapInPandas(run, "d int, e double, a double, top double").groupBy("d").agg(F.sum("e").alias("e"), F.sum("a").alias("a"), F.sum("top").alias("top")).collect():
            out[:, x["d"]] = x["e"], x["a"], x["top"]
        return out[0], out[1], out[2]

    steps, _, expected = fit_rates(sums, have, share, repeats, total_tokens)

    # every text's own rate: whole copies, and the fraction that is drawn
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = np.vstack([np.eye(k), np.zeros(k)])
        place = {d: n for n, d in enumerate(domains)}
        for b in batches:
            p = one[[place.get(s, k) for s in b["source"]]]
            for n, q in enumerate(b["p"]):
                if q is not None:
                    p[n] = q
            r = _rate(p, _most(p, repeats), steps)
            base = np.floor(r + 1e-9)
            frac = np.maximum(r - base, 0.0)
            u = np.array([int(x[:13], 16) for x in b["key"]]) / float(1 << 52)
            with np.errstate(divide="ignore"):
                v = np.where(frac > 1e-9, u / frac, np.inf)
            yield pd.DataFrame({"key": b["key"], "doc_id": b["doc_id"], "n_tokens": b["n_tokens"], "domain": [domains[x] for x in p.argmax(1)], "p": b["p"], "base": base.astype(int), "frac": frac, "v": v}).loc[r > 1e-9]

    rated = cut(texts.mapInPandas(apply, "key string, doc_id long, n_tokens long, domain string, p array<double>, base int, frac double, v double"), "rated")
    used = draw(rated)
    used = cut(used.where("copies > 0"), "used")
    member = F.explode(F.arrays_zip(F.array(*map(F.lit, domains)).alias("d"), F.col("p").alias("p"))).alias("m")
    tokens = F.col("copies") * F.col("n_tokens")
    known = used.where("p IS NULL").groupBy(F.col("domain").alias("source")).agg(F.sum(tokens.cast("double")).alias("t"))
    partly = used.where("p IS NOT NULL").select(tokens.alias("t"), member).groupBy(F.col("m.d").alias("source")).agg(F.sum(F.col("t") * F.col("m.p")).alias("t"))
    got = known.unionByName(partly).groupBy("source").agg(F.sum("t").alias("tokens"))
    asked = spark.createDataFrame([(d, float(s), int(m), float(x)) for (d, s, m), x in zip(goal, expected)], "source string, target_share double, max_repeats int, expected_tokens double")
    shares = asked.join(got, "source", "left").withColumn("whole", F.sum("tokens").over(Window.partitionBy(F.lit(1)))).select("source", "target_share", "max_repeats", "expected_tokens", F.coalesce("tokens", F.lit(0.0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"))
    return used.select("doc_id", F.col("domain").alias("source"), "copies", "n_tokens"), shares


#: Buckets of a histogram of one domain; two are taken, the second within one bucket of the first.
BUCKETS = 2_048


def draw(rated: DataFrame) -> DataFrame:
    """``rated`` with ``copies``: ``base``, and one more where ``v`` is below the limit of the domain.

    ``v`` is a uniform number over the text's fraction, so a limit of 1 draws
    each text with the probability of its fraction.  The limit of a domain is
    set where the extra copies hold the tokens the fractions stand for: two
    histograms find the bucket (``BUCKETS`` numbers a domain reach the driver),
    and the texts of the last bucket are taken in order, as many as fit.  What
    is then still missing goes to the largest text that fits, until none does or less
    than ``NEAR`` of the domain is missing.
    """
    some = rated.where(f"frac > 1e-9 AND v < {BUCKETS}")
    want = {r["domain"]: (float(r["w"] or 0), float(r["t"])) for r in rated.groupBy("domain").agg(F.sum(F.col("frac") * F.col("n_tokens")).alias("w"), F.sum((F.col("base") + F.col("frac")) * F.col("n_tokens")).alias("t")).collect()}
    at = {d: [0.0, w] for d, (w, _) in want.items()}  # limit so far, tokens still wanted
    width = 2.0
    for level in range(2):
        starts = F.create_map(*(F.lit(x) for d, (v, _) in at.items() for x in (d, v))) if at else F.create_map().cast("map<string,double>")
        step = width / BUCKETS
        off = F.floor((F.col("v") - F.element_at(starts, F.col("domain"))) / step)
        for d, own in _by_domain(some.withColumn("b", off).where(f"b >= 0 AND b < {BUCKETS}").groupBy("domain", "b").agg(F.sum("n_tokens").alias("t")).collect()).items():
            start, left = at[d]
            end = BUCKETS
            for b, t in sorted(own):
                if left < t:
                    end = b
                    break
                left -= t
            at[d] = [start + end * step, left]
        width = step
    limit = F.create_map(*(F.lit(x) for d, (v, _) in at.items() for x in (d, v))) if at else F.create_map().cast("map<string,double>")
    left = F.create_map(*(F.lit(x) for d, (_, n) in at.items() for x in (d, n))) if at else F.create_map().cast("map<string,double>")
    edge = F.element_at(limit, F.col("domain"))
    last = some.where((F.col("v") >= edge) & (F.col("v") < edge + width)).withColumn("sum", F.sum("n_tokens").over(Window.partitionBy("domain").orderBy("v", "key").rowsBetween(Window.unboundedPreceding, 0)))
    extra = {(r["domain"], r["key"]): r["n_tokens"] for r in last.where(F.col("sum") <= F.element_at(left, F.col("domain"))).select("domain", "key", "n_tokens").collect()}
    for d, key in extra:
        at[d][1] -= extra[d, key]
    open_ = {d for d in at if at[d][1] > NEAR * want[d][1]}
    while open_:
        room = F.create_map(*(F.lit(x) for d in sorted(open_) for x in (d, at[d][1])))
        fits = some.where((F.col("v") >= edge) & (F.col("n_tokens") > 0) & (F.col("n_tokens") <= F.try_element_at(room, F.col("domain"))) & ~F.col("key").isin([k for _, k in extra]))
        best = {r["domain"]: r["m"] for r in fits.groupBy("domain").agg(F.max(F.struct("n_tokens", "key")).alias("m")).collect()}
        for d, m in best.items():
            extra[d, m["key"]] = m["n_tokens"]
            at[d][1] -= m["n_tokens"]
        open_ = {d for d in best if at[d][1] > NEAR * want[d][1]}
    more = (F.col("frac") > 1e-9) & ((F.col("v") < edge) | F.col("key").isin([k for _, k in extra]))
    return rated.withColumn("copies", (F.col("base") + F.when(more, 1).otherwise(0)).cast("int"))


def _by_domain(rows: list) -> dict[str, list[tuple[int, float]]]:
    out: dict[str, list[tuple[int, float]]] = {}
    for r in rows:
        out.setdefault(r["domain"], []).append((r["b"], float(r["t"])))
    return out
