"""Probabilistic record linkage of two tables without a common key.

Several blocking passes give candidate pairs; each pair becomes a vector of
agreement levels; expectation-maximisation over the counts of the vectors finds
how often matches and non-matches agree at each level; the posterior of a
vector is the confidence of its pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.session import cut

#: Level 0 of every comparison: a side has no value, which speaks neither for nor against.
MISSING = 0


def fit(vectors: np.ndarray, counts: np.ndarray, levels: Sequence[int], start_share: float = 0.2, rounds: int = 500, smooth: float = 0.5, never: tuple[int, int] | None = None) -> tuple[float, list[np.ndarray], list[np.ndarray]]:
    """Share of matches and, for each comparison, the probabilities of its levels among matches and non-matches.

    ``vectors`` is one row a distinct vector, ``counts`` how many pairs have it.
    Only vectors reach this place, never pairs: their number is the product of
    the levels at most. Missing values are left out of the likelihood. Starts
    from agreement being likelier, the higher the level, among matches.
    ``never``: a comparison and its level that no match has, so that its
    probability among matches is 0 and its pairs teach the non-match side.
    """
    m, u = [], []
    for k in levels:
        w = 4.0 ** np.arange(k)
        m.append(w / w.sum())
        u.append(w[::-1] / w.sum())

    def barred() -> None:
        if never is not None:
            m[never[0]][never[1] - 1] = 0.0
            m[never[0]] /= m[never[0]].sum()

    barred()
    share, counts = start_share, counts.astype(float)
    for _ in range(rounds):
        p = posterior(vectors, share, m, u)
        new = float((p * counts).sum() / max(counts.sum(), 1.0))
        for j, k in enumerate(levels):
            for probs, weight in ((m, p), (u, 1 - p)):
                seen = vectors[:, j] != MISSING
                sums = np.bincount(vectors[seen, j] - 1, weights=(weight * counts)[seen], minlength=k) + smooth
                probs[j] = sums / sums.sum()
        barred()
        if abs(new - share) < 1e-9:
            break
        share = min(max(new, 1e-6), 1 - 1e-6)
    return share, m, u


def posterior(vectors: np.ndarray, share: float, m: list[np.ndarray], u: list[np.ndarray]) -> np.ndarray:
    log = np.full(len(vectors), np.log(share / (1 - share)))
    with np.errstate(divide="ignore"):
        for j in range(vectors.shape[1] if len(vectors) else 0):
            seen = vectors[:, j] != MISSING
            at = vectors[seen, j] - 1
            log[seen] += np.log(m[j][at]) - np.log(u[j][at])
    return np.where(np.isneginf(log), 0.0, 1 / (1 + np.exp(-np.clip(log, -700, 700))))


def candidate_pairs(left: DataFrame, right: DataFrame, passes: Sequence[tuple[Column, Column]], near: DataFrame | None = None, crowd: int = 200) -> DataFrame:
    """Distinct (l, r) of rows that share a blocking key in any pass; each pass gives an array of keys on either side.

    The keys of all passes lie in one table a side, so there is one join. A key
    that more than ``crowd`` rows of the right table share is dealt into parts
    of about ``crowd`` rows, and its left rows go to each part: all pairs are
    found at every size, and no task has the whole key.
    """
    named = lambda keys, i: F.transform(F.array_distinct(keys), lambda k: F.struct(F.lit(i).alias("pass"), k.alias("k")))
    every = lambda side: F.flatten(F.array(*(named(p[side], i) for i, p in enumerate(passes))))
    keys_l = left.select("l", F.inline(every(0)))
    keys_r = right.select("r", F.inline(every(1)))
    crowded = keys_r.groupBy("pass", "k").count().where(F.col("count") > crowd).select("pass", "k", F.ceil(F.col("count") / F.lit(crowd)).cast("int").alias("parts"))
    one = F.coalesce(F.col("parts"), F.lit(1))
    keys_l = keys_l.join(crowded, ["pass", "k"], "left").select("l", "pass", "k", F.explode(F.sequence(F.lit(0), one - 1)).alias("part"))
    keys_r = keys_r.join(crowded, ["pass", "k"], "left").select("r", "pass", "k", F.pmod(F.xxhash64("r"), one).cast("int").alias("part"))
    found = keys_l.join(keys_r, ["pass", "k", "part"]).select("l", "r")
    if near is not None:
        found = found.unionByName(near.select("l", "r"))
    return found.distinct()


def score(pairs: DataFrame, comparisons: dict[str, tuple[Column, int]], never: tuple[str, int] | None = None, split: Sequence[str] = ()) -> DataFrame:
    """``pairs`` with the level of each comparison and ``confidence``.

    ``comparisons``: name to (level, number of levels besides 0). ``never``: a
    comparison and the level of it that no match has. ``split``: comparisons without which pairs are of another
    kind; where all of them are missing, the pairs came by other passes and have
    a model of their own. The confidence is the posterior throughout. The pairs with
    their levels are written to the shared folder once; the vectors' counts are
    the only thing that comes to the driver.
    """
    names = list(comparisons)
    levels = [k for _, k in comparisons.values()]
    levelled = cut(pairs.withColumns({f"level_{n}": F.coalesce(c, F.lit(0)).cast("int") for n, (c, _) in comparisons.items()}))
    cols = [f"level_{n}" for n in names]
    rows = levelled.groupBy(*cols).count().collect()
    vectors = np.array([[r[c] for c in cols] for r in rows], int).reshape(len(rows), len(cols))
    counts = np.array([r["count"] for r in rows], float)
    barred = (names.index(never[0]), never[1]) if never else None
    apart = (vectors[:, [names.index(n) for n in split]] == MISSING).all(axis=1) if split and len(rows) else np.zeros(len(rows), bool)
    p = np.zeros(len(rows))
    for kind in (apart, ~apart):
        if kind.any():
            share, m, u = fit(vectors[kind], counts[kind], levels, never=barred)
            p[kind] = posterior(vectors[kind], share, m, u)
    spark = pairs.sparkSession
    table = spark.createDataFrame([(*map(int, v), float(x)) for v, x in zip(vectors, p)], ", ".join(f"{c} int" for c in cols) + ", confidence double")
    return levelled.join(F.broadcast(table), cols)


def best_partner(scored: DataFrame, least: float, tie: Sequence[Column]) -> DataFrame:
    """The most confident pair of each left row, from ``least`` on; ties by ``tie``, then the right id."""
    rank = F.struct((-F.col("confidence")).alias("c"), *(t.alias(f"t{i}") for i, t in enumerate(tie)), F.col("r"))
    rest = [c for c in scored.columns if c != "l"]
    best = scored.where(F.col("confidence") >= least).groupBy("l").agg(F.min_by(F.struct(*rest), rank).alias("b"))
    return best.select("l", "b.*")


def near_text(a: Column, b: Column) -> Column:
    """Equal but for one typing error: a letter more, less or changed, or two neighbours swapped."""
    d = F.levenshtein(a, b)
    swapped = (d == 2) & (F.length(a) == F.length(b)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return (d <= 1) | swapped


def deletions(text: Column) -> Column:
    """The text and all texts with one letter less: two texts with one typing error between them share one."""
    n = F.length(text)
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, n)))
    return F.when(n > 0, F.concat(F.array(text), cuts)).otherwise(F.array().cast("array<string>"))
