"""Rules that go through a small group in order: rotations, grids, dithers, and merged catalogues."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import sphere as S
from lumenfold.operators.graph import ordered_clusters
from lumenfold.operators.rank import dense_ids
from lumenfold.operators.sky import sky_join

ROTATION_TOLERANCE = 3.0


def circular_median(df: DataFrame, by: list[str], angle: str) -> DataFrame:
    """Median angle per group: angles are unwrapped about their mean direction first, so the seam does no harm."""
    r = F.radians(angle)
    mean = df.where(F.col(angle).isNotNull()).groupBy(*by).agg(F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r)))).alias("__mean"))
    off = F.pmod(F.col(angle) - F.col("__mean") + 180.0, F.lit(360.0)) - 180.0
    med = df.where(F.col(angle).isNotNull()).join(mean, by).groupBy(*by).agg(F.first("__mean").alias("__mean"), F.median(off).alias("__off"))
    return med.select(*by, F.pmod(F.col("__mean") + F.col("__off"), F.lit(360.0)).alias("median_deg"))


def _apart(a: np.ndarray, b: float) -> np.ndarray:
    d = np.abs(a - b) % 180.0
    return np.minimum(d, 180.0 - d)


def rotation_groups(angles: np.ndarray, hours: np.ndarray, masters: np.ndarray, tolerance: float = ROTATION_TOLERANCE) -> list[tuple[float, float, int]]:
    """Groups of angles modulo a half turn, the heaviest first: mean angle, hours, masters.

    Each round takes the angles within the tolerance of one of them that hold
    most hours; ties go to more masters, then to the smaller angle.
    """
    left = np.ones(len(angles), bool)
    out = []
    while left.any():
        best, chosen = None, None
        for a in angles[left]:
            inside = left & (_apart(angles, a) <= tolerance)
            key = (hours[inside].sum(), masters[inside].sum(), -a)
            if best is None or key > best:
                best, chosen = key, inside
        w = hours[chosen] if hours[chosen].sum() else masters[chosen].astype(float)
        t = np.radians(2 * angles[chosen])
        mean = math.degrees(math.atan2((w * np.sin(t)).sum(), (w * np.cos(t)).sum())) / 2 % 180.0
        out.append((round(mean, 2) % 180.0, float(hours[chosen].sum()), int(masters[chosen].sum())))
        left &= ~chosen
    return out


def rotations(df: DataFrame, by: str, kind: str) -> DataFrame:
    """The chosen rotation of each group, its hours and how many other groups there are.

    ``df``: by, rotation_deg, hours. Angles are first summed by hundredths of a
    degree on the map side, so a group holds at most 18,000 rows whatever its size.
    """
    fold = F.round(F.pmod(F.col("rotation_deg"), F.lit(180.0)), 2)
    bins = df.where("rotation_deg is not null").groupBy(by, F.when(fold >= 180.0, 0.0).otherwise(fold).alias("angle")).agg(F.sum(F.coalesce("hours", F.lit(0.0))).alias("hours"), F.count("*").alias("masters"))

    def choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("angle")
        g = rotation_groups(pdf["angle"].to_numpy(), pdf["hours"].to_numpy(), pdf["masters"].to_numpy())
        return pd.DataFrame([(key[0], g[0][0], g[0][1], g[0][2], len(g) - 1)], columns=[by, "rotation_deg", "hours", "masters", "others"])

    return bins.groupBy(by).applyInPandas(choose, f"{by} {kind}, rotation_deg double, hours double, masters bigint, others int")


def grid_of(ra_deg: np.ndarray, dec_deg: np.ndarray, rotation_deg: float, tolerance_arcmin: float = 2.0) -> tuple[int, int, np.ndarray] | None:
    """Rows, columns and (row, col) of points on a regular grid, row 1 north and column 1 west; None if they form none."""
    if len(ra_deg) < 2:
        return None
    tol, r = tolerance_arcmin / 60.0, math.radians(rotation_deg or 0.0)
    east = (ra_deg - ra_deg.mean()) * max(1e-6, math.cos(math.radians(dec_deg.mean())))
    north = dec_deg - dec_deg.mean()
    x, y = east * math.cos(r) - north * math.sin(r), east * math.sin(r) + north * math.cos(r)
    order = np.argsort(-y, kind="stable")
    rows: list[list[int]] = []
    anchors: list[float] = []
    for i in order:
        if anchors and abs(anchors[-1] - y[i]) < tol:
            rows[-1].append(int(i))
        else:
            anchors.append(float(y[i]))
            rows.append([int(i)])
    if len({len(row) for row in rows}) != 1:
        return None
    even = lambda steps: len(steps) == 0 or max(steps) - min(steps) <= tol
    if not even(np.abs(np.diff(anchors))):
        return None
    place = np.zeros((len(ra_deg), 2), int)
    for i, row in enumerate(rows, 1):
        row.sort(key=lambda k: x[k])
        if not even(np.diff(x[row])):
            return None
        for j, k in enumerate(row, 1):
            place[k] = i, j
    return len(rows), len(rows[0]), place


def dithers(steps: list[str], every: int) -> list[str]:
    """A list of filters with ``dither`` put in where any filter comes the (every + 1)th time since the last one; the list is a circle."""
    if every <= 0 or not steps:
        return list(steps)
    out: list[str] = []
    seen: dict[str, int] = {}
    for i, s in enumerate([*steps, steps[0]]):
        if seen.get(s, 0) == every:
            out.append("dither")
            seen = {}
        seen[s] = seen.get(s, 0) + 1
        if i < len(steps):
            out.append(s)
    return out


def dithered(steps: Column, every: int) -> Column:
    @F.pandas_udf("array<string>")
    def put(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else dithers(list(x), every))

    return put(steps)


def merged_catalogue(objects: DataFrame) -> DataFrame:
    """id and the id of the object it merges into: itself if it stays.

    ``objects``: id, family, ra_deg, dec_deg, major (arcmin or null). The largest
    first, unknown sizes last, then by id: an object joins the first kept one of
    its family that reaches it (a fifth of its size, between 1 and 30 arcmin) and
    isn't more than four times as large. The same as going through them in order.
    """
    placed = objects.where("ra_deg is not null and dec_deg is not null").select("id", "family", "major", S.xyz(F.col("ra_deg"), F.col("dec_deg")).alias("v"))
    ranked = dense_ids(placed, [F.col("major").desc_nulls_last(), F.col("id").asc()], "n")
    a = ranked.select(F.col("n").alias("low"), F.col("family").alias("fa"), F.col("major").alias("ma"), F.col("v").alias("__c"))
    b = ranked.select(F.col("n").alias("high"), F.col("family").alias("fb"), F.col("major").alias("mb"), F.col("v").alias("__v"))
    reach = F.least(F.lit(30.0), F.greatest(F.lit(1.0), F.coalesce("ma", F.lit(0.0)) * 0.2)) / 60.0
    near = sky_join(b, a, reach).where(F.col("low") < F.col("high")).where(F.col("fa").eqNullSafe(F.col("fb")) & ~F.coalesce(F.col("ma") > F.col("mb") * 4, F.lit(False)))
    seeds = ordered_clusters(ranked.select(F.col("n").alias("node")), near.select(F.col("low").alias("a"), F.col("high").alias("b")))
    ids = ranked.select("id", "n")
    return seeds.join(ids.withColumnRenamed("n", "node"), "node").join(ids.select(F.col("id").alias("into"), F.col("n").alias("seed")), "seed").select("id", "into")
