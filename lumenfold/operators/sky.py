"""Points near points and inside regions, over the whole sphere.

Positions become unit vectors and are hashed to cubes of a grid in space. A
cube's side is at least the search radius, so a ball meets few cubes; there is
no seam and no pole. Candidates that share a cube are verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions import sphere as S
from lumenfold.session import cut

#: Level k has cubes with a side of 2 / 2**k; level 20 is 0.4 arcsec.
FINEST = 20


def _level(radius: Column) -> Column:
    """The finest level whose cubes are no smaller than the radius (a chord)."""
    return F.greatest(F.lit(0), F.least(F.lit(FINEST), F.floor(F.log2(2.0 / F.greatest(radius, F.lit(1e-9)))))).cast("int")


def _cell(i: Column, j: Column, k: Column) -> Column:
    """Three indices of up to 2**20 as one number."""
    part = lambda c, by: F.shiftleft(c.cast("bigint"), by)
    return part(i, 42).bitwiseOR(part(j, 21)).bitwiseOR(k.cast("bigint"))


def _index(v: Column, level: Column) -> Column:
    """Index of a coordinate, from 0 on; kept within the grid."""
    n = F.pow(F.lit(2.0), level)
    return F.greatest(F.lit(0.0), F.least(n, F.floor((v + 1.0) * n / 2.0))).cast("int")


def point_cells(v: Column, levels: list[int]) -> Column:
    """Array of level and cell that hold a unit vector, one for each level."""
    return F.array(*(F.struct(F.lit(n).alias("__level"), _cell(*(_index(v[c], F.lit(n)) for c in "xyz")).alias("__cell")) for n in levels))


def cells_of_balls(v: np.ndarray, radius: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of its ``level`` that each ball round a unit vector meets, and the ball of each; at most three a side, as a side is no shorter than the radius."""
    n = np.exp2(level)[:, None]
    index = lambda x: np.clip(np.floor((x + 1.0) * n / 2.0), 0, n).astype(np.int64)
    low, high = index(v - radius[:, None]), index(v + radius[:, None])
    side = 2.0 / n
    at = low[:, :, None] + np.arange(3)  # ball, axis, place
    start = at * side[:, :, None] - 1.0
    gap = np.maximum(np.maximum(start - v[:, :, None], v[:, :, None] - start - side[:, :, None]), 0.0) ** 2
    gap = np.where(at <= high[:, :, None], gap, np.inf)
    far = gap[:, 0, :, None, None] + gap[:, 1, None, :, None] + gap[:, 2, None, None, :]
    ball, i, j, k = np.nonzero(far <= (radius * radius * (1 + 1e-9) + 1e-15)[:, None, None, None])
    return ball, (at[ball, 0, i] << 42) | (at[ball, 1, j] << 21) | at[ball, 2, k]


def with_cells(balls: DataFrame, centre: str) -> DataFrame:
    """``balls`` (with __chord and __level) once for each cell that they meet, as ``__cell``."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column(b.schema.get_field_index(centre))
            v = np.stack([c.field(x).to_numpy(zero_copy_only=False) for x in range(3)], 1)
            get = lambda name: b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
            ball, cell = cells_of_balls(v, get("__chord"), get("__level"))
            rows = b.take(pa.array(ball))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell)], names=[*b.schema.names, "__cell"])

    return balls.mapInArrow(spread, T.StructType([*balls.schema.fields, T.StructField("__cell", T.LongType())]))


def chord(radius_rad: Column) -> Column:
    return 2.0 * F.sin(F.least(radius_rad, F.lit(math.pi)) / 2.0)


def _levels(balls: DataFrame) -> list[int]:
    """The levels in use: at most 21 small numbers."""
    return sorted(r[0] for r in balls.select("__level").distinct().collect())


def sky_join(points: DataFrame, centres: DataFrame, radius_deg: Column | float, point: str = "__v", centre: str = "__c") -> DataFrame:
    """All pairs of a point and a centre no further apart than the centre's radius.

    ``points`` has its unit vector in column ``point`` (see :func:`sphere.xyz`),
    ``centres`` in ``centre``; the other columns must have other names. Rows
    without a position are in no pair; a radius that is null or negative finds
    nothing. Adds ``sep_deg``. A crowded cell is a skewed join key, which
    adaptive execution splits, as it does a cell with many centres.
    """
    constant = isinstance(radius_deg, int | float)
    radius = F.radians(F.lit(radius_deg) if constant else radius_deg)
    balls = centres.withColumn("__rad", radius).where(F.col(centre).isNotNull() & (F.col("__rad") >= 0))
    balls = balls.withColumn("__chord", chord(F.col("__rad"))).withColumn("__level", _level(F.col("__chord")))
    # one radius has one level; the levels of many are looked up in their radii, which nothing else of the table is read for
    levels = _levels(balls.limit(1) if constant else balls) or [0]
    spots = points.where(F.col(point).isNotNull()).select("*", F.inline(point_cells(F.col(point), levels)))
    # a point lies in one cell of a level, so a pair meets once
    pairs = spots.join(with_cells(balls, centre), ["__level", "__cell"]).withColumn("__angle", S.angle(F.col(point), F.col(centre)))
    kept = pairs.where(F.col("__angle") <= F.col("__rad") + 1e-12)
    return kept.withColumn("sep_deg", F.degrees("__angle")).drop("__cell", "__rad", "__chord", "__level", "__angle")


def _sum(corners: Column) -> Column:
    return F.aggregate(corners, S.vec(F.lit(0.0), F.lit(0.0), F.lit(0.0)), lambda acc, c: S.plus(acc, c))


def footprint_normals(corners: Column, mean: Column) -> Column:
    """Inward normals of the great circles round a convex region with the given corners (array of unit vectors), in any order.

    The corners are sorted by angle round their ``mean`` direction first.
    """
    # any direction that isn't along the mean gives a basis
    helper = F.when(F.abs(mean["z"]) < 0.9, S.vec(F.lit(0.0), F.lit(0.0), F.lit(1.0))).otherwise(S.vec(F.lit(1.0), F.lit(0.0), F.lit(0.0)))

    def turned(east: Column) -> Column:
        return S.let(
            S.cross(mean, east),
            lambda north: F.array_sort(F.transform(corners, lambda c: F.struct(F.atan2(S.dot(c, north), S.dot(c, east)).alias("t"), c["x"].alias("x"), c["y"].alias("y"), c["z"].alias("z")))),
        )

    sides = lambda t: F.transform(t, lambda c, i: S.cross(c, F.element_at(t, (i + 1) % F.size(t) + 1)))
    return S.let(S.let(S.let(S.cross(helper, mean), S.unit), turned), sides)


def regions(targets: DataFrame, keep: list[str]) -> DataFrame:
    """Footprints as unit centre ``__c``, radius ``__reach`` in degrees and ``__normals``.

    The corners count if there are at least three, all with both coordinates;
    else the rectangle of ``footprint_arcmin`` on the plane tangent at the centre
    (rotation null is 0); a target with neither has no region.
    """
    given = F.col("corners_icrs")
    whole = F.coalesce(F.size(given) >= 3, F.lit(False)) & F.coalesce(F.forall(given, lambda c: (F.size(c) >= 2) & c[0].isNotNull() & c[1].isNotNull()), F.lit(False))
    size = F.col("footprint_arcmin")
    boxed = F.coalesce(F.size(size) >= 2, F.lit(False)) & size[0].isNotNull() & size[1].isNotNull() & F.col("center_ra_deg").isNotNull() & F.col("center_dec_deg").isNotNull()
    box = S.tangent_rectangle(F.col("center_ra_deg"), F.col("center_dec_deg"), size[0], size[1], F.coalesce(F.col("rotation_deg"), F.lit(0.0)))
    corners = F.when(whole, F.transform(given, lambda c: S.xyz(c[0], c[1]))).when(boxed, F.transform(box, lambda c: S.xyz(c["ra"], c["dec"])))
    df = targets.select(*keep, corners.alias("__corners")).where("__corners is not null")
    df = df.withColumn("__c", S.let(_sum(F.col("__corners")), S.unit))
    reach = F.array_max(F.transform("__corners", lambda c: S.angle(c, F.col("__c"))))
    return df.select(*keep, "__c", F.degrees(reach).alias("__reach"), footprint_normals(F.col("__corners"), F.col("__c")).alias("__normals"))


def points_in_regions(points: DataFrame, targets: DataFrame, point_id: str = "candidate_id", region_id: str = "target_id") -> DataFrame:
    """Pairs of a point and a footprint that holds it (the edge belongs to it).

    ``points`` needs ra_deg and dec_deg. Points without a position and targets
    without a footprint are in no pair. Ids that are repeated in a table give
    their pairs once. Other columns are ignored.
    """
    spots = points.select(F.col(point_id).alias("__p"), S.xyz(F.col("ra_deg"), F.col("dec_deg")).alias("__v"))
    # written once: the levels in use and the cells are both read from it
    fields = cut(regions(targets.withColumn("__r", F.col(region_id)), ["__r"]))
    near = sky_join(spots, fields, F.col("__reach"))
    inside = F.forall("__normals", lambda n: S.dot(n, F.col("__v")) >= 0)
    return near.where(inside).select(F.col("__p").alias(point_id), F.col("__r").alias(region_id)).distinct()
