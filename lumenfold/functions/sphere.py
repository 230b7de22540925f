"""Expressions on the sphere: unit vectors, separations, tangent planes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; the optimizer would else repeat it at every use."""
    return F.transform(F.array(value), body)[0]


def xyz(ra_deg: Column, dec_deg: Column) -> Column:
    """Unit vector of a position; any right ascension is taken modulo a turn. Null or NaN in, null out."""
    ok = ra_deg.isNotNull() & dec_deg.isNotNull() & ~F.isnan(ra_deg) & ~F.isnan(dec_deg)
    a, d = F.radians(ra_deg), F.radians(dec_deg)
    return F.when(ok, F.struct((F.cos(d) * F.cos(a)).alias("x"), (F.cos(d) * F.sin(a)).alias("y"), F.sin(d).alias("z")))


def vec(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def scaled(a: Column, k: Column) -> Column:
    return vec(a["x"] * k, a["y"] * k, a["z"] * k)


def plus(*vs: Column) -> Column:
    return vec(*(sum((v[c] for v in vs[1:]), vs[0][c]) for c in "xyz"))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    return scaled(a, F.lit(1.0) / norm(a))


def angle(a: Column, b: Column) -> Column:
    """Radians between two vectors; accurate at every distance."""
    return F.atan2(norm(cross(a, b)), dot(a, b))


def separation_deg(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle separation in degrees, in the arctangent form that is stable everywhere."""
    d1, d2, da = F.radians(dec1), F.radians(dec2), F.radians(ra2 - ra1)
    east = F.cos(d2) * F.sin(da)
    north = F.cos(d1) * F.sin(d2) - F.sin(d1) * F.cos(d2) * F.cos(da)
    return F.degrees(F.atan2(F.sqrt(east * east + north * north), F.sin(d1) * F.sin(d2) + F.cos(d1) * F.cos(d2) * F.cos(da)))


def gnomonic(ra0: Column, dec0: Column, ra: Column, dec: Column, floor: float = 1e-6) -> Column:
    """Position on the plane tangent at (ra0, dec0), degrees east and north; null beyond the horizon."""
    d0, d, da = F.radians(dec0), F.radians(dec), F.radians(ra - ra0)
    c = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(da)
    east = F.degrees(F.cos(d) * F.sin(da) / c)
    north = F.degrees((F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(da)) / c)
    return F.when(c > floor, F.struct(east.alias("east"), north.alias("north")))


def deproject(ra0: Column, dec0: Column, east_deg: Column, north_deg: Column) -> Column:
    """Inverse of :func:`gnomonic`: struct of ra (0 to 360) and dec in degrees."""
    e, n, d0 = F.radians(east_deg), F.radians(north_deg), F.radians(dec0)
    down = F.cos(d0) - n * F.sin(d0)
    ra = ra0 + F.degrees(F.atan2(e, down))
    dec = F.degrees(F.atan2(F.sin(d0) + n * F.cos(d0), F.sqrt(e * e + down * down)))
    return F.struct(F.pmod(ra, F.lit(360.0)).alias("ra"), dec.alias("dec"))


def tangent_rectangle(ra0: Column, dec0: Column, w_arcmin: Column, h_arcmin: Column, rotation_deg: Column) -> Column:
    """Corners of a rectangle on the tangent plane, in order round it, its up side turned from north towards east."""
    r = F.radians(rotation_deg)

    def corner(sx: int, sy: int) -> Column:
        x, y = w_arcmin * (sx / 120.0), h_arcmin * (sy / 120.0)
        return deproject(ra0, dec0, x * F.cos(r) + y * F.sin(r), y * F.cos(r) - x * F.sin(r))

    return F.array(*(corner(sx, sy) for sx, sy in ((-1, -1), (-1, 1), (1, 1), (1, -1))))


def galactic(ra_deg: Column, dec_deg: Column) -> Column:
    """ICRS to galactic longitude and latitude in degrees, by the fixed rotation."""
    v = xyz(ra_deg, dec_deg)
    # fixed values: rows of the ICRS to galactic rotation
    rows = (
        (-0.0548755604162154, -0.8734370902348850, -0.4838350155487132),
        (0.4941094278755837, -0.4448296299600112, 0.7469822444972189),
        (-0.8676661490190047, -0.1980763734312015, 0.4559837761750669),
    )
    x, y, z = (v["x"] * r[0] + v["y"] * r[1] + v["z"] * r[2] for r in rows)
    lon = F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))
    return F.struct(lon.alias("l"), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z)))).alias("b"))


TURN = 2 * math.pi
