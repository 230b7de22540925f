"""Scales and fields of view, and outlines on the tangent plane."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions.sphere import deproject


def pixel_scale(pixel_um: Column, focal_mm: Column, binning: Column | None = None) -> Column:
    """Arcsec a pixel; null unless both are positive."""
    b = F.lit(1) if binning is None else F.coalesce(binning, F.lit(1))
    return F.when((pixel_um > 0) & (focal_mm > 0), 206.265 * pixel_um * b / focal_mm)


def field_arcmin(pixels: Column, scale: Column) -> Column:
    return F.round(pixels * scale / 60.0, 2)


def field_pairing(n1: Column, n2: Column, solved1: Column, solved2: Column, solved_scale: Column, focal_scale: Column, most: float = 1.5) -> Column:
    """The grid and the scale that belong together: struct n1, n2, scale, method.

    The scale of a solution goes with the grid that was solved, the focal scale
    with the native one. Where the two fields differ by more than the ratio the
    focal one is right, as a solution of another image may linger in a header.
    """
    g1, g2 = F.coalesce(solved1, n1), F.coalesce(solved2, n2)
    wcs, focal = g1 * solved_scale, n1 * focal_scale
    far = F.greatest(wcs, focal) / F.nullif(F.least(wcs, focal), F.lit(0.0)) > most
    pick = lambda a, b, s, m: F.struct(a.alias("n1"), b.alias("n2"), s.alias("scale"), F.lit(m).alias("method"))
    none = F.lit(None).cast("double")
    return (
        F.when((wcs > 0) & (focal > 0) & far, pick(n1, n2, focal_scale, "focal"))
        .when(wcs > 0, pick(g1, g2, solved_scale, "wcs"))
        .when(focal > 0, pick(n1, n2, focal_scale, "focal"))
        .otherwise(pick(n1, n2, none, "none"))
    )


def view_radius(w_deg: Column, h_deg: Column, most: float = 15.0) -> Column:
    """Radius of the cone round a view: half its diagonal; null for views that are too wide."""
    r = F.sqrt(w_deg * w_deg + h_deg * h_deg) / 2
    return F.when(r <= most, r)


def least_size_arcmin(scale_arcsec: Column, least_px: Column) -> Column:
    return least_px * scale_arcsec / 60.0


def outline(ra: Column, dec: Column, major_arcmin: Column, minor_arcmin: Column, angle_deg: Column, points: int = 48) -> Column:
    """Points of an ellipse on the sky; its long side at a position angle from north towards east. Unknown minor sizes are round."""
    a, b, t = major_arcmin / 120.0, F.coalesce(minor_arcmin, major_arcmin) / 120.0, F.radians(F.coalesce(angle_deg, F.lit(0.0)))

    def at(k: Column) -> Column:
        p = k * (2 * math.pi / points)
        u, v = a * F.cos(p), b * F.sin(p)
        return deproject(ra, dec, u * F.sin(t) + v * F.cos(t), u * F.cos(t) - v * F.sin(t))

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)
