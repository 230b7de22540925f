"""Coverage as sets of equal-area cells: union, difference, shares of the sky, points in an area."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import healpix as H
from lumenfold.functions import sphere as S

#: Cells of one bitmap, the size of Spark's bitmap functions, and how many bitmaps a task holds (4 KB each) before it hands them on.
BUCKET, HELD = 8 * 4096, 8192


def cell_column(ra: Column, dec: Column, depth: int) -> Column:
    """Cell of a position; null without one."""

    @F.pandas_udf("bigint")
    def cell(a: pd.Series, d: pd.Series) -> pd.Series:
        ok = a.notna() & d.notna()
        out = pd.array([pd.NA] * len(a), dtype="Int64")
        if ok.any():
            out[ok.to_numpy()] = H.cell_of(a[ok].to_numpy(), d[ok].to_numpy(), depth)
        return pd.Series(out)

    return cell(ra, dec)


def corner_arrays(targets: DataFrame) -> DataFrame:
    """target_id with arrays ra and dec of the footprint's corners; targets without one drop out."""
    given = F.col("corners_icrs")
    size = F.col("footprint_arcmin")
    box = S.tangent_rectangle(F.col("center_ra_deg"), F.col("center_dec_deg"), F.try_element_at(size, F.lit(1)), F.try_element_at(size, F.lit(2)), F.coalesce("rotation_deg", F.lit(0.0)))
    df = targets.withColumn("__box", F.when(given.isNull() & size.isNotNull(), box))
    df = df.where("corners_icrs is not null or __box is not null")
    ra = F.coalesce(F.transform(given, lambda c: c[0]), F.transform("__box", lambda c: c["ra"]))
    dec = F.coalesce(F.transform(given, lambda c: c[1]), F.transform("__box", lambda c: c["dec"]))
    return df.withColumns({"__ra": ra, "__dec": dec}).drop("__box")


def footprint_cells(targets: DataFrame, depth: int = 10, keep: tuple[str, ...] = ("target_id",)) -> DataFrame:
    """One row a footprint and cell whose centre it holds, or that it meets if it holds no centre.

    A cell on the edge belongs to the footprint that holds its centre, so areas
    differ from the true ones by the edge cells only, and no footprint vanishes.
    """

    @F.pandas_udf("array<bigint>")
    def cells(ra: pd.Series, dec: pd.Series) -> pd.Series:
        return pd.Series([H.cells_in_polygon(np.array(a, float), np.array(d, float), depth) for a, d in zip(ra, dec)])

    df = corner_arrays(targets)
    return df.select(*keep, F.explode(cells("__ra", "__dec")).alias("cell"))


def gap_cells(have: DataFrame, missing: DataFrame) -> DataFrame:
    """Cells of ``have`` that aren't in ``missing``, each once."""
    return have.select("cell").distinct().join(missing.select("cell").distinct(), "cell", "left_anti")


def sky_share(cells: DataFrame, depth: int = 10) -> Column:
    return F.count_distinct("cell") / F.lit(float(H.n_cells(depth)))


def cell_bitmaps(footprints: DataFrame, depth: int = 10) -> DataFrame:
    """band, bucket and bits: the cells of each band's footprints (``bands``, ``__ra``, ``__dec``) as bitmaps.

    A task marks cells in place, so what it holds and sends follows the area of
    the sky and not the footprints; one bucket may come from several tasks.
    """

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}

        def taken() -> Iterator[pa.RecordBatch]:
            keys = list(held)
            for i in range(0, len(keys), 256):
                part = keys[i : i + 256]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in part], pa.string()), pa.array([k for _, k in part], pa.int64()), pa.array([held[k].tobytes() for k in part], pa.binary())], ["band", "bucket", "bits"])
            held.clear()

        for batch in batches:
            for bands, ra, dec in zip(*(batch.column(c).to_pylist() for c in ("bands", "__ra", "__dec"))):
                cells = H.cells_in_polygon(np.array(ra, float), np.array(dec, float), depth)  # sorted
                byte = cells >> 3
                first = np.flatnonzero(np.diff(byte, prepend=-1))
                byte, bits = byte[first], np.bitwise_or.reduceat(np.uint8(1) << (cells & 7).astype(np.uint8), first)
                for k in np.unique(byte // (BUCKET // 8)).tolist():
                    own = byte // (BUCKET // 8) == k
                    at, to = byte[own] % (BUCKET // 8), bits[own]
                    for band in bands:
                        if (band, k) not in held:
                            held[band, k] = np.zeros(BUCKET // 8, np.uint8)
                        held[band, k][at] |= to
                if len(held) > HELD:
                    yield from taken()
        yield from taken()

    return footprints.select("bands", "__ra", "__dec").mapInArrow(mark, "band string, bucket bigint, bits binary")


def band_shares(targets: DataFrame, bands: DataFrame, depth: int = 10) -> DataFrame:
    """Share of the sky that the footprints of each band cover (``bands``: target_id, band); a cell counts once."""
    # never broadcast: there is a row for every target
    rows = corner_arrays(targets).join(bands.groupBy("target_id").agg(F.collect_set("band").alias("bands")).hint("merge"), "target_id")
    whole = cell_bitmaps(rows, depth).groupBy("band", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return whole.groupBy("band").agg((F.sum(F.bitmap_count("bits")) / F.lit(float(H.n_cells(depth)))).alias("share"))


def parents(cells: DataFrame, levels: int = 1) -> DataFrame:
    """Cells rolled up: a parent with how many of its children are there; complete parents have ``4 ** levels``."""
    return cells.select(F.shiftright("cell", 2 * levels).alias("cell")).groupBy("cell").agg(F.count("*").alias("children"))


def normalised(cells: DataFrame, depth: int, coarsest: int = 0) -> DataFrame:
    """The same area as few cells as possible: four whole children become their parent. depth and cell."""
    now, out = cells.select("cell").distinct(), None
    for d in range(depth, coarsest, -1):
        up = parents(now).where("children = 4").select("cell")
        rest = now.withColumn("p", F.shiftright("cell", 2)).join(up.withColumnRenamed("cell", "p"), "p", "left_anti").select(F.lit(d).alias("depth"), "cell")
        out = rest if out is None else out.unionByName(rest)
        now = up
    last = now.select(F.lit(coarsest).alias("depth"), "cell")
    return last if out is None else out.unionByName(last)


def points_in_cells(points: DataFrame, cells: DataFrame, depth: int = 10) -> DataFrame:
    """Points (ra_deg, dec_deg) whose cell is in the area: a semi-join on the cell."""
    return points.withColumn("cell", cell_column(F.col("ra_deg"), F.col("dec_deg"), depth)).join(cells.select("cell").distinct(), "cell", "left_semi")
