import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import healpix as H
from lumenfold.operators import coverage as C
from lumenfold.operators import search as Q


@pytest.mark.parametrize("depth", [0, 1, 3, 6])
def test_cells_round_trip(depth):
    cells = np.arange(H.n_cells(depth)) if depth < 6 else np.random.default_rng(0).integers(0, H.n_cells(depth), 5000)
    ra, dec = H.centre_of(cells, depth)
    assert (H.cell_of(ra, dec, depth) == cells).all()
    if depth:
        # the parent's cell holds its children's centres
        assert (H.cell_of(ra, dec, depth - 1) == cells >> 2).all()


def test_cells_have_equal_areas():
    rng = np.random.default_rng(1)
    z, ra = rng.uniform(-1, 1, 400_000), rng.uniform(-720, 720, 400_000)
    n = np.bincount(H.cell_of(ra, np.degrees(np.arcsin(z)), 1), minlength=48)
    assert abs(n / n.mean() - 1).max() < 0.05
    assert H.cell_of(np.array([0.0, 359.9999, 10.0]), np.array([90.0, -90.0, 0.0]), 5).max() < H.n_cells(5)


@pytest.mark.parametrize("centre", [(0.0, 0.0), (359.9, 45.0), (10.0, 89.5), (200.0, -90.0)])
def test_polygon_area(centre):
    ra, dec = np.radians(centre[0]), np.radians(centre[1])
    m = np.array([np.cos(dec) * np.cos(ra), np.cos(dec) * np.sin(ra), np.sin(dec)])
    e = np.array([-np.sin(ra), np.cos(ra), 0.0])
    n = np.cross(m, e)
    half = np.radians(1.0)
    corners = np.array([m + x * half * e + y * half * n for x, y in ((-1, -1), (1, 1), (1, -1), (-1, 1))])
    corners /= np.linalg.norm(corners, axis=1)[:, None]
    cells = H.cells_in_polygon(np.degrees(np.arctan2(corners[:, 1], corners[:, 0])), np.degrees(np.arcsin(corners[:, 2])), 9)
    area = len(cells) * 4 * np.pi / H.n_cells(9) * np.degrees(1) ** 2
    assert area == pytest.approx(4.0, rel=0.05) and len(set(cells)) == len(cells)


@pytest.mark.parametrize("centre", [(0.0, 0.0), (359.9, 45.0), (10.0, 89.5), (200.0, -80.0)])
def test_footprint_without_a_centre_keeps_its_cells(centre):
    # a small box round a corner of cells, where no centre lies
    depth, half = 8, 0.02
    cell = H.cell_of(np.array([centre[0]]), np.array([centre[1]]), depth)
    ra, dec = H.centre_of(cell, depth)
    ra, dec = ra[0], dec[0] + 0.08
    wide = half / np.cos(np.radians(dec))
    got = set(H.cells_in_polygon(np.array([ra - wide, ra + wide, ra + wide, ra - wide]), np.array([dec - half, dec - half, dec + half, dec + half]), depth))
    rng = np.random.default_rng(0)
    under = set(H.cell_of(ra + rng.uniform(-wide, wide, 20_000), dec + rng.uniform(-half, half, 20_000), depth))
    assert got and under <= got


def test_registered_depth_is_the_references():
    from lumenfold.plans import library

    assert library.DEPTH == 10


def cells(spark, xs):
    return spark.createDataFrame([(int(x),) for x in xs], "cell bigint")


def test_set_algebra(spark):
    a, b = cells(spark, [1, 2, 2, 3]), cells(spark, [2, 9])
    got = lambda df: sorted(r["cell"] for r in df.collect())
    assert got(C.gap_cells(a, b)) == [1, 3]
    assert got(C.gap_cells(a, cells(spark, []))) == [1, 2, 3] and got(C.gap_cells(cells(spark, []), b)) == []
    whole = cells(spark, [*range(16), 20])
    norm = sorted((r["depth"], r["cell"]) for r in C.normalised(whole, 2).collect())
    assert norm == [(0, 0), (2, 20)]
    assert sum(4 ** (2 - d) for d, _ in norm) == 17


def test_points_in_cells(spark):
    pts = spark.createDataFrame([(1, 10.0, 10.0), (2, None, 1.0), (3, 200.0, -5.0)], "id int, ra_deg double, dec_deg double")
    at = int(H.cell_of(np.array([10.0]), np.array([10.0]), 10)[0])
    assert [r["id"] for r in C.points_in_cells(pts, cells(spark, [at])).collect()] == [1]


def test_search_language(spark):
    schema = "id int, objects array<string>, telescopes array<string>, cameras array<string>, filters map<string,struct<total_hours:double>>, fov_arcmin array<double>"
    rows = [
        (1, ["NGC 7000", "North America"], ["RedCat"], ["268M"], {"Ha": (5.0,), "SII": (0.0,)}, [90.0, 60.0]),
        (2, None, None, None, None, None),
        (3, ["Veil"], ["Newton 200"], ["ASI"], {"Ha": (1.0,), "OIII": (20.0,)}, [30.0]),
    ]
    df = spark.createDataFrame(rows, schema)
    found = lambda q: [r["id"] for r in df.where(Q.target_matches(q)).orderBy("id").collect()]
    assert found("") == found(None) == [1, 2, 3]
    assert found("veil") == [3] and found("-veil") == [1, 2] and found('"north america"') == [1]
    assert found("filter:sii") == [] and found("filter:HA") == [1, 3] and found("tel:newton cam:asi") == [3]
    assert found("hours>5") == [3] and found("hours<1") == [2] and found("fov>60") == [1] and found("-fov>60") == [2, 3]
    assert found("class:x") == [1, 2, 3] and found("hours>x") == [] and found('name:"ngc 7000"') == [1]
    keys = [r[0] for r in spark.createDataFrame([("M 101",), ("M 9",), ("m 33",)], "n string").orderBy(Q.natural_key(F.col("n"))).collect()]
    assert keys == ["M 9", "m 33", "M 101"]


def test_targets_by_name_sorts_all_names(spark, tmp_path):
    import re

    from lumenfold.plans.library import targets_by_name

    rnd = np.random.default_rng(3)
    names = [f"{rnd.choice(['ABC', 'abc', 'Pale_Gate', 'x-y'])} {rnd.integers(0, 300)}{rnd.choice(['', ' panel 2', ' panel 10'])}" for _ in range(230)] + ["Quiet Gate", None, ""]
    rows = [(i, [n]) for i, n in enumerate(names)] + [(900, None), (901, [])]
    spark.createDataFrame(rows, "target_id bigint, objects array<string>").write.parquet(str(tmp_path / "library_target.parquet"))
    natural = lambda n: [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.findall(r"\d+|\D+", (n or "").lower())]
    want = sorted(range(len(names)), key=lambda i: (natural(names[i]), i))
    got = sorted((r["place"], r["target_id"]) for r in targets_by_name(spark, str(tmp_path)).collect())
    assert got == list(enumerate(want, 1))


def test_natural_key_of_long_numbers(spark):
    names = ["m 0", "m 007", "m 12", "m 1000000000001", "m 1000000000002", "m 10000000000010", "m 20000000000001"]
    df = spark.createDataFrame([(n,) for n in reversed(names)], "n string")
    assert [r[0] for r in df.orderBy(Q.natural_key(F.col("n")), "n").collect()] == names
    assert df.select(Q.natural_key(F.col("n"))).distinct().count() == len(names)


def test_band_shares_hold_bitmaps_not_cells(spark, monkeypatch):
    """Cells are never rows: hundreds of fields over one place come back as a few bitmaps; a cell counts once a band."""
    monkeypatch.setattr(C, "HELD", 3)
    rng = np.random.default_rng(3)
    rows, bands, want = [], [], {}
    for i in range(300):
        ra, dec = float(200.0 + rng.uniform(-1, 1)), float(rng.choice([88.5, -30.0]) + rng.uniform(-1, 1))
        corners = [[ra + x / np.cos(np.radians(dec)), dec + y] for x, y in ((-0.3, -0.2), (0.3, -0.2), (0.3, 0.2), (-0.3, 0.2))]
        own = [b for b in ("Ha", "OIII", "L") if rng.random() < 0.4]
        rows.append((i // 2, ra, dec, None, 0.0, [[float(x) for x in c] for c in corners]))  # two footprints a target
        bands += [(i // 2, b) for b in own]
    rows.append((9999, None, None, None, None, None))
    bands += [(9999, "Ha"), (None, "L"), (7777, "SII")]
    lib = spark.createDataFrame(rows, "target_id int, center_ra_deg double, center_dec_deg double, footprint_arcmin array<double>, rotation_deg double, corners_icrs array<array<double>>")
    of = spark.createDataFrame(bands, "target_id int, band string")
    for t, _, _, _, _, c in rows[:-1]:
        cells = set(H.cells_in_polygon(*np.array(c).T, 8).tolist())
        for b in {b for k, b in bands if k == t}:
            want.setdefault(b, set()).update(cells)
    got = {r["band"]: r["share"] for r in C.band_shares(lib, of, 8).collect()}
    assert got == {b: len(c) / H.n_cells(8) for b, c in want.items()}


def test_coverage_share_sends_no_cells(spark):
    from lumenfold.plans import library

    src = "/root/testdata/sf0.001"
    df = library.coverage_share(spark, src)
    lib = library._library(spark, src)
    cells = C.footprint_cells(lib, library.DEPTH).join(lib.select("target_id", F.explode("filters").alias("band", "f")).where("f.total_hours > 0"), "target_id")
    want = {r["band"]: r["share"] for r in cells.groupBy("band").agg(C.sky_share(cells, library.DEPTH).alias("share")).collect()}
    assert {r["band"]: r["share"] for r in df.collect()} == want and want
    assert "explode(cell" not in df._jdf.queryExecution().toString() and df._jdf.queryExecution().toString().count("BroadcastExchange") == 0
