import json
import math
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.sources import headers as H
from lumenfold.sources import tables as B


def card(key, value):
    text = f"'{value}'" if isinstance(value, str) else {True: "T", False: "F"}.get(value, repr(value)) if isinstance(value, bool) else repr(value)
    return f"{key:<8}= {text:>20}".ljust(80)


def fits(cards, history=(), pad=b"\0" * 2880):
    lines = [card("SIMPLE", True), card("BITPIX", 16)] + [card(k, v) for k, v in cards.items()] + [f"HISTORY {h}".ljust(80) for h in history] + ["END".ljust(80)]
    head = "".join(lines).encode()
    return head + b" " * (-len(head) % 2880) + pad


def xisf(keywords, geometry="100:80:1", prop=""):
    xml = '<xisf xmlns="http://www.pixinsight.com/xisf"><Image geometry="%s">%s%s</Image></xisf>' % (geometry, "".join(f'<FITSKeyword name="{k}" value="{v}" comment=""/>' for k, v in keywords.items()), prop)
    data = xml.encode()
    return b"XISF0100" + struct.pack("<II", len(data), 0) + data


SOLVED = {"NAXIS": 2, "NAXIS1": 100, "NAXIS2": 80, "CRVAL1": 359.99, "CRVAL2": 10.0, "CRPIX1": 51.0, "CRPIX2": 41.0, "CD1_1": -0.001, "CD1_2": 0.0, "CD2_1": 0.0, "CD2_2": 0.001}


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    root = tmp_path_factory.mktemp("a")
    light = {"NAXIS": 2, "NAXIS1": 100, "NAXIS2": 80, "EXPTIME": 300.0, "FILTER": "H-Alpha", "IMAGETYP": "LIGHT", "OBJECT": "M 31", "INSTRUME": "ZWO ASI2600MM Pro", "TELESCOP": "RedCat51", "OBJCTRA": "00 42 44", "OBJCTDEC": "+41 16 09", "FOCALLEN": 250.0, "XPIXSZ": 3.76}
    files = {
        "s1/Lights/a.fits": fits(light | {"DATE-OBS": "2024-01-02T03:04:05.123456"}), "s1/Lights/b.fit": fits(light | {"DATE-OBS": "2024-01-02T03:09:05.200"}), "s1/Lights/copy_of_b.FITS": fits(light | {"DATE-OBS": "2024-01-02T03:09:05.2000"}),
        "s1/Lights/a.xisf": xisf({"EXPTIME": "300", "FILTER": "'Ha'", "IMAGETYP": "'LIGHT'"}), "s1/flat_001.fits": fits({"NAXIS": 2, "NAXIS1": 10, "NAXIS2": 10, "IMAGETYP": "FLAT"}),
        "s1/master/masterLight_Ha.fits": fits(SOLVED | {"EXPTIME": 300.0, "FILTER": "Ha", "IMAGETYP": "Master Light"}, ["ImageIntegration.numberOfImages: 40", "numberOfImages = 59"]),
        "bad.fits": b"not a header" * 300, "empty.fts": b"", "s2/Light_NGC6960_180.0s.fit": fits({"NAXIS": 3, "NAXIS1": 10, "NAXIS2": 10, "NAXIS3": 3, "EXPOSURE": 180, "RA": 312.5, "DEC": 30.7, "IMAGETYP": "Light"}), "notes.txt": b"x",
    }
    for name, data in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return root


def scan(spark, archive):
    files = H.list_files(spark, f"file://{archive}")
    return files, {r["path"].rsplit("/", 1)[-1]: r for r in H.normalised(H.read_headers(files), files).collect()}


def test_headers(spark, archive):
    files, rows = scan(spark, archive)
    assert len(rows) == 8 and "notes.txt" not in rows and "empty.fts" not in rows
    a = rows["a.fits"]
    assert (a["filter"], a["exptime"], a["telescope"], a["camera"], a["role"]) == ("Ha", 300.0, "RedCat 51", "ASI2600MM Pro", "sub")
    assert a["date_obs_ms"] == "2024-01-02T03:04:05.123" and a["ra_deg"] == pytest.approx(10.6833, abs=1e-3) and a["dec_deg"] == pytest.approx(41.2692, abs=1e-3)
    assert a["pix_arcsec_focal"] == pytest.approx(206.265 * 3.76 / 250)
    m = rows["masterLight_Ha.fits"]
    assert (m["role"], m["ncombine"], m["has_wcs"], m["rotation_deg"]) == ("master", 59, True, 0.0)
    assert m["ra_deg"] == pytest.approx(359.99, abs=2e-3) and m["pix_arcsec"] == pytest.approx(3.6)
    assert rows["flat_001.fits"]["role"] == "calibration"
    n = rows["Light_NGC6960_180.0s.fit"]
    assert (n["object"], n["colour"], n["exptime"], n["ra_deg"], n["role"]) == ("NGC 6960", True, 180.0, 312.5, "sub")
    for bad in ("bad.fits",):
        assert rows[bad]["role"] == "unreadable" and rows[bad]["error"]


def test_prefilter(spark, archive):
    from lumenfold.functions.names import is_calibration_name

    files = H.list_files(spark, f"file://{archive}")
    assert [r["path"].rsplit("/", 1)[-1] for r in files.where(is_calibration_name(F.col("path"))).collect()] == ["flat_001.fits"]


def test_blocks_collapse_pairs_and_copies(spark, archive):
    files = H.list_files(spark, f"file://{archive}")
    blocks = H.folder_blocks(H.normalised(H.read_headers(files), files)).where(F.col("folder").endswith("Lights")).collect()
    assert len(blocks) == 1
    # a.fits stands for its pair, b.fit for its copy
    assert (blocks[0]["n_subs"], blocks[0]["instants"], blocks[0]["total_hours"]) == (2, 2, pytest.approx(600 / 3600))


def test_cache_reads_only_what_is_new(spark, archive, tmp_path):
    files = H.list_files(spark, f"file://{archive}").cache()
    first, cache = H.cached_headers(spark, files, None, "v1")
    cache.write.parquet(str(tmp_path / "c1"))
    # with the stored headers changed, a hit shows the change and a miss doesn't
    spark.read.parquet(str(tmp_path / "c1")).withColumn("object", F.lit("cached")).write.parquet(str(tmp_path / "c2"))
    again, _ = H.cached_headers(spark, files, str(tmp_path / "c2"), "v1")
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in again.collect()}
    assert rows["a.fits"]["object"] == "cached" and not rows["bad.fits"]["ok"] and len(rows) == first.count()
    other, _ = H.cached_headers(spark, files, str(tmp_path / "c2"), "v2")
    assert all(r["object"] != "cached" for r in other.collect())


def test_rotation_of_a_solution():
    for pa in (0.0, 30.0, 181.0, 359.5):
        r = math.radians(pa)
        c = SOLVED | {"CD1_1": -0.001 * math.cos(r), "CD1_2": 0.001 * math.sin(r), "CD2_1": 0.001 * math.sin(r), "CD2_2": 0.001 * math.cos(r)}
        got = H.solution(c, 100, 80)["rotation_deg"]
        assert min(abs(got - pa), 360 - abs(got - pa)) < 0.05


def test_manifest_and_shared_checks(spark, tmp_path):
    doc = {"schema": 2, "targets": [{"target_id": 1, "objects": ["A"], "center_ra_deg": 1.0, "center_dec_deg": 2.0, "telescopes": ["T 80mm"], "cameras": [], "filters": {"Ha": {"total_hours": 1.26, "files": 2}}}, {"target_id": 2}]}
    p = tmp_path / "m.json"
    p.write_text(json.dumps(doc))
    t = B.read_manifest(spark, str(p))
    assert t.count() == 2 and B.check_shared(t).count() == 2
    with pytest.raises(ValueError, match="path"):
        B.check_shared(t.withColumn("objects", F.array(F.lit("/home/me/x"))))
    with pytest.raises(ValueError, match="most"):
        B.check_shared(t, 1)
    row = B.sanitised(t, "s").orderBy("center_ra_deg").collect()[-1]
    assert row["filters"]["Ha"].asDict() == {"total_hours": 1.3, "files": 2} and row["target_id"].startswith("f_") and len(row["target_id"]) == 14
    assert row["telescopes"] == ["80mm telescope"] and "cameras" not in row.asDict()
    assert row["target_id"] != B.sanitised(t, "other").orderBy("center_ra_deg").collect()[-1]["target_id"]


def test_shared_figures_are_kept(spark):
    """All hours, the basis and the stale flag of a band leave the archive, the rigs don't; paths are hidden or stop it."""
    band = "struct<total_hours:double,captured_hours:double,accepted_hours:double,integrated_hours:double,files:int,headline_basis:string,stale_master:boolean,rigs:array<string>>"
    rows = [(1, ["M 1", "C:\\x", "a.fits", None], 10.0, 20.0, ["Newton 200"], {"Ha": (1.26, 2.0, None, 0.04, 3, "captured", None, ["r"])}), (2, None, None, None, None, None)]
    t = spark.createDataFrame(rows, f"target_id int, objects array<string>, center_ra_deg double, center_dec_deg double, telescopes array<string>, filters map<string,{band}>")
    one, two = B.sanitised(t, "s").orderBy(F.col("center_ra_deg").desc()).collect()
    assert one["filters"]["Ha"].asDict() == {"total_hours": 1.3, "captured_hours": 2.0, "accepted_hours": 0.0, "integrated_hours": 0.0, "files": 3, "headline_basis": "captured", "stale_master": False}
    assert one["objects"] == ["M 1", "unknown", "unknown", "unknown"] and one["telescopes"] == ["200mm reflector"] and two["filters"] is None
    bad = t.withColumn("filters", F.map_from_arrays(F.array(F.lit("/home/x")), F.map_values("filters"))).where("target_id = 1")
    with pytest.raises(Exception, match="path"):
        B.sanitised(bad, "s").collect()


def test_catalogue(spark, tmp_path):
    p = tmp_path / "c.tsv"
    p.write_text("# made\nName\tRA\tDE\nM 31\t00 42 44\t+41 16 09\nbad\tx\ty\nd\t10.5\t-5\n")
    cols = {"name": "Name", "ra": "RA", "dec": "DE"}
    got = {r["name"]: (r["ra_deg"], r["dec_deg"]) for r in B.read_catalogue(spark, str(p), "\t", cols, "c").collect()}
    assert got == {"M 31": (pytest.approx(10.68333, abs=1e-4), pytest.approx(41.26917, abs=1e-4)), "d": (10.5, -5.0)}
    assert [r["name"] for r in B.read_quarantine(spark, str(p), "\t", cols, "c").collect()] == ["bad"]
    back = spark.range(1).select(B.from_galactic(F.lit(121.17), F.lit(-21.57)).alias("p")).collect()[0]["p"]
    assert (back["ra"], back["dec"]) == (pytest.approx(10.68, abs=0.02), pytest.approx(41.27, abs=0.02))


def test_merge_conform_fan_out_and_atomic_write(spark, tmp_path):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    b = spark.createDataFrame([("x", 9, "n")], "k string, v int, w string")
    assert {(r["k"], r["v"]) for r in B.merge_catalogues([(0, a), (1, b)], "k").collect()} == {("x", 9), ("y", 2)}
    schema = T.StructType([T.StructField("K", T.StringType()), T.StructField("v", T.DoubleType()), T.StructField("z", T.IntegerType())])
    assert [tuple(r) for r in B.conform(a, schema, {"z": 7}).orderBy("K").collect()] == [("x", 1.0, 7), ("y", 2.0, 7)]
    rows, failed = B.fan_out({"a": lambda: a, "c": lambda: 1 / 0}, ["k"])
    assert rows.count() == 2 and set(failed) == {"c"}
    at = str(tmp_path / "t")
    for df in (a, a.limit(1)):
        B.write_atomic(df, at)
    assert spark.read.parquet(at).count() == 1
