import uuid

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import names as N


def values(spark, expr, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


CASES = {
    "H_Alpha": "Ha", " oiii ": "OIII", "S2": "SII", "LIGHT": "L", "none": "NoFilter", "NON": "NoFilter", "?": None, "": None, "  ": None, "N/A": None, "7": None, "unknown": None, None: None,
    "l-ExTreme": "L-eXtreme", "SV220_Ha-Oiii_3nm": "SV220 Ha-OIII 3nm", "svbony sv240": "SV240", "SV220 SII": "SV220 SII-OIII 7nm", "SV 220": "SV220", "Antlia Ha": "Ha", "Astronomik_OIII": "OIII", "NA": "NA", " Sodium": "Sodium", "LPS D2": "LPS-D2",
}


def test_canonical_filter(spark):
    assert dict(zip(CASES, values(spark, N.canonical_filter, CASES))) == CASES


def test_bands(spark):
    rows = [("Ha", False), ("NoFilter", True), ("NoFilter", False), (None, True), (None, False), ("IR CUT", True), ("IR CUT", False), ("Quad-Band", True), ("LPS-D1", False), ("Sodium", False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, f string, c boolean").orderBy("i")
    got = [tuple(r[0]) for r in df.select(N.bands_for(F.col("f"), F.col("c"))).collect()]
    rgb = ("R", "G", "B")
    assert got == [("Ha",), rgb, ("L",), rgb, ("Unknown",), rgb, ("IR CUT",), ("Ha", "OIII", "SII"), ("L",), ("Sodium",)]
    labels = [r[0] for r in df.select(N.filter_label(F.col("f"), F.col("c"))).collect()]
    assert labels == ["Ha", "OSC", "NoFilter", "OSC", "Unknown", "OSC", "IR CUT", "Quad-Band", "LPS-D1", "Sodium"]


def test_gear(spark):
    assert values(spark, N.telescope_name, ["Sky-Watcher MN190", "hyper  star", "HYPERSTAR", "iOptron CEM26", "", None, "My Scope"]) == ["190MN", "hyper  star", "HyperStar", None, None, None, "My Scope"]
    assert values(spark, N.camera_name, ["ZWO ASI 2600", "qhyccd  268M", "QHY268M", "zwo", "player one  Ares", "", None]) == ["ASI 2600", "268M", "QHY268M", "zwo", "Ares", None, None]
    assert values(spark, lambda c: N.rig_key(c, F.lit(None).cast("string")), ["a/b|c", None, " "]) == ["a_b_c|?", "?|?", "?|?"]
    assert values(spark, N.rig_label, ["?|?", "A|B"]) == ["Unknown rig", "A + B"]
    assert values(spark, N.camera_is_colour, ["ASI2600MC Pro", "268C", "Poseidon-M", "ASI2600MM", "Canon"]) == [True, True, False, False, None]


def test_paths(spark):
    assert values(spark, N.is_rejected, ["/a/Rejected/x", "/a/bad_frames/x", "/a/BadFrames", "/a/Sinbad/x", "/Badlands/x", "/Bad Tolz/x", None]) == [True, True, True, False, False, False, False]
    assert values(spark, N.parent_dir, ["/a/b/c.fit", "C:\\x\\y.fit", "plain", "/root"]) == ["/a/b", "C:\\x", "plain", "/"]
    assert values(spark, N.object_from_filename, ["Light_NGC6960_180.0s", "sh2-129_x", "x_m31_y", "M31", "plain"]) == ["NGC 6960", "Sh2-129", "M31", "M31", None]
    stamps = ["2024-01-02T03:04:05.123456", "2024-01-02T03:04:05.000", "2024-01-02T03:04:05", "2024-01-02T03:04:05.5", None]
    assert values(spark, N.millisecond_stamp, stamps) == ["2024-01-02T03:04:05.123", None, None, "2024-01-02T03:04:05.500", None]


def test_uuid5(spark):
    texts = ["", "a", "länger", "x" * 300]
    want = [str(uuid.uuid5(uuid.NAMESPACE_URL, t)) for t in texts]
    assert values(spark, lambda c: N.uuid5(uuid.NAMESPACE_URL.hex, c), texts) == want


def test_sexagesimal(spark):
    assert values(spark, N.parse_ra, ["12 30 00", "12h30m0s", "187.5", "25 0 0", "x", "12 61 0", None]) == [pytest.approx(187.5), pytest.approx(187.5), 187.5, None, None, None, None]
    assert values(spark, N.parse_dec, ["-00 30 00", "+41:16:09", "-5", "91", ""]) == [-0.5, pytest.approx(41.26917, abs=1e-5), -5.0, None, None]
    assert values(spark, lambda c: N.format_sexagesimal(c.cast("double")), ["12.99999999", "-0.5", "0"]) == ["13 00 00.0", "-00 30 00.0", "00 00 00.0"]


def test_aperture(spark):
    names = ["RedCat 51", "Scope 80mm", '8" RC', "Newton 200/1000", "Esprit 100 ED", "AP110", "C9.25 SCT", "Dob 12 inch", "Tube 12", "none", "", None]
    assert values(spark, N.aperture_class, names) == ["51mm refractor", "80mm telescope", "203mm telescope", "200mm reflector", "100mm refractor", "110mm refractor", "telescope", "305mm reflector", "telescope", "telescope", "telescope", "telescope"]


def test_makers_and_series(spark):
    """One maker after the other comes off; a series is known by its words, however they are joined."""
    got = values(spark, N.canonical_filter, ["Antlia Ha", "ZWO Antlia OIII", "zwo_baader_astronomik_sii", "ZWO Optolong", "Baader 2", "Antlia Baader Weird 5", "SV220 Ha 3nm", "Svbony SV-220 SII OIII", "sv240", "SVBONY SV 220", "SV2200"])
    assert got == ["Ha", "OIII", "SII", "OPTOLONG", None, "WEIRD 5", "SV220 Ha-OIII 3nm", "SV220 SII-OIII 7nm", "SV240", "SV220", "SV2200"]
