import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import names as N
from lumenfold.functions import optics as O
from lumenfold.operators import blocks as B
from lumenfold.operators import skyobjects as K
from lumenfold.sources import clock


def one(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_pointing_and_agreement(spark):
    df = one(spark, "g string, id int, ra_deg double, dec_deg double", ("a", 1, None, None), ("a", 2, 5.0, 6.0), ("a", 3, 7.0, 8.0), ("b", 4, None, 1.0), (None, 5, 1.0, 1.0))
    got = {r["id"]: (r["ra_deg"], r["dec_deg"], r["inherited"]) for r in B.inherit_pointing(df, ["g"], [F.col("id")]).collect()}
    assert got == {1: (5.0, 6.0, True), 2: (5.0, 6.0, False), 3: (7.0, 8.0, False), 4: (None, 1.0, False), 5: (1.0, 1.0, False)}
    v = one(spark, "g string, v string", ("a", "x"), ("a", None), ("a", "x"), ("b", "x"), ("b", "y"), ("c", None))
    assert {r["g"]: r["o"] for r in B.only_value(v, ["g"], "v", "o").collect()} == {"a": "x", "b": None, "c": None}


def test_richest_settings_and_changes(spark):
    df = one(spark, "k string, a int, b int, p string", ("x", 1, None, "p"), ("x", 1, 2, "q"), ("x", 3, 4, "r"), (None, 1, 1, "s"))
    assert [(r["k"], r["p"]) for r in B.richest(df, ["k"], ["a", "b"], "p").collect()] == [("x", "q")]
    s = one(spark, "g string, i int, a int, b string", ("g", 2, 5, "z"), ("g", 1, None, "z"), ("g", 3, 6, None))
    r = B.first_settings(s, ["g"], F.col("i"), ["a", "b"]).collect()[0]
    assert (r["a"], r["a_differs"], r["b"], r["b_differs"]) == (5, True, "z", False)
    c = one(spark, "k string, i int, `from` string, `to` string", ("p", 1, "a", "b"), ("p", 2, "b", "c"), ("q", 1, "a", "b"), ("q", 2, "b", "a"), ("r", 1, None, "x"))
    got = {r["k"]: (r["from"], r["to"], r["changes"]) for r in B.coalesced_changes(c, ["k"], ["i"]).collect()}
    assert got == {"p": ("a", "c", 2), "r": (None, "x", 1)}


def test_pages_marks_and_sources(spark):
    have = one(spark, "n int, id int, v string", (1, 1, "a"), (1, 2, "b"), (2, 3, "c"), (2, 4, "d"))
    got = one(spark, "n int, id int, v string", (1, 1, "A"), (2, 3, "C"))
    out = B.merged_pages(have, got, "n", "id", one(spark, "n int", (1,)))
    assert sorted((r["id"], r["v"]) for r in out.collect()) == [(1, "A"), (3, "C"), (4, "d")]
    m = one(spark, "k string, t int, v boolean", ("a", 1, True), ("a", 2, False), ("b", 1, None), ("b", 2, True), ("c", 1, True), ("c", 2, None))
    assert [r["k"] for r in B.last_writes(m, ["k"], ["t"], "v").collect()] == ["b"]
    s = one(spark, "s string, h double", ("a", 1.0), ("a", 9.0), ("b", 1.0), ("c", None))
    assert sorted(r["s"] for r in B.sources_over(s, "s", "h", 5.0).collect()) == ["a", "c"]


def test_facets(spark):
    df = one(spark, "t string, c array<string>", ("x", ["m", "n"]), ("x", ["m"]), ("y", ["m", "m"]), ("y", None))
    f = {"t": (F.array("t"), F.col("t") == "x"), "c": (F.col("c"), F.array_contains("c", "n"))}
    got = {(r["facet"], r["value"]): r["items"] for r in B.facet_counts(df, f).collect()}
    assert got == {("t", "x"): 1, ("c", "m"): 2, ("c", "n"): 1}


def test_paths(spark):
    cases = {
        "/a/x_FILTER-Ha_1.xisf": "Ha", "/a/L-eXtreme_1.fit": "L-eXtreme", "/a/m31_oiii_300.fit": "OIII", "/a/t/2024/LIGHT/Ha/f.fit": "Ha", "/a/LIGHT/f1.fit": None, "C:\\a\\SII\\f1.fit": "SII", "/a/b c.fit": "B", "/Ha/1/2/3/4/f9.fit": None,
    }
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r["p"]: r["f"] for r in df.select("p", N.filter_from_path(F.col("p")).alias("f")).collect()} == cases
    stems = one(spark, "s string", ("x_c_d_r",), ("x",), ("_r",)).select("s", N.stage_stems(F.col("s")).alias("a")).collect()
    assert {r["s"]: list(r["a"]) for r in stems} == {"x_c_d_r": ["x", "x_c", "x_c_d", "x_c_d_r"], "x": ["x"], "_r": ["_r"]}
    p = one(spark, "p string", ("/nas/a/b/c.fit",), ("/other/x/y/z.fit",), ("C:\\nas\\q.fit",), ("plain",), ("/one",))
    got = {r["p"]: (r["s"], r["m"]) for r in p.select("p", N.shortened(F.col("p"), ["/nas", "/nas/a"]).alias("s"), N.mapped(F.col("p"), {"/nas/": "Z:/", "/nas/a/": "Y:/"}).alias("m")).collect()}
    assert got["/nas/a/b/c.fit"] == ("b/c.fit", "Y:/b/c.fit") and got["/other/x/y/z.fit"] == ("y/z.fit", None)
    assert got["C:\\nas\\q.fit"][0] == "nas/q.fit" and got["plain"][0] == "plain" and got["/one"][0] == "one"


def test_optics(spark):
    schema = "n1 int, n2 int, s1 int, s2 int, w double, f double"
    rows = [(6000, 4000, None, None, 1.0, 1.1), (6000, 4000, 3000, 2000, 2.0, 1.0), (6000, 4000, None, None, 5.0, 1.0), (6000, 4000, None, None, None, 1.0), (6000, 4000, None, None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).orderBy("i")
    got = [r[0] for r in df.select(O.field_pairing(*(F.col(c) for c in ("n1", "n2", "s1", "s2", "w", "f")))).collect()]
    assert [(g["n1"], g["scale"], g["method"]) for g in got] == [(6000, 1.0, "wcs"), (3000, 2.0, "wcs"), (6000, 1.0, "focal"), (6000, 1.0, "focal"), (6000, None, "none")]
    r = spark.range(1).select(O.pixel_scale(F.lit(3.76), F.lit(500.0), F.lit(2)).alias("s"), O.view_radius(F.lit(3.0), F.lit(4.0)).alias("v"), O.view_radius(F.lit(30.0), F.lit(4.0)).alias("x"), O.outline(F.lit(10.0), F.lit(0.0), F.lit(60.0), F.lit(30.0), F.lit(0.0), 4).alias("o")).collect()[0]
    assert r["s"] == pytest.approx(206.265 * 3.76 * 2 / 500) and r["v"] == 2.5 and r["x"] is None
    assert r["o"][0]["dec"] == pytest.approx(0.5, abs=1e-3) and r["o"][1]["ra"] == pytest.approx(10.25, abs=1e-3) and math.isclose(r["o"][1]["dec"], 0, abs_tol=1e-9)


def test_sky_objects(spark):
    reply = {"metadata": [{"name": x} for x in ("oid", "main_id", "otype", "ra", "dec", "galdim_majaxis", "galdim_minaxis")], "data": [[1, "M  31", "G", 10.68, 41.27, 177.8, 0], [2, "x", None, 1, 1, 1, 1], [3, "y", "G", None, 1, 1, 1], [4, "NGC 7000", "HII", 314.8, 44.3, None, None]]}
    df = spark.createDataFrame([(json.dumps(reply),), ("broken",), (None,)], "reply string")
    objects = K.reply_rows(df)
    got = {r["oid"]: (r["name"], r["major"], r["minor"], r["pa"]) for r in objects.collect()}
    assert got == {1: ("M 31", 177.8, None, None), 4: ("NGC 7000", None, None, None)}
    ids = spark.createDataFrame([(1, "NGC 224"), (1, "NGC  224"), (1, "M 31"), (9, "z")], "oid int, id string")
    named = {r["oid"]: (list(r["aliases"]), list(r["c"])) for r in K.with_identifiers(objects, ids).withColumn("c", K.catalogues_of(F.concat(F.array("name"), F.col("aliases")))).collect()}
    assert named == {1: (["NGC 224"], ["messier", "ngc"]), 4: ([], ["ngc"])}
    sizes = one(spark, "i int, m double", (1, 30.0), (2, 100.0), (3, None), (4, 5.0)).orderBy("i")
    assert [r[0] for r in sizes.select(K.fits_frame(F.col("m"), 100.0, 0.1, 0.5, True)).collect()] == [True, False, True, False]
    assert [r[0] for r in sizes.select(K.fits_frame(F.col("m"), 100.0, None, None, False, 10.0)).collect()] == [True, True, False, False]


def test_clock():
    now = dt.datetime(2024, 2, 28, 23, 50)
    assert clock.fire_time("0 3 * * *", now) == dt.datetime(2024, 2, 29, 3, 0)
    assert clock.fire_time("*/15 * * * *", now) == dt.datetime(2024, 2, 29, 0, 0)
    assert clock.fire_time("30 4 1,15 * 5", now) == dt.datetime(2024, 3, 1, 4, 30)
    assert clock.fire_time("0 0 29 2 *", now, forward=False) == dt.datetime(2020, 2, 29, 0, 0)
    assert clock.fire_time("0 12 * * 7", now) == dt.datetime(2024, 3, 3, 12, 0)
    assert clock.fire_time("0 0 31 2 *", now) is None
    assert clock.overdue("0 3 * * *", dt.datetime(2024, 2, 28, 2, 0), now) and not clock.overdue("0 3 * * *", dt.datetime(2024, 2, 28, 3, 0), now)
    for bad in ("* * *", "61 * * * *", "5-1 * * * *", "*/0 * * * *", "x * * * *"):
        with pytest.raises(ValueError):
            clock.parse(bad)
