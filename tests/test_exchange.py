import datetime as dt

from pyspark.sql import functions as F

from lumenfold.operators import copies_of_frames as C
from lumenfold.operators import exchange as X
from lumenfold.operators import log as L


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).collect()[0]


def test_variant_stems(spark):
    cases = {
        "masterLight_mono_drizzle_2x_autocrop": "masterLight_mono", "L_stars2": "L", "x_DBE_DBE2": "x", "m (1)": "m", "m_final (2)": "m", "final": "final", "_final": "_final", "final_final": "final", "x_v2": "x_v2",
        "integration": "integration", "Ha_integration-starless": "Ha_integration", "x__final": "x_", "bin_2": "bin_2", "L_4x": "L", "a_bxt": "a_bxt", "": "", None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert [r[0] for r in df.select(C.variant_stem(F.col("s"))).collect()] == list(cases.values())


def test_untimed_frames_are_not_trusted(spark):
    times = [("g", "a", 1, 1), ("g", "a", 2, 1), ("g", "a", 3, 1), ("g", "b", 1, 1), ("g", "b", 2, 1), ("g", "c", 1, 1), ("g", "c", 2, 1), ("g", "c", None, 40), ("g", "d", 1, 9)]
    df = spark.createDataFrame(times, "grp string, block string, t int, n int")
    assert [(r["block"], r["keeper"]) for r in C.whole_copies(df).collect()] == [("b", "a")]
    assert C.whole_copies(df.where("false")).count() == 0


def test_secrets_and_homes(spark):
    texts = {
        r"see C:\Users\Jo Doe\plans\x.fits": "see ~\\plans\\x.fits", "d:/users/jo/x": "~\\x", "/Users/jo/x /home/ann/y": "~/x ~/y", "BEARER abc.def-1": "BEARER [redacted]", "api_token=xyz&b=1": "api_token=[redacted]&b=1",
        "Password = p'w": "Password = [redacted]'w", "ftp+ssl://me:pw@host/x": "ftp+ssl://[redacted]@host/x", "http://host:80/@x": "http://host:80/@x", "forbearer x": "forbearer x", "token: x": "token: x", "": "", None: None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(L.scrubbed(F.col("t"))).collect()] == list(texts.values())


def test_counts_to_write(spark):
    rows = [(3600.0, 12, 300.0, True, 20), (3600.0, 12, 300.0, False, 20), (3600.0, 12, 300.0, False, 5), (None, 12, 300.0, True, 5), (-1.0, 0, 300.0, False, 5), (899.9999999, 3, 300.0, None, 50), (0.0, 0, 300.0, False, 3)]
    df = spark.createDataFrame(rows, "s double, f int, sub double, c boolean, w int")
    got = [r[0] for r in df.select(X.accepted_to_write(F.col("s"), F.col("f"), F.col("sub"), F.col("c"), F.col("w"), F.lit(30))).collect()]
    # 12 whole exposures; complete: at least those wanted; else at most wanted less what is missing of 30
    assert got == [20, 2, 0, None, None, 3, 0]
    r = one(spark, a=X.unfloored(F.lit(30), F.lit(8), F.lit(30)), b=X.unfloored(F.lit(31), F.lit(8), F.lit(30)), c=X.unfloored(F.lit(40), F.lit(40), F.lit(30)), d=X.unfloored(F.lit(0), F.lit(0), F.lit(30)))
    assert tuple(r) == (8, 31, 40, 0)


def test_switches(spark):
    df = spark.createDataFrame([("a", "r1", True), ("a", "r2", None), ("b", "r2", False), ("b", "r1", False), ("b", "r3", True), ("c", "r1", False)], "p string, r string, on boolean")
    assert {r["p"]: r["scheduling"] for r in X.scheduling_text(df, "p", "r", "on").collect()} == {"a": "on", "b": "off: r1, r2", "c": "off"}
    r = one(spark, a=X.switched_on(F.lit(None).cast("boolean"), F.lit(None).cast("boolean")), b=X.switched_on(F.lit(False), F.lit(True)), c=X.in_scope(F.array().cast("array<string>"), "p"), d=X.in_scope(F.array(F.lit("q")), "p"), e=X.in_scope(F.lit(None).cast("array<string>"), "p"))
    assert tuple(r) == (True, False, True, False, True)


def test_goals_and_saved_rows(spark):
    rows = [("p", 1, "Ha", 300.0, "fr", None, 12, None), ("p", 2, " Ha ", 60.0, "h", 2.5, None, 1.0), ("p", 3, "Ha", 120.0, "h", 9.0, None, 1.0), ("p", 4, "", 1.0, "h", 1.0, None, None), ("p", 5, "L", 300.0, "fr", None, 12, None), ("q", 6, None, 1.0, "h", 1.0, None, None)]
    df = spark.createDataFrame(rows, "plan_id string, n int, filter string, template_sub_s double, unit string, target_hours double, target_frames int, actual_hours double")
    assert {(r["plan_id"], r["filter"]): (r["target_hours"], r["sub_exposure_s"]) for r in X.goals_view(df, ["n"]).collect()} == {("p", "Ha"): (2.5, 60.0), ("p", "L"): (1.0, 300.0)}
    old = spark.createDataFrame([(1, "Ha", 5.0), (2, None, 6.0)], "k int, f string, h double")
    new = spark.createDataFrame([(1, "Ha", 0.0), (2, "L", 0.0), (3, "L", 1.0)], "k int, f string, h double")
    assert sorted((r["k"], r["kept"], r["h"]) for r in X.kept_figures(new, old, ["k"], ["f"], ["h"]).collect()) == [(1, True, 5.0), (2, False, 0.0), (3, False, 1.0)]
    assert sorted(tuple(r) for r in X.reported(old, new, ["k"], ["f"]).collect()) == [(1, "taken"), (2, "changed"), (3, "unknown")]
    got = {r["k"]: (r["action"], r["writes"], r["f"], r["h"]) for r in X.write_mask(new, old, ["k"], ["f", "h"]).collect()}
    assert got == {1: ("update", ["h"], None, 0.0), 2: ("update", ["f", "h"], "L", 0.0), 3: ("insert", ["f", "h"], "L", 1.0)}


def test_restamping(spark):
    df = spark.createDataFrame([(1, "A", "a"), (2, "a", "a"), (3, "B-", "b"), (4, "B", "b"), (5, None, "c"), (6, "d", None)], "id int, g string, p string")
    assert [tuple(r) for r in X.restamped(df, "g", "p", "id").collect()] == [(3, "B-", "b")]


def test_orders(spark):
    members = spark.createDataFrame([("g", i) for i in range(5)] + [("h", 9)], "g string, m int")
    shots = spark.createDataFrame([(3, 10), (1, 20), (3, 5), (77, 1)], "m int, at int")
    assert sorted((r["g"], r["place"], r["m"]) for r in X.shooting_order(members, shots, "g", "m", "at").collect()) == [("g", 1, 3), ("g", 2, 1), ("g", 3, 0), ("g", 4, 2), ("g", 5, 4), ("h", 1, 9)]
    arr = lambda *xs: F.array(*map(F.lit, xs))
    assert one(spark, a=X.remapped(arr(2, 0, 1, 7), arr(10, 11, 12), arr(12, 10)))["a"] == [0, 1]


def test_samples_are_exact(spark):
    df = spark.createDataFrame([("hot", i) for i in range(500, 0, -1)] + [("rare", 3), (None, 4)], "k string, i int")
    got = {r["k"]: (r["rows"], r["examples"]) for r in X.sampled(df, "k", "i", 3).collect()}
    assert got["hot"] == (500, [1, 2, 3]) and got["rare"] == (1, [3])
    assert X.sampled(df.where("false"), "k", "i").count() == 0
    flags = {r["kind"]: r["rows"] for r in X.flagged(df, {"even": F.col("i") % 2 == 0, "none": F.lit(None).cast("boolean")}, "i").collect()}
    assert flags == {"even": 251}


def test_seeds_links_and_deltas(spark):
    names = spark.createDataFrame([("Alpha 1",), ("alpha  1",), ("Alpha-1!",), ("Known",), ("known?",), (None,)], "name string")
    known = spark.createDataFrame([("KNOWN",)], "name string")
    slug = F.btrim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), F.lit("-"))
    norm = F.btrim(F.regexp_replace(F.lower("name"), r"\s+", " "))
    assert sorted(tuple(r) for r in X.seeded(names, known, "name", slug, norm).collect()) == [("Alpha 1", "alpha-1"), ("Alpha-1!", "alpha-1-2"), ("known?", "known-2")]
    w = spark.createDataFrame([(1, "a"), (2, "b"), (3, "z"), (4, None)], "key int, name string")
    k = spark.createDataFrame([(10, "A"), (11, "b"), (12, "B"), (11, "b")], "key int, name string")
    got = {r["key"]: (r["link"], r["to"]) for r in X.name_links(w, k, "name", "key", F.lower("name")).collect()}
    assert got == {1: ("linked", 10), 2: ("ambiguous", None), 3: ("unlinked", None), 4: ("unlinked", None)}
    b, a = (spark.createDataFrame(x, "k string, v double") for x in ([("x", 1.0), ("y", 2.0), ("x", 1.0)], [("x", 2.0), ("z", 3.0), ("n", None)]))
    assert sorted((r["k"], r["delta"]) for r in X.totals_delta(b, a, ["k"], "v").collect()) == [("y", -2.0), ("z", 3.0)]


def test_alive_problems_and_visible(spark):
    now = dt.datetime(2024, 1, 1, 12)
    ago = lambda m: now - dt.timedelta(minutes=m)
    r = spark.createDataFrame([("run", ago(29), False), ("old", ago(31), False), ("done", ago(9), True), ("over", ago(11), True), ("again", ago(40), True), ("again", ago(5), False), ("ahead", ago(-5), False)], "k string, at timestamp, d boolean")
    assert [x["k"] for x in X.alive(r, "k", "at", F.col("d"), F.lit(now)).collect()] == ["again", "done", "run"]
    p = spark.createDataFrame([(1, -1, None), (2, 5, "x"), (3, None, None)], "i int, a int, b string")
    assert {x["i"]: x["problem"] for x in X.first_problem(p, {"neg": F.col("a") < 0, "blank": F.col("b").isNull()}).collect()} == {1: "neg", 3: "blank"}
    v = spark.createDataFrame([(1, "t", None), (2, "t", "error"), (3, "u", "info"), (4, None, None)], "i int, type string, severity string")
    assert sorted(x["i"] for x in X.visible_rows(v, {"t": "site"}, ["site"]).collect()) == [2, 3, 4]
    assert one(spark, a=X.plan_matches(["active"], " TAV ", F.lit(None).cast("string"), [F.lit("Tav 9"), F.lit(None).cast("string")]), b=X.plan_matches(["active"], "", F.lit("draft"), [F.lit("x")])) == (True, False)


def test_extent_and_span(spark):
    r = one(spark, e=X.mosaic_extent(F.lit(60.0), F.lit(40.0), F.lit(2), F.lit(3), F.lit(10.0)), n=X.mosaic_extent(F.lit(60.0), F.lit(40.0), F.lit(None).cast("int"), F.lit(0), F.lit(None).cast("double")))
    assert (round(r["e"]["width"], 9), round(r["e"]["height"], 9)) == (168.0, 76.0) and tuple(r["n"]) == (60.0, 40.0)
    pts = lambda *xs: F.array(*(F.array(*map(F.lit, x)) for x in xs))
    none = F.lit(None)
    r = one(spark, a=X.widest(pts((359.5, 0.0), (0.5, 0.0), (0.0, 0.2)), none.cast("array<double>")), b=X.widest(none.cast("array<array<double>>"), F.array(F.lit(30.0), F.lit(90.0))), c=X.widest(none.cast("array<array<double>>"), none.cast("array<double>")), d=X.widest(pts((1.0, 89.9), (181.0, 89.9), (90.0, 89.9)), none.cast("array<double>")))
    assert [round(x, 6) for x in r] == [1.0, 1.5, 1.0, 0.2]
