import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import log as L
from lumenfold.operators import merge3 as M
from lumenfold.operators import planning as P

T0 = dt.datetime(2024, 1, 1)
FIELDS = [M.MergeField("a"), M.MergeField("x", True)]


def test_classes(spark):
    schema = "k string, a string, x double"
    base = [("1", "p", 1.0), ("2", "p", 1.0), ("3", "p", 1.0), ("4", None, 1.0), ("5", "p", None)]
    local = [("1", "p", 1.0005), ("2", "q", 1.0), ("3", "q", 1.0), ("4", "p", 1.0), ("5", "p", 2.0), ("6", "z", 1.0)]
    remote = [("1", "q", 1.0), ("2", "p", 1.0), ("3", "r", 1.0), ("4", "p", 1.0), ("5", "p", None), ("6", "y", 1.0)]
    df = lambda rows: spark.createDataFrame(rows, schema)
    rows = M.joined(df(base), df(local), df(remote), ["k"], FIELDS)
    got = {(r["k"], r["field"]): r["class"] for r in M.field_classes(rows, ["k"], FIELDS).collect()}
    assert got == {("1", "a"): "auto_pull", ("2", "a"): "auto_keep", ("3", "a"): "conflict", ("5", "x"): "auto_keep", ("6", "a"): "auto_pull"}
    strict = {(r["k"], r["field"]): r["class"] for r in M.field_classes(rows, ["k"], FIELDS, strict=True).collect()}
    assert strict == got | {("6", "a"): "conflict"}
    now = {r["k"]: (r["a"], r["x"]) for r in M.pulled(rows, ["k"], FIELDS).collect()}
    assert now["1"] == ("q", 1.0005) and now["2"] == ("q", 1.0) and now["6"] == ("z", 1.0)


def test_upsert(spark):
    incoming = spark.createDataFrame([("g1", "n"), ("g2", "m"), ("g3", "m"), ("g4", None)], "guid string, name string")
    existing = spark.createDataFrame([(1, "g1", "x"), (2, " ", "m"), (3, None, "m"), (4, "other", "n")], "id int, guid string, name string")
    got = {r["guid"]: (r["action"], r["target"]) for r in M.upsert_actions(incoming, existing, "guid", ["name"], "id").collect()}
    assert got == {"g1": ("update", 1), "g2": ("claim", 2), "g3": ("insert", None), "g4": ("insert", None)}


def test_order(spark):
    cases = [(["a", "b", "c"], ["a", "c"], True), (["c", "a"], ["a", "c"], False), ([], ["a"], True), (["x", "a", "c"], ["a", "y", "c"], True)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a array<string>, b array<string>").orderBy("i")
    assert [r[0] for r in df.select(M.same_order(F.col("a"), F.col("b"))).collect()] == [c[2] for c in cases]


def test_goals_come_back(spark):
    rnd = random.Random(0)
    rows = [(rnd.randint(1, 9999), rnd.choice([0.5, 7.0, 30.0, 60.0, 180.0, 299.9, 601.3])) for _ in range(800)]
    df = spark.createDataFrame(rows, "n int, s double")
    bad = df.where(P.frames_wanted(P.hours_for_frames(F.col("n"), F.col("s")), F.col("s")) != F.col("n"))
    assert bad.count() == 0


def test_progress(spark):
    schema = "plan_id string, filter string, unit string, target_hours double, target_frames int, template_sub_s double, actual_hours double"
    rows = [("p", "Ha", "h", 2.0, None, 60.0, 3.0), ("p", "Ha", "fr", None, 60, 60.0, 0.5), ("q", "L", "h", None, None, None, None)]
    f = {(r["plan_id"], r["filter"]): r for r in P.by_filter(spark.createDataFrame(rows, schema)).collect()}
    r = f["p", "Ha"]
    assert (r["goal_hours"], r["actual_hours"], r["credited_hours"], r["left_hours"]) == (3.0, 3.5, 2.5, 0.5)
    p = {r["plan_id"]: r for r in P.by_plan(P.by_filter(spark.createDataFrame(rows, schema))).collect()}
    assert p["p"]["done"] == pytest.approx(2.5 / 3) and not p["p"]["finished"] and p["q"]["done"] is None


def rotated(ra, dec, days):
    """Rigorous precession angles, to compare with."""
    t = days / 36525
    zeta, z, theta = (math.radians(s / 3600) for s in (2306.2181 * t + 0.30188 * t * t, 2306.2181 * t + 1.09468 * t * t, 2004.3109 * t - 0.42665 * t * t))
    a, d = math.radians(ra) + zeta, math.radians(dec)
    x, y, w = math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d)
    x2, w2 = math.cos(theta) * x - math.sin(theta) * w, math.sin(theta) * x + math.cos(theta) * w
    return math.degrees(math.atan2(y, x2) + z), math.degrees(math.asin(w2))


def test_altitudes(spark):
    rnd = random.Random(1)
    rows = [(rnd.uniform(0, 360), rnd.uniform(-89.5, 89.5), rnd.uniform(9000, 10000)) for _ in range(50)]
    df = spark.createDataFrame(rows, "ra double, dec double, d double")
    ra, dec = P.precessed(F.col("ra"), F.col("dec"), F.col("d"))
    out = df.select("*", P.altitude(ra, dec, F.col("d"), F.lit(32.9), F.lit(-105.5)).alias("alt"))
    for r in out.collect():
        a, d = rotated(r["ra"], r["dec"], r["d"])
        h = math.radians((280.46061837 + r["d"] * 360.98564736629) % 360 - 105.5 - a)
        lat, d = math.radians(32.9), math.radians(d)
        want = math.degrees(math.asin(math.sin(d) * math.sin(lat) + math.cos(d) * math.cos(lat) * math.cos(h)))
        assert r["alt"] == pytest.approx(want, abs=0.02)


def test_year(spark):
    t = spark.createDataFrame([(1, 10.0, 89.0), (2, 10.0, -89.0), (3, 83.8, -5.4)], "target_id int, ra_deg double, dec_deg double")
    got = {(r["target_id"], r["month"]): r for r in P.year_visibility(t, 2026, 32.9, -105.5, 30.0).collect()}
    assert len(got) == 36
    # the pole stays at the site's latitude all night; the other one is never up
    assert all(abs(got[1, m]["peak_alt_deg"] - 32.9) < 1.2 and got[1, m]["hours_above_min"] > 5 for m in range(1, 13))
    assert all(got[2, m]["label"] == "not_visible" for m in range(1, 13))
    # a winter field in the north
    assert got[3, 12]["label"] == "good" and got[3, 6]["label"] == "not_visible"
    # no darkness near the pole in summer
    polar = {r["month"]: r for r in P.year_visibility(t.where("target_id = 1"), 2026, 75.0, 0.0, 30.0).collect()}
    assert polar[6]["peak_alt_deg"] is None and polar[6]["label"] == "not_visible" and polar[12]["label"] == "great"


LOG = "delivery_id bigint, source string, key string, seq bigint, at timestamp, received_at timestamp, content string, type string, needs_you boolean, resolve_key string, resolves array<string>"


def entry(i, key, seq, at=0, received=None, content="c", type_="t", needs=False, rk=None, resolves=()):
    return (i, "s", key, seq, T0 + dt.timedelta(hours=at), T0 + dt.timedelta(hours=i if received is None else received), content, type_, needs, rk, list(resolves))


def sequential(rows):
    state, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[5], r[0])):
        k = (r[1], r[2])
        if k not in state:
            state[k], out[r[0]] = [r[3], r[6]], "stored"
            continue
        seq, content = state[k]
        if r[3] is not None and seq is not None and r[3] < seq:
            out[r[0]] = "stale"
            continue
        state[k][0] = max(x for x in (r[3], seq) if x is not None) if (r[3], seq) != (None, None) else None
        out[r[0]] = "unchanged" if content == r[6] else "updated"
        state[k][1] = r[6]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_outcomes_in_sequence(spark, seed):
    rnd = random.Random(seed)
    rows = [entry(i, rnd.choice("abc"), rnd.choice([None, 1, 2, 3, 4]), received=rnd.randint(0, 40), content=rnd.choice("xy")) for i in range(120)]
    got = {r["delivery_id"]: r["outcome"] for r in L.outcomes(spark.createDataFrame(rows, LOG), ["content"]).collect()}
    assert got == sequential(rows)


def test_open_items(spark):
    rows = [
        entry(1, "open", 1, 5, needs=True, rk="k1"), entry(2, "closed", 1, 5, needs=True, rk="k2"), entry(3, "solver", 1, 6, resolves=["k2"]), entry(4, "early", 1, 1, resolves=["k1"]),
        entry(5, "own", 1, 5, needs=True, rk="k5", resolves=["k5"]), entry(6, "old", 1, 0, type_="safety", needs=True, rk="k6"), entry(7, "reopened", 1, 5, needs=True, rk="k7"), entry(8, "r7", 1, 6, resolves=["k7"]), entry(9, "reopened", 2, 9, needs=True, rk="k7"),
    ]
    now = L.current(spark.createDataFrame(rows, LOG))
    got = {r["key"] for r in L.open_items(now, F.lit(T0 + dt.timedelta(days=8))).collect()}
    assert got == {"open", "own", "reopened"}


def test_progress_steps(spark):
    df = spark.createDataFrame([("p", i, h) for i, h in enumerate([1.0, 3.0, 2.0, 2.5])] + [("q", 0, 0.0)], "plan string, i int, hours double")
    got = {r["plan"]: (r["hours"], r["most"]) for r in L.progress_hours(df, ["plan"], ["i"]).collect()}
    assert got == {"p": (3.5, 3.0), "q": (0.0, 0.0)}


def test_scrub(spark):
    df = spark.createDataFrame([("Bearer abc.d; my_token = x1, db_password=y&z https://u:p@h/x /Users/me/a /home/you/b",)], "t string")
    assert df.select(L.scrubbed(F.col("t"))).collect()[0][0] == "Bearer [redacted]; my_token = [redacted], db_password=[redacted]&z https://[redacted]@h/x ~/a ~/b"


def test_rig_verdicts(spark):
    rows = [(1, 1.0, 60.0, 40.0, ["Ha"]), (2, 1.0, 70.0, 44.0, ["L"]), (3, 2.0, 60.0, 40.0, ["L"]), (4, 1.0, 60.0, 40.0, ["X", "L"]), (5, None, 1.0, 1.0, []), (6, 1.0, 60.0, 40.0, ["OIII"])]
    df = spark.createDataFrame(rows, "id int, scale double, w double, h double, filters array<string>")
    got = {r["id"]: r["verdict"] for r in P.rig_verdicts(df, 1.0, 62.0, 41.0, {"L": "direct", "Ha": "direct", "OIII": "dual"}).collect()}
    assert got == {1: "fit", 2: "fit_with_warnings", 3: "no_fit", 4: "no_fit", 5: "unconstrained", 6: "fit_with_warnings"}
    assert np.isfinite(1.0)
