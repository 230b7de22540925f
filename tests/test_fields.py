import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import names as N
from lumenfold.operators import geometry as G
from lumenfold.operators import grouped as R
from lumenfold.operators import identity as I
from lumenfold.operators import rank, tiles
from lumenfold.sources.registry import CatalogueSource, SourceRegistry, TileSource
from lumenfold.streaming.events import EventStream


def box(ra, dec, w, h, rot=0.0):
    """Corners of a small box, in arcmin, on a flat sky."""
    r = math.radians(rot)
    out = []
    for x, y in ((-w, -h), (-w, h), (w, h), (w, -h)):
        e, n = x / 120 * math.cos(r) + y / 120 * math.sin(r), y / 120 * math.cos(r) - x / 120 * math.sin(r)
        out.append((ra + e / math.cos(math.radians(dec)), dec + n))
    return [p[0] for p in out], [p[1] for p in out]


def test_shared_areas():
    a = box(10.0, 0.0, 60, 60)
    assert G.shares(*a, *a) == (pytest.approx(1.0), pytest.approx(1.0))
    small, union = G.shares(*a, *box(10.5, 0.0, 60, 60))
    assert (small, union) == (pytest.approx(0.5, abs=1e-3), pytest.approx(1 / 3, abs=1e-3))
    assert G.shares(*a, *box(10.0, 0.0, 30, 30)) == (pytest.approx(1.0), pytest.approx(0.25, abs=1e-3))
    assert G.shares(*a, *box(12.0, 0.0, 60, 60)) == (0.0, 0.0)
    assert G.shares(*a, *box(190.0, 0.0, 60, 60)) == (0.0, 0.0)
    # a square turned by 45 degrees shares an octagon
    assert G.shares(*a, *box(10.0, 0.0, 60, 60, 45.0))[0] == pytest.approx(2 * (math.sqrt(2) - 1), abs=1e-3)
    # over the seam, corners in any order
    b = box(0.1, 5.0, 60, 40)
    c = [b[0][2], b[0][0], b[0][3], b[0][1]], [b[1][2], b[1][0], b[1][3], b[1][1]]
    assert G.shares(*b, *c)[1] == pytest.approx(1.0)


SHAPE = "k bigint, ra double, dec double, cra array<double>, cdec array<double>, field double, reach double"


def fields(spark, rows, key):
    data = [(i, ra, dec, *box(ra, dec, w, h), float(min(w, h)), math.hypot(w, h) / 120 * 1.01) for i, ra, dec, w, h in rows]
    return spark.createDataFrame(data, SHAPE).withColumnRenamed("k", key)


def test_duplicates_against_brute_force(spark):
    rnd = random.Random(0)
    rows = lambda n, at: [(at + i, rnd.uniform(0, 4), rnd.uniform(-2, 2), rnd.choice([20, 60]), rnd.choice([20, 40])) for i in range(n)]
    a, b = rows(25, 0), rows(25, 100)
    want = {}
    for i, ra, dec, w, h in a:
        best = None
        for j, ra2, dec2, w2, h2 in b:
            sep = 60 * math.degrees(math.acos(min(1.0, math.sin(math.radians(dec)) * math.sin(math.radians(dec2)) + math.cos(math.radians(dec)) * math.cos(math.radians(dec2)) * math.cos(math.radians(ra - ra2)))))
            share = G.shares(*box(ra, dec, w, h), *box(ra2, dec2, w2, h2))[0]
            if sep <= min(w, h, w2, h2) / 2 or share >= 0.3:
                key = (-round(share, 9), round(sep / 60, 9), j)
                best = min(best, key) if best else key
        if best:
            want[i] = best[2]
    got = {r["l"]: r["r"] for r in G.duplicate_fields(fields(spark, a, "l"), fields(spark, b, "r")).collect()}
    assert got == want and got


def scan(spark, old, new, old_names, new_names, hours_old=None, hours_new=None):
    names = lambda d, k: spark.createDataFrame([(i, n) for i, ns in d.items() for n in ns], f"{k} bigint, name string")
    edges = I.match_edges(fields(spark, old, "l"), fields(spark, new, "r"), names(old_names, "l"), names(new_names, "r"))
    h = lambda rows, hs, k: spark.createDataFrame([(r[0], float((hs or {}).get(r[0], 1.0))) for r in rows], f"{k} bigint, hours double")
    ids, gone = I.assign(h(old, hours_old, "l"), h(new, hours_new, "r"), edges, 50)
    return {r["r"]: (r["target_id"], r["status"]) for r in ids.collect()}, {r["l"]: r["into"] for r in gone.collect()}


def test_identities(spark):
    a, b, far = (1, 10.0, 0.0, 60, 60), (2, 20.0, 5.0, 60, 60), (3, 100.0, 10.0, 60, 60)
    at = lambda i, f, d=0.0: (i, f[1] + d, *f[2:])
    # only the order changed; one field is new, one is gone
    ids, gone = scan(spark, [a, b, far], [at(0, b, 0.01), at(1, a), (2, 200.0, 0.0, 60, 60)], {1: ["x"], 2: ["y"]}, {0: ["y"], 1: ["x"]})
    assert ids == {0: (2, "kept"), 1: (1, "kept"), 2: (50, "new")} and gone == {3: None}
    # a split: the one with most hours keeps the number
    ids, gone = scan(spark, [a], [at(0, a), at(1, a, 0.1)], {1: ["x"]}, {0: ["x"], 1: ["x"]}, None, {1: 9.0})
    assert ids == {1: (1, "kept"), 0: (50, "new")} and gone == {}
    # a merge: the number of the old one with most hours
    ids, gone = scan(spark, [a, at(2, a, 0.1)], [at(0, a)], {1: ["x"], 2: ["x"]}, {0: ["x"]}, {2: 9.0})
    assert ids == {0: (2, "kept")} and gone == {1: 2}
    # unlike names on one place: only a footprint that nearly agrees is a rename
    ids, _ = scan(spark, [a], [at(0, a)], {1: ["x"]}, {0: ["z"]})
    assert ids[0] == (1, "kept")
    ids, _ = scan(spark, [a], [at(0, a, 0.45)], {1: ["x"]}, {0: ["z"]})
    assert ids[0] == (50, "new")
    ids, gone = scan(spark, [a], [], {}, {})
    assert ids == {} and gone == {1: None}


def test_retired_numbers_come_back_for_the_same_place(spark):
    old, gone, new = [(1, 10.0, 0.0, 60, 60)], [(7, 50.0, 5.0, 60, 60), (8, 50.0, 5.02, 60, 60)], [(0, 10.0, 0.0, 60, 60), (1, 50.0, 5.0, 60, 60), (2, 90.0, 0.0, 60, 60)]
    none = lambda k: spark.createDataFrame([], f"{k} bigint, name string")
    edges = lambda rows: I.match_edges(fields(spark, rows, "l"), fields(spark, new, "r"), none("l"), none("r"))
    hours = lambda rows, k: spark.createDataFrame([(r[0], 1.0) for r in rows], f"{k} bigint, hours double")
    ids, lost = I.assign(hours(old, "l"), hours(new, "r"), edges(old), 50, edges(gone))
    assert {r["r"]: (r["target_id"], r["status"]) for r in ids.collect()} == {0: (1, "kept"), 1: (7, "revived"), 2: (50, "new")} and lost.count() == 0


def test_chains(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 8), (9, 10)] + [(100 + i, 101 + i) for i in range(20)], "old int, new int")
    got = {r["old"]: r["new"] for r in I.resolve_chains(df).collect()}
    assert got == {1: 8, 2: 8, 3: 8, 9: 10} | {100 + i: 120 for i in range(20)}


def test_dense_ids(spark):
    rnd = random.Random(1)
    values = [rnd.choice([None, *range(40)]) for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int").repartition(7)
    got = [(r["n"], r["v"], r["i"]) for r in rank.dense_ids(df, [F.col("v").desc_nulls_last(), F.col("i").asc()], "n", 5).collect()]
    got.sort()
    assert [g[0] for g in got] == list(range(5, 305))
    assert [(g[1], g[2]) for g in got] == sorted(((v, i) for i, v in enumerate(values)), key=lambda t: (t[0] is None, -(t[0] or 0), t[1]))
    assert rank.dense_ids(df.where("false"), [F.col("i").asc()], "n").count() == 0


def test_rotations(spark):
    assert R.rotation_groups(np.array([1.0, 2.0, 90.0, 179.5]), np.array([1.0, 1.0, 2.5, 1.0]), np.ones(4)) == [(pytest.approx(0.83, abs=0.01), 3.0, 3), (90.0, 2.5, 1)]
    assert R.rotation_groups(np.array([10.0, 50.0]), np.zeros(2), np.ones(2))[0][0] == 10.0
    df = spark.createDataFrame([("a", 359.0, 1.0), ("a", 180.5, 1.0), ("a", 90.0, 1.5), ("b", None, 1.0)], "g string, rotation_deg double, hours double")
    r = R.rotations(df, "g", "string").collect()
    assert len(r) == 1 and r[0]["hours"] == 2.0 and r[0]["others"] == 1 and min(r[0]["rotation_deg"], 180 - r[0]["rotation_deg"]) < 0.5
    med = R.circular_median(spark.createDataFrame([("a", x) for x in (350.0, 10.0, 5.0)], "g string, x double"), ["g"], "x").collect()
    assert med[0]["median_deg"] == pytest.approx(5.0)


def test_grids():
    ra, dec = np.meshgrid([10.0, 11.0, 12.0], [1.0, 0.0])
    rows, cols, place = R.grid_of(ra.ravel(), dec.ravel(), 0.0)
    assert (rows, cols) == (2, 3) and place[0].tolist() == [1, 1] and place[5].tolist() == [2, 3]
    t = math.radians(30)
    x, y = ra.ravel() - 11, dec.ravel() - 0.5
    turned = R.grid_of(11 + x * math.cos(t) + y * math.sin(t), 0.5 + y * math.cos(t) - x * math.sin(t), 30.0)
    assert turned is not None and turned[:2] == (2, 3)
    assert R.grid_of(np.array([1.0]), np.array([1.0]), 0.0) is None
    assert R.grid_of(np.array([1.0, 2.0, 3.5]), np.zeros(3), 0.0) is None and R.grid_of(np.array([1.0, 2.0, 1.0]), np.array([0.0, 0.0, 1.0]), 0.0) is None


def circle(steps, every):
    """The rule as it is told, on a list that is walked as a circle."""
    work, out, pos = [*steps, steps[0]], [], 0
    while True:
        counts, found = {}, None
        for i in range(pos, len(work)):
            counts[work[i]] = counts.get(work[i], 0) + 1
            if counts[work[i]] == every + 1:
                found = i
                break
        if found is None:
            return (out + work[pos:])[:-1]
        out += work[pos:found] + ["dither"]
        pos = found


def test_dithers(spark):
    rnd = random.Random(2)
    for _ in range(300):
        steps = [rnd.choice("LRG") for _ in range(rnd.randint(1, 12))]
        every = rnd.randint(1, 3)
        assert R.dithers(steps, every) == circle(steps, every)
    df = spark.createDataFrame([(["L", "L"],), ([],), (None,)], "s array<string>")
    assert [r[0] for r in df.select(R.dithered(F.col("s"), 1)).collect()] == [["L", "dither", "L", "dither"], [], None]


def test_merged_catalogue_in_order(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("ab"), rnd.uniform(0, 1), rnd.uniform(0, 1), rnd.choice([None, 0.0, 2.0, 30.0, 120.0])) for i in range(60)]
    order = sorted(rows, key=lambda r: (r[4] is None, -(r[4] or 0.0), r[0]))
    kept, want = [], {}
    for o in order:
        for k in kept:
            reach = min(30.0, max(1.0, 0.2 * (k[4] or 0.0)))
            d = 60 * math.degrees(math.acos(min(1.0, math.sin(math.radians(k[3])) * math.sin(math.radians(o[3])) + math.cos(math.radians(k[3])) * math.cos(math.radians(o[3])) * math.cos(math.radians(k[2] - o[2])))))
            if k[1] == o[1] and d <= reach and not (k[4] is not None and o[4] is not None and k[4] > 4 * o[4]):
                want[o[0]] = k[0]
                break
        else:
            kept.append(o)
            want[o[0]] = o[0]
    got = {r["id"]: r["into"] for r in R.merged_catalogue(spark.createDataFrame(rows, "id int, family string, ra_deg double, dec_deg double, major double")).collect()}
    assert got == want


def test_tiles(spark):
    schema = "id int, priority int, per_band map<string,struct<covered:boolean>>, category_counts map<string,int>, metadata map<string,string>"
    rows = [(1, 1, {"Ha": (True,), "SII": (False,)}, {"snr": 2}, {"f": "x"}), (2, 0, None, None, None), (3, 5, {"Ha": (False,)}, {"snr": 0}, {"f": "y"}), (4, None, {"Ha": (None,)}, {"snr": 1}, {})]
    df = spark.createDataFrame(rows, schema)
    ids = lambda *a: [r["id"] for r in df.where(tiles.tile_passes(*a)).orderBy("id").collect()]
    assert ids([1, 5], [], []) == [1, 2, 3, 4] and ids([], [], []) == [2, 4] and ids([1, 5], ["Ha"], []) == [2, 3, 4]
    assert ids([1, 5], [], ["snr"]) == [1, 4] and ids([1, 5], [], [], {"f": ["x"]}) == [1, 2, 4]
    assert [r[0] for r in df.orderBy("id").select(tiles.completion()).collect()] == [0.5, 0.0, 0.0, 0.0]


def test_session_stages(spark):
    paths = ["/n/a/calibrated/1", "/n/a/registered", "/n/b/calibrated/x", "/n/b/calibrated/y", "/n/c/Master", "/n/d/lights", "/n/e/originals/z", "/n/e/calibrated"]
    got = {r["p"]: (r["session_root"], r["stage"]) for r in N.session_stages(spark.createDataFrame([(p,) for p in paths], "p string"), "p").collect()}
    assert got["/n/a/calibrated/1"] == ("/n/a", "calibrated") and got["/n/b/calibrated/x"] == ("/n/b/calibrated/x", "root")
    assert got["/n/c/Master"] == ("/n/c", "master") and got["/n/d/lights"] == ("/n/d/lights", "root") and got["/n/e/originals/z"] == ("/n/e", "og")


def test_fnv(spark):
    def plain(t):
        h = 2166136261
        for b in t.encode():
            h = (h ^ b) * 16777619 % 2**32
        return h

    texts = ["", "a", "RedCat 51", "länge"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(N.fnv1a(F.col("t"))).collect()]
    assert got == [plain(t) for t in texts]


def test_sources_fail_alone(spark):
    class Tiles:
        source_id = "t"

        def tiles(self, s):
            return s.createDataFrame([(1, 2)], "id int, priority int")

    r = SourceRegistry()
    r.load("good", Tiles)
    r.load("again", Tiles)
    r.load("bad", lambda: 1 / 0)
    r.load("old", Tiles, api=0)
    r.load("odd", lambda: object())
    assert list(r.sources) == ["t"] and set(r.failed) == {"bad", "old", "odd"}
    assert len(r.of(TileSource)) == 1 and r.of(CatalogueSource) == []
    assert r.union(spark, TileSource, "tiles", ["id"]).collect()[0]["source_id"] == "t" and r.listing(spark).count() == 4


def test_event_stream_equals_batch(spark, tmp_path):
    from lumenfold.operators import log as L
    from tests.test_plans import LOG, entry

    rnd = random.Random(4)
    rows = [entry(i, rnd.choice(["a", " A", "b"]), rnd.choice([None, 1, 2]), content=rnd.choice("xy")) for i in range(60)]
    src = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame(rows[k::3], LOG).coalesce(1).write.mode("append").parquet(str(src))
    got = EventStream(spark, str(tmp_path / "w")).run(str(src), 1).current()
    want = L.current(L.keyed(spark.createDataFrame(rows, LOG))).drop("deliveries", "first_received")
    norm = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert norm(got) == norm(want)
