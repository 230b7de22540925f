import math
import random

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import sphere as S
from lumenfold.operators import sky


def xyz(ra, dec):
    a, d = math.radians(ra), math.radians(dec)
    return math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d)


def angle(p, q):
    c = [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    return math.degrees(math.atan2(math.sqrt(sum(x * x for x in c)), sum(x * y for x, y in zip(p, q))))


@pytest.mark.parametrize("radius", [0.01, 1.0, 40.0, 180.0])
def test_join_against_brute_force(spark, radius):
    rnd = random.Random(int(radius * 100))
    pts = [(i, rnd.uniform(-400, 800), math.degrees(math.asin(rnd.uniform(-1, 1)))) for i in range(60)]
    pts += [(100, 0.001, 0.0), (101, 359.999, 0.0), (102, 10.0, 90.0), (103, 200.0, 89.995), (104, 7.0, -90.0), (105, None, 1.0), (106, 5.0, None), (107, 10.0, 90.0)]
    cts = [(i + 1000, ra, dec, radius * rnd.choice([1, 0.3])) for i, ra, dec in pts if ra is not None and dec is not None] + [(5000, 1.0, 1.0, None), (5001, 1.0, 1.0, -1.0), (5002, None, None, 1.0)]
    p = spark.createDataFrame(pts, "p int, ra double, dec double").select("p", S.xyz(F.col("ra"), F.col("dec")).alias("__v"))
    c = spark.createDataFrame(cts, "c int, ra double, dec double, r double").select("c", "r", S.xyz(F.col("ra"), F.col("dec")).alias("__c"))
    got = sorted((r["p"], r["c"]) for r in sky.sky_join(p, c, F.col("r")).collect())
    want = sorted((i, j) for i, a, d in pts if a is not None and d is not None for j, b, e, r in cts if r is not None and r >= 0 and b is not None and angle(xyz(a, d), xyz(b, e)) <= r + 1e-10)
    assert got == want and len(set(got)) == len(got)


def test_separation(spark):
    df = spark.createDataFrame([(0.0, 90.0, 123.0, 90.0), (359.9, 0.0, 0.1, 0.0), (10.0, 0.0, 190.0, 0.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(S.separation_deg(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert got == pytest.approx([0.0, 0.2, 180.0], abs=1e-9)


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(0.05, 88.0, 1.5, 1.5), (359.9, -60.0, -0.7, 0.2)], "a double, d double, e double, n double")
    out = df.withColumn("p", S.deproject(F.col("a"), F.col("d"), F.col("e"), F.col("n"))).withColumn("g", S.gnomonic(F.col("a"), F.col("d"), F.col("p.ra"), F.col("p.dec")))
    for r in out.collect():
        assert (r["g"]["east"], r["g"]["north"]) == pytest.approx((r["e"], r["n"]), abs=1e-9)


SCHEMA = "target_id bigint, center_ra_deg double, center_dec_deg double, footprint_arcmin array<double>, rotation_deg double, corners_icrs array<array<double>>, candidate_id string"


def test_points_in_regions_cases(spark):
    square = [[359.0, -1.0], [1.0, 1.0], [1.0, -1.0], [-1.0, 1.0]]  # over the seam, in no order
    polar = [[0.0, 89.0], [180.0, 89.0], [90.0, 89.0], [270.0, 89.0]]
    targets = [
        (1, 0.0, 0.0, None, None, square, "clash"),
        (2, None, None, None, None, polar, None),
        (3, 120.0, 40.0, [60.0, 30.0], None, None, None),
        (4, 120.0, 40.0, [60.0, 30.0], 90.0, None, None),
        (5, 10.0, 10.0, None, 1.0, None, None),
        (6, 10.0, 10.0, [None, 3.0], 1.0, [[1.0, None], [2.0, 2.0], [3.0, 1.0]], None),
        (1, 0.0, 0.0, None, None, square, "repeated"),
    ]
    points = [(1, 0.0, 0.0), (2, 360.5, 0.5), (3, 1.5, 0.0), (4, 33.0, 89.9), (5, 120.0, 40.4), (6, 120.6, 40.0), (7, None, 0.0), (8, 180.0, 0.0), (1, 0.0, 0.0)]
    t = spark.createDataFrame(targets, SCHEMA)
    p = spark.createDataFrame(points, "candidate_id bigint, ra_deg double, dec_deg double").withColumn("target_id", F.lit("clash"))
    got = sorted((r[0], r[1]) for r in sky.points_in_regions(p, t).collect())
    # target 3 reaches half a degree east and west, 4 the same north and south
    assert got == [(1, 1), (2, 1), (4, 2), (5, 4), (6, 3)]
    assert sky.points_in_regions(p.limit(0), t).count() == 0
    assert sky.points_in_regions(p, t.limit(0)).count() == 0
