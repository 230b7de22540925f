import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import linkage as K
from lumenfold.llm import targets as T

S = "id int, name string, ra double, dec double, rotation double, r string"
L = "target_id bigint, objects array<string>, center_ra_deg double, center_dec_deg double, footprint_arcmin array<double>, rotation_deg double, l string"


def made(seed=0, n=60):
    rnd = random.Random(seed)
    adjectives, nouns, kinds = ["Quiet", "Rusted", "Velvet", "Hollow", "Amber", "Pale"], ["Otter", "Lantern", "Gate", "Harbour", "Trellis", "Whistle"], ["Nebula", "Galaxy", "Cloud"]
    lib, sched, truth, sid = [], [], set(), 1
    for i in range(n):
        cat, num = rnd.choice(["abc", "xyz", "qrs"]), rnd.randint(10, 9999)
        name = f"{rnd.choice(adjectives)} {rnd.choice(nouns)} {rnd.choice(kinds)}"
        ra, dec, rot = rnd.uniform(0, 360), rnd.uniform(-80, 80), rnd.choice([0.0, rnd.uniform(0, 360)])
        lib.append((1000 + i, [f"{cat.title()} {num}", name] if i % 9 else [f"{cat}_{num}"], ra, dec, [40.0, 30.0], rot, "clash"))
        for k in range(rnd.randint(0, 2)):
            a, d, r = ra + rnd.uniform(-0.1, 0.1), dec + rnd.uniform(-0.1, 0.1), rot + rnd.choice([0, 180]) + rnd.uniform(-0.5, 0.5)
            text = rnd.choice([f"{cat.upper()} 0{num}", f"{cat}_{num} panel {k + 1}", f"redo {cat}{num}"])
            hours = a / 15 if a >= 0 else a / 15 + 24
            if rnd.random() < 0.15:
                hours, d = rnd.choice([(None, None), (0.0, 0.0)])
            elif rnd.random() < 0.1 and a > 24:
                hours = a  # in degrees
            sched.append((sid, text, hours, d, r, "clash"))
            truth.add((sid, 1000 + i))
            sid += 1
        if rnd.random() < 0.5:  # another object near by
            sched.append((sid, f"{rnd.choice(['abc', 'xyz'])} {rnd.randint(10000, 99999)}", ra / 15, min(dec + 0.3, 90.0), rnd.uniform(0, 360), None))
            sid += 1
    return sched, lib, truth


def frames(spark, sched, lib):
    return spark.createDataFrame(sched, S), spark.createDataFrame(lib, L)


def test_finds_made_pairs(spark):
    sched, lib, truth = made()
    m = T.matches(*frames(spark, sched, lib)).collect()
    got = {(r["l"], r["r"]) for r in m}
    assert len(got) == len({a for a, _ in got})
    hit = len(got & truth)
    assert hit / len(got) >= 0.95 and hit / len(truth) >= 0.95
    assert all(0 <= r["confidence"] <= 1 for r in m)


def test_fit_against_row_by_row():
    # counts of vectors give the same as every pair on its own
    rnd = np.random.default_rng(0)
    pairs = np.stack([rnd.integers(0, 4, 400), rnd.integers(0, 3, 400)], axis=1)
    distinct, counts = np.unique(pairs, axis=0, return_counts=True)
    one = K.fit(distinct, counts, [3, 2], rounds=30)
    two = K.fit(pairs, np.ones(len(pairs)), [3, 2], rounds=30)
    assert np.isclose(one[0], two[0]) and all(np.allclose(a, b) for a, b in zip(one[1] + one[2], two[1] + two[2]))
    p = K.posterior(distinct, *one)
    assert ((p >= 0) & (p <= 1)).all()
    assert np.isclose(K.posterior(np.array([[0, 0]]), *one)[0], one[0])


def test_blocking_by_typing_errors(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    cuts = {r["w"]: set(r["c"]) for r in df.select("w", K.deletions(F.col("w")).alias("c")).collect()}
    pairs = df.crossJoin(df.withColumnRenamed("w", "v")).select("w", "v", K.near_text(F.col("w"), F.col("v")).alias("near")).collect()
    for r in pairs:
        swaps = any(r["w"][:i] + r["w"][i + 1] + r["w"][i] + r["w"][i + 2 :] == r["v"] for i in range(len(r["w"]) - 1))
        if swaps:
            assert r["near"]
        # a swap of neighbours and any single error share a cut text
        if swaps or (r["near"] and len(r["w"]) != len(r["v"])):
            assert cuts[r["w"]] & cuts[r["v"]]


@pytest.mark.parametrize("n", [9, 10, 11, 300])
def test_crowded_key_keeps_all_pairs(spark, n):
    """As many pairs below, at and above the number of rows from which a key is dealt into parts; keys of unlike passes don't mix."""
    left = spark.createDataFrame([(i, "hot", "a") for i in range(7)], "l int, k string, f string")
    right = spark.createDataFrame([(i, "hot", "hot") for i in range(n)] + [(1000, "cold", "a")], "r int, k string, f string")
    passes = [(F.array("k"), F.array("k")), (F.array(F.lit("x"), "f"), F.array(F.lit("y"), "f"))]
    got = {tuple(r) for r in K.candidate_pairs(left, right, passes, None, 10).collect()}
    assert got == {(i, j) for i in range(7) for j in [*range(n), 1000]}


def test_crowded_names_keep_all_pairs(spark):
    # a third of the library shares a name; targets without a position and with another rotation are found by it alone
    sched, lib, _ = made(5, 40)
    lib += [(5000 + i, ["abc 77", "Pale Otter Nebula"], 3.0 * i, 10.0, [40.0, 30.0], 10.0, None) for i in range(20)]
    sched += [(7000, "ABC 77", None, None, 60.0, None), (7001, "abc_77", 0.0, 0.0, 99.0, None)]
    s, b = frames(spark, sched, lib)
    norm = lambda df: {(r["l"], r["r"]): round(r["confidence"], 9) for r in df.collect()}
    few, many = norm(T.link_targets(s, b, crowd=5)), norm(T.link_targets(s, b, crowd=1000))
    assert few == many
    assert all((l, 5000 + i) in few for l in (7000, 7001) for i in range(20))


def test_nulls_repeats_and_empty_tables(spark):
    sched, lib, truth = made(2, 20)
    nulls = [(None, None, None, None, None, None), (9000, None, None, None, None, None), (9001, "", 1.0, 95.0, None, None), (9002, "x" * 20_000, 1.0, 1.0, 1.0, None)]
    odd = [(8000, None, None, None, None, None, None), (8001, [None, ""], 5.0, 5.0, [None], None, None)]
    plain = {(r["l"], r["r"]) for r in T.matches(*frames(spark, sched, lib)).collect()}
    more = {(r["l"], r["r"]) for r in T.matches(*frames(spark, sched + nulls + sched[:5], lib + odd + lib[:3])).collect()}
    assert plain <= more | plain and {p for p in more if p[0] is not None and p[0] < 9000} == plain
    s, b = frames(spark, sched, lib)
    for a, c in ((s.where("false"), b), (s, b.where("false")), (s.where("false"), b.where("false"))):
        assert T.matches(a, c).count() == 0
