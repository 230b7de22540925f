import random
from collections import Counter

import pytest

from lumenfold.operators import copies_of_frames as C
from lumenfold.operators import graph as G
from lumenfold.operators import hours as H


def made(seed):
    rnd = random.Random(seed)
    blocks = {}
    for b in range(40):
        grp = rnd.randrange(3)
        times = Counter(rnd.randrange(6) for _ in range(rnd.randint(1, 10)))
        if rnd.random() < 0.3 and blocks:
            grp, times = rnd.choice(list(blocks.values()))
        blocks[b] = (grp, times)
    return blocks, [(g, b, t, n) for b, (g, ts) in blocks.items() for t, n in ts.items()]


@pytest.mark.parametrize("seed", range(3))
def test_whole_copies(spark, seed):
    blocks, rows = made(seed)
    order = sorted((b for b in blocks if len(blocks[b][1]) > 1), key=lambda b: (-blocks[b][1].total(), b))
    want = set()
    for i, b in enumerate(order):
        g, ts = blocks[b]
        for o in order[:i]:
            if blocks[o][0] == g and all(blocks[o][1][t] >= n for t, n in ts.items()):
                want.add((g, b, o))
                break
    got = {tuple(r) for r in C.whole_copies(spark.createDataFrame(rows, "grp int, block int, t int, n int")).select("grp", "block", "keeper").collect()}
    assert got == want


def test_whole_copies_never_pair_blocks(spark, monkeypatch):
    """Folders of one group that all hold the same times: found in chunks, over several batches, and no row is a pair."""
    monkeypatch.setattr(C, "CHUNK", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rnd = random.Random(5)
    blocks = {f"b{i:03d}": (i % 2, Counter(rnd.choice("xyz") for _ in range(rnd.randint(2, 40)))) for i in range(200)}
    rows = [(g, b, t, n) for b, (g, ts) in blocks.items() for t, n in ts.items()]
    want = {}
    for b, (g, ts) in blocks.items():
        if len(ts) > 1:
            rank = {o: (-us.total(), o) for o, (h, us) in blocks.items() if h == g and len(us) > 1 and all(us[t] >= n for t, n in ts.items())}
            first = min(rank, key=rank.get)
            if first != b:
                want[b] = first
    df = C.whole_copies(spark.createDataFrame(rows, "grp int, block string, t string, n int"))
    got = {r["block"]: r["keeper"] for r in df.collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len(want) > 100
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # two joins, each by the block's own key: none by a time that it shares with others
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 2 and not any("(t#" in line for line in joins)


@pytest.mark.parametrize("seed", range(2))
def test_partial_copies_one_by_one(spark, seed):
    blocks, rows = made(seed + 10)
    order = sorted((b for b in blocks if len(blocks[b][1]) > 1), key=lambda b: (-blocks[b][1].total(), b))
    credited, want = {}, set()
    for b in order:
        g, ts = blocks[b]
        lost = 0
        for t, n in ts.items():
            lost += min(n, credited.get((g, t), 0))
            credited[g, t] = max(credited.get((g, t), 0), n)
        if lost >= 5 and lost >= ts.total() * 0.1:
            want.add((g, b, ts.total(), lost))
    got = {tuple(r) for r in C.partial_copies(spark.createDataFrame(rows, "grp int, block int, t int, n int")).select("grp", "block", "frames", "lost").collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_components_and_clusters(spark, seed):
    rnd = random.Random(seed)
    n = 60
    edges = {(min(a, b), max(a, b)) for a, b in ((rnd.randrange(n), rnd.randrange(n)) for _ in range(45)) if a != b}
    chain = [(100 + i, 101 + i) for i in range(40)]
    edges |= set(chain)
    df = spark.createDataFrame([*edges, (5, 5), (None, 3), *list(edges)[:5]], "a int, b int")
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in G.connected_components(df).collect()}
    assert got == {x: find(x) for x in parent}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    nodes = sorted({*range(n), *near})
    seed_of = {}
    for x in nodes:
        if x not in seed_of:
            seed_of[x] = x
            for y in near.get(x, ()):
                if y > x:
                    seed_of.setdefault(y, x)
    got = {r["node"]: r["seed"] for r in G.ordered_clusters(spark.createDataFrame([(x,) for x in nodes], "node int"), df.where("a is not null and a <> b")).collect()}
    assert got == seed_of


def test_components_of_nothing(spark):
    none = spark.createDataFrame([], "a int, b int")
    assert G.connected_components(none).count() == 0
    assert G.ordered_clusters(spark.createDataFrame([(1,)], "node int"), none).collect()[0]["seed"] == 1


MEMBER = "target_id int, role string, path string, filter string, colour boolean, rig_key string, hours double, depth_known boolean, date string, session_root string, bucket string, n_subs int, accepted boolean, counts_captured boolean"


def rig(spark, *rows):
    base = dict(target_id=1, role="folder_sub", path="p", filter="Ha", colour=False, rig_key="S|C", hours=1.0, depth_known=True, date="2024-01-01", session_root="/s", bucket="/s/l", n_subs=10, accepted=True, counts_captured=True)
    names = MEMBER.replace(",", "").split()[::2]
    df = spark.createDataFrame([tuple((base | r)[c] for c in names) for r in rows], MEMBER)
    out = H.by_rig(df).collect()
    assert len(out) == 1
    return out[0]


def test_hours_rules(spark):
    m = dict(role="master", path="m", n_subs=0)
    r = rig(spark, dict(hours=5.0), m | dict(hours=4.0))
    assert (r["headline_basis"], r["headline_hours"], r["stale_master"], r["stale_excess_hours"]) == ("integrated", 4.0, True, 1.0)
    # exactly at the limit isn't stale
    assert not rig(spark, dict(hours=4.8), m | dict(hours=4.0))["stale_master"]
    # the deepest master counts, never the sum; a known depth before a deeper unknown one
    r = rig(spark, dict(hours=9.0), m | dict(hours=4.0), m | dict(hours=3.0, path="n"), m | dict(hours=99.0, depth_known=False, path="o"))
    assert (r["integrated_hours"], r["n_masters"], r["multi_master"]) == (4.0, 3, True)
    # a stack deeper than its own subs isn't trusted, unless its subs aren't there
    r = rig(spark, dict(hours=1.0), m | dict(hours=4.0))
    assert (r["integration_anomaly"], r["headline_basis"], r["headline_hours"]) == (True, "captured", 1.0)
    r = rig(spark, dict(hours=1.0), m | dict(hours=4.0, session_root="/elsewhere"))
    assert (r["integration_anomaly"], r["masters_without_subs"], r["headline_basis"]) == (False, True, "integrated")
    # rejects below another block are taken out once; at the same place they only don't count
    r = rig(spark, dict(hours=5.0), dict(hours=2.0, accepted=False, bucket="/s/l/rejected", path="q"))
    assert (r["captured_hours"], r["accepted_hours"], r["accepted_basis"]) == (7.0, 3.0, "rejected_folders")
    assert rig(spark, dict(hours=5.0), dict(hours=2.0, accepted=False, path="q"))["accepted_hours"] == 5.0
    # no depth: captured; nothing: none
    assert rig(spark, m | dict(hours=4.0, depth_known=False))["headline_basis"] == "none"
    # one rig in two spellings
    r = rig(spark, dict(hours=1.0), dict(hours=2.0, rig_key="s|c", path="q"))
    assert (r["captured_hours"], r["rig_key"]) == (3.0, "S|C")
