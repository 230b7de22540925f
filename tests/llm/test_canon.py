import random

import pytest

from lumenfold.llm import canon as K
from lumenfold.llm import filters

LETTERS = "abc"


def word(rnd, n):
    return "".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, n)))


def test_distance_is_a_metric():
    rnd = random.Random(0)
    assert K.distance("ca", "abc") == 2  # transposition with a letter between: not so in the restricted form
    assert K.distance("ab", "ba") == 1 and K.distance("", "abc") == 3 and K.distance("a", "a") == 0
    for _ in range(2000):
        a, b, c = (word(rnd, 6) for _ in range(3))
        assert K.distance(a, b) == K.distance(b, a)
        assert (K.distance(a, b) == 0) == (a == b)
        assert K.distance(a, c) <= K.distance(a, b) + K.distance(b, c)


def test_tree_finds_every_entry_within_the_threshold():
    rnd = random.Random(1)
    entries = {word(rnd, 7) for _ in range(300)}
    tree = K.BKTree(entries)
    for _ in range(200):
        v, t = word(rnd, 8), rnd.randint(0, 3)
        assert sorted(tree.within(v, t)) == sorted((K.distance(v, e), e) for e in entries if K.distance(v, e) <= t)
    assert K.BKTree().within("x", 3) == []


def frame(spark, values):
    return spark.createDataFrame([(v, "clash") for v in values], "value string, canon_id string")


# a reference list of this shape; only the word table is typed in, the spellings come from it by rule
LIST = [
    ("L", "luminance", "broadband", 300.0), ("R", "red", "broadband", 100.0), ("G", "green", "broadband", 90.0), ("B", "blue", "broadband", 100.0), ("Ha", "hydrogen alpha", "narrowband", 5.0), ("Hb", "hydrogen beta", "narrowband", 5.0),
    ("OIII", "doubly ionised oxygen", "narrowband", 5.0), ("SII", "ionised sulphur", "narrowband", 5.0), ("Methane", "methane absorption", "narrowband", 10.0), ("UV/IR cut", "ultraviolet and infrared block", "broadband", 300.0),
    ("Korvex Duo 7", "two lines, 7 nm", "dual", 7.0), ("Korvex Duo 3", "two lines, 3 nm", "dual", 3.0), ("Nivalis SkyCut", "light pollution cut", "broadband", 200.0), ("Nivalis SkyCut Plus", "stronger light pollution cut", "broadband", 140.0),
    ("Tessera HO", "hydrogen and oxygen", "dual", 6.0), ("Photometric V", None, "photometric", 90.0), ("Moonbar 2", "moonlight reducer", None, None), ("Vexil Tri 6", None, "triple", 6.0),
]


@pytest.fixture(scope="module")
def canon(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(LIST, 1)], "canon_id int, canon_name string, long_name string, kind string, width_nm double")


CASES = {
    "Ha": "Ha", "  7: Hydrogen lApha-3nm (Obrix 571 colour)": "Ha", "filter_O-III_12nm": "OIII", "grÃ¼n": "G", "Nivalis B": "B", "Nivalis_Sky_Cut_Plus": "Nivalis SkyCut Plus",
    "Korvex Duo Bnad 3nm": "Korvex Duo 3", "KORVEX DUO BAND 7NM": "Korvex Duo 7", "Tessera HO": "Tessera HO", "Red Stars": "R", "Oxygen II": "OIII", "Oxygen nII": "OIII", "H-eta": "Hb", "Methhan": "Methane", "uv ir block": "UV/IR cut", "moon-bar II": "Moonbar 2", "phot. V": "Photometric V", "tessera ha+oiii": "Tessera HO",
    "nivalis skycut+": "Nivalis SkyCut Plus", "Newmaker Luminanz 36mm filter": None, "Newmaker Luminanz filter": "L", "vexil tri band 6nm": "Vexil Tri 6", "Vexil 3-band 6 nm": "Vexil Tri 6", "korvex duo 8": None,
    "Filter 7": None, "07": None, "slot?": None, "": None, " \t": None, "Calcium K": None, "ND 3.8": None, "x" * 20_000: None,
}


@pytest.mark.parametrize("shard", [20_000, 10])
def test_cases_whole_and_sharded(spark, canon, shard):
    ids = {r["canon_name"]: r["canon_id"] for r in canon.collect()}
    got = {r["value"]: r["canon_id"] for r in K.match_values(frame(spark, [*CASES, None, "Ha"]), filters.entries(canon), filters.BESIDE, shard_entries=shard).collect()}
    assert got == {v: ids[n] if n else 0 for v, n in CASES.items()}


def test_against_brute_force(spark, canon):
    rnd = random.Random(3)
    entries = [r["entry"] for r in filters.entries(canon).collect()]
    values = []
    for _ in range(150):
        t = list(rnd.choice(entries))
        for _ in range(rnd.randint(0, 2)):
            i = rnd.randrange(len(t) + 1)
            t[i : i + rnd.randint(0, 1)] = rnd.choice(["", "x", "q"])
        values.append(rnd.choice(["", "Corvane ", "3: "]) + "".join(t) + rnd.choice(["", " 3nm", " filter"]))

    def brute(v):
        written = K.forms(v, filters.BESIDE)
        texts = [K.compact(t) for t in written]
        for t in texts:
            if t in entries:
                return 0, texts.index(t), t
        near = [(K.distance(t, e), i, e) for i, t in enumerate(texts) for e in entries if K.digits(t) == K.digits(e)]
        near = [x for x in near if x[0] <= min(K.allowance(written[x[1]]), K.allowance(x[2]))]
        return min(near) if near else None

    got = {r["value"]: (r["dist"], r["entry"]) for r in K.match_values(frame(spark, values), filters.entries(canon), filters.BESIDE).collect()}
    for v in values:
        want = brute(v)
        assert got[v] == ((want[0], want[2]) if want else (None, None))


def test_empty_tables(spark, canon):
    none = frame(spark, []).where("false")
    assert K.match_values(none, filters.entries(canon), filters.BESIDE).count() == 0
    got = K.match_values(frame(spark, ["Ha"]), filters.entries(canon.where("false")), filters.BESIDE).collect()
    assert [r["canon_id"] for r in got] == [0]


def test_map_column_keeps_every_row(spark, canon):
    rows = spark.createDataFrame([(1, "H-alpha"), (1, "H-alpha"), (2, None), (3, "?")], "id int, f string")
    m = K.match_values(rows.selectExpr("f as value"), filters.entries(canon), filters.BESIDE)
    assert sorted((r["id"], r["canon_id"]) for r in K.map_column(rows.withColumnRenamed("f", "value"), "value", m).collect() if r["canon_id"] is not None) == [(1, 5), (1, 5), (3, 0)]
