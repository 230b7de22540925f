import datetime as dt
import random

import pytest

from lumenfold.operators import copies as C

SPEC = C.DiffSpec(("k", "j"), ("name", "x", "n", "ok", "state"), newest="at", same={"state": {"parked": "inactive"}})
SCHEMA = "k string, j string, name string, x double, n int, ok boolean, state string, at timestamp, field string"
T0 = dt.datetime(2024, 1, 1)


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def unlike(f, a, b):
    if a is None or b is None:
        return (a is None) != (b is None)
    if f == "x":
        nan = a != a, b != b
        return nan[0] != nan[1] if any(nan) else abs(a - b) > 1e-3
    if f == "state":
        a, b = ("inactive" if v == "parked" else v for v in (a, b))
    return a != b


def brute(base, local, remote):
    sides = []
    for rows in (base, local, remote):
        d = {}
        for r in rows:
            key, at = (r[0], r[1]), r[7] or dt.datetime(1900, 1, 1)
            if key not in d or at > (d[key][7] or dt.datetime(1900, 1, 1)):
                d[key] = r
        sides.append(d)
    b, lo, re = sides
    out = set()
    for key in lo.keys() | re.keys():
        if key not in re or key not in lo:
            out.add((*key, "", "remote" if key not in re else "local"))
            continue
        for i, f in enumerate(SPEC.fields, 2):
            if unlike(f, lo[key][i], re[key][i]):
                if key not in b:
                    side = "nobase"
                else:
                    p, q = unlike(f, lo[key][i], b[key][i]), unlike(f, re[key][i], b[key][i])
                    side = "both" if p == q else "local" if p else "remote"
                out.add((*key, f, side))
    return out


def rows(rnd, keys, at=True):
    out = []
    for k in keys:
        out.append((*k, rnd.choice(["a", "b", None]), rnd.choice([1.0, 1.0005, 2.0, float("nan"), None]), rnd.choice([1, 2, None]), rnd.choice([True, None]), rnd.choice(["parked", "inactive", "x", None]), T0 + dt.timedelta(days=rnd.randint(0, 9)) if at else None, "clash"))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    keys = [(rnd.choice(["p", "q", None]), str(i) if i % 9 else None) for i in range(80)]
    keys = list(dict.fromkeys(keys))
    sides = [rows(rnd, [k for k in keys if rnd.random() < 0.8]) for _ in range(3)]
    # repeats with another time
    sides[1] += [(*r[:7], r[7] - dt.timedelta(days=20), r[8]) for r in sides[1][:9]]
    got = [tuple(r)[:4] for r in C.differences(*(frame(spark, s) for s in sides), SPEC).collect()]
    assert set(got) == brute(*sides) and len(got) == len(set(got))


def test_empty_sides(spark):
    rnd = random.Random(1)
    some = frame(spark, rows(rnd, [("a", "1"), ("b", "2")]))
    none = frame(spark, [], 1)
    assert C.differences(none, none, none, SPEC).count() == 0
    assert {(r["field"], r["side"]) for r in C.differences(none, some, none, SPEC).collect()} == {("", "remote")}
    assert C.differences(some, none, none, SPEC).count() == 0
    assert C.differences(none, some, some, SPEC).count() == 0


def test_hot_key_is_collapsed(spark):
    rnd = random.Random(2)
    one = rows(rnd, [("hot", "1")])
    many = [(*one[0][:7], T0 + dt.timedelta(minutes=i), "c") for i in range(3000)] + rows(rnd, [("k", str(i)) for i in range(40)])
    local, remote = many, rows(rnd, [("hot", "1")]) + many[3000:]
    got = {tuple(r)[:4] for r in C.differences(frame(spark, one), frame(spark, local), frame(spark, remote), SPEC).collect()}
    assert got == brute(one, local, remote)
