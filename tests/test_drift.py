import json

from lumenfold.operators import drift as D

RAW = "feed string, file_seq int, line_no int, record string, guid string"


def raw(spark, files):
    rows = [(feed, seq, i, r if isinstance(r, str) or r is None else json.dumps(r), "clash") for feed, seq, rs in files for i, r in enumerate(rs)]
    return spark.createDataFrame(rows, RAW)


KNOWN = [D.Field("guid", "string"), D.Field("x", "bigint"), D.Field("p", "double"), D.Field("t", "string"), D.Field("flag", "boolean"), D.Field("order", "array<bigint>")]


def changes(spark, files):
    """The same changes whether the schema knows the fields or everything is rescued."""
    found = [sorted(tuple(r) for r in D.field_changes(D.ingest(raw(spark, files), fields), fields).collect()) for fields in (KNOWN, KNOWN[:1], [D.Field("other", "string")])]
    assert found[0] == found[1] == found[2]
    return found[0]


def test_changes(spark):
    a = [{"guid": "1", "x": 1, "p": 5, "t": "a"}, {"guid": "2", "x": 2, "p": None, "t": "b"}, {"guid": "3", "x": 3}]
    b = [{"guid": "1", "y": 1, "p": "5", "new": None}, {"guid": "2", "y": 2, "p": "7"}, {"guid": "3", "y": 9}]
    got = changes(spark, [("f", 1, a), ("f", 3, b), ("g", 1, a)])
    assert got == [("f", 3, "added", "", "new"), ("f", 3, "removed", "t", ""), ("f", 3, "renamed", "x", "y"), ("f", 3, "retyped", "p", "p")]


def test_no_rename_without_common_values(spark):
    got = changes(spark, [("f", 1, [{"guid": "1", "x": 1}]), ("f", 2, [{"guid": "1", "y": 2}])])
    assert got == [("f", 2, "added", "", "y"), ("f", 2, "removed", "x", "")]
    # no target is in both files
    got = changes(spark, [("f", 1, [{"guid": "1", "x": 1}]), ("f", 2, [{"guid": "2", "y": 1}])])
    assert [c[2] for c in got] == ["added", "removed"]


def test_exactly_half_renames_and_each_field_once(spark):
    a = [{"guid": "1", "x": 1, "z": 1}, {"guid": "2", "x": 2, "z": 2}]
    b = [{"guid": "1", "y": 1}, {"guid": "2", "y": 3}]
    got = changes(spark, [("f", 1, a), ("f", 2, b)])
    assert got == [("f", 2, "removed", "z", ""), ("f", 2, "renamed", "x", "y")]


def test_values_agree_between_columns_and_rescue(spark):
    """A rename is seen where one name is a typed column and the other is rescued, for every type."""
    alike = [("x", 3, 3), ("p", 5, 5.0), ("p", 0.1, 0.1), ("p", 1e-9, 1e-9), ("t", 'a "q" \u00e9', 'a "q" \u00e9'), ("flag", True, True), ("order", [1, 2], [1, 2]), ("x", 2**60, 2**60)]
    # a text is no number, and a list no text
    unlike = [("x", 3, "3"), ("t", "true", True), ("order", [1, 2], "[1,2]")]
    files = [f for i, (old, value, twin) in enumerate(alike + unlike) for f in ((f"{i:02d}", 1, [{"guid": "1", old: value}]), (f"{i:02d}", 2, [{"guid": "1", "new": twin}]))]
    want = [(f"{i:02d}", 2, "renamed", old, "new") for i, (old, _, _) in enumerate(alike)]
    want += [c for i, (old, _, _) in enumerate(unlike, len(alike)) for c in ((f"{i:02d}", 2, "added", "", "new"), (f"{i:02d}", 2, "removed", old, ""))]
    assert changes(spark, files) == want


def test_types_that_are_half_typed_half_rescued(spark):
    a = [{"guid": str(i), "x": v} for i, v in enumerate([1, 2, "3", None, "4", "5"])]
    assert changes(spark, [("f", 1, a), ("f", 2, [{"guid": "9", "x": 1.5}])]) == [("f", 2, "retyped", "x", "x")]


def test_bad_null_and_repeated_records(spark):
    a = ["{not json", None, "[1]", {"guid": "1", "x": 1}, {"guid": "1", "x": 1}]
    got = changes(spark, [("f", 1, a), ("f", 2, ["{}"]), ("f", 3, []), ("f", 4, [{"guid": "1", "x": None}])])
    assert got == [("f", 2, "removed", "guid", ""), ("f", 2, "removed", "x", ""), ("f", 4, "added", "", "guid"), ("f", 4, "added", "", "x")]
    assert changes(spark, []) == []


FIELDS = [D.Field("guid", "string"), D.Field("ra", "double", ("RA",)), D.Field("n", "bigint", ("rank",)), D.Field("on", "boolean", ("enabled",)), D.Field("order", "array<bigint>", ("oeo",))]


def test_rescue_and_replay(spark):
    records = [
        {"guid": "1", "ra": 1.5, "n": 3, "on": 1, "order": [1, 2], "note": "hi"},
        {"guid": "2", "RA": "04 30 36", "rank": "7", "enabled": False, "oeo": "3,4"},
        {"guid": "3", "ra": "east", "n": None, "order": "x"},
        "broken",
        None,
    ]
    t = D.ingest(raw(spark, [("f", 1, records)]), FIELDS)
    first = {r["guid"]: r for r in t.collect()}
    assert json.loads(first["1"][D.RESCUED]) == {"note": "hi", "on": 1} and first["1"]["on"] is None and first["1"]["ra"] == 1.5
    assert json.loads(first["3"][D.RESCUED]) == {"ra": "east", "n": None, "order": "x"}
    assert first["2"]["ra"] is None and json.loads(first["2"][D.RESCUED]) == {"RA": "04 30 36", "enabled": False, "oeo": "3,4", "rank": "7"}
    assert first["1"]["raw_guid"] == "clash"
    p = D.promote(t, FIELDS).collect()
    two = next(r for r in p if r["guid"] == "2")
    assert (two["ra"], two["n"], two["on"], list(two["order"]), two[D.RESCUED]) == (4.51, 7, False, [3, 4], None)
    one = next(r for r in p if r["guid"] == "1")
    assert one["on"] is True and one[D.RESCUED] == '{"note":"hi"}'
    three = next(r for r in p if r["guid"] == "3")
    assert json.loads(three[D.RESCUED]) == {"ra": "east", "order": "x"}
    broken = [r[D.RESCUED] for r in p if r["guid"] is None]
    assert sorted(broken, key=str) == sorted([None, '{"_corrupt":"broken"}'], key=str)
    # replaying again changes nothing
    again = D.promote(D.promote(t, FIELDS), FIELDS)
    assert sorted(map(str, again.collect())) == sorted(map(str, p))
