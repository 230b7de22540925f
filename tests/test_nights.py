import datetime as dt
import json
import random
from collections import Counter

from pyspark.sql import functions as F

from lumenfold.operators import nights as N
from lumenfold.streaming.nights import NightStream

SCHEMA = "delivery_id bigint, source string, key string, seq bigint, at timestamp, received_at timestamp, data string, night string"
UTC = dt.timezone.utc


def rows(seed=0, n=400):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 3, 1, tzinfo=UTC)
    first_of = {k: rnd.choice([-30, 5, 60 * 30, 60 * 80, 60 * 200]) for k in range(60)}
    at_of = {k: base + dt.timedelta(minutes=rnd.randint(0, 6000)) for k in range(60)}
    out = []
    for i in range(n):
        k = rnd.randrange(60)
        at = None if k % 17 == 3 else at_of[k]
        received = at_of[k] + dt.timedelta(minutes=first_of[k] + rnd.randint(0, 100))
        out.append((i, rnd.choice(["Plug", " plug", "PLUG\t"]), f"K{k}", rnd.choice([None, 1, 2, 3]), at, received, rnd.choice([None, "{}", "oops", json.dumps({"hours": rnd.random(), "frames": 3})]), "claimed"))
    return out


def brute(rs):
    events = {}
    for d, s, k, seq, at, rec, data, _ in rs:
        if at is None:
            continue
        e = events.setdefault((s.strip(" \t").lower(), k.lower()), [at, rec])
        e[1] = min(e[1], rec)
    found = {"on_time": set(), "correction": set(), "dropped": set()}
    for key, (at, first) in events.items():
        night = (at - dt.timedelta(hours=19)).date()
        close = dt.datetime.combine(night, dt.time(), UTC) + dt.timedelta(hours=43)
        kind = "on_time" if first <= close else "correction" if first <= close + dt.timedelta(hours=72) else "dropped"
        found[kind].add((str(night), *key))
    return found


def test_classes_against_brute_force(spark):
    rs = rows()
    df = spark.createDataFrame(rs, SCHEMA)
    got = N.classify(N.fold(df)).collect()
    want = brute(rs)
    for kind in ("on_time", "correction"):
        assert {(r["night"], r["source"], r["key"]) for r in got if r["arrival"] == kind} == want[kind]
    assert all(want.values())
    late = {(r["night"], r["source"]): r["events"] for r in N.dropped(N.diverted(N.arrivals(df)), N.fold(df)).collect()}
    assert late == dict(Counter((n, s) for n, s, _ in want["dropped"]))


def test_limits_are_inclusive(spark):
    at = dt.datetime(2024, 3, 2, 3, tzinfo=UTC)  # 20:00 on the site's 1 March
    close = dt.datetime(2024, 3, 2, 19, tzinfo=UTC)
    us = dt.timedelta(microseconds=1)
    times = [close, close + us, close + dt.timedelta(hours=72), close + dt.timedelta(hours=72) + us]
    df = spark.createDataFrame([(i, "s", str(i), None, at, t, None, None) for i, t in enumerate(times)], SCHEMA)
    got = {r["key"]: (r["night"], r["arrival"]) for r in N.classify(N.fold(df)).collect()}
    assert got == {"0": ("2024-03-01", "on_time"), "1": ("2024-03-01", "correction"), "2": ("2024-03-01", "correction")}
    assert [r["delivery_id"] for r in N.diverted(N.arrivals(df)).collect()] == [3]


def test_empty_and_null_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert N.totals(N.classify(N.fold(empty))).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None, None, None, None)], SCHEMA)
    assert N.fold(nulls).count() == 0


def test_stream_in_micro_batches_equals_one_run(spark, tmp_path):
    rs = rows(1)
    src = tmp_path / "in"
    for i in range(4):
        spark.createDataFrame(rs[i::4], SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    stream = NightStream(spark, str(tmp_path / "work")).run(str(src), max_files=1)
    whole = N.classify(N.fold(spark.createDataFrame(rs, SCHEMA)))
    norm = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert norm(stream.nights()) == norm(N.totals(whole))
    assert norm(stream.late()) == norm(N.dropped(N.diverted(N.arrivals(spark.createDataFrame(rs, SCHEMA))), whole))
    # the files hold the arrivals of a week in no order: what the watermark had dropped was replayed
    assert stream.disorder > 24
    # a later delivery corrects the night that it belongs to, and only upserts
    at = dt.datetime(2024, 3, 2, 3, tzinfo=UTC)
    more = [(9999, "plug", "late", 1, at, at + dt.timedelta(hours=30), json.dumps({"hours": 1.5, "frames": 7}), None)]
    spark.createDataFrame(more, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    stream.run(str(src))
    whole = N.classify(N.fold(spark.createDataFrame(rs + more, SCHEMA)))
    assert norm(stream.nights()) == norm(N.totals(whole))
    assert stream.state().where(F.col("key") == "late").count() == 1


def test_late_revision_is_diverted(spark, tmp_path):
    at = dt.datetime(2024, 3, 2, 3, tzinfo=UTC)
    limit = dt.datetime(2024, 3, 5, 19, tzinfo=UTC)
    us = dt.timedelta(microseconds=1)
    data = lambda h: json.dumps({"hours": h, "frames": 1})
    rs = [
        (1, "s", "a", 1, at, at, data(1.0), None), (2, "S ", "A", 2, at, limit, data(2.0), None), (3, "s", "a", 3, at, limit + us, data(4.0), None),
        (4, "s", "b", 1, at, limit + us, data(8.0), None), (5, "s", "c", None, at, at, data(16.0), None), (6, "s", "c", 9, at, limit + us, None, None),
    ]
    src = str(tmp_path / "in")
    for i in (5, 2, 0, 1, 3, 4):
        spark.createDataFrame(rs[i : i + 1], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = NightStream(spark, str(tmp_path / "work")).run(src, max_files=2)
    night = stream.nights().collect()
    assert [(r["events"], r["hours"], r["frames"]) for r in night] == [(2, 18.0, 2)]
    assert sorted((r["delivery_id"], r["source"], r["key"]) for r in stream.diverted().collect()) == [(3, "s", "a"), (4, "s", "b"), (6, "s", "c")]
    assert [(r["source"], r["events"]) for r in stream.late().collect()] == [("s", 1)]


def test_late_report_is_withdrawn(spark, tmp_path):
    """An event is first heard of after its limit; then a delivery turns up that had arrived in time."""
    at = dt.datetime(2024, 3, 2, 3, tzinfo=UTC)
    src = str(tmp_path / "in")
    stream = NightStream(spark, str(tmp_path / "work"))
    hour = lambda h: at + dt.timedelta(hours=h)
    spark.createDataFrame([(1, "s", "a", 1, at, hour(200), json.dumps({"hours": 2.0}), None)], SCHEMA).coalesce(1).write.parquet(src)
    stream.run(src)
    assert [r["events"] for r in stream.late().collect()] == [1] and stream.nights().count() == 0
    spark.createDataFrame([(2, "s", "a", 1, at, hour(1), json.dumps({"hours": 2.0}), None)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream.run(src)
    assert stream.late().count() == 0 and [r["hours"] for r in stream.nights().collect()] == [2.0]
    assert [r["arrival"] for r in stream.state().collect()] == ["on_time"]


def test_state_is_bounded_and_files_do_not_matter(spark, tmp_path):
    """A month of nights in files by arrival: only open nights have state, and many small files give what one gives."""
    rnd = random.Random(7)
    base = dt.datetime(2024, 3, 1, 5, tzinfo=UTC)
    rs = []
    for day in range(30):
        for k in range(10):
            at = base + dt.timedelta(days=day, minutes=rnd.randint(0, 300))
            for seq in range(rnd.randint(1, 3)):
                rs.append((len(rs), "Site ", f"d{day}k{k}", seq, at, at + dt.timedelta(hours=rnd.choice([0, 1, 5, 40, 90])), json.dumps({"hours": rnd.random(), "frames": 2}), None))
    rs.append((len(rs), "site", "ahead", 1, base + dt.timedelta(days=4000), base, json.dumps({"hours": 1.0}), None))
    rs.sort(key=lambda r: r[5])
    many, one = str(tmp_path / "many"), str(tmp_path / "one")
    step = len(rs) // 9
    for i in range(0, len(rs), step):
        spark.createDataFrame(rs[i : i + step], SCHEMA).coalesce(1).write.mode("append").parquet(many)
    spark.createDataFrame(rs, SCHEMA).coalesce(1).write.parquet(one)
    a = NightStream(spark, str(tmp_path / "a"), merge_every=3).run(many, max_files=1)
    b = NightStream(spark, str(tmp_path / "b")).run(one)
    norm = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    for what in ("state", "nights", "late", "diverted"):
        assert norm(getattr(a, what)()) == norm(getattr(b, what)())
    whole = N.classify(N.fold(spark.createDataFrame(rs, SCHEMA)))
    assert norm(a.state()) == norm(whole) and whole.count() > 250
    # five nights may be open, and the one of the clock that runs ahead, of 301 events; old deltas are merged and gone
    assert a.disorder == 24 and a.open_states <= 10 * 6 + 1
    assert a._folders("closed") and len(a._folders("merged")) == 1 and len(a._folders("deltas")) < 4


def test_closed_nights_are_not_read_again(spark, tmp_path, monkeypatch):
    """Each batch runs twice, as after a failure: it reads open nights and what it put aside itself, never what others did."""
    rnd = random.Random(8)
    base = dt.datetime(2024, 3, 1, 5, tzinfo=UTC)
    rs = []
    for day in range(60):
        for k in range(5):
            at = base + dt.timedelta(days=day, minutes=rnd.randint(0, 300))
            for seq in range(rnd.randint(1, 3)):
                rs.append((len(rs), "site", f"d{day}k{k}", seq, at, at + dt.timedelta(hours=rnd.choice([0, 1, 5, 40, 90])), json.dumps({"hours": rnd.random(), "frames": 2}), None))
    rs.sort(key=lambda r: r[5])
    src, step = str(tmp_path / "in"), len(rs) // 11
    for i in range(0, len(rs), step):
        spark.createDataFrame(rs[i : i + step], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    upsert, read, now, reads = NightStream._upsert, NightStream._read, [], []
    monkeypatch.setattr(NightStream, "_upsert", lambda self, batch, i: (now.append(i), upsert(self, batch, i), upsert(self, batch, i), now.pop()))
    monkeypatch.setattr(NightStream, "_read", lambda self, what, batches: (reads.extend((now[-1], b) for b in batches if now and what == "closed"), read(self, what, batches))[1])
    stream = NightStream(spark, str(tmp_path / "work"), merge_every=2).run(src, max_files=1)
    assert len(stream._folders("closed")) >= 4 and all(i == b for i, b in reads) and reads
    whole = N.classify(N.fold(spark.createDataFrame(rs, SCHEMA)))
    norm = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert norm(stream.nights()) == norm(N.totals(whole)) and norm(stream.state()) == norm(whole)


def test_parts_of_the_state_follow_a_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    for r in rows(4)[:8]:
        spark.createDataFrame([r], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        stream = NightStream(spark, str(tmp_path / "work"))
        assert [stream._parts(src, n) for n in (1, 4, 8, None)] == [max(8, spark.sparkContext.defaultParallelism), 32, 64, 64]
        assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_found_runs_the_upserts(spark, tmp_path, monkeypatch):
    from lumenfold.plans import problems

    ran = []
    upsert = NightStream._upsert
    monkeypatch.setattr(NightStream, "_upsert", lambda self, batch, i: (ran.append(i), upsert(self, batch, i)))
    rs = rows(3)
    for i in range(6):
        spark.createDataFrame(rs[i::6], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "activity_log.parquet"))
    got = {tuple(r) for r in problems.p1_found(spark, str(tmp_path)).collect()}
    assert got == brute(rs)["correction"] and len(ran) >= 2


def test_local_nights_on_days_of_clock_changes(spark):
    from zoneinfo import ZoneInfo

    zone = ZoneInfo("Europe/Berlin")
    base = dt.datetime(2024, 3, 30, 20, tzinfo=UTC)
    times = [base + dt.timedelta(minutes=37 * i) for i in range(60)] + [dt.datetime(2024, 10, 26, 20, tzinfo=UTC) + dt.timedelta(minutes=37 * i) for i in range(60)]
    want = [(t.astimezone(zone).replace(tzinfo=None) - dt.timedelta(hours=12)).date() for t in times]
    df = spark.createDataFrame(list(enumerate(times)), "i int, t timestamp").orderBy("i")
    for session in ("UTC", "America/Denver"):
        spark.conf.set("spark.sql.session.timeZone", session)
        got = [r[0] for r in df.select(N.local_night(F.col("t"), "Europe/Berlin")).collect()]
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert got == want
