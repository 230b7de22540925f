"""Queries of the general training-data problems: late events, repeats, regions, copies and drifting schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.text import folded
from lumenfold.operators import copies, deliveries, drift, sky
from lumenfold.operators import nights as N
from lumenfold.plans.registry import Registry
from lumenfold.session import cut, read
from lumenfold.streaming.nights import NightStream

registry = Registry()
query = registry.query

# ---------------------------------------------------------------- late events

EVENTS_SQL = r"""
with d as (
  select lower(trim("source", ' ' || chr(9))) as source, lower(trim("key", ' ' || chr(9))) as key, "at" as t, received_at as r, seq, delivery_id,
         try_cast(json_extract_string("data", '$.hours') as double) as hours, try_cast(json_extract_string("data", '$.frames') as bigint) as frames
  from activity_log where "at" is not null and received_at is not null and "source" is not null and "key" is not null),
e as (
  select source, key, min(t) as t, min(r) as first_received,
         first(hours order by coalesce(seq, -1) desc, hours is not null desc, r, delivery_id) as hours,
         first(frames order by coalesce(seq, -1) desc, hours is not null desc, r, delivery_id) as frames
  from d group by 1, 2),
n as (
  select *, cast(epoch_us(t) // 3600000000 as bigint) as hour_no, cast(floor((epoch_us(t) - 19 * 3600000000.0) / 86400000000.0) as bigint) as day_no from e),
c as (
  select *, cast(date '1970-01-01' + cast(day_no as integer) as varchar) as night,
         epoch_us(first_received) - (day_no * 24 + 43) * 3600000000 as late_us from n),
k as (select *, case when late_us <= 0 then 'on_time' when late_us <= 72 * 3600000000 then 'correction' else 'dropped' end as arrival from c)
"""


def _stream(spark: SparkSession, sf: str) -> NightStream:
    """The whole stream in micro-batches of a few files, with its upserts and diverted records."""
    return NightStream(spark).run(f"{sf}/activity_log.parquet", max_files=4)


@query("p1_found", EVENTS_SQL + "select night, source, key from k where arrival = 'correction'")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Events that correct a night already closed: the stream's keyed state after everything has arrived."""
    return _stream(spark, sf).state().where("arrival = 'correction'").select("night", "source", "key")


@query(
    "p1_nights",
    EVENTS_SQL + """select night, count(*) as events, count(*) filter (arrival = 'correction') as corrections, round(sum(hours), 4) as hours, cast(sum(frames) as bigint) as frames,
    max(first_received) as last_update from k where arrival <> 'dropped' group by 1""",
)
def p1_nights(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and hours per night as last upserted."""
    return _stream(spark, sf).nights()


@query("p1_dropped", EVENTS_SQL + "select night, source, count(*) as events, max(first_received) as last_received from k where arrival = 'dropped' group by 1, 2")
def p1_dropped(spark: SparkSession, sf: str) -> DataFrame:
    """Events that never came within the limit."""
    return _stream(spark, sf).late()


@query("p1_diverted", EVENTS_SQL + "select delivery_id, night, d.source, d.key, d.r as received_at from d join c on d.source = c.source and d.key = c.key where epoch_us(d.r) - (day_no * 24 + 43) * 3600000000 > 72 * 3600000000")
def p1_diverted(spark: SparkSession, sf: str) -> DataFrame:
    """Late deliveries that were diverted, also those of events known in time."""
    return _stream(spark, sf).diverted()


# ------------------------------------------------------------ repeated messages

MESSAGE_SQL = r"""
with d as (
  select *, row_number() over (partition by lower(trim("source", ' ' || chr(9))), lower(trim("key", ' ' || chr(9))), seq order by received_at, delivery_id) as i from activity_log)
"""


def _message() -> tuple[dict, dict]:
    order = {"received": F.col("received_at"), "delivery": F.col("delivery_id")}
    return {"source": folded("source"), "key": folded("key"), "seq": F.col("seq")}, order


@query("p4_found", MESSAGE_SQL + "select delivery_id from d where i > 1")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries to be removed."""
    return deliveries.split_deliveries(spark, f"{sf}/activity_log.parquet", *_message(), ["delivery_id"], keep=False)


WIDE = ["delivery_id", "batch_id", "source", "key", "seq", "type", "at", "night", "title", "detail", "severity", "refs", "data", "needs_you", "resolve_key", "profileid", "received_at"]


@query("p4_kept", MESSAGE_SQL + "select " + ", ".join(f'"{c}"' for c in WIDE) + " from d where i = 1")
def p4_kept(spark: SparkSession, sf: str) -> DataFrame:
    """The wide rows that stay, read in place against the bitmaps of their files."""
    return deliveries.split_deliveries(spark, f"{sf}/activity_log.parquet", *_message(), WIDE)


# ------------------------------------------------------------- points in regions

P5_SQL = r"""
with sign as (select * from (values (1, -1, -1), (2, -1, 1), (3, 1, 1), (4, 1, -1)) v(i, sx, sy)),
t as (select target_id, center_ra_deg as a0, radians(center_dec_deg) as d0, radians(coalesce(rotation_deg, 0)) as r, footprint_arcmin as f, corners_icrs as c from library_target),
flat as (
  select target_id, i, a0, d0, radians((sx * f[1] * cos(r) + sy * f[2] * sin(r)) / 120) as e, radians((sy * f[2] * cos(r) - sx * f[1] * sin(r)) / 120) as n
  from t, sign where c is null and f is not null and a0 is not null and d0 is not null),
corner as (
  select target_id, i, radians(c[i][1]) as a, radians(c[i][2]) as d from t, sign where c is not null
  union all
  select target_id, i, radians(a0) + atan2(e, cos(d0) - n * sin(d0)), atan2(sin(d0) + n * cos(d0), sqrt(e * e + (cos(d0) - n * sin(d0)) * (cos(d0) - n * sin(d0)))) from flat),
v as (select target_id, i, cos(d) * cos(a) as x, cos(d) * sin(a) as y, sin(d) as z from corner),
-- a convex region with four corners is the union of the triangles between any three of them
tri as (
  select p.target_id, p.x as px, p.y as py, p.z as pz, q.x as qx, q.y as qy, q.z as qz, s.x as sx, s.y as sy, s.z as sz,
         sign(p.x * (q.y * s.z - q.z * s.y) + p.y * (q.z * s.x - q.x * s.z) + p.z * (q.x * s.y - q.y * s.x)) as o
  from v p join v q on p.target_id = q.target_id and p.i < q.i join v s on s.target_id = q.target_id and q.i < s.i),
g as (select candidate_id, cos(radians(dec_deg)) * cos(radians(ra_deg)) as x, cos(radians(dec_deg)) * sin(radians(ra_deg)) as y, sin(radians(dec_deg)) as z
      from gap_candidate where ra_deg is not null and dec_deg is not null)
select distinct candidate_id, target_id from g join tri on
  o * (x * (py * qz - pz * qy) + y * (pz * qx - px * qz) + z * (px * qy - py * qx)) >= 0 and
  o * (x * (qy * sz - qz * sy) + y * (qz * sx - qx * sz) + z * (qx * sy - qy * sx)) >= 0 and
  o * (x * (sy * pz - sz * py) + y * (sz * px - sx * pz) + z * (sx * py - sy * px)) >= 0
"""


@query("p5_found", P5_SQL)
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The footprints that hold each catalogue point."""
    points = read(spark, sf, "gap_candidate").select("candidate_id", "ra_deg", "dec_deg")
    targets = read(spark, sf, "library_target").select("target_id", "center_ra_deg", "center_dec_deg", "footprint_arcmin", "rotation_deg", "corners_icrs")
    return sky.points_in_regions(points, targets)


@query(
    "p5_near",
    """with g as (select candidate_id, cos(radians(dec_deg)) * cos(radians(ra_deg)) as x, cos(radians(dec_deg)) * sin(radians(ra_deg)) as y, sin(radians(dec_deg)) as z
      from gap_candidate where ra_deg is not null and dec_deg is not null),
    t as (select target_id, cos(radians(center_dec_deg)) * cos(radians(center_ra_deg)) as x, cos(radians(center_dec_deg)) * sin(radians(center_ra_deg)) as y, sin(radians(center_dec_deg)) as z
      from library_target where center_ra_deg is not null and center_dec_deg is not null),
    p as (select candidate_id, target_id, degrees(atan2(sqrt(power(g.y * t.z - g.z * t.y, 2) + power(g.z * t.x - g.x * t.z, 2) + power(g.x * t.y - g.y * t.x, 2)), g.x * t.x + g.y * t.y + g.z * t.z)) as sep from g, t)
    select candidate_id, target_id, round(sep, 6) as sep_deg from p where sep <= 0.75""",
)
def p5_near(spark: SparkSession, sf: str) -> DataFrame:
    """All library targets whose centre lies within 45 arcmin of a catalogue point."""
    from lumenfold.functions.sphere import xyz

    points = read(spark, sf, "gap_candidate").select("candidate_id", xyz(F.col("ra_deg"), F.col("dec_deg")).alias("__v"))
    centres = read(spark, sf, "library_target").select("target_id", xyz(F.col("center_ra_deg"), F.col("center_dec_deg")).alias("__c"))
    return sky.sky_join(points, centres, 0.75).select("candidate_id", "target_id", F.round("sep_deg", 6).alias("sep_deg"))


# ------------------------------------------------------------------- two copies

PLAN_FIELDS = ("project_name", "target_name", "state", "priority", "min_altitude_deg", "center_ra_deg", "center_dec_deg", "rotation_deg", "filter", "template", "template_sub_s", "target_hours", "target_frames", "enabled")
PLAN_DOUBLES = ("min_altitude_deg", "center_ra_deg", "center_dec_deg", "rotation_deg", "template_sub_s", "target_hours")
PLAN = copies.DiffSpec(("plan_id", "row_id"), PLAN_FIELDS, newest="updated_at", same={"state": {"parked": "inactive"}})


def _unlike_sql(f: str, a: str, b: str) -> str:
    if f in PLAN_DOUBLES:
        return f'(({a}."{f}" is null) <> ({b}."{f}" is null) or coalesce(abs({a}."{f}" - {b}."{f}") > 0.001, false))'
    if f == "state":
        return f"(replace({a}.state, 'parked', 'inactive') is distinct from replace({b}.state, 'parked', 'inactive'))"
    return f'({a}."{f}" is distinct from {b}."{f}")'


def _one(side: str) -> str:
    return f"{side[0]} as (select * from plan_{side} qualify row_number() over (partition by plan_id, row_id order by updated_at desc nulls last) = 1)"


P6_SQL = f"with {_one('base')}, {_one('local')}, {_one('remote')}, j as (select l.plan_id, l.row_id from l)\n" + "\nunion all\n".join(
    [
        "select plan_id, row_id, '' as field, 'remote' as side from l where not exists (select 1 from r where r.plan_id = l.plan_id and r.row_id = l.row_id)",
        "select plan_id, row_id, '', 'local' from r where not exists (select 1 from l where r.plan_id = l.plan_id and r.row_id = l.row_id)",
    ]
    + [
        f"""select l.plan_id, l.row_id, '{f}', case when b.plan_id is null then 'nobase' when {_unlike_sql(f, "l", "b")} = {_unlike_sql(f, "r", "b")} then 'both' when {_unlike_sql(f, "l", "b")} then 'local' else 'remote' end
        from l join r using (plan_id, row_id) left join b on b.plan_id = l.plan_id and b.row_id = l.row_id where {_unlike_sql(f, "l", "r")}"""
        for f in PLAN_FIELDS
    ]
)


def _plan_differences(spark: SparkSession, sf: str) -> DataFrame:
    return copies.differences(*(read(spark, sf, f"plan_{s}") for s in copies.SIDES), PLAN)


@query("p6_found", P6_SQL)
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Missing rows and differing fields of the two copies, with the side that moved."""
    return _plan_differences(spark, sf).select("plan_id", "row_id", "field", "side")


@query("p6_summary", f"select field, side, count(*) as rows, count(distinct plan_id) as plans from ({P6_SQL}) group by 1, 2")
def p6_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Differences counted by field and side."""
    return _plan_differences(spark, sf).groupBy("field", "side").agg(F.count("*").alias("rows"), F.countDistinct("plan_id").alias("plans"))


# ------------------------------------------------------------- drifting schemas

TARGET_FIELDS = [
    drift.Field("guid", "string"),
    drift.Field("name", "string", ("Name", "targetName")),
    drift.Field("ra", "double", ("RA", "raHours")),
    drift.Field("dec", "double", ("DEC", "decDeg")),
    drift.Field("rotation", "double", ("Rotation", "rot_deg", "positionAngle")),
    drift.Field("roi", "double", ("ROI", "roiPercent")),
    drift.Field("active", "boolean", ("isActive", "enabled")),
    drift.Field("epochcode", "bigint"),
    drift.Field("priority", "bigint", ("Priority", "rank", "prio")),
    drift.Field("unusedOEO", "array<bigint>", ("oeo", "overrideExposureOrder", "exposureOrder")),
]

P7_SQL = r"""
with x as (select feed, file_seq, record, unnest(json_keys(record)) as f from target_raw),
w as (select feed, file_seq, f, json_extract_string(record, '$.guid') as id, json_type(record, '$."' || f || '"') as ty, cast(json_extract(record, '$."' || f || '"') as varchar) as v from x),
y as (select *, case when ty = 'NULL' then null when ty = 'VARCHAR' then 'text' when ty = 'BOOLEAN' then 'boolean' when ty = 'ARRAY' then 'list' when ty = 'OBJECT' then 'object' else 'number' end as kind from w),
k as (select feed, file_seq, f, kind, count(*) as n from y group by all),
s as (select feed, file_seq, f, first(kind order by n desc, kind) filter (kind is not null) as kind from k group by all),
files as (select feed, file_seq, lag(file_seq) over (partition by feed order by file_seq) as before from (select distinct feed, file_seq from target_raw)),
p as (select * from files where before is not null),
gone as (select p.*, s.f from p join s on s.feed = p.feed and s.file_seq = p.before where not exists (select 1 from s t where t.feed = p.feed and t.file_seq = p.file_seq and t.f = s.f)),
new as (select p.*, s.f from p join s on s.feed = p.feed and s.file_seq = p.file_seq where not exists (select 1 from s t where t.feed = p.feed and t.file_seq = p.before and t.f = s.f)),
gv as (select g.feed, g.file_seq, g.f, y.id, list(distinct v) as v from gone g join y on y.feed = g.feed and y.file_seq = g.before and y.f = g.f where kind is not null and id is not null group by all),
nv as (select g.feed, g.file_seq, g.f, y.id, list(distinct v) as v from new g join y on y.feed = g.feed and y.file_seq = g.file_seq and y.f = g.f where kind is not null and id is not null group by all),
a as (select gv.feed, gv.file_seq, gv.f as o, nv.f as n, count(*) as c, count(*) filter (list_has_any(gv.v, nv.v)) as same from gv join nv using (feed, file_seq, id) group by all having same * 2 >= c),
r as (select feed, file_seq, o, n from (
  select *, row_number() over (partition by feed, file_seq, o order by same / c desc, same desc, n) as i, row_number() over (partition by feed, file_seq, n order by same / c desc, same desc, o) as j from a) where i = 1 and j = 1)
select feed, cast(file_seq as bigint) as file_seq, 'renamed' as change, o as old_field, n as new_field from r
union all select feed, file_seq, 'removed', f, '' from gone where (feed, file_seq, f) not in (select (feed, file_seq, o) from r)
union all select feed, file_seq, 'added', '', f from new where (feed, file_seq, f) not in (select (feed, file_seq, n) from r)
union all select p.feed, p.file_seq, 'retyped', s.f, s.f from p join s on s.feed = p.feed and s.file_seq = p.file_seq join s t on t.feed = p.feed and t.file_seq = p.before and t.f = s.f where s.kind <> t.kind
"""


@query("p7_found", P7_SQL)
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Field changes of every file against the one before it in its feed, from the ingested table."""
    table = cut(drift.ingest(read(spark, sf, "target_raw").select("feed", "file_seq", "record"), TARGET_FIELDS))
    return drift.field_changes(table, TARGET_FIELDS)


def target_table(raw: DataFrame) -> DataFrame:
    """One consistent target table: typed columns, the rest rescued; records written twice count once."""
    once = raw.select("raw_id", "feed", "file_seq", "line_no", "record").dropDuplicates(["feed", "file_seq", "line_no", "record"])
    return drift.promote(drift.ingest(once.drop("raw_id"), TARGET_FIELDS), TARGET_FIELDS)


def _pick(f: drift.Field) -> str:
    """The first of the names that holds a non-null value, as JSON text."""
    names = ", ".join(f"""nullif(cast(json_extract(record, '$."{a}"') as varchar), 'null')""" for a in (f.name, *f.aliases))
    return f"coalesce({names})"


def _sexagesimal(v: str) -> str:
    t = f"trim({v}, '\"')"
    parts = f"string_split({t}, ' ')"
    return f"coalesce(try_cast({t} as double), cast({parts}[1] as double) + cast({parts}[2] as double) / 60 + cast({parts}[3] as double) / 3600)"


P7_TABLE_SQL = f"""
with once as (select distinct feed, file_seq, line_no, record from target_raw),
t as (select feed, file_seq, line_no, {", ".join(f'{_pick(f)} as "{f.name}_j"' for f in TARGET_FIELDS)}, record from once)
select feed, file_seq, line_no, trim(guid_j, '"') as guid, trim(name_j, '"') as name, round({_sexagesimal("ra_j")}, 6) as ra, round(cast("dec_j" as double), 6) as dec,
  round(cast(rotation_j as double), 6) as rotation, round(cast(trim(roi_j, '"') as double), 6) as roi, active_j in ('1', 'true') as active, cast(trim(epochcode_j, '"') as bigint) as epochcode,
  cast(trim(priority_j, '"') as bigint) as priority, trim("unusedOEO_j", '"[]') as unused_oeo,
  cast(len(list_filter(json_keys(record), lambda k: k in ('note', 'comments', 'remark') and json_type(record, '$.' || k) <> 'NULL')) as bigint) as rescued
from t
"""


@query("p7_table", P7_TABLE_SQL)
def p7_table(spark: SparkSession, sf: str) -> DataFrame:
    """The consistent table, with the number of fields that stay rescued."""
    t = target_table(read(spark, sf, "target_raw"))
    r6 = lambda c: F.round(c, 6).alias(c)
    oeo = F.array_join(F.col("unusedOEO").cast("array<string>"), ",").alias("unused_oeo")
    rescued = F.coalesce(F.size(F.json_object_keys(drift.RESCUED)), F.lit(0)).cast("bigint").alias("rescued")
    return t.select("feed", "file_seq", "line_no", "guid", "name", r6("ra"), r6("dec"), r6("rotation"), r6("roi"), "active", "epochcode", "priority", oeo, rescued)
