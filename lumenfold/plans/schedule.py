"""Queries over schedules, plans and their copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import names as N
from lumenfold.operators import merge3 as M
from lumenfold.operators import planning as P
from lumenfold.plans.problems import PLAN_DOUBLES, PLAN_FIELDS, _one
from lumenfold.plans.registry import Registry
from lumenfold.session import read

registry = Registry()
query = registry.query

MERGED = [M.MergeField(f, f in PLAN_DOUBLES) for f in PLAN_FIELDS]


def _once(df: DataFrame) -> DataFrame:
    """The newest of rows that were loaded twice."""
    rest = [c for c in df.columns if c not in ("plan_id", "row_id")]
    return df.groupBy("plan_id", "row_id").agg(F.max_by(F.struct(*rest), F.coalesce("updated_at", F.lit("1900-01-01").cast("timestamp"))).alias("r")).select("plan_id", "row_id", "r.*")


def _sides(spark: SparkSession, sf: str) -> DataFrame:
    return M.joined(*(_once(read(spark, sf, f"plan_{s}")) for s in ("base", "local", "remote")), ["plan_id", "row_id"], MERGED)


def _same_sql(f: str, a: str, b: str) -> str:
    if f in PLAN_DOUBLES:
        return f'({a}."{f}" is not distinct from {b}."{f}" or coalesce(abs({a}."{f}" - {b}."{f}") <= 0.001, false))'
    return f'({a}."{f}" is not distinct from {b}."{f}")'


MERGE_SQL = f"with {_one('base')}, {_one('local')}, {_one('remote')}\n" + "\nunion all\n".join(
    f"""select l.plan_id, l.row_id, '{f}' as field, case when b.plan_id is null then 'auto_pull' when {_same_sql(f, "l", "b")} then 'auto_pull' when {_same_sql(f, "r", "b")} then 'auto_keep' else 'conflict' end as class
    from l join r using (plan_id, row_id) left join b on b.plan_id = l.plan_id and b.row_id = l.row_id where not {_same_sql(f, "l", "r")} and not (b.plan_id is not null and {_same_sql(f, "l", "b")} and {_same_sql(f, "r", "b")})"""
    for f in PLAN_FIELDS
)


@query("merge_classes", MERGE_SQL)
def merge_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Each differing field of the two copies as pulled, kept or in conflict."""
    return M.field_classes(_sides(spark, sf), ["plan_id", "row_id"], MERGED).select("plan_id", "row_id", "field", "class")


@query(
    "merge_pulled",
    f"with {_one('base')}, {_one('local')}, {_one('remote')} select l.plan_id, l.row_id, "
    + ", ".join(
        f'case when b.plan_id is not null and not {_same_sql(f, "l", "r")} and {_same_sql(f, "l", "b")} and not {_same_sql(f, "r", "b")} then r."{f}" else l."{f}" end as "{f}"'
        for f in PLAN_FIELDS
    )
    + " from l join r using (plan_id, row_id) left join b on b.plan_id = l.plan_id and b.row_id = l.row_id",
)
def merge_pulled(spark: SparkSession, sf: str) -> DataFrame:
    """The local rows after what only the remote side changed was taken over."""
    return M.pulled(_sides(spark, sf), ["plan_id", "row_id"], MERGED)


# a row that is switched off stands for one that nobody has stamped
EXISTING_SQL = "select case when enabled then plan_id || '/' || row_id end as guid, project_name, target_name, filter, plan_id || '/' || row_id as row_key from plan_remote"
INCOMING_SQL = "select distinct plan_id || '/' || row_id as guid, project_name, target_name, filter from plan_local"


@query(
    "upsert_actions",
    f"""with e as ({EXISTING_SQL}), i as ({INCOMING_SQL}), g as (select guid, min(row_key) as target from e where guid is not null group by 1), u as (select i.*, g.target from i left join g using (guid)),
    free as (select project_name, target_name, filter, min(row_key) as target from e where guid is null group by 1, 2, 3), r as (select *, row_number() over (partition by project_name, target_name, filter order by guid) as n from u where target is null)
    select guid, 'update' as action, target from u where target is not null union all
    select r.guid, case when n = 1 and f.target is not null then 'claim' else 'insert' end, case when n = 1 then f.target end from r left join free f on r.project_name = f.project_name and r.target_name = f.target_name and r.filter = f.filter""",
)
def upsert_actions(spark: SparkSession, sf: str) -> DataFrame:
    """What a write of the local rows into the remote table would do."""
    for t in ("plan_remote", "plan_local"):
        read(spark, sf, t).createOrReplaceTempView(t)
    return M.upsert_actions(spark.sql(INCOMING_SQL), spark.sql(EXISTING_SQL), "guid", ["project_name", "target_name", "filter"], "row_key")


IMAGES_SQL = "i as (select distinct * from acquiredimage)"


def _images(spark: SparkSession, sf: str) -> DataFrame:
    """Images, those loaded twice once: by id, since the rows are equal."""
    df = read(spark, sf, "acquiredimage").select("id", "projectid", "targetid", "acquireddate", "filtername", "gradingstatus", "profileid")
    return df.dropDuplicates(["id"])


@query(
    "acquired",
    f"""with {IMAGES_SQL}, t as (select profileid, filtername, max(defaultexposure) as exposure from exposuretemplate where profileid is not null and filtername is not null group by 1, 2)
    select s.id as target_id, i.filtername, count(*) filter (coalesce(p.enablegrader, 0) <> 1 or i.gradingstatus = 1) as frames, round(sum(case when coalesce(p.enablegrader, 0) <> 1 or i.gradingstatus = 1 then coalesce(t.exposure, 300) else 0 end) / 3600, 6) as hours
    from i join scheduler_target s on i.targetid = s.id join project p on s.projectid = p.id left join t on t.profileid = i.profileid and t.filtername = i.filtername group by 1, 2""",
)
def acquired(spark: SparkSession, sf: str) -> DataFrame:
    """Frames and hours per target and filter: accepted ones where a project grades; lengths from the template, if there is one."""
    i = _images(spark, sf)
    s = read(spark, sf, "scheduler_target").select(F.col("id").alias("target_id"), F.col("projectid").alias("project_id"))
    p = read(spark, sf, "project").select(F.col("id").alias("project_id"), "enablegrader")
    t = read(spark, sf, "exposuretemplate").where("profileid is not null and filtername is not null").groupBy("profileid", "filtername").agg(F.max("defaultexposure").alias("exposure"))
    df = i.join(s, i["targetid"] == s["target_id"]).join(p, "project_id").join(t, ["profileid", "filtername"], "left")
    counts = (F.coalesce("enablegrader", F.lit(0)) != 1) | F.coalesce(F.col("gradingstatus") == 1, F.lit(False))
    return df.groupBy("target_id", "filtername").agg(F.count_if(counts).alias("frames"), F.round(F.sum(F.when(counts, F.coalesce("exposure", F.lit(300.0))).otherwise(0.0)) / 3600, 6).alias("hours"))


@query("unused_templates", "select id, filtername from exposuretemplate t where not exists (select 1 from acquiredimage i where i.profileid = t.profileid and i.filtername = t.filtername)")
def unused_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Templates whose filter no image of the profile used."""
    return read(spark, sf, "exposuretemplate").select("id", "filtername", "profileid").join(read(spark, sf, "acquiredimage").select("profileid", "filtername"), ["profileid", "filtername"], "left_anti").select("id", "filtername")


@query(
    "template_groups",
    f"""with {IMAGES_SQL}, u as (select profileid, filtername, count(*) as n from i group by 1, 2), t as (select e.*, coalesce(u.n, 0) as n, case when e.defaultexposure < 60 then 'short' else 'normal' end as kind from exposuretemplate e left join u using (profileid, filtername))
    select profileid, filtername, kind, count(*) as templates, first(id order by n desc, id) as preferred from t group by 1, 2, 3""",
)
def template_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Templates by filter and length, with the one to prefer: most used, then the lowest id."""
    use = _images(spark, sf).groupBy("profileid", "filtername").agg(F.count("*").alias("n"))
    t = read(spark, sf, "exposuretemplate").select("id", "profileid", "filtername", "defaultexposure").join(use, ["profileid", "filtername"], "left")
    t = t.withColumns({"n": F.coalesce("n", F.lit(0)), "kind": F.when(F.col("defaultexposure") < 60, "short").otherwise("normal")})
    return t.groupBy("profileid", "filtername", "kind").agg(F.count("*").alias("templates"), F.min_by("id", F.struct((-F.col("n")).alias("a"), F.col("id").alias("b"))).alias("preferred"))


@query(
    "project_rollup",
    f"""with {IMAGES_SQL}, t as (select projectid as id, count(*) as targets, count(*) filter (active = 1) as active from scheduler_target group by 1), m as (select projectid as id, count(*) as images, count(*) filter (gradingstatus = 1) as accepted from i group by 1)
    select p.id, p.name, coalesce(t.targets, 0) as targets, coalesce(t.active, 0) as active, coalesce(m.images, 0) as images, coalesce(m.accepted, 0) as accepted from project p left join t using (id) left join m using (id)""",
)
def project_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Targets and images of every project: two aggregates, then joins of small results."""
    t = read(spark, sf, "scheduler_target").groupBy(F.col("projectid").alias("id")).agg(F.count("*").alias("targets"), F.count_if(F.col("active") == 1).alias("active"))
    m = _images(spark, sf).groupBy(F.col("projectid").alias("id")).agg(F.count("*").alias("images"), F.count_if(F.col("gradingstatus") == 1).alias("accepted"))
    return read(spark, sf, "project").select("id", "name").join(t, "id", "left").join(m, "id", "left").na.fill(0, ["targets", "active", "images", "accepted"])


@query(
    "project_constraints",
    """with s as (select name, state, count(*) as n from project group by 1, 2), m as (select name, first(state order by n desc, state) as state from s where state is not null group by 1)
    select p.name, max(minimumaltitude) as min_altitude, min(nullif(meridianwindow, 0)) as meridian, max(priority) as priority, max(minimumtime) as minimum_time, any_value(m.state) as state,
    count(distinct minimumaltitude) > 1 as altitudes_differ, count(*) as projects from project p left join m using (name) group by 1""",
)
def project_constraints(spark: SparkSession, sf: str) -> DataFrame:
    """One set of constraints for all projects of a name: the strictest, and the commonest state."""
    p = read(spark, sf, "project")
    s = p.where("state is not null").groupBy("name", "state").count().groupBy("name").agg(F.min_by("state", F.struct((-F.col("count")).alias("n"), F.col("state").alias("s"))).alias("state"))
    g = p.groupBy("name").agg(F.max("minimumaltitude").alias("min_altitude"), F.min(F.when(F.col("meridianwindow") != 0, F.col("meridianwindow"))).alias("meridian"), F.max("priority").alias("priority"), F.max("minimumtime").alias("minimum_time"), (F.count_distinct("minimumaltitude") > 1).alias("altitudes_differ"), F.count("*").alias("projects"))
    return g.join(s, g["name"].eqNullSafe(s["name"]), "left").drop(s["name"])


GOALS_SQL = """
g as (select *, coalesce(case when unit = 'fr' then target_frames * template_sub_s / 3600.0 else target_hours end, 0) as goal, coalesce(actual_hours, 0) as actual from plan_row),
f as (select plan_id, filter, sum(goal) as goal_hours, sum(actual) as actual_hours, sum(least(goal, actual)) as credited_hours, sum(greatest(0, goal - actual)) as left_hours, count(*) as rows from g group by 1, 2)
"""


def _r(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c.endswith("_hours")})


@query("plan_filters", f"with {GOALS_SQL} select plan_id, filter, round(goal_hours, 6) as goal_hours, round(actual_hours, 6) as actual_hours, round(credited_hours, 6) as credited_hours, round(left_hours, 6) as left_hours, rows from f")
def plan_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Goal, actual, credited and missing hours per plan and filter."""
    return _r(P.by_filter(read(spark, sf, "plan_row")))


@query(
    "plan_progress",
    f"""with {GOALS_SQL}, p as (select plan_id, sum(goal_hours) as goal_hours, sum(credited_hours) as credited_hours, sum(left_hours) as left_hours, bool_and(goal_hours > 0 and left_hours <= 0) as finished from f group by 1)
    select plan_id, round(goal_hours, 6) as goal_hours, round(credited_hours, 6) as credited_hours, round(left_hours, 6) as left_hours, finished, round(case when goal_hours > 0 then least(1, credited_hours / goal_hours) end, 6) as done from p""",
)
def plan_progress(spark: SparkSession, sf: str) -> DataFrame:
    """How far each plan is."""
    return _r(P.by_plan(P.by_filter(read(spark, sf, "plan_row")))).withColumn("done", F.round("done", 6))


@query(
    "goal_frames",
    """select plan_row_id, greatest(1, cast(ceil(round(target_hours * 3600.0 / nullif(template_sub_s, 0), 9)) as bigint)) as frames from plan_row where unit = 'h' and target_hours is not null and template_sub_s is not null""",
)
def goal_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Exposures that each goal of hours takes."""
    df = read(spark, sf, "plan_row").where("unit = 'h' and target_hours is not null and template_sub_s is not null")
    return df.select("plan_row_id", P.frames_wanted(F.col("target_hours"), F.col("template_sub_s")).alias("frames"))


@query("goal_round_trip", "select count(*) as rows, count(*) as back from plan_row where unit = 'fr' and target_frames > 0 and template_sub_s > 0")
def goal_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Frame goals as hours that come back to the same frames: all of them."""
    df = read(spark, sf, "plan_row").where("unit = 'fr' and target_frames > 0 and template_sub_s > 0")
    back = P.frames_wanted(P.hours_for_frames(F.col("target_frames"), F.col("template_sub_s")), F.col("template_sub_s")) == F.col("target_frames")
    return df.agg(F.count("*").alias("rows"), F.count_if(back).alias("back"))


@query(
    "mosaic_panels",
    """with f as (select target_id as id, center_ra_deg as a, center_dec_deg as d, footprint_arcmin[1] as w, footprint_arcmin[2] as h, radians(coalesce(rotation_deg, 0)) as t from library_target where footprint_arcmin is not null),
    p as (select f.*, r.row, c.col, (c.col - 0.5) * w / 60.0 * 0.85 as x, (0.5 - r.row) * h / 60.0 * 0.85 as y from f, (values (0), (1)) r(row), (values (0), (1)) c(col))
    select id, row, col, round(a + (x * cos(t) + y * sin(t)) / greatest(1e-6, cos(radians(d))), 6) as panel_ra_deg, round(d + y * cos(t) - x * sin(t), 6) as panel_dec_deg from p""",
)
def mosaic_panels(spark: SparkSession, sf: str) -> DataFrame:
    """Panels of a two by two mosaic over every field, overlapping by 15 percent."""
    size = F.col("footprint_arcmin")
    f = read(spark, sf, "library_target").where("footprint_arcmin is not null").select(F.col("target_id").alias("id"), F.col("center_ra_deg").alias("ra_deg"), F.col("center_dec_deg").alias("dec_deg"), size[0].alias("w_arcmin"), size[1].alias("h_arcmin"), "rotation_deg")
    p = P.mosaic_panels(f, F.lit(2), F.lit(2), F.lit(15.0))
    return p.withColumns({c: F.round(c, 6) for c in ("panel_ra_deg", "panel_dec_deg")})


@query(
    "rig_verdicts",
    """with p as (select target_id as id, fov_arcmin[1] * 60 / 4000 as scale, fov_arcmin[1] as w, fov_arcmin[2] as h, coalesce(map_keys(filters), []) as filters from library_target),
    q as (select id, 1.0 / scale as ratio, least(66.0 / w, 44.0 / h) as worst, list_sort(list_filter(filters, lambda f: not list_contains(['B', 'G', 'Ha', 'L', 'OIII', 'R'], f))) as missing, list_has_any(filters, ['OIII']) as dual, w, h, scale from p)
    select id, round(ratio, 4) as scale_ratio, round(worst, 4) as field_ratio, missing, case when not coalesce(scale > 0 and w > 0 and h > 0, false) then 'unconstrained' when abs(ratio - 1) > 0.15 or worst < 0.8 or len(missing) > 0 then 'no_fit' when worst < 0.9 or dual then 'fit_with_warnings' else 'fit' end as verdict from q""",
)
def rig_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """How well one rig fits every field."""
    w, h = F.try_element_at("fov_arcmin", F.lit(1)), F.try_element_at("fov_arcmin", F.lit(2))
    p = read(spark, sf, "library_target").select(F.col("target_id").alias("id"), (w * 60 / 4000).alias("scale"), w.alias("w"), h.alias("h"), F.coalesce(F.map_keys("filters"), F.array().cast("array<string>")).alias("filters"))
    return P.rig_verdicts(p, 1.0, 66.0, 44.0, {"L": "direct", "R": "direct", "G": "direct", "B": "direct", "Ha": "direct", "OIII": "dual"})


@query("repeated_guids", "select guid, count(*) as rows from scheduler_target where guid is not null group by 1 having count(*) > 1")
def repeated_guids(spark: SparkSession, sf: str) -> DataFrame:
    """Identifiers that several targets carry: the check before a push."""
    return read(spark, sf, "scheduler_target").where("guid is not null").groupBy("guid").agg(F.count("*").alias("rows")).where("rows > 1")


@query(
    "stable_ids",
    """with h as (select id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat_ws('|', cast(len(profileid) as varchar), profileid, cast(len(name) as varchar), name))) as h from project)
    select id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (position(substr(h, 17, 1) in '0123456789abcdef') - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as stable_id from h""",
)
def stable_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Name-based identifiers of projects: the same on every run."""
    name = F.concat_ws("|", F.length("profileid").cast("string"), "profileid", F.length("name").cast("string"), "name")
    return read(spark, sf, "project").select("id", N.uuid5("6ba7b8119dad11d180b400c04fd430c8", name).alias("stable_id"))


@query("plan_documents", "select plan_id, count(*) as rows, string_agg(row_id || ':' || coalesce(filter, ''), ',' order by plan_row_id) as rows_text from plan_row group by 1")
def plan_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Plans as documents with their rows nested, in order."""
    rows = F.array_sort(F.collect_list(F.struct("plan_row_id", "row_id", "filter")))
    df = read(spark, sf, "plan_row").groupBy("plan_id").agg(F.count("*").alias("rows"), rows.alias("filter_rows"))
    return df.select("plan_id", "rows", F.array_join(F.transform("filter_rows", lambda r: F.concat(r["row_id"], F.lit(":"), F.coalesce(r["filter"], F.lit("")))), ",").alias("rows_text"))


YEAR_SQL = """
with m as (select unnest(generate_series(1, 12)) as month), t as (select month, date_diff('day', date '2000-01-01', make_date(2026, month, 15)) + i * 15 / 1440.0 as d from m, (select unnest(generate_series(0, 96)) as i)),
e as (select month, d, radians(280.460 + d * 0.9856474 + sin(radians(357.528 + d * 0.9856003)) * 1.915 + sin(radians(357.528 + d * 0.9856003) * 2) * 0.020) as lon, radians(23.439 - d * 0.0000004) as eps, 280.46061837 + d * 360.98564736629 - 105.5 as lst from t),
s as (select *, degrees(atan2(cos(eps) * sin(lon), cos(lon))) as sa, asin(sin(eps) * sin(lon)) as sd from e),
dark as (select month, d, lst from s where degrees(asin(sin(sd) * sin(radians(32.9)) + cos(sd) * cos(radians(32.9)) * cos(radians(lst - sa)))) < -18),
f as (select target_id, radians(center_ra_deg) as a, radians(center_dec_deg) as q from library_target where center_ra_deg is not null and center_dec_deg is not null),
v as (select target_id, month, lst, radians(d / 36525.0 * 0.5567530) as z, d / 36525.0 * 1.2812323 as mm, cos(q) * cos(a) as x, cos(q) * sin(a) as y, sin(q) as w from f, dark),
p as (select target_id, month, lst - degrees(atan2(y, x * cos(z) - w * sin(z))) - mm as h, asin(greatest(-1, least(1, x * sin(z) + w * cos(z)))) as dec from v),
alt as (select target_id, month, degrees(asin(greatest(-1, least(1, sin(dec) * sin(radians(32.9)) + cos(dec) * cos(radians(32.9)) * cos(radians(h)))))) as alt from p),
g as (select target_id, month, max(alt) as peak, count(*) filter (alt >= 30) * 0.25 as hours from alt group by 1, 2)
select target_id, month, case when peak is null or peak < 30 then 'not_visible' when hours < 1 then 'partial' when peak >= 60 and hours >= 3 then 'great' when peak >= 45 and hours >= 2 then 'good' else 'fair' end as label,
  round(peak, 2) as peak_alt_deg, cast(round(coalesce(hours, 0), 2) as double) as hours_above_min from f cross join m left join g using (target_id, month)
"""


@query("year_visibility", YEAR_SQL)
def year_visibility(spark: SparkSession, sf: str) -> DataFrame:
    """Visibility of every field over a year from one site."""
    t = read(spark, sf, "library_target").where("center_ra_deg is not null and center_dec_deg is not null").select("target_id", F.col("center_ra_deg").alias("ra_deg"), F.col("center_dec_deg").alias("dec_deg"))
    return P.year_visibility(t, 2026, 32.9, -105.5, 30.0)


@query(
    "visibility_trend",
    f"""with y as ({YEAR_SQL}), r as (select *, list_position(['not_visible', 'partial', 'fair', 'good', 'great'], label) - 1 as rank from y)
    select target_id, max(rank * 100 + hours_above_min) filter (month = 6) as now, sum(rank * 100 + hours_above_min) filter (month in (7, 8, 9)) as season, min((month + 6) % 12) filter (rank >= 3) as months_until_good from r group by 1""",
)
def visibility_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Score of the month, of the season and the months until a field is good."""
    return P.trend(year_visibility(spark, sf), 6)
