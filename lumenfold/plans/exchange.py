"""Queries of exchanging plans and reporting on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import names as N
from lumenfold.operators import exchange as X
from lumenfold.operators import planning as P
from lumenfold.plans.registry import Registry
from lumenfold.session import read

registry = Registry()
query = registry.query

KEY = ("plan_id", "row_id")


def _one(spark: SparkSession, sf: str, side: str) -> DataFrame:
    """One row a key of a copy of the plans: the newest."""
    df = read(spark, sf, f"plan_{side}")
    rest = [c for c in df.columns if c not in KEY]
    newest = F.struct(F.col("updated_at").isNotNull().alias("known"), "updated_at")
    return df.groupBy(*KEY).agg(F.max_by(F.struct(*rest), newest).alias("r")).select(*KEY, "r.*")


def _one_sql(side: str) -> str:
    return f"{side[0]} as (select * from plan_{side} qualify row_number() over (partition by plan_id, row_id order by updated_at desc nulls last) = 1)"


@query(
    "plan_goals",
    """with r as (select plan_id, trim("filter") as "filter", plan_row_id, unit, template_sub_s, actual_hours, round(coalesce(case when unit = 'fr' then target_frames * template_sub_s / 3600.0 else target_hours end, 0), 4) as goal from plan_row where trim("filter") <> '')
    select plan_id, "filter", first(goal order by coalesce(unit, 'h') = 'fr', plan_row_id) as target_hours, first(template_sub_s order by coalesce(unit, 'h') = 'fr', plan_row_id) as sub_exposure_s, first(actual_hours order by coalesce(unit, 'h') = 'fr', plan_row_id) as actual_hours from r group by 1, 2""",
)
def plan_goals(spark: SparkSession, sf: str) -> DataFrame:
    """The goal of each plan and filter as older clients read it."""
    return X.goals_view(read(spark, sf, "plan_row"), ["plan_row_id"])


_WANTED = "case when unit = 'fr' then coalesce(target_frames, 0) else greatest(1, cast(ceil(round(target_hours * 3600.0 / nullif(template_sub_s, 0), 9)) as bigint)) end"


@query(
    "goals_unfloored",
    f"""with {_one_sql("local")}, {_one_sql("remote")}, w as (select l.plan_id, l.row_id, cast(l.target_frames as bigint) as mine, cast(r.target_frames as bigint) as theirs from l join r using (plan_id, row_id) where l.target_frames is not null and r.target_frames is not null)
    select plan_id, row_id, mine, theirs, case when mine > 0 and greatest(mine, 60) <> mine and theirs = greatest(mine, 60) then mine else theirs end as goal from w""",
)
def goals_unfloored(spark: SparkSession, sf: str) -> DataFrame:
    """Goals that came back, without the floor of 60 frames under which none was sent."""
    mine = _one(spark, sf, "local").select(*KEY, F.col("target_frames").cast("bigint").alias("mine")).where("mine is not null")
    theirs = _one(spark, sf, "remote").select(*KEY, F.col("target_frames").cast("bigint").alias("theirs")).where("theirs is not null")
    return mine.join(theirs, list(KEY)).withColumn("goal", X.unfloored(F.col("theirs"), F.col("mine"), F.lit(60)))


@query(
    "accepted_to_write",
    f"""with r as (select plan_row_id, template_sub_s as sub, actual_hours * 3600 as seconds, cast({_WANTED} as bigint) as wanted, unit, target_hours, target_frames from plan_row where template_sub_s > 0),
    s as (select *, cast(floor(seconds / sub) as bigint) as frames, coalesce(case when unit = 'fr' then target_frames * sub else target_hours * 3600 end <= seconds, false) as complete from r)
    select plan_row_id, cast(case when seconds >= 0 and frames >= 0 then case when complete then greatest(floor(seconds / sub + 1e-6), wanted) else greatest(0, least(floor(seconds / sub + 1e-6), wanted - greatest(1, 30 - frames))) end end as bigint) as accepted from s""",
)
def accepted_to_write(spark: SparkSession, sf: str) -> DataFrame:
    """The accepted exposures that a scheduler is told for each row."""
    r = read(spark, sf, "plan_row").where("template_sub_s > 0").withColumn("seconds", F.col("actual_hours") * 3600)
    r = r.withColumn("wanted", F.when(F.col("unit") == "fr", F.coalesce(F.col("target_frames").cast("bigint"), F.lit(0))).otherwise(P.frames_wanted(F.col("target_hours"), F.col("template_sub_s"))))
    goal = F.when(F.col("unit") == "fr", F.col("target_frames") * F.col("template_sub_s")).otherwise(F.col("target_hours") * 3600)
    frames = F.floor(F.col("seconds") / F.col("template_sub_s"))
    return r.select("plan_row_id", X.accepted_to_write(F.col("seconds"), frames, F.col("template_sub_s"), goal <= F.col("seconds"), F.col("wanted"), F.lit(30)).alias("accepted"))


@query(
    "figures_kept",
    f"""with {_one_sql("local")}, {_one_sql("base")}, j as (select l.*, b.plan_id is not null and l."filter" is not distinct from b."filter" and l.template is not distinct from b.template as kept, b.target_hours as h, b.target_frames as f from l left join b using (plan_id, row_id))
    select plan_id, row_id, kept, case when kept then h else target_hours end as target_hours, case when kept then f else target_frames end as target_frames from j""",
)
def figures_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that are saved take the stored figures where row, filter and template are the same."""
    d = X.kept_figures(_one(spark, sf, "local"), _one(spark, sf, "base"), KEY, ["filter", "template"], ["target_hours", "target_frames"])
    return d.select(*KEY, "kept", "target_hours", "target_frames")


@query(
    "reports_taken",
    f"""with {_one_sql("local")}, {_one_sql("remote")} select r.plan_id, r.row_id, case when l.plan_id is null then 'unknown' when l."filter" is not distinct from r."filter" and l.template is not distinct from r.template then 'taken' else 'changed' end as outcome from r left join l using (plan_id, row_id)""",
)
def reports_taken(spark: SparkSession, sf: str) -> DataFrame:
    """Which of the remote side's rows are taken, and which are about something else by now."""
    return X.reported(_one(spark, sf, "local"), _one(spark, sf, "remote"), KEY, ["filter", "template"])


MASKED = ("state", "priority", "project_name", "template")


@query(
    "write_mask",
    f"""with {_one_sql("local")}, {_one_sql("base")}, j as (select l.plan_id, l.row_id, b.plan_id is null as new, {', '.join(f'l.{f} as {f}, b.plan_id is null or l.{f} is distinct from b.{f} as w_{f}' for f in MASKED)} from l left join b using (plan_id, row_id))
    select plan_id, row_id, case when new then 'insert' when {' or '.join(f'w_{f}' for f in MASKED)} then 'update' else 'none' end as action, concat_ws(',', {', '.join(f"case when w_{f} then '{f}' end" for f in MASKED)}) as writes, {', '.join(f'case when w_{f} then {f} end as {f}' for f in MASKED)} from j""",
)
def write_mask(spark: SparkSession, sf: str) -> DataFrame:
    """The columns that a push would write of each row."""
    d = X.write_mask(_one(spark, sf, "local"), _one(spark, sf, "base"), KEY, MASKED)
    return d.withColumn("writes", F.array_join("writes", ","))


@query(
    "guids_restamped",
    """with t as (select id, guid, lower(regexp_replace(guid, '[^0-9a-zA-Z]', '', 'g')) as plain from scheduler_target), m as (select * from t where guid is not null and guid <> plain and plain not in (select guid from t where guid is not null))
    select min(id) as id, first(guid order by id) as guid, plain from m group by plain""",
)
def guids_restamped(spark: SparkSession, sf: str) -> DataFrame:
    """Targets whose identifier moves to its plain form."""
    t = read(spark, sf, "scheduler_target").select("id", "guid", F.lower(F.regexp_replace("guid", "[^0-9a-zA-Z]", "")).alias("plain"))
    return X.restamped(t, "guid", "plain", "id")


@query(
    "scheduling_text",
    f"""with {_one_sql("local")}, g as (select plan_id, list_sort(list(distinct row_id) filter (not coalesce(enabled, true))) as o, count(distinct row_id) as n from l group by 1)
    select plan_id, case when o is null then 'on' when len(o) = n then 'off' else 'off: ' || array_to_string(o, ', ') end as scheduling from g""",
)
def scheduling_text(spark: SparkSession, sf: str) -> DataFrame:
    """Which rows of each plan are switched off, as one text."""
    return X.scheduling_text(_one(spark, sf, "local"), "plan_id", "row_id", "enabled")


@query(
    "rows_scheduled",
    f"""with {_one_sql("local")} select plan_id, row_id from l where coalesce(state <> 'inactive' and state <> 'parked', true) and coalesce(enabled, true)""",
)
def rows_scheduled(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that are scheduled: neither their plan nor they themselves are switched off."""
    return _one(spark, sf, "local").where(X.switched_on(~F.col("state").isin("inactive", "parked"), F.col("enabled"))).select(*KEY)


@query(
    "links_in_scope",
    """with l as (select s.id, list(distinct p.profileid) filter (p.profileid is not null) as links from scheduler_target s left join project p on p.id = s.projectid group by 1), f as (select min(profileid) as p from project)
    select id from l, f where coalesce(len(links), 0) = 0 or list_contains(links, p)""",
)
def links_in_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Targets that are linked to the first profile, or to none."""
    project = read(spark, sf, "project")
    first = project.agg(F.min("profileid")).first()[0] or ""
    linked = read(spark, sf, "scheduler_target").join(project.select(F.col("id").alias("projectid"), "profileid"), "projectid", "left")
    # a target has one project
    return linked.groupBy("id").agg(F.collect_set("profileid").alias("links")).where(X.in_scope(F.col("links"), first)).select("id")


@query(
    "plan_list",
    """with p as (select plan_id, min(coalesce(state, 'active')) as state, min(target_name) as target_name, min(project_name) as project_name from plan_local group by 1)
    select plan_id from p where state in ('active', 'inactive') and (lower(target_name) like '%an%' or lower(project_name) like '%an%' or lower(plan_id) like '%an%') and (project_name is null or project_name not in (select name from project where state = 2 and name is not null))""",
)
def plan_list(spark: SparkSession, sf: str) -> DataFrame:
    """Plans of two states with a text in their names, without those of hidden projects."""
    plans = read(spark, sf, "plan_local").groupBy("plan_id").agg(F.min(F.coalesce("state", F.lit("active"))).alias("state"), F.min("target_name").alias("target_name"), F.min("project_name").alias("project_name"))
    hidden = read(spark, sf, "project").where("state = 2").select(F.col("name").alias("project_name")).distinct()
    found = plans.where(X.plan_matches(["active", "inactive"], "an", F.col("state"), [F.col("target_name"), F.col("project_name"), F.col("plan_id")]))
    return found.join(hidden, "project_name", "left_anti").select("plan_id")


CHIPS = {"imaging_target": "imaging", "progress_report": "imaging", "autofocus_summary": "site", "meridian_flip": "site", "safety": "site", "session_start": "site", "session_end": "site", "transfer_landed": "files", "upload_failed": "files"}


@query(
    "log_visible",
    f"""with c as (select delivery_id, severity, case {' '.join(f"when type = '{t}' then '{c}'" for t, c in CHIPS.items())} else 'plans' end as chip from activity_log)
    select delivery_id, chip from c where coalesce(severity = 'error', false) or chip not in ('site', 'files')""",
)
def log_visible(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the log that show with two chips switched off."""
    return X.visible_rows(read(spark, sf, "activity_log").select("delivery_id", "type", "severity"), CHIPS, ["site", "files"]).select("delivery_id", "chip")


@query(
    "plan_problems",
    """select plan_id, row_id, updated_at, case when coalesce(trim(project_name), '') = '' then 'no project' when coalesce(trim(target_name), '') = '' then 'no target' when coalesce(priority not in ('low', 'normal', 'high'), false) then 'priority'
      when coalesce(center_ra_deg < 0 or center_ra_deg >= 360 or center_dec_deg < -90 or center_dec_deg > 90, false) then 'position' when (min_altitude_deg is null) then 'no altitude' when coalesce(template_sub_s <= 0, false) then 'exposure'
      when (target_hours is null) = (target_frames is null) then 'goal' when coalesce(target_hours > 20, false) then 'long goal' end as problem from plan_local where problem is not null""",
)
def plan_problems(spark: SparkSession, sf: str) -> DataFrame:
    """The first rule that each row of the plans breaks."""
    c = F.col
    blank = lambda n: F.coalesce(F.btrim(n), F.lit("")) == ""
    rules = {
        "no project": blank("project_name"),
        "no target": blank("target_name"),
        "priority": ~c("priority").isin("low", "normal", "high"),
        "position": (c("center_ra_deg") < 0) | (c("center_ra_deg") >= 360) | (c("center_dec_deg") < -90) | (c("center_dec_deg") > 90),
        "no altitude": c("min_altitude_deg").isNull(),
        "exposure": c("template_sub_s") <= 0,
        "goal": c("target_hours").isNull() == c("target_frames").isNull(),
        "long goal": c("target_hours") > 20,
    }
    return X.first_problem(read(spark, sf, "plan_local"), rules).select(*KEY, "updated_at", "problem")


@query(
    "shooting_order",
    """with s as (select targetid as id, min(acquireddate) as first_shot from acquiredimage group by 1)
    select t.projectid, t.id, first_shot, row_number() over (partition by t.projectid order by first_shot nulls last, t.id) as place from scheduler_target t left join s using (id) where t.projectid is not null""",
)
def shooting_order(spark: SparkSession, sf: str) -> DataFrame:
    """Targets of each project in the order in which they were first shot."""
    members = read(spark, sf, "scheduler_target").where("projectid is not null").select("projectid", "id")
    shots = read(spark, sf, "acquiredimage").select(F.col("targetid").alias("id"), "acquireddate")
    return X.shooting_order(members, shots, "projectid", "id", "acquireddate").select("projectid", "id", "first_shot", "place")


@query(
    "plans_by_hours_left",
    """with r as (select plan_id, coalesce(case when unit = 'fr' then target_frames * template_sub_s / 3600.0 else target_hours end, 0) - coalesce(actual_hours, 0) as d from plan_row), p as (select plan_id, round(sum(greatest(0, d)), 6) as hours_left from r group by 1)
    select plan_id, hours_left, row_number() over (order by hours_left desc, plan_id) as place from p""",
)
def plans_by_hours_left(spark: SparkSession, sf: str) -> DataFrame:
    """Plans by the work that is left, the most first."""
    from lumenfold.operators.rank import dense_ids

    goal = F.coalesce(P.goal_hours(F.col("unit"), F.col("target_hours"), F.col("target_frames"), F.col("template_sub_s")), F.lit(0.0))
    left = read(spark, sf, "plan_row").groupBy("plan_id").agg(F.round(F.sum(F.greatest(F.lit(0.0), goal - F.coalesce("actual_hours", F.lit(0.0)))), 6).alias("hours_left"))
    return dense_ids(left, [F.col("hours_left").desc(), F.col("plan_id").asc()], "place", 1)


@query(
    "orders_remapped",
    """with o as (select id, list_transform(string_split(unusedoeo, ','), lambda x: cast(trim(x) as bigint)) as refs from scheduler_target where unusedoeo is not null and regexp_matches(unusedoeo, '^\\s*\\d+(\\s*,\\s*\\d+)*\\s*$'))
    select id, array_to_string(list_transform(list_filter(refs, lambda x: x < 8 and x not in (1, 4)), lambda x: x - case when x > 4 then 2 when x > 1 then 1 else 0 end), ',') as refs from o""",
)
def orders_remapped(spark: SparkSession, sf: str) -> DataFrame:
    """Exposure orders after two of eight rows were taken out of the list they refer to."""
    t = read(spark, sf, "scheduler_target").where(F.col("unusedoeo").rlike(r"^\s*\d+(\s*,\s*\d+)*\s*$"))
    refs = F.transform(F.split("unusedoeo", ","), lambda x: F.btrim(x).cast("int"))
    before, after = (F.array(*(F.lit(x).cast("bigint") for x in xs)) for xs in ((10, 11, 12, 13, 14, 15, 16, 17), (10, 12, 13, 15, 16, 17)))
    return t.select("id", F.array_join(X.remapped(refs, before, after).cast("array<string>"), ",").alias("refs"))


@query(
    "reject_reasons",
    """with r as (select coalesce(nullif(trim(rejectreason), ''), 'unknown') as reason, id from acquiredimage where gradingstatus = 2), n as (select *, row_number() over (partition by reason order by id) as i from r)
    select reason, count(*) as rows, array_to_string(list(id order by id) filter (i <= 5), ',') as examples from n group by 1""",
)
def reject_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Rejected exposures by reason, with the first five of each."""
    r = read(spark, sf, "acquiredimage").where("gradingstatus = 2").select(F.coalesce(F.nullif(F.btrim("rejectreason"), F.lit("")), F.lit("unknown")).alias("reason"), "id")
    return X.sampled(r, "reason", "id").select("reason", "rows", F.array_join(F.col("examples").cast("array<string>"), ",").alias("examples"))


@query(
    "library_health",
    """with l as (select target_id, unnest(list_filter([case when coalesce(len(objects), 0) = 0 then 'no objects' end, case when footprint_arcmin is null then 'no size' end, case when corners_icrs is null then 'no corners' end,
      case when coalesce(cardinality(filters), 0) = 0 then 'no filters' end, case when coalesce(len(telescopes), 0) > 1 then 'several telescopes' end, case when abs(center_dec_deg) > 85 then 'near a pole' end], lambda x: x is not null)) as kind from library_target),
    n as (select *, row_number() over (partition by kind order by target_id) as i from l) select kind, count(*) as rows, array_to_string(list(target_id order by target_id) filter (i <= 5), ',') as examples from n group by 1""",
)
def library_health(spark: SparkSession, sf: str) -> DataFrame:
    """What is missing or odd in the library: counters with examples."""
    c = F.col
    empty = lambda n: F.coalesce(F.size(n), F.lit(0)) <= 0
    flags = {"no objects": empty("objects"), "no size": c("footprint_arcmin").isNull(), "no corners": c("corners_icrs").isNull(), "no filters": empty("filters"), "several telescopes": F.size("telescopes") > 1, "near a pole": F.abs("center_dec_deg") > 85}
    d = X.flagged(read(spark, sf, "library_target"), flags, "target_id")
    return d.select("kind", "rows", F.array_join(F.col("examples").cast("array<string>"), ",").alias("examples"))


@query(
    "hours_delta",
    f"""with {_one_sql("base")}, {_one_sql("remote")}, x as (select target_name, "filter", sum(coalesce(target_hours, 0)) as h from b group by 1, 2), y as (select target_name, "filter", sum(coalesce(target_hours, 0)) as h from r group by 1, 2)
    select target_name, "filter", round(coalesce(x.h, 0), 4) as before, round(coalesce(y.h, 0), 4) as after, round(coalesce(y.h, 0) - coalesce(x.h, 0), 4) as delta from x full join y using (target_name, "filter") where abs(coalesce(y.h, 0) - coalesce(x.h, 0)) > 0.05 and target_name is not null and "filter" is not null""",
)
def hours_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Hours per target and filter that changed between two states."""
    named = lambda side: _one(spark, sf, side).where("target_name is not null and filter is not null")
    d = X.totals_delta(named("base"), named("remote"), ["target_name", "filter"], "target_hours", 0.05)
    return d.withColumns({c: F.round(c, 4) for c in ("before", "after", "delta")})


@query(
    "unplaced_hours",
    """with i as (select distinct id, targetid from acquiredimage where gradingstatus <> 2) select round(count(*) * 180 / 3600.0, 4) as hours, count(*) as frames from i join scheduler_target s on s.id = i.targetid where s.ra is null or s."dec" is null""",
)
def unplaced_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Hours of targets without a position; exposures loaded twice count once."""
    images = read(spark, sf, "acquiredimage").where("gradingstatus <> 2").select("id", F.col("targetid").alias("target")).distinct()
    nowhere = read(spark, sf, "scheduler_target").where("ra is null or dec is null").select(F.col("id").alias("target"))
    return images.join(nowhere, "target", "left_semi").agg(F.round(F.count("*") * 180 / 3600.0, 4).alias("hours"), F.count("*").alias("frames"))


@query(
    "fields_representing",
    """with m as (select telescopes[1] as telescope, target_id, footprint_arcmin[1] * footprint_arcmin[2] as area, corners_icrs is not null as solved from library_target where len(telescopes) > 0)
    select telescope, first(target_id order by coalesce(area, -1) desc, not solved, target_id) as target_id from m group by 1""",
)
def fields_representing(spark: SparkSession, sf: str) -> DataFrame:
    """The field that stands for each telescope: the largest, a solved one first."""
    size = F.col("footprint_arcmin")
    m = read(spark, sf, "library_target").where("size(telescopes) > 0").select(F.col("telescopes")[0].alias("telescope"), "target_id", (F.try_element_at(size, F.lit(1)) * F.try_element_at(size, F.lit(2))).alias("area"), F.col("corners_icrs").isNotNull().alias("solved"))
    return X.representative(m, "telescope", [-F.coalesce("area", F.lit(-1.0)), ~F.col("solved"), F.col("target_id")]).select("telescope", "target_id")


_NORM_SQL = "trim(regexp_replace(lower(name), '[\\s_-]+', ' ', 'g'))"
_SLUG_SQL = "trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-')"


@query(
    "gear_seeded",
    f"""with known as (select canon_name as name from filter_canon where canon_name is not null), k as (select {_NORM_SQL} as norm, {_SLUG_SQL} as slug from known), t as (select name, {_NORM_SQL} as norm, {_SLUG_SQL} as slug from exposuretemplate where name is not null),
    n as (select first(name order by name) as name, first(slug order by name) as slug from t where norm not in (select norm from k) group by norm), c as (select slug, count(distinct norm) as taken from k group by 1),
    p as (select name, slug, row_number() over (partition by slug order by name) + coalesce(taken, 0) as i from n left join c using (slug)) select name, case when i = 1 then slug else slug || '-' || i end as slug from p""",
)
def gear_seeded(spark: SparkSession, sf: str) -> DataFrame:
    """Template names that aren't among the reference names yet, with slugs of their own."""
    norm = F.btrim(F.regexp_replace(F.lower("name"), r"[\s_-]+", " "))
    known = read(spark, sf, "filter_canon").select(F.col("canon_name").alias("name"))
    return X.seeded(read(spark, sf, "exposuretemplate").select("name"), known, "name", N.slug(F.col("name")), norm)


@query(
    "target_name_links",
    """with w as (select distinct id as key, lower(regexp_replace(name, '[\\s_-]+', '', 'g')) as n from scheduler_target where name is not null), h as (select distinct target_id as k, lower(regexp_replace(o, '[\\s_-]+', '', 'g')) as n from (select target_id, unnest(objects) as o from library_target) where o is not null),
    p as (select key, min(k) as a, max(k) as b from w join h using (n) group by 1) select cast(s.id as bigint) as key, case when a is null then 'unlinked' when a = b then 'linked' else 'ambiguous' end as link, case when a = b then a end as "to" from (select distinct id from scheduler_target) s left join p on p.key = s.id""",
)
def target_name_links(spark: SparkSession, sf: str) -> DataFrame:
    """Targets by how many library fields share their name."""
    norm = F.lower(F.regexp_replace("name", r"[\s_-]+", ""))
    wanted = read(spark, sf, "scheduler_target").select(F.col("id").cast("bigint").alias("key"), "name")
    known = read(spark, sf, "library_target").select(F.col("target_id").alias("key"), F.explode("objects").alias("name"))
    return X.name_links(wanted, known, "name", "key", norm)


@query(
    "template_usage",
    f"""with {_one_sql("local")}, t as (select name, min(id) as id from exposuretemplate where name is not null group by 1), u as (select template as name, count(*) as rows, count(distinct plan_id) as plans from l where template is not null group by 1)
    select t.name, t.id, coalesce(u.rows, 0) as rows, coalesce(u.plans, 0) as plans from t left join u using (name)""",
)
def template_usage(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows and plans use each template."""
    t = read(spark, sf, "exposuretemplate").where("name is not null").groupBy("name").agg(F.min("id").alias("id"))
    u = _one(spark, sf, "local").where("template is not null").groupBy(F.col("template").alias("name")).agg(F.count("*").alias("rows"), F.count_distinct("plan_id").alias("plans"))
    return t.join(u, "name", "left").na.fill(0, ["rows", "plans"]).select("name", "id", "rows", "plans")


@query(
    "transfers_alive",
    """with r as (select lower(trim("key", ' ' || chr(9))) as key, received_at, delivery_id, type = 'transfer_landed' as done from activity_log where type in ('transfer_landed', 'progress_report') and "key" is not null),
    t as (select key, max(received_at) as received_at, first(coalesce(done, false) order by received_at desc, delivery_id desc) as done from r group by 1), n as (select max(received_at) as now from r)
    select key, received_at, done from t, n where epoch_us(now) - epoch_us(received_at) <= case when done then 10 else 30 end * 60000000 order by received_at desc, key limit 50""",
)
def transfers_alive(spark: SparkSession, sf: str) -> DataFrame:
    """Transfers that still show at the time of the last report."""
    from lumenfold.functions.text import folded

    r = read(spark, sf, "activity_log").where("type in ('transfer_landed', 'progress_report') and key is not null").select(folded("key").alias("key"), "received_at", (F.col("type") == "transfer_landed").alias("done"))
    now = r.agg(F.max("received_at")).first()[0]
    return X.alive(r, "key", "received_at", F.col("done"), F.lit(now))


@query(
    "footprints_widest",
    """with c as (select target_id, fov_arcmin as f, corners_icrs as c from library_target), p as (select target_id, radians(c[i][1]) as a, radians(c[i][2]) as d, i from c, (select unnest(generate_series(1, 4)) as i) where c is not null),
    w as (select p.target_id, max(degrees(atan2(sqrt(power(cos(q.d) * sin(q.a - p.a), 2) + power(cos(p.d) * sin(q.d) - sin(p.d) * cos(q.d) * cos(q.a - p.a), 2)), sin(p.d) * sin(q.d) + cos(p.d) * cos(q.d) * cos(q.a - p.a)))) as w from p join p q using (target_id) group by 1)
    select target_id, round(case when w > 0 then w when len(f) = 2 and list_max(f) > 0 then list_max(f) / 60 else 1.0 end, 6) as degrees from c left join w using (target_id)""",
)
def footprints_widest(spark: SparkSession, sf: str) -> DataFrame:
    """How far each footprint spans."""
    return read(spark, sf, "library_target").select("target_id", F.round(X.widest(F.col("corners_icrs"), F.col("fov_arcmin")), 6).alias("degrees"))


@query(
    "mosaic_extents",
    "select target_id, round(footprint_arcmin[1] * (1 + 2 * 0.85), 6) as width, round(footprint_arcmin[2] * (1 + 1 * 0.85), 6) as height from library_target where footprint_arcmin is not null",
)
def mosaic_extents(spark: SparkSession, sf: str) -> DataFrame:
    """Size of a mosaic of two rows and three columns of each field, overlapping by 15 percent."""
    size = F.col("footprint_arcmin")
    e = X.mosaic_extent(size[0], size[1], F.lit(2), F.lit(3), F.lit(15.0))
    return read(spark, sf, "library_target").where("footprint_arcmin is not null").select("target_id", e.alias("e")).select("target_id", F.round("e.width", 6).alias("width"), F.round("e.height", 6).alias("height"))
