"""Queries over derived archive frames: normalisation and hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import names as N
from lumenfold.operators import hours as H
from lumenfold.plans import views as V
from lumenfold.plans.registry import Registry

registry = Registry()
query = registry.query


def normalised(frames: DataFrame) -> DataFrame:
    """Frames with canonical filter, telescope, camera and rig."""
    df = N.by_values(frames, {"raw_filter": ("filter", N.canonical_filter), "raw_scope": ("telescope", N.telescope_name), "raw_camera": ("camera", N.camera_name)})
    return df.withColumn("rig_key", N.rig_key(F.col("telescope"), F.col("camera")))


def members(frames: DataFrame) -> DataFrame:
    """Frames as members of targets: masters and folder blocks with their hours."""
    master = F.col("is_master")
    df = normalised(frames)
    return df.select(
        "target_id", F.when(master, "master").otherwise("folder_sub").alias("role"), F.concat_ws("/", "bucket", "file_name").alias("path"), "filter", "colour", "rig_key",
        F.when(master & (F.col("n_subs") <= 1), F.col("exptime") / 3600).otherwise(F.col("exptime") * F.col("n_subs") / 3600).alias("hours"),
        (F.col("n_subs") > 1).alias("depth_known"), F.col("night").alias("date"), "session_root", "bucket", "n_subs", "accepted", F.lit(True).alias("counts_captured"),
    )


# what the fixed tables make of the derived spellings
NORMAL_SQL = f"""
f as ({V.FRAMES_SQL}),
n as (select *, case trim(raw_filter) when 'Ha' then 'Ha' when 'halpha' then 'Ha' when 'oiii' then 'OIII' when 'O3' then 'OIII' when 'S-II' then 'SII' when 'lum' then 'L' when 'RED' then 'R'
    when 'Green' then 'G' when 'b' then 'B' when 'L-eXtreme' then 'L-eXtreme' when 'none' then 'NoFilter' when 'SV220_Ha-Oiii_3nm' then 'SV220 Ha-OIII 3nm' when 'Antlia OIII' then 'OIII' when 'Sodium' then 'Sodium' end as filter,
  case raw_scope when 'Astro-Physics 110GTX' then '110GTX' when 'RedCat51' then 'RedCat 51' when 'hyperstar' then 'HyperStar' when 'William Optics RedCat 51' then 'RedCat 51' end as telescope,
  case raw_camera when 'ZWO ASI2600MM Pro' then 'ASI2600MM Pro' when 'asi2600mc  pro' then 'asi2600mc pro' when 'Player One Poseidon-C' then 'Poseidon-C' else '268M' end as camera from f),
m as (select *, coalesce(telescope, '?') || '|' || camera as rig_key from n)
"""

HOURS_SQL = f"""
{NORMAL_SQL},
e as (
  select target_id, case when is_master then 'master' else 'folder_sub' end as role, bucket || '/' || file_name as path, filter, rig_key, n_subs, accepted, session_root, bucket, night as date,
    case when is_master and n_subs <= 1 then exptime / 3600 else exptime * n_subs / 3600 end as hours, n_subs > 1 as depth_known,
    unnest(case when filter is null then case when colour then ['R', 'G', 'B'] else ['Unknown'] end when filter = 'NoFilter' then case when colour then ['R', 'G', 'B'] else ['L'] end
      when filter in ('L-eXtreme', 'SV220 Ha-OIII 3nm') then ['Ha', 'OIII'] else [filter] end) as band from m),
nest as (
  select target_id, band, lower(rig_key) as rig, sum(hours) as nested from (
    select distinct r.target_id, r.band, r.rig_key, r.path, r.bucket, r.hours from e r join e c on c.target_id = r.target_id and c.band = r.band and lower(c.rig_key) = lower(r.rig_key)
    where r.role = 'folder_sub' and c.role = 'folder_sub' and not r.accepted and starts_with(r.bucket, c.bucket || '/')) group by 1, 2, 3),
g as (
  select e.target_id, e.band, lower(e.rig_key) as rig, min(rig_key) as rig_key, coalesce(sum(hours) filter (role = 'folder_sub'), 0) as captured_hours,
    coalesce(sum(hours) filter (role = 'folder_sub' and accepted), 0) as plain, coalesce(sum(n_subs) filter (role = 'folder_sub'), 0) as n_subs, count(*) filter (role = 'folder_sub') as n_blocks,
    count(*) filter (role = 'master') as n_masters, max(row(depth_known, hours, date, path, session_root)) filter (role = 'master') as mm, list(distinct session_root) filter (role = 'folder_sub') as roots,
    first(hours order by depth_known desc, hours desc, date desc, path desc) filter (role = 'master') as m_hours, first(path order by depth_known desc, hours desc, date desc, path desc) filter (role = 'master') as m_path,
    first(depth_known order by depth_known desc, hours desc, date desc, path desc) filter (role = 'master') as m_deep, first(session_root order by depth_known desc, hours desc, date desc, path desc) filter (role = 'master') as m_root,
    list(distinct session_root) filter (role = 'master') as m_roots from e group by 1, 2, 3),
h as (
  select g.*, coalesce(m_hours, 0) as integrated_hours, greatest(0, plain - coalesce(nested, 0)) as accepted_hours from g left join nest using (target_id, band, rig)),
s as (
  select *, n_masters > 0 and integrated_hours > 0 and accepted_hours - integrated_hours > least(integrated_hours * 0.2, 2.0) as stale_master,
    coalesce(captured_hours > 0 and list_contains(roots, m_root) and integrated_hours > captured_hours * 1.05 + 0.1, false) as integration_anomaly from h),
rigs as (
  select target_id, band, rig_key, captured_hours, accepted_hours, integrated_hours, case when coalesce(m_deep, false) and integrated_hours > 0 and not integration_anomaly then integrated_hours else captured_hours end as headline_hours,
    case when coalesce(m_deep, false) and integrated_hours > 0 and not integration_anomaly then 'integrated' when captured_hours > 0 then 'captured' else 'none' end as headline_basis, m_path as integrated_master,
    n_masters, n_blocks, n_subs, stale_master, case when stale_master then accepted_hours - integrated_hours else 0 end as stale_excess_hours, integration_anomaly,
    len(list_filter(coalesce(m_roots, []), lambda x: not list_contains(coalesce(roots, []), x))) > 0 as masters_without_subs, n_masters > 1 as multi_master from s),
bands as (
  select target_id, band, sum(captured_hours) as captured_hours, sum(accepted_hours) as accepted_hours, sum(integrated_hours) as integrated_hours, sum(headline_hours) as headline_hours,
    case when count(distinct headline_basis) filter (headline_hours > 0) = 0 then 'none' when count(distinct headline_basis) filter (headline_hours > 0) = 1 then max(headline_basis) filter (headline_hours > 0) else 'mixed' end as headline_basis,
    bool_or(stale_master) as stale_master, count(*) as rigs from rigs group by 1, 2)
"""


@query(
    "frame_names",
    f"with {NORMAL_SQL} select target_id, file_name, filter, telescope, camera, rig_key from m",
)
def frame_names(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical filter, telescope, camera and rig of every frame."""
    return normalised(V.frames(spark, sf)).select("target_id", "file_name", "filter", "telescope", "camera", "rig_key")


@query("unrecognised_filters", f"with {NORMAL_SQL} select trim(raw_filter) as name, count(*) as frames from m where raw_filter = 'Sodium' group by 1")
def unrecognised_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Filter names that are in no table, with their frames."""
    df = V.frames(spark, sf).withColumn("filter", N.canonical_filter(F.col("raw_filter")))
    return df.where(F.col("filter").isNotNull() & ~N.is_known_filter(F.col("raw_filter"))).groupBy(F.btrim("raw_filter").alias("name")).agg(F.count("*").alias("frames"))


@query("band_credit", f"with {HOURS_SQL} select band, count(*) as frames, round(sum(hours), 6) as hours from e group by 1")
def band_credit(spark: SparkSession, sf: str) -> DataFrame:
    """Frames and hours that each band is credited with: a frame counts in full for every band."""
    return H.credited(members(V.frames(spark, sf))).groupBy("band").agg(F.count("*").alias("frames"), F.round(F.sum("hours"), 6).alias("hours"))


@query(
    "filter_labels",
    f"with {NORMAL_SQL} select case when filter is null then case when colour then 'OSC' else 'Unknown' end when filter = 'NoFilter' and colour then 'OSC' else filter end as label, count(*) as frames from m group by 1",
)
def filter_labels(spark: SparkSession, sf: str) -> DataFrame:
    df = normalised(V.frames(spark, sf))
    return df.groupBy(N.filter_label(F.col("filter"), F.col("colour")).alias("label")).agg(F.count("*").alias("frames"))


def _r6(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c.endswith("_hours")})


RIG_COLUMNS = ("captured_hours", "accepted_hours", "integrated_hours", "headline_hours", "stale_excess_hours")


@query(
    "rig_hours",
    f"with {HOURS_SQL} select target_id, band, rig_key, {', '.join(f'round({c}, 6) as {c}' for c in RIG_COLUMNS)}, headline_basis, integrated_master, n_masters, n_blocks, cast(n_subs as bigint) as n_subs, stale_master, integration_anomaly, masters_without_subs, multi_master from rigs",
)
def rig_hours(spark: SparkSession, sf: str) -> DataFrame:
    """The three figures of every target, band and rig."""
    return _r6(H.by_rig(members(V.frames(spark, sf)))).drop("accepted_basis", "first_sub_date", "last_sub_date", "last_master_date")


@query(
    "band_hours",
    f"with {HOURS_SQL} select target_id, band, round(captured_hours, 6) as captured_hours, round(accepted_hours, 6) as accepted_hours, round(integrated_hours, 6) as integrated_hours, round(headline_hours, 6) as headline_hours, headline_basis, stale_master, rigs from bands",
)
def band_hours(spark: SparkSession, sf: str) -> DataFrame:
    df = H.by_band(H.by_rig(members(V.frames(spark, sf))))
    return _r6(df).select("target_id", "band", "captured_hours", "accepted_hours", "integrated_hours", "headline_hours", "headline_basis", "stale_master", "rigs")


def bands(spark: SparkSession, sf: str) -> DataFrame:
    return H.by_band(H.by_rig(members(V.frames(spark, sf))))


@query(
    "have_without",
    f"""with {HOURS_SQL}, w as (select target_id, coalesce(max(headline_hours) filter (band = 'Ha'), 0) as have_hours, coalesce(max(headline_hours) filter (band = 'SII'), 0) as missing_hours, sum(headline_hours) as total_hours from bands group by 1)
    select target_id, round(have_hours, 6) as have_hours, round(missing_hours, 6) as missing_hours, round(total_hours, 6) as total_hours from w where have_hours >= 1 and missing_hours < 0.5""",
)
def have_without(spark: SparkSession, sf: str) -> DataFrame:
    """Which targets have an hour of Ha but hardly any SII."""
    return _r6(H.one_band_without_other(bands(spark, sf), "Ha", "SII", 1.0, 0.5).drop("hours_by_band"))


@query(
    "integrity_flags",
    f"""with {HOURS_SQL} select target_id, band, rig_key, 'stale_master' as flag, round(integrated_hours, 6) as integrated_hours, round(accepted_hours, 6) as reference_hours, round(stale_excess_hours, 6) as excess_hours from rigs where stale_master
    union all select target_id, band, rig_key, 'integration_anomaly', round(integrated_hours, 6), round(captured_hours, 6), round(integrated_hours - captured_hours, 6) from rigs where integration_anomaly""",
)
def integrity_flags(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(H.integrity_flags(H.by_rig(members(V.frames(spark, sf)))))


@query(
    "filter_rollup",
    f"with {HOURS_SQL} select band, count(distinct target_id) as targets, round(sum(captured_hours), 4) as captured_hours, round(sum(headline_hours), 4) as headline_hours from bands group by 1",
)
def filter_rollup(spark: SparkSession, sf: str) -> DataFrame:
    df = H.filter_rollup(bands(spark, sf))
    return df.select("band", "targets", F.round("captured_hours", 4).alias("captured_hours"), F.round("headline_hours", 4).alias("headline_hours"))


@query("archive_total", f"with {HOURS_SQL} select round(sum(captured_hours), 3) as captured_hours, round(sum(accepted_hours), 3) as accepted_hours, round(sum(integrated_hours), 3) as integrated_hours, round(sum(headline_hours), 3) as headline_hours from bands")
def archive_total(spark: SparkSession, sf: str) -> DataFrame:
    """Hours over every band of every target."""
    return bands(spark, sf).agg(*(F.round(F.sum(c), 3).alias(c) for c in ("captured_hours", "accepted_hours", "integrated_hours", "headline_hours")))


@query("top_targets", f"with {HOURS_SQL} select target_id, round(sum(headline_hours), 6) as total_hours from bands group by 1 order by 2 desc, 1 limit 15")
def top_targets(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(H.top_targets(bands(spark, sf)))


@query(
    "deepest_filter",
    f"with {HOURS_SQL} select target_id, first(band order by list_position(['Ha', 'OIII', 'SII', 'L', 'R', 'G', 'B'], band)) as deepest from bands where headline_hours >= 0.1 and list_contains(['Ha', 'OIII', 'SII', 'L', 'R', 'G', 'B'], band) group by 1",
)
def deepest_filter(spark: SparkSession, sf: str) -> DataFrame:
    return H.deepest_filter(bands(spark, sf))


DB_SQL = "select l_partkey as target_id, 'Ha' as band, sum(l_quantity) / 60.0 as db_hours from lineitem group by 1"


@query(
    "database_floor",
    f"""with {HOURS_SQL}, d as ({DB_SQL}), j as (select b.*, greatest(captured_hours, coalesce(db_hours, 0)) as now from bands b left join d using (target_id, band))
    select target_id, band, round(now, 6) as captured_hours, round(now - captured_hours, 6) as unattributed_hours, round(case when headline_basis in ('captured', 'none') then now else headline_hours end, 6) as headline_hours,
    case when headline_basis in ('captured', 'none') then case when now > 0 then 'captured' else 'none' end else headline_basis end as headline_basis from j""",
)
def database_floor(spark: SparkSession, sf: str) -> DataFrame:
    """Captured hours raised to a capture database's figure."""
    b = bands(spark, sf)
    return _r6(H.database_floor(b, spark.sql(DB_SQL)))
