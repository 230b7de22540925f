"""Queries on fields: duplicates, identities, rotations, grids, tiles and merged catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import names as N
from lumenfold.operators import coverage, geometry, grouped, identity, rank, tiles
from lumenfold.plans.registry import Registry
from lumenfold.session import read

registry = Registry()
query = registry.query


def shapes(lib: DataFrame, key: str) -> DataFrame:
    """Fields as geometry.near_fields takes them."""
    df = coverage.corner_arrays(lib.select("target_id", "center_ra_deg", "center_dec_deg", "footprint_arcmin", "rotation_deg", "corners_icrs"))
    size = F.col("footprint_arcmin")
    short = F.least(F.try_element_at(size, F.lit(1)), F.try_element_at(size, F.lit(2)))
    # the corners of a field lie within its half diagonal; unknown sizes get a wide reach
    wide = F.coalesce(F.sqrt(F.try_element_at(size, F.lit(1)) ** 2 + F.try_element_at(size, F.lit(2)) ** 2) / 120.0 * 1.01, F.lit(2.0))
    return df.select(F.col("target_id").alias(key), F.col("center_ra_deg").alias("ra"), F.col("center_dec_deg").alias("dec"), F.col("__ra").alias("cra"), F.col("__dec").alias("cdec"), short.alias("field"), wide.alias("reach"))


@query("duplicate_fields")
def duplicate_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of the library that share 30 percent with the field of a scheduled target, which is taken for a square of 40 arcmin."""
    lib = read(spark, sf, "library_target")
    ra = F.when(F.col("ra").between(0, 24), F.col("ra") * 15)
    none = F.lit(None).cast("array<array<double>>")
    sched = read(spark, sf, "scheduler_target").where("ra is not null and dec between -90 and 90 and not (ra = 0 and dec = 0)").where(ra.isNotNull())
    sched = sched.select(F.col("id").cast("bigint").alias("target_id"), ra.alias("center_ra_deg"), F.col("dec").alias("center_dec_deg"), F.array(F.lit(40.0), F.lit(40.0)).alias("footprint_arcmin"), F.col("rotation").alias("rotation_deg"), none.alias("corners_icrs"))
    pairs = geometry.near_fields(shapes(lib, "l"), shapes(sched, "r")).where("overlap.small >= 0.3")
    return pairs.select("l", "r", F.round("overlap.small", 6).alias("overlap"), F.round("sep_deg", 6).alias("sep_deg"))


@query("target_numbers")
def target_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of a scan that found the library again, a little displaced and in another order."""
    lib = read(spark, sf, "library_target")
    again = rank.dense_ids(lib, [F.xxhash64("target_id").asc(), F.col("target_id").asc()], "r")
    moved = again.withColumn("center_dec_deg", F.col("center_dec_deg") + 0.001)
    old, new = shapes(lib, "l"), shapes(moved.drop("target_id").withColumnRenamed("r", "target_id"), "r")
    names = lambda df, key, out: df.select(F.col(key).alias(out), F.explode("objects").alias("n")).select(out, identity.name_key(F.col("n")).alias("name")).distinct()
    hours = F.aggregate(F.map_values("filters"), F.lit(0.0), lambda a, f: a + F.coalesce(f["total_hours"], F.lit(0.0)))
    edges = identity.match_edges(old, new, names(lib, "target_id", "l"), names(again, "r", "r"))
    ids, _ = identity.assign(lib.select(F.col("target_id").alias("l"), F.coalesce(hours, F.lit(0.0)).alias("hours")), again.select("r", F.coalesce(hours, F.lit(0.0)).alias("hours")), edges, 900_000_000_000)
    return ids


@query(
    "rotation_medians",
    """with x as (select unnest(list_distinct(telescopes)) as telescope, rotation_deg as r from library_target where rotation_deg is not null), m as (select telescope, degrees(atan2(avg(sin(radians(r))), avg(cos(radians(r))))) as mean from x group by 1),
    o as (select telescope, mean, ((r - mean + 180) % 360 + 360) % 360 - 180 as off from x join m using (telescope)), d as (select telescope, any_value(mean) + median(off) as a from o group by 1) select telescope, round((a % 360 + 360) % 360, 5) % 360 as median_deg from d""",
)
def rotation_medians(spark: SparkSession, sf: str) -> DataFrame:
    """Median rotation per telescope, unwrapped about the mean."""
    x = read(spark, sf, "library_target").where("rotation_deg is not null").select(F.explode(F.array_distinct("telescopes")).alias("telescope"), "rotation_deg")
    return grouped.circular_median(x, ["telescope"], "rotation_deg").select("telescope", (F.round("median_deg", 5) % 360).alias("median_deg"))


@query("project_rotations")
def project_rotations(spark: SparkSession, sf: str) -> DataFrame:
    """The rotation that each project's targets agree on most."""
    df = read(spark, sf, "scheduler_target").where("projectid is not null").select("projectid", F.col("rotation").alias("rotation_deg"), F.lit(1.0).alias("hours"))
    return grouped.rotations(df, "projectid", "int")


@query("catalogue_merged")
def catalogue_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue points merged within their family; the size of a point is made from its id."""
    pts = read(spark, sf, "gap_candidate").select(F.col("candidate_id").alias("id"), F.col("catalog").alias("family"), "ra_deg", "dec_deg", (F.col("candidate_id") % 50).cast("double").alias("major"))
    return grouped.merged_catalogue(pts)


TILE_SQL = """select target_id, (target_id % 5) as priority, filters from library_target where coalesce(filters['SII'].total_hours, 0) < 5 and ((target_id % 5) = 0 or (target_id % 5) in (1, 2)) and coalesce(filters['Ha'].total_hours, 0) > 0"""


def _tiles(spark: SparkSession, sf: str) -> DataFrame:
    band = F.transform_values("filters", lambda _, f: F.struct((F.coalesce(f["total_hours"], F.lit(0.0)) >= 5).alias("covered")))
    counts = F.transform_values("filters", lambda _, f: F.when(f["total_hours"] > 0, 1).otherwise(0))
    return read(spark, sf, "library_target").select("target_id", (F.col("target_id") % 5).alias("priority"), band.alias("per_band"), counts.alias("category_counts"), F.create_map(F.lit("x"), F.lit("y")).alias("metadata"))


@query("tiles_filtered", f"select target_id, priority from ({TILE_SQL})")
def tiles_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles of chosen priorities that lack one band and have another."""
    return _tiles(spark, sf).where(tiles.tile_passes([1, 2], ["SII"], ["Ha"], {"x": ["y"]})).select("target_id", "priority")


@query(
    "tiles_summary",
    """with t as (select target_id % 5 as priority, map_values(filters) as f from library_target) select count(*) as tiles, max(priority) as max_priority,
    round(avg(case when f is null or len(f) = 0 then 0 else len(list_filter(f, lambda x: coalesce(x.total_hours, 0) >= 5)) / len(f) end), 6) as completion from t""",
)
def tiles_summary(spark: SparkSession, sf: str) -> DataFrame:
    return tiles.tile_summary(_tiles(spark, sf))


PATHS_SQL = """select o_orderkey as id, '/nas/obj' || cast(o_custkey as varchar(20)) || case o_orderkey % 6 when 0 then '/calibrated/j' || cast(o_orderkey as varchar(20)) when 1 then '/master' when 2 then '/registered/x' when 3 then '/Calibrated' when 4 then '/lights' else '' end as bucket from orders"""


@query(
    "session_stages",
    f"""with p as ({PATHS_SQL}), s as (select id, bucket, regexp_extract(bucket, '^(.*)/(calibrated|registered|master|Calibrated)(/.*)?$', 1) as parent, lower(regexp_extract(bucket, '^(.*)/(calibrated|registered|master|Calibrated)(/.*)?$', 2)) as stage from p),
    r as (select parent from s where stage <> '' group by 1 having (count(distinct stage) >= 2 and bool_or(stage in ('registered', 'master'))) or bool_or(stage = 'master'))
    select id, case when r.parent is null then bucket else s.parent end as session_root, case when r.parent is null then 'root' else stage end as stage from s left join r on r.parent = s.parent and s.stage <> ''""",
)
def session_stages(spark: SparkSession, sf: str) -> DataFrame:
    """The session and stage of every folder; a stage folder counts only below a real session."""
    read(spark, sf, "orders").createOrReplaceTempView("orders")
    return N.session_stages(spark.sql(PATHS_SQL), "bucket").select("id", "session_root", "stage")


@query(
    "object_links",
    """with a as (select lower(trim(replace(o, '_', ' '))) as k, max(target_id) as target_id from (select target_id, unnest(objects) as o from library_target) group by 1)
    select s.id, a.target_id from scheduler_target s left join a on a.k = lower(trim(replace(s.name, '_', ' ')))""",
)
def object_links(spark: SparkSession, sf: str) -> DataFrame:
    """Scheduler targets by object name: of fields that share a name the last one wins."""
    key = lambda c: F.lower(F.btrim(F.replace(F.col(c), F.lit("_"), F.lit(" "))))
    a = read(spark, sf, "library_target").select("target_id", F.explode("objects").alias("o")).groupBy(key("o").alias("k")).agg(F.max("target_id").alias("target_id"))
    return read(spark, sf, "scheduler_target").select("id", key("name").alias("k")).join(a, "k", "left").select("id", "target_id")


@query(
    "rig_list",
    """with t as (select distinct unnest(telescopes) as telescope from library_target), c as (select distinct unnest(cameras) as camera from library_target) select telescope, camera from t, c""",
)
def rig_list(spark: SparkSession, sf: str) -> DataFrame:
    """Every telescope with every camera: two distinct lists of gear."""
    lib = read(spark, sf, "library_target")
    t = lib.select(F.explode("telescopes").alias("telescope")).distinct()
    c = lib.select(F.explode("cameras").alias("camera")).distinct().agg(F.collect_set("camera").alias("cs"))
    return t.crossJoin(F.broadcast(c)).select("telescope", F.explode("cs").alias("camera"))  # one row of cameras


@query(
    "band_correlation",
    "select f1 as band, round(corr(h1, h2), 6) as r, count(*) as n from (select a.target_id, a.f as f1, a.h as h1, b.h as h2 from (select target_id, unnest(map_keys(filters)) as f, unnest(map_values(filters)).total_hours as h from library_target) a join (select target_id, filters['Ha'].total_hours as h from library_target) b using (target_id)) where h1 is not null and h2 is not null group by 1 having count(*) >= 10",
)
def band_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """How the hours of each band go with those of Ha."""
    lib = read(spark, sf, "library_target").select(F.try_element_at("filters", F.lit("Ha"))["total_hours"].alias("h2"), F.explode("filters").alias("band", "f"))
    df = lib.select("band", F.col("f.total_hours").alias("h1"), "h2").where("h1 is not null and h2 is not null")
    return df.groupBy("band").agg(F.round(F.corr("h1", "h2"), 6).alias("r"), F.count("*").alias("n")).where("n >= 10")
