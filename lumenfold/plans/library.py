"""Queries over the library of fields: search, facets, joins on the sky, gaps and sharing."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions import sphere as S
from lumenfold.operators import coverage as C
from lumenfold.operators import search as Q
from lumenfold.operators import sky
from lumenfold.operators.rank import dense_ids
from lumenfold.plans.problems import P5_SQL
from lumenfold.plans.registry import Registry
from lumenfold.session import cut, read
from lumenfold.sources.tables import sanitised

registry = Registry()
query = registry.query

HOURS_SQL = "coalesce(list_sum(list_transform(map_values(filters), lambda f: coalesce(f.total_hours, 0))), 0)"


def _library(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "library_target")


SEARCH = 'telescope:dunmark hours>10 -filter:SII -"bell"'


@query(
    "search_targets",
    f"""select target_id, round({HOURS_SQL}, 6) as hours from library_target where len(list_filter(coalesce(telescopes, []), lambda x: contains(lower(x), 'dunmark'))) > 0 and {HOURS_SQL} > 10
    and not (coalesce(filters['SII'].total_hours, 0) > 0) and len(list_filter(list_concat(coalesce(objects, []), coalesce(telescopes, []), coalesce(cameras, [])), lambda x: contains(lower(x), 'bell'))) = 0""",
)
def search_targets(spark: SparkSession, sf: str) -> DataFrame:
    """A search in the list's language."""
    return _library(spark, sf).where(Q.target_matches(SEARCH)).select("target_id", F.round(Q.total_hours(), 6).alias("hours"))


@query("search_candidates", "select candidate_id, catalog from gap_candidate where contains(lower(coalesce(name, '')), 'orm') and lower(coalesce(catalog, '')) = 'orm_remnants' and not contains(lower(coalesce(name, '')), 'g1')")
def search_candidates(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "gap_candidate").withColumnRenamed("catalog", "category").withColumn("tags", F.array("category"))
    return df.where(Q.object_matches("orm class:orm_remnants -name:g1")).select("candidate_id", F.col("category").alias("catalog"))


@query(
    "chips",
    """select target_id, coalesce(filters['Ha'].total_hours, 0) >= 5 or coalesce(filters['OIII'].total_hours, 0) >= 5 as any_chip, coalesce(filters['Ha'].total_hours, 0) >= 5 and coalesce(filters['OIII'].total_hours, 0) >= 5 as all_chips,
    coalesce(filters['Ha'].total_hours, 0) > 0 and not coalesce(filters['SII'].total_hours, 0) > 0 as ha_not_sii from library_target""",
)
def chips(spark: SparkSession, sf: str) -> DataFrame:
    """The three ways that filter chips combine."""
    two = ["Ha", "OIII"]
    return _library(spark, sf).select("target_id", Q.chip_matches(two, "any", 5.0).alias("any_chip"), Q.chip_matches(two, "all", 5.0).alias("all_chips"), Q.chip_matches([], "ha_not_sii", 0.0).alias("ha_not_sii"))


@query(
    "filter_hidden",
    f"select count(*) filter (not ({HOURS_SQL} > 20)) as hidden, count(*) as targets from library_target",
)
def filter_hidden(spark: SparkSession, sf: str) -> DataFrame:
    """How many targets a filter hides that a reset would show."""
    now = Q.target_matches("hours>20")
    return _library(spark, sf).agg(F.count_if(~now).alias("hidden"), F.count("*").alias("targets"))


@query(
    "facets",
    """select 'telescope' as facet, v as value, count(*) as targets from (select unnest(list_distinct(telescopes)) as v from library_target) group by 2
    union all select 'camera', v, count(*) from (select unnest(list_distinct(cameras)) as v from library_target) group by 2 union all select 'filter', v, count(*) from (select unnest(map_keys(filters)) as v from library_target) group by 2""",
)
def facets(spark: SparkSession, sf: str) -> DataFrame:
    """Targets per telescope, camera and filter; a target counts once for each of its values. One pass."""
    kinds = F.create_map(F.lit("telescope"), F.array_distinct("telescopes"), F.lit("camera"), F.array_distinct("cameras"), F.lit("filter"), F.map_keys("filters"))
    df = _library(spark, sf).select(F.explode(kinds).alias("facet", "values")).select("facet", F.explode("values").alias("value"))
    return df.groupBy("facet", "value").agg(F.count("*").alias("targets"))


@query("gear_pairs", "select t as telescope, c as camera, count(*) as targets from (select t, unnest(list_distinct(cameras)) as c from (select unnest(list_distinct(telescopes)) as t, cameras from library_target)) group by 1, 2 order by 3 desc, 1, 2 limit 1")
def gear_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The pair of telescope and camera that most targets name."""
    df = _library(spark, sf).select(F.explode(F.array_distinct("telescopes")).alias("telescope"), "cameras").select("telescope", F.explode(F.array_distinct("cameras")).alias("camera"))
    return df.groupBy("telescope", "camera").agg(F.count("*").alias("targets")).orderBy(F.desc("targets"), "telescope", "camera").limit(1)


@query(
    "gear_of_library",
    """with x as (select unnest(list_distinct(telescopes)) as telescope, fov_arcmin, filters from library_target), g as (select telescope, list_sort(list(greatest(fov_arcmin[1], fov_arcmin[2]))) as s, count(*) as n from x where fov_arcmin is not null group by 1),
    f as (select telescope, list_sort(list_distinct(flatten(list(map_keys(filters))))) as filters from x group by 1)
    select telescope, round(s[n // 2 + 1], 6) as upper_median_fov, n as targets, array_to_string(filters, ',') as filters from g join f using (telescope)""",
)
def gear_of_library(spark: SparkSession, sf: str) -> DataFrame:
    """Telescopes with the upper median of their fields and all their filters."""
    x = _library(spark, sf).select(F.explode(F.array_distinct("telescopes")).alias("telescope"), "fov_arcmin", "filters")
    wide = F.when(F.col("fov_arcmin").isNotNull(), F.greatest(F.col("fov_arcmin")[0], F.col("fov_arcmin")[1]))
    n = F.count(wide)
    # the element after the lower half: a discrete percentile, without a list of all values
    median = F.expr("percentile_disc(0.5) within group (order by greatest(fov_arcmin[0], fov_arcmin[1]))")
    upper = F.expr("-percentile_disc(0.5) within group (order by -greatest(fov_arcmin[0], fov_arcmin[1]))")
    df = x.groupBy("telescope").agg(F.round(F.when(n % 2 == 0, upper).otherwise(median), 6).alias("upper_median_fov"), n.alias("targets"))
    names = x.select("telescope", F.explode(F.map_keys("filters")).alias("f")).groupBy("telescope").agg(F.array_join(F.array_sort(F.collect_set("f")), ",").alias("filters"))
    return df.join(names, "telescope").where("targets > 0")


@query(
    "targets_by_name",
    r"""with n as (select target_id, list_transform(regexp_extract_all(lower(regexp_replace(coalesce(objects[1], ''), '\s+', ' ', 'g')), '[0-9]+|[^0-9]+'), lambda p: case when regexp_matches(p, '^[0-9]') then lpad(cast(len(ltrim(p, '0')) as varchar), 10, '0') || ltrim(p, '0') else p end) as parts
      from library_target where len(objects) > 0) select target_id, row_number() over (order by array_to_string(parts, ''), target_id) as place from n""",
)
def targets_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """All named targets in natural order of their names: ranges are sorted and numbered apart."""
    first = F.coalesce(F.try_element_at("objects", F.lit(1)), F.lit(""))
    df = _library(spark, sf).where(F.size("objects") > 0).select("target_id", Q.natural_key(F.regexp_replace(first, r"\s+", " ")).alias("key"))
    return dense_ids(df, [F.col("key").asc(), F.col("target_id").asc()], "place", 1).select("target_id", "place")


NEAR_SQL = """
g as (select candidate_id, catalog, name, cos(radians(dec_deg)) * cos(radians(ra_deg)) as x, cos(radians(dec_deg)) * sin(radians(ra_deg)) as y, sin(radians(dec_deg)) as z from gap_candidate where ra_deg is not null and dec_deg is not null),
t as (select target_id, filters, cos(radians(center_dec_deg)) * cos(radians(center_ra_deg)) as x, cos(radians(center_dec_deg)) * sin(radians(center_ra_deg)) as y, sin(radians(center_dec_deg)) as z from library_target),
p as (select *, degrees(atan2(sqrt(power(g.y * t.z - g.z * t.y, 2) + power(g.z * t.x - g.x * t.z, 2) + power(g.x * t.y - g.y * t.x, 2)), g.x * t.x + g.y * t.y + g.z * t.z)) as sep from g, t)
"""


def _near(spark: SparkSession, sf: str, radius: float) -> DataFrame:
    points = read(spark, sf, "gap_candidate").select("candidate_id", "catalog", S.xyz(F.col("ra_deg"), F.col("dec_deg")).alias("__v"))
    centres = _library(spark, sf).select("target_id", "filters", S.xyz(F.col("center_ra_deg"), F.col("center_dec_deg")).alias("__c"))
    return sky.sky_join(points, centres, radius)


@query(
    "nearest_target",
    f"with {NEAR_SQL} select candidate_id, first(target_id order by round(sep, 9), target_id) as target_id, round(min(sep), 6) as sep_deg from p where sep <= 0.75 group by 1",
)
def nearest_target(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest field of each point, within 45 arcmin: further ones would be rejected anyway."""
    df = _near(spark, sf, 0.75)
    rank = F.struct(F.round("sep_deg", 9).alias("s"), F.col("target_id").alias("t"))
    return df.groupBy("candidate_id").agg(F.min_by("target_id", rank).alias("target_id"), F.round(F.min("sep_deg"), 6).alias("sep_deg"))


@query(
    "priority_list",
    f"""with {NEAR_SQL}, n as (select candidate_id, first(catalog) as catalog, first(target_id order by round(sep, 9), target_id) as target_id, first(filters order by round(sep, 9), target_id) as filters, min(sep) as sep from p where sep <= 0.75 group by 1)
    select candidate_id, catalog, target_id, round(sep * 60, 4) as sep_arcmin, coalesce(filters['Ha'].total_hours, 0) as ha_hours, coalesce(filters['SII'].total_hours, 0) as sii_hours from n
    where coalesce(filters['Ha'].total_hours, 0) >= 1 and coalesce(filters['SII'].total_hours, 0) < 0.5""",
)
def priority_list(spark: SparkSession, sf: str) -> DataFrame:
    """Points whose nearest field is deep in one band and empty in another: the rows of the export."""
    df = _near(spark, sf, 0.75)
    rank = F.struct(F.round("sep_deg", 9).alias("s"), F.col("target_id").alias("t"))
    near = df.groupBy("candidate_id").agg(F.first("catalog").alias("catalog"), F.min_by(F.struct("target_id", "filters", "sep_deg"), rank).alias("n"))
    hours = lambda f: F.coalesce(F.try_element_at("n.filters", F.lit(f))["total_hours"], F.lit(0.0))
    rows = near.select("candidate_id", "catalog", "n.target_id", F.round(F.col("n.sep_deg") * 60, 4).alias("sep_arcmin"), hours("Ha").alias("ha_hours"), hours("SII").alias("sii_hours"))
    return rows.where("ha_hours >= 1 and sii_hours < 0.5")


@query(
    "cone_matches",
    f"with {NEAR_SQL}, r as (select target_id, candidate_id, sep, row_number() over (partition by target_id order by round(sep, 9), candidate_id) as place from p where sep <= 0.75) select target_id, candidate_id, place, round(sep, 6) as sep_deg from r where place <= 20",
)
def cone_matches(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 nearest points of each field, within 45 arcmin."""
    w = Window.partitionBy("target_id").orderBy(F.round("sep_deg", 9), "candidate_id")
    df = _near(spark, sf, 0.75).withColumn("place", F.row_number().over(w)).where("place <= 20")
    return df.select("target_id", "candidate_id", "place", F.round("sep_deg", 6).alias("sep_deg"))


@query(
    "hit_test",
    f"""with pairs as ({P5_SQL}) select candidate_id, first(p.target_id order by coalesce(t.footprint_arcmin[1] * t.footprint_arcmin[2], 1e9), p.target_id) as target_id, count(*) as footprints
    from pairs p join library_target t on t.target_id = p.target_id group by 1""",
)
def hit_test(spark: SparkSession, sf: str) -> DataFrame:
    """The smallest footprint that holds each point; ties by id."""
    pts = read(spark, sf, "gap_candidate").select("candidate_id", "ra_deg", "dec_deg")
    lib = _library(spark, sf)
    pairs = sky.points_in_regions(pts, lib)
    area = lib.select("target_id", (F.coalesce(F.col("footprint_arcmin")[0] * F.col("footprint_arcmin")[1], F.lit(1e9))).alias("area"))
    return pairs.join(area, "target_id").groupBy("candidate_id").agg(F.min_by("target_id", F.struct("area", "target_id")).alias("target_id"), F.count("*").alias("footprints"))


DEPTH = 10


def _band_cells(spark: SparkSession, sf: str, band: str) -> DataFrame:
    has = F.coalesce(F.try_element_at("filters", F.lit(band))["total_hours"] > 0, F.lit(False))
    return C.footprint_cells(_library(spark, sf).where(has), DEPTH)


@query("gap_region")
def gap_region(spark: SparkSession, sf: str) -> DataFrame:
    """Cells that Ha covers and SII doesn't."""
    return C.gap_cells(_band_cells(spark, sf, "Ha"), _band_cells(spark, sf, "SII"))


@query("gap_candidates")
def gap_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue points in the gap, by catalogue."""
    pts = read(spark, sf, "gap_candidate").select("candidate_id", "catalog", "ra_deg", "dec_deg")
    return C.points_in_cells(pts, gap_region(spark, sf), DEPTH).select("candidate_id", "catalog")


@query("coverage_share")
def coverage_share(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the sky that each filter covers; a cell counts once however many fields hold it."""
    lib = _library(spark, sf)
    bands = lib.select("target_id", F.explode("filters").alias("band", "f")).where("f.total_hours > 0").select("target_id", "band")
    return C.band_shares(lib, bands, DEPTH)


@query("coverage_normalised")
def coverage_normalised(spark: SparkSession, sf: str) -> DataFrame:
    """The gap as few cells as possible."""
    return C.normalised(cut(gap_region(spark, sf)), DEPTH)  # each level reads the gap again


@query(
    "galactic",
    """with x as (select candidate_id, cos(radians(dec_deg)) * cos(radians(ra_deg)) as x, cos(radians(dec_deg)) * sin(radians(ra_deg)) as y, sin(radians(dec_deg)) as z from gap_candidate where ra_deg is not null and dec_deg is not null),
    g as (select candidate_id, -0.0548755604162154 * x - 0.8734370902348850 * y - 0.4838350155487132 * z as a, 0.4941094278755837 * x - 0.4448296299600112 * y + 0.7469822444972189 * z as b, -0.8676661490190047 * x - 0.1980763734312015 * y + 0.4559837761750669 * z as c from x)
    select candidate_id, round(case when degrees(atan2(b, a)) < 0 then degrees(atan2(b, a)) + 360 else degrees(atan2(b, a)) end, 6) as l, round(degrees(asin(greatest(-1, least(1, c)))), 6) as b from g""",
)
def galactic(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "gap_candidate").where("ra_deg is not null and dec_deg is not null").withColumn("g", S.galactic(F.col("ra_deg"), F.col("dec_deg")))
    return df.select("candidate_id", F.round("g.l", 6).alias("l"), F.round("g.b", 6).alias("b"))


@query(
    "rotation_mean",
    """with x as (select unnest(telescopes) as telescope, rotation_deg as r, h from (select *, coalesce(list_sum(list_transform(map_values(filters), lambda f: coalesce(f.total_hours, 0))), 0) as h from library_target) where rotation_deg is not null),
    s as (select telescope, sum(h) as w, sum(h * sin(radians(2 * r))) as s, sum(h * cos(radians(2 * r))) as c, sum(sin(radians(2 * r))) as s1, sum(cos(radians(2 * r))) as c1 from x group by 1),
    a as (select telescope, degrees(atan2(case when w = 0 then s1 else s end, case when w = 0 then c1 else c end)) / 2 as a from s)
    select telescope, round(case when a < 0 then a + 180 else a end, 4) as mean_deg from a""",
)
def rotation_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Mean rotation per telescope on doubled angles, weighted by hours; unweighted if all hours are 0."""
    x = _library(spark, sf).where("rotation_deg is not null").select(F.explode("telescopes").alias("telescope"), F.radians(F.col("rotation_deg") * 2).alias("r"), Q.total_hours().alias("h"))
    g = x.groupBy("telescope").agg(F.sum("h").alias("w"), F.sum(F.col("h") * F.sin("r")).alias("s"), F.sum(F.col("h") * F.cos("r")).alias("c"), F.sum(F.sin("r")).alias("s1"), F.sum(F.cos("r")).alias("c1"))
    flat = F.col("w") == 0
    a = F.degrees(F.atan2(F.when(flat, F.col("s1")).otherwise(F.col("s")), F.when(flat, F.col("c1")).otherwise(F.col("c")))) / 2
    return g.select("telescope", F.round(F.when(a < 0, a + 180).otherwise(a), 4).alias("mean_deg"))


#: Hides the ids of the shared table; a deployment sets its own.
SALT = os.environ.get("LUMENFOLD_SHARE_SALT", "not a secret: for tests")

_CLASS_SQL = """coalesce(cast(coalesce(try_cast(regexp_extract(lower(t), '(\\d{2,4})\\s*mm', 1) as int), cast(round(try_cast(regexp_extract(lower(t), '(\\d+(?:\\.\\d+)?)\\s*(?:"|-?inch|in\\b)', 1) as double) * 25.4) as int),
  case when try_cast(regexp_extract(lower(t), '(?:^|\\D)(\\d{2,4})(?:\\D|$)', 1) as int) between 40 and 1000 then try_cast(regexp_extract(lower(t), '(?:^|\\D)(\\d{2,4})(?:\\D|$)', 1) as int) end) as varchar) || 'mm '
  || case when regexp_matches(lower(t), 'refractor|apo|redcat|esprit|tak |fsq|ap |ap1|askar|william optics|tsa|fcd|gtx|petzval|doublet|triplet') then 'refractor' when regexp_matches(lower(t), 'newt|rasa|dob') then 'reflector' else 'telescope' end, 'telescope')"""


@query(
    "shared_manifest",
    f"""with e as (select target_id, f.key as band, round(coalesce(f.value.total_hours, 0), 1) as total_hours, coalesce(f.value.files, 0) as files from (select target_id, unnest(map_entries(filters)) as f from library_target))
    select 'f_' || substring(sha256('{SALT}|' || cast(l.target_id as varchar) || coalesce('|' || cast(center_ra_deg as varchar), '') || coalesce('|' || cast(center_dec_deg as varchar), '')), 1, 12) as target_id,
      array_to_string(list_transform(coalesce(telescopes, []), lambda t: {_CLASS_SQL}), ',') as telescopes, len(coalesce(objects, [])) as objects, band, total_hours, files from library_target l join e using (target_id)""",
)
def shared_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """What may leave the archive, one row a band: hidden ids, apertures for telescopes, hours in tenths."""
    shared = sanitised(_library(spark, sf), SALT)
    rows = shared.select("target_id", F.array_join("telescopes", ",").alias("telescopes"), F.size("objects").cast("bigint").alias("objects"), F.explode("filters").alias("band", "f"))
    return rows.select("target_id", "telescopes", "objects", "band", "f.total_hours", "f.files")
