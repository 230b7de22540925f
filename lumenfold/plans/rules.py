"""Queries of the small rules over groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import names as N
from lumenfold.operators import blocks as B
from lumenfold.operators import log as L
from lumenfold.plans.activity import KEYED_SQL
from lumenfold.plans.registry import Registry
from lumenfold.session import read

registry = Registry()
query = registry.query


@query(
    "inherited_pointing",
    """with d as (select projectid, first(ra order by id) as ra0, first("dec" order by id) as dec0 from scheduler_target where ra is not null and "dec" is not null group by 1)
    select s.id, case when (s.ra is null or s."dec" is null) and d.projectid is not null then ra0 else s.ra end as ra, case when (s.ra is null or s."dec" is null) and d.projectid is not null then dec0 else s."dec" end as "dec",
    (s.ra is null or s."dec" is null) and d.projectid is not null as inherited from scheduler_target s left join d using (projectid)""",
)
def inherited_pointing(spark: SparkSession, sf: str) -> DataFrame:
    """Targets without a position borrow their project's first one."""
    df = read(spark, sf, "scheduler_target").select("id", "projectid", "ra", "dec")
    return B.inherit_pointing(df, ["projectid"], [F.col("id")], "ra", "dec").select("id", "ra", "dec", "inherited")


@query("agreed_priority", "select name, case when min(priority) = max(priority) then min(priority) end as priority from project group by 1")
def agreed_priority(spark: SparkSession, sf: str) -> DataFrame:
    """The priority of the projects of a name, where they agree."""
    return B.only_value(read(spark, sf, "project"), ["name"], "priority", "priority")


@query(
    "richest_rows",
    """select guid, first(id order by (case when ra is not null then 1 else 0 end + case when rotation is not null then 1 else 0 end + case when priority is not null then 1 else 0 end) desc, id) as id from scheduler_target where guid is not null group by 1""",
)
def richest_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Of targets with one identifier the row that knows most."""
    df = read(spark, sf, "scheduler_target").select("id", "guid", "ra", "rotation", "priority")
    return B.richest(df, ["guid"], ["ra", "rotation", "priority"], "id").select("guid", "id")


@query(
    "project_settings",
    """select name, first(minimumaltitude order by id) filter (minimumaltitude is not null) as minimumaltitude, coalesce(min(minimumaltitude) <> max(minimumaltitude), false) as minimumaltitude_differs,
    first(meridianwindow order by id) filter (meridianwindow is not null) as meridianwindow, coalesce(min(meridianwindow) <> max(meridianwindow), false) as meridianwindow_differs from project group by 1""",
)
def project_settings(spark: SparkSession, sf: str) -> DataFrame:
    """The first settings of the projects of a name, and where they disagree."""
    return B.first_settings(read(spark, sf, "project"), ["name"], F.col("id"), ["minimumaltitude", "meridianwindow"])


@query(
    "plan_changes",
    f"""with {KEYED_SQL}, e as (select json_extract_string(refs, '$.plan_id') as plan_id, night, title, detail, "at" as t, source, key from c where type = 'plan_edited' and night is not null),
    g as (select plan_id, night, first(title order by t, source, key) as "from", last(detail order by t, source, key) as "to", count(*) as changes from e where plan_id is not null group by 1, 2)
    select * from g where "from" is distinct from "to" """,
)
def plan_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Edits of one plan in one night as one change."""
    df = L.current(L.keyed(read(spark, sf, "activity_log"))).where("type = 'plan_edited' and night is not null")
    df = df.select(F.get_json_object("refs", "$.plan_id").alias("plan_id"), "night", F.col("title").alias("from"), F.col("detail").alias("to"), "at", "source", "key").where("plan_id is not null")
    return B.coalesced_changes(df, ["plan_id", "night"], ["at", "source", "key"])


@query(
    "candidate_facets",
    """with g as (select catalog, case when dec_deg >= 0 then 'north' when dec_deg < 0 then 'south' end as half from gap_candidate)
    select 'catalog' as facet, catalog as value, count(*) as items from g where half = 'north' and catalog is not null group by 2 union all select 'half', half, count(*) from g where catalog in ('orm_remnants', 'hel_regions') and half is not null group by 2""",
)
def candidate_facets(spark: SparkSession, sf: str) -> DataFrame:
    """Counts per facet under the other facets' filters."""
    df = read(spark, sf, "gap_candidate").withColumn("half", F.when(F.col("dec_deg") >= 0, "north").when(F.col("dec_deg") < 0, "south"))
    filters = {"catalog": (F.array_compact(F.array("catalog")), F.col("catalog").isin("orm_remnants", "hel_regions")), "half": (F.array_compact(F.array("half")), F.col("half") == "north")}
    return B.facet_counts(df, filters)


@query(
    "deep_telescopes",
    """with x as (select unnest(telescopes) as telescope, coalesce(filters['Ha'].total_hours, 0) as h from library_target) select telescope from x group by 1 having max(h) >= 20""",
)
def deep_telescopes(spark: SparkSession, sf: str) -> DataFrame:
    """Telescopes of which any field is deep enough."""
    x = read(spark, sf, "library_target").select(F.explode("telescopes").alias("telescope"), F.coalesce(F.try_element_at("filters", F.lit("Ha"))["total_hours"], F.lit(0.0)).alias("h"))
    return B.sources_over(x, "telescope", "h", 20.0)


PATHS_SQL = """select o_orderkey as id, case o_orderkey % 7 when 0 then '/nas/t1/2024/LIGHT/Ha/f1.fit' when 1 then '/nas/t2/m_FILTER-OIII_x.xisf' when 2 then '/nas/t3/x_sii_300.fits' when 3 then '/nas/t4/L-eXtreme/f2.fit' when 4 then '/nas/t5/LIGHT/f3.fit' when 5 then '/nas/t6/NGC7000_lum.fit' else '/other/p/q/r.fit' end as path from orders"""


@query(
    "path_filters",
    f"""select id, case id % 7 when 0 then 'Ha' when 1 then 'OIII' when 2 then 'SII' when 3 then 'L-eXtreme' when 5 then 'L' when 6 then 'R' end as filter, case id % 7 when 5 then 'NGC 7000' end as object, case when id % 7 = 6 then 'q/r.fit' else substr(path, 6) end as short from ({PATHS_SQL})""",
)
def path_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Filter, object and short form of paths."""
    read(spark, sf, "orders").createOrReplaceTempView("orders")
    df = spark.sql(PATHS_SQL)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return df.select("id", N.filter_from_path(F.col("path")).alias("filter"), N.object_from_filename(stem).alias("object"), N.shortened(F.col("path"), ["/nas"]).alias("short"))


@query(
    "frame_roles",
    """select case when o_orderkey % 5 = 0 then 'master' when o_orderkey % 5 = 1 then 'calibration' when o_orderkey % 5 = 2 then 'sub' when o_orderkey % 5 = 3 then 'calibrated_sub' else 'unknown' end as role, count(*) as files from orders group by 1""",
)
def frame_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Roles of files whose headers are made from orders."""
    k = F.col("o_orderkey") % 5
    o = read(spark, sf, "orders")
    path = F.when(k == 0, "/n/x/masterLight_a.fit").when(k == 1, "/n/x/f.fit").when(k == 2, "/n/lights/f.fit").when(k == 3, "/n/calibrated/f.fit").otherwise("/n/misc/f.fit")
    typ = F.when(k == 1, "FLAT").when(k == 2, "LIGHT")
    role = N.role_of(path, typ, F.lit(10), F.lit(10), F.lit(None).cast("int"), F.when(k == 2, 60.0), F.lit(None).cast("string"), F.lit(1000))
    return o.groupBy(role.alias("role")).agg(F.count("*").alias("files"))
