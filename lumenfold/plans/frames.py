"""Queries on repeated exposures, clusters and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import sphere as S
from lumenfold.operators import copies_of_frames as C
from lumenfold.operators import graph as G
from lumenfold.operators.sky import sky_join
from lumenfold.plans.registry import Registry
from lumenfold.session import cut, read

registry = Registry()
query = registry.query

# folders of an archive: an order's lines as frames, with few unlike capture times so that copies occur
TIMES_SQL = "select l_orderkey % 400 as grp, l_orderkey as block, l_partkey % 9 as t, count(*) as n from lineitem group by 1, 2, 3"


def _times(spark: SparkSession, sf: str) -> DataFrame:
    # an order's lines come together once; whatever groups by block later needs no other exchange
    read(spark, sf, "lineitem").repartition("l_orderkey").createOrReplaceTempView("lineitem")
    return spark.sql(TIMES_SQL)


COPIES_SQL = f"""
with t as ({TIMES_SQL}), b as (select grp, block, sum(n) as frames, count(*) as kinds from t group by 1, 2 having count(*) > 1),
x as (select t.*, b.frames, b.kinds from t join b using (grp, block)),
c as (
  select i.grp, i.block, o.block as outer_block, o.frames as outer_frames from x i join x o on i.grp = o.grp and i.t = o.t and o.n >= i.n and (o.frames > i.frames or (o.frames = i.frames and o.block < i.block))
  group by 1, 2, 3, 4, i.kinds having count(*) = i.kinds)
"""


@query("whole_copies", COPIES_SQL + "select grp, block, first(outer_block order by outer_frames desc, outer_block) as keeper from c group by 1, 2")
def whole_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Folders whose capture times all lie in an earlier-ranked folder."""
    return C.whole_copies(_times(spark, sf))


@query(
    "partial_copies",
    f"""with t as ({TIMES_SQL}), b as (select grp, block, sum(n) as frames, count(*) as kinds from t group by 1, 2 having count(*) > 1), x as (select t.*, b.frames from t join b using (grp, block)),
    s as (select *, least(n, coalesce(max(n) over (partition by grp, t order by frames desc, block rows between unbounded preceding and 1 preceding), 0)) as shared from x)
    select grp, block, cast(frames as bigint) as frames, cast(sum(shared) as bigint) as lost from s group by grp, block, frames having sum(shared) >= 5 and sum(shared) >= frames * 0.1""",
)
def partial_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Frames that a folder shares with earlier-ranked ones, where they are enough to be taken from it."""
    return C.partial_copies(_times(spark, sf))


@query(
    "condemned_hours",
    f"with t as ({TIMES_SQL}), m as (select grp, t, max(n) as n from t where block % 3 = 0 group by 1, 2) select grp, round(sum(n) * 300 / 3600.0, 6) as hours from m group by 1",
)
def condemned_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Hours of the multiset union of rejected copies: each capture time counts as often as the folder with most of it."""
    t = _times(spark, sf).where("block % 3 = 0").groupBy("grp", "t").agg(F.max("n").alias("n"))
    return t.groupBy("grp").agg(F.round(F.sum("n") * 300 / 3600.0, 6).alias("hours"))


STAGES_SQL = """
select o_custkey as session, o_orderkey % 3 as filter, case o_orderkey % 5 when 0 then 'registered' when 1 then 'calibrated' when 2 then 'og' when 3 then 'master' else 'root' end as stage, o_orderkey as block,
  '/a/' || cast(o_custkey as varchar(20)) || '/' || cast(o_orderkey % 97 as varchar(20)) as bucket, o_orderstatus = 'O' as captured, o_orderpriority < '3' as accepted from orders
"""
STAGE_RANK_SQL = "case stage when 'og' then 0 when 'root' then 1 when 'calibrated' then 2 when 'registered' then 3 else 4 end"


@query("stage_winner", f"with s as ({STAGES_SQL}), r as (select *, {STAGE_RANK_SQL} as k from s) select session, filter, stage, block from r where k = (select min(k) from r q where q.session = r.session and q.filter = r.filter)")
def stage_winner(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of the first stage of every session and filter."""
    read(spark, sf, "orders").createOrReplaceTempView("orders")
    return C.stage_winner(spark.sql(STAGES_SQL).select("session", "filter", "stage", "block"), ["session", "filter"])


@query(
    "content_survivors",
    f"""with s as ({STAGES_SQL}) select session, filter, first(bucket order by not captured, not accepted, len(bucket), bucket) as bucket, bool_or(captured) as captured, bool_or(accepted) as accepted, count(*) as copies from s group by 1, 2""",
)
def content_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """One block of every content key, with the flags of its copies."""
    read(spark, sf, "orders").createOrReplaceTempView("orders")
    return C.content_survivors(spark.sql(STAGES_SQL).select("session", "filter", "bucket", "captured", "accepted"), ["session", "filter"])


MASTERS_SQL = """
select 'd' || cast(p_partkey % 40 as varchar(20)) as folder, 'stack_' || cast(p_partkey % 7 as varchar(20)) || case p_partkey % 6 when 0 then '' when 1 then '_ABE' when 2 then '_dbe2' when 3 then ' (2)' when 4 then '_final_v3' else '_drizzle_2x_autocrop' end as stem,
  case when p_partkey % 40 = 3 then p_brand else 'Ha' end as filter, cast(10 + p_partkey % 40 as double) as ra_deg, case when p_partkey % 40 = 5 then 20 + p_size / 100.0 else 20.0 end as dec_deg, p_size as ncombine, cast(p_partkey as varchar(20)) as path from part
"""


@query(
    "master_variants",
    rf"""with m as (select *, regexp_replace(stem, '^(.+?)([_\s-](starless|stars|starmask|nostars|autocrop|crop|cropped|trimmed|abe|dbe|gradient|bg|background|denoise|denoised|nr|decon|deconvolved|sharpened|stretched|nonlinear|linear|ht|stf|final|processed|edit|edited|clone|copy|preview|drizzle|drz|1x|2x|3x|4x)[0-9]*|[\s_-]*\([0-9]+\))+$', '\1', 'i') as base from ({MASTERS_SQL}) q),
    g as (select folder, base, count(distinct filter) as filters, max(dec_deg) - min(dec_deg) as spread, first(dec_deg order by ncombine desc, len(path), path) as d0, first(path order by ncombine desc, len(path), path) as winner from m group by 1, 2)
    select folder, stem, filter, path from m join g using (folder, base) where filters > 1 or winner = path or exists (select 1 from m n where n.folder = m.folder and n.base = m.base and abs(n.dec_deg - d0) * 60 > 2.0)""",
)
def master_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Masters after the variants of one stack have folded to the deepest."""
    read(spark, sf, "part").createOrReplaceTempView("part")
    return C.collapse_variants(spark.sql(MASTERS_SQL)).select("folder", "stem", "filter", "path")


@query(
    "edit_runs",
    """with e as (select source, "at" as t, delivery_id, type, sum(case when type is distinct from p or i = 1 then 1 else 0 end) over (partition by source order by delivery_id) as run from (
      select *, lag(type) over (partition by source order by delivery_id) as p, row_number() over (partition by source order by delivery_id) as i from activity_log))
    select source, cast(run as bigint) as run, type, min(delivery_id) as first, max(delivery_id) as last, count(*) as rows from e group by 1, 2, 3""",
)
def edit_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Adjacent log rows of one source and type, folded."""
    return C.runs(read(spark, sf, "activity_log").select("source", "delivery_id", "type"), ["source"], ["delivery_id"], ["type"])


def places(points: DataFrame, key: str) -> DataFrame:
    """k, v and the least key ``rep`` of the rows at exactly the same place; rows without a place drop out.

    Rows that share a place are never paired among themselves: the place is
    joined once, through its representative.
    """
    v = points.select(F.col(key).alias("k"), S.xyz(F.col("ra_deg"), F.col("dec_deg")).alias("v")).where("v is not null")
    first = v.groupBy("v").agg(F.min("k").alias("rep"))
    return cut(v.join(first, "v").select("k", "v", "rep"))


def near_pairs(at: DataFrame, radius_deg: float) -> DataFrame:
    """Pairs (a, b) of representatives within a radius, each once."""
    v = at.where("k = rep")
    a, b = v.select(F.col("k").alias("a"), F.col("v").alias("__v")), v.select(F.col("k").alias("b"), F.col("v").alias("__c"))
    return sky_join(a, b, radius_deg).where("a < b").select("a", "b")


POINTS_SQL = "select candidate_id as k, cos(radians(dec_deg)) * cos(radians(ra_deg)) as x, cos(radians(dec_deg)) * sin(radians(ra_deg)) as y, sin(radians(dec_deg)) as z from gap_candidate where ra_deg is not null and dec_deg is not null"


@query(
    "sky_components",
    f"""with recursive p as ({POINTS_SQL}), e as (select a.k as a, b.k as b from p a, p b where a.k <> b.k and degrees(2 * asin(least(1, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) / 2))) <= 0.5),
    r as (select a as node, a as root from e union select e.b, r.root from r join e on e.a = r.node) select node, min(root) as component from r group by 1""",
)
def sky_components(spark: SparkSession, sf: str) -> DataFrame:
    """Single-link groups of catalogue points within half a degree."""
    at = places(read(spark, sf, "gap_candidate"), "candidate_id")
    copies = at.where("k <> rep").select(F.col("rep").alias("a"), F.col("k").alias("b"))
    return G.connected_components(near_pairs(at, 0.5).unionByName(copies))


@query("sky_clusters")
def sky_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered greedy clusters of catalogue points within half a degree."""
    at = places(read(spark, sf, "gap_candidate"), "candidate_id")
    seeds = G.ordered_clusters(at.where("k = rep").select(F.col("k").alias("node")), near_pairs(at, 0.5))
    # a copy is later than its representative and reaches the same seeds
    return at.join(seeds.withColumnRenamed("node", "rep"), "rep").select(F.col("k").alias("node"), "seed")
