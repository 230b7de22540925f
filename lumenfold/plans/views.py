"""Deterministic stand-ins for archive tables, as DataFrames and as the same SQL.

The star-schema tables hold no images, so frames, fields and plans are derived
from them with plain arithmetic that any engine repeats exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.session import read

# fixed values: raw spellings that the derived frames carry
RAW_FILTERS = ("Ha", "halpha", " oiii", "O3", "S-II", "lum", "RED", "Green", "b", "L-eXtreme", "none", "?", "SV220_Ha-Oiii_3nm", "Antlia OIII", "7", "Sodium")
RAW_SCOPES = ("Astro-Physics 110GTX", "RedCat51", "hyperstar", "EQ6-R Pro", "William Optics RedCat 51", " ")
RAW_CAMERAS = ("ZWO ASI2600MM Pro", "asi2600mc  pro", "Player One Poseidon-C", "QHY 268M")


def _pick(values: tuple[str, ...], index: str) -> str:
    return "(case " + " ".join(f"when {index} = {i} then '{v}'" for i, v in enumerate(values)) + " end)"


# whole rows of lineitem are unique, so the file name holds enough columns to be so, too
FRAMES_SQL = f"""
select l_partkey as target_id,
  {_pick(RAW_FILTERS, f"(l_suppkey + l_linenumber) % {len(RAW_FILTERS)}")} as raw_filter,
  {_pick(RAW_SCOPES, f"l_suppkey % {len(RAW_SCOPES)}")} as raw_scope,
  {_pick(RAW_CAMERAS, f"l_orderkey % {len(RAW_CAMERAS)}")} as raw_camera,
  (l_orderkey % {len(RAW_CAMERAS)}) in (1, 2) as colour,
  l_linestatus = 'F' and l_linenumber <= 2 as is_master,
  cast(60 * (1 + l_linenumber) as double) as exptime,
  cast(l_quantity as bigint) as n_subs,
  l_returnflag <> 'R' as accepted,
  '/archive/t' || cast(l_partkey as varchar(20)) || '/s' || cast(l_orderkey % 5 as varchar(20)) as session_root,
  '/archive/t' || cast(l_partkey as varchar(20)) || '/s' || cast(l_orderkey % 5 as varchar(20)) || '/lights' || case when l_returnflag = 'R' and l_suppkey % 2 = 0 then '/rejected' else '' end as bucket,
  'f' || cast(l_orderkey as varchar(20)) || '_' || cast(l_linenumber as varchar(20)) || '_' || cast(l_suppkey as varchar(20)) || '_' || cast(cast(round(l_extendedprice * 100) as bigint) as varchar(20)) || '.fits' as file_name,
  substring(cast(l_shipdate as varchar(40)), 1, 10) as night
from lineitem
"""

# fields of the sky, well spread: integer arithmetic only
FIELDS_SQL = """
select p_partkey as target_id, 360.0 * ((p_partkey * 754877) % 1000000) / 1000000.0 as ra_deg,
  degrees(asin(2.0 * ((p_partkey * 569841) % 1000000) / 1000000.0 - 1.0)) as dec_deg, p_name as name, cast(p_size as double) as size_arcmin
from part
"""

# catalogue points near fields: offsets of up to 0.9 degrees along the declination
POINTS_SQL = f"""
select c_custkey as point_id, c_mktsegment as category, f.ra_deg as ra_deg,
  greatest(-89.0, least(89.0, f.dec_deg + ((c_custkey * 7919) % 19 - 9) * 0.1)) as dec_deg
from customer join ({FIELDS_SQL}) f on f.target_id = c_custkey % 2000 + 1
"""

# plans: one an order, grouped into projects by customer
PLANS_SQL = """
select o_orderkey as plan_id, o_custkey as project_id, case o_orderstatus when 'O' then 'active' when 'F' then 'closed' else 'draft' end as state,
  case substring(o_orderpriority, 1, 1) when '1' then 2 when '2' then 1 else 0 end as priority_rank, round(o_totalprice / 10000.0, 4) as goal_hours,
  o_orderkey % 3 as rig, o_orderdate as created
from orders
"""


def _views(spark: SparkSession, sf: str, *tables: str) -> None:
    for t in tables:
        read(spark, sf, t).createOrReplaceTempView(t)


def frames(spark: SparkSession, sf: str) -> DataFrame:
    _views(spark, sf, "lineitem")
    return spark.sql(FRAMES_SQL)


def fields(spark: SparkSession, sf: str) -> DataFrame:
    _views(spark, sf, "part")
    return spark.sql(FIELDS_SQL)


def points(spark: SparkSession, sf: str) -> DataFrame:
    _views(spark, sf, "customer", "part")
    return spark.sql(POINTS_SQL)


def plans(spark: SparkSession, sf: str) -> DataFrame:
    _views(spark, sf, "orders")
    return spark.sql(PLANS_SQL)
