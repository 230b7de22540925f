"""Queries over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import log as L
from lumenfold.plans.registry import Registry
from lumenfold.session import read

registry = Registry()
query = registry.query

KEYED_SQL = """
l as (select * exclude ("source", "key"), lower(trim("source", ' ' || chr(9))) as source, lower(trim("key", ' ' || chr(9))) as key from activity_log),
c as (select * from (select *, row_number() over (partition by source, key order by coalesce(seq, -1) desc, received_at desc, delivery_id desc) as i, count(*) over (partition by source, key) as deliveries from l) where i = 1)
"""


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return L.keyed(read(spark, sf, "activity_log"))


@query("log_current", f'with {KEYED_SQL} select source, key, delivery_id, seq, type, "at", night, severity, profileid, deliveries from c')
def log_current(spark: SparkSession, sf: str) -> DataFrame:
    """The latest revision of every event."""
    return L.current(_log(spark, sf)).select("source", "key", "delivery_id", "seq", "type", "at", "night", "severity", "profileid", "deliveries")


OUTCOME_SQL = f"""
with {KEYED_SQL}, o as (select *, max(seq) over (partition by source, key order by received_at, delivery_id rows between unbounded preceding and 1 preceding) as top, row_number() over (partition by source, key order by received_at, delivery_id) as n,
  coalesce(title, '~') || '|' || coalesce("data", '~') || '|' || coalesce(severity, '~') as content from l),
s as (select *, coalesce(seq < top, false) as stale from o), p as (select *, last_value(case when not stale then content end ignore nulls) over (partition by source, key order by received_at, delivery_id rows between unbounded preceding and 1 preceding) as last from s),
r as (select source, case when n = 1 then 'stored' when stale then 'stale' when last = content then 'unchanged' else 'updated' end as outcome from p)
select source, outcome, count(*) as deliveries from r group by 1, 2
"""


@query("log_outcomes", OUTCOME_SQL)
def log_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """How many deliveries of each source were stored, updated, unchanged or stale."""
    return L.outcomes(_log(spark, sf), ["title", "data", "severity"]).groupBy("source", "outcome").agg(F.count("*").alias("deliveries"))


NOW = "2024-06-01 00:00:00"


@query(
    "log_open_items",
    f"""with {KEYED_SQL}, v as (select unnest(resolves) as k, "at" as solved, source, key from c), w as (select k, max(row(solved, source, key)) as s from v group by 1)
    select source, key, type, resolve_key from c left join w on w.k = c.resolve_key where needs_you and resolve_key is not null and not coalesce(s[1] >= "at" and not (s[2] = source and s[3] = key), false)
    and not coalesce(type in ('safety', 'upload_failed') and "at" + interval 7 day <= timestamptz '{NOW}+00', false)""",
)
def log_open_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items that nobody has resolved and that haven't expired."""
    return L.open_items(L.current(_log(spark, sf)), F.lit(f"{NOW}+00:00").cast("timestamp")).select("source", "key", "type", "resolve_key")


@query("log_nights", f"with {KEYED_SQL} select night, count(*) as events, count(*) filter (needs_you) as needing from c where night is not null and night < date '2024-06-01' group by 1 order by 1 desc limit 31")
def log_nights(spark: SparkSession, sf: str) -> DataFrame:
    """A page of nights by keyset, with one row of lookahead."""
    return L.night_page(L.current(_log(spark, sf)), "2024-06-01", 30)


@query("log_page", f'with {KEYED_SQL} select source, key, "at" from c where night = date \'2024-03-05\' order by "at" desc, source, key limit 5 offset 3')
def log_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page of one night's events by offset."""
    return L.events_page(L.current(_log(spark, sf)), "2024-03-05", 3, 5).select("source", "key", "at")


@query("log_retained", f"with {KEYED_SQL}, n as (select min(night) as least from (select distinct night from c where night is not null order by 1 desc limit 60)) select source, key from c, n where night >= least")
def log_retained(spark: SparkSession, sf: str) -> DataFrame:
    """Events of the newest 60 nights."""
    return L.retained(L.current(_log(spark, sf)), 60)[0].select("source", "key")


@query("log_tombstones", f"with {KEYED_SQL}, n as (select min(night) as least from (select distinct night from c where night is not null order by 1 desc limit 60)) select source, key from c, n where night < least")
def log_tombstones(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that retention has made dead."""
    return L.retained(L.current(_log(spark, sf)), 60)[1]


@query(
    "log_summary",
    f"""with {KEYED_SQL} select type, severity, count(*) as events, max(received_at) as newest, min("at") as oldest from c group by 1, 2""",
)
def log_summary(spark: SparkSession, sf: str) -> DataFrame:
    return L.current(_log(spark, sf)).groupBy("type", "severity").agg(F.count("*").alias("events"), F.max("received_at").alias("newest"), F.min("at").alias("oldest"))


REPORTS_SQL = f"""
with {KEYED_SQL}, r as (select json_extract_string(refs, '$.plan_id') as plan_id, "at" as t, delivery_id, try_cast(json_extract_string("data", '$.hours') as double) as hours from c where type = 'progress_report' and "at" is not null),
q as (select * from r where plan_id is not null and hours is not null)
"""


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    df = L.current(_log(spark, sf).where("at is not null")).where("type = 'progress_report'")
    df = df.select(F.get_json_object("refs", "$.plan_id").alias("plan_id"), "at", "delivery_id", F.get_json_object("data", "$.hours").try_cast("double").alias("hours"))
    return df.where("plan_id is not null and hours is not null")


@query(
    "log_progress",
    REPORTS_SQL.replace("from l)", 'from l where "at" is not null)')
    + ", s as (select plan_id, hours, greatest(0, hours - coalesce(lag(hours) over (partition by plan_id order by t, delivery_id), 0)) as step from q) select plan_id, round(sum(step), 4) as hours, max(hours) as most from s group by 1",
)
def log_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Hours gained per plan: the positive steps of its reports."""
    return L.progress_hours(_reports(spark, sf), ["plan_id"], ["at", "delivery_id"]).select("plan_id", F.round("hours", 4).alias("hours"), "most")


@query("log_monotone", REPORTS_SQL.replace("from l)", 'from l where "at" is not null)') + "select plan_id, max(hours) as hours from q group by 1")
def log_monotone(spark: SparkSession, sf: str) -> DataFrame:
    """Progress that only rises."""
    return L.monotone(_reports(spark, sf), ["plan_id"])


@query(
    "log_last_night",
    f"""with {KEYED_SQL}, i as (select cast(cast(("at" at time zone 'UTC') - interval 19 hour as date) as varchar) as night, json_extract_string(refs, '$.plan_id') as plan_id, try_cast(json_extract_string("data", '$.hours') as double) as hours,
      try_cast(json_extract_string("data", '$.frames') as bigint) as frames from c where type = 'imaging_target' and "at" is not null)
    select night, plan_id, round(sum(hours), 4) as hours, cast(sum(frames) as bigint) as frames from i where night = (select max(night) from i where frames > 0) group by 1, 2""",
)
def log_last_night(spark: SparkSession, sf: str) -> DataFrame:
    """Hours per plan of the newest night with frames."""
    from lumenfold.operators.nights import NightClock

    df = L.current(_log(spark, sf)).where("type = 'imaging_target' and at is not null")
    df = df.select(NightClock().night(F.col("at")).alias("night"), F.get_json_object("refs", "$.plan_id").alias("plan_id"), F.get_json_object("data", "$.hours").try_cast("double").alias("hours"), F.get_json_object("data", "$.frames").try_cast("bigint").alias("frames"))
    newest = df.where("frames > 0").agg(F.max("night").alias("night"))
    return df.join(F.broadcast(newest), "night").groupBy("night", "plan_id").agg(F.round(F.sum("hours"), 4).alias("hours"), F.sum("frames").alias("frames"))


def _scrubbed_sql(text: str) -> str:
    """The same replacements, one in the other; a mark at the front of a word is put back, as the dialect has no look-behind."""
    steps = [
        (r"((?:token|password)\s*=\s*)[^\s,;&''\"]+", r"\1[redacted]", "gi"),
        (r"(^|[^\w])((?:bearer)\s+)[-\w=+/.~]+", r"\1\2[redacted]", "gi"),
        (r"([a-z][-+.a-z0-9]*://)(?:[^\s:@/]+:[^\s@/]+)@", r"\1[redacted]@", "gi"),
        (r"(^|[^a-z])[a-z]:[\\/]Users[\\/][^\\/\r\n]+[\\/]", r"\1~\\", "gi"),
        (r"/(?:Users|home)/[^/\s]+/", "~/", "g"),
    ]
    for pattern, repl, flags in steps:
        text = f"regexp_replace({text}, '{pattern}', '{repl}', '{flags}')"
    return text


@query("log_scrubbed", f"""select delivery_id, {', '.join(_scrubbed_sql(f'"{c}"') + f' as "{c}"' for c in ("title", "detail", "data"))} from activity_log""")
def log_scrubbed(spark: SparkSession, sf: str) -> DataFrame:
    """The texts of every delivery without credentials and home folders."""
    return read(spark, sf, "activity_log").select("delivery_id", *(L.scrubbed(F.col(c)).alias(c) for c in ("title", "detail", "data")))


@query(
    "log_fingerprints",
    f"""with l as (select * from activity_log where profileid is not null), x as (select profileid, max(received_at) as received_at from l group by 1) select profileid, received_at from x order by received_at desc limit 50""",
)
def log_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """The newest report of each profile, the 50 most recent."""
    return L.recent(read(spark, sf, "activity_log").select("profileid", "received_at"), [F.col("profileid")], "received_at", 50)
