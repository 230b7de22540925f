"""A keyed event log: revisions, open items, expiry, retention, redaction, paging and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import folded

EVENT = ("source", "key")

# fixed values: types of event that expire, and after how many days
EXPIRING, EXPIRY_DAYS = ("safety", "upload_failed"), 7

#: Names that announce a secret: the words before an equals sign, and those before a blank.
ASSIGNED, SPOKEN = ("token", "password"), ("bearer",)
#: Where home folders lie, up to the name of the user; the first kind with slashes, the second with a drive and either slash.
HOMES = ("Users", "home")


def _secrets() -> list[tuple[str, str]]:
    """Patterns and what stays of them. A value ends at a blank, a quote or a mark that separates values."""
    assigned, spoken, homes = "|".join(ASSIGNED), "|".join(SPOKEN), "|".join(HOMES)
    return [
        (rf"(?i)((?:{assigned})\s*=\s*)[^\s,;&'\"]+", "$1[redacted]"),
        (rf"(?i)(?<!\w)((?:{spoken})\s+)[-\w=+/.~]+", "$1[redacted]"),
        (r"(?i)([a-z][-+.a-z0-9]*://)(?:[^\s:@/]+:[^\s@/]+)(?=@)", "$1[redacted]"),
        (rf"(?i)(?<![a-z])[a-z]:[\\/]{HOMES[0]}[\\/][^\\/\r\n]+[\\/]", r"~\\"),
        (rf"/(?:{homes})/[^/\s]+/", "~/"),
    ]


def keyed(log: DataFrame) -> DataFrame:
    """The log with one spelling of source and key."""
    return log.withColumns({"source": folded("source"), "key": folded("key")})


def current(log: DataFrame) -> DataFrame:
    """The latest revision of each event: the highest seq (null lowest), then the latest arrival, then the greatest delivery."""
    rank = F.struct(F.coalesce("seq", F.lit(-1)).alias("s"), F.col("received_at").alias("r"), F.col("delivery_id").alias("d"))
    rest = [c for c in log.columns if c not in EVENT]
    return log.groupBy(*EVENT).agg(F.max_by(F.struct(*rest), rank).alias("e"), F.count("*").alias("deliveries"), F.min("received_at").alias("first_received")).select(*EVENT, "e.*", "deliveries", "first_received")


def outcomes(log: DataFrame, content: list[str]) -> DataFrame:
    """What each delivery did when it arrived: stored, updated, unchanged or stale.

    A delivery is stale if an earlier one had a higher seq. Of the others, one
    with the content of the one before it is unchanged. Arrival is by
    received_at, then delivery_id.
    """
    w = Window.partitionBy(*EVENT).orderBy("received_at", "delivery_id")
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    df = log.withColumns({"__top": F.max("seq").over(prior), "__i": F.row_number().over(w), "__c": F.sha1(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}))})
    stale = F.coalesce(F.col("seq") < F.col("__top"), F.lit(False))
    df = df.withColumn("__live", F.when(~stale, F.col("__c")))
    last = F.last("__live", ignorenulls=True).over(prior)
    outcome = F.when(F.col("__i") == 1, "stored").when(stale, "stale").when(last == F.col("__c"), "unchanged").otherwise("updated")
    return df.withColumn("outcome", outcome).drop("__top", "__i", "__c", "__live")


def open_items(now: DataFrame, at: Column) -> DataFrame:
    """Events that need somebody: with a resolve key that no other event resolved since, and not expired at ``at``.

    ``now`` is :func:`current`. A resolution may have arrived before its item;
    only the times of the events count.
    """
    solved = now.select(F.explode("resolves").alias("resolve_key"), F.col("at").alias("solved"), *(F.col(c).alias(f"by_{c}") for c in EVENT))
    latest = solved.groupBy("resolve_key").agg(F.max(F.struct("solved", "by_source", "by_key")).alias("s"))
    items = now.where("needs_you and resolve_key is not null").join(latest, "resolve_key", "left")
    own = (F.col("s.by_source") == F.col("source")) & (F.col("s.by_key") == F.col("key"))
    closed = F.coalesce((F.col("s.solved") >= F.col("at")) & ~own, F.lit(False))
    expires = F.when(F.col("type").isin(*EXPIRING), F.timestamp_micros(F.unix_micros("at") + EXPIRY_DAYS * 86_400_000_000))
    return items.withColumn("expires_at", expires).where(~closed & ~F.coalesce(F.col("expires_at") <= at, F.lit(False))).drop("s")


def scrubbed(text: Column) -> Column:
    """Text without tokens, passwords, credentials of addresses and the names of home folders."""
    for pattern, repl in _secrets():
        text = F.regexp_replace(text, pattern, repl)
    return text


def retained(now: DataFrame, keep_nights: int) -> tuple[DataFrame, DataFrame]:
    """Events of the newest nights, and the keys of the others, which stay dead.

    Only the distinct nights, one a day at most, are ranked.
    """
    nights = now.select("night").where("night is not null").distinct().orderBy(F.desc("night")).limit(keep_nights)
    least = nights.agg(F.min("night").alias("__least"))
    df = now.crossJoin(F.broadcast(least))  # one row
    return df.where("night >= __least").drop("__least"), df.where("night < __least").select(*EVENT)


def night_page(now: DataFrame, before: str | None, size: int) -> DataFrame:
    """Nights before a given one, newest first, one more than asked for so that the caller sees whether there are more."""
    df = now.where("night is not null")
    if before is not None:
        df = df.where(F.col("night") < F.lit(before).cast("date"))
    return df.groupBy("night").agg(F.count("*").alias("events"), F.count_if(F.col("needs_you")).alias("needing")).orderBy(F.desc("night")).limit(size + 1)


def events_page(now: DataFrame, night: str, offset: int, size: int = 200) -> DataFrame:
    """One page of a night, newest first."""
    df = now.where(F.col("night") == F.lit(night).cast("date"))
    return df.orderBy(F.desc("at"), *EVENT).offset(offset).limit(size)


def progress_hours(reports: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Sum of the positive steps of a figure that is reported again and again."""
    w = Window.partitionBy(*by).orderBy(*order)
    step = F.greatest(F.lit(0.0), F.col("hours") - F.coalesce(F.lag("hours").over(w), F.lit(0.0)))
    return reports.withColumn("step", step).groupBy(*by).agg(F.sum("step").alias("hours"), F.max("hours").alias("most"))


def monotone(reports: DataFrame, by: list[str]) -> DataFrame:
    """Progress that only rises: the greatest figure of each part."""
    return reports.groupBy(*by).agg(F.max("hours").alias("hours"))


def recent(rows: DataFrame, identity: list[Column], at: str, keep: int) -> DataFrame:
    """The latest row of each identity (the first of several names that isn't null), and of those the newest ``keep``."""
    who = F.coalesce(*identity)
    rest = F.struct(*rows.columns)
    latest = rows.withColumn("__who", who).where("__who is not null").groupBy("__who").agg(F.max_by(rest, F.struct(at, F.xxhash64(*rows.columns))).alias("r"))
    return latest.select("r.*").orderBy(F.desc(at)).limit(keep)
