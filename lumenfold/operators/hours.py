"""Hours per target, band and rig: captured, accepted, integrated, and the figure that counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import names as N
from lumenfold.session import cut

# fixed values: when a master is stale, and when it holds more than was captured
STALE_SHARE, STALE_HOURS = 0.20, 2.0
ANOMALY_SHARE, ANOMALY_HOURS = 0.05, 0.1

RIG = ("target_id", "band", "rig_fold")


def folders_of(members: DataFrame) -> DataFrame:
    """Members summed by folder, filter and rig, before any of them is credited to several bands. Written once: both the rigs and the nested folders are made from it."""
    sub = (F.col("role") == "folder_sub") & F.col("counts_captured")
    master = F.col("role") != "folder_sub"
    rank = F.struct(F.col("depth_known"), F.coalesce("hours", F.lit(0.0)).alias("hours"), F.coalesce("date", F.lit("")).alias("date"), F.coalesce("path", F.lit("")).alias("path"), F.col("session_root"))
    return cut(
        members.groupBy("target_id", "filter", "colour", F.lower("rig_key").alias("rig_fold"), "bucket").agg(
            F.min("rig_key").alias("rig_key"),
            F.sum(F.when(sub, F.col("hours"))).alias("captured"),
            F.sum(F.when(sub & F.col("accepted"), F.col("hours"))).alias("accepted"),
            F.sum(F.when(sub & ~F.col("accepted"), F.col("hours"))).alias("rejected"),
            F.sum(F.when(sub, F.col("n_subs"))).alias("n_subs"),
            F.count_if(sub).alias("n_blocks"),
            F.count_if(sub & ~F.col("accepted")).alias("n_rejected"),
            F.count_if(master).alias("n_masters"),
            F.max(F.when(master, rank)).alias("m"),
            F.collect_set(F.when(sub, F.col("session_root"))).alias("roots"),
            F.collect_set(F.when(master, F.coalesce("session_root", F.lit("")))).alias("master_roots"),
            F.min(F.when(sub, F.col("date"))).alias("first_sub_date"),
            F.max(F.when(sub, F.col("date"))).alias("last_sub_date"),
            F.max(F.when(master, F.col("date"))).alias("last_master_date"),
        )
    )


def credited(folders: DataFrame) -> DataFrame:
    """One row a folder and band that it credits in full."""
    return folders.withColumn("band", F.explode(N.bands_for(F.col("filter"), F.col("colour"))))


def ancestors(path: Column) -> Column:
    """The proper parents of a path, nearest last."""
    parts = N.segments(path)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def nested_rejects(credits: DataFrame) -> DataFrame:
    """Hours, by rig, of rejected blocks that lie below another captured block: those were counted there already.

    A folder's own ancestors are looked up among the folders: an equi-join, not
    a comparison of every pair of paths.
    """
    folders = credits.where("n_blocks > 0").groupBy(*RIG, "bucket").agg(F.sum("rejected").alias("rejected_hours"))
    at = folders.select(*RIG, F.array_join(N.segments(F.col("bucket")), "/").alias("__at")).distinct()
    below = folders.where("rejected_hours is not null").select(*RIG, "bucket", "rejected_hours", F.explode(ancestors(F.col("bucket"))).alias("__at")).join(at, [*RIG, "__at"], "left_semi")
    once = below.groupBy(*RIG, "bucket").agg(F.first("rejected_hours").alias("h"))
    return once.groupBy(*RIG).agg(F.sum("h").alias("nested_hours"))


def by_rig(members: DataFrame) -> DataFrame:
    """One row a target, band and rig.

    ``members``: target_id, role (folder_sub or master), path, filter, colour,
    rig_key, hours, depth_known, date, session_root, bucket, n_subs, accepted,
    counts_captured. Hours stay unrounded. Of several masters the deepest counts,
    a known depth before an unknown one; masters are never added up.
    """
    credits = credited(folders_of(members))
    every = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    rigs = credits.groupBy(*RIG).agg(
        F.min("rig_key").alias("rig_key"),
        F.coalesce(F.sum("captured"), F.lit(0.0)).alias("captured_hours"),
        F.coalesce(F.sum("accepted"), F.lit(0.0)).alias("plain_accepted"),
        F.coalesce(F.sum("n_subs"), F.lit(0)).alias("n_subs"),
        *(F.sum(c).alias(c) for c in ("n_blocks", "n_rejected", "n_masters")),
        F.max("m").alias("m"),
        every("roots").alias("roots"),
        every("master_roots").alias("master_roots"),
        F.min("first_sub_date").alias("first_sub_date"),
        F.max("last_sub_date").alias("last_sub_date"),
        F.max("last_master_date").alias("last_master_date"),
    )
    df = rigs.join(nested_rejects(credits), [*RIG], "left")
    integrated = F.coalesce(F.col("m.hours"), F.lit(0.0))
    accepted = F.greatest(F.lit(0.0), F.col("plain_accepted") - F.coalesce("nested_hours", F.lit(0.0)))
    df = df.withColumns({"integrated_hours": integrated, "accepted_hours": accepted})
    excess = F.col("accepted_hours") - F.col("integrated_hours")
    stale = (F.col("n_masters") > 0) & (F.col("integrated_hours") > 0) & (excess > F.least(F.col("integrated_hours") * STALE_SHARE, F.lit(STALE_HOURS)))
    covered = F.coalesce(F.array_contains("roots", F.col("m.session_root")), F.lit(False))
    anomaly = (F.col("captured_hours") > 0) & covered & (F.col("integrated_hours") > F.col("captured_hours") * (1 + ANOMALY_SHARE) + ANOMALY_HOURS)
    df = df.withColumns({"stale_master": stale, "integration_anomaly": F.coalesce(anomaly, F.lit(False))})
    deep = F.coalesce(F.col("m.depth_known"), F.lit(False)) & (F.col("integrated_hours") > 0) & ~F.col("integration_anomaly")
    basis = F.when(deep, "integrated").when(F.col("captured_hours") > 0, "captured").otherwise("none")
    headline = F.when(deep, F.col("integrated_hours")).when(F.col("captured_hours") > 0, F.col("captured_hours")).otherwise(0.0)
    return df.select(
        "target_id", "band", "rig_key", "captured_hours", "accepted_hours", "integrated_hours", headline.alias("headline_hours"), basis.alias("headline_basis"),
        F.col("m.path").alias("integrated_master"), "n_masters", "n_blocks", "n_subs", "stale_master",
        F.when(F.col("stale_master"), excess).otherwise(0.0).alias("stale_excess_hours"), "integration_anomaly",
        (F.size(F.array_except("master_roots", "roots")) > 0).alias("masters_without_subs"), (F.col("n_masters") > 1).alias("multi_master"),
        F.when(F.col("n_blocks") > 0, F.when(F.col("n_rejected") > 0, "rejected_folders").otherwise("no_rejects")).alias("accepted_basis"),
        "first_sub_date", "last_sub_date", "last_master_date",
    )


def by_band(rigs: DataFrame) -> DataFrame:
    """Sums of the unrounded rigs of each target and band; ``mixed`` if their bases differ."""
    bases = F.collect_set(F.when(F.col("headline_hours") > 0, F.col("headline_basis")))
    return rigs.groupBy("target_id", "band").agg(
        *(F.sum(c).alias(c) for c in ("captured_hours", "accepted_hours", "integrated_hours", "headline_hours", "stale_excess_hours", "n_subs")),
        F.when(F.size(bases) == 0, "none").when(F.size(bases) == 1, F.element_at(bases, 1)).otherwise("mixed").alias("headline_basis"),
        *(F.bool_or(c).alias(c) for c in ("stale_master", "integration_anomaly", "masters_without_subs", "multi_master")),
        F.count("*").alias("rigs"),
    )


def emitted(bands: DataFrame) -> DataFrame:
    """Half-even rounding to two digits, once, at the surface."""
    return bands.withColumns({c: F.bround(c, 2) for c in bands.columns if c.endswith("_hours")})


def database_floor(bands: DataFrame, database: DataFrame) -> DataFrame:
    """Raise captured hours to a database's figure where it is larger; the gap belongs to no rig.

    The headline follows only where it is built from captured hours.
    ``database``: target_id, band, db_hours.
    """
    df = bands.join(database, ["target_id", "band"], "left")
    now = F.greatest(F.col("captured_hours"), F.coalesce("db_hours", F.lit(0.0)))
    loose = F.col("headline_basis").isin("captured", "none")
    return df.select(
        "target_id", "band", now.alias("captured_hours"), (now - F.col("captured_hours")).alias("unattributed_hours"),
        F.when(loose, now).otherwise(F.col("headline_hours")).alias("headline_hours"),
        F.when(loose, F.when(now > 0, "captured").otherwise("none")).otherwise(F.col("headline_basis")).alias("headline_basis"),
    )


def integrity_flags(rigs: DataFrame) -> DataFrame:
    """One row a stale or anomalous rig, with the figure it was held against."""
    stale = rigs.where("stale_master").select("target_id", "band", "rig_key", F.lit("stale_master").alias("flag"), "integrated_hours", F.col("accepted_hours").alias("reference_hours"), F.col("stale_excess_hours").alias("excess_hours"))
    odd = rigs.where("integration_anomaly").select("target_id", "band", "rig_key", F.lit("integration_anomaly").alias("flag"), "integrated_hours", F.col("captured_hours").alias("reference_hours"), (F.col("integrated_hours") - F.col("captured_hours")).alias("excess_hours"))
    return stale.unionByName(odd)


def filter_rollup(bands: DataFrame) -> DataFrame:
    return bands.groupBy("band").agg(F.countDistinct("target_id").alias("targets"), *(F.sum(c).alias(c) for c in ("captured_hours", "accepted_hours", "integrated_hours", "headline_hours")))


def top_targets(bands: DataFrame, n: int = 15) -> DataFrame:
    """The targets with most hours; ties by id."""
    return bands.groupBy("target_id").agg(F.sum("headline_hours").alias("total_hours")).orderBy(F.desc(F.round("total_hours", 6)), "target_id").limit(n)


def deepest_filter(bands: DataFrame, least: float = 0.1, order: tuple[str, ...] = ("Ha", "OIII", "SII", "L", "R", "G", "B")) -> DataFrame:
    """Of each target the first band, in a fixed order of priority, that has enough hours."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("band"))
    ok = bands.where((F.col("headline_hours") >= max(least, 0.1)) & (place > 0))
    return ok.groupBy("target_id").agg(F.min_by("band", place).alias("deepest"))


def one_band_without_other(bands: DataFrame, have: str, missing: str, have_hours: float, missing_below: float) -> DataFrame:
    """Targets with enough hours in one band and too few in another, deepest first, with the hours per band."""
    hours = F.map_from_entries(F.array_sort(F.collect_list(F.struct("band", F.round("headline_hours", 6).alias("h")))))
    wide = bands.groupBy("target_id").agg(
        F.coalesce(F.max(F.when(F.col("band") == have, F.col("headline_hours"))), F.lit(0.0)).alias("have_hours"),
        F.coalesce(F.max(F.when(F.col("band") == missing, F.col("headline_hours"))), F.lit(0.0)).alias("missing_hours"),
        F.sum("headline_hours").alias("total_hours"), hours.alias("hours_by_band"),
    )
    return wide.where((F.col("have_hours") >= have_hours) & (F.col("missing_hours") < missing_below)).orderBy(F.desc("have_hours"), "target_id")


def running_share(bands: DataFrame) -> DataFrame:
    """Each band's share of its target's hours."""
    total = F.sum("headline_hours").over(Window.partitionBy("target_id"))
    return bands.withColumn("share", F.when(total > 0, F.col("headline_hours") / total))
