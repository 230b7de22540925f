"""Small rules over groups of blocks, objects and settings, each as one aggregate joined back or a keyed last write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inherit_pointing(blocks: DataFrame, keys: list[str], rank: list[Column], ra: str = "ra_deg", dec: str = "dec_deg") -> DataFrame:
    """Blocks without a position borrow it from the first of their group that has one; ``inherited`` says so."""
    donor = blocks.where(F.col(ra).isNotNull() & F.col(dec).isNotNull()).groupBy(*keys).agg(F.min_by(F.struct(ra, dec), F.struct(*(r.alias(f"k{i}") for i, r in enumerate(rank)))).alias("__d"))
    df = blocks.join(donor, keys, "left")
    takes = (F.col(ra).isNull() | F.col(dec).isNull()) & F.col("__d").isNotNull()
    return df.withColumns({ra: F.when(takes, F.col(f"__d.{ra}")).otherwise(F.col(ra)), dec: F.when(takes, F.col(f"__d.{dec}")).otherwise(F.col(dec)), "inherited": takes}).drop("__d")


def only_value(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """The value of each group if all its rows that have one agree, else null. Minimum and maximum tell: no set is collected."""
    g = rows.groupBy(*keys).agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
    return g.select(*keys, F.when(F.col("__a") == F.col("__b"), F.col("__a")).alias(out))


def richest(rows: DataFrame, keys: list[str], fields: list[str], tie: str) -> DataFrame:
    """One row of each key: the one with most of the fields known, then the smallest ``tie``."""
    known = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    rest = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct((-known).alias("n"), F.col(tie).alias("t")))
    return rows.dropna(subset=keys).groupBy(*keys).agg(best.alias("r")).select(*keys, "r.*")


def first_settings(rows: DataFrame, keys: list[str], order: Column, fields: list[str]) -> DataFrame:
    """Of each field the first value in order that isn't null, and whether the group's rows disagree on it."""
    aggs = []
    for f in fields:
        aggs.append(F.min_by(f, F.when(F.col(f).isNotNull(), order)).alias(f))
        aggs.append((F.min(f) != F.max(f)).alias(f"{f}_differs"))
    return rows.groupBy(*keys).agg(*aggs).na.fill(False, [f"{f}_differs" for f in fields])


def coalesced_changes(changes: DataFrame, keys: list[str], at: list[str]) -> DataFrame:
    """Changes of one thing in one night as one: the first ``from``, the last ``to``; what came back to its start drops out."""
    order = F.struct(*at)
    g = changes.groupBy(*keys).agg(F.min_by(F.struct("from"), order).alias("a"), F.max_by(F.struct("to"), order).alias("b"), F.count("*").alias("changes"))
    return g.select(*keys, F.col("a.from").alias("from"), F.col("b.to").alias("to"), "changes").where(~F.col("from").eqNullSafe(F.col("to")))


def merged_pages(have: DataFrame, got: DataFrame, night: str, key: str, complete: DataFrame) -> DataFrame:
    """Rows on hand after a page came in: rows of a complete night are replaced, others upserted by key."""
    nights = complete.select(night).distinct()
    stay = have.join(nights, night, "left_anti").join(got.select(key), key, "left_anti")
    return stay.select(*have.columns).unionByName(got)


def last_writes(rows: DataFrame, keys: list[str], at: list[str], value: str) -> DataFrame:
    """Keyed marks: the last write of each key; a null or false value deletes."""
    g = rows.groupBy(*keys).agg(F.max_by(F.struct(value), F.struct(*at)).alias("v"))
    return g.select(*keys, F.col(f"v.{value}").alias(value)).where(F.col(value).isNotNull() & (F.col(value).cast("string") != "false"))


def sources_over(regions: DataFrame, source: str, hours: str, least: float) -> DataFrame:
    """Sources of which any region has the hours, or that have no regions at all (one row with null): regions are never trimmed."""
    g = regions.groupBy(source).agg(F.max(hours).alias("most"))
    return g.where((F.col("most") >= least) | F.col("most").isNull()).select(source)


def facet_counts(items: DataFrame, filters: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Counts of each facet's values over the items that all the other facets let through. One pass.

    ``filters``: facet to (array of the item's values, predicate).
    """
    names = list(filters)
    entries = []
    labelled = lambda n: lambda v: F.struct(F.lit(n).alias("facet"), v.alias("value"))
    for n in names:
        others = F.lit(True)
        for o in names:
            if o != n:
                others = others & F.coalesce(filters[o][1], F.lit(False))
        entries.append(F.transform(F.when(others, F.array_distinct(filters[n][0])).otherwise(F.array().cast("array<string>")), labelled(n)))
    return items.select(F.explode(F.flatten(F.array(*entries))).alias("e")).groupBy("e.facet", "e.value").agg(F.count("*").alias("items"))
