"""Ranked tiles of the sky: filters, completion and summaries over their maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tile_passes(priorities: list[int], missing: list[str], categories: list[str], facets: dict[str, list[str]] | None = None) -> Column:
    """Whether a tile stays: its priority is chosen (0 always is), it lacks every ticked band, has a ticked category, and its facets fit.

    Columns: priority, per_band map<string, struct<covered>>, category_counts
    map<string, int>, metadata map<string, string>. Empty choices don't filter.
    """
    rank = F.coalesce("priority", F.lit(0))
    tests = [(rank == 0) | rank.isin(*priorities)]
    tests += [~F.coalesce(F.try_element_at("per_band", F.lit(b))["covered"], F.lit(False)) for b in missing]
    if categories:
        tests.append(reduce(lambda a, b: a | b, (F.coalesce(F.try_element_at("category_counts", F.lit(c)) > 0, F.lit(False)) for c in categories)))
    for field, chosen in (facets or {}).items():
        tests.append(F.coalesce(F.try_element_at("metadata", F.lit(field)).isin(*chosen), F.lit(True)))
    return reduce(lambda a, b: a & b, tests)


def completion() -> Column:
    """Share of a tile's bands that are covered."""
    n = F.size(F.map_values("per_band"))
    covered = F.size(F.filter(F.map_values("per_band"), lambda b: F.coalesce(b["covered"], F.lit(False))))
    return F.when(n > 0, covered / n).otherwise(0.0)


def tile_summary(tiles: DataFrame) -> DataFrame:
    """One row: tiles, highest priority, mean completion."""
    return tiles.agg(F.count("*").alias("tiles"), F.max("priority").alias("max_priority"), F.round(F.avg(completion()), 6).alias("completion"))
