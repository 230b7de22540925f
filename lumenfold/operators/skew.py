"""Finding the few keys that hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hot_values(df: DataFrame, key: Column, share: float = 0.02) -> list[int]:
    """Values of the hash ``key`` (bigint) that more than ``share`` of the rows hold.

    At most ``1 / share`` values come to the driver. Two passes over the key's
    columns alone: a frequent-items sketch that misses none, then exact counts.
    """
    keys = df.select(key.cast("bigint").alias("k"))
    found = [x for x in keys.freqItems(["k"], share).first()[0] if x is not None]
    if not found:
        return []
    is_found = F.when(F.col("k").isin(found), F.col("k"))
    counts = {r["k"]: r["count"] for r in keys.select(is_found.alias("k")).groupBy("k").count().collect()}
    total = sum(counts.values())
    return sorted(k for k, n in counts.items() if k is not None and n > share * total)
