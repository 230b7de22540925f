"""Dense numbers over a whole table without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.session import cut


def dense_ids(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """``df`` with ``name`` counting from ``start`` in the given total order.

    Rows are dealt into sorted ranges and numbered within them; each range is
    moved up by the sizes of those before (one small row a range).
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()}))
    first = ranged.groupBy("__p").agg(F.min("__i").alias("__first"), F.count("*").alias("__n"))
    before = first.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.join(F.broadcast(before), "__p").withColumn(name, F.col("__before") + F.col("__i") - F.col("__first") + start).drop("__p", "__i", "__first", "__n", "__before")
