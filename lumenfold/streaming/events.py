"""The event log as a stream of upserts: at-least-once deliveries in, the latest revision of each event out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.operators import log as L
from lumenfold.session import scratch
from lumenfold.streaming.nights import _as_glob


class EventStream:
    """Deltas of each micro-batch below ``work``; the state is their merge.

    A batch that runs again replaces its own delta. Merging takes the greatest
    (seq, arrival, delivery), so order and repeats don't matter.
    """

    def __init__(self, spark: SparkSession, work: str | None = None) -> None:
        self.spark, self.work = spark, work or scratch(spark, "events")

    def run(self, path: str, max_files: int | None = None) -> "EventStream":
        """Take in what has arrived at ``path`` since the last run."""
        source = self.spark.readStream.schema(self.spark.read.parquet(path).schema)
        if max_files:
            source = source.option("maxFilesPerTrigger", max_files)
        query = source.parquet(_as_glob(self.spark, path)).writeStream.foreachBatch(self._append).option("checkpointLocation", f"{self.work}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
        return self

    def _append(self, batch: DataFrame, batch_id: int) -> None:
        newest = L.current(L.keyed(batch)).drop("deliveries", "first_received")
        newest.write.mode("overwrite").parquet(f"{self.work}/deltas/b{batch_id}")

    def current(self) -> DataFrame:
        """The latest revision of every event."""
        return L.current(self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.work}/deltas")).drop("deliveries", "first_received")
