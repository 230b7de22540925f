"""The per-night aggregates as a Structured Streaming job with upserts.

A streaming aggregation keeps the state of every event whose night is open. Its
watermark is the least of two clocks, the arrivals (less the disorder of their
transport) and the limits of the nights seen: so a sender clock that runs ahead
closes nothing, and a state is dropped once no delivery can come in time for
it. Each micro-batch gives the states it touched; they are appended as a delta,
and the nights they touch are emitted again in full: an upsert by ``night``,
the newest batch wins. Deltas are merged every few batches, and nights the
watermark has closed are put aside for good and not read again, so what a batch
reads stays in proportion to the open nights, however long the stream has run.
Deliveries after the limit of their night change
no state and flow into a table of their own.

Folders are named by the batch, so a batch that runs again after a failure
replaces its own output and nothing else.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.operators import nights as N
from lumenfold.session import remove, scratch

NEEDED = ("source", "key", "seq", "at", "received_at", "delivery_id", "data")

#: Two watermarks hold for one aggregation (the least counts); the engine takes that only where it may not chain stateful operators.
ONE_OPERATOR = "spark.sql.streaming.statefulOperator.allowMultiple"

#: Months that a batch names to read only their parts; with more it reads all that are open.
MONTHS = 100


def _as_glob(spark: SparkSession, path: str) -> str:
    """A single file as a pattern that matches it alone: a stream takes folders or patterns."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p) or fs.getFileStatus(p).isDirectory():
        return path
    head, _, name = path.rpartition("/")
    return f"{head}/[{name[0]}]{name[1:]}"


class NightStream:
    """Open and closed states, emitted nights and diverted late records of one stream, below ``work``.

    ``disorder_hours``: how much later than others a delivery may be handed
    over, measured in arrivals. A delivery in time that the transport holds up
    for longer would find its state dropped; this is noticed, and everything is
    replayed with ten times the disorder, so that no delivery is lost.
    """

    def __init__(self, spark: SparkSession, work: str | None = None, clock: N.NightClock = N.NightClock(), disorder_hours: int = 24, merge_every: int = 8) -> None:
        self.spark, self.clock, self.disorder, self.merge_every = spark, clock, disorder_hours, merge_every
        self.root = work or scratch(spark, "nights")
        self.open_states = 0

    @property
    def work(self) -> str:
        return f"{self.root}/disorder={self.disorder}"

    def run(self, path: str, max_files: int | None = None) -> "NightStream":
        """Take in everything that has arrived at ``path`` since the last run, then stop."""
        while self._run(path, max_files):
            remove(self.spark, self.work)
            self.disorder *= 10
        return self

    def _parts(self, path: str, max_files: int | None) -> int:
        """Parts of the state: the session's number is for the whole input, a batch has so many files of it. Every part costs two tasks and a commit a batch."""
        every = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if not max_files:
            return every
        share = max_files / max(1, len(self.spark.read.parquet(path).inputFiles()))
        return min(every, max(self.spark.sparkContext.defaultParallelism, math.ceil(every * share)))

    def _run(self, path: str, max_files: int | None) -> int:
        """One pass; gives how many rows came in time and found their state dropped."""
        spark = self.spark
        schema = T.StructType([f for f in spark.read.parquet(path).schema if f.name in NEEDED])
        source = spark.readStream.schema(schema)
        if max_files:
            source = source.option("maxFilesPerTrigger", max_files)
        arrivals = N.arrivals(source.parquet(_as_glob(spark, path)), self.clock)
        clocks = arrivals.withWatermark("received_at", f"{self.disorder} hours")
        states = N.keyed(N.in_time(clocks).withWatermark("until", "0 seconds"))
        needs = {ONE_OPERATOR: "false", "spark.sql.streaming.numRecentProgressUpdates": "1000000", "spark.sql.shuffle.partitions": str(self._parts(path, max_files))}
        before = {k: spark.conf.get(k) for k in needs}
        for k, v in needs.items():
            spark.conf.set(k, v)
        try:
            upserts = states.writeStream.outputMode("update").foreachBatch(self._upsert).option("checkpointLocation", f"{self.work}/progress").trigger(availableNow=True).start()
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
        late = N.diverted(arrivals, self.clock).writeStream.format("parquet").option("checkpointLocation", f"{self.work}/progress-diverted").trigger(availableNow=True).start(f"{self.work}/diverted")
        upserts.awaitTermination()
        late.awaitTermination()
        operators = [o for p in upserts.recentProgress for o in p.stateOperators]
        if operators:
            self.open_states = operators[-1].numRowsTotal
        return sum(o.numRowsDroppedByWatermark for o in operators)

    def _folders(self, what: str) -> list[int]:
        """The batches whose folders are complete, in order."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.work}/{what}")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        done = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.work}/{what}/{n}/_SUCCESS"))]
        return sorted(int(m.group(1)) for n in done if (m := re.fullmatch(r"batch=(\d+)", n)))

    def _read(self, what: str, batches: list[int]) -> list[DataFrame]:
        """The tables of these batches; their columns are the same."""
        if not batches:
            return []
        table = self.spark.read.schema(STATES).option("basePath", f"{self.work}/{what}").parquet(*(f"{self.work}/{what}/batch={b}" for b in batches))
        return [table.select(*(f.name for f in STATES))]

    def _open(self) -> list[DataFrame]:
        """What isn't put aside: the newest merged states and the deltas after them."""
        merged = self._folders("merged")[-1:]
        return self._read("merged", merged) + self._read("deltas", [b for b in self._folders("deltas") if b > max(merged, default=-1)])

    def _write(self, states: DataFrame, to: str) -> None:
        # a month is a part: few files, and a touched night reads one; rebalance splits a month that is too large for a task
        states.select(*(f.name for f in STATES)).hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(f"{self.work}/{to}")

    def _upsert(self, batch: DataFrame, batch_id: int) -> None:
        dated = batch.withColumn("night", self.clock.night(F.col("at")))
        self._write(dated.withColumn("month", F.substring("night", 1, 7)), f"deltas/batch={batch_id}")
        touched = self._read("deltas", [batch_id])[0].select("month", "night").distinct()
        # what was put aside lies behind the watermark of every later batch; only a batch that runs again may have done so itself
        every = reduce(DataFrame.unionByName, self._open() + self._read("closed", [b for b in self._folders("closed") if b == batch_id]))
        months = [r[0] for r in touched.select("month").distinct().limit(MONTHS + 1).collect()]
        if len(months) <= MONTHS:
            every = every.where(F.col("month").isin(months))
        states = N.merge(every.join(touched, ["month", "night"], "left_semi"))
        N.totals(N.classify(states, self.clock)).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{self.work}/nights/b{batch_id}")
        if (batch_id + 1) % self.merge_every == 0:
            self._merge(batch_id)

    def _merge(self, batch_id: int) -> None:
        """Merge the open states, and put the nights aside that are closed; the merged folder is written last and makes it count."""
        old, deltas = self._folders("merged"), self._folders("deltas")
        if batch_id in old:
            return
        states = reduce(DataFrame.unionByName, self._open())
        clock = states.agg(F.max("last_received")).first()[0]
        if clock is None:
            return
        states = N.merge(states).withColumns({"until": self.clock.limit(F.col("at")), "night": self.clock.night(F.col("at"))}).withColumn("month", F.substring("night", 1, 7))
        over = F.col("until") < F.lit(clock) - F.make_dt_interval(hours=F.lit(self.disorder))
        self._write(states.where(over), f"closed/batch={batch_id}")
        self._write(states.where(~over), f"merged/batch={batch_id}")
        for what, batches in (("merged", old), ("deltas", deltas)):
            for b in batches:
                remove(self.spark, f"{self.work}/{what}/batch={b}")

    def state(self) -> DataFrame:
        """The state of every event after all batches, classified."""
        return N.classify(N.merge(reduce(DataFrame.unionByName, self._open() + self._read("closed", self._folders("closed")))), self.clock)

    def nights(self) -> DataFrame:
        """The totals of each night as last upserted."""
        df = self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.work}/nights")
        newest = df.groupBy("night").agg(F.max("batch").alias("batch"))
        return df.join(newest, ["night", "batch"]).drop("batch")

    def diverted(self) -> DataFrame:
        """Every delivery that came after the limit of its night."""
        return self.spark.read.schema("delivery_id bigint, night string, source string, key string, received_at timestamp").parquet(f"{self.work}/diverted")

    def late(self) -> DataFrame:
        """The events of which nothing came in time, by night and source; one that was heard of in time after all is withdrawn."""
        return N.dropped(self.diverted(), self.state())


STATES = T.StructType(
    [
        T.StructField("until", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("first_received", T.TimestampType()),
        T.StructField("last_received", T.TimestampType()),
        T.StructField("latest", T.StructType([T.StructField("seq", T.LongType()), T.StructField("has_hours", T.BooleanType()), T.StructField("neg_received", T.LongType()), T.StructField("neg_delivery", T.LongType()), T.StructField("hours", T.DoubleType()), T.StructField("frames", T.LongType())])),
        T.StructField("night", T.StringType()),
        T.StructField("month", T.StringType()),
    ]
)
