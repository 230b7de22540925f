"""Per-night aggregates by event time, corrected while late records arrive.

Three clocks disagree: when a thing happened (``at``), when a delivery arrived
(``received_at``) and how often the sender revised it (``seq``). Windows are
nights of ``at``; arrival is the clock that closes them, since sender clocks
may run ahead. The state kept per event is a set of minima and maxima, so it
can be folded in any order, in one run or in many micro-batches. What arrives
after the limit of its night changes no state; it is diverted and reported.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import folded

#: Microseconds of an hour.
HOUR = 3_600_000_000

@dataclass(frozen=True)
class NightClock:
    """A site clock with a fixed offset; a night is the date twelve hours before, and closes at noon."""

    utc_offset_hours: int = -7
    lateness_hours: int = 72

    def _day(self, at: Column) -> Column:
        """Days since 1970-01-01 of the night of ``at``, whatever the session's time zone."""
        return F.floor((F.unix_micros(at) + F.lit((self.utc_offset_hours - 12) * HOUR)) / F.lit(24 * HOUR)).cast("int")

    def night(self, at: Column) -> Column:
        return F.date_from_unix_date(self._day(at)).cast("string")

    def closing(self, at: Column) -> Column:
        """The instant at which the night of ``at`` closes."""
        return F.timestamp_micros(self._day(at).cast("bigint") * F.lit(24 * HOUR) + F.lit((36 - self.utc_offset_hours) * HOUR))

    def limit(self, at: Column) -> Column:
        return F.timestamp_micros(F.unix_micros(self.closing(at)) + F.lit(self.lateness_hours * HOUR))


def local_night(at: Column, zone: str) -> Column:
    """The date on which the evening of ``at`` began in a named zone: twelve hours are taken off the wall clock, also on days when it is put forward or back."""
    wall = F.convert_timezone(F.current_timezone(), F.lit(zone), at.cast("timestamp_ntz"))
    return F.to_date(wall - F.make_dt_interval(hours=F.lit(12)))


def arrivals(deliveries: DataFrame, clock: NightClock = NightClock()) -> DataFrame:
    """Deliveries that have a night, with source and key as they are compared: ``until`` (the limit of the night) and ``latest`` (what the delivery says, ordered by revision).

    ``deliveries`` needs source, key, seq, at, received_at, delivery_id and data.
    Rows without source, key, ``at`` or arrival have no night and are left out.
    """
    rows = deliveries.where(F.col("at").isNotNull() & F.col("received_at").isNotNull())
    rows = rows.withColumns({"source": folded("source"), "key": folded("key")})
    rows = rows.where(F.col("source").isNotNull() & F.col("key").isNotNull())
    hours = F.get_json_object("data", "$.hours").try_cast("double")
    frames = F.get_json_object("data", "$.frames").try_cast("bigint")
    latest = F.struct(
        F.coalesce(F.col("seq"), F.lit(-1).cast("bigint")).alias("seq"),
        hours.isNotNull().alias("has_hours"),
        (-F.unix_micros("received_at")).alias("neg_received"),
        (-F.col("delivery_id")).alias("neg_delivery"),
        hours.alias("hours"),
        frames.alias("frames"),
    )
    return rows.select("delivery_id", "source", "key", "at", "received_at", clock.limit(F.col("at")).alias("until"), latest.alias("latest"))


def in_time(rows: DataFrame) -> DataFrame:
    """The arrivals within the limit of their night; only these change a state."""
    return rows.where(F.col("received_at") <= F.col("until"))


def diverted(rows: DataFrame, clock: NightClock = NightClock()) -> DataFrame:
    """The arrivals after the limit of their night, whether their event was known in time or not."""
    return rows.where(F.col("received_at") > F.col("until")).select("delivery_id", clock.night(F.col("at")).alias("night"), "source", "key", "received_at")


def keyed(rows: DataFrame) -> DataFrame:
    """State of each event of a night: the first and last arrival and the latest revision, a set of minima and maxima.

    Among revisions the highest ``seq`` counts (null lowest), then one that
    carries hours, then the earliest arrival, then the smallest ``delivery_id``.
    Over a stream the state of a night is dropped once the watermark passes
    ``until``. Combined on the map side, so hot events need no salt.
    """
    return rows.groupBy("until", "source", "key").agg(F.min("at").alias("at"), F.min("received_at").alias("first_received"), F.max("received_at").alias("last_received"), F.max("latest").alias("latest"))


def merge(states: DataFrame) -> DataFrame:
    """Fold rows of state into one an event; associative and commutative, so repeats and order don't matter. Of an event with several ``at`` the first counts."""
    return states.groupBy("source", "key").agg(F.min("at").alias("at"), F.min("first_received").alias("first_received"), F.max("last_received").alias("last_received"), F.max("latest").alias("latest"))


def fold(deliveries: DataFrame, clock: NightClock = NightClock()) -> DataFrame:
    """The states that a stream over these deliveries ends with."""
    return merge(keyed(in_time(arrivals(deliveries, clock))))


def classify(state: DataFrame, clock: NightClock = NightClock()) -> DataFrame:
    """State with ``night`` and ``arrival``: on_time, or correction (first heard of after closing)."""
    at = F.col("at")
    arrival = F.when(F.col("first_received") <= clock.closing(at), "on_time").otherwise("correction")
    return state.withColumns({"night": clock.night(at), "arrival": arrival})


def totals(classified: DataFrame) -> DataFrame:
    """One row a night: events, corrections, hours and frames of what came within the limit."""
    return classified.groupBy("night").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("arrival") == "correction").alias("corrections"),
        F.round(F.sum("latest.hours"), 4).alias("hours"),
        F.sum("latest.frames").alias("frames"),
        F.max("first_received").alias("last_update"),
    )


def dropped(late: DataFrame, state: DataFrame) -> DataFrame:
    """The events of which nothing came within the limit, counted by night and source with the last first arrival.

    ``late`` has the diverted deliveries; an event that has a state isn't
    reported, also if its state came after the diverted delivery.
    """
    first = late.groupBy("night", "source", "key").agg(F.min("received_at").alias("received_at"))
    unknown = first.join(state.select("source", "key"), ["source", "key"], "left_anti")
    return unknown.groupBy("night", "source").agg(F.count("*").alias("events"), F.max("received_at").alias("last_received"))
