"""Filling sequences of several permitted lengths with texts, best fit first.

Only the histogram of text lengths matters for the layout: it has at most as
many entries as the longest permitted sequence has tokens, whatever the corpus.
The layout is made from it on the driver, as runs of equal bins; each text then
finds its place from its length and its rank among the texts of that length.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.session import cut

#: The splitting pattern that belongs to the vocabulary (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@dataclass(frozen=True)
class Run:
    """``n`` items of one length, ranks from ``rank`` on, in the bins from ``bin`` on: ``each`` a bin, from ``offset`` on."""

    length: int
    rank: int
    n: int
    bin: int
    each: int
    offset: int


@dataclass
class Bins:
    """Equal bins ``first`` to ``first + n - 1`` that still have ``room``."""

    first: int
    n: int
    size: int
    room: int


def attention_cost(size: int, width: int = 4096) -> float:
    """Cost of one sequence: its tokens, and the share of attention that grows with the square of the length at this model width."""
    return size * (1 + size / (6 * width))


class Outlook:
    """What is still to come and not yet promised to an open bin: the fillings that new bins may hope for."""

    def __init__(self, histogram: dict[int, int]) -> None:
        self.left = dict(histogram)
        self.lengths = sorted(histogram)

    def take(self, length: int, n: int) -> None:
        if length in self.left:
            self.left[length] -= n
            if self.left[length] <= 0:
                del self.left[length]
                self.lengths.pop(bisect_left(self.lengths, length))

    def filling(self, length: int, n: int, size: int) -> tuple[int, int, list[tuple[int, int]]]:
        """Tokens that a bin would hold whose first item is one of ``n`` of this length, each further item being the longest that fits; how many bins can be filled so; the items by length."""
        each = min(n, size // length)
        room, bins, items = size - each * length, n // each, []
        i = bisect_left(self.lengths, length)
        while room and (i := bisect_right(self.lengths, room, 0, i) - 1) >= 0:
            fit = self.lengths[i]
            k = min(self.left[fit], room // fit)
            bins = min(bins, self.left[fit] // k)
            items.append((fit, k))
            room -= k * fit
        return size - room, bins, items


def layout(histogram: dict[int, int], sizes: Sequence[int], cost: Callable[[int], float] = attention_cost, opened: Sequence[int] | None = None) -> tuple[list[Run], list[Bins]]:
    """Best-fit decreasing over a histogram of lengths, many equal bins at a time.

    Gives the runs of placed items and the groups of bins with their final,
    downsized permitted size. Items go the longest first, each into the bin with
    the least room that holds it, a new bin only where none does. A new bin gets
    that size among ``opened`` (all, if not given) whose outlook costs least a
    token: what would fill it is looked up among the shorter items that no open
    bin waits for, and as many bins are opened together as can be filled so.
    """
    sizes = sorted(sizes)
    opened = sorted(opened or sizes)
    rooms: list[int] = []  # the rooms that occur, sorted
    by_room: dict[int, list[Bins]] = {}
    runs: list[Run] = []
    bins = 0
    outlook = Outlook(histogram)

    def put(g: Bins) -> None:
        if g.room not in by_room:
            by_room[g.room] = []
            insort(rooms, g.room)
        by_room[g.room].append(g)

    def fill(g: Bins, length: int, rank: int, left: int) -> int:
        """Place up to ``left`` items into the group; gives how many."""
        each = g.room // length
        full = min(g.n, left // each)
        if full:
            runs.append(Run(length, rank, full * each, g.first, each, g.size - g.room))
            put(Bins(g.first, full, g.size, g.room - each * length))
        placed = full * each
        rest = min(left - placed, each) if full < g.n else 0
        if rest:
            runs.append(Run(length, rank + placed, rest, g.first + full, rest, g.size - g.room))
            put(Bins(g.first + full, 1, g.size, g.room - rest * length))
        untouched = g.n - full - bool(rest)
        if untouched:
            put(Bins(g.first + full + bool(rest), untouched, g.size, g.room))
        return placed + rest

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        outlook.take(length, left)
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                group = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(i)
            else:
                fit = [s for s in opened if s >= length] or [next(s for s in sizes if s >= length)]
                hopes = {s: outlook.filling(length, left, s) for s in fit}
                size = min(fit, key=lambda s: (cost(s) / hopes[s][0], s))
                _, n, items = hopes[size]
                for fitting, k in items:
                    outlook.take(fitting, k * n)
                group = Bins(bins, n, size, size)
                bins += n
            placed = fill(group, length, rank, left)
            rank, left = rank + placed, left - placed
    closed = []
    for groups in by_room.values():
        for g in groups:
            used = g.size - g.room
            closed.append(Bins(g.first, g.n, next(s for s in sizes if s >= used), used))
    return runs, sorted(closed, key=lambda g: g.first)


def mixes(histogram: dict[int, int], sizes: Sequence[int], cost: Callable[[int], float] = attention_cost) -> dict[tuple[int, ...], tuple[float, list[Run], list[Bins]]]:
    """The layout and its whole cost for each set of sizes in which bins may be opened; the permitted sizes are few."""
    found = {}
    for n in range(1, len(sizes) + 1):
        for opened in combinations(sorted(sizes), n):
            if max(opened) == max(sizes):
                runs, groups = layout(histogram, sizes, cost, opened)
                found[opened] = (sum(g.n * cost(g.size) for g in groups), runs, groups)
    return found


def cheapest(histogram: dict[int, int], sizes: Sequence[int], cost: Callable[[int], float] = attention_cost) -> tuple[list[Run], list[Bins]]:
    """The layout of the mix of sizes that costs least as a whole; among equal ones that of fewer sizes."""
    return min(mixes(histogram, sizes, cost).values(), key=lambda m: m[0])[1:]


def token_counts(documents: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and number of tokens of each whole text; null texts count 0. Strings of special tokens are ordinary text."""
    with open(vocabulary, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value)
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["id", "tokens"])

    return documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col)).mapInArrow(count, "id bigint, tokens bigint")


def _encoder(ranks: bytes) -> Callable[[str], list[int]]:
    import tiktoken

    pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=pairs, special_tokens={}).encode_ordinary


def ranked(items: DataFrame, shards: int = 64) -> DataFrame:
    """``items`` (id, piece, length) with ``rank`` within each length, from 0.

    Items of one length are dealt into shards by a hash of their id, ranked there,
    and moved up by the sizes of the shards before, so a length that a third of
    all items have is spread over tasks. The order is that of ids, run for run.
    """
    df = items.withColumn("__s", F.pmod(F.xxhash64("id", "piece"), F.lit(shards)).cast("int"))
    sizes = df.groupBy("length", "__s").count()
    before = sizes.withColumn("__b", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    own = df.withColumn("__i", F.row_number().over(Window.partitionBy("length", "__s").orderBy("id", "piece")) - 1)
    return own.join(before, ["length", "__s"]).withColumn("rank", F.col("__b") + F.col("__i")).drop("__s", "__b", "__i")


def pieces(counts: DataFrame, capacity: int) -> DataFrame:
    """id, piece, start and length: a text is cut only if it alone exceeds the capacity, into full pieces and a rest; empty texts have none."""
    n = F.ceil(F.col("tokens") / F.lit(capacity)).cast("int")
    cuts = counts.where("tokens > 0").select("id", "tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    start = F.col("piece").cast("bigint") * capacity
    return cuts.select("id", "piece", start.alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("tokens") - start).alias("length"))


def histogram_of(items: DataFrame) -> dict[int, int]:
    """Number of items by length: one entry a length, so bounded by the greatest size."""
    return {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}


def pack(counts: DataFrame, sizes: Sequence[int], cost: Callable[[int], float] = attention_cost) -> DataFrame:
    """Place every text: id, piece, start, length, bin, offset, capacity and filled (the bin's size and contents).

    ``counts`` has id and tokens. Texts without tokens are placed nowhere. Ids
    that are repeated are texts of their own only if their counts differ; equal
    rows must be removed before. Every item is in one bin, no bin exceeds its
    capacity, capacities are permitted sizes, and only texts longer than the
    greatest size are cut. An empty table gives no rows.
    """
    spark = counts.sparkSession
    items = cut(pieces(counts, max(sizes)))
    runs, groups = cheapest(histogram_of(items), sizes, cost)
    if not runs:
        return items.select("id", "piece", "start", "length", *(F.lit(0).cast("bigint").alias(c) for c in ("bin", "offset", "capacity", "filled"))).where("false")
    runs.sort(key=lambda r: (r.length, r.rank))
    table = {
        **{c: np.array([getattr(r, c) for r in runs], np.int64) for c in ("length", "rank", "bin", "each", "offset")},
        "first": np.array([g.first for g in groups], np.int64),
        "size": np.array([g.size for g in groups], np.int64),
        "used": np.array([g.room for g in groups], np.int64),
    }
    # lengths are few: where the runs of each begin
    starts: dict[int, tuple[int, int]] = {}
    for i, r in enumerate(runs):
        starts[r.length] = (starts.get(r.length, (i, 0))[0], i + 1)
    shared = spark.sparkContext.broadcast((table, starts))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, at = shared.value
        for b in batches:
            run = np.zeros(len(b), np.int64)
            lengths, ranks = b["length"].to_numpy(), b["rank"].to_numpy()
            order = np.argsort(lengths, kind="stable")
            edges = np.flatnonzero(np.diff(lengths[order], prepend=-1))
            for i, j in zip(edges, [*edges[1:], len(order)]):
                lo, hi = at[int(lengths[order[i]])]
                run[order[i:j]] = lo + np.searchsorted(t["rank"][lo:hi], ranks[order[i:j]], side="right") - 1
            k = ranks - t["rank"][run]
            bins = t["bin"][run] + k // t["each"][run]
            group = np.searchsorted(t["first"], bins, side="right") - 1
            yield pd.DataFrame(
                {
                    "id": b["id"], "piece": b["piece"], "start": b["start"], "length": lengths, "bin": bins,
                    "offset": t["offset"][run] + k % t["each"][run] * lengths, "capacity": t["size"][group], "filled": t["used"][group],
                }
            )

    schema = "id bigint, piece int, start bigint, length bigint, bin bigint, offset bigint, capacity bigint, filled bigint"
    return ranked(items).select("id", "piece", "start", "length", "rank").mapInPandas(place, schema)
