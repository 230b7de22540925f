"""Exposures that were stored more than once: stages, variants, whole and partial copies of folders."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: stages of processing, the earliest wins
STAGE_RANK = {"og": 0, "root": 1, "calibrated": 2, "registered": 3, "master": 4}

#: A folder loses frames to an earlier one only from so many, and so large a share, on.
LEAST_SHARED, LEAST_SHARE = 5, 0.10

#: Blocks whose places are kept in one number as bits.
CHUNK = 8192


def stage_winner(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of the first stage that each session and filter has; later stages hold the same exposures.

    A minimum per group joined back: no window over a group of any size.
    """
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in STAGE_RANK.items() for x in kv)), F.col("stage")), F.lit(99))
    df = blocks.withColumn("__rank", rank)
    first = df.groupBy(*keys).agg(F.min("__rank").alias("__first"))
    return df.join(first, keys).where("__rank = __first").drop("__rank", "__first")


def content_survivors(blocks: DataFrame, key: list[str], path: str = "bucket") -> DataFrame:
    """One block of each content key: captured before not, accepted before not, the shorter path, the path.

    Flags of the copies are joined by or. Blocks with a null in the key drop out,
    as they can't be told apart.
    """
    known = blocks.dropna(subset=key)
    order = F.struct((~F.col("captured")).alias("c"), (~F.col("accepted")).alias("a"), F.length(path).alias("l"), F.col(path).alias("p"))
    rest = [c for c in blocks.columns if c not in (*key, "captured", "accepted")]
    kept = known.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("k"), F.bool_or("captured").alias("captured"), F.bool_or("accepted").alias("accepted"), F.count("*").alias("copies"))
    return kept.select(*key, "k.*", "captured", "accepted", "copies")


def multisets(times: DataFrame) -> DataFrame:
    """``times`` (grp, block, t, n) as one row a block: its sorted times with counts, frames and distinct times.

    Blocks with a frame that has no time, or with a single time for all, are
    left out: their times can't tell which frames they hold.
    """
    whole = times.groupBy("grp", "block").agg(F.array_sort(F.collect_list(F.struct("t", "n"))).alias("times"), F.sum("n").alias("frames"), F.count("*").alias("kinds"), F.count_if(F.col("t").isNull() & (F.coalesce("n", F.lit(1)) > 0)).alias("untimed"))
    return whole.where("kinds > 1 and untimed = 0").drop("untimed")


def _first_holder(held: dict, times: list[tuple], size: int) -> int | None:
    """Place of the first block that has every one of these times at least so often. ``held``: places by time, count and chunk of ``size``, as bits."""
    levels = []
    for t, n in times:
        of = [chunks for m, chunks in held.get(t, {}).items() if m >= n]
        if not of:
            return None
        levels.append(of)
    # only chunks with a holder of the rarest time are looked at
    levels.sort(key=lambda of: sum(map(len, of)))
    for c in sorted(set().union(*levels[0])):
        found = -1
        for of in levels:
            bits = 0
            for chunks in of:
                bits |= chunks.get(c, 0)
            found &= bits
            if not found:
                break
        if found:
            return c * size + (found & -found).bit_length() - 1
    return None


def contained(ranked: DataFrame) -> DataFrame:
    """grp, block and the keeper ``by``, for blocks (grp, block, times) whose times are all in an earlier one of the group.

    Rows of a group come together, the first rank first. No pair is ever a row: a
    task keeps which blocks of the group hold a time as bits, and the blocks that
    hold all times of another are what these have in common.
    """

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, start, held, blocks = None, 0, {}, None
        for batch in batches:
            own = batch.column("block")
            before = len(blocks) if blocks is not None else 0
            blocks = pa.chunked_array([*(blocks.chunks if before else []), own], own.type)
            ends, flat = batch.column("times").offsets.to_pylist(), batch.column("times").values
            t, n = flat.field("t"), flat.field("n").to_pylist()
            t = (t.cast(pa.int64()) if pa.types.is_timestamp(t.type) else t).to_pylist()
            inner, by = [], []
            for i, g in enumerate(batch.column("grp").to_pylist()):
                if g != group:
                    group, start, held = g, before + i, {}
                place = before + i - start
                times = list(zip(t[ends[i] : ends[i + 1]], n[ends[i] : ends[i + 1]]))
                known = [x for x in times if x[1] is not None]
                if place and len(known) == len(times) and (first := _first_holder(held, times, CHUNK)) is not None:
                    inner.append(i)
                    by.append(start + first)
                c, bit = place // CHUNK, 1 << place % CHUNK
                for x, k in known:
                    chunks = held.setdefault(x, {}).setdefault(k, {})
                    chunks[c] = chunks.get(c, 0) | bit
            at = pa.array(inner, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("grp").take(at), own.take(at), blocks.take(pa.array(by, pa.int64())).combine_chunks()], ["grp", "block", "by"])
            # the open group goes on
            blocks, start = blocks.slice(start), 0

    grp, block = (ranked.schema[c].dataType for c in ("grp", "block"))
    return ranked.select("grp", "block", "times").mapInArrow(find, T.StructType([T.StructField("grp", grp), T.StructField("block", block), T.StructField("by", block)]))


def whole_copies(times: DataFrame) -> DataFrame:
    """Blocks whose capture times are all in an earlier-ranked block of the group: grp, block and the keeper.

    Blocks with a single time, or with untimed frames, aren't trusted. Equal
    multisets are one row, so thousands of copies cost one row; the first of them
    stands for it. Blocks with more frames rank first, then the smaller name; the
    keeper is the first-ranked container.
    """
    # one exchange: all that follows reads the same three columns of it
    blocks = multisets(times).where("grp is not null and block is not null").select("grp", "block", "times").repartition("grp", "times")
    firsts = blocks.groupBy("grp", "times").agg(F.min("block").alias("first"))
    frames = F.aggregate("times", F.lit(0).cast("bigint"), lambda a, e: a + F.coalesce(e["n"], F.lit(0)).cast("bigint"))
    ranked = firsts.select("grp", F.col("first").alias("block"), "times", frames.alias("frames")).repartition("grp").sortWithinPartitions("grp", F.desc("frames"), "block")
    # a copy of a contained multiset goes to whatever holds it, which ranks before its own first
    copies = blocks.join(firsts, ["grp", "times"]).select("grp", "block", "first")
    kept = copies.join(contained(ranked).withColumnRenamed("block", "first"), ["grp", "first"], "left")
    return kept.select("grp", "block", F.coalesce("by", "first").alias("keeper")).where("block <> keeper")


def partial_copies(times: DataFrame) -> DataFrame:
    """Frames that each block shares with earlier-ranked ones, where they are enough to be taken from it.

    Each capture time is credited to the first-ranked block; a later one loses
    the smaller of its own count and the most that any earlier one holds. Gives
    grp, block, frames and lost.
    """
    blocks = multisets(times)
    spread = blocks.select("grp", "block", "frames", F.explode("times").alias("e")).select("grp", "block", "frames", F.col("e.t").alias("t"), F.col("e.n").alias("n"))
    earlier = Window.partitionBy("grp", "t").orderBy(F.desc("frames"), "block").rowsBetween(Window.unboundedPreceding, -1)
    shared = spread.withColumn("shared", F.least("n", F.coalesce(F.max("n").over(earlier), F.lit(0))))
    lost = shared.groupBy("grp", "block", "frames").agg(F.sum("shared").alias("lost"))
    return lost.where((F.col("lost") >= LEAST_SHARED) & (F.col("lost") >= F.col("frames") * LEAST_SHARE))


# fixed values: marks of a master's variants
VARIANT_TOKENS = (
    "starless", "stars", "starmask", "nostars", "autocrop", "crop", "cropped", "trimmed", "abe", "dbe", "gradient", "bg", "background", "denoise", "denoised", "nr", "decon", "deconvolved", "sharpened",
    "stretched", "nonlinear", "linear", "ht", "stf", "final", "processed", "edit", "edited", "clone", "copy", "preview", "drizzle", "drz", "1x", "2x", "3x", "4x",
)
#: Everything before the marks at the end of a stem, each of which may be numbered; the copies of a file system have a number in brackets.
VARIANT = rf"(?i)^(.+?)(?:[_\-\s](?:{'|'.join(VARIANT_TOKENS)})\d*|[\s_\-]*\(\d+\))+$"


def variant_stem(stem: Column) -> Column:
    """A master's name without the marks of its variants; never empty."""
    return F.regexp_replace(stem, VARIANT, "$1")


def collapse_variants(masters: DataFrame, far_arcmin: float = 2.0) -> DataFrame:
    """One master of each folder and stem, unless the group holds several filters or lies apart: then all stay.

    ``masters``: folder, stem, filter, ra_deg, dec_deg, ncombine, path. The deepest
    stack wins, then the shorter name, then the name.
    """
    from lumenfold.functions.sphere import separation_deg

    df = masters.withColumn("__stem", variant_stem(F.col("stem")))
    order = F.struct((-F.coalesce("ncombine", F.lit(0))).alias("n"), F.length("path").alias("l"), F.col("path").alias("p"))
    df = df.withColumn("__order", order)
    group = df.groupBy("folder", "__stem").agg(F.count_distinct("filter").alias("__filters"), F.min("__order").alias("__first"), F.min_by(F.struct("ra_deg", "dec_deg"), "__order").alias("__at"))
    df = df.join(group, ["folder", "__stem"])
    sep = separation_deg(F.col("ra_deg"), F.col("dec_deg"), F.col("__at.ra_deg"), F.col("__at.dec_deg"))
    apart = df.groupBy("folder", "__stem").agg(F.max(F.coalesce(sep, F.lit(0.0))).alias("__apart"))
    df = df.join(apart, ["folder", "__stem"])
    whole = (F.col("__filters") > 1) | (F.col("__apart") * 60 > far_arcmin)
    return df.where(whole | (F.col("__order") == F.col("__first"))).select(*masters.columns)


def runs(rows: DataFrame, keys: list[str], order: list[str], same: list[str]) -> DataFrame:
    """Adjacent rows that are alike fold to one: its first and last place and how many there were."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.lit(False)
    for c in same:
        new = new | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    new = new | (F.row_number().over(w) == 1)
    marked = rows.withColumn("__new", new.cast("int"))
    numbered = marked.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "run", *same).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("rows"))
