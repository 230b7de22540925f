"""One copy of each message that was delivered at least once.

Only the identifier, the delivery order and the row's place in its file are
shuffled. The winners become bitmaps, one bit a row, kept per file; wide rows
are then read once, in place, against the bitmaps of their file and are never
shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.session import BROADCAST_BOUND, cut

#: Rows that one bitmap covers (fixed by Spark's bitmap functions) and its bytes.
BITMAP_ROWS, BITMAP_BYTES = 32768, 4096

FILE, ROW, BUCKET, BITS = "__file", "__row", "__bucket", "__bits"


def positions(spark: SparkSession, path: str | Sequence[str], columns: dict[str, Column | str]) -> DataFrame:
    """The named columns of every row with its file and row position.

    The file's path is hashed to 64 bits; :func:`_check_files` proves that no
    two of the files read share a hash.
    """
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    _check_files(df)
    own = [(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()]
    return df.select(
        *own,
        F.xxhash64(F.col("_metadata.file_path")).alias(FILE),
        F.col("_metadata.row_index").alias(ROW),
        F.bitmap_bucket_number(F.col("_metadata.row_index") + 1).alias(BUCKET),
    )


def _check_files(df: DataFrame) -> None:
    spark = df.sparkSession
    files = df.inputFiles()
    n = spark.range(1).select(F.explode(F.array(*map(F.lit, files))).alias("f")) if len(files) < 64 else spark.createDataFrame([(f,) for f in files], "f string")
    if n.select(F.xxhash64("f")).distinct().count() != len(set(files)):
        raise ValueError("two input files share a hash")


def winners(rows: DataFrame, identity: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Place of the first row of each identity by ``order``.

    A minimum of structs is combined on the map side, so an identity that holds
    a third of all rows costs no more than any other. Nulls agree with nulls and
    sort before values; pass expressions for any other rule.
    """
    first = F.min(F.struct(*order, FILE, ROW)).alias("w")
    return rows.groupBy(*identity).agg(first).select(f"w.{FILE}", f"w.{ROW}")


def vectors(places: DataFrame) -> DataFrame:
    """Bitmaps of the rows to keep: one for each file and run of 32,768 rows.

    The narrow places are shuffled before they become bitmaps, so that no
    half-empty bitmaps travel.
    """
    at = places.withColumn(BUCKET, F.bitmap_bucket_number(F.col(ROW) + 1)).repartition(FILE, BUCKET)
    return at.groupBy(FILE, BUCKET).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(ROW) + 1)).alias(BITS))


def _kept() -> Column:
    at = F.bitmap_bit_position(F.col(ROW) + 1)
    byte = F.conv(F.hex(F.substring(F.col(BITS), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def apply_vectors(rows: DataFrame, bits: DataFrame, keep: bool = True, bound: int = BROADCAST_BOUND) -> DataFrame:
    """``rows`` (from :func:`positions`) whose bit is set, or with ``keep=False`` those whose bit is not.

    The bitmaps take one bit a row. While all together are within ``bound`` they
    are broadcast whole. Beyond it they are dealt into groups by the hash of the
    file, each within the bound, and the rows of each group meet only their own
    group's bitmaps; if one file alone is beyond the bound, the join is left to
    the planner.
    """
    per_file = bits.groupBy(FILE).count().agg(F.sum("count"), F.max("count")).first()
    total, largest = ((x or 0) * BITMAP_BYTES for x in per_file)
    own = [c for c in rows.columns if c not in (FILE, ROW, BUCKET)]
    if total <= bound:
        joined = rows.join(F.broadcast(bits), [FILE, BUCKET], "left")
    elif largest > bound:
        joined = rows.join(bits, [FILE, BUCKET], "left")
    else:
        n = 2 * -(-total // bound)
        joined = None
        for k in range(n):
            mine = F.pmod(F.col(FILE), F.lit(n)) == k
            part = rows.where(mine).join(F.broadcast(bits.where(mine)), [FILE, BUCKET], "left")
            joined = part if joined is None else joined.unionByName(part)
    return joined.where(_kept() if keep else ~_kept()).select(*own)


def split_deliveries(
    spark: SparkSession,
    path: str | Sequence[str],
    identity: dict[str, Column],
    order: dict[str, Column],
    columns: Sequence[str],
    keep: bool = True,
) -> DataFrame:
    """Read ``columns`` of the copies that stay, or with ``keep=False`` of those that go.

    Nulls: a part of the identifier that is null agrees only with null. Ties:
    ``order`` must end in a unique column, else the place in the files decides.
    Rows that are repeated whole are copies like any other. An empty table gives
    an empty result. Other columns are never read.
    """
    narrow = positions(spark, path, {f"i_{k}": v for k, v in identity.items()} | {f"o_{k}": v for k, v in order.items()})
    places = winners(narrow, [f"i_{k}" for k in identity], [f"o_{k}" for k in order])
    bits = cut(vectors(places))
    return apply_vectors(positions(spark, path, {c: c for c in columns}), bits, keep)
