"""Three-way merges of plan rows, and the plan of an upsert."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of these kinds are equal within the tolerance.
TOLERANCE = 1e-3


@dataclass(frozen=True)
class MergeField:
    """A compared column; ``near`` for a number with a tolerance, ``default`` for what a null means on a side that exists."""

    name: str
    near: bool = False
    default: object = None


def _same(f: MergeField, a: Column, b: Column) -> Column:
    if f.near:
        return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= TOLERANCE, F.lit(False))
    return a.eqNullSafe(b)


def joined(base: DataFrame, local: DataFrame, remote: DataFrame, keys: Sequence[str], fields: Sequence[MergeField]) -> DataFrame:
    """Rows of both copies beside their base: structs b, l and r, null where a side has no such row."""
    side = lambda df, n: df.select(*keys, F.struct(*(f.name for f in fields)).alias(n))
    return side(local, "l").join(side(remote, "r"), list(keys), "inner").join(side(base, "b"), list(keys), "left")


def field_classes(rows: DataFrame, keys: Sequence[str], fields: Sequence[MergeField], strict: bool = False) -> DataFrame:
    """One row a key and field that differs: class, base, local and remote as text.

    ``auto_pull``: only the remote side changed; ``auto_keep``: only the local
    one; ``conflict``: both, to unlike values. Without a base any difference is
    taken from the remote side, or is a conflict if ``strict``.
    """

    def one(f: MergeField) -> Column:
        get = lambda s: F.coalesce(F.col(s)[f.name], F.lit(f.default)) if f.default is not None else F.col(s)[f.name]
        b, lo, re = get("b"), get("l"), get("r")
        kind = (
            F.when(_same(f, lo, re), None)
            .when(F.col("b").isNull(), F.lit("conflict" if strict else "auto_pull"))
            .when(_same(f, lo, b) & _same(f, re, b), None)
            .when(_same(f, lo, b), F.lit("auto_pull"))
            .when(_same(f, re, b), F.lit("auto_keep"))
            .otherwise(F.lit("conflict"))
        )
        text = lambda c: c.cast("string")
        return F.struct(F.lit(f.name).alias("field"), kind.alias("class"), text(b).alias("base"), text(lo).alias("local"), text(re).alias("remote"))

    return rows.select(*keys, F.explode(F.array(*map(one, fields))).alias("d")).where("d.class is not null").select(*keys, "d.*")


def pulled(rows: DataFrame, keys: Sequence[str], fields: Sequence[MergeField]) -> DataFrame:
    """The local rows with the fields taken over that only the remote side changed; everything else stays."""

    def now(f: MergeField) -> Column:
        b, lo, re = F.col("b")[f.name], F.col("l")[f.name], F.col("r")[f.name]
        pull = ~_same(f, lo, re) & F.col("b").isNotNull() & _same(f, lo, b) & ~_same(f, re, b)
        return F.when(pull, re).otherwise(lo).alias(f.name)

    return rows.select(*keys, *map(now, fields))


def upsert_actions(incoming: DataFrame, existing: DataFrame, guid: str, claim: Sequence[str], row_id: str) -> DataFrame:
    """What a keyed write would do with each incoming row: update by guid, claim a row without guid by its natural key, or insert.

    A row of another owner (with a guid of its own) is never claimed; each
    unowned row is claimed once, by the first incoming row, and the first of
    several unowned rows is taken.
    """
    own = existing.where(F.coalesce(F.btrim(F.col(guid)), F.lit("")) != "")
    by_guid = own.groupBy(guid).agg(F.min(row_id).alias("target"))
    hit = incoming.join(by_guid, guid, "left")
    done = hit.where("target is not null").select(guid, F.lit("update").alias("action"), "target")
    rest = hit.where("target is null").drop("target")
    free = existing.where(F.coalesce(F.btrim(F.col(guid)), F.lit("")) == "").groupBy(*claim).agg(F.min(row_id).alias("target"))
    first = rest.groupBy(*claim).agg(F.min(guid).alias("first"))
    other = rest.join(first, list(claim), "left").join(free, list(claim), "left")
    claimed = F.coalesce((F.col(guid) == F.col("first")) & F.col("target").isNotNull(), F.lit(False))
    return done.unionByName(other.select(guid, F.when(claimed, "claim").otherwise("insert").alias("action"), F.when(claimed, F.col("target")).alias("target")))


def same_order(local: Column, base: Column) -> Column:
    """Whether the ids that both lists hold stand in one order."""
    common = F.array_intersect(local, base)
    return F.filter(local, lambda x: F.array_contains(common, x)) == F.filter(base, lambda x: F.array_contains(common, x))
