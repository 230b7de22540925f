"""Differences between two copies of a table, with the side that moved.

Both copies and the base are dealt into key ranges with shared split points and
sorted within them; each partition is then read once, in key order, by a merge
that keeps no more than one row of each side for the key at hand.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.skew import hot_values

SIDES = ("base", "local", "remote")


@dataclass(frozen=True)
class DiffSpec:
    """Keys, compared columns and the rules of equality.

    ``newest`` picks among repeated rows of one key on one side: the greatest
    value, then the smallest values of the compared columns. ``same`` gives
    spellings that mean one value.
    """

    keys: tuple[str, ...]
    fields: tuple[str, ...]
    newest: str | None = None
    tolerance: float = 1e-3
    same: dict[str, dict[str, str]] = field(default_factory=dict)


def _tagged(df: DataFrame, side: int, spec: DiffSpec) -> DataFrame:
    newest = F.col(spec.newest) if spec.newest else F.lit(None).cast("int")
    return df.select(*spec.keys, F.lit(side).cast("tinyint").alias("__side"), newest.alias("__newest"), *spec.fields)


def differences(base: DataFrame, local: DataFrame, remote: DataFrame, spec: DiffSpec) -> DataFrame:
    """One row a difference: the keys, ``field``, ``side`` and the three values as text.

    A row on one side only has the empty ``field`` and the side that lacks it.
    Otherwise ``side`` is the copy that differs from the base, ``both`` (also
    where each is within the tolerance of the base but they aren't of each
    other) or ``nobase``. Null equals only null, also in keys; NaN equals NaN.
    Rows repeated under one key count once (see :class:`DiffSpec`). Other
    columns are ignored; empty tables work as sides without rows.
    """
    union = _tagged(base, 0, spec).unionByName(_tagged(local, 1, spec)).unionByName(_tagged(remote, 2, spec))
    doubles = {f.name for f in local.schema if f.name in spec.fields and f.dataType.typeName() in ("double", "float")}
    union = _collapse_hot(union, spec)
    # one exchange over the union: its split points are shared by the sides
    order = [F.col(k).asc_nulls_first() for k in spec.keys]
    ranged = union.repartitionByRange(*order).sortWithinPartitions(*order, "__side", F.col("__newest").desc_nulls_last(), *spec.fields)
    keys = ", ".join(f"`{k}` {local.schema[k].dataType.simpleString()}" for k in spec.keys)
    schema = f"{keys}, field string, side string, base_value string, local_value string, remote_value string"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _merge_stream(batches, spec, doubles)

    return ranged.mapInArrow(merge, schema)


def _collapse_hot(union: DataFrame, spec: DiffSpec) -> DataFrame:
    """Keys that are repeated very often are reduced to a row a side before the exchange, by a map-side combine."""
    key = F.xxhash64(*spec.keys)
    hot = hot_values(union, key)
    if not hot:
        return union
    rest = [c for c in union.columns if c not in (*spec.keys, "__side")]
    rank = F.struct(F.col("__newest").isNull().alias("n"), _descending("__newest", union), *spec.fields)
    one = union.where(key.isin(hot)).groupBy(*spec.keys, "__side").agg(F.min_by(F.struct(*rest), rank).alias("r"))
    return union.where(~key.isin(hot)).unionByName(one.select(*spec.keys, "__side", "r.*"))


def _descending(c: str, df: DataFrame):
    kind = df.schema[c].dataType.typeName()
    if kind == "timestamp":
        return (-F.unix_micros(c)).alias("d")
    return (-F.col(c).cast("double")).alias("d")


def _new_key(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """True where a row's key isn't the one of the row before."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        a = table.column(k).combine_chunks()
        x, y = a.slice(1), a.slice(0, n - 1)
        eq = pc.fill_null(pc.equal(x, y), False).to_numpy(zero_copy_only=False)
        null = pc.and_(pc.is_null(x), pc.is_null(y)).to_numpy(zero_copy_only=False)
        new[1:] |= ~(eq | null)
    return new


def _merge_stream(batches: Iterator[pa.RecordBatch], spec: DiffSpec, doubles: set[str]) -> Iterator[pa.RecordBatch]:
    """Two-pointer merge of sorted rows; what is carried over is the last key's first row of each side."""
    carried: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if carried is None else pa.concat_tables([carried, rows])
        new = _new_key(rows, spec.keys)
        side = rows.column("__side").to_numpy()
        first = new.copy()
        first[1:] |= side[1:] != side[:-1]
        last = len(new) - 1 - int(np.argmax(new[::-1]))
        at = np.flatnonzero(first)
        done, left = at[at < last], at[at >= last]
        if len(done):
            yield from _compare(rows.take(done), new[done], spec, doubles)
        carried = rows.take(left)
    if carried is not None and carried.num_rows:
        yield from _compare(carried, _new_key(carried, spec.keys), spec, doubles)


def _compare(rows: pa.Table, new: np.ndarray, spec: DiffSpec, doubles: set[str]) -> Iterator[pa.RecordBatch]:
    """Rows hold each key's first row of each side, in order."""
    group = np.cumsum(new) - 1
    n = int(group[-1]) + 1
    side = rows.column("__side").to_numpy()
    at = np.full((3, n), -1)
    at[side, group] = np.arange(len(group))
    has = at >= 0
    key_row = at.max(axis=0)
    found: list[tuple[np.ndarray, str, np.ndarray, list[pa.Array]]] = []
    nothing = lambda k: pa.nulls(k, pa.string())
    for lacking, other in ((1, 2), (2, 1)):
        g = np.flatnonzero(~has[lacking] & has[other])
        if len(g):
            found.append((g, "", np.full(len(g), SIDES[lacking], object), [nothing(len(g))] * 3))
    pairs = np.flatnonzero(has[1] & has[2])
    for f in spec.fields:
        if not len(pairs):
            break
        values = [pc.take(rows.column(f).combine_chunks(), pa.array(np.where(at[s, pairs] < 0, None, at[s, pairs]), pa.int64())) for s in range(3)]
        unlike = _unlike_floats if f in doubles else _unlike
        b, lo, re = values if f not in spec.same else [_respelled(v, spec.same[f]) for v in values]
        differ = unlike(lo, re, spec.tolerance)
        if not differ.any():
            continue
        hit = np.flatnonzero(differ)
        moved_l, moved_r = unlike(lo, b, spec.tolerance)[hit], unlike(re, b, spec.tolerance)[hit]
        who = np.where(moved_l == moved_r, "both", np.where(moved_l, "local", "remote"))
        who = np.where(has[0, pairs[hit]], who, "nobase").astype(object)
        found.append((pairs[hit], f, who, [pc.take(v, pa.array(hit)).cast(pa.string()) for v in values]))
    for g, f, who, values in found:
        keys = rows.select(list(spec.keys)).take(key_row[g])
        out = pa.table([*keys.columns, pa.array([f] * len(g), pa.string()), pa.array(who, pa.string()), *values], names=[*spec.keys, "field", "side", "base_value", "local_value", "remote_value"])
        yield from out.to_batches()


def _respelled(values: pa.Array, same: dict[str, str]) -> pa.Array:
    for old, now in same.items():
        values = pc.if_else(pc.fill_null(pc.equal(values, old), False), now, values)
    return values


def _nulls(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return pc.is_null(a).to_numpy(zero_copy_only=False), pc.is_null(b).to_numpy(zero_copy_only=False)


def _unlike(a: pa.Array, b: pa.Array, _: float) -> np.ndarray:
    x, y = _nulls(a, b)
    return (x != y) | pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)


def _unlike_floats(a: pa.Array, b: pa.Array, tolerance: float) -> np.ndarray:
    x, y = _nulls(a, b)
    p, q = (pc.fill_null(v.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False) for v in (a, b))
    with np.errstate(invalid="ignore"):
        far = ~((np.abs(p - q) <= tolerance) | (p == q) | (np.isnan(p) & np.isnan(q)))
    return (x != y) | (~x & ~y & far)
