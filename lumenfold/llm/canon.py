"""Mapping free-typed values to a reference list with a BK-tree.

Reference entries (canonical names and the other ways they are written) form a
tree under the unrestricted Damerau-Levenshtein distance, which is a metric, so
the triangle inequality prunes safely. Each distinct value is searched once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.session import BROADCAST_BOUND, cut


def distance(a: str, b: str) -> int:
    """Damerau-Levenshtein distance with transpositions of any reach: a true metric."""
    if a == b:
        return 0
    last: dict[str, int] = {}
    most = len(a) + len(b)
    d = [[most] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        match = 0
        for j, y in enumerate(b, 1):
            i1, j1 = last.get(y, 0), match
            cost = 1
            if x == y:
                cost, match = 0, j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[i1][j1] + (i - i1 - 1) + 1 + (j - j1 - 1))
        last[x] = i
    return d[-1][-1]


class BKTree:
    """Entries under :func:`distance`; a search gives every entry within the threshold."""

    def __init__(self, entries: Iterable[str] = ()) -> None:
        self.root: tuple[str, dict] | None = None
        for e in entries:
            self.add(e)

    def add(self, entry: str) -> None:
        if self.root is None:
            self.root = (entry, {})
            return
        node = self.root
        while (d := distance(entry, node[0])) and d in node[1]:
            node = node[1][d]
        if d:
            node[1][d] = (entry, {})

    def within(self, value: str, threshold: int) -> list[tuple[int, str]]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            entry, children = todo.pop()
            d = distance(value, entry)
            if d <= threshold:
                found.append((d, entry))
            todo += [child for k, child in children.items() if d - threshold <= k <= d + threshold]
        return found


@dataclass(frozen=True)
class Decoration:
    """What may be written beside a value without changing its meaning, as patterns over folded text."""

    prefixes: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()


def fold(value: str) -> str:
    """Broken encoding mended, compatibility forms joined, lower case, any run of blanks or underscores as one space."""
    try:
        mended = value.encode("cp1252").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        mended = value
    text = unicodedata.normalize("NFKC", mended).lower()
    return re.sub(r"[\s_]+", " ", text).strip()


def compact(text: str) -> str:
    """A folded text as entries are compared: without blanks and marks, a plus sign behind a word written out."""
    text = re.sub(r"(?<=\w)\+(?=\s|$)", " plus", text)
    return re.sub(r"[\s\-_/.,:;+\[\]()]+", "", text) or text


def forms(value: str, decoration: Decoration) -> list[str]:
    """The folded value, then what is left as decorations come off, fewest first."""
    seen, todo = [fold(value)], [fold(value)]
    while todo:
        now = todo.pop(0)
        for p in (*(rf"^(?:{p})" for p in decoration.prefixes), *(rf"(?:{s})$" for s in decoration.suffixes)):
            left = re.sub(p, "", now).strip(" ")
            if left and left not in seen:
                seen.append(left)
                todo.append(left)
    return seen


def allowance(text: str) -> int:
    """Typing errors that a text may hold, as it was written: none below five characters, one from five on."""
    return 1 if len(text) >= 5 else 0


def digits(text: str) -> str:
    return re.sub(r"\D", "", text)


def best_match(value: str, tree: BKTree, decoration: Decoration, threshold: int = 1) -> tuple[int, int, str] | None:
    """Least (distance, form, entry) for a value; None if nothing is within reach.

    An exact form wins over any inexact one. Among inexact ones the nearest
    counts, then the form with fewer decorations taken off, then the entry. A
    digit is never a typing error: it says which of several alike is meant.
    """
    written = forms(value, decoration)
    texts = [compact(t) for t in written]
    for i, t in enumerate(texts):
        if exact := tree.within(t, 0):
            return 0, i, exact[0][1]
    found = [(d, i, e) for i, t in enumerate(texts) for d, e in tree.within(t, min(threshold, allowance(written[i])))]
    found = [(d, i, e) for d, i, e in found if d <= allowance(e) and digits(texts[i]) == digits(e)]
    return min(found) if found else None


SCHEMA = "value string, entry string, dist int, form int"


def match_values(values: DataFrame, entries: DataFrame, decoration: Decoration, threshold: int = 1, shard_entries: int = 20_000) -> DataFrame:
    """Nearest reference entry of each distinct value.

    ``values`` has ``value``, ``entries`` has ``entry`` (compact) and ``canon_id``.
    Gives value, canon_id (0: none within reach), entry and dist. Null values are
    left out; an empty value maps to 0. Entries that share a text must share the
    id (the smallest counts). Up to ``shard_entries`` entries make one tree that
    goes to every task; more are dealt into shards by hash, each value is
    searched in every shard, and the shards' winners are merged.
    """
    values = values.where("value is not null").select("value").distinct()
    entries = entries.groupBy("entry").agg(F.min("canon_id").alias("canon_id"))
    n = entries.count()
    if n <= shard_entries:
        tree_of = values.sparkSession.sparkContext.broadcast([r["entry"] for r in entries.select("entry").orderBy("entry").collect()])

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tree = BKTree(tree_of.value)
            for b in batches:
                yield _found(b["value"], tree, decoration, threshold)

        won = values.mapInPandas(search, SCHEMA)
    else:
        shards, salt = -(-n // shard_entries), 8
        left = values.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(salt)).cast("int"))
        right = entries.select("entry", F.pmod(F.xxhash64("entry"), F.lit(shards)).cast("int").alias("shard")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))

        def search_shard(v: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
            return _found(v["value"], BKTree(sorted(e["entry"])), decoration, threshold)

        each = left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInPandas(search_shard, SCHEMA)
        # an exact match comes first at any form, then the nearest, the fewest decorations, the entry
        rank = F.when(F.col("entry").isNotNull(), F.struct("dist", "form", "entry"))
        won = each.groupBy("value").agg(F.min(rank).alias("w")).select("value", "w.entry", "w.dist", "w.form")
    return won.join(entries, "entry", "left").select("value", F.coalesce("canon_id", F.lit(0)).cast("bigint").alias("canon_id"), "entry", "dist")


def _found(values: pd.Series, tree: BKTree, decoration: Decoration, threshold: int) -> pd.DataFrame:
    rows = []
    for v in values:
        hit = best_match(v, tree, decoration, threshold)
        rows.append((v, hit[2], hit[0], hit[1]) if hit else (v, None, None, None))
    return pd.DataFrame(rows, columns=["value", "entry", "dist", "form"]).astype({"dist": "Int32", "form": "Int32"})


def map_column(rows: DataFrame, column: str, matched: DataFrame) -> DataFrame:
    """``rows`` with ``canon_id``, ``entry`` and ``dist`` of the value in ``column``; all null where it is null.

    The matches are written once and measured: within the bound they are broadcast,
    so that a value which many rows hold moves none of them; else the planner joins.
    """
    m = cut(matched.select(F.col("value").alias("__value"), "canon_id", "entry", "dist"))
    size = m.agg(F.sum(F.octet_length("__value") + F.coalesce(F.octet_length("entry"), F.lit(0)) + 64)).first()[0] or 0
    m = F.broadcast(m) if size <= BROADCAST_BOUND else m
    return rows.join(m, F.col(column) == F.col("__value"), "left").drop("__value")


def is_listed(column: str, names: list[str]) -> Column:
    """Whether a value is a canonical name, character by character."""
    return F.col(column).isin(names)
