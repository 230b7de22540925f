"""Numbers of targets that stay the same from one scan to the next."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.geometry import near_fields
from lumenfold.operators.graph import connected_components
from lumenfold.operators.rank import dense_ids
from lumenfold.session import cut

#: Footprints that share this much of the smaller are the same target, and without a common name only from the second figure on.
MATCH_OVERLAP, RENAME_UNION = 0.5, 0.5


def match_edges(previous: DataFrame, new: DataFrame, old_names: DataFrame, new_names: DataFrame) -> DataFrame:
    """Pairs of an old (l) and a new target (r) that look the same: shared, union and separation make the score.

    Names: (l, name) and (r, name). Targets that both have names but none in
    common match only if their footprints nearly agree.
    """
    p = near_fields(previous, new)
    shared = old_names.join(new_names, "name").groupBy("l", "r").agg(F.count_distinct("name").alias("shared"))
    named_l, named_r = old_names.select("l").distinct().withColumn("has_l", F.lit(True)), new_names.select("r").distinct().withColumn("has_r", F.lit(True))
    p = p.join(shared, ["l", "r"], "left").join(named_l, "l", "left").join(named_r, "r", "left")
    close = F.coalesce(F.col("sep_deg") * 60 <= 0.5 * F.least("field_l", "field_r"), F.lit(False))
    unlike = F.col("has_l").isNotNull() & F.col("has_r").isNotNull() & F.col("shared").isNull()
    ok = (close | (F.col("overlap.small") >= MATCH_OVERLAP)) & (~unlike | (close & (F.col("overlap.union") >= RENAME_UNION)))
    return p.where(ok).select("l", "r", F.when(F.col("shared").isNotNull(), 1).otherwise(0).alias("shared"), F.round("overlap.union", 6).alias("union"), "sep_deg")


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """One component: which new target keeps which number, and which old ones end in another."""
    score = {(e.l, e.r): (e.shared, e.union, -e.sep_deg) for e in pdf.itertuples()}
    old, new = sorted(set(pdf["l"])), sorted(set(pdf["r"]))
    hours_l = dict(zip(pdf["l"], pdf["hours_l"]))
    hours_r = dict(zip(pdf["r"], pdf["hours_r"]))
    keeps: dict = {}
    ends: dict = {}
    if len(old) == 1:
        keeps[max((n for n in new if (old[0], n) in score), key=lambda n: (hours_r[n], score[old[0], n], -n))] = old[0]
    elif len(new) == 1:
        best = max((p for p in old if (p, new[0]) in score), key=lambda p: (hours_l[p], score[p, new[0]], -p))
        keeps[new[0]] = best
        ends = {p: best for p in old if p != best}
    else:
        for p, n in sorted(score, key=lambda k: (score[k], -k[0], -k[1]), reverse=True):
            if p not in keeps.values() and n not in keeps:
                keeps[n] = p
        for p in old:
            near = [n for n in new if (p, n) in score and n in keeps]
            if p not in keeps.values() and near:
                ends[p] = keeps[max(near, key=lambda n: score[p, n])]
    rows = [("keep", p, n, None) for n, p in keeps.items()] + [("merge", p, None, q) for p, q in ends.items()]
    return pd.DataFrame(rows, columns=["what", "l", "r", "into"]).astype({"l": "Int64", "r": "Int64", "into": "Int64"})


def _revive(pdf: pd.DataFrame) -> pd.DataFrame:
    """Best pairs first, each old number and each new target once."""
    rows: dict = {}
    for e in sorted(pdf.itertuples(), key=lambda e: (e.shared, e.union, -e.sep_deg, -e.l, -e.r), reverse=True):
        if e.r not in rows and e.l not in rows.values():
            rows[e.r] = e.l
    return pd.DataFrame(list(rows.items()), columns=["r", "target_id"])


def _components(edges: DataFrame) -> DataFrame:
    """Edges with the component that their ends belong to."""
    nodes = edges.select((F.col("l") * 2).alias("a"), (F.col("r") * 2 + 1).alias("b"))
    found = connected_components(nodes).where(F.col("node") % 2 == 0).select((F.col("node") / 2).cast("bigint").alias("l"), "component")
    return edges.join(found, "l")


def assign(previous: DataFrame, new: DataFrame, edges: DataFrame, next_id: int, retired_edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(r, target_id, status) of the new targets, and (l, into) of the old ones: the number they end in, null if retired.

    ``previous``: l, hours. ``new``: r, hours. Old and new targets that match form
    components; each is settled on its own, since fields that overlap are few.
    An old target with several new ones stays with the one of most hours (a
    split); several old ones become the one of most hours (a merge); else the
    best pairs are taken greedily. ``retired_edges`` are matches with numbers that
    were retired before: new targets left over take those back. New numbers count
    up from ``next_id``.
    """
    full = _components(cut(edges)).join(previous.select("l", F.col("hours").alias("hours_l")), "l").join(new.select("r", F.col("hours").alias("hours_r")), "r")
    settled = cut(full.groupBy("component").applyInPandas(_settle, "what string, l bigint, r bigint, into bigint"))
    kept = settled.where("what = 'keep'").select("r", F.col("l").alias("target_id"), F.lit("kept").alias("status"))
    rest = new.join(kept, "r", "left_anti").select("r")
    if retired_edges is not None:
        back = cut(_components(cut(retired_edges.join(rest, "r", "left_semi"))).groupBy("component").applyInPandas(_revive, "r bigint, target_id bigint"))
        kept = kept.unionByName(back.select("r", "target_id", F.lit("revived").alias("status")))
        rest = rest.join(back, "r", "left_anti")
    fresh = dense_ids(rest, [F.col("r").asc()], "target_id", next_id).select("r", "target_id", F.lit("new").alias("status"))
    gone = previous.select("l").join(settled.where("what = 'keep'").select("l"), "l", "left_anti").join(settled.where("what = 'merge'").select("l", "into"), "l", "left")
    return kept.unionByName(fresh), gone


def resolve_chains(merges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(old, new) merges with chains followed to their ends by doubling: a into b and b into c gives a into c."""
    now = cut(merges.select("old", "new"))
    for _ in range(most_rounds):
        step = now.alias("x").join(now.alias("y"), F.col("x.new") == F.col("y.old"), "left")
        nxt = cut(step.select(F.col("x.old").alias("old"), F.coalesce("y.new", "x.new").alias("new"), F.col("y.new").isNotNull().alias("moved")))
        if nxt.where("moved").isEmpty():
            return nxt.drop("moved")
        now = nxt.drop("moved")
    raise RuntimeError("merges form a ring")


def name_key(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), r"[\s_\-]+", " "))
