"""Rules of exchanging plans with a scheduler, and of reporting on what came back: goals, counts, masks, switches, orders, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators import planning as P
from lumenfold.operators.rank import dense_ids

# ---------------------------------------------------------------------- goals


def goals_view(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """One goal a plan and filter: its first row in hours, else its first row; in hours, with the exposure and what was done.

    A minimum a group, combined on the map side. Rows without a filter are left out.
    """
    hours = F.round(F.coalesce(P.goal_hours(F.col("unit"), F.col("target_hours"), F.col("target_frames"), F.col("template_sub_s")), F.lit(0.0)), 4)
    first = F.struct((F.coalesce(F.col("unit"), F.lit("h")) == "fr").alias("f"), *order)
    entry = F.struct(hours.alias("target_hours"), F.col("template_sub_s").alias("sub_exposure_s"), "actual_hours")
    named = rows.withColumn("filter", F.btrim("filter")).where("filter <> ''")
    return named.groupBy("plan_id", "filter").agg(F.min_by(entry, first).alias("g")).select("plan_id", "filter", "g.*")


def floored(wanted: Column, least: Column) -> Column:
    """Frames as they are sent: at least ``least``, but a goal of none stays none."""
    return F.when(wanted > 0, F.greatest(wanted, F.coalesce(least, wanted))).otherwise(wanted)


def unfloored(remote: Column, local: Column, least: Column) -> Column:
    """A goal that came back: what the local one was raised to when sent is no change, anything else is an edit."""
    raised = floored(local, least)
    return F.when((raised != local) & (remote == raised), local).otherwise(remote)


def accepted_to_write(seconds: Column, frames: Column, sub_s: Column, complete: Column, wanted: Column, least_frames: Column) -> Column:
    """Accepted exposures as a scheduler is told them: whole ones; at least those wanted once complete, else short of them by what is missing.

    Null where there are no usable figures.
    """
    count = F.floor(seconds / sub_s + 1e-6)
    short = F.greatest(F.lit(1), least_frames - frames)
    open_ = F.greatest(F.lit(0), F.least(count, wanted - short))
    return F.when((seconds >= 0) & (frames >= 0) & (sub_s > 0), F.when(F.coalesce(complete, F.lit(False)), F.greatest(count, wanted)).otherwise(open_)).cast("bigint")


# ----------------------------------------------------------------- saved rows


def kept_figures(saved: DataFrame, stored: DataFrame, keys: Sequence[str], same: Sequence[str], figures: Sequence[str]) -> DataFrame:
    """Rows that are saved, with the figures of the stored row where key and ``same`` agree; ``kept`` says so. Other rows keep what they bring."""
    old = stored.select(*keys, F.struct(*same, *figures).alias("__o"))
    df = saved.join(old, list(keys), "left")
    agrees = F.col("__o").isNotNull()
    for c in same:
        agrees = agrees & F.col(c).eqNullSafe(F.col(f"__o.{c}"))
    df = df.withColumn("kept", agrees)
    return df.withColumns({c: F.when(F.col("kept"), F.col(f"__o.{c}")).otherwise(F.col(c)) for c in figures}).drop("__o")


def reported(stored: DataFrame, report: DataFrame, keys: Sequence[str], same: Sequence[str]) -> DataFrame:
    """What becomes of each reported row: ``taken`` if the stored row says the same of ``same``, ``changed`` if it doesn't, ``unknown`` if there is none."""
    df = report.join(stored.select(*keys, F.struct(*same).alias("__o")), list(keys), "left")
    agrees = F.lit(True)
    for c in same:
        agrees = agrees & F.col(c).eqNullSafe(F.col(f"__o.{c}"))
    return df.select(*keys, F.when(F.col("__o").isNull(), "unknown").when(agrees, "taken").otherwise("changed").alias("outcome"))


def write_mask(now: DataFrame, base: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """What is written of each row: all fields of a row without a base, of the others only those that changed since; ``action`` insert, update or none.

    A field is null where it isn't written; ``writes`` names those that are.
    """
    df = now.join(base.select(*keys, F.struct(*fields).alias("__b")), list(keys), "left")
    new = F.col("__b").isNull()
    changed = {f: new | ~F.col(f).eqNullSafe(F.col(f"__b.{f}")) for f in fields}
    writes = F.array_compact(F.array(*(F.when(c, F.lit(f)) for f, c in changed.items())))
    df = df.withColumn("writes", writes).withColumn("action", F.when(new, "insert").when(F.size("writes") > 0, "update").otherwise("none"))
    return df.select(*keys, "action", "writes", *(F.when(F.array_contains("writes", f), F.col(f)).alias(f) for f in fields))


def restamped(rows: DataFrame, old: str, new: str, key: str) -> DataFrame:
    """Rows whose identifier moves from ``old`` to ``new``: not where a row has the new one already, and of several that would take it only the first."""
    moving = rows.where(F.col(old).isNotNull() & F.col(new).isNotNull() & (F.col(old) != F.col(new)))
    free = moving.join(rows.select(F.col(old).alias(new)).distinct(), new, "left_anti")
    first = free.groupBy(new).agg(F.min(F.struct(key, old)).alias("f"))
    return first.select(f"f.{key}", f"f.{old}", new)


# ------------------------------------------------------------ switches, scopes


def switched_on(plan_on: Column, part_on: Column) -> Column:
    """Whether a part of a plan is scheduled: an absent switch is on."""
    return F.coalesce(plan_on, F.lit(True)) & F.coalesce(part_on, F.lit(True))


def scheduling_text(parts: DataFrame, plan: str, part: str, on: str) -> DataFrame:
    """One comparable text a plan: ``on``, ``off`` if all its parts are, else ``off:`` and the parts that are. A plan has few parts."""
    off = F.array_sort(F.collect_set(F.when(~F.coalesce(F.col(on), F.lit(True)), F.col(part))))
    g = parts.groupBy(plan).agg(off.alias("__off"), F.count_distinct(part).alias("__n"))
    n = F.size("__off")
    return g.select(plan, F.when(n == 0, "on").when(n == F.col("__n"), "off").otherwise(F.concat(F.lit("off: "), F.array_join("__off", ", "))).alias("scheduling"))


def in_scope(linked: Column, profile: str) -> Column:
    """Whether something belongs to a profile: it is linked to it, or to none."""
    return (F.coalesce(F.size(linked), F.lit(0)) <= 0) | F.array_contains(linked, profile)


def plan_matches(states: Sequence[str], text: str, state: Column, names: Sequence[Column]) -> Column:
    """Whether a plan passes the ticked states (none is active) and a text that is looked for in its names."""
    found = F.lit(not text.strip())
    for n in names:
        found = found | F.coalesce(F.contains(F.lower(n), F.lit(text.strip().lower())), F.lit(False))
    return F.coalesce(state, F.lit("active")).isin(*states) & found


def visible_rows(rows: DataFrame, chip_of: dict[str, str], off: Sequence[str], other: str = "plans") -> DataFrame:
    """Rows of the log whose chip isn't switched off; errors always show."""
    chips = F.create_map(*(F.lit(x) for kv in chip_of.items() for x in kv))
    chip = F.coalesce(F.try_element_at(chips, F.col("type")), F.lit(other))
    return rows.withColumn("chip", chip).where(F.coalesce(F.col("severity") == "error", F.lit(False)) | ~F.col("chip").isin(*off))


def first_problem(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, with the first rule in order that they break (a rule that can't be told isn't broken)."""
    problem = None
    for name, broken in rules.items():
        hit = F.coalesce(broken, F.lit(False))
        problem = F.when(hit, name) if problem is None else problem.when(hit, name)
    return rows.withColumn("problem", problem).where("problem is not null")


# --------------------------------------------------------------------- orders


def numbered_within(rows: DataFrame, group: str, order: Sequence[Column], name: str) -> DataFrame:
    """``rows`` numbered from 1 within each group in a total order; a group of any size is spread over tasks."""
    numbered = dense_ids(rows, [F.col(group).asc(), *order], "__d")
    first = numbered.groupBy(group).agg(F.min("__d").alias("__from"))
    return numbered.join(first, group).withColumn(name, F.col("__d") - F.col("__from") + 1).drop("__d", "__from")


def shooting_order(members: DataFrame, shots: DataFrame, group: str, member: str, at: str) -> DataFrame:
    """Members of each group by their first shot; those that no shot names come last, in their own order."""
    first = shots.groupBy(member).agg(F.min(at).alias("first_shot"))
    df = members.join(first, member, "left")
    return numbered_within(df, group, [F.col("first_shot").asc_nulls_last(), F.col(member).asc()], "place")


def remapped(refs: Column, before: Column, after: Column) -> Column:
    """References into a list (from 0) after the list changed: to the same members, those that left dropped."""
    member = F.transform(refs, lambda r: F.try_element_at(before, r + 1))
    place = F.transform(F.filter(member, lambda m: F.array_contains(after, m)), lambda m: F.array_position(after, m) - 1)
    return place.cast("array<bigint>")


# -------------------------------------------------------------------- reports


def sampled(rows: DataFrame, kind: str, example: str, most: int = 5) -> DataFrame:
    """How many rows there are of each kind, with the first ``most`` examples; no group is collected, its least are taken before the shuffle.

    The examples are the feature: counts are of all rows.
    """
    counts = rows.groupBy(kind).agg(F.count("*").alias("rows"))
    least = rows.select(kind, example).withColumn("__i", F.row_number().over(Window.partitionBy(kind).orderBy(example))).where(F.col("__i") <= most)
    some = least.groupBy(kind).agg(F.array_sort(F.collect_list(example)).alias("examples"))
    return counts.join(some, kind, "left")


def flagged(rows: DataFrame, flags: dict[str, Column], example: str, most: int = 5) -> DataFrame:
    """Counters of named conditions with examples, one row a condition that holds anywhere."""
    kinds = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags.items())))
    return sampled(rows.select(F.explode(kinds).alias("kind"), example), "kind", example, most)


def totals_delta(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str, least: float = 0.0) -> DataFrame:
    """Totals by key before and after, where they differ by more than ``least``; a key that is missing on a side counts as 0 there."""
    total = lambda df, n: df.groupBy(*keys).agg(F.sum(F.coalesce(value, F.lit(0.0))).alias(n))
    df = total(before, "before").join(total(after, "after"), list(keys), "full_outer").na.fill(0.0, ["before", "after"])
    return df.withColumn("delta", F.col("after") - F.col("before")).where(F.abs("delta") > least)


def representative(members: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """The member that stands for each group: the least in order."""
    rest = [c for c in members.columns if c != group]
    rank = F.struct(*(o.alias(f"k{i}") for i, o in enumerate(order)))
    return members.groupBy(group).agg(F.min_by(F.struct(*rest), rank).alias("m")).select(group, "m.*")


def seeded(names: DataFrame, known: DataFrame, name: str, slug: Column, norm: Column) -> DataFrame:
    """Names that aren't known under their normal form, each once, with a slug of its own: a clash gets -2, -3 and so on."""
    plain = lambda df: df.where(F.col(name).isNotNull()).select(name, norm.alias("__norm"), slug.alias("__slug"))
    new = plain(names).join(plain(known).select("__norm").distinct(), "__norm", "left_anti")
    once = new.groupBy("__norm").agg(F.min(F.struct(name, "__slug")).alias("n")).select(f"n.{name}", "n.__slug")
    taken = plain(known).groupBy("__slug").agg(F.count_distinct("__norm").alias("__taken"))
    placed = numbered_within(once, "__slug", [F.col(name).asc()], "__i").join(taken, "__slug", "left")
    n = F.col("__i") + F.coalesce("__taken", F.lit(0))
    return placed.select(name, F.when(n == 1, F.col("__slug")).otherwise(F.concat("__slug", F.lit("-"), n.cast("string"))).alias("slug"))


def name_links(wanted: DataFrame, known: DataFrame, name: str, key: str, norm: Column) -> DataFrame:
    """Each wanted key by how many known ones share one of its names: linked to the one, ambiguous, or unlinked."""
    have = known.select(F.col(key).alias("__k"), norm.alias("__n")).where("__n is not null").distinct()
    pairs = wanted.select(key, norm.alias("__n")).where("__n is not null").distinct().join(have, "__n").groupBy(key).agg(F.min("__k").alias("__a"), F.max("__k").alias("__b"))
    one = F.col("__a") == F.col("__b")
    return wanted.select(key).distinct().join(pairs, key, "left").select(key, F.when(F.col("__a").isNull(), "unlinked").when(one, "linked").otherwise("ambiguous").alias("link"), F.when(one, F.col("__a")).alias("to"))


def alive(reports: DataFrame, key: str, at: str, done: Column, now: Column, running_min: int = 30, done_min: int = 10, most: int = 50) -> DataFrame:
    """The newest report of each transfer that still shows at ``now``: for half an hour while it runs, ten minutes when done; at most ``most``, the newest."""
    last = reports.groupBy(key).agg(F.max_by(F.struct(F.coalesce(done, F.lit(False)).alias("done")), at).alias("s"), F.max(at).alias(at)).select(key, at, "s.done")
    age = F.unix_micros(now) - F.unix_micros(at)
    shows = age <= F.when(F.col("done"), F.lit(done_min)).otherwise(F.lit(running_min)) * F.lit(60_000_000)
    return last.where(shows & (age >= 0)).orderBy(F.desc(at), key).limit(most)


# ------------------------------------------------------------------- geometry


def mosaic_extent(width: Column, height: Column, rows: Column, cols: Column, overlap_pct: Column) -> Column:
    """Width and height of a whole mosaic whose panels overlap."""
    stride = 1.0 - F.greatest(F.lit(0.0), F.least(F.lit(0.99), F.coalesce(overlap_pct, F.lit(0.0)) / 100.0))
    side = lambda size, n: size * (1 + (F.greatest(F.lit(1), F.coalesce(n, F.lit(1))) - 1) * stride)
    return F.struct(side(width, cols).alias("width"), side(height, rows).alias("height"))


def widest(corners: Column, field: Column, default: float = 1.0) -> Column:
    """Degrees that a footprint spans: the widest separation of two corners, else the longer side of the field (arcmin), else a default."""
    from lumenfold.functions.sphere import separation_deg

    across = F.array_max(F.flatten(F.transform(corners, lambda a: F.transform(corners, lambda b: separation_deg(a[0], a[1], b[0], b[1])))))
    side = F.array_max(field) / 60.0
    return F.when((F.size(corners) >= 3) & (across > 0), across).when((F.size(field) == 2) & (side > 0), side).otherwise(F.lit(default))
