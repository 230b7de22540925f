"""Records whose fields drift between files: one table, and a report of each change.

Reading enforces a target schema strictly. A field that the schema doesn't
name, whose value is of another type, or that is null, is kept as JSON in a
rescue column, so nothing is lost: which fields a record had, of which type and
with which value, can be read off the table. The report of changes is made from
it. Fields that are approved are then promoted: their rescued values are
replayed, cast, into the typed columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.session import cut

RESCUED = "_rescued"


@dataclass(frozen=True)
class Field:
    """A column of the target table: its type, and the approved names it may be replayed from, best first."""

    name: str
    kind: str
    aliases: tuple[str, ...] = ()


def _object(record: str | Column) -> Column:
    """The record as a map of variants; null if it isn't one JSON object with unlike names."""
    return F.try_parse_json(F.col(record) if isinstance(record, str) else record).try_cast("map<string,variant>")


def _number(v: Column) -> Column:
    """A number, a number as text, or a sexagesimal text (its first part is whole units)."""
    plain = v.try_cast("double")
    text = F.btrim(v.try_cast("string"))
    parts = F.split(text, r"[:\s]+")
    part = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    size = F.abs(part(1)) + part(2) / 60.0 + F.coalesce(part(3), F.lit(0.0)) / 3600.0
    return F.coalesce(plain, F.when(text.rlike(r"^[+-]?\d+[:\s]+\d+([:\s]+[\d.]+)?$"), F.when(text.startswith("-"), -size).otherwise(size)))


def _list(v: Column) -> Column:
    """A list of numbers, or one written as text with commas."""
    text = v.try_cast("string")
    return F.coalesce(v.try_cast("array<bigint>"), F.when(text.rlike(r"^\s*-?\d+(\s*,\s*-?\d+)*\s*$"), F.transform(F.split(text, ","), lambda x: F.btrim(x).try_cast("bigint"))))


def _typed(v: Column, kind: str) -> Column:
    if kind == "double":
        return _number(v)
    if kind == "bigint":
        return v.try_cast("bigint")
    if kind == "boolean":
        return F.coalesce(v.try_cast("boolean"), v.try_cast("bigint") != 0)
    if kind == "array<bigint>":
        return _list(v)
    return v.try_cast(kind)


#: The name under which a record that can't be read is rescued whole.
CORRUPT = "_corrupt"

#: What a value of each column type is in JSON.
KIND = {"string": "text", "double": "number", "bigint": "number", "boolean": "boolean", "array<bigint>": "list"}


def _strict(v: Column, kind: str) -> Column:
    """The value, if it is of exactly this type; null if anything would have to be cast."""
    s = F.schema_of_variant(v)
    if kind == "string":
        return F.when(s == "STRING", v.try_cast("string"))
    if kind == "boolean":
        return F.when(s == "BOOLEAN", v.try_cast("boolean"))
    if kind == "bigint":
        return F.when(s == "BIGINT", v.try_cast("bigint"))
    if kind == "double":
        return F.when(s.rlike("^(BIGINT|DOUBLE|DECIMAL)"), v.try_cast("double"))
    if kind == "array<bigint>":
        return F.when(s == "ARRAY<BIGINT>", v.try_cast("array<bigint>"))
    raise ValueError(f"no type for fields of {kind}")


def ingest(raw: DataFrame, fields: list[Field], record: str = "record") -> DataFrame:
    """Typed columns for the fields of exactly these names and types, the rest as JSON in ``_rescued``.

    Keeps the other columns of ``raw``; one that has a target field's name is
    renamed with the prefix ``raw_``. Unknown fields, values of another type and
    null fields are rescued as they are. A record that can't be read is rescued
    whole under the name ``_corrupt``; a field that has this name itself is no
    field of its file.
    """
    clash = {f.name for f in fields} | {RESCUED}
    others = [F.col(c).alias(f"raw_{c}" if c in clash else c) for c in raw.columns if c != record]
    df = raw.select(*others, _object(record).alias("__o"), F.col(record).alias("__text"))
    typed = {f.name: _strict(F.try_element_at("__o", F.lit(f.name)), f.kind) for f in fields}
    df = df.withColumns(typed)
    df = df.withColumn("__fits", F.array_compact(F.array(*(F.when(F.col(f.name).isNotNull(), F.lit(f.name)) for f in fields))))
    # the names are used twice, so the optimizer works them out once a record and not once a field of it
    rest = F.when(F.size("__fits") == 0, F.col("__o")).otherwise(F.map_filter("__o", lambda k, v: ~F.array_contains("__fits", k)))
    rescued = F.when(F.col("__o").isNull(), F.when(F.col("__text").isNotNull(), F.to_json(F.create_map(F.lit(CORRUPT), F.col("__text"))))).when(F.size(rest) > 0, F.to_json(rest))
    return df.withColumn(RESCUED, rescued).drop("__o", "__text", "__fits")


def promote(table: DataFrame, fields: list[Field]) -> DataFrame:
    """Replay rescued values into typed columns: the approved aliases of each field, in order, where the column is null.

    What was replayed leaves the rescue column, and so do nulls; what still doesn't fit stays.
    """
    df = table.withColumn("__r", _object(RESCUED))
    columns, used = {}, []
    for f in fields:
        value = F.col(f.name)
        for a in (f.name, *f.aliases):
            old = _typed(F.try_element_at("__r", F.lit(a)), f.kind)
            used.append(F.when(value.isNull() & old.isNotNull(), F.lit(a)))
            value = F.coalesce(value, old)
        columns[f.name] = value
    df = df.withColumn("__used", F.array_compact(F.array(*used))) if used else df.withColumn("__used", F.array().cast("array<string>"))
    left = F.map_filter("__r", lambda k, v: ~F.array_contains("__used", k) & ~F.is_variant_null(v))
    df = df.withColumns(columns | {RESCUED: F.when(F.col("__r").isNull(), F.col(RESCUED)).when(F.size(left) > 0, F.to_json(left))})
    return df.drop("__r", "__used")


def _kind(v: Column) -> Column:
    """number, text, boolean, list or object; null for a null."""
    s = F.schema_of_variant(v)
    return (
        F.when(s == "VOID", None)
        .when(s == "STRING", "text")
        .when(s == "BOOLEAN", "boolean")
        .when(s.startswith("ARRAY"), "list")
        .when(s.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def _plain_number(v: Column) -> Column:
    """A number as text: equal numbers give equal texts, whether they were written whole or with a fraction."""
    whole = (F.abs(v) < 2.0**53) & (v == F.floor(v))
    return F.when(whole, v.cast("bigint").cast("string")).otherwise(v.cast("string"))


def _value(v: Column, s: Column) -> Column:
    """A rescued value of schema ``s`` as its kind and text; equal values of a kind give equal texts."""
    number = F.when(s == "BIGINT", v.try_cast("string")).otherwise(_plain_number(v.try_cast("double")))
    return (
        F.when(s == "STRING", F.concat(F.lit("text "), v.try_cast("string")))
        .when(s == "BOOLEAN", F.concat(F.lit("boolean "), v.try_cast("string")))
        .when(s.startswith("ARRAY"), F.concat(F.lit("list "), F.to_json(v)))
        .when(s.startswith("OBJECT"), F.concat(F.lit("object "), F.to_json(v)))
        .otherwise(F.concat(F.lit("number "), number))
    )


def _typed_value(f: Field) -> Column:
    """The same of a typed column."""
    c = F.col(f.name)
    text = _plain_number(c) if f.kind == "double" else F.to_json(c) if f.kind.startswith("array") else c.cast("string")
    return F.concat(F.lit(KIND[f.kind] + " "), text)


def field_changes(table: DataFrame, fields: list[Field], identity: str = "guid") -> DataFrame:
    """Changes of each file's top-level fields against the file before it in its feed, from an ingested table.

    ``table`` is what :func:`ingest` made (not yet promoted), with feed and
    file_seq; a typed column holds a field of its type, everything else is in
    the rescue column. It is read three times, so it should be a written one.
    Gives feed, file_seq, change (added, removed, renamed, retyped), old_field
    and new_field (empty where there is none). Files are ordered by
    ``file_seq`` alone; rows without feed or file_seq belong to no file, and
    records that can't be read have no fields. A field is retyped if the
    commonest type of its non-null values differs (ties: the first by name). A
    rename pairs the gone with the new field that agree in most targets, each
    field once; ties go to the names. Records that are repeated count by
    target, not by row.
    """
    raw = table.where("feed is not null and file_seq is not null").withColumn("file_seq", F.col("file_seq").cast("bigint"))
    names = [f.name for f in fields]
    # typed columns are counted in place; only what was rescued is taken apart
    typed = raw.groupBy("feed", "file_seq").agg(*(F.count(n).alias(f"__n{i}") for i, n in enumerate(names)))
    one = F.array(*(F.struct(F.lit(f.name).alias("field"), F.lit(KIND[f.kind]).alias("kind"), F.col(f"__n{i}").alias("count")) for i, f in enumerate(fields)))
    typed = typed.select("feed", "file_seq", F.inline(one)).where("count > 0")
    rescued = raw.where(F.col(RESCUED).isNotNull()).select("feed", "file_seq", F.explode(_object(RESCUED)).alias("field", "v")).where(F.col("field") != CORRUPT)
    counts = typed.unionByName(rescued.groupBy("feed", "file_seq", "field", _kind(F.col("v")).alias("kind")).count())
    counts = counts.groupBy("feed", "file_seq", "field", "kind").agg(F.sum("count").alias("count"))
    # a file's fields are few; from here on rows are fields of files, not records
    best = F.min_by("kind", F.when(F.col("kind").isNotNull(), F.struct((-F.col("count")).alias("n"), F.col("kind").alias("k"))))
    shapes = counts.groupBy("feed", "file_seq", "field").agg(best.alias("kind"))
    shapes = cut(shapes)
    files = raw.groupBy("feed", "file_seq").agg(F.lit(1).alias("one"))
    before = files.withColumn("before", F.lag("file_seq").over(Window.partitionBy("feed").orderBy("file_seq"))).where("before is not null").drop("one")
    now = before.join(shapes, ["feed", "file_seq"]).withColumn("__now", F.lit(True))
    old = before.join(shapes.select("feed", F.col("file_seq").alias("before"), "field", F.col("kind").alias("old_kind")), ["feed", "before"]).withColumn("__old", F.lit(True))
    both = now.join(old, ["feed", "file_seq", "before", "field"], "full_outer")
    both = cut(both.where("__now is null or __old is null or kind <> old_kind"))

    retyped = both.where("__now and __old").select("feed", "file_seq", F.lit("retyped").alias("change"), F.col("field").alias("old_field"), F.col("field").alias("new_field"))
    gone = both.where("__now is null").select("feed", "file_seq", "before", F.col("field").alias("old_field"))
    new = both.where("__old is null").select("feed", "file_seq", "before", F.col("field").alias("new_field"))
    # values are read only from files that lost a field and gained one
    pairs = gone.join(new, ["feed", "file_seq", "before"])
    r = _object(RESCUED)
    own = F.try_element_at("__r", F.lit(identity)).try_cast("string")
    id_of = F.coalesce(F.col(identity).cast("string"), own) if identity in names else own
    # values are worked out of the wanted fields alone
    wanted = lambda name: F.array_contains("names", name)
    kept = F.array_compact(F.array(*(F.when(wanted(F.lit(f.name)) & F.col(f.name).isNotNull(), F.struct(F.lit(f.name).alias("field"), _typed_value(f).alias("v"))) for f in fields)))
    loose = F.filter(F.coalesce(F.map_entries("__r"), F.array().cast("array<struct<key:string,value:variant>>")), lambda e: wanted(e["key"]) & (e["key"] != CORRUPT))
    loose = F.filter(F.transform(loose, lambda e: F.struct(e["key"].alias("k"), e["value"].alias("x"), F.schema_of_variant(e["value"]).alias("s"))), lambda e: e["s"] != "VOID")
    loose = F.transform(loose, lambda e: F.struct(e["k"].alias("field"), _value(e["x"], e["s"]).alias("v")))
    held = raw.withColumnsRenamed({"file_seq": "at"}).withColumn("__r", r).withColumn("id", id_of).where("id is not null")

    def values(fields: DataFrame, at: str, name: str) -> DataFrame:
        lists = fields.groupBy("feed", "file_seq", F.col(at).alias("at")).agg(F.collect_set(name).alias("names"))
        rows = held.join(lists, ["feed", "at"])
        got = rows.select("feed", "file_seq", "id", F.inline(F.concat(kept, loose)).alias(name, "v"))
        return got.groupBy("feed", "file_seq", "id", name).agg(F.collect_set("v").alias(f"{name}_v"))

    both_sides = pairs.select("feed", "file_seq", "before").distinct()
    a = values(gone.join(both_sides, ["feed", "file_seq", "before"], "left_semi"), "before", "old_field")
    b = values(new.join(both_sides, ["feed", "file_seq", "before"], "left_semi").withColumn("now", F.col("file_seq")), "now", "new_field")
    agree = a.join(b, ["feed", "file_seq", "id"]).groupBy("feed", "file_seq", "old_field", "new_field").agg(F.count("*").alias("n"), F.count_if(F.arrays_overlap("old_field_v", "new_field_v")).alias("same"))
    share = F.col("same") / F.col("n")
    likely = agree.where(F.col("same") * 2 >= F.col("n")).withColumn("share", share)
    rank = lambda c, o: F.row_number().over(Window.partitionBy("feed", "file_seq", c).orderBy(F.desc("share"), F.desc("same"), o))
    renamed = likely.withColumn("i", rank("old_field", "new_field")).withColumn("j", rank("new_field", "old_field")).where("i = 1 and j = 1")
    renamed = cut(renamed.select("feed", "file_seq", "old_field", "new_field"))
    empty = F.lit("")
    removed = gone.join(renamed, ["feed", "file_seq", "old_field"], "left_anti").select("feed", "file_seq", F.lit("removed").alias("change"), "old_field", empty.alias("new_field"))
    added = new.join(renamed, ["feed", "file_seq", "new_field"], "left_anti").select("feed", "file_seq", F.lit("added").alias("change"), empty.alias("old_field"), "new_field")
    moved = renamed.select("feed", "file_seq", F.lit("renamed").alias("change"), "old_field", "new_field")
    return retyped.unionByName(removed).unionByName(added).unionByName(moved)
