"""Objects of remote catalogues after they have arrived: rows from columnar replies, families, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: catalogues by the way they write a name
CATALOGUE_NAMES = {"messier": r"^M\s*\d+$", "ngc": r"^NGC\s*\d+", "ic": r"^IC\s*\d+", "sharpless": r"^Sh\s*2-", "barnard": r"^Barnard\s*\d+|^B\s+\d+", "ldn": r"^LDN\s*\d+", "lbn": r"^LBN\s*\d+", "abell": r"^(?:Abell|PN A66)\s*\d+"}


def reply_rows(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Rows of a columnar reply ``{"metadata": [{"name": ..}], "data": [[..]]}``: oid, name, type, ra, dec, major, minor, pa.

    Cells are found by the names in the reply. Rows without a type or a position
    drop out; sizes that aren't positive become null. Broken replies give no rows.
    """
    schema = "metadata array<struct<name:string>>, data array<array<string>>"
    df = replies.select(F.from_json(column, schema).alias("r")).select(F.transform("r.metadata", lambda m: F.lower(m["name"])).alias("names"), F.explode("r.data").alias("cells"))
    get = lambda n: F.try_element_at("cells", F.nullif(F.array_position("names", n), F.lit(0)).cast("int"))
    size = lambda n: F.when(get(n).try_cast("double") > 0, get(n).try_cast("double"))
    out = df.select(
        get("oid").try_cast("bigint").alias("oid"), F.btrim(F.regexp_replace(get("main_id"), r"\s+", " ")).alias("name"), get("otype").alias("type"), get("ra").try_cast("double").alias("ra"), get("dec").try_cast("double").alias("dec"),
        size("galdim_majaxis").alias("major"), size("galdim_minaxis").alias("minor"), get("galdim_angle").try_cast("double").alias("pa"),
    )
    return out.where("type is not null and ra is not null and dec is not null")


def with_identifiers(objects: DataFrame, aliases: DataFrame) -> DataFrame:
    """Objects with their other names (oid, id), each once, in order, without the name itself."""
    got = aliases.select("oid", F.btrim(F.regexp_replace("id", r"\s+", " ")).alias("a")).groupBy("oid").agg(F.array_sort(F.collect_set("a")).alias("aliases"))
    df = objects.join(got, "oid", "left")
    return df.withColumn("aliases", F.coalesce(F.array_remove("aliases", F.col("name")), F.array().cast("array<string>")))


def catalogues_of(names: Column) -> Column:
    """Catalogues that an object's names belong to; ``other`` if none."""
    written = lambda p: lambda n: n.rlike(f"(?i){p}")
    hits = F.array_compact(F.array(*(F.when(F.exists(names, written(p)), F.lit(c)) for c, p in CATALOGUE_NAMES.items())))
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit("other")))


def fits_frame(major: Column, frame_arcmin: float, low: float | None, high: float | None, unknown: bool, least_arcmin: float = 0.0) -> Column:
    """Whether an object is large enough and fills a share of the frame between two ends, either of which may be open."""
    fill = major / frame_arcmin
    ok = (major >= least_arcmin) & (fill >= (low if low is not None else 0.0)) & (fill <= high if high is not None else F.lit(True))
    return F.when(major.isNull(), F.lit(unknown)).otherwise(ok)
