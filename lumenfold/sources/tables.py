"""Sources and sinks of tables: manifests, catalogues, scheduler snapshots, atomic writes and shared copies."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions import names as N
from lumenfold.functions import sphere as S

#: A manifest document: targets with their bands.
MANIFEST = """schema int, targets array<struct<target_id: bigint, objects: array<string>, center_ra_deg: double, center_dec_deg: double, fov_arcmin: array<double>, footprint_arcmin: array<double>,
 rotation_deg: double, corners_icrs: array<array<double>>, telescopes: array<string>, cameras: array<string>, filters: map<string, struct<total_hours: double, files: int>>>>"""


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Targets of a manifest document, with a fixed schema; figures that aren't finite become null."""
    doc = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    df = doc.select(F.explode("targets").alias("t")).select("t.*")
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < F.lit(1e300)), F.col(c))
    return df.withColumns({c: finite(c) for c in ("center_ra_deg", "center_dec_deg", "rotation_deg")})


def check_shared(targets: DataFrame, most: int = 10_000) -> DataFrame:
    """A manifest from somebody else: refused if it has too many targets or any text that looks like a path."""
    texts = F.concat_ws("\n", F.array_join("objects", "\n"), F.array_join("telescopes", "\n"), F.array_join("cameras", "\n"), F.array_join(F.map_keys("filters"), "\n"))
    bad = texts.rlike(r"(?i)(?:^|\n)(?:[a-z]:)?[\\/]|\\\\|://|[\\/][^\n]*[\\/]")
    n, paths = targets.agg(F.count("*"), F.count_if(bad)).first()
    if n > most:
        raise ValueError(f"{n} targets; {most} at most")
    if paths:
        raise ValueError(f"{paths} targets hold a path")
    return targets


def read_catalogue(spark: SparkSession, path: str, sep: str, columns: dict[str, str], catalogue: str, comment: str | None = "#", galactic: bool = False) -> DataFrame:
    """A delimited catalogue as candidates: ``columns`` maps name, ra and dec (or l and b) to its columns.

    Positions may be sexagesimal; rows without a readable position are left out
    and counted by :func:`read_quarantine`.
    """
    raw = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE")
    raw = (raw.option("comment", comment) if comment else raw).csv(path)
    return _placed(raw, columns, catalogue, galactic).where("ra_deg is not null and dec_deg is not null")


def read_quarantine(spark: SparkSession, path: str, sep: str, columns: dict[str, str], catalogue: str, comment: str | None = "#", galactic: bool = False) -> DataFrame:
    raw = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE")
    raw = (raw.option("comment", comment) if comment else raw).csv(path)
    return _placed(raw, columns, catalogue, galactic).where("ra_deg is null or dec_deg is null")


def _placed(raw: DataFrame, columns: dict[str, str], catalogue: str, galactic: bool) -> DataFrame:
    name = F.btrim(F.col(columns["name"]))
    if galactic:
        l, b = (F.col(columns[c]).try_cast("double") for c in ("l", "b"))
        at = from_galactic(l, b)
        ra, dec = at["ra"], at["dec"]
    else:
        ra, dec = N.parse_ra(F.col(columns["ra"])), N.parse_dec(F.col(columns["dec"]))
    return raw.select(F.lit(catalogue).alias("catalog"), name.alias("name"), ra.alias("ra_deg"), dec.alias("dec_deg")).withColumn("galactic", S.galactic(F.col("ra_deg"), F.col("dec_deg")))


def from_galactic(l, b):  # noqa: E741
    """Galactic to ICRS: the inverse of :func:`sphere.galactic`."""
    # fixed values: rows of the galactic to ICRS rotation
    rows = (
        (-0.0548755604162154, 0.4941094278755837, -0.8676661490190047),
        (-0.8734370902348850, -0.4448296299600112, -0.1980763734312015),
        (-0.4838350155487132, 0.7469822444972189, 0.4559837761750669),
    )
    v = S.xyz(l, b)
    x, y, z = (v["x"] * r[0] + v["y"] * r[1] + v["z"] * r[2] for r in rows)
    return F.struct(F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)).alias("ra"), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z)))).alias("dec"))


def merge_catalogues(parts: Iterable[tuple[int, DataFrame]], key: str) -> DataFrame:
    """One catalogue from several; of rows that share a key the one of greatest precedence stays."""
    union = None
    for rank, df in parts:
        tagged = df.withColumn("__rank", F.lit(rank))
        union = tagged if union is None else union.unionByName(tagged, allowMissingColumns=True)
    if union is None:
        raise ValueError("no catalogue")
    rest = [c for c in union.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct("__rank", F.xxhash64(*rest)))
    return union.groupBy(key).agg(best.alias("r")).select(key, "r.*").drop("__rank")


def fan_out(sources: dict[str, Callable[[], DataFrame]], columns: list[str]) -> tuple[DataFrame | None, dict[str, str]]:
    """Rows of all sources that work, and the error of each that doesn't."""
    rows, failed = None, {}
    for name, make in sources.items():
        try:
            df = make().select(F.lit(name).alias("source"), *columns)
        except Exception as e:
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
            continue
        rows = df if rows is None else rows.unionByName(df)
    return rows, failed


def conform(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """A table of any version as one schema: missing columns are typed nulls or defaults, others are cast or null."""
    have = {c.lower(): c for c in df.columns}
    defaults = defaults or {}

    def one(f: T.StructField):
        if f.name.lower() not in have:
            return F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name)
        return F.col(have[f.name.lower()]).try_cast(f.dataType).alias(f.name)

    return df.select(*map(one, schema.fields))


def write_atomic(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace a table: written beside it, then renamed, so that readers see the old or the new one."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target, staged, old = (jvm.org.apache.hadoop.fs.Path(path + s) for s in ("", ".staged", ".old"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(staged, True)
    df.write.format(fmt).save(path + ".staged")
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(staged, target):
        fs.rename(old, target)
        raise OSError(f"could not replace {path}")
    fs.delete(old, True)


#: What may leave the archive of a band: figures in tenths of an hour and flags, never the rigs.
BAND_HOURS = ("total_hours", "captured_hours", "accepted_hours", "integrated_hours")


def sanitised(targets: DataFrame, salt: str, key: str = "target_id") -> DataFrame:
    """What may leave the archive: allowed columns only, ids hashed with a secret salt, names that look like paths hidden, apertures for telescopes, figures in tenths.

    ``filters`` is a map of structs; of each band all hours are kept that the
    struct has (0 where null), the files, and the basis and flag of the
    headline. A path anywhere in what is left raises when read. Columns that
    aren't there are left out.
    """
    has = set(targets.columns)
    ident = F.concat(F.lit("f_"), F.substring(F.sha2(F.concat_ws("|", F.lit(salt), F.col(key).cast("string"), F.col("center_ra_deg").cast("string"), F.col("center_dec_deg").cast("string")), 256), 1, 12))
    out = {"target_id": ident}
    if "objects" in has:
        out["objects"] = F.transform(F.coalesce("objects", F.array().cast("array<string>")), lambda o: F.when((F.coalesce(o, F.lit("")) == "") | o.rlike(r"(?i)[:\\/]|\.(?:fits?|xisf)$"), "unknown").otherwise(o))
    for c in ("center_ra_deg", "center_dec_deg", "center_l_deg", "center_b_deg", "pix_arcsec", "rotation_deg", "fov_arcmin", "corners_icrs"):
        if c in has:
            out[c] = F.col(c)
    out["telescopes"] = F.transform(F.coalesce("telescopes", F.array().cast("array<string>")), N.aperture_class)
    inner = targets.schema["filters"].dataType.valueType.names
    keep = lambda f: [
        *(F.round(F.coalesce(f[h], F.lit(0.0)), 1).alias(h) for h in BAND_HOURS if h in inner),
        F.coalesce(f["files"], F.lit(0)).alias("files"),
        *([f["headline_basis"].alias("headline_basis")] if "headline_basis" in inner else []),
        *([F.coalesce(f["stale_master"], F.lit(False)).alias("stale_master")] if "stale_master" in inner else []),
    ]
    out["filters"] = F.transform_values("filters", lambda _, f: F.struct(*keep(f)))
    df = targets.select(*(v.alias(k) for k, v in out.items()))
    texts = F.concat(F.coalesce(F.map_keys("filters"), F.array().cast("array<string>")), F.col("telescopes"), *([F.col("objects")] if "objects" in has else []))
    leak = F.coalesce(F.exists(texts, lambda k: k.rlike(r"[\\/]|^~|\.(?:fits?|xisf)$")), F.lit(False))
    return df.withColumn("target_id", F.when(leak, F.raise_error(F.lit("a path in a shared table"))).otherwise(F.col("target_id")))


def summary(bands: DataFrame, targets: int = 15) -> str:
    """A report in Markdown: totals, bands in a fixed order, the largest targets. Only aggregates come to the driver."""
    from lumenfold.operators.hours import filter_rollup, top_targets

    order = ("L", "R", "G", "B", "Ha", "OIII", "SII")
    rows = {r["band"]: r for r in filter_rollup(bands).collect()}
    names = [b for b in order if b in rows] + sorted(set(rows) - set(order))
    out = ["# Archive", "", "| band | targets | captured h | headline h |", "|-|-|-|-|"]
    out += [f"| {b} | {rows[b]['targets']} | {rows[b]['captured_hours']:.2f} | {rows[b]['headline_hours']:.2f} |" for b in names]
    out += ["", f"## Top {targets}", ""] + [f"- {r['target_id']}: {r['total_hours']:.2f} h" for r in top_targets(bands, targets).collect()]
    return "\n".join(out) + "\n"
