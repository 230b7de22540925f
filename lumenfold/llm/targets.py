"""Linking targets of a schedule with fields of a library by name, place and rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import sphere as S
from lumenfold.llm import linkage as K
from lumenfold.operators.sky import sky_join
from lumenfold.session import cut

# fixed values: words that say what kind of object a name means, as they are written
KINDS = {
    "nebula": ("nebula", "neb.", "neb"),
    "galaxy": ("galaxy", "gal.", "gal"),
    "cluster": ("cluster", "cl.", "cl"),
    "cloud": ("cloud", "cld.", "cld"),
    "remnant": ("remnant", "rem.", "rem"),
    "complex": ("complex", "cplx.", "cplx"),
}

#: Words beside a name that tell nothing about the object.
NOISE = r"^(?:(?:redo|nb|bb|new|test|field|the|copy of|20\d\d|\*)\s+)+|^(?:redo|nb|bb|new|test|field)\s*\d*$"
PANEL = r"[\s(]*\b(?:panel|pane|tile|p)\s*\d+(?:\s*/\s*\d+)?\)?\s*$"
DESIGNATION = r"\b([a-z]{2,4}) ?(\d{1,8})\b"


def _plain(name: Column) -> Column:
    """Lower case, separators and runs of blanks as one space, without panel marks and noise words."""
    n = F.btrim(F.regexp_replace(F.lower(name), r"[\s_\-]+", " "))
    n = F.btrim(F.regexp_replace(n, PANEL, ""))
    return F.btrim(F.regexp_replace(n, NOISE, ""))


def designation(name: Column, zeros: bool = False) -> Column:
    """Catalogue and number, like ``abc 123``; null if there is none. ``zeros`` keeps those before the number: a lost digit may have stood before them."""
    n = _plain(name)
    letters, number = F.regexp_extract(n, DESIGNATION, 1), F.regexp_extract(n, DESIGNATION, 2)
    number = number if zeros else F.regexp_replace(number, r"^0+(?=\d)", "")
    return F.when(n.rlike(DESIGNATION), F.concat_ws(" ", letters, number))


def common_name(name: Column) -> Column:
    """The words of a name without designation and brackets; null if fewer than two are left."""
    n = F.regexp_replace(_plain(name), r"\b[a-z]{2,4} ?\d{1,6}\b", " ")
    n = F.btrim(F.regexp_replace(n, r"[^\p{L}. ]+|\s+", " "))
    n = F.btrim(F.regexp_replace(n, r"\s+", " "))
    n = F.btrim(F.regexp_replace(n, r"^the ", ""))
    return F.when(F.size(F.split(n, " ")) >= 2, n)


def core(name: Column) -> Column:
    """A common name without its word of kind."""
    kinds = "|".join(k.replace(".", r"\.") for ks in KINDS.values() for k in ks)
    return F.btrim(F.regexp_replace(name, rf" (?:{kinds})$", ""))


def schedule_side(df: DataFrame) -> DataFrame:
    """Attributes of scheduler targets. A right ascension is in hours, or in degrees; from 24 on it can only be degrees.

    (0, 0) and positions off the sphere are placeholders and count as missing.
    """
    ok = F.col("ra").isNotNull() & F.col("dec").isNotNull() & ~((F.col("ra") == 0) & (F.col("dec") == 0)) & (F.abs("dec") <= 90) & F.col("ra").between(-360, 720)
    hours = ok & F.col("ra").between(0, 24)
    com = common_name(F.col("name"))
    return df.select(
        F.col("id").cast("bigint").alias("l"),
        designation(F.col("name")).alias("des"),
        designation(F.col("name"), zeros=True).alias("des_typed"),
        core(com).alias("com"),
        com.alias("full"),
        F.when(hours, S.xyz(F.col("ra") * 15.0, F.col("dec"))).alias("v_hours"),
        F.when(ok, S.xyz(F.col("ra"), F.col("dec"))).alias("v_degrees"),
        F.pmod(F.col("rotation"), F.lit(180.0)).alias("rot"),
    ).dropDuplicates(["l"])


def library_side(df: DataFrame, usual_arcmin: float = 40.0) -> DataFrame:
    """Attributes of library targets; ``reach`` is half the diagonal of the field in degrees (of a usual square where the size is null)."""
    names = F.coalesce(F.col("objects"), F.array().cast("array<string>"))
    size = F.col("footprint_arcmin")
    side = lambda i: F.coalesce(F.try_element_at(size, F.lit(i)), F.lit(usual_arcmin))
    w, h = side(1), side(2)
    coms = F.array_compact(F.transform(names, common_name))
    return df.select(
        F.col("target_id").alias("r"),
        F.array_distinct(F.array_compact(F.transform(names, lambda n: designation(n)))).alias("deses"),
        F.array_distinct(F.transform(coms, core)).alias("coms"),
        F.array_distinct(coms).alias("fulls"),
        S.xyz(F.col("center_ra_deg"), F.col("center_dec_deg")).alias("c"),
        (F.sqrt(w * w + h * h) / 120.0).alias("reach"),
        F.pmod(F.col("rotation_deg"), F.lit(180.0)).alias("rot_lib"),
    ).dropDuplicates(["r"])


def _named(one: Column, many: Column, typed: Column | None = None) -> Column:
    """Level of a text (or the text as it was typed) against a list: 3 equal, 2 but for a typing error, 1 unlike."""
    near = (lambda x: K.near_text(one, x)) if typed is None else (lambda x: K.near_text(one, x) | K.near_text(typed, x))
    return (
        F.when(one.isNull() | (F.size(many) == 0), K.MISSING)
        .when(F.array_contains(many, one), 3)
        .when(F.exists(many, near), 2)
        .otherwise(1)
    )


def link_targets(schedule: DataFrame, library: DataFrame, spread: float = 0.9, crowd: int = 200) -> DataFrame:
    """All scored candidate pairs: l (scheduler id), r (target_id), the levels, sep_deg and confidence.

    Passes: designation, common name, either with one typing error, and place
    within ``spread`` of the field's half diagonal. Names that many library rows
    share are dealt into parts. Levels: designation and common name
    (equal, a typing error, unlike; pairs with no name to compare have a model of their own), place (on the centre, well inside, inside,
    outside), rotation modulo a half turn (agreeing within 1.5 degrees at an
    angle of its own, agreeing at zero, which many fields have, or unlike). A row
    with nothing to compare has no pair. Repeated ids count once; extra columns
    are ignored; an empty table gives no pairs.
    """
    left, right = cut(schedule_side(schedule)), cut(library_side(library))
    centres = right.select("r", F.col("c").alias("__c"), (F.col("reach") * spread).alias("rad"))
    spots = left.select("l", F.explode(F.array("v_hours", "v_degrees")).alias("__v")).where("__v is not null")
    near = sky_join(spots, centres, F.col("rad")).select("l", "r")
    one = lambda c: F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.array(c))
    cuts = lambda c: F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(K.deletions(F.col(c)))
    many_cuts = lambda c: F.flatten(F.transform(F.col(c), K.deletions))
    passes = [(one("des"), F.col("deses")), (one("com"), F.col("coms")), (F.concat(cuts("des"), cuts("des_typed")), many_cuts("deses")), (cuts("com"), many_cuts("coms")), (cuts("full"), many_cuts("fulls"))]
    pairs = K.candidate_pairs(left, right, passes, near, crowd)
    full = pairs.join(left, "l").join(right, "r")
    sep = F.least(S.angle(F.col("v_hours"), F.col("c")), S.angle(F.col("v_degrees"), F.col("c")))
    full = full.withColumn("sep_deg", F.degrees(sep))
    turn = F.abs(F.col("rot") - F.col("rot_lib"))
    turn = F.least(turn, 180.0 - turn)
    share = F.col("sep_deg") / F.col("reach")
    place = F.when(F.col("sep_deg").isNull(), K.MISSING).when(F.col("sep_deg") <= 0.5 / 60, 4).when(share <= 0.35, 3).when(share <= spread, 2).otherwise(1)
    upright = (F.least(F.col("rot"), 180.0 - F.col("rot")) <= 1.5) & (F.least(F.col("rot_lib"), 180.0 - F.col("rot_lib")) <= 1.5)
    rotation = F.when(turn.isNull(), K.MISSING).when(turn > 1.5, 1).when(upright, 2).otherwise(3)
    comparisons = {
        "designation": (_named(F.col("des"), F.col("deses"), F.col("des_typed")), 3),
        "name": (F.greatest(_named(F.col("com"), F.col("coms")), F.least(F.lit(2), _named(F.col("full"), F.col("fulls")))), 3),
        "place": (place, 4),
        "rotation": (rotation, 3),
    }
    levelled = full.select("l", "r", "des", "des_typed", "deses", "com", "coms", "full", "fulls", "sep_deg", "reach", "rot", "rot_lib")
    return K.score(levelled, comparisons, never=("place", 1), split=("designation", "name")).drop("des", "des_typed", "deses", "com", "coms", "full", "fulls", "rot", "rot_lib")


def matches(schedule: DataFrame, library: DataFrame, least: float = 0.2) -> DataFrame:
    """The partner of each scheduler target that has one, with its confidence; ties go to the nearer field."""
    near = F.coalesce(F.col("sep_deg") / F.col("reach"), F.lit(1e9))
    return K.best_partner(link_targets(schedule, library), least, [near])
