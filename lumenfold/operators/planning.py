"""Goals, progress, mosaics, rigs and the sky over a year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: how near a rig must be to a plan
SCALE_TOLERANCE, FIELD_FITS, FIELD_WARNS = 0.15, 0.9, 0.8


def goal_hours(unit: Column, hours: Column, frames: Column, sub_s: Column) -> Column:
    """A goal in hours, whichever unit it was given in."""
    return F.when(unit == "fr", frames * sub_s / 3600.0).otherwise(hours)


def frames_wanted(hours: Column, sub_s: Column) -> Column:
    """Exposures that a goal of hours takes: at least one."""
    return F.greatest(F.lit(1), F.ceil(F.round(hours * 3600.0 / F.nullif(sub_s, F.lit(0.0)), 9))).cast("bigint")


def hours_for_frames(frames: Column, sub_s: Column) -> Column:
    """Hours that come back to exactly these frames: four digits if they do, else rounded down, else exact."""
    exact = frames * sub_s / 3600.0
    four, floor = F.round(exact, 4), F.floor(exact * 10000) / 10000.0
    return F.when(frames_wanted(four, sub_s) == frames, four).when(frames_wanted(floor, sub_s) == frames, floor).otherwise(exact)


def by_filter(rows: DataFrame) -> DataFrame:
    """Goal, actual, credited (no more than each row's goal) and missing hours per plan and filter."""
    goal = goal_hours(F.col("unit"), F.col("target_hours"), F.col("target_frames"), F.col("template_sub_s"))
    df = rows.withColumns({"goal": F.coalesce(goal, F.lit(0.0)), "actual": F.coalesce("actual_hours", F.lit(0.0))})
    df = df.withColumn("credit", F.least("goal", "actual"))
    return df.groupBy("plan_id", "filter").agg(F.sum("goal").alias("goal_hours"), F.sum("actual").alias("actual_hours"), F.sum("credit").alias("credited_hours"), F.sum(F.greatest(F.lit(0.0), F.col("goal") - F.col("actual"))).alias("left_hours"), F.count("*").alias("rows"))


def by_plan(filters: DataFrame) -> DataFrame:
    """Progress of a plan: hours done and left, and whether all goals are met."""
    df = filters.groupBy("plan_id").agg(*(F.sum(c).alias(c) for c in ("goal_hours", "credited_hours", "left_hours")), F.bool_and((F.col("goal_hours") > 0) & (F.col("left_hours") <= 0)).alias("finished"))
    return df.withColumn("done", F.when(F.col("goal_hours") > 0, F.least(F.lit(1.0), F.col("credited_hours") / F.col("goal_hours"))))


def mosaic_panels(fields: DataFrame, rows: Column, cols: Column, overlap_pct: Column) -> DataFrame:
    """Centres of the panels of a mosaic: row 0 is north; offsets are flat, divided by the cosine of the declination.

    ``fields``: id, ra_deg, dec_deg, w_arcmin, h_arcmin, rotation_deg.
    """
    lap = F.greatest(F.lit(0.0), F.least(F.lit(0.99), overlap_pct / 100.0))
    df = fields.withColumns({"__r": rows, "__c": cols, "__o": lap})
    df = df.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("__r") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("__c") - 1)))
    x = (F.col("col") - (F.col("__c") - 1) / 2.0) * F.col("w_arcmin") / 60.0 * (1.0 - F.col("__o"))
    y = ((F.col("__r") - 1) / 2.0 - F.col("row")) * F.col("h_arcmin") / 60.0 * (1.0 - F.col("__o"))
    df = df.withColumns({"__x": x, "__y": y, "__t": F.radians(F.coalesce("rotation_deg", F.lit(0.0)))})
    east = F.col("__x") * F.cos("__t") + F.col("__y") * F.sin("__t")
    north = F.col("__y") * F.cos("__t") - F.col("__x") * F.sin("__t")
    flat = F.greatest(F.lit(1e-6), F.cos(F.radians("dec_deg")))
    return df.select("id", "row", "col", (F.col("ra_deg") + east / flat).alias("panel_ra_deg"), (F.col("dec_deg") + north).alias("panel_dec_deg"))


def rig_verdicts(plans: DataFrame, scale: float, width: float, height: float, bands: dict[str, str]) -> DataFrame:
    """How well one rig fits each plan: ratios, missing filters, verdict.

    ``plans``: id, scale, w, h, filters (array). ``bands`` gives the rig's bands
    and how it has them: direct, colour or dual.
    """
    have, dual = F.array(*map(F.lit, sorted(bands))), F.array(*(F.lit(b) for b in sorted(bands) if bands[b] == "dual")).cast("array<string>")
    ratio = F.lit(scale) / F.col("scale")
    worst = F.least(F.lit(width) / F.col("w"), F.lit(height) / F.col("h"))
    missing = F.array_sort(F.array_except("filters", have))
    warn = (worst < FIELD_FITS) | F.arrays_overlap("filters", dual)
    bad = (F.abs(ratio - 1.0) > SCALE_TOLERANCE) | (worst < FIELD_WARNS) | (F.size(missing) > 0)
    known = F.coalesce((F.col("scale") > 0) & (F.col("w") > 0) & (F.col("h") > 0), F.lit(False))
    verdict = F.when(~known, "unconstrained").when(bad, "no_fit").when(warn, "fit_with_warnings").otherwise("fit")
    return plans.select("id", F.round(ratio, 4).alias("scale_ratio"), F.round(worst, 4).alias("field_ratio"), missing.alias("missing"), verdict.alias("verdict"))


# ------------------------------------------------------------------ altitudes


def _gmst(days: Column) -> Column:
    """Greenwich mean sidereal time in degrees, days since J2000.0."""
    return F.pmod(F.lit(280.46061837) + days * 360.98564736629, F.lit(360.0))


def precessed(ra: Column, dec: Column, days: Column) -> tuple[Column, Column]:
    """Right ascension and declination of date, from J2000, to first order in time."""
    t = days / 36525.0
    m, n = t * 1.2812323, t * 0.5567530
    a, d = F.radians(ra), F.radians(dec)
    # the rotation is applied about the mean of the pole's path, which stays exact enough near the poles
    z = F.radians(n)
    x, y, w = F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)
    x2, w2 = x * F.cos(z) - w * F.sin(z), x * F.sin(z) + w * F.cos(z)
    return F.degrees(F.atan2(y, x2)) + m, F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), w2))))


def altitude(ra: Column, dec: Column, days: Column, lat: Column, lon: Column) -> Column:
    """Altitude in degrees at a site, without refraction; positions are of date."""
    h = F.radians(_gmst(days) + lon - ra)
    s = F.sin(F.radians(dec)) * F.sin(F.radians(lat)) + F.cos(F.radians(dec)) * F.cos(F.radians(lat)) * F.cos(h)
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s))))


def sun(days: Column) -> tuple[Column, Column]:
    """Right ascension and declination of the sun to about 0.01 degrees."""
    g = F.radians(F.lit(357.528) + days * 0.9856003)
    lon = F.radians(F.lit(280.460) + days * 0.9856474 + F.sin(g) * 1.915 + F.sin(g * 2) * 0.020)
    eps = F.radians(F.lit(23.439) - days * 0.0000004)
    return F.degrees(F.atan2(F.cos(eps) * F.sin(lon), F.cos(lon))), F.degrees(F.asin(F.sin(eps) * F.sin(lon)))


def year_visibility(targets: DataFrame, year: int, lat: float, lon: float, min_alt: float, step_min: int = 15) -> DataFrame:
    """Peak altitude and hours above the minimum in astronomical darkness, per target and month, with a label.

    Each month is sampled from noon of the 15th for a day, both ends included.
    The dark samples (a few hundred rows for the year, whatever the targets) are
    joined to the targets once for all. A month without darkness is not_visible.
    """
    spark = targets.sparkSession
    n = 24 * 60 // step_min
    months = spark.range(1, 13).select(F.col("id").cast("int").alias("month"))
    start = F.datediff(F.make_date(F.lit(year), F.col("month"), F.lit(15)), F.lit("2000-01-01").cast("date"))
    times = months.select("month", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("i")).withColumn("days", start + F.col("i") * (step_min / 1440.0))
    sun_ra, sun_dec = sun(F.col("days"))
    dark = times.where(altitude(sun_ra, sun_dec, F.col("days"), F.lit(lat), F.lit(lon)) < -18.0).select("month", "days")
    grid = dark.groupBy().agg(F.collect_list(F.struct("month", "days")).alias("grid"))
    rows = targets.crossJoin(F.broadcast(grid)).select("target_id", "ra_deg", "dec_deg", F.explode("grid").alias("g"))  # one row of samples
    ra, dec = precessed(F.col("ra_deg"), F.col("dec_deg"), F.col("g.days"))
    alt = rows.select("target_id", F.col("g.month").alias("month"), altitude(ra, dec, F.col("g.days"), F.lit(lat), F.lit(lon)).alias("alt"))
    found = alt.groupBy("target_id", "month").agg(F.max("alt").alias("peak"), (F.count_if(F.col("alt") >= min_alt) * (step_min / 60.0)).alias("hours"))
    all_months = targets.select("target_id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    df = all_months.join(found, ["target_id", "month"], "left")
    label = (
        F.when(F.col("peak").isNull() | (F.col("peak") < min_alt), "not_visible")
        .when(F.col("hours") < 1.0, "partial")
        .when((F.col("peak") >= 60.0) & (F.col("hours") >= 3.0), "great")
        .when((F.col("peak") >= 45.0) & (F.col("hours") >= 2.0), "good")
        .otherwise("fair")
    )
    return df.select("target_id", "month", label.alias("label"), F.round("peak", 2).alias("peak_alt_deg"), F.round(F.coalesce("hours", F.lit(0.0)), 2).alias("hours_above_min"))


LABELS = ("not_visible", "partial", "fair", "good", "great")


def trend(bins: DataFrame, month: int) -> DataFrame:
    """Rank of a month, of the season (the next three, round the year's end) and months until it is good."""
    rank = F.array_position(F.array(*map(F.lit, LABELS)), F.col("label")) - 1
    year = bins.groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("month", (rank * 100 + F.col("hours_above_min")).alias("score"), rank.alias("rank")))).alias("y"))
    at = lambda k: F.element_at("y", F.lit((month - 1 + k) % 12 + 1))
    season = at(1)["score"] + at(2)["score"] + at(3)["score"]
    order = F.array(*(at(k)["rank"] for k in range(12)))
    until = F.array_position(F.transform(order, lambda r: r >= 3), F.lit(True)) - 1
    return year.select("target_id", at(0)["score"].alias("now"), season.alias("season"), F.when(until >= 0, until).alias("months_until_good"))
