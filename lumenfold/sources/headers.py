"""Image headers of an archive: FITS cards and XISF XML, without reading the images.

Only as many bytes as the header has are read of each file. A file that can't
be read becomes a row with its error, never an exception.
"""

from __future__ import annotations

import math
import re
import struct
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions import names as N

EXTENSIONS = ("fit", "fits", "fts", "xisf")
CARD, BLOCK, MOST_BLOCKS = 80, 2880, 4000

_NUMBER = {"exptime", "pix_arcsec", "pix_arcsec_focal", "focallen", "xpixsz", "ypixsz", "aperture_mm", "gain", "offset", "ra_deg", "dec_deg", "rotation_deg"}
_WHOLE = {"ncombine", "naxis1", "naxis2", "wcs_naxis1", "wcs_naxis2", "xbinning"}
_TEXT = ("raw_filter", "date_obs", "date_obs_ms_raw", "object", "raw_telescope", "raw_camera", "creator", "imagetyp", "error")
_FLAG = ("ok", "has_wcs", "colour")
FIELDS = [*_TEXT, *sorted(_NUMBER), *sorted(_WHOLE), *_FLAG]
SCHEMA = T.StructType(
    [T.StructField("path", T.StringType())]
    + [T.StructField(f, T.DoubleType() if f in _NUMBER else T.LongType() if f in _WHOLE else T.BooleanType() if f in _FLAG else T.StringType()) for f in FIELDS]
)


def parse_cards(data: bytes) -> tuple[dict[str, object], list[str], bool]:
    """Keywords of one header block sequence, its history lines and whether END was there."""
    cards: dict[str, object] = {}
    history: list[str] = []
    for i in range(0, len(data) - CARD + 1, CARD):
        card = data[i : i + CARD].decode("ascii", "replace")
        key = card[:8].strip()
        if key == "END":
            return cards, history, True
        if key == "HISTORY":
            history.append(card[8:].strip())
        elif card[8:10] == "= " and key:
            cards.setdefault(key, _value(card[10:]))
    return cards, history, False


def _value(text: str) -> object:
    text = text.strip()
    if text.startswith("'"):
        m = re.match(r"'((?:[^']|'')*)'", text)
        return (m[1] if m else text[1:]).replace("''", "'").rstrip()
    text = text.split("/", 1)[0].strip()
    if text in ("T", "F"):
        return text == "T"
    for kind in (int, float):
        try:
            return kind(text.replace("D", "E") if kind is float else text)
        except ValueError:
            pass
    return text or None


def fits_header(read: Callable[[int, int], bytes]) -> tuple[dict[str, object], list[str]]:
    """Keywords and history of the first image of a FITS file (NAXIS of 2 or more), else of the first header."""
    at, first = 0, None
    for _ in range(64):
        data, ended = b"", False
        while not ended and len(data) < BLOCK * MOST_BLOCKS:
            block = read(at + len(data), BLOCK)
            if not block:
                break
            data += block
            cards, history, ended = parse_cards(data)
        if not data or not ended and not parse_cards(data)[0]:
            break
        if first is None:
            if "SIMPLE" not in cards:
                raise ValueError("no FITS signature")
            first = cards, history
        if int(cards.get("NAXIS") or 0) >= 2:
            return cards, history
        size = abs(int(cards.get("BITPIX") or 8)) // 8
        for k in range(1, int(cards.get("NAXIS") or 0) + 1):
            size *= int(cards.get(f"NAXIS{k}") or 0)
        at += len(data) + (-(-size // BLOCK) * BLOCK if cards.get("NAXIS") else 0)
    if first is None:
        raise ValueError("no header")
    return first


def xisf_header(read: Callable[[int, int], bytes]) -> tuple[dict[str, object], list[str]]:
    """Keywords and history of an XISF file's first image; geometry becomes NAXIS1 and NAXIS2."""
    head = read(0, 16)
    if head[:8] != b"XISF0100":
        raise ValueError("no XISF signature")
    (length,) = struct.unpack("<I", head[8:12])
    root = ET.fromstring(read(16, length).split(b"\0", 1)[0])
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    image = next((e for e in root.iter() if local(e) == "Image"), None)
    if image is None:
        raise ValueError("no image")
    cards: dict[str, object] = {}
    history: list[str] = []
    for e in image.iter():
        if local(e) == "FITSKeyword":
            name, value = e.get("name", ""), e.get("value", "")
            if name == "HISTORY":
                history.append(e.get("comment") or value)
            else:
                cards.setdefault(name, _value(value))
        elif local(e) == "Property" and e.get("id") == "PixInsight:ProcessingHistory":
            history.append(e.text or e.get("value") or "")
    geometry = (image.get("geometry") or "").split(":")
    for i, n in enumerate(geometry[:2], 1):
        cards[f"NAXIS{i}"] = int(n)
    if len(geometry) > 2 and geometry[2] == "3":
        cards["NAXIS3"] = 3
    return cards, history


def _first(cards: dict[str, object], *keys: str) -> object:
    return next((cards[k] for k in keys if cards.get(k) not in (None, "")), None)


def _float(v: object) -> float | None:
    try:
        x = float(v)  # type: ignore[arg-type]
        return x if math.isfinite(x) else None
    except (TypeError, ValueError):
        return None


def _int(v: object) -> int | None:
    x = _float(v)
    return None if x is None else int(x)


STACKED = re.compile(r'numberOfImages(?:"\s+value="|\s*[:=]\s*)(\d+)', re.I)


def stack_depth(history: list[str]) -> int | None:
    """The last positive number of images that a history names; escaped XML is undone first."""
    import html

    found = [int(n) for line in history for n in STACKED.findall(html.unescape(line))]
    return next((n for n in reversed(found) if n > 0), None)


def solution(c: dict[str, object], n1: int, n2: int) -> dict[str, object]:
    """Centre, scale and rotation from a tangent-plane solution; empty if there is none."""
    ra0, dec0, p1, p2 = (_float(c.get(k)) for k in ("CRVAL1", "CRVAL2", "CRPIX1", "CRPIX2"))
    cd = [_float(c.get(k)) for k in ("CD1_1", "CD1_2", "CD2_1", "CD2_2")]
    if any(v is None for v in cd):
        d1, d2, rot = _float(c.get("CDELT1")), _float(c.get("CDELT2")), math.radians(_float(c.get("CROTA2")) or 0.0)
        if d1 is None or d2 is None:
            return {}
        cd = [d1 * math.cos(rot), -d2 * math.sin(rot), d1 * math.sin(rot), d2 * math.cos(rot)]
    if None in (ra0, dec0, p1, p2):
        return {}
    out: dict[str, object] = {}
    w, h = _int(c.get("IMAGEW")), _int(c.get("IMAGEH"))
    cx, cy = n1 / 2, n2 / 2
    if w and h and (w < n1 or h < n2):
        cx, cy = w / 2, h / 2
        out |= {"wcs_naxis1": w, "wcs_naxis2": h}

    def sky(x: float, y: float) -> tuple[float, float]:
        u, v = x - (p1 - 1), y - (p2 - 1)
        e, n = math.radians(cd[0] * u + cd[1] * v), math.radians(cd[2] * u + cd[3] * v)
        d = math.radians(dec0)
        down = math.cos(d) - n * math.sin(d)
        return math.radians(ra0) + math.atan2(e, down), math.atan2(math.sin(d) + n * math.cos(d), math.hypot(e, down))

    (a0, d0), (a1, d1) = sky(cx, cy), sky(cx, cy + 1)
    east = math.cos(d1) * math.sin(a1 - a0)
    north = math.cos(d0) * math.sin(d1) - math.sin(d0) * math.cos(d1) * math.cos(a1 - a0)
    rotation = round(math.degrees(math.atan2(east, north)) % 360, 2)
    scale = (math.hypot(cd[0], cd[2]) + math.hypot(cd[1], cd[3])) / 2 * 3600
    return out | {"ra_deg": math.degrees(a0) % 360, "dec_deg": math.degrees(d0), "rotation_deg": 0.0 if rotation >= 360 else rotation, "pix_arcsec": scale, "has_wcs": True}


def sexagesimal(text: object) -> float | None:
    parts = re.findall(r"[\d.]+", str(text))
    if not 1 <= len(parts) <= 3:
        return None
    v = sum(float(p) / 60**i for i, p in enumerate(parts))
    return -v if str(text).strip().startswith("-") else v


def header_row(cards: dict[str, object], history: list[str]) -> dict[str, object]:
    """One row from the keywords; the first keyword of several that has a value counts."""
    n1, n2 = _int(cards.get("NAXIS1")), _int(cards.get("NAXIS2"))
    depth = next((n for k in ("NCOMBINE", "STACKCNT", "NSTACKED", "NSUBS", "NIMAGES") if (n := _int(cards.get(k))) is not None), None)
    date = _first(cards, "DATE-OBS")
    row: dict[str, object] = {
        "raw_filter": _text(_first(cards, "FILTER", "FILTRE")), "exptime": _float(_first(cards, "EXPTIME", "EXPOSURE")) or None, "ncombine": depth if depth is not None else stack_depth(history),
        "naxis1": n1 or None, "naxis2": n2 or None, "date_obs": _text(date)[:19] if date else None, "date_obs_ms_raw": _text(date), "object": (_text(cards.get("OBJECT")) or "").strip() or None,
        "raw_telescope": _text(_first(cards, "TELESCOP", "INSTRUME")), "raw_camera": _text(cards.get("INSTRUME")), "creator": _text(cards.get("CREATOR")), "imagetyp": _text(_first(cards, "IMAGETYP", "OBSTYPE")),
        "colour": bool(str(_first(cards, "BAYERPAT", "COLORTYP") or "").strip()) or cards.get("NAXIS3") == 3, "gain": _float(cards.get("GAIN")), "offset": _float(cards.get("OFFSET")), "xbinning": _int(cards.get("XBINNING")),
        "aperture_mm": _positive(cards.get("APTDIA")), "ypixsz": _positive(_first(cards, "YPIXSZ", "PIXSIZE2")), "has_wcs": False, "ok": True, "error": None,
    }
    if n1 and n2 and "CRVAL1" in cards:
        row |= solution(cards, n1, n2)
    if not row["has_wcs"]:
        ra, dec = cards.get("OBJCTRA"), cards.get("OBJCTDEC")
        if ra and dec:
            a, d = sexagesimal(ra), sexagesimal(dec)
            if a is not None and d is not None:
                row |= {"ra_deg": a * 15, "dec_deg": d}
        else:
            a, d = cards.get("RA"), cards.get("DEC")
            if all(isinstance(v, int | float) and not isinstance(v, bool) for v in (a, d)) and 0 <= a < 360 and -90 <= d <= 90:
                row |= {"ra_deg": float(a), "dec_deg": float(d)}
    focal, pixel = _positive(cards.get("FOCALLEN")), _positive(_first(cards, "XPIXSZ", "PIXSIZE1"))
    if focal and pixel:
        row |= {"focallen": focal, "xpixsz": pixel, "pix_arcsec_focal": 206.265 * pixel / focal}
    return row


def _text(v: object) -> str | None:
    return None if v is None else str(v)


def _positive(v: object) -> float | None:
    x = _float(v)
    return x if x and x > 0 else None


def _open(path: str) -> tuple[Callable[[int, int], bytes], Callable[[], None]]:
    """A reader of byte ranges for a path or address that Arrow's file systems know."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    f = system.open_input_file(inner)
    return (lambda at, n: f.read_at(n, at)), f.close


def read_header(path: str) -> dict[str, object]:
    try:
        read, close = _open(path)
        try:
            return header_row(*(xisf_header if path.lower().endswith(".xisf") else fits_header)(read))
        finally:
            close()
    except Exception as e:
        return {"ok": False, "error": f"{type(e).__name__}: {e}"}


def list_files(spark: SparkSession, *roots: str) -> DataFrame:
    """path, size and mtime of the image files below the roots; contents are pruned from the scan. Files without a byte are not listed."""
    pattern = "*.{" + ",".join(e for x in EXTENSIONS for e in (x, x.upper())) + "}"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(list(roots))
    return df.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def read_headers(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row a file; spread over ``tasks`` since listings come in few partitions."""
    spread = files.repartition(tasks or files.sparkSession.sparkContext.defaultParallelism, "path")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"path": p} | read_header(p) for p in b["path"]]
            df = pd.DataFrame(rows, columns=SCHEMA.names).astype(object)
            for c in _WHOLE:
                df[c] = df[c].astype("Int64")
            for c in _NUMBER:
                df[c] = pd.to_numeric(df[c])
            yield df.where(df.notna(), None)

    return spread.select("path").mapInPandas(scan, SCHEMA)


def normalised(headers: DataFrame, sizes: DataFrame) -> DataFrame:
    """Headers with canonical names and the role of each file."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    camera = N.camera_name(F.col("raw_camera"))
    df = headers.join(sizes.select("path", "size"), "path").withColumns(
        {
            "telescope": N.telescope_name(F.col("raw_telescope")),
            "camera": camera,
            "object": F.coalesce("object", N.object_from_filename(stem)),
            "filter": N.smart_telescope_filter(N.canonical_filter(F.col("raw_filter")), F.col("creator"), F.col("raw_telescope")),
            "colour": F.col("colour") | F.coalesce(N.camera_is_colour(camera), F.lit(False)),
            "date_obs_ms": N.millisecond_stamp(F.col("date_obs_ms_raw")),
            "folder": N.parent_dir(F.col("path")),
        }
    )
    role = N.role_of(F.col("path"), F.col("imagetyp"), F.col("naxis1"), F.col("naxis2"), F.col("ncombine"), F.col("exptime"), F.col("object"), F.col("size"))
    return df.withColumn("role", F.when(F.col("ok"), role).otherwise("unreadable"))


def cached_headers(spark: SparkSession, files: DataFrame, cache: str | None, version: str) -> tuple[DataFrame, DataFrame]:
    """Headers of all files, read only where path, size, mtime or the reader's version are new; and the new cache.

    ``cache`` is a table written by an earlier run, or None. Files that are gone
    leave the cache; unreadable ones are tried again every time.
    """
    wanted = files.withColumn("version", F.lit(version))
    if cache is None:
        fresh = wanted.join(read_headers(files), "path")
        return fresh.select(SCHEMA.names), fresh.where("ok")
    old = spark.read.parquet(cache)
    hits = wanted.join(old, ["path", "size", "mtime", "version"])
    misses = wanted.join(old.select("path", "size", "mtime", "version"), ["path", "size", "mtime", "version"], "left_anti")
    fresh = misses.join(read_headers(misses.select("path")), "path")
    now = hits.unionByName(fresh.select(hits.columns))
    return now.select(SCHEMA.names), now.where("ok")


def folder_blocks(frames: DataFrame) -> DataFrame:
    """Folders of single exposures by filter and exposure: frames, hours, dates, distinct instants and a representative.

    Of a FITS and XISF pair of one stem the first by path counts; of frames with
    one capture instant to the millisecond, too. The representative is solved
    before placed before any.
    """
    usable = frames.where("ok and filter is not null and exptime > 0 and role in ('sub', 'calibrated_sub')")
    stem = F.regexp_replace("path", r"\.[^.]*$", "")
    one = usable.withColumn("stem", stem).groupBy("stem").agg(F.min_by(F.struct(*frames.columns), "path").alias("f")).select("f.*")
    keys = ["folder", "filter", F.round("exptime", 1).alias("exposure")]
    timed = one.where("date_obs_ms is not null").groupBy(*keys, "date_obs_ms").agg(F.min_by(F.struct(*frames.columns), "path").alias("f"))
    rest = one.where("date_obs_ms is null").select(*keys, F.lit(None).cast("string").alias("date_obs_ms"), F.struct(*frames.columns).alias("f"))
    rank = F.struct((~F.col("f.has_wcs")).alias("w"), F.col("f.ra_deg").isNull().alias("c"), F.col("f.path").alias("p"))
    return timed.unionByName(rest).groupBy("folder", "filter", "exposure").agg(
        F.count("*").alias("n_subs"), (F.sum("f.exptime") / 3600).alias("total_hours"), F.min("f.date_obs").alias("first_date_obs"), F.max("f.date_obs").alias("last_date_obs"),
        F.count("date_obs_ms").alias("instants"), F.min_by("f", rank).alias("representative"),
    )
