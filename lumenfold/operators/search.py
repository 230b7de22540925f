"""The search language of the target list: text, phrases, ``key:value``, comparisons, negation; all must hold."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: keys that take a value or a comparison
VALUE_KEYS = ("object", "name", "filter", "telescope", "tel", "camera", "cam", "class", "tag")
NUMBER_KEYS = ("hours", "fov")

_TOKEN = re.compile(r'-?(?:[A-Za-z]+:"[^"]*"|[A-Za-z]+[:<>][^\s]+|"[^"]*"|\S+)')


@dataclass(frozen=True)
class Token:
    kind: str
    value: str | float
    key: str = ""
    op: str = ""
    negate: bool = False


def parse(query: str | None) -> list[Token]:
    """Tokens of a query; what no rule knows is plain text."""
    out = []
    for raw in _TOKEN.findall(query or ""):
        negate = raw.startswith("-") and len(raw) > 1
        body = raw[1:] if negate else raw
        if (m := re.fullmatch(r"([A-Za-z]+)([<>])(.+)", body)) and m[1].lower() in NUMBER_KEYS:
            number = re.match(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", m[3])
            if number and math.isfinite(float(number[0])):
                out.append(Token("number", float(number[0]), m[1].lower(), m[2], negate))
                continue
        if (m := re.fullmatch(r"([A-Za-z]+):(.*)", body)) and m[1].lower() in VALUE_KEYS:
            value = m[2][1:-1] if len(m[2]) >= 2 and m[2][0] == m[2][-1] == '"' else m[2]
            if value:
                out.append(Token("value", value.lower(), m[1].lower(), "", negate))
            continue
        value = body[1:-1] if len(body) >= 2 and body[0] == body[-1] == '"' else body
        if value:
            out.append(Token("text", value.lower(), "", "", negate))
    return out


def _any_has(column: str, text: str) -> Column:
    return F.coalesce(F.exists(column, lambda x: F.lower(x).contains(text)), F.lit(False))


def total_hours(filters: str = "filters") -> Column:
    return F.coalesce(F.aggregate(F.map_values(filters), F.lit(0.0), lambda acc, f: acc + F.coalesce(f["total_hours"], F.lit(0.0))), F.lit(0.0))


def target_matches(query: str | None) -> Column:
    """Predicate over objects, telescopes, cameras, filters (map) and fov_arcmin; keys of other lists are neutral."""

    def one(t: Token) -> Column:
        if t.kind == "text":
            hit = reduce(lambda a, b: a | b, (_any_has(c, t.value) for c in ("objects", "telescopes", "cameras")))
        elif t.kind == "number":
            left = F.coalesce(F.array_max("fov_arcmin"), F.lit(0.0)) if t.key == "fov" else total_hours()
            hit = left > t.value if t.op == ">" else left < t.value
        elif t.key in ("object", "name"):
            hit = _any_has("objects", t.value)
        elif t.key in ("telescope", "tel"):
            hit = _any_has("telescopes", t.value)
        elif t.key in ("camera", "cam"):
            hit = _any_has("cameras", t.value)
        elif t.key == "filter":
            hit = F.coalesce(F.exists(F.map_entries("filters"), lambda e: (F.lower(e["key"]) == t.value) & (e["value"]["total_hours"] > 0)), F.lit(False))
        else:
            return F.lit(True) if not t.negate else F.lit(False)
        return ~hit if t.negate else hit

    return reduce(lambda a, b: a & b, map(one, parse(query)), F.lit(True))


def object_matches(query: str | None) -> Column:
    """Predicate over a catalogue's name, category and tags."""
    name, category = F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("category", F.lit("")))

    def one(t: Token) -> Column:
        if t.kind == "text" or t.key in ("name", "object"):
            hit = name.contains(t.value)
        elif t.key == "class":
            hit = category == t.value
        elif t.key == "tag":
            hit = F.coalesce(F.exists("tags", lambda x: F.lower(x) == t.value), F.lit(False))
        else:
            hit = F.lit(True)
        return ~hit if t.negate else hit

    return reduce(lambda a, b: a & b, map(one, parse(query)), F.lit(True))


def chip_matches(chips: list[str], logic: str, least_hours: float) -> Column:
    """Filter chips: any or all of them deep enough, or one band without the other."""
    hours = lambda f: F.coalesce(F.try_element_at("filters", F.lit(f))["total_hours"], F.lit(0.0))
    if logic == "any":
        return reduce(lambda a, b: a | b, (hours(c) >= least_hours for c in chips), F.lit(False))
    if logic == "all":
        return reduce(lambda a, b: a & b, (hours(c) >= least_hours for c in chips), F.lit(True))
    if logic == "ha_not_sii":
        return (hours("Ha") > 0) & ~(hours("SII") > 0)
    return F.lit(True)


def natural_key(name: Column) -> Column:
    """Sort key under which numbers in names compare by value: digits without leading zeros, after their count."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda p: F.regexp_replace(p, "^0+", "")
    # a count of ten digits holds any length of a text
    number = lambda p: F.concat(F.lpad(F.length(digits(p)).cast("string"), 10, "0"), digits(p))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), number(p)).otherwise(p)), "")
