"""The reference list of filters, and the rules by which its entries are written in other ways."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from lumenfold.llm.canon import Decoration, compact, fold

# fixed values: the words of this domain, in the languages of its users
WORDS = {
    "luminance": ("lum", "clear lum", "luminanz", "luminancia"),
    "red": ("rot", "rouge", "rojo"),
    "green": ("gr\u00fcn", "gruen", "vert", "verde"),
    "blue": ("blau", "bleu", "azul"),
    "methane": ("ch4", "methan", "metano"),
    "ultraviolet": ("uv",),
    "infrared": ("ir",),
}
ELEMENTS = {"h": ("hydrogen",), "he": ("helium",), "n": ("nitrogen",), "o": ("oxygen",), "s": ("sulphur", "sulfur")}
GREEK = {"a": ("alpha", "\u03b1"), "b": ("beta", "\u03b2")}
NUMERALS = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5"}
COUNTS = {"duo": "2", "tri": "3", "quad": "4"}

#: Slots, makers (one word before), passbands, cameras and purposes that are written beside a filter.
BESIDE = Decoration(
    prefixes=(r"\d+\s*:\s*", r"filter[ :]+(?=\D)", rf"(?!(?:{'|'.join(e for es in ELEMENTS.values() for e in es)})\b)[^\W\d_]{{3,}}\s+(?=\S)"),
    suffixes=(r"\s*\([^()]*\)", r"[\s-]*\d+(?:\.\d+)?\s*nm", r"[\s-]+(?:filter|stars|short|long)", r"\s+band"),
)


def spellings(name: str, long_name: str | None, kind: str | None, width_nm: float | None, lines: dict[str, str]) -> set[str]:
    """The ways, compact, in which an entry is written; ``lines`` gives the narrowband entry that an initial letter stands for.

    Its name and its long name; words of the domain for either; an ion as
    element and numeral, roman or not, a line as element and greek letter; a last
    numeral as roman or not; two words the other way round, the first one
    shortened; the number of bands as a word or a digit, with the width in nm;
    the lines for their initials.
    """
    plain = fold(name)
    texts = {plain}
    if long_name:
        whole = fold(long_name)
        short = re.sub(r"\band\b", " ", whole)
        for word, others in WORDS.items():
            for other in others:
                if re.search(rf"\b{word}\b", whole) and (whole == word or len(whole.split()) == 1):
                    texts.add(other)
            if len(short.split()) > 1:
                short = re.sub(rf"\b{word}\b", others[0], short)
        texts |= {whole, short}
    for word, others in WORDS.items():
        if plain == word:
            texts |= set(others)
        elif (swapped := re.sub(rf"\b{others[0]}\b", word, plain)) != plain and " " in plain:
            texts.add(swapped)
    if ion := re.fullmatch(rf"({'|'.join(sorted(ELEMENTS, key=len, reverse=True))})({'|'.join(NUMERALS)})", plain):
        symbol, numeral = ion.groups()
        texts |= {f"{e} {n}" for e in (symbol, *ELEMENTS[symbol]) for n in (numeral, NUMERALS[numeral])}
    if kind == "narrowband":
        texts |= {f"{t} band" for t in (plain, fold(long_name or "").split(" ")[0]) if len(t) > 4}
    if line := re.fullmatch(r"(h)([ab])", plain):
        texts |= {f"{e} {g}" for e in (line[1], *ELEMENTS[line[1]]) for g in GREEK[line[2]]}
    words = plain.split(" ")
    for roman, digit in NUMERALS.items():
        if len(words) > 1 and words[-1] == digit:
            texts.add(" ".join([*words[:-1], roman]))
    if len(words) == 2 and kind == "photometric":
        texts |= {f"{words[1]} {words[0]}", f"{words[0][:4]} {words[1]}"}
    for i, w in enumerate(words):
        if w in COUNTS:
            rest = [f"{words[-1]}nm"] if width_nm is not None and words[-1] == f"{width_nm:g}" else words[i + 1 :]
            texts |= {" ".join([*words[:i], bands, *rest]) for bands in (f"{w} band", f"{COUNTS[w]} band")}
    initials = name.split(" ")[-1]
    if kind == "dual" and initials.isupper() and all(c in lines for c in initials):
        texts.add(" ".join([*words[:-1], *(lines[c] for c in initials)]))
    return {compact(t) for t in texts}


def entries(canon: DataFrame) -> DataFrame:
    """Reference entries: the compact spellings of each canonical name with the id; of two entries with one spelling the first has it.

    The reference list is short by nature: it is read on the driver.
    """
    rows = canon.where("canon_name is not null").select("canon_id", "canon_name", "long_name", "kind", "width_nm").orderBy("canon_id").collect()
    lines: dict[str, str] = {}
    for r in rows:
        if r["kind"] == "narrowband":
            lines.setdefault(r["canon_name"][:1].upper(), r["canon_name"].lower())
    named = {compact(fold(r["canon_name"])): r["canon_id"] for r in reversed(rows)}
    for r in rows:
        for s in sorted(spellings(r["canon_name"], r["long_name"], r["kind"], r["width_nm"], lines)):
            named.setdefault(s, r["canon_id"])
    return canon.sparkSession.createDataFrame([(int(i), e) for e, i in named.items()], "canon_id bigint, entry string")
