"""Pages of repeated keywords, links, tags or offers instead of sentences.

Two signals are measured round every word of a page. How its terms come back:
the gaps to the word's own recurrences, and the autocorrelation of positions
over all lags of a window, which is high only where a few terms return again
and again at unlike distances (a sentence that is said twice returns at one
lag only). And how bare it is: a list of many nouns without function words. A
word stands in stuffing if it is regular repetition, or part of a bare list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: function words of English, German, French and Spanish
FUNCTION_WORDS = """
the a an of and or to in on at for with by from is was are were be been it its this that these those i my me we our you your he she
they them his her their as but if so not no than then when while after before until into over under about what which who where why how
there here had has have do does did will would can could should may might must just only also very too more most some any each all both
other two once every up down out off between without because although though yet now still never always again
der die das und ist ein eine einen dem den des im in von zu zum zur mit auf für nicht ich es sich auch war wurde habe haben hat nach aus bei an am
als wie noch so dass was wenn aber oder sind waren mir mich sie er wir um durch über vor weil nur sehr
el la los las un una de del y en que no se por con para es fue al lo más pero como su sus mi me te han les porque sin sobre entre
muy ya hasta estaba está cuando
le la les des du et est une dans pour pas que qui sur avec au aux ce cette ne plus par mais ont il elle je nous était trop jusqu encore à sans
se son sa ses leur ou où
""".split()

#: Words and numbers; parts joined by a hyphen or underscore are one.
WORD = re.compile(r"[^\W_]+(?:[-_][^\W_]+)*")
NUMERIC = re.compile(r"^[\s\d.:+/TZ-]*\d[\s\d.:+/TZ-]*$")
HEADER = re.compile(r"^[A-Z][A-Z0-9_-]{0,8}\s*=")


@dataclass(frozen=True)
class Rules:
    """Parameters. ``lag``: words within which a term comes back; ``half``: words to either side that are measured with a word.

    A word is repetition if the autocorrelation over the lags reaches ``echo``,
    a share of ``back`` of the words round it come back, and at most
    ``sentence`` of them are function words. It is in a bare list if at most
    ``bare`` of them are. Without ``function_words`` only repetition counts. A
    page counts if more than ``share`` of its words, and ``least_words`` at
    least, stand in stuffing.
    """

    lag: int = 24
    half: int = 16
    echo: float = 0.05
    back: float = 0.4
    sentence: float = 0.3
    bare: float = 0.17
    share: float = 0.5
    least_words: int = 20
    function_words: frozenset[str] = frozenset(FUNCTION_WORDS)


def _is_record(line: str) -> bool:
    """A line of a table or a header: data that was written down, not a list of keywords."""
    if HEADER.match(line):
        return True
    fields = re.split(r"[,;\t|]", line)
    return len(fields) >= 3 and sum(bool(NUMERIC.match(f)) for f in fields) >= 2


def terms_of(text: str) -> tuple[list[str], int]:
    """The words of a page in order, and the number of further words that stand in records."""
    words: list[str] = []
    records = 0
    for line in text.split("\n"):
        found = WORD.findall(line.lower())
        if found and _is_record(line):
            records += len(found)
        else:
            words += found
    return words, records


def _around(x: np.ndarray, half: int) -> np.ndarray:
    """Sum of ``x`` over the places up to ``half`` away, at each place."""
    n = len(x)
    sums = np.concatenate([[0], np.cumsum(x)])
    at = np.arange(n)
    return sums[np.minimum(at + half + 1, n)] - sums[np.maximum(at - half, 0)]


def returns(words: list[str], lag: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word, how many of the ``lag`` words before are the same term, and whether the gap to its next or last recurrence is within ``lag``."""
    n = len(words)
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    order = np.argsort(ids, kind="stable")
    key = ids[order] * (n + lag + 1) + order
    before = np.empty(n, np.int64)
    before[order] = np.arange(n) - np.searchsorted(key, key - lag)
    close = np.diff(key) <= lag
    back = np.zeros(n, bool)
    back[order[1:][close]] = True
    back[order[:-1][close]] = True
    return before, back


@dataclass(frozen=True)
class Found:
    """Shares of all words: in stuffing, in repetition, in bare lists; the mean autocorrelation, recurrence and function words."""

    share: float
    repeated: float
    bare: float
    echo: float
    back: float
    function: float
    words: int


def judge(text: str | None, rules: Rules = Rules()) -> Found | None:
    """What was measured on a page; None if it has too few words, or only records."""
    if not text:
        return None
    words, records = terms_of(text)
    n, total = len(words), len(words) + records
    if total < rules.least_words or not n:
        return None
    before, back = returns(words, rules.lag)
    lags = np.minimum(np.arange(n), rules.lag)
    size = _around(np.ones(n), rules.half)
    echo = _around(before, rules.half) / np.maximum(_around(lags, rules.half), 1)
    again = _around(back, rules.half) / size
    plain = np.fromiter((w in rules.function_words for w in words), bool, n)
    function = _around(plain, rules.half) / size
    repeated = (echo >= rules.echo) & (again >= rules.back) & (function <= rules.sentence)
    bare = (function <= rules.bare) if rules.function_words else np.zeros(n, bool)
    stuffed = int((repeated | bare).sum())
    return Found(stuffed / total, float(repeated.sum() / total), float(bare.sum() / total), float(before.sum() / max(lags.sum(), 1)), float(back.mean()), float(plain.mean()), stuffed)


def is_stuffed(found: Found | None, rules: Rules = Rules()) -> bool:
    return found is not None and found.share > rules.share and found.words >= rules.least_words


SCHEMA = "doc_id bigint, stuffed_share double, repeated_share double, bare_share double, echo double, recurring double, function_share double"


def stuffed_pages(documents: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id and the measures of each page that is keywords, links, tags or offers rather than sentences.

    Each whole text is read once, without a shuffle. Null, empty and very short
    texts are no cases; lines of tables and headers count as words but never as
    keywords. Repeated rows give repeated results; other columns are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            rows = [(d, m.share, m.repeated, m.bare, m.echo, m.back, m.function) for d, t in zip(b.column(0).to_pylist(), b.column(1)) if is_stuffed(m := judge(t.as_py(), rules), rules)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    return documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(scan, SCHEMA)
