"""Evaluation passages inside a training corpus: a prefix-filtered set join with exact verification.

An item's windows are its runs of ``window`` consecutive words. A document holds
a window only if it holds every shingle of it, so it is enough to look where
the window's rarest shingle occurs: its prefix. One narrow pass counts the
shingles over all documents and brings back one number a shingle; the second
looks at the prefixes alone, and compares the whole window there, word by word.
No document leaves its task in either.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.session import cut

#: Bytes of item text that one pair of scans works off; its index takes about eight times as much in every task.
ITEM_BYTES = 24 << 20

#: Words after which the documents read so far are looked at together.
CHUNK_WORDS = 200_000

#: Runs of letters and digits; everything else only separates.
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class ShingleIndex:
    """The items' words, shingles and windows by exact word sequence, each with a number; holds no document."""

    def __init__(self, items: list[tuple[int, str]], size: int, window: int) -> None:
        self.size, self.window = size, window
        self.vocabulary: dict[str, int] = {}
        words: list[int] = []
        owner, held = [], []
        for item, text in items:
            ws = words_of(text)
            words += [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]
            words.append(-1)
            owner.append(item)
            held.append(len(ws) + 1)
        self.words = np.array(words, np.int64)
        self.base = len(self.vocabulary) + 1
        # a sequence of words becomes one number step by step: each step numbers the pairs (number so far, next word)
        self.steps: list[np.ndarray] = []
        at = self._runs(size)
        number = self.words[at]
        for depth in range(1, size):
            codes, number = np.unique(number * self.base + self.words[at + depth], return_inverse=True)
            self.steps.append(codes)
        self.shingles = int(number.max()) + 1 if len(number) else 0
        shingle_at = np.full(len(self.words), -1, np.int64)
        shingle_at[at] = number
        # equal windows are one; each belongs to all items that have it
        at = self._runs(window)
        number = shingle_at[at]
        for depth in range(size, window):
            number = np.unique(number * self.base + self.words[at + depth], return_inverse=True)[1]
        _, first, number = np.unique(number, return_index=True, return_inverse=True)
        self.place = at[first]  # where the items' words have each window
        item = np.repeat(np.array(owner, np.int64), held)[at]
        pairs = np.unique(np.stack([number, item], 1), axis=0) if len(at) else np.empty((0, 2), np.int64)
        self.items = pairs[:, 1]
        self.items_from = np.searchsorted(pairs[:, 0], np.arange(len(self.place) + 1))
        self.window_shingles = shingle_at[self.place[:, None] + np.arange(window - size + 1)] if len(at) else np.empty((0, window - size + 1), np.int64)

    def _runs(self, n: int) -> np.ndarray:
        """Where ``n`` words of one item begin."""
        if len(self.words) < n:
            return np.empty(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(self.words < 0)])
        return np.flatnonzero(ends[n:] == ends[:-n])

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and numbers of the items' shingles in words that were numbered by the vocabulary (-1: another word, or an end): exact, without hashing."""
        n = len(ids) - self.size + 1
        if n <= 0 or not self.shingles:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.flatnonzero(ids[:n] >= 0)
        number = ids[at]
        for depth, codes in enumerate(self.steps, 1):
            nxt = ids[at + depth]
            code = np.where(nxt >= 0, number * self.base + nxt, -1)
            number = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            ok = codes[number] == code
            at, number = at[ok], number[ok]
        return at, number

    def choose_prefixes(self, counts: np.ndarray) -> None:
        """Take each window's rarest shingle for its prefix, ties by number; a window with a shingle that no document holds has none."""
        order = np.lexsort((np.arange(self.shingles), counts))
        rank = np.empty(self.shingles, np.int64)
        rank[order] = np.arange(self.shingles)
        ranks = rank[self.window_shingles]
        offset = ranks.argmin(1) if len(ranks) else np.empty(0, np.int64)
        prefix = self.window_shingles[np.arange(len(offset)), offset]
        live = np.flatnonzero(counts[prefix] > 0)
        by = live[np.argsort(prefix[live], kind="stable")]
        self.prefix_windows, self.prefix_offsets = by, offset[by]
        self.prefix_from = np.searchsorted(prefix[by], np.arange(self.shingles + 1))
        self.window_shingles = None

    def windows_in(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of every whole window in numbered words: places of prefixes, bounds, then all words compared."""
        at, shingle = self.hits(ids)
        start, window = _spread(self.prefix_from, shingle, self.prefix_windows)
        begins = at[start] - _spread(self.prefix_from, shingle, self.prefix_offsets)[1]
        inside = (begins >= 0) & (begins + self.window <= len(ids))
        begins, window = begins[inside], window[inside]
        steps = np.arange(self.window)
        whole = (ids[begins[:, None] + steps] == self.words[self.place[window][:, None] + steps]).all(1)
        return begins[whole], window[whole]


def _spread(starts: np.ndarray, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key the values of its group, and which key each belongs to."""
    sizes = starts[keys + 1] - starts[keys]
    which = np.repeat(np.arange(len(keys)), sizes)
    within = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return which, values[starts[keys][which] + within]


def _chunks(batches: Iterator[pa.RecordBatch], vocabulary: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents (their ids, and where each begins) and their words as numbers, an end after each document, some documents at a time."""
    docs, sizes, words = [], [], []

    def numbered() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return np.array(docs, np.int64), begins, np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int64, len(words))

    for b in batches:
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
            ws = words_of(text.as_py())
            docs.append(doc)
            sizes.append(len(ws) + 1)
            words += ws
            words.append("")
            if len(words) >= CHUNK_WORDS:
                yield numbered()
                docs, sizes, words = [], [], []
    if docs:
        yield numbered()


def shingle_counts(documents: DataFrame, index: ShingleIndex) -> np.ndarray:
    """How often each shingle of the items occurs in all documents; counted in the tasks, one number a shingle comes back."""
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        seen = np.zeros(ix.shingles, np.int64)
        for _, _, ids in _chunks(batches, ix.vocabulary):
            seen += np.bincount(ix.hits(ids)[1], minlength=ix.shingles)
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(seen[found])], names=["shingle", "n"])

    table = documents.mapInArrow(scan, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(index.shingles, np.int64)
    counts[table["shingle"].to_numpy()] = table["n"].to_numpy()
    shared.unpersist()
    return counts


def segments(items: DataFrame, window: int, most: int) -> DataFrame:
    """Items with long ones cut into segments of at most ``most`` words that share ``window - 1`` words, so that every window is in one."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = [], []
            for item, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = words_of(text.as_py())
                for k in range(0, max(1, len(words) - window + 1), most):
                    ids.append(item)
                    texts.append(" ".join(words[k : k + most + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["item_id", "item_text"])

    return items.where("item_id is not null and item_text is not null").select(F.col("item_id").cast("bigint"), "item_text").mapInArrow(split, "item_id bigint, item_text string")


def leaked_windows(documents: DataFrame, items: DataFrame, window: int = 12, size: int = 5, bound: int = ITEM_BYTES) -> DataFrame:
    """doc_id, item_id and start (in words) of every window of an item that a document holds.

    ``items`` (item_id, item_text) is a held-out set. Its text is measured:
    within ``bound`` bytes all items go to every task at once; beyond it, parts
    of about that size do one after the other, each by scans of its own, and no
    item is too long for a part. Items of fewer than ``window`` words have no
    window. Null or empty texts hold nothing. Items or documents repeated under
    one id give their rows again. Other columns are ignored.
    """
    total = items.agg(F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // bound))
    pieces = segments(items, window, max(bound // 256, 1))
    if parts > 1:
        pieces = cut(pieces.withColumn("part", F.pmod(F.xxhash64("item_id", "item_text"), F.lit(parts))))
    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = []
    for k in range(parts):
        mine = (pieces.where(F.col("part") == k) if parts > 1 else pieces).select("item_id", "item_text").collect()
        found.append(_leaked(texts, ShingleIndex([tuple(r) for r in mine], size, window)))
    return reduce(DataFrame.unionByName, found)


def _leaked(texts: DataFrame, index: ShingleIndex) -> DataFrame:
    index.choose_prefixes(shingle_counts(texts, index) if index.shingles else np.zeros(0, np.int64))
    shared = texts.sparkSession.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for docs, begins, ids in _chunks(batches, ix.vocabulary):
            start, window = ix.windows_in(ids)
            which, item = _spread(ix.items_from, window, ix.items)
            start = start[which]
            doc = np.searchsorted(begins, start, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(docs[doc]), pa.array(item), pa.array(start - begins[doc])], names=["doc_id", "item_id", "start"])

    return texts.mapInArrow(scan, "doc_id bigint, item_id bigint, start bigint")


def leaks(documents: DataFrame, items: DataFrame, window: int = 12, size: int = 5) -> DataFrame:
    """doc_id and item_id of each document that holds ``window`` consecutive words of an item."""
    return leaked_windows(documents, items, window, size).select("doc_id", "item_id").distinct()
