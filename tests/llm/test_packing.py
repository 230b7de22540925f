import random

import pytest

from lumenfold.llm import packing as P
from lumenfold.llm.queries import VOCABULARY


def item_by_item(lengths, size):
    """Best-fit decreasing, one item at a time, into bins of one size."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if b[1] >= n]
        if fit:
            b = min(fit, key=lambda b: b[1])
        else:
            b = [size, size]
            bins.append(b)
        b[1] -= n
    return sorted(s - room for s, room in bins)


@pytest.mark.parametrize("seed", range(60))
def test_layout(seed):
    rnd = random.Random(seed)
    sizes = rnd.choice([[16], [8, 16, 32], [10, 30]])
    lengths = [rnd.randint(1, max(sizes)) if rnd.random() < 0.5 else rnd.choice([3, 7]) for _ in range(rnd.randint(1, 80))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    runs, groups = P.layout(histogram, sizes)
    held = {}
    for r in runs:
        for k in range(r.n):
            held.setdefault(r.bin + k // r.each, []).append((r.offset + k % r.each * r.length, r.length))
    assert sorted(n for v in held.values() for _, n in v) == sorted(lengths)
    fills = sorted(g.room for g in groups for _ in range(g.n))
    assert fills == sorted(sum(n for _, n in v) for v in held.values())
    for v in held.values():
        end = 0
        for offset, n in sorted(v):
            assert offset == end
            end = offset + n
    for g in groups:
        assert g.room <= g.size and g.size == min(s for s in sizes if s >= g.room)
    if len(sizes) == 1:
        assert fills == item_by_item(lengths, sizes[0])
    # no two bins could have been one
    assert all(a + b > max(sizes) for a, b in zip(fills, fills[1:])) or len(fills) < 3 or len(sizes) > 1


def lognormal(n, seed=1, most=8192):
    rnd = random.Random(seed)
    out = {}
    for _ in range(n):
        k = min(most, max(1, int(rnd.lognormvariate(5.5, 1.5))))
        out[k] = out.get(k, 0) + 1
    return out


def test_sizes_are_used_jointly():
    """All sizes are used, and the whole costs less than any mix of fewer and than bins of one size."""
    sizes = (2048, 4096, 8192)
    histogram = lognormal(20_000)
    every = P.mixes(histogram, sizes)
    assert set(every) == {(8192,), (2048, 8192), (4096, 8192), sizes}
    runs, groups = P.cheapest(histogram, sizes)
    by_size = {s: sum(g.n for g in groups if g.size == s) for s in sizes}
    assert all(by_size.values())
    total = sum(n * P.attention_cost(s) for s, n in by_size.items())
    assert total == min(t for t, *_ in every.values()) and total < 0.9 * every[(8192,)][0]
    tokens = sum(k * n for k, n in histogram.items())
    assert tokens / sum(s * n for s, n in by_size.items()) > 0.98


def test_large_bins_where_small_ones_waste():
    """Items just over half of a small bin: the large one wastes less, and is opened although it costs more a token of room."""
    _, groups = P.cheapest({1100: 7000}, (2048, 8192))
    assert {g.size for g in groups} == {8192} and sum(g.n for g in groups) == 1000
    _, groups = P.cheapest({2000: 7000}, (2048, 8192))
    assert {g.size for g in groups} == {2048}
    assert P.cheapest({}, (2048, 8192)) == ([], [])


def check(spark, counts, sizes):
    rows = P.pack(spark.createDataFrame(counts, "id bigint, tokens bigint"), sizes).collect()
    by_id, by_bin = {}, {}
    for r in rows:
        by_id.setdefault(r["id"], []).append((r["start"], r["length"]))
        by_bin.setdefault(r["bin"], []).append((r["offset"], r["length"], r["capacity"], r["filled"]))
    for i, n in counts:
        if n:
            end = 0
            for start, length in sorted(by_id[i]):
                assert start == end
                end += length
            assert end == n
            if n <= max(sizes):
                assert len(by_id[i]) == 1
        else:
            assert i not in by_id
    for v in by_bin.values():
        end = 0
        for offset, length, capacity, filled in sorted(v):
            assert offset == end and capacity in sizes and filled <= capacity
            end += length
        assert end == v[0][3]
    return rows


def test_pack_round_trip(spark):
    rnd = random.Random(5)
    counts = [(i, rnd.choice([0, 1, 5, 5, 5, rnd.randint(1, 100), 1000])) for i in range(500)]
    rows = check(spark, counts, (32, 64, 128))
    used = sum(n for _, n in counts)
    assert used / sum({r["bin"]: r["capacity"] for r in rows}.values()) > 0.98


def test_hot_length_empty_and_huge(spark):
    check(spark, [(i, 7) for i in range(3000)], (16, 64))
    check(spark, [(1, 100_000)], (2048, 4096))
    assert check(spark, [], (16,)) == []
    assert check(spark, [(1, 0), (2, 0)], (16,)) == []


def test_ranks_are_dense_within_each_length(spark):
    df = spark.createDataFrame([(i, 0, i % 3) for i in range(500)], "id bigint, piece int, length bigint")
    got = {}
    for r in P.ranked(df, shards=5).collect():
        got.setdefault(r["length"], []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values()) and len(got) == 3


def test_token_counts(spark):
    encode = P._encoder(open(VOCABULARY, "rb").read())
    texts = ["", "Hello world", "<|endoftext|>", "é" * 5000, "a" * 120_000, None, "x y\n" * 1000]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id bigint, text string, tokens int")
    got = {r["id"]: r["tokens"] for r in P.token_counts(df, VOCABULARY).collect()}
    assert got == {i: len(encode(t)) if t else 0 for i, t in enumerate(texts)}
    assert got[2] > 1
