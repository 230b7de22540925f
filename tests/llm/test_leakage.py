import random

import pytest

from lumenfold.llm import leakage as L


def brute(docs, items, window):
    found = set()
    for i, t in items:
        w = L.words_of(t)
        own = {tuple(w[k : k + window]) for k in range(len(w) - window + 1)}
        for d, text in docs:
            v = L.words_of(text)
            if d is not None and i is not None and any(tuple(v[k : k + window]) in own for k in range(len(v) - window + 1)):
                found.add((d, i))
    return found


def run(spark, docs, items, window=12, size=5):
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(*x, "clash") for x in items], "item_id bigint, item_text string, text string")
    return sorted(tuple(r) for r in L.leaks(d, i, window, size).collect())


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    vocabulary = ["a", "b", "c", "d", "Ä1", "e"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(rnd.randint(3, 14))) for i in range(25)]
    docs = [(i, text(rnd.randint(0, 60))) for i in range(60)]
    for k in range(20):
        w = L.words_of(rnd.choice(items)[1])
        docs.append((100 + k, text(5) + " ... " + rnd.choice([", ", "\n", " -- "]).join(w).upper() + " " + text(3)))
    assert run(spark, docs, items, 6, 3) == sorted(brute(docs, items, 6))


def test_edges(spark):
    twelve = "one two three four five six seven eight nine ten eleven twelve"
    item = (1, twelve + " thirteen")
    eleven = twelve.rsplit(" ", 1)[0]
    docs = [
        (1, twelve), (2, "x " + twelve.upper().replace(" ", "-") + "."), (3, eleven), (4, None), (5, ""), (6, eleven + " other " + twelve), (6, twelve), (7, twelve.replace("six", "six six")),
        (8, "filler " * 50_000 + twelve), (9, "two " + twelve[4:]), (None, twelve),
    ]
    got = run(spark, docs, [item, (1, item[1]), (2, eleven), (3, None), (4, ""), (None, twelve), (5, twelve)])
    assert got == [(d, i) for d in (1, 2, 6, 8) for i in (1, 5)]
    assert run(spark, docs, []) == [] and run(spark, [], [item]) == []


def test_texts_of_one_id_are_not_mixed(spark):
    first, second = "a b c d e f x x x x x x", "x x x x x x g h i j k l"
    assert run(spark, [(1, first), (1, second)], [(1, "a b c d e f g h i j k l")], 12, 3) == []
    assert run(spark, [(1, first), (1, first), (1, second)], [(1, "a b c d e f")], 6, 3) == [(1, 1)]


def test_items_in_parts(spark):
    rnd = random.Random(9)
    items = [(i, " ".join(str(rnd.randint(0, 3)) for _ in range(10))) for i in range(8)]
    docs = [(i, "x " + items[i % 8][1]) for i in range(16)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, item_text string")
    got = {(r["doc_id"], r["item_id"]) for r in L.leaked_windows(d, i, 6, 3, bound=60).collect()}
    assert got == brute(docs, items, 6)


def test_long_item_is_cut_into_parts(spark):
    rnd = random.Random(11)
    words = [str(rnd.randint(0, 99)) for _ in range(4000)]
    items = [(1, " ".join(words)), (2, " ".join(words[:30])), (3, None)]
    docs = [(k, "x " + " ".join(words[k * 13 : k * 13 + 12]) + " y") for k in range(200)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, item_text string")
    assert {(r["doc_id"], r["item_id"]) for r in L.leaked_windows(d, i, 12, 5, bound=4000).select("doc_id", "item_id").collect()} == brute(docs, [x for x in items if x[1]], 12)


def test_prefix_is_the_rarest_shingle():
    ix = L.ShingleIndex([(7, "a b c d e f"), (8, "a b c d e f"), (9, "b c d e f g")], 3, 6)
    ids = lambda text: L.np.array([ix.vocabulary.get(w, -1) for w in text.split()])
    at, number = ix.hits(ids("x a b c d e f x b c d"))
    assert at.tolist() == [1, 2, 3, 4, 8] and number[1] == number[4]
    counts = L.np.bincount(number, minlength=ix.shingles)
    ix.choose_prefixes(counts)
    # the window of item 9 has a shingle that is nowhere, so only one prefix is left, and it isn't the frequent one
    assert len(ix.prefix_windows) == 1 and ix.prefix_from[number[1]] == ix.prefix_from[number[1] + 1]
    start, window = ix.windows_in(ids("x a b c d e f x b c d"))
    assert start.tolist() == [1] and sorted(ix.items[ix.items_from[window[0]] : ix.items_from[window[0] + 1]].tolist()) == [7, 8]
