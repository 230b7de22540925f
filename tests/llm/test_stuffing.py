import random

import numpy as np

from lumenfold.llm import stuffing as K

PROSE = "The guide log has a spike every few minutes that matches the worm period of the mount, so I cleaned the gears and it was gone by the end of the night. "
NAMES = ["Wolden 70", "Trine CEM", "dust cap", "filter wheel", "Pellin 533", "luminance", "Nadira C9"]


def lists(rnd, sep, n=60):
    return sep.join(rnd.choice(["", "buy ", "cheap "]) + rnd.choice(NAMES) for _ in range(n))


def case(text):
    return K.is_stuffed(K.judge(text))


def test_spam_of_each_kind():
    rnd = random.Random(0)
    for sep in (", ", " | ", "\n", " / ", " "):
        assert case(lists(rnd, sep))
    assert case("\n".join(f"- [{rnd.choice(NAMES)}](https://shop.example/{i}-deal)" for i in range(30)))
    assert case(" ".join(f"#{rnd.choice(NAMES).replace(' ', '_')}" for _ in range(60)))
    assert case(" ; ".join(f"sale {rnd.choice(NAMES)} EUR {i}.99 add to cart" for i in range(40)))
    assert case(PROSE + "\n" + lists(rnd, ", ", 120))


def test_honest_pages():
    rnd = random.Random(1)
    assert not case(PROSE * 5)
    assert not case("date,target,filter,subs,hfr\n" + "\n".join(f"2024-01-{i:02d},Orm {i},Ha,{i * 3},2.1" for i in range(1, 30)))
    assert not case("SIMPLE  =                    T\n" + "\n".join(f"GAIN    = {i} / camera gain" for i in range(40)))
    assert not case("\n".join(f"{n}: {PROSE}" for n in NAMES))
    assert not case("\n".join(f"https://site.example/{i} explains this well. {PROSE}" for i in range(8)))
    assert not case(PROSE * 8 + "\n" + lists(rnd, ", ", 20))
    for short in (None, "", "   ", "ok", "buy Wolden 70"):
        assert not case(short)


def test_repetition_decides_without_function_words():
    """With an empty word list recurrence and autocorrelation alone find the pages of repeated keywords, and take no sentences for them."""
    rnd = random.Random(4)
    bare = K.Rules(function_words=frozenset())
    stuffed = lambda text: K.is_stuffed(K.judge(text, bare), bare)
    places = ["Sandalwick", "Pellmoor", "Lower Asp", "Tarn Hollow", "Old Quarry", "Cold Fen", "Brackwater", "Merrin Lake"]
    pages = [lists(rnd, sep, 80) for sep in (", ", " | ", "\n", " / ", " ") for _ in range(8)]
    pages += [sep.join(rnd.choice(["dew strap in {}", "{} dew strap", "buy dew strap {}"]).format(rnd.choice(places)) for _ in range(50)) for sep in (", ", "\n", ". ") for _ in range(8)]
    assert sum(map(stuffed, pages)) >= 0.95 * len(pages)
    sentences = [PROSE, "Whoever sets the offset by hand has to write it down, because no header keeps it. ", "Three panels were shot before clouds came in from the west and ended the session. ", "A longer dither settled every walking pattern that my old stacks had shown. "]
    assert not any(stuffed("".join(rnd.choice(sentences) for _ in range(rnd.randint(3, 12)))) for _ in range(40))


def test_returns_against_plain_loops():
    rnd = random.Random(5)
    for _ in range(30):
        words = [rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 60))]
        lag = rnd.randint(1, 12)
        before, back = K.returns(words, lag)
        assert before.tolist() == [words[max(0, i - lag) : i].count(w) for i, w in enumerate(words)]
        assert back.tolist() == [w in words[max(0, i - lag) : i] + words[i + 1 : i + 1 + lag] for i, w in enumerate(words)]
        half = rnd.randint(0, 9)
        x = [rnd.random() for _ in words]
        got = K._around(np.array(x), half).tolist()
        assert all(abs(g - sum(x[max(0, i - half) : i + half + 1])) < 1e-9 for i, g in enumerate(got))


def test_frame(spark):
    rnd = random.Random(3)
    rows = [(1, lists(rnd, ", "), "x"), (2, PROSE * 3, "x"), (3, None, None), (None, lists(rnd, ", "), None), (4, lists(rnd, " ", 30_000), "long"), (5, "x" * 200_000, "long")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, marks string")
    assert sorted(r["doc_id"] for r in K.stuffed_pages(df).collect()) == [1, 4]
    assert K.stuffed_pages(df.where("false")).count() == 0
