import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lumenfold.functions.text import folded
from lumenfold.operators import deliveries as D

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "delivery_id bigint, source string, key string, seq bigint, received_at timestamp, __row string, payload string"


def write(spark, tmp_path, rows, parts=3):
    at = str(tmp_path / "t.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(parts).write.parquet(at)
    return at


def identity():
    return {"source": folded("source"), "key": folded("key"), "seq": F.col("seq")}, {"r": F.col("received_at"), "d": F.col("delivery_id")}


def brute(rows):
    best = {}
    low = lambda x: None if x is None else x.strip(" \t").lower()
    for r in rows:
        k = (low(r[1]), low(r[2]), r[3])
        o = (r[4] is not None, r[4] or T0, r[0])
        if k not in best or o < best[k][0]:
            best[k] = (o, r[0])
    return {v[1] for v in best.values()}


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rows = [
        (i, rnd.choice(["a", " A\t", "b", None]), rnd.choice(["k", "K ", "l", None, ""]), rnd.choice([None, 1, 2]), rnd.choice([None, T0, T0 + dt.timedelta(seconds=rnd.randint(0, 3))]), "x", "p" * rnd.randint(0, 9))
        for i in range(300)
    ]
    at = write(spark, tmp_path, rows)
    ident, order = identity()
    kept = {r[0] for r in D.split_deliveries(spark, at, ident, order, ["delivery_id", "payload"]).collect()}
    gone = {r[0] for r in D.split_deliveries(spark, at, ident, order, ["delivery_id"], keep=False).collect()}
    assert kept == brute(rows)
    assert kept | gone == set(range(300)) and not kept & gone


def test_empty_table(spark, tmp_path):
    at = write(spark, tmp_path, [], 1)
    ident, order = identity()
    assert D.split_deliveries(spark, at, ident, order, ["delivery_id"], keep=False).count() == 0


def test_hot_key_and_many_rows_in_one_file(spark, tmp_path):
    # more rows than one bitmap covers, a third of them copies of one message
    n = 40_000
    df = spark.range(n).select(
        F.col("id").alias("delivery_id"), F.lit("s").alias("source"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), F.lit(1).cast("bigint").alias("seq"),
        F.timestamp_seconds(F.lit(1_700_000_000) - F.col("id") % 7).alias("received_at"), F.lit("c").alias("__row"), F.lit("w").alias("payload"),
    )
    at = str(tmp_path / "t.parquet")
    df.coalesce(1).write.parquet(at)
    ident, order = identity()
    kept = D.split_deliveries(spark, at, ident, order, ["delivery_id", "key"])
    assert kept.count() == n - n // 3 - (1 if n % 3 else 0) + 1
    hot = kept.where("key = 'hot'").collect()
    assert [r["delivery_id"] for r in hot] == [6]


def test_groups_of_bitmaps_beyond_the_bound(spark, tmp_path):
    rows = [(i, "s", str(i % 50), 1, T0, "x", "p") for i in range(200)]
    at = write(spark, tmp_path, rows, 8)
    ident, order = identity()
    narrow = D.positions(spark, at, {"i_k": folded("key"), "o_d": F.col("delivery_id")})
    bits = D.vectors(D.winners(narrow, ["i_k"], ["o_d"])).cache()
    for bound in (D.BITMAP_BYTES, 1):
        got = D.apply_vectors(D.positions(spark, at, {"delivery_id": "delivery_id"}), bits, True, bound)
        assert {r[0] for r in got.collect()} == set(range(50))
