import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tracewell.operators import order


@pytest.mark.parametrize("hot_rows", [5, 10**6])
def test_dense_index_is_the_same_with_and_without_buckets(spark, hot_rows):
    rng = random.Random(3)
    keys = rng.sample(range(10_000), 300)
    data = [("hot" if rng.random() < 0.7 else f"g{k % 5}", k) for k in keys]
    df = spark.createDataFrame(data, "g string, k long").repartition(5)
    got = {(r.g, r.k): r.i for r in order.dense_index(df, "i", ["g"], "k", width=50, hot_rows=hot_rows).collect()}
    want = {}
    for g in {g for g, _ in data}:
        want |= {(g, k): i for i, k in enumerate(sorted(k for h, k in data if h == g))}
    assert got == want


def test_running_before_sums_values(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(100)], "k long, v int")
    out = order.running_before(df, "s", ["k"], [order.key_range("k", 7)], value=F.col("v"))
    assert rows(out.select("k", "s")) == [(k, sum(i % 4 for i in range(k))) for k in range(100)]


def test_dictionary_ids_follow_first_sight(spark):
    words = "b a b c a d c".split()
    df = spark.createDataFrame(list(enumerate(words)), "i long, t string").repartition(3)
    d = order.first_seen_dictionary(df, "t", F.struct("i"), "id")
    assert rows(d) == [(0, "b"), (1, "a"), (2, "c"), (3, "d")]


def test_name_dictionary_orders_by_name(spark):
    words = ["é", "b", "ab", "aa", "", "z", "a"]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    assert [r[1] for r in rows(order.name_dictionary(df, "t", "id"), "id")] == sorted(words)


def test_halo_copies_only_border_rows(spark):
    df = spark.range(10).withColumnRenamed("id", "p")
    out = rows(order.with_halo(df, "p", 5, before=2, after=1).filter("not _own").select("_chunk", "p"))
    assert out == [(0, 5), (1, 3), (1, 4), (2, 8), (2, 9)]


def test_first_match_ignores_partitioning(spark):
    df = spark.createDataFrame([(5, "x", "late"), (1, "x", "early"), (3, "y", "only")], "o long, k string, v string")
    for n in (1, 3):
        out = order.first_match(df.repartition(n), ["k"], F.struct("o"), ["v"])
        assert rows(out) == [("x", "early"), ("y", "only")]


def test_small_side_is_bounded_in_rows_and_bytes(spark):
    from tracewell.session import small_side

    df = spark.createDataFrame([(i, "x" * 100) for i in range(50)], "k long, v string")
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(small_side(df))
    assert not hinted(small_side(df, max_rows=49))
    assert not hinted(small_side(df, max_bytes=1_000))
    assert hinted(small_side(df.limit(0)))
