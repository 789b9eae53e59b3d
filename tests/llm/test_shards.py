from collections import defaultdict

import pytest

from tracewell.llm import shards


def check(rows, n):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) <= set(range(n))
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    return {k: sum(r.size for r in part) for k, part in by.items()}


@pytest.mark.parametrize("n", [1, 3, 8])
def test_sizes_are_near_equal_and_small_groups_stay_whole(spark, n):
    texts = [f"text {i % 1500} " + "x" * (i % 97) for i in range(4000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = shards.shard(docs, n).collect()
    assert len(out) == 4000
    sizes = check(out, n)
    mean = sum(sizes.values()) / n
    assert all(abs(s - mean) <= 0.011 * mean + 120 for s in sizes.values())
    split = defaultdict(set)
    for r in out:
        split[r.text].add(r.shard)
    assert sum(len(s) > 1 for s in split.values()) < n
    again = shards.shard(docs.repartition(7), n).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in out} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_hot_group_is_split(spark):
    rows = [(i, "copy" * 10 if i % 2 else f"own {i} " + "y" * 30) for i in range(3000)]
    sizes = check(shards.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect(), 8)
    assert max(sizes.values()) < 1.03 * min(sizes.values())


def test_odd_tables(spark):
    rows = [(None, None, "a"), (None, None, "a"), (1, "", "b"), (1, "z" * 100_000, None), (1, "é", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = shards.shard(docs).collect()
    assert sorted(r.size for r in out) == [1, 1, 1, 3, 100_001]
    check(out, 8)
    assert shards.shard(docs.limit(0)).collect() == []
