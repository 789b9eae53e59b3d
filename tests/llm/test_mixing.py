from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracewell.llm import mixing
from tracewell.llm.common import n_words, words


def test_targets_reshare_what_passes_the_limit():
    assert mixing.targets([100, 100, 100], [1, 1, 1], 1.5, 2) == [150, 150, 150]
    assert mixing.targets([10, 1000, 1000], [3, 1, 2], 1.5, 2) == pytest.approx([20, 3015 / 3 - 20 / 3, 2 * (3015 - 20) / 3], abs=1)
    assert mixing.targets([0, 10], [3, 1], 1.5, 2) == pytest.approx([0, 15])


def test_word_rule(spark):
    texts = ["", " ", "a", " a\tb\x0bc\x0cd\r\n", "a\xa0b", "  x  "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select(n_words(F.col("text")), F.size(words(F.col("text")))).collect()
    assert [tuple(r) for r in got] == [(0, 0), (0, 0), (1, 1), (4, 4), (1, 1), (1, 1)]


def rows():
    out = []
    for i in range(3000):
        source = None if i % 50 == 0 else f"s{i % 7}" if i % 3 else "hot"
        out.append((i, "w " * (i * 7919 % 90), source, "x", 1))
    return [*out, (0, "big " * 20_000, "s1", "x", 1), (None, None, "s2", "x", 1), (7, "a b", "é", "x", 1)] * 2


@pytest.mark.parametrize("weighted", [False, True])
def test_mix_meets_targets_as_a_plain_sample_does(spark, weighted):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string, cut string, target int")
    weight = 1.0 + F.coalesce(F.col("doc_id"), F.lit(0)) % 3 if weighted else None
    out = mixing.mix(docs, weight=weight).collect()
    again = mixing.mix(docs.repartition(5), weight=weight).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    by = defaultdict(list)
    for r in out:
        assert 0 <= r.copies <= 2
        assert r.size == len((r.text or "").split())
        by[r.source].append(r)
    sources = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r.size for r in by[s]) for s in sources]
    goal = mixing.targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(sources))], 1.5, 2)
    for s, size, target in zip(sources, sizes, goal, strict=True):
        assert {(r.source_size, r.target) for r in by[s]} == {(size, target)}
        taken = sum(r.copies * r.size for r in by[s])
        # rows come in identical pairs, which are taken alike
        assert abs(taken - target) <= 2 * max(r.size for r in by[s]) / 2 + 1
    assert sum(r.copies for r in out) == mixing.repeat(mixing.mix(docs, weight=weight)).count()


def test_heavier_documents_are_taken_more_often(spark):
    data = [(i, f"text {i}", "a") for i in range(4000)] + [(i, f"text {i}", "b") for i in range(4000, 8000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    weight = F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)
    out = mixing.mix(docs, weights=(1.0, 3.0), share=0.5, weight=weight)
    even, odd = (out.where(f"source = 'a' and doc_id % 2 = {k}").agg(F.sum("copies")).first()[0] for k in (0, 1))
    assert even > 2 * odd


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).collect() == []
