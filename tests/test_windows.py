import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tracewell.operators import adaptive, windows


def series(seed, n, words="abcdefg"):
    rng = random.Random(seed)
    return [rng.choice(words) for _ in range(n)]


def test_window_members_fixture(lines):
    out = windows.window_members(lines(list("abac")), 3)
    assert rows(out.select("win", "template")) == [(0, "a"), (0, "b"), (1, "a"), (1, "b"), (1, "c")]
    assert windows.window_members(lines(list("abac")), 5).count() == 0


@pytest.mark.parametrize("chunk", [3, 7, 1000])
@pytest.mark.parametrize("w", [1, 2, 5])
def test_windows_match_brute_force_for_any_chunk(lines, chunk, w):
    texts = [series(1, 40), series(2, 3), series(3, 17)]
    want = sorted(
        (f"s{k}", i, tuple(sorted(set(t[i : i + w])))) for k, t in enumerate(texts) for i in range(len(t) - w + 1)
    )
    df = lines(*texts).repartition(3)
    sets = windows.window_sets(df, w, chunk).collect()
    assert sorted((r.source, r.win, tuple(r["items"])) for r in sets) == want
    members = windows.window_members(df, w, chunk).collect()
    assert sorted((r.source, r.win, r.template) for r in members) == [(s, i, v) for s, i, vs in want for v in vs]


@pytest.mark.parametrize("chunk", [4, 1000])
def test_lags_match_brute_force(lines, chunk):
    t = series(5, 30)
    got = rows(windows.lag_pairs(lines(t), 3, chunk).select("line_no", "lag", "template", "earlier"))
    assert got == [(i, k, t[i], t[i - k]) for i in range(30) for k in (1, 2, 3) if i >= k]


def test_window_size_formula(spark):
    df = spark.createDataFrame([(100, 10), (60, 10), (40, 10), (5, 0)], "n long, f long")
    got = [r[0] for r in df.select(windows.window_size(F.col("n"), F.col("f"))).collect()]
    assert got == [30, 11, 2, None]
    for n in range(0, 80, 7):
        for f in range(1, 9):
            search = next((w for w in range(30, 1, -1) if n - w + 1 >= 5 * f), 2)
            assert search == max(2, min(30, n - 5 * f + 1))


def test_no_frequent_template_is_an_error(lines):
    with pytest.raises(ValueError):
        windows.require_features(windows.frequent_lines(lines(list("abc"))))


def test_frequent_lines_and_slots(lines):
    t = list("abacadaea")
    assert [r.template for r in windows.frequent_lines(lines(t), 5).collect()] == ["a"] * 5
    assert rows(windows.frequent_lines(lines(t), 5).select("line_no")) == [(i,) for i in range(5)]
    slots = rows(windows.frequent_slots(lines(t), 5).select("line_no", "template"))
    assert slots == [(i, "a" if i % 2 == 0 else None) for i in range(9)]


def test_fixed_bins(lines):
    df = lines(["x"] * 130)
    last = {r.line_no: r.bin for r in windows.bins_clamped(df).collect()}
    assert (last[0], last[59], last[60], last[129]) == (1, 1, 2, 2)
    last = {r.line_no: r.bin for r in windows.bins_open(df).collect()}
    assert (last[119], last[120], last[129]) == (2, 3, 3)
    assert {r.bin for r in windows.bins_clamped(lines(["x"] * 10)).collect()} == {1}


def test_bin_matrix_has_zeros(lines):
    out = windows.bin_matrix(windows.bins_open(lines(list("aab")), 2))
    assert rows(out.select("template", "bin", "cnt")) == [("a", 1, 2), ("a", 2, 0), ("b", 1, 0), ("b", 2, 1)]


def test_quality_labels(spark):
    data = [("a", 100, 10, 1), ("b", 50, 10, 1), ("c", 499, 100, 1), ("d", 0, 0, 2)]
    df = spark.createDataFrame(data, "source string, n_lines long, n_features long, window_size long")
    got = {r.source: (r.ratio, r.confidence) for r in windows.matrix_quality(df).collect()}
    assert got == {"a": (10.0, "high"), "b": (5.0, "moderate"), "c": (4.99, "low"), "d": (0.0, "low")}


def brute_bins(t, k):
    out, b, seen = [], 0, set()
    for x in t:
        out.append(b)
        seen.add(x)
        if len(seen) == k:
            b, seen = b + 1, set()
    return out


def test_adaptive_fixture(lines):
    got = rows(adaptive.bins_adaptive(lines(list("aabccab")), 2).select("line_no", "bin"))
    assert [b for _, b in got] == [0, 0, 0, 1, 1, 1, 2]


@pytest.mark.parametrize("words,k", [("abcdefg", 3), ("abc", 2), ("ab", 5), ("abcdefghijkl", 9)])
def test_adaptive_chunks_equal_the_plain_scan(lines, words, k):
    texts = [series(11, 203, words), series(12, 9, words), [words[i % len(words)] for i in range(60)]]
    out = adaptive.bins_adaptive(lines(*texts).repartition(4), k, chunk=20)
    want = sorted((f"s{j}", i, b) for j, t in enumerate(texts) for i, b in enumerate(brute_bins(t, k)))
    assert rows(out.select("source", "line_no", "bin")) == want


def test_wide_matrix_is_built_in_bounded_parts(spark, monkeypatch):
    given = [(r, f"c{c}", r + c) for r in range(200) for c in range(5) if (r + c) % 3]
    given += [(None, "c0", 4), (7, "c9", 2), (7, "c9", 2)]
    cells = spark.createDataFrame(given, "row_id long, var string, n long")
    whole = sorted(map(repr, windows.wide_matrix(cells, "row_id", "var", "n").collect()))
    monkeypatch.setattr(windows, "WIDE_CELLS", 100)
    cut = windows.wide_matrix(cells, "row_id", "var", "n")
    places = len(given) * 6
    assert cut.rdd.getNumPartitions() >= places // 100
    assert sorted(map(repr, cut.collect())) == whole and len(whole) == 201
    row = {tuple(r)[0]: tuple(r)[1:] for r in cut.collect()}
    assert row[7] == (7, 8, 0, 10, 11, 2) and row[5] == (5, 0, 7, 8, 0, 0)
