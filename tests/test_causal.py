import itertools
import math

import numpy as np
import pytest
from conftest import rows

from tracewell.functions.stats import chi2_tail
from tracewell.operators import citest, granger, graph, matrix, pc, windows

# Patterns over five templates A, C, D, L, N with their weights (fixed values).
BINARY = {
    (1, 1, 1, 1, 0): 287, (1, 1, 1, 1, 1): 133, (0, 1, 0, 0, 0): 75, (0, 1, 1, 1, 0): 69,
    (0, 0, 0, 0, 1): 69, (0, 1, 0, 1, 0): 60, (0, 1, 1, 0, 0): 46, (0, 1, 0, 0, 1): 31,
    (0, 1, 1, 1, 1): 28, (0, 1, 0, 1, 1): 27, (0, 1, 1, 0, 1): 15,
}
# pair: n11, chi-square, G-square (fixed values).
LEVEL0 = {
    "AC": (420, 75.175097, 101.837678), "AD": (420, 380.761246, 486.413859),
    "AL": (420, 328.211921, 421.879949), "AN": (133, 7.067500, 7.080817),
    "CD": (578, 165.844299, 174.965599), "CL": (604, 192.397283, 191.861028),
    "CN": (234, 133.231113, 151.947908), "DL": (517, 282.263104, 274.935070),
    "DN": (176, 25.396134, 24.956788), "LN": (188, 22.802580, 22.332918),
}


def samples(spark, table, split=1):
    """Sparse samples of code vectors with their weights, each cut into ``split`` rows."""
    rows_ = [
        ([(v, c) for v, c in enumerate(k) if c], w // split + (i < w % split)) for k, w in table.items() for i in range(split)
    ]
    return spark.createDataFrame(rows_, "items array<struct<v:int,c:int>>, weight long")


def listed(spark, names):
    return matrix.listed_variables(spark, list(names))


def found(spark, table, names, kind="chi2", alpha=0.01, **kw):
    return pc.discover(samples(spark, table), listed(spark, names), kind, alpha, **kw)


COLLIDER = {(0, 0, 0): 100, (0, 1, 1): 100, (1, 0, 1): 100, (1, 1, 1): 100}
CHAIN = {
    (x, y, z): 20 * (3 if x == z else 1) * (3 if y == z else 1)
    for x, y, z in itertools.product((0, 1), repeat=3)
}


@pytest.mark.parametrize("split", [1, 3])
def test_level0_numbers(spark, split):
    p = samples(spark, BINARY, split).repartition(4)
    table = citest.pair_table(citest.pair_cells(p, 5))
    n11 = {"ACDLN"[r.a] + "ACDLN"[r.b]: r.n11 for r in table.collect()}
    assert n11 == {k: v[0] for k, v in LEVEL0.items()}
    for at, kind in ((1, "chi2"), (2, "gsq")):
        got = {r.x + r.y: (r.stat, r.dof) for r in citest.pair_tests(p, listed(spark, "ACDLN"), kind).collect()}
        for k, v in LEVEL0.items():
            assert got[k] == (pytest.approx(v[at], abs=1e-6), 1)


def cells_of(codes, weights, x, y, given=()):
    out = {}
    for row, w in zip(codes, weights):
        key = (tuple(row[v] for v in given), row[x], row[y])
        out[key] = out.get(key, 0) + w
    return out


def statistic(cells, kind):
    stat, dof = 0.0, 0
    for z in {s for s, _, _ in cells}:
        o = {(x, y): n for (s, x, y), n in cells.items() if s == z}
        r, c = ({v: sum(n for k, n in o.items() if k[i] == v) for v in {k[i] for k in o}} for i in (0, 1))
        total = sum(o.values())
        for x, y in itertools.product(r, c):
            n, e = o.get((x, y), 0), r[x] * c[y] / total
            stat += (n - e) ** 2 / e if kind == "chi2" else 2 * n * math.log(n / e) if n else 0.0
        dof += (len(r) - 1) * (len(c) - 1)
    return stat, dof


@pytest.mark.parametrize("kind", ["chi2", "gsq"])
def test_sparse_cells_of_many_codes_equal_brute_force(spark, kind):
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 4, (120, 6)) * (rng.random((120, 6)) < 0.6)
    codes[:, 5] = 0  # a variable that never occurs
    codes[:3, 4] = 99_999
    codes, weights = [tuple(r) for r in codes.tolist()], rng.integers(1, 9, 120).tolist()
    given = [([(v, c) for v, c in enumerate(k) if c], w) for k, w in zip(codes, weights)]
    p = spark.createDataFrame(given, "items array<struct<v:int,c:int>>, weight long")
    want = {(a, b): cells_of(codes, weights, a, b) for a, b in itertools.combinations(range(6), 2)}
    got = {}
    for r in citest.pair_cells(p, 6).collect():
        got.setdefault((r.a, r.b), {})[(), r.x, r.y] = r.cnt
    assert got == want
    for r in citest.pair_independence(p, 6, kind).collect():
        assert (pytest.approx(r.stat, abs=1e-9), r.dof) == statistic(want[r.a, r.b], kind)
    tests = [(0, 1, [2]), (0, 4, [1, 2, 3]), (1, 3, []), (2, 5, [0]), (0, 1, [5])]
    asked = spark.createDataFrame(tests, "a int, b int, given array<int>")
    cells = citest.set_cells(p, asked)
    got = {}
    for r in cells.collect():
        got.setdefault((r.a, r.b, tuple(r.given)), {})[tuple(r.s), r.x, r.y] = r.cnt
    assert got == {(a, b, tuple(g)): cells_of(codes, weights, a, b, g) for a, b, g in tests}
    for r in citest.independence(cells, kind=kind).collect():
        assert (pytest.approx(r.stat, abs=1e-9), r.dof) == statistic(got[r.a, r.b, tuple(r.given)], kind)


def test_pairs_of_five_thousand_variables(spark):
    rng = np.random.default_rng(9)
    v, n = 5_000, 150
    members = [sorted(rng.choice(v, 8, replace=False).tolist()) for _ in range(n)]
    p = spark.createDataFrame([([(m, 1) for m in row], 2) for row in members], "items array<struct<v:int,c:int>>, weight long")
    stats = citest.pair_independence(p, v)
    row = stats.selectExpr("count(*) AS n", "sum(stat) AS stat", "sum(dof) AS dof").first()
    hot = np.zeros((n, v))
    for i, m in enumerate(members):
        hot[i, m] = 1
    k = hot.sum(0)
    some = np.flatnonzero(k)
    both, k = hot[:, some].T @ hot[:, some], k[some]
    chi = (both * n - np.outer(k, k)) ** 2 * n * 2 / (np.outer(k, k) * np.outer(n - k, n - k))
    upper = np.triu_indices(len(some), 1)
    assert row.n == v * (v - 1) // 2 and row.dof == len(some) * (len(some) - 1) // 2
    assert row.stat == pytest.approx(chi[upper].sum())


def results(graph_):
    return {(r.a, r.b, tuple(r.given)): (round(r.stat, 6), r.dof) for r in graph_.tests.collect()}


def test_collider(spark):
    g = found(spark, COLLIDER, "XYZ")
    r = results(g)
    assert r[0, 1, ()] == (0.0, 1) and r[0, 2, ()] == (133.333333, 1)
    assert rows(pc.typed_edges(g)) == [("X", "Z", "directed"), ("Y", "Z", "directed")]
    asked = spark.createDataFrame([(0, 2, [1]), (0, 1, [2])], "a int, b int, given array<int>")
    cells = citest.set_cells(samples(spark, COLLIDER), asked)
    for kind, want in (("chi2", (75, 200)), ("gsq", (104.649629, 277.258872))):
        got = rows(citest.independence(cells, kind=kind).select("b", "stat", "dof"))
        assert [(b, round(s, 6), d) for b, s, d in got] == [(1, want[0], 1), (2, want[1], 1)]


@pytest.mark.parametrize("kind,xy,xz,xz_y", [("chi2", 40, 160, 128), ("gsq", 40.427446, 167.439406, 127.01196)])
def test_chain(spark, kind, xy, xz, xz_y):
    g = found(spark, CHAIN, "XYZ", kind)
    r = results(g)
    assert r[0, 1, ()] == (xy, 1) and r[0, 2, ()] == (xz, 1)
    assert r[0, 1, (2,)] == (0.0, 2) and r[0, 2, (1,)] == (xz_y, 2)
    und = "undirected"
    assert rows(pc.typed_edges(g)) == [("X", "Z", und), ("Y", "Z", und), ("Z", "X", und), ("Z", "Y", und)]
    assert rows(pc.skeleton_edges(g)) == [("X", "Z"), ("Y", "Z")]
    assert [(r.a, r.b, r.given) for r in g.sepsets.collect()] == [(0, 1, [2])]
    best = {(r.x, r.y): r.p_max for r in pc.max_p(g).collect()}
    assert best["X", "Y"] == pytest.approx(1.0)
    table = {(r.x, r.y, r.given) for r in pc.test_table(g).collect()}
    assert {("X", "Y", ""), ("X", "Y", "Z"), ("X", "Z", "Y")} <= table


def test_level_cap_keeps_the_edge(spark):
    assert found(spark, CHAIN, "XYZ", max_level=0).edges.count() == 6


def graph_of(spark, n, pairs, sepsets):
    edges = [p for a, b in pairs for p in ((a, b), (b, a))]
    return pc.Graph(
        matrix.listed_variables(spark, [chr(97 + i) for i in range(n)]),
        spark.createDataFrame(edges, "x int, y int"),
        spark.createDataFrame([(a, b, list(g)) for (a, b), g in sepsets.items()], "a int, b int, given array<int>"),
        spark.createDataFrame([], "a int, b int, given array<int>, level int, stat double, dof long, p double"),
    )


def arrows_of(graph_):
    return {(r.s, r.t) for r in pc.orient(graph_).collect()}


def plain_orient(n, pairs, sepsets):
    """Colliders one after another, then rounds of the three rules, in sets."""
    near = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(n)}
    arrows = set()
    for x, y, z in sorted((x, y, z) for x in range(n) for y in range(x + 1, n) for z in near[x] & near[y]):
        if y not in near[x] and z not in sepsets.get((x, y), ()) and not {(z, x), (z, y)} & arrows:
            arrows |= {(x, z), (y, z)}
    while True:
        plain = {(a, b) for a in near for b in near[a] if (a, b) not in arrows and (b, a) not in arrows}
        new = set()
        for s, t in plain:
            chain = any((c, s) in arrows and t not in near[c] for c in near[s])
            cycle = any((s, c) in arrows and (c, t) in arrows for c in near)
            fork = [c for c in near if (s, c) in plain and (c, t) in arrows]
            if chain or cycle or any(d not in near[c] for c, d in itertools.combinations(fork, 2)):
                new.add((s, t))
        new = {(s, t) for s, t in new if s < t or (t, s) not in new}
        if not new:
            return arrows
        arrows |= new


def test_orientation_rules(spark):
    # Known start: c -> s forced by a collider, then a chain rule turns s - t.
    pairs, sepsets = [(0, 2), (1, 2), (2, 3)], {(0, 1): (), (0, 3): (2,), (1, 3): (2,)}
    assert arrows_of(graph_of(spark, 4, pairs, sepsets)) == {(0, 2), (1, 2), (2, 3)}


@pytest.mark.parametrize("seed", range(6))
def test_orientation_equals_plain_sets(spark, seed):
    """Random graphs with random separating sets: many colliders contradict each other."""
    rng = np.random.default_rng(seed)
    n = 9
    pairs = [p for p in itertools.combinations(range(n), 2) if rng.random() < (0.3, 0.45, 0.6)[seed % 3]]
    sepsets = {}
    for p in itertools.combinations(range(n), 2):
        if p not in pairs:
            sepsets[p] = tuple(v for v in range(n) if v not in p and rng.random() < (0.5, 0.85)[seed % 2])
    assert arrows_of(graph_of(spark, n, pairs, sepsets)) == plain_orient(n, pairs, sepsets)


def test_conditioning_sets(spark):
    edges = [p for a, b in [(0, 1), (0, 2), (0, 3), (1, 4)] for p in ((a, b), (b, a))]
    got = {(r.a, r.b, tuple(r.given)) for r in pc.level_tests(spark.createDataFrame(edges, "x int, y int"), 2).collect()}
    assert got == {(0, 1, (2, 3)), (0, 2, (1, 3)), (0, 3, (1, 2))}


def test_chi2_tail():
    assert chi2_tail(6.634896601, 1) == pytest.approx(0.01, rel=1e-6)
    assert chi2_tail(9.210340372, 2) == pytest.approx(0.01, rel=1e-6)
    assert chi2_tail(18.47530691, 7) == pytest.approx(0.01, rel=1e-6)
    assert chi2_tail(20.09023503, 8) == pytest.approx(0.01, rel=1e-6)
    assert chi2_tail(7.0675, 1) == pytest.approx(0.00785, abs=1e-5)
    assert chi2_tail(3.0, 0) == 1.0 and math.isfinite(chi2_tail(5_000.0, 4_000))


def test_gaussian_pc_finds_a_collider(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(2, 4000))
    z = x + y + 0.5 * rng.normal(size=4000)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), z.tolist())), "x double, y double, z double")
    c = citest.correlations(df, ["x", "y", "z"])
    g = pc.discover_gaussian(c, listed(spark, "xyz"), alpha=0.001)
    assert rows(pc.typed_edges(g)) == [("x", "z", "directed"), ("y", "z", "directed")]
    r = {(q.x, q.y): q for q in citest.fisher_z(c).collect()}
    want = np.corrcoef(x, z)[0, 1]
    assert r["x", "z"].z == pytest.approx(np.arctanh(want) * math.sqrt(3997))


def test_partial_correlations_equal_the_inverse(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 5)) @ rng.normal(size=(5, 5))
    r = np.corrcoef(x.T)
    known = [(a, b, 500, float(r[a, b])) for a, b in itertools.combinations(range(5), 2)]
    correlated = spark.createDataFrame(known, "a int, b int, n long, r double")
    tests = [(a, b, list(g)) for a, b in itertools.combinations(range(5), 2) for k in range(4)
             for g in itertools.combinations([v for v in range(5) if v not in (a, b)], k)]
    for t in citest.partial_z(spark.createDataFrame(tests, "a int, b int, given array<int>"), correlated).collect():
        at = [t.a, t.b, *t.given]
        inverse = np.linalg.inv(r[np.ix_(at, at)])
        partial = -inverse[0, 1] / np.sqrt(inverse[0, 0] * inverse[1, 1])
        assert t.stat == pytest.approx(np.arctanh(partial) * math.sqrt(500 - len(t.given) - 3), abs=1e-6)


def test_partial_correlations_of_odd_columns(spark):
    # column 1 repeats column 0, column 2 is constant, column 3 has fewer rows
    known = [(0, 1, 50, 1.0), (0, 2, 50, None), (1, 2, 50, float("nan")), (0, 3, 20, 0.5), (1, 3, 20, 0.5), (2, 3, 20, None)]
    correlated = spark.createDataFrame(known, "a int, b int, n long, r double")
    tests = [(0, 3, []), (0, 3, [1]), (0, 3, [2]), (0, 2, []), (0, 3, [1, 2])]
    asked = spark.createDataFrame(tests, "a int, b int, given array<int>")
    got = {(r.a, r.b, tuple(r.given)): round(r.stat, 6) for r in citest.partial_z(asked, correlated).collect()}
    half = lambda n: round(math.atanh(0.5) * math.sqrt(n), 6)
    assert got == {(0, 3, ()): half(17), (0, 3, (1,)): 0.0, (0, 3, (2,)): half(16), (0, 2, ()): 0.0, (0, 3, (1, 2)): 0.0}


def test_uniform_bins(spark):
    df = spark.createDataFrame([(0.0, 1.0), (5.0, 1.0), (10.0, 1.0)], "a double, b double")
    assert rows(matrix.discretize(df, ["a", "b"])) == [(0, 0), (2, 0), (4, 0)]


def test_baskets(spark):
    df = spark.createDataFrame([(1, "b, a, b"), (2, "a"), (3, "b, a")], "id long, line string")
    m = matrix.basket_members(df, "id")
    assert rows(m) == [(1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, "b")]
    p = matrix.set_patterns(matrix.row_sets(m))
    assert rows(matrix.item_samples(p, listed(spark, "ab"))) == [([(0, 1)], 1), ([(0, 1), (1, 1)], 2)]
    assert rows(matrix.item_samples(p, listed(spark, "b"))) == [([], 1), ([(0, 1)], 2)]


def test_coded_samples(spark):
    df = spark.createDataFrame([(0, 5), (0, 5), (1, None), (2, 0)], "a int, b int")
    assert rows(matrix.coded_samples(df, ["a", "b"])) == [([(0, 2)], 1), ([(1, 5)], 2)]
    named = spark.createDataFrame([("z",), ("k",), (None,), ("z",)], "flag string")
    assert sorted(r.flag for r in matrix.coded_names(named, "flag").collect() if r.flag is not None) == [0, 1, 1]


def one_hot(series, names, maxlag):
    z = np.array([[float(t == n) for n in names] for t in series])
    x = np.hstack([z[maxlag - k : len(z) - k] for k in range(1, maxlag + 1)])
    return x, z[maxlag:]


@pytest.mark.parametrize("chunk", [7, 1000])
def test_moments_match_the_dense_matrix(lines, chunk):
    rng = np.random.default_rng(1)
    t = [["a", "b", "c", None][i] for i in rng.integers(0, 4, 53)]
    folds = np.zeros((5, 13, 13))
    names = ["a", "b", "c"]
    at = {("", -1): 0} | {(n, k): 1 + 3 * k + i for k in range(4) for i, n in enumerate(names)}
    for r in granger.moments(granger.lag_tuples(lines(t), 3, 5, chunk)).collect():
        i, j = at[r.va, r.la], at[r.vb, r.lb]
        folds[r.fold, i, j] = folds[r.fold, j, i] = r.cnt
    x, y = one_hot(t, names, 3)
    z = np.hstack([np.ones((50, 1)), y, x])
    for f in range(5):
        part = z[10 * f : 10 * f + 10]
        assert np.array_equal(folds[f], part.T @ part)


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 6))
    y = x @ np.array([1.0, 0, -0.5, 0, 0, 0]) + 0.1 * rng.normal(size=200)
    x, y = x - x.mean(0), y - y.mean()
    gram, xy = x.T @ x / 200, x.T @ y / 200
    grid = np.array([0.5, 0.1, 0.01])
    for alpha, b in zip(grid, granger._solve_path(gram, xy, y @ y / 200, grid)):
        slope = xy - gram @ b
        assert np.all(np.abs(slope) <= alpha * 1.05 + 1e-9)
        assert np.allclose(slope[b != 0], alpha * np.sign(b[b != 0]), atol=0.05 * alpha + 1e-9)


def dense_lasso(x, y, folds=5, alphas=100):
    """The same regression on whole matrices: grid of penalties, contiguous folds, coordinate descent."""
    solve = lambda a, b, grid: granger._solve_path(
        (a - a.mean(0)).T @ (a - a.mean(0)) / len(a), (a - a.mean(0)).T @ (b - b.mean()) / len(a), b.var(), grid
    )
    top = np.abs((x - x.mean(0)).T @ (y - y.mean()) / len(x)).max()
    grid, errors = np.geomspace(top, top * 1e-3, alphas), np.zeros(alphas)
    for held in np.array_split(np.arange(len(x)), folds):
        rest = np.setdiff1d(np.arange(len(x)), held)
        path = solve(x[rest], y[rest], grid)
        a = y[rest].mean() - path @ x[rest].mean(0)
        errors += ((y[held][None] - path @ x[held].T - a[:, None]) ** 2).mean(1)
    return solve(x, y, grid)[np.argmin(errors)]


@pytest.mark.parametrize("group", [8, 2])
def test_granger_of_several_variables_equals_whole_matrices(lines, monkeypatch, group):
    monkeypatch.setattr(granger, "GROUP_TARGETS", group)
    rng = np.random.default_rng(6)
    names = list("abcdef")
    t = []
    for _ in range(140):
        t += ["a", "b"] if rng.random() < 0.4 else ["c", str(rng.choice(["d", "e"])), "f"] if rng.random() < 0.3 else [str(rng.choice(names))]
    log = lines(t)
    got = {(e.source, e.target, e.lag): e.coefficient for e in granger.granger_lasso(log, listed(log.sparkSession, names)).collect()}
    x, y = one_hot(t, names, 3)
    want = {}
    for k, name in enumerate(names):
        b = dense_lasso(x, y[:, k])
        want |= {(names[j % 6], name, j // 6 + 1): b[j] for j in np.flatnonzero(np.abs(b) > 1e-6) if j % 6 != k}
    assert len(want) > 20 and set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_granger_finds_a_planted_lag(lines):
    rng = np.random.default_rng(3)
    t = []
    for _ in range(300):
        t += ["cause", "effect"] if rng.random() < 0.4 else [str(rng.choice(["n1", "n2"]))]
    names = ["cause", "effect", "n1", "n2"]
    spark = lines(t).sparkSession
    edges = granger.granger_lasso(windows.frequent_slots(lines(t)), listed(spark, names)).collect()
    lag1 = {(e.source, e.target): e.coefficient for e in edges if e.lag == 1}
    assert max(lag1, key=lag1.get) == ("cause", "effect")
    assert all(e.source != e.target for e in edges)
    assert granger.first_block(granger.granger_lasso(windows.frequent_slots(lines(t)), listed(spark, names))).columns == [
        "source", "target", "coefficient",
    ]


def test_components_with_hub_chain_and_cycle(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)]
    hub = [("hub", f"leaf{i}") for i in range(30)]
    cycle = [("x", "y"), ("y", "z"), ("z", "x")]
    df = spark.createDataFrame(chain + hub + cycle, "source string, target string")
    got = graph.weak_components(df)
    assert {r.component for r in got.collect()} == {"c000", "hub", "x"}
    assert rows(graph.component_sizes(got), "component") == [("c000", 41), ("hub", 31), ("x", 3)]


def test_dag_orientations(spark):
    def count(pairs, fixed=(), **kw):
        e = [p for a, b in pairs for p in ((a, b), (b, a))] + list(fixed)
        return graph.acyclic_orientations(spark.createDataFrame(e, "source string, target string"), **kw).count()

    assert count([("a", "b"), ("b", "c")]) == 4
    assert count([("a", "b"), ("b", "c"), ("a", "c")]) == 6
    assert count([("a", "b"), ("b", "c")], forbid_new_colliders=True) == 3
    assert count([("a", "b")], fixed=[("b", "c"), ("c", "a")]) == 1
    assert count([("a", "b")], fixed=[("x", "y"), ("y", "x2"), ("x2", "x")]) == 0


def test_endpoint_classes(spark):
    data = [("a", "b", -1, 1), ("c", "d", 1, -1), ("e", "f", 1, 1), ("g", "h", -1, -1), ("i", "j", 0, 0)]
    e = graph.classify_endpoints(spark.createDataFrame(data, "i string, j string, at_i int, at_j int"))
    assert rows(e) == [
        ("a", "b", "directed"), ("d", "c", "directed"), ("e", "f", "bidirectional"), ("f", "e", "bidirectional"),
        ("g", "h", "undirected"), ("h", "g", "undirected"),
    ]
    assert rows(graph.edge_report(e)) == [(8, 2, 2, 2)]
    assert rows(graph.edge_report(e, 10)) == [(10, 2, 2, 2)]
    assert rows(graph.undirected_pairs(e)) == [("e", "f"), ("g", "h")]
    assert rows(graph.simple_graph(e)) == [("a", "b"), ("c", "d"), ("e", "f"), ("g", "h")]
    nodes = spark.createDataFrame([("a",), ("b",), ("g",)], "template string")
    assert rows(graph.first_neighbours(nodes, e)) == [("a", "NA", "b"), ("b", "a", "NA"), ("g", "NA", "NA")]
    assert graph.drop_node(e, "a").count() == 5


def test_pair_pmax_tries_all_sets_of_up_to_three(spark, tmp_path):
    from itertools import combinations

    from tracewell.plans import causal

    rng = np.random.default_rng(5)
    hidden = rng.random(6000) < 0.5
    bits = rng.random((6000, 5)) < np.where(hidden, 0.8, 0.2)[:, None]
    bits = bits[bits.any(axis=1)].astype(int)
    names = list("abcde")
    spark.createDataFrame(list(enumerate(names)), "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    items = [(int(o), int(v)) for o, v in np.argwhere(bits)]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")

    def p_value(x, y, given):
        stat, dof = 0.0, 0
        code = bits[:, list(given)] @ (2 ** np.arange(len(given))) if given else np.zeros(len(bits), int)
        for z in np.unique(code):
            o = np.histogram2d(bits[code == z, x], bits[code == z, y], bins=2, range=[[0, 1], [0, 1]])[0]
            o = o[o.any(axis=1)][:, o.any(axis=0)]
            e = o.sum(axis=1, keepdims=True) * o.sum(axis=0, keepdims=True) / o.sum()
            stat, dof = stat + ((o - e) ** 2 / e).sum(), dof + (o.shape[0] - 1) * (o.shape[1] - 1)
        return chi2_tail(stat, dof)

    near = {v: set(range(5)) - {v} for v in range(5)}
    tried = {}
    for level in range(4):
        frozen = {v: set(k) for v, k in near.items()}
        for x, y in combinations(range(5), 2):
            if y not in frozen[x]:
                continue
            sets = {s for end, other in ((x, y), (y, x)) for s in combinations(sorted(frozen[end] - {other}), level)}
            found = [p_value(x, y, s) for s in sets]
            tried.setdefault((x, y), []).extend(found)
            if any(p > causal.ALPHA for p in found):
                near[x].discard(y)
                near[y].discard(x)
    want = {(names[x], names[y]): (round(max(p), 4), len(p)) for (x, y), p in tried.items() if max(p) > 0}
    got = {(r.x, r.y): (r.p_max, r.n_tests) for r in causal.pair_pmax(spark, str(tmp_path)).collect()}
    assert any(n > 4 for _, n in want.values())
    assert {k: n for k, (_, n) in got.items()} == {k: n for k, (_, n) in want.items()}
    assert all(got[k][0] == pytest.approx(want[k][0], abs=1e-4) for k in want)


def test_many_sets_are_counted_from_shared_items(spark):
    """All sets of five of twelve variables: too many meetings of rows and sets to make one by one."""
    rng = np.random.default_rng(17)
    codes = np.unique(rng.integers(1, 3, (1500, 12)) * (rng.random((1500, 12)) < 0.3), axis=0)
    codes, weights = [tuple(r) for r in codes.tolist()], rng.integers(1, 9, len(codes)).tolist()
    given = [([(v, c) for v, c in enumerate(k) if c], w) for k, w in zip(codes, weights)]
    p = spark.createDataFrame(given, "items array<struct<v:int,c:int>>, weight long")
    every = list(itertools.combinations(range(12), 5))
    sets = spark.createDataFrame([(list(m),) for m in every], "members array<int>")
    assert citest._supports_take_less(p, sets)
    assert not citest._supports_take_less(p, sets.limit(1))
    got = {(tuple(r.members), tuple(r.code)): r.cnt for r in citest._support_cells(p, sets).collect()}
    want = {}
    for code, w in zip(codes, weights):
        for m in every:
            key = m, tuple(code[v] for v in m)
            want[key] = want.get(key, 0) + w
    assert got == want
    some = spark.createDataFrame([(3, 7, [11, 0, 5]), (0, 3, [5, 7, 11]), (1, 2, [])], "a int, b int, given array<int>")
    for few in (True, False):
        cells = {}
        for r in citest.set_cells(p, some, few=few).collect():
            cells.setdefault((r.a, r.b, tuple(r.given)), {})[tuple(r.s), r.x, r.y] = r.cnt
        tests = [(3, 7, (11, 0, 5)), (0, 3, (5, 7, 11)), (1, 2, ())]
        assert cells == {t: cells_of(codes, weights, *t) for t in tests}
