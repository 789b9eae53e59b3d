"""Constraint-based causal discovery as relations: skeleton by levels, then orientation.

Edges, tests, separating sets and arrows are tables. A level joins the edge table with itself to get
its conditioning sets, counts the cells of all tests, and takes decision and separating set as an
aggregate per pair; orientation is joins and anti-joins until nothing changes. The driver only asks
whether a table is empty.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.citest import (
    TEST,
    all_pairs,
    independence,
    pair_independence,
    partial_z,
    set_cells,
    total_weight,
    with_p,
)
from tracewell.session import cut_lineage, materialize

BOTH = ["x", "y"]


@dataclass
class Graph:
    """The graph over numbered variables.

    ``variables`` (v, name); ``edges`` (x, y) in both directions; ``sepsets`` (a, b, given) with a < b;
    ``tests`` (a, b, given, level, stat, dof, p).
    """

    variables: DataFrame
    edges: DataFrame
    sepsets: DataFrame
    tests: DataFrame


#: (tests, level, number of tests) to (a, b, given, stat, dof, p).
Tester = Callable[[DataFrame, int, int], DataFrame]
#: Variables of all tests of a level, one row each, up to which the tests are broadcast.
FEW = 100_000


def discrete_tester(samples: DataFrame, n_variables: int, kind: str) -> Tester:
    total = total_weight(samples)

    def evaluate(tests: DataFrame, level: int, n_tests: int) -> DataFrame:
        if level:
            cells = set_cells(samples, tests, total, n_tests * (level + 2) <= FEW)
            return with_p(independence(cells, TEST, kind))
        pairs = with_p(pair_independence(samples, n_variables, kind))
        return pairs.withColumn("given", F.array().cast("array<int>"))

    return evaluate


def gaussian_tester(correlated: DataFrame) -> Tester:
    return lambda tests, *_: partial_z(tests, correlated)


def _flipped(pairs: DataFrame, a: str = "x", b: str = "y") -> DataFrame:
    return pairs.select(F.col(b).alias(a), F.col(a).alias(b))


def level_tests(edges: DataFrame, level: int) -> DataFrame:
    """(a, b, given): for each edge a < b all sets of ``level`` other neighbours of a or of b."""
    halves = []
    for end, other in (("x", "y"), ("y", "x")):
        sets = edges.where("x < y").withColumn("given", F.array().cast("array<int>"))
        for _ in range(level):
            kin = edges.select(F.col("x").alias("of"), F.col("y").alias("next"))
            last = F.coalesce(F.try_element_at("given", F.lit(-1)), F.lit(-1))
            sets = sets.join(kin, (F.col(end) == F.col("of")) & (F.col("next") != F.col(other)) & (F.col("next") > last))
            sets = sets.select("x", "y", F.concat("given", F.array("next")).alias("given"))
        halves.append(sets)
    return halves[0].unionByName(halves[1]).distinct().withColumnsRenamed({"x": "a", "y": "b"})


def skeleton(variables: DataFrame, evaluate: Tester, alpha: float = 0.01, max_level: int | None = None) -> Graph:
    """Order-independent skeleton search: all tests of a level use the graph at its start."""
    pairs = cut_lineage(all_pairs(variables.sparkSession, variables.count()))
    edges = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"))
    edges = edges.unionByName(_flipped(edges))
    none = F.array().cast("array<int>")
    found, separated = [], []
    for level in count():
        if max_level is not None and level > max_level:
            break
        tests = cut_lineage(level_tests(edges, level)) if level else pairs.withColumn("given", none)
        n_tests = tests.count() if level else 0
        if level and not n_tests:
            break
        done = evaluate(tests, level, n_tests).select(*TEST, F.lit(level).alias("level"), "stat", "dof", "p")
        found.append(materialize(done, "tests"))
        # read from the table of results, like all that follows from it
        separated.append(found[-1].where(F.col("p") > alpha).groupBy("a", "b").agg(F.min("given").alias("given")))
        gone = separated[-1].select(F.col("a").alias("x"), F.col("b").alias("y"))
        edges = cut_lineage(edges.join(gone.unionByName(_flipped(gone)), BOTH, "left_anti"))
    return Graph(variables, edges, *(reduce(DataFrame.unionByName, x) for x in (separated, found)))


def _without(rows: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Rows that have no partner in the (x, y) pairs of ``other`` under the named columns."""
    named = other.select(*[F.col(own).alias(key) for own, key in zip(BOTH, keys, strict=True)])
    return rows.join(named, list(keys), "left_anti")


def colliders(graph: Graph) -> DataFrame:
    """(s, t): the arrows of unshielded colliders.

    A collider x -> z <- y is taken unless an earlier taken one, in the order of (x, y, z), holds the
    reverse of one of its arrows. All those whose earlier opponents are decided are decided at once.
    """
    near = graph.edges
    left, right = near.withColumnRenamed("y", "z"), near.select(F.col("x").alias("y"), F.col("y").alias("z"))
    open_ = _without(left.join(right, "z").where("x < y"), near, "x", "y")
    keyed = graph.sepsets.withColumnsRenamed({"a": "x", "b": "y"})
    key = F.struct("x", "y", "z").alias("key")
    wanted = open_.join(keyed, BOTH).where(~F.array_contains("given", F.col("z"))).select(key)
    wanted = cut_lineage(wanted)
    half = lambda rows: rows.select("key", F.explode(F.array("key.x", "key.y")).alias("s"), F.col("key.z").alias("t"))
    mine, theirs = half(wanted), half(wanted).select(F.col("key").alias("early"), F.col("t").alias("s"), F.col("s").alias("t"))
    opposed = cut_lineage(mine.join(theirs, ["s", "t"]).where("early < key").select("key", "early").distinct())
    waiting, taken = wanted, wanted.limit(0)
    while True:
        alive = waiting.unionByName(taken).withColumnRenamed("key", "early")
        blocked = opposed.join(alive, "early", "left_semi").select("key").distinct()
        free = cut_lineage(waiting.join(blocked, "key", "left_anti"))
        taken = cut_lineage(taken.unionByName(free))
        lost = opposed.join(taken.withColumnRenamed("key", "early"), "early", "left_semi").select("key").distinct()
        waiting = cut_lineage(waiting.join(free, "key", "left_anti").join(lost, "key", "left_anti"))
        if waiting.isEmpty():
            return half(taken).select("s", "t").distinct()


def orient(graph: Graph) -> DataFrame:
    """Arrows (s, t): colliders first, then the three Meek rules in rounds until nothing changes.

    A round applies every rule to the arrows at its start; a pair that both directions claim points
    from the lower number to the higher.
    """
    near = graph.edges
    arrows = cut_lineage(colliders(graph))
    named = lambda rows, *names: rows.toDF(*names)
    while True:
        known = arrows.select(F.col("s").alias("x"), F.col("t").alias("y"))
        plain = cut_lineage(near.join(known.unionByName(_flipped(known)), BOTH, "left_anti"))
        if plain.isEmpty():
            return arrows
        st = named(plain, "s", "t")
        chain = _without(st.join(named(arrows, "c", "s"), "s"), near, "c", "t").where("c != t")
        cycle = st.join(named(arrows, "s", "c"), "s").join(named(arrows, "c", "t"), ["c", "t"])
        fork = st.join(named(plain, "s", "c"), "s").join(named(arrows, "c", "t"), ["c", "t"])
        kite = fork.join(fork.withColumnRenamed("c", "d"), ["s", "t"]).where("c < d")
        kite = _without(kite, near, "c", "d")
        new = reduce(DataFrame.unionByName, (rows.select("s", "t") for rows in (chain, cycle, kite))).distinct()
        back = new.select(F.col("t").alias("s"), F.col("s").alias("t"), F.lit(True).alias("both"))
        new = cut_lineage(new.join(back, ["s", "t"], "left").where("both IS NULL OR s < t").select("s", "t"))
        if new.isEmpty():
            return arrows
        arrows = cut_lineage(arrows.unionByName(new))


def _named(graph: Graph, pairs: DataFrame, *ends: str) -> DataFrame:
    """Replace the variable numbers in the columns ``ends`` by names."""
    for end in ends:
        names = graph.variables.select(F.col("v").alias(end), F.col("name").alias("_name"))
        pairs = pairs.join(names, end).drop(end).withColumnRenamed("_name", end)
    return pairs


def typed_edges(graph: Graph) -> DataFrame:
    """(source, target, relation); an undirected pair appears in both directions."""
    arrows = cut_lineage(orient(graph))
    flag = lambda s, t, name: arrows.select(F.col(s).alias("x"), F.col(t).alias("y"), F.lit(True).alias(name))
    marked = graph.edges.join(flag("s", "t", "there"), BOTH, "left").join(flag("t", "s", "back"), BOTH, "left")
    marked = marked.where("there IS NOT NULL OR back IS NULL")
    kind = F.when(F.col("there").isNull(), "undirected").when(F.col("back").isNull(), "directed").otherwise("bidirectional")
    return _named(graph, marked.select("x", "y", kind.alias("relation")), "x", "y").select(
        F.col("x").alias("source"), F.col("y").alias("target"), "relation"
    )


def skeleton_edges(graph: Graph) -> DataFrame:
    """(x, y) with x < y by name."""
    return _named(graph, graph.edges, "x", "y").where("x < y").select("x", "y")


def test_table(graph: Graph) -> DataFrame:
    """(x, y, given, level, stat, dof, p) by name; the names in ``given`` are joined by commas."""
    sets = graph.tests.select("given").distinct()
    each = sets.select("given", F.posexplode("given").alias("at", "v")).join(graph.variables, "v")
    names = F.array_sort(F.collect_list(F.struct("at", "name")))
    labels = each.groupBy("given").agg(F.array_join(F.transform(names, lambda n: n["name"]), ",").alias("label"))
    rows = graph.tests.join(labels, "given", "left").withColumn("given", F.coalesce("label", F.lit("")))
    return _named(graph, rows.withColumnsRenamed({"a": "x", "b": "y"}), "x", "y").select(
        "x", "y", "given", "level", "stat", "dof", "p"
    )


def max_p(graph: Graph) -> DataFrame:
    """(x, y, p_max, n_tests): largest p per variable pair over all tests tried, zeros left out."""
    best = graph.tests.groupBy("a", "b").agg(F.max("p").alias("p_max"), F.count(F.lit(1)).alias("n_tests"))
    best = best.where(F.col("p_max") != 0).withColumnsRenamed({"a": "x", "b": "y"})
    return _named(graph, best, "x", "y").select("x", "y", "p_max", "n_tests")


def _sampled(samples: DataFrame) -> DataFrame:
    """Checkpointed samples; without any, no test has a result and no graph would mean anything.

    They are few bytes, which a shuffle leaves in few partitions, but every row meets many tests.
    """
    fixed = cut_lineage(samples.repartition(samples.sparkSession.sparkContext.defaultParallelism))
    if fixed.isEmpty():
        raise ValueError("no samples to test")
    return fixed


def discover(
    samples: DataFrame, variables: DataFrame, kind: str = "chi2", alpha: float = 0.01, max_level: int | None = None
) -> Graph:
    """PC on sparse samples. They are checkpointed once and read again by every level."""
    variables = cut_lineage(variables)
    return skeleton(variables, discrete_tester(_sampled(samples), variables.count(), kind), alpha, max_level)


def discover_gaussian(
    correlated: DataFrame, variables: DataFrame, alpha: float = 0.05, max_level: int | None = None
) -> Graph:
    """PC on continuous columns with Fisher-Z; ``correlated`` is (x, y, n, r) by name."""
    numbers = variables.select("name", "v")
    pairs = correlated.join(numbers.toDF("x", "i"), "x").join(numbers.toDF("y", "j"), "y")
    pairs = cut_lineage(pairs.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "n", "r"))
    return skeleton(cut_lineage(variables), gaussian_tester(pairs), alpha, max_level)


def compare_tests(samples: DataFrame, variables: DataFrame, alpha: float, max_level: int | None = None) -> DataFrame:
    """(test, edges): edges of the chi-square graph against those of the G-square skeleton."""
    samples, parts = _sampled(samples), []
    for kind in ("chi2", "gsq"):
        edges = discover(samples, variables, kind, alpha, max_level).edges.where("x < y")
        parts.append(edges.agg(F.count(F.lit(1)).alias("edges")).select(F.lit(kind).alias("test"), "edges"))
    return parts[0].unionByName(parts[1])
