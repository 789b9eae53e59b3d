"""Independence tests on sparse samples.

A sample table holds distinct rows of the variable matrix: ``items``, the codes that are not 0 as
(v, c) sorted by variable, and ``weight``. Counts start from these items: variables that occur together
are paired inside a row, the variables of a conditional test meet the rows that hold one of them or
are counted from the items that rows share, and what is left of each margin is the cells of code 0. No row has a place for every variable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.stats import chi2_p, normal_p
from tracewell.session import cut_lineage, small_side

TEST = ("a", "b", "given")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda total, n: total + n)


def total_weight(samples: DataFrame) -> int:
    return samples.agg(F.sum("weight")).first()[0] or 0


def code_margins(samples: DataFrame) -> DataFrame:
    """(v, codes): the codes of each variable other than 0 with their weights, as (c, n)."""
    counted = samples.select(F.inline("items"), "weight").groupBy("v", "c").agg(F.sum("weight").alias("n"))
    return counted.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("c", "n"))).alias("codes"))


def _together(samples: DataFrame) -> DataFrame:
    """(a, b, cells): cells (x, y, cnt) of variables a < b that share a row, both codes other than 0."""
    first = samples.select("weight", "items", F.posexplode("items").alias("at", "p"))
    both = first.select("weight", "p", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("q"))
    counted = both.groupBy(
        F.col("p.v").alias("a"), F.col("q.v").alias("b"), F.col("p.c").alias("x"), F.col("q.c").alias("y")
    ).agg(F.sum("weight").alias("cnt"))
    return counted.groupBy("a", "b").agg(F.collect_list(F.struct("x", "y", "cnt")).alias("cells"))


def all_pairs(spark, n_variables: int) -> DataFrame:
    """(a, b) with a < b for every pair of variables."""
    one = spark.range(n_variables).select(F.col("id").cast("int").alias("a")).where(F.col("a") < n_variables - 1)
    return one.select("a", F.explode(F.sequence(F.col("a") + 1, F.lit(n_variables - 1))).alias("b"))


def _pairs_with_cells(samples: DataFrame, n_variables: int) -> DataFrame:
    """(a, b, n_rows, n_cols, cells): the codes of either variable that occur, and all non-empty cells.

    A cell is (x, y, cnt, r, c) with the margins of its row and its column.
    """
    n = F.lit(total_weight(samples))
    margins = code_margins(samples).withColumn("rest", n - _sum(F.col("codes.n")))
    margins = small_side(margins)
    joined = all_pairs(samples.sparkSession, n_variables).join(_together(samples), ["a", "b"], "left")
    for v in ("a", "b"):
        named = margins.select(F.col("v").alias(v), F.struct("codes", "rest").alias(f"_{v}"))
        never = F.struct(F.array().cast("array<struct<c:int,n:bigint>>").alias("codes"), n.alias("rest"))
        joined = joined.join(named, v, "left").withColumn(f"_{v}", F.coalesce(f"_{v}", never))
    joined = joined.withColumn("cells", F.coalesce("cells", F.array().cast("array<struct<x:int,y:int,cnt:bigint>>")))
    zero, rest_a, rest_b = F.lit(0), F.col("_a.rest"), F.col("_b.rest")

    def cell(x: Column, y: Column, cnt: Column, r: Column, c: Column) -> Column:
        whole = zip(("x", "y", "cnt", "r", "c"), (x, y, cnt, r, c), ("int", "int", "long", "long", "long"), strict=True)
        return F.struct(*[value.cast(kind).alias(name) for name, value, kind in whole])

    size_of = lambda v, code: F.element_at(F.filter(f"_{v}.codes", lambda m: m["c"] == code), 1)["n"]
    met = lambda end, m: _sum(F.transform(F.filter("cells", lambda c: c[end] == m["c"]), lambda c: c["cnt"]))
    left = n - _sum(F.col("_a.codes.n")) - _sum(F.col("_b.codes.n")) + _sum(F.col("cells.cnt"))
    cells = F.concat(
        F.transform("cells", lambda c: cell(c["x"], c["y"], c["cnt"], size_of("a", c["x"]), size_of("b", c["y"]))),
        F.transform("_a.codes", lambda m: cell(m["c"], zero, m["n"] - met("x", m), m["n"], rest_b)),
        F.transform("_b.codes", lambda m: cell(zero, m["c"], m["n"] - met("y", m), rest_a, m["n"])),
        F.array(cell(zero, zero, left, rest_a, rest_b)),
    )
    present = lambda v: (F.size(f"_{v}.codes") + (F.col(f"_{v}.rest") > 0).cast("int")).cast("long")
    return joined.select(
        "a", "b", present("a").alias("n_rows"), present("b").alias("n_cols"), F.filter(cells, lambda c: c["cnt"] > 0).alias("cells")
    )


def pair_cells(samples: DataFrame, n_variables: int) -> DataFrame:
    """Non-empty cells of every variable pair: (a, b, x, y, cnt) with a < b."""
    return _pairs_with_cells(samples, n_variables).select("a", "b", F.inline("cells")).drop("r", "c")


def _term(kind: str, cnt: Column, expected: Column) -> Column:
    """chi2: its terms add up to the sum of (O-E)^2/E with empty cells included; gsq: 2 O ln(O/E)."""
    return {"chi2": cnt * cnt / expected - cnt, "gsq": 2 * cnt * F.log(cnt / expected)}[kind]


def pair_independence(samples: DataFrame, n_variables: int, kind: str = "chi2") -> DataFrame:
    """(a, b, stat, dof) of the unconditional test of every variable pair."""
    n = F.lit(total_weight(samples))
    term = lambda c: _term(kind, c["cnt"], c["r"] * c["c"] / n)
    stat = F.aggregate("cells", F.lit(0.0), lambda total, c: total + term(c))
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    return _pairs_with_cells(samples, n_variables).select("a", "b", stat.alias("stat"), dof.alias("dof"))


def set_cells(samples: DataFrame, tests: DataFrame, total: int | None = None, few: bool = False) -> DataFrame:
    """Non-empty cells of conditional tests: (a, b, given, s, x, y, cnt); ``s`` is the slice.

    Tests over the same variables share their cells, which are counted once: from the rows that meet a
    set of variables or from the weights of sets of items, whichever takes fewer rows. ``total`` is the
    weight of all samples, if known; with ``few`` the caller has counted the tests to be few enough to
    broadcast.
    """
    total = total_weight(samples) if total is None else total
    member = F.concat(F.array("a", "b"), "given")
    keyed = tests.select(*TEST, F.array_sort(member).alias("members"))
    sets = cut_lineage(keyed.select("members").distinct())
    counted = _support_cells(samples, sets) if _supports_take_less(samples, sets) else _met_cells(samples, sets, total, few)
    place = F.transform(member, lambda m: F.array_position("members", m).cast("int"))
    cells = keyed.withColumn("at", place).join(counted, "members")
    code = lambda p: F.element_at("code", p)
    return cells.select(
        *TEST,
        F.transform(F.slice("at", 3, F.size("given")), code).alias("s"),
        code(F.col("at")[0]).alias("x"),
        code(F.col("at")[1]).alias("y"),
        "cnt",
    )


def _supports_take_less(samples: DataFrame, sets: DataFrame) -> bool:
    """Whether item sets give the cells of variable sets in fewer rows than rows that meet these sets."""
    size = F.size("members")
    parts, pairs, most = sets.agg(F.sum(F.pow(F.lit(2.0), size)), F.sum(F.pow(F.lit(3.0), size)), F.max(size)).first()
    if not parts:
        return False
    asked = sets.select(F.explode("members").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    held = samples.select(F.explode("items.v").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("rows"))
    meetings = held.join(asked, "v").agg(F.sum(F.col("n").cast("double") * F.col("rows"))).first()[0] or 0
    term = held_sets = F.lit(1.0)
    for i in range(most):
        term = term * (F.size("items") - i) / (i + 1)
        held_sets = held_sets + term
    grown = samples.agg(F.sum(F.least(held_sets, F.lit(float(parts))))).first()[0] or 0
    return grown + pairs < meetings


def _met_cells(samples: DataFrame, sets: DataFrame, total: int, few: bool) -> DataFrame:
    """(members, code, cnt) of sets of variables, from the rows that hold one of their variables.

    A row meets a set once, through the first of its variables that the row holds. The weight that no
    row brings belongs to the cell whose codes are all 0.
    """
    asked = sets.withColumn("v", F.explode("members"))
    rows = samples.select("weight", F.map_from_entries("items").alias("codes"), F.explode("items.v").alias("v"))
    met = rows.join(F.broadcast(asked) if few else small_side(asked), "v")
    held = F.filter("members", lambda m: F.try_element_at(F.col("codes"), m).isNotNull())
    met = met.where(F.element_at(held, 1) == F.col("v"))
    code = F.transform("members", lambda m: F.coalesce(F.try_element_at(F.col("codes"), m), F.lit(0)))
    some = met.groupBy("members", code.alias("code")).agg(F.sum("weight").alias("cnt"))
    brought = some.groupBy("members").agg(F.sum("cnt").alias("brought"))
    rest = sets.join(brought, "members", "left").select(
        "members",
        F.array_repeat(F.lit(0), F.size("members")).alias("code"),
        (F.lit(total) - F.coalesce("brought", F.lit(0))).alias("cnt"),
    )
    return some.unionByName(rest.where("cnt > 0"))


def _parts_of_sets(sets: DataFrame) -> DataFrame:
    """(members, mask, vars): every part of a set; bit i of ``mask`` stands for the i-th member."""
    whole = (F.pow(F.lit(2.0), F.size("members")) - 1).cast("int")
    masked = sets.withColumn("mask", F.explode(F.sequence(F.lit(0), whole)))
    has = lambda m, i: F.getbit("mask", i) == 1
    return masked.withColumn("vars", F.filter("members", has))


def item_supports(samples: DataFrame, wanted: DataFrame) -> DataFrame:
    """(vars, codes, n): the weight of the rows that hold these codes of the variables ``wanted`` (vars).

    With a set its leading parts must be wanted, too: a row grows its sets by one item at a time, in the
    order of the variables, and goes on with those that are wanted only.
    """
    known = small_side(wanted)
    most = known.agg(F.max(F.size("vars"))).first()[0] or 0
    none, item = F.array().cast("array<int>"), "struct<v:int,c:int>"
    empty = F.array().cast(f"array<{item}>")
    rows = samples.select("weight", none.alias("vars"), none.alias("codes"), F.col("items").cast(f"array<{item}>").alias("left"))
    taken = F.col("x").isNotNull()
    for _ in range(most):
        # no item: the set is done and has none left to grow by
        choice = F.concat("left", F.array(F.lit(None).cast(item)))
        rows = rows.select("*", F.posexplode(choice).alias("i", "x")).select(
            "weight",
            F.when(taken, F.concat("vars", F.array("x.v"))).otherwise(F.col("vars")).alias("vars"),
            F.when(taken, F.concat("codes", F.array("x.c"))).otherwise(F.col("codes")).alias("codes"),
            F.when(taken, F.slice("left", F.col("i") + 2, F.size("left"))).otherwise(empty).alias("left"),
        )
        rows = rows.join(known, "vars")
    return rows.groupBy("vars", "codes").agg(F.sum("weight").alias("n"))


def _support_cells(samples: DataFrame, sets: DataFrame) -> DataFrame:
    """(members, code, cnt) of sets of variables, by inclusion and exclusion of the weights of item sets.

    The weight of an item set counts for each of its parts, whose other codes are then 0, with a
    sign that alternates with the number of items left out.
    """
    parts = _parts_of_sets(sets)
    supports = item_supports(samples, parts.select("vars").distinct())
    part = F.explode(F.filter(F.sequence(F.lit(0), F.col("mask")), lambda t: t.bitwiseOR(F.col("mask")) == F.col("mask")))
    signed = parts.join(supports, "vars").withColumn("part", part)
    left_out = F.bit_count("mask") - F.bit_count("part")
    code_of = F.map_from_arrays("vars", "codes")
    code = F.transform(
        "members", lambda m, i: F.when(F.getbit("part", i) == 1, F.element_at(F.col("code_of"), m)).otherwise(0)
    )
    signed = signed.withColumn("code_of", code_of).select(
        "members", code.alias("code"), F.when(left_out % 2 == 0, F.col("n")).otherwise(-F.col("n")).alias("n")
    )
    return signed.groupBy("members", "code").agg(F.sum("n").alias("cnt")).where("cnt > 0")


def independence(cells: DataFrame, keys: Sequence[str] = TEST, kind: str = "chi2") -> DataFrame:
    """Statistic and degrees of freedom per test, summed over its slices ``s``.

    Only non-empty margins of a slice count towards its freedom.
    """
    at = [*keys, "s"]
    # All windows refine one hash partitioning by the test keys.
    placed = cells.repartition(*keys)
    total = lambda *k: F.sum("cnt").over(Window.partitionBy(*at, *k))
    margins = placed.withColumn("_r", total("x")).withColumn("_c", total("y")).withColumn("_n", total())
    expected = F.col("_r") * F.col("_c") / F.col("_n")
    per_slice = margins.groupBy(*at).agg(
        F.sum(_term(kind, F.col("cnt"), expected)).alias("stat"),
        ((F.count_distinct("x") - 1) * (F.count_distinct("y") - 1)).alias("dof"),
    )
    return per_slice.groupBy(*keys).agg(F.sum("stat").alias("stat"), F.sum("dof").alias("dof"))


def with_p(stats: DataFrame) -> DataFrame:
    return stats.withColumn("p", chi2_p("stat", "dof"))


def pair_tests(samples: DataFrame, variables: DataFrame, kind: str = "chi2") -> DataFrame:
    """Unconditional test of every variable pair: (x, y, stat, dof, p), by name."""
    return with_p(name_pairs(pair_independence(samples, variables.count(), kind), variables))


def name_pairs(pairs: DataFrame, variables: DataFrame) -> DataFrame:
    """Replace variable numbers a, b by names x, y."""
    names = small_side(variables.select("v", "name"))
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    for number, name in (("a", "_x"), ("b", "_y")):
        pairs = pairs.join(names.withColumnsRenamed({"v": number, "name": name}), number)
    return pairs.select(F.col("_x").alias("x"), F.col("_y").alias("y"), *rest)


def pair_table(cells: DataFrame) -> DataFrame:
    """2x2 counts n11, n10, n01, n00 per pair of binary variables."""
    n = lambda i, j: F.sum(F.when((F.col("x") == i) & (F.col("y") == j), F.col("cnt")).otherwise(0))
    return cells.groupBy("a", "b").agg(
        n(1, 1).alias("n11"), n(1, 0).alias("n10"), n(0, 1).alias("n01"), n(0, 0).alias("n00")
    )


def correlations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One pass over the rows: (x, y, n, r) for every column pair."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    cells = [
        F.struct(
            F.lit(a).alias("x"),
            F.lit(b).alias("y"),
            F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"),
            F.corr(a, b).alias("r"),
        )
        for a, b in pairs
    ]
    return rows.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def fisher_z(correlated: DataFrame) -> DataFrame:
    """Fisher-Z statistic and two-sided p for each correlation."""
    r = F.col("r")
    z = F.lit(0.5) * F.log((1 + r) / (1 - r)) * F.sqrt(F.col("n") - 3)
    return correlated.withColumn("z", z).withColumn("p", normal_p("z"))


#: Residual variance under which a variable counts as explained by the others.
EXPLAINED = 1e-12


def partial_z(tests: DataFrame, correlated: DataFrame) -> DataFrame:
    """Fisher-Z tests (a, b, given, stat, dof, p) from correlations (a, b, n, r) with a < b.

    The correlations of a test's variables are gathered in one row and the conditioning variables
    swept out one after another: what is left is the partial correlation. A conditioning variable
    that the earlier ones explain adds nothing; a tested one without residual is independent. A
    constant column correlates with nothing. ``n`` is the least of the pairs', for columns with nulls.
    """
    k = F.size("given") + 2
    members = F.concat(F.array("a", "b"), "given")
    ends = F.flatten(
        F.transform(
            F.sequence(F.lit(0), k - 2),
            lambda i: F.transform(F.sequence(i + 1, k - 1), lambda j: F.struct(i.alias("i"), j.alias("j"))),
        )
    )
    asked = tests.select(*TEST, members.alias("m"), k.alias("k"), F.inline(ends))
    at = lambda end: F.element_at("m", F.col(end) + 1)
    asked = asked.withColumn("low", F.least(at("i"), at("j"))).withColumn("high", F.greatest(at("i"), at("j")))
    known = small_side(correlated.select(F.col("a").alias("low"), F.col("b").alias("high"), "n", F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0)).alias("r")))
    entry = F.struct((F.col("i") * F.col("k") + F.col("j")).alias("at"), "r")
    gathered = asked.join(known, ["low", "high"]).groupBy(*TEST, "k").agg(
        F.map_from_entries(F.collect_list(entry)).alias("upper"), F.min("n").alias("n")
    )
    row, col = lambda p: F.floor(p / F.col("k")), lambda p: p % F.col("k")
    cell = lambda p: F.when(row(p) == col(p), F.lit(1.0)).otherwise(
        F.try_element_at("upper", (F.least(row(p), col(p)) * F.col("k") + F.greatest(row(p), col(p))).cast("int"))
    )
    whole = F.transform(F.sequence(F.lit(0), F.col("k") * F.col("k") - 1), cell)
    entry_of = lambda m, i, j: F.element_at(m, (i * F.col("k") + j + 1).cast("int"))

    def swept(m: Column, z: Column) -> Column:
        pivot = entry_of(m, z, z)
        gone = lambda v, p: v - entry_of(m, row(p), z) * entry_of(m, z, col(p)) / pivot
        return F.when(pivot > EXPLAINED, F.transform(m, gone)).otherwise(m)

    order = F.when(F.col("k") > 2, F.sequence(F.lit(2), F.col("k") - 1)).otherwise(F.array().cast("array<int>"))
    left = gathered.withColumn("m", whole).withColumn("m", F.aggregate(order, F.col("m"), swept))
    zero, one = F.lit(0), F.lit(1)
    own = entry_of(F.col("m"), zero, zero) * entry_of(F.col("m"), one, one)
    r = F.when(own > EXPLAINED, entry_of(F.col("m"), zero, one) / F.sqrt(own)).otherwise(0.0)
    r = F.greatest(F.lit(-0.999999999), F.least(F.lit(0.999999999), r))
    z = 0.5 * F.log((1 + r) / (1 - r)) * F.sqrt(F.greatest(F.col("n") - F.col("k") - 1, F.lit(0)).cast("double"))
    return left.select(*TEST, z.alias("stat"), F.lit(1).cast("long").alias("dof")).withColumn("p", normal_p("stat"))
