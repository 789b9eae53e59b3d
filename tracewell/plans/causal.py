"""Independence tests, PC and Granger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import citest, granger, matrix, pc, windows
from tracewell.plans import discovery
from tracewell.plans.fragments import BASKETS, SERIES
from tracewell.sources import tables

ALPHA = 0.01
WINDOW = 3
CONTINUOUS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def basket_samples(spark, sf):
    """Brand baskets of the orders as sparse samples, and the brands."""
    brands = matrix.variables(tables.table(spark, sf, "part"), "p_brand")
    sets = matrix.row_sets(tables.basket_items(spark, sf))
    return matrix.item_samples(matrix.set_patterns(sets), brands), brands


def window_samples(spark, sf, w=WINDOW):
    """Sliding windows of the event series as sparse samples, and the templates."""
    templates = matrix.variables(tables.events(spark, sf), "template")
    sets = windows.window_sets(tables.series(spark, sf), w)
    return matrix.item_samples(matrix.set_patterns(sets), templates), templates


def _statistics(kind):
    def run(spark, sf):
        out = citest.pair_tests(*basket_samples(spark, sf), kind)
        return out.select("x", "y", F.round("stat", 6).alias("stat"), "dof", (F.col("p") <= ALPHA).alias("dependent"))

    return run


def pair_contingency(spark, sf):
    samples, brands = basket_samples(spark, sf)
    cells = citest.pair_cells(samples, brands.count())
    return citest.name_pairs(citest.pair_table(cells), brands)


def row_patterns(spark, sf):
    sets = matrix.row_sets(tables.basket_items(spark, sf))
    return matrix.set_patterns(sets).select(F.array_join("items", ",").alias("pattern"), "weight")


def basket_matrix(spark, sf):
    # Each item is a basket line of its own, so the length of an order does not matter.
    return matrix.basket_members(tables.order_items(spark, sf), "group_id", "item").distinct()


def discretize_uniform(spark, sf):
    item = tables.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *CONTINUOUS)
    return matrix.discretize(item, CONTINUOUS, 5)


def chi2_multivalued(spark, sf):
    names = ["l_discount", "l_linestatus", "l_quantity", "l_returnflag", "l_tax"]
    item = tables.table(spark, sf, "lineitem").select(*names)
    coded = matrix.discretize(item, ["l_discount", "l_quantity", "l_tax"], 5)
    coded = matrix.coded_names(matrix.coded_names(coded, "l_returnflag"), "l_linestatus")
    stats = citest.pair_tests(matrix.coded_samples(coded, names), matrix.listed_variables(spark, names))
    return stats.select("x", "y", F.round("stat", 6).alias("stat"), "dof")


def fisherz_pairs(spark, sf):
    item = tables.table(spark, sf, "lineitem").select(*CONTINUOUS)
    z = citest.fisher_z(citest.correlations(item, CONTINUOUS))
    return z.select("x", "y", "n", F.round("r", 6).alias("r"), F.round("z", 4).alias("z"))


def pc_skeleton(spark, sf):
    return pc.skeleton_edges(pc.discover(*window_samples(spark, sf), "gsq", ALPHA, 3))


def pc_orient(spark, sf):
    return pc.typed_edges(pc.discover(*window_samples(spark, sf), "chi2", ALPHA))


def pc_fisherz(spark, sf):
    sizes = tables.doc_sizes(spark, sf)
    names = matrix.listed_variables(spark, sizes.columns)
    return pc.typed_edges(pc.discover_gaussian(citest.correlations(sizes, sizes.columns), names))


def _traits_graph(spark, sf):
    traits = tables.doc_traits(spark, sf)
    names = matrix.listed_variables(spark, traits.columns)
    return pc.discover(matrix.coded_samples(traits, traits.columns), names, "chi2", ALPHA)


def pc_skeleton_traits(spark, sf):
    return pc.skeleton_edges(_traits_graph(spark, sf))


def pc_orient_traits(spark, sf):
    return pc.typed_edges(_traits_graph(spark, sf))


def chi2_bins(spark, sf):
    """Pair tests over template counts per bin: multi-valued variables."""
    binned = windows.bins_clamped(tables.series(spark, sf), 10, tables.flat_series(spark, sf))
    templates = matrix.variables(tables.events(spark, sf), "template")
    stats = citest.pair_tests(discovery.bin_samples(binned, templates), templates)
    return stats.select("x", "y", F.round("stat", 6).alias("stat"), "dof")


def pair_pmax(spark, sf):
    graph = pc.discover(*basket_samples(spark, sf), "chi2", ALPHA, max_level=3)
    return pc.max_p(graph).withColumn("p_max", F.round("p_max", 4))


def test_compare(spark, sf):
    return pc.compare_tests(*window_samples(spark, sf), ALPHA, 3)


def pc_var_subset(spark, sf):
    """The test and its decision for a chosen pair of templates only."""
    pair = matrix.listed_variables(spark, ["click", "error"])
    sets = windows.window_sets(tables.series(spark, sf), WINDOW)
    graph = pc.discover(matrix.item_samples(matrix.set_patterns(sets), pair), pair, "chi2", ALPHA)
    return pc.test_table(graph).select(
        "x", "y", F.round("stat", 6).alias("stat"), "dof", (F.col("p") <= ALPHA).alias("dependent")
    )


def granger_lasso(spark, sf):
    edges, _ = discovery.granger_from_log(tables.turns(spark, sf), min_freq=1)
    return edges.withColumn("coefficient", F.round("coefficient", 6))


def granger_moments(spark, sf):
    flat = tables.flat_series(spark, sf)
    slots = windows.frequent_slots(tables.series(spark, sf), unordered=flat)
    return granger.moments(granger.lag_tuples(slots, unordered=flat))


QUERIES = {
    "basket_matrix": basket_matrix,
    "row_patterns": row_patterns,
    "discretize_uniform": discretize_uniform,
    "pair_contingency": pair_contingency,
    "chi2_pairs": _statistics("chi2"),
    "gsq_pairs": _statistics("gsq"),
    "chi2_multivalued": chi2_multivalued,
    "fisherz_pairs": fisherz_pairs,
    "pc_skeleton": pc_skeleton,
    "pc_orient": pc_orient,
    "pc_fisherz": pc_fisherz,
    "pc_skeleton_traits": pc_skeleton_traits,
    "pc_orient_traits": pc_orient_traits,
    "chi2_bins": chi2_bins,
    "pair_pmax": pair_pmax,
    "test_compare": test_compare,
    "pc_var_subset": pc_var_subset,
    "granger_moments": granger_moments,
    "granger_lasso": granger_lasso,
}

# Upper 1 % points of chi-square with 1 to 16 degrees of freedom.
CRITICAL = [
    6.634896601, 9.210340372, 11.34486673, 13.27670414, 15.08627247, 16.81189383, 18.47530691,
    20.09023503, 21.66599433, 23.20925116, 24.72497031, 26.21696731, 27.68824961, 29.14123774,
    30.57791417, 31.99992691,
]

_BASKET_PATTERNS = (
    BASKETS
    + """, na AS (SELECT DISTINCT p_brand AS var FROM part)
, rp AS (SELECT row_id, list(var ORDER BY var) AS items FROM bk GROUP BY row_id)
, pt AS (SELECT items, count(*) AS w FROM rp GROUP BY items)
, pi AS (SELECT row_number() OVER () AS pid, items, w FROM pt)
, va AS (SELECT pid, w, var, CASE WHEN list_contains(items, var) THEN 1 ELSE 0 END AS bit FROM pi, na)"""
)

_WINDOW_PATTERNS = (
    SERIES
    + f""", n AS (SELECT source, count(*) AS n FROM se GROUP BY source)
, wi AS (SELECT a.source, a.line_no, list(DISTINCT b.template) AS items FROM se a
  JOIN n ON a.source = n.source AND a.line_no <= n.n - {WINDOW}
  JOIN se b ON a.source = b.source AND b.line_no BETWEEN a.line_no AND a.line_no + {WINDOW - 1} GROUP BY ALL)
, na AS (SELECT DISTINCT template AS var FROM se)
, pt AS (SELECT list_sort(items) AS items, count(*) AS w FROM wi GROUP BY ALL)
, pi AS (SELECT row_number() OVER () AS pid, items, w FROM pt)
, va AS (SELECT pid, w, var, CASE WHEN list_contains(items, var) THEN 1 ELSE 0 END AS bit FROM pi, na)"""
)


_TRAIT_PATTERNS = """tr AS (
  SELECT CASE WHEN regexp_matches(text, '[0-9]') THEN 1 ELSE 0 END AS digit, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS english,
         CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS long, CASE WHEN contains(text, '@') THEN 1 ELSE 0 END AS mail,
         CASE WHEN contains(text, chr(10)) THEN 1 ELSE 0 END AS multiline, CASE WHEN contains(text, 'http') THEN 1 ELSE 0 END AS url
  FROM documents)
, pt AS (SELECT *, count(*) AS w FROM tr GROUP BY ALL)
, pi AS (SELECT row_number() OVER () AS pid, * FROM pt)
, va AS (UNPIVOT pi ON digit, english, long, mail, multiline, url INTO NAME var VALUE bit)
, na AS (SELECT DISTINCT var FROM va)"""


def _stat_term(kind):
    if kind == "chi2":
        return "sum(o * o / (r * c / n) - o)"
    return "sum(2 * o * ln(o / (r * c / n)))"


def _before(level: int, tag: str) -> str:
    return f"g{tag}{level - 1}" if level else "(SELECT a.var AS x, b.var AS y FROM na a JOIN na b ON a.var <> b.var)"


def _tests_sql(level: int, tag: str) -> str:
    """Tests of a level on the frozen graph: pairs x < y and sets of neighbours of either end."""
    before, out = _before(level, tag), f"{tag}{level}"
    if level == 0:
        return f"t{out} AS (SELECT x, y FROM {before} WHERE x < y)"
    halves = []
    for end, other in (("x", "y"), ("y", "x")):
        joins = "".join(f" JOIN {before} k{i} ON k{i}.x = g.{end} AND k{i}.y <> g.{other}" for i in range(level))
        order = "".join(f" AND k{i - 1}.y < k{i}.y" for i in range(1, level))
        picked = "".join(f", k{i}.y AS s{i}" for i in range(level))
        halves.append(f"SELECT g.x, g.y{picked} FROM {before} g{joins} WHERE g.x < g.y{order}")
    return f"t{out} AS ({' UNION '.join(halves)})"


def _survivors_sql(level: int, tag: str) -> str:
    out = f"{tag}{level}"
    return f"""g{out} AS MATERIALIZED (SELECT x, y FROM {_before(level, tag)} g WHERE NOT EXISTS
  (SELECT 1 FROM d{out} d WHERE d.independent AND ((d.x = g.x AND d.y = g.y) OR (d.x = g.y AND d.y = g.x))))"""


def _level_sql(level: int, kind: str, tag: str = "") -> str:
    """CTEs of one level: tests on the frozen graph, cells, statistics, surviving graph."""
    s = [f"s{i}" for i in range(level)]
    cols = "".join(f", t.{c}" for c in s)
    out = f"{tag}{level}"
    slices = "".join(f" JOIN va v{i} ON v{i}.pid = a.pid AND v{i}.var = t.s{i}" for i in range(level))
    code = " || ".join(f"v{i}.bit" for i in range(level)) or "''"
    group = "x, y" + "".join(f", {c}" for c in s)
    critical = ", ".join(f"({i + 1}, {c})" for i, c in enumerate(CRITICAL))
    return f"""{_tests_sql(level, tag)}
, c{out} AS (SELECT t.x, t.y{cols}, CAST({code} AS VARCHAR) AS z, a.bit AS xb, b.bit AS yb, sum(a.w)::DOUBLE AS o
  FROM t{out} t JOIN va a ON a.var = t.x JOIN va b ON b.pid = a.pid AND b.var = t.y{slices} GROUP BY ALL)
, m{out} AS (SELECT *, sum(o) OVER (PARTITION BY {group}, z, xb) AS r, sum(o) OVER (PARTITION BY {group}, z, yb) AS c,
  sum(o) OVER (PARTITION BY {group}, z) AS n FROM c{out})
, z{out} AS (SELECT {group}, z, {_stat_term(kind)} AS stat, (count(DISTINCT xb) - 1) * (count(DISTINCT yb) - 1) AS dof FROM m{out} GROUP BY ALL)
, r{out} AS (SELECT {group}, sum(stat) AS stat, CAST(sum(dof) AS BIGINT) AS dof FROM z{out} GROUP BY ALL)
, d{out} AS MATERIALIZED (SELECT r.*, coalesce(stat < crit, true) AS independent FROM r{out} r
  LEFT JOIN (SELECT * FROM (VALUES {critical}) q(k, crit)) q ON q.k = r.dof)
, {_survivors_sql(level, tag)}"""


def _skeleton_sql(kind: str, levels: int, tag: str = "") -> str:
    return "\n, ".join(_level_sql(i, kind, tag) for i in range(levels + 1))


def _oriented_sql(levels: int, rounds: int = 12) -> str:
    """CTEs and final SELECT of the typed edges of the graph ``g<levels>``; rounds are unrolled."""
    given = [f"[{', '.join(f's{i}' for i in range(level))}]::VARCHAR[]" for level in range(levels + 1)]
    sets = " UNION ALL ".join(f"SELECT x, y, {g} AS given FROM d{i} WHERE independent" for i, g in enumerate(given))
    out = f"""sp AS (SELECT x, y, min(given) AS given FROM ({sets}) GROUP BY ALL)
, nr AS MATERIALIZED (SELECT x, y FROM g{levels})
, ca AS MATERIALIZED (SELECT row_number() OVER (ORDER BY a.x, b.x, a.y) AS k, a.x, b.x AS y, a.y AS z
  FROM nr a JOIN nr b ON a.y = b.y AND a.x < b.x JOIN sp ON sp.x = a.x AND sp.y = b.x
  WHERE NOT list_contains(given, a.y) AND NOT EXISTS (SELECT 1 FROM nr n WHERE n.x = a.x AND n.y = b.x))
, ha AS MATERIALIZED (SELECT k, x AS s, z AS t FROM ca UNION ALL SELECT k, y, z FROM ca)
, co AS MATERIALIZED (SELECT DISTINCT j.k AS early, i.k AS late FROM ha i JOIN ha j ON i.s = j.t AND i.t = j.s AND j.k < i.k)
, st0 AS MATERIALIZED (SELECT k, 'open' AS state FROM ca)"""
    for r in range(rounds):
        out += f"""
, st{r + 1} AS MATERIALIZED (SELECT c.k, CASE WHEN c.state <> 'open' THEN c.state
    WHEN EXISTS (SELECT 1 FROM co JOIN st{r} e ON e.k = early WHERE late = c.k AND e.state = 'taken') THEN 'lost'
    WHEN EXISTS (SELECT 1 FROM co JOIN st{r} e ON e.k = early WHERE late = c.k AND e.state = 'open') THEN 'open'
    ELSE 'taken' END AS state FROM st{r} c)"""
    out += f"\n, w0 AS MATERIALIZED (SELECT DISTINCT s, t FROM ha JOIN st{rounds} USING (k) WHERE state = 'taken')"
    for r in range(rounds):
        out += f"""
, p{r} AS MATERIALIZED (SELECT x AS s, y AS t FROM nr WHERE NOT EXISTS (SELECT 1 FROM w{r} w WHERE (w.s = x AND w.t = y) OR (w.s = y AND w.t = x)))
, f{r} AS MATERIALIZED (SELECT p.s, p.t, q.t AS c FROM p{r} p JOIN p{r} q ON q.s = p.s JOIN w{r} w ON w.s = q.t AND w.t = p.t)
, n{r} AS MATERIALIZED (
  SELECT p.s, p.t FROM p{r} p JOIN w{r} w ON w.t = p.s WHERE NOT EXISTS (SELECT 1 FROM nr n WHERE n.x = w.s AND n.y = p.t) AND w.s <> p.t
  UNION SELECT p.s, p.t FROM p{r} p JOIN w{r} w ON w.s = p.s JOIN w{r} v ON v.s = w.t AND v.t = p.t
  UNION SELECT a.s, a.t FROM f{r} a JOIN f{r} b ON a.s = b.s AND a.t = b.t AND a.c < b.c
    WHERE NOT EXISTS (SELECT 1 FROM nr n WHERE n.x = a.c AND n.y = b.c))
, w{r + 1} AS MATERIALIZED (SELECT s, t FROM w{r} UNION
  SELECT s, t FROM n{r} n WHERE s < t OR NOT EXISTS (SELECT 1 FROM n{r} m WHERE m.s = n.t AND m.t = n.s))"""
    return out + f"""
SELECT e.x AS source, e.y AS target, CASE WHEN a.s IS NULL THEN 'undirected' WHEN b.s IS NULL THEN 'directed' ELSE 'bidirectional' END AS relation
FROM nr e LEFT JOIN w{rounds} a ON a.s = e.x AND a.t = e.y LEFT JOIN w{rounds} b ON b.s = e.y AND b.t = e.x
WHERE a.s IS NOT NULL OR b.s IS NULL"""


def _fisherz_sql() -> str:
    """PC over the four size measures: partial correlations by recursion, then the orientation."""
    levels, names = 2, ["chars", "commas", "lines", "words"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    corr = " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r FROM sz" for a, b in pairs)
    out = f"""si AS (SELECT n_chars::DOUBLE AS chars, (length(text) - length(replace(text, ',', '')))::DOUBLE AS commas,
    len(string_split(text, chr(10)))::DOUBLE AS lines, len(string_split(text, ' '))::DOUBLE AS words FROM documents)
, sz AS (SELECT * FROM si WHERE chars IS NOT NULL AND commas IS NOT NULL)
, na AS (SELECT unnest({names}) AS var)
, nn AS (SELECT count(*) AS n FROM sz)
, c0 AS ({corr})
, q0 AS (SELECT x, y, r FROM c0 UNION ALL SELECT y, x, r FROM c0)"""
    for level in range(1, levels + 1):
        have = "".join(f", a.s{i}" for i in range(level - 1))
        same = lambda e: "".join(f" AND a.s{i} = {e}.s{i}" for i in range(level - 1))
        fresh = "".join(f" AND b.y <> a.s{i}" for i in range(level - 1))
        out += f"""
, q{level} AS (SELECT a.x, a.y{have}, b.y AS s{level - 1}, (a.r - b.r * c.r) / sqrt((1 - b.r * b.r) * (1 - c.r * c.r)) AS r
  FROM q{level - 1} a JOIN q{level - 1} b ON b.x = a.x{same('b')} AND b.y <> a.y{fresh}
  JOIN q{level - 1} c ON c.x = a.y AND c.y = b.y{same('c')})"""
    for level in range(levels + 1):
        given = "".join(f" AND q.s{i} = t.s{i}" for i in range(level))
        out += f"""
, {_tests_sql(level, '')}
, d{level} AS MATERIALIZED (SELECT t.*, abs(atanh(q.r)) * sqrt(n - {level + 3}) < 1.959963984540054 AS independent
  FROM t{level} t JOIN q{level} q ON q.x = t.x AND q.y = t.y{given}, nn)
, {_survivors_sql(level, '')}"""
    return f"WITH {out}\n, {_oriented_sql(levels)}"


# Complementary error function by its published rational-exponential fit (error below 1.2e-7).
_ERFC = """t * exp(-z * z - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806
  + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277)))))))))"""

_PMAX = f"""al AS (SELECT x, y, greatest(stat, 0) AS stat, dof FROM r0 UNION ALL SELECT x, y, greatest(stat, 0), dof FROM r1)
, zz AS (SELECT *, sqrt(stat / 2) AS z, 1 / (1 + 0.5 * sqrt(stat / 2)) AS t FROM al)
, pp AS (SELECT x, y, CASE dof WHEN 0 THEN 1.0 WHEN 1 THEN {_ERFC} ELSE exp(-stat / 2) END AS p FROM zz)
SELECT x, y, round(max(p), 4) AS p_max, count(*) AS n_tests FROM pp GROUP BY x, y HAVING max(p) > 0"""

_BIN5 = """CASE WHEN hi_{c} > lo_{c} THEN greatest(0, least(4, floor(({c} - lo_{c}) * 5 / (hi_{c} - lo_{c})))) ELSE 0 END::BIGINT AS {c}"""


def _ranges(columns):
    return ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in columns)


def _chi2_multivalued_sql():
    columns = ["l_discount", "l_quantity", "l_tax"]
    names = ["l_discount", "l_linestatus", "l_quantity", "l_returnflag", "l_tax"]
    coded = ", ".join(_BIN5.format(c=c) for c in columns)
    pairs = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            pairs.append(
                f"SELECT '{a}' AS x, '{b}' AS y, CAST({a} AS VARCHAR) AS xb, CAST({b} AS VARCHAR) AS yb, count(*)::DOUBLE AS o FROM co GROUP BY ALL"
            )
    return f"""WITH rg AS (SELECT {_ranges(columns)} FROM lineitem),
        co AS (SELECT l_linestatus, l_returnflag, {coded} FROM lineitem, rg),
        ce AS ({' UNION ALL '.join(pairs)}),
        m AS (SELECT *, sum(o) OVER (PARTITION BY x, y, xb) AS r, sum(o) OVER (PARTITION BY x, y, yb) AS c, sum(o) OVER (PARTITION BY x, y) AS n FROM ce)
        SELECT x, y, round(sum(o * o / (r * c / n) - o), 6) AS stat, (count(DISTINCT xb) - 1) * (count(DISTINCT yb) - 1) AS dof FROM m GROUP BY x, y"""


def _chi2_bins_sql():
    return f"""WITH {SERIES}, b AS (SELECT source, template,
            least(line_no // 10 + 1, greatest(1, count(*) OVER (PARTITION BY source) // 10)) AS bin FROM se),
        t AS (SELECT DISTINCT template FROM se), d AS (SELECT DISTINCT source, bin FROM b),
        v AS (SELECT d.source, d.bin, t.template, count(b.bin) AS k FROM d CROSS JOIN t
          LEFT JOIN b ON b.source = d.source AND b.bin = d.bin AND b.template = t.template GROUP BY ALL),
        ce AS (SELECT p.template AS x, q.template AS y, p.k AS xb, q.k AS yb, count(*)::DOUBLE AS o
          FROM v p JOIN v q ON p.source = q.source AND p.bin = q.bin AND p.template < q.template GROUP BY ALL),
        m AS (SELECT *, sum(o) OVER (PARTITION BY x, y, xb) AS r, sum(o) OVER (PARTITION BY x, y, yb) AS c, sum(o) OVER (PARTITION BY x, y) AS n FROM ce)
        SELECT x, y, round(sum(o * o / (r * c / n) - o), 6) AS stat, (count(DISTINCT xb) - 1) * (count(DISTINCT yb) - 1) AS dof FROM m GROUP BY x, y"""


def _statistics_sql(kind):
    return f"""WITH {_BASKET_PATTERNS}, {_level_sql(0, kind)}
        SELECT x, y, round(stat, 6) AS stat, dof, NOT independent AS dependent FROM d0"""


def _correlation_sql():
    pairs = [(a, b) for i, a in enumerate(CONTINUOUS) for b in CONTINUOUS[i + 1 :]]
    rows = " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, count(*) AS n, corr({a}, {b}) AS r FROM lineitem" for a, b in pairs
    )
    return f"WITH c AS ({rows}) SELECT x, y, n, round(r, 6) AS r, round(0.5 * ln((1 + r) / (1 - r)) * sqrt(n - 3), 4) AS z FROM c"


_FOLD = """CASE WHEN i < (m // 5 + 1) * (m % 5) THEN i // (m // 5 + 1)
  ELSE m % 5 + (i - (m // 5 + 1) * (m % 5)) // greatest(m // 5, 1) END"""

SQL = {
    "basket_matrix": f"WITH {BASKETS} SELECT row_id, var FROM bk",
    "row_patterns": f"""WITH {BASKETS}, rp AS (SELECT row_id, string_agg(var, ',' ORDER BY var) AS pattern FROM bk GROUP BY row_id)
        SELECT pattern, count(*) AS weight FROM rp GROUP BY pattern""",
    "discretize_uniform": f"""WITH rg AS (SELECT {_ranges(CONTINUOUS)} FROM lineitem)
        SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {', '.join(_BIN5.format(c=c) for c in CONTINUOUS)} FROM lineitem, rg""",
    "pair_contingency": f"""WITH {_BASKET_PATTERNS}
        SELECT a.var AS x, b.var AS y, CAST(sum(a.w) FILTER (WHERE a.bit = 1 AND b.bit = 1) AS BIGINT) AS n11,
        CAST(sum(a.w) FILTER (WHERE a.bit = 1 AND b.bit = 0) AS BIGINT) AS n10, CAST(sum(a.w) FILTER (WHERE a.bit = 0 AND b.bit = 1) AS BIGINT) AS n01,
        CAST(sum(a.w) FILTER (WHERE a.bit = 0 AND b.bit = 0) AS BIGINT) AS n00
        FROM va a JOIN va b ON a.pid = b.pid AND a.var < b.var GROUP BY ALL""",
    "chi2_pairs": _statistics_sql("chi2"),
    "gsq_pairs": _statistics_sql("gsq"),
    "chi2_multivalued": _chi2_multivalued_sql(),
    "fisherz_pairs": _correlation_sql(),
    "pc_skeleton": f"WITH {_WINDOW_PATTERNS}, {_skeleton_sql('gsq', 3)} SELECT x, y FROM g3 WHERE x < y",
    "pc_orient": f"WITH {_WINDOW_PATTERNS}, {_skeleton_sql('chi2', 3)}\n, {_oriented_sql(3)}",
    "pc_orient_traits": f"WITH {_TRAIT_PATTERNS}, {_skeleton_sql('chi2', 4)}\n, {_oriented_sql(4)}",
    "pc_fisherz": _fisherz_sql(),
    "pc_skeleton_traits": f"WITH {_TRAIT_PATTERNS}, {_skeleton_sql('chi2', 4)} SELECT x, y FROM g4 WHERE x < y",
    "chi2_bins": _chi2_bins_sql(),
    "pair_pmax": f"WITH {_BASKET_PATTERNS}, {_skeleton_sql('chi2', 1)}, {_PMAX}",
    "test_compare": f"""WITH {_WINDOW_PATTERNS}, {_skeleton_sql('chi2', 3, 'c')}, {_skeleton_sql('gsq', 3, 'q')}
        SELECT 'chi2' AS test, count(*) AS edges FROM gc3 WHERE x < y UNION ALL SELECT 'gsq', count(*) FROM gq3 WHERE x < y""",
    "pc_var_subset": f"""WITH {_WINDOW_PATTERNS}, {_level_sql(0, 'chi2')}
        SELECT x, y, round(stat, 6) AS stat, dof, NOT independent AS dependent FROM d0 WHERE x = 'click' AND y = 'error'""",
    "granger_moments": f"""WITH {SERIES}, fq AS (SELECT source, template FROM se GROUP BY ALL HAVING count(*) >= 5),
        sl AS (SELECT se.source, line_no, fq.template, count(*) OVER (PARTITION BY se.source) - 3 AS m FROM se
          LEFT JOIN fq ON se.source = fq.source AND se.template = fq.template),
        tu AS (SELECT a.source, a.line_no - 3 AS i, a.m, a.template AS t0, b.template AS t1, c.template AS t2, d.template AS t3
          FROM sl a JOIN sl b ON a.source = b.source AND b.line_no = a.line_no - 1
          JOIN sl c ON a.source = c.source AND c.line_no = a.line_no - 2 JOIN sl d ON a.source = d.source AND d.line_no = a.line_no - 3),
        ce AS (SELECT source, i, {_FOLD} AS fold, unnest([{{l: -1, v: ''}}, {{l: 0, v: t0}}, {{l: 1, v: t1}}, {{l: 2, v: t2}}, {{l: 3, v: t3}}]) AS c FROM tu)
        SELECT a.fold, CAST(a.c.l AS BIGINT) AS la, a.c.v AS va, CAST(b.c.l AS BIGINT) AS lb, b.c.v AS vb, count(*) AS cnt
        FROM ce a JOIN ce b ON a.source = b.source AND a.i = b.i AND a.c.l <= b.c.l
        WHERE a.c.v IS NOT NULL AND b.c.v IS NOT NULL GROUP BY ALL""",
}
