"""End-to-end runs on template logs: (source, line_no, template) in, typed edges and reports out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import graph, granger, matrix, pc, windows
from tracewell.session import cut_lineage, materialize


@dataclass
class Windowed:
    """Window samples of a log with the facts behind them."""

    samples: DataFrame
    templates: DataFrame
    quality: DataFrame


def windowed_dataset(lines: DataFrame, window_size: int | None = None, min_freq: int = 5) -> Windowed:
    """Frequent lines, cut into sliding windows, as sparse samples.

    Without a size each source gets the largest window that leaves enough samples per template.
    The distinct window sizes (at most 29) give one sliding pass each.
    """
    # Read by the size choice, the name list and every window size.
    kept = materialize(windows.frequent_lines(lines, min_freq), "frequent-lines")
    sizes = windows.choose_window(kept)
    if window_size is not None:
        sizes = sizes.withColumn("window_size", F.lit(window_size).cast("long"))
    templates = cut_lineage(matrix.variables(kept, "template"))
    if templates.isEmpty():
        raise ValueError("no template is frequent enough")
    sizes = cut_lineage(sizes)
    sets = None
    for (w,) in sizes.select("window_size").distinct().orderBy("window_size").collect():
        part = kept
        if window_size is None:
            part = kept.join(sizes.filter(F.col("window_size") == w).select("source"), "source", "left_semi")
        one = windows.window_sets(part, w)
        sets = one if sets is None else sets.unionByName(one)
    samples = matrix.item_samples(matrix.set_patterns(sets), templates)
    return Windowed(samples, templates, windows.matrix_quality(sizes))


def pc_from_log(
    lines: DataFrame,
    window_size: int | None = None,
    min_freq: int = 5,
    kind: str = "chi2",
    alpha: float = 0.01,
    max_level: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Typed edges, one-row report and largest p per pair of the PC graph over a template log."""
    data = windowed_dataset(lines, window_size, min_freq)
    found = pc.discover(data.samples, data.templates, kind, alpha, max_level)
    edges = pc.typed_edges(found)
    return edges, graph.edge_report(edges, data.templates.count()), pc.max_p(found)


def pc_from_baskets(
    lined: DataFrame, row_id: str, kind: str = "gsq", alpha: float = 0.05, max_level: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Typed edges and first-parent / first-child table over ', '-separated lines."""
    members = matrix.basket_members(lined, row_id)
    nodes = members.select(F.col("var").alias("template")).distinct()
    variables = matrix.variables(members, "var")
    samples = matrix.item_samples(matrix.set_patterns(matrix.row_sets(members)), variables)
    edges = pc.typed_edges(pc.discover(samples, variables, kind, alpha, max_level))
    return edges, graph.first_neighbours(nodes, edges)


def bin_samples(binned: DataFrame, variables: DataFrame) -> DataFrame:
    """Template counts per bin as sparse samples: templates are variables, bins samples."""
    return matrix.counted_samples(binned, ["source", "bin"], "template", variables)


def compare_on_bins(
    binned: DataFrame, variables: DataFrame, alpha: float = 0.01, max_level: int | None = None
) -> DataFrame:
    """Edges of the chi-square graph and the G-square skeleton over bin counts."""
    return pc.compare_tests(bin_samples(binned, variables), variables, alpha, max_level)


def granger_from_log(lines: DataFrame, min_freq: int = 5, maxlag: int = 3) -> tuple[DataFrame, DataFrame]:
    """Weighted edges and a one-row report of the lagged LASSO over a template log."""
    slots = materialize(windows.frequent_slots(lines, min_freq), "slots")
    variables = cut_lineage(matrix.variables(slots, "template"))
    if variables.isEmpty():
        raise ValueError("no template is frequent enough")
    edges = granger.granger_lasso(slots, variables, maxlag)
    report = edges.agg(
        F.lit(variables.count()).cast("long").alias("n_variables"), F.count(F.lit(1)).alias("n_relations")
    )
    return edges, report
