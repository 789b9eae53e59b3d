"""Graph operators on edge tables (source, target[, relation])."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import cut_lineage


def classify_endpoints(endpoints: DataFrame) -> DataFrame:
    """Endpoint table (i, j, at_i, at_j), -1 tail and 1 arrow, to typed edges.

    A directed pair gives one row, the two symmetric kinds one row per direction.
    """
    a, b = F.col("at_i"), F.col("at_j")
    edge = lambda s, t, kind: F.struct(
        F.col(s).alias("source"), F.col(t).alias("target"), F.lit(kind).alias("relation")
    )
    both = lambda kind: F.array(edge("i", "j", kind), edge("j", "i", kind))
    edges = (
        F.when((a == -1) & (b == 1), F.array(edge("i", "j", "directed")))
        .when((a == 1) & (b == -1), F.array(edge("j", "i", "directed")))
        .when((a == 1) & (b == 1), both("bidirectional"))
        .when((a == -1) & (b == -1), both("undirected"))
    )
    return endpoints.select(F.inline(edges))


def edge_report(edges: DataFrame, n_variables: int | None = None) -> DataFrame:
    """Variables and edge rows by relation; without a given count, nodes of the edges are counted."""
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node"))
    count = F.lit(n_variables).cast("long") if n_variables is not None else None
    kinds = edges.agg(
        *[F.count_if(F.col("relation") == k).alias(k) for k in ("directed", "bidirectional", "undirected")]
    )
    if count is None:
        count = nodes.agg(F.count_distinct("node")).scalar()
    return kinds.select(count.alias("n_variables"), "directed", "bidirectional", "undirected")


def drop_node(edges: DataFrame, node: str) -> DataFrame:
    return edges.filter((F.col("source") != node) & (F.col("target") != node))


def undirected_pairs(edges: DataFrame) -> DataFrame:
    """Pairs whose edge exists in both directions, once each."""
    a, b = F.least("source", "target"), F.greatest("source", "target")
    ways = edges.filter(F.col("source") != F.col("target")).groupBy(a.alias("x"), b.alias("y"))
    return (
        ways.agg(F.count_distinct("source").alias("ways"))
        .filter(F.col("ways") == 2)
        .select("x", "y")
    )


def simple_graph(edges: DataFrame) -> DataFrame:
    """Undirected simple graph: each adjacent pair once."""
    a, b = F.least("source", "target"), F.greatest("source", "target")
    return edges.filter(a != b).select(a.alias("x"), b.alias("y")).distinct()


def first_neighbours(nodes: DataFrame, edges: DataFrame, missing: str = "NA") -> DataFrame:
    """First parent and first child of each node along directed edges."""
    directed = edges.filter(F.col("relation") == "directed")
    up = directed.groupBy(F.col("target").alias("template")).agg(F.min("source").alias("_up"))
    down = directed.groupBy(F.col("source").alias("template")).agg(F.min("target").alias("_down"))
    return (
        nodes.join(up, "template", "left")
        .join(down, "template", "left")
        .select(
            "template",
            F.coalesce("_up", F.lit(missing)).alias("ancestor"),
            F.coalesce("_down", F.lit(missing)).alias("descendant"),
        )
    )


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, component): the component is named by its least node.

    Each round takes the least label around every node and then follows the label's own label, so
    distances halve. The least-label aggregate combines map-side, which keeps hub nodes harmless.
    """
    there = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    back = edges.select(F.col("target").alias("a"), F.col("source").alias("b"))
    pairs = cut_lineage(there.unionByName(back).distinct())
    labels = cut_lineage(
        pairs.groupBy("a").agg(F.min("b").alias("b")).select(
            F.col("a").alias("node"), F.least("a", "b").alias("component")
        )
    )
    while True:
        around = (
            pairs.join(labels, pairs.b == labels.node)
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        reached = labels.join(around, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("label")
        )
        onward = labels.select(F.col("node").alias("label"), F.col("component").alias("onward"))
        new = cut_lineage(
            reached.join(onward, "label").select(
                "node", "old", F.least("label", "onward").alias("component")
            )
        )
        changed = new.filter(F.col("old") != F.col("component")).isEmpty()
        labels = new.select("node", "component")
        if changed:
            return labels


def component_sizes(components: DataFrame) -> DataFrame:
    return (
        components.groupBy("component")
        .agg(F.count(F.lit(1)).alias("size"))
        .orderBy(F.desc("size"), "component")
    )


def acyclic_orientations(edges: DataFrame, forbid_new_colliders: bool = False) -> DataFrame:
    """Every orientation of the undirected pairs that leaves the graph acyclic: (code).

    Bit k of ``code`` turns the k-th pair, in name order, from low->high to high->low. Candidates
    are a Spark range checked in batches; only the variable graph itself is sent to the tasks.
    """
    edges = cut_lineage(edges)
    pairs = [tuple(r) for r in undirected_pairs(edges).orderBy("x", "y").collect()]
    loose = set(pairs) | {(b, a) for a, b in pairs}
    fixed = [
        (r["source"], r["target"])
        for r in edges.select("source", "target").distinct().collect()
        if (r["source"], r["target"]) not in loose
    ]
    nodes = sorted({n for p in [*pairs, *fixed] for n in p})
    at = {n: i for i, n in enumerate(nodes)}
    fixed = [(at[a], at[b]) for a, b in fixed]
    turned = [(at[a], at[b]) for a, b in pairs]
    size = len(nodes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            code = pdf["id"].to_numpy()
            m = np.zeros((len(code), size, size), bool)
            for a, b in fixed:
                m[:, a, b] = True
            for k, (a, b) in enumerate(turned):
                up = (code >> k & 1).astype(bool)
                m[~up, a, b] = True
                m[up, b, a] = True
            keep = np.ones(len(code), bool)
            if forbid_new_colliders:
                keep &= ~_new_collider(m, fixed)
            alive = np.ones((len(code), size), bool)
            for _ in range(size):
                # Peel nodes without a living parent; a cycle never empties.
                alive &= (m & alive[:, :, None]).any(axis=1)
            keep &= ~alive.any(axis=1)
            yield pd.DataFrame({"code": code[keep]})

    return edges.sparkSession.range(2 ** len(pairs)).mapInPandas(run, "code long")


def _new_collider(m: np.ndarray, fixed: list[tuple[int, int]]) -> np.ndarray:
    """Candidates with a collider of non-adjacent parents that the fixed edges do not show."""
    linked = m | m.transpose(0, 2, 1)
    bad = np.zeros(len(m), bool)
    known = set(fixed)
    size = m.shape[1]
    for z in range(size):
        for x in range(size):
            for y in range(x + 1, size):
                if (x, z) in known and (y, z) in known:
                    continue
                bad |= m[:, x, z] & m[:, y, z] & ~linked[:, x, y]
    return bad
