"""Template mining by a fixed-depth prefix tree with similarity clusters.

Lines of different token counts never meet, so (source, n_tokens) is an exact grouping key. Inside a
bucket the clustering depends on line order. A bucket above ``hot_rows`` is cut into line ranges:
the tree state rarely changes once the templates are known, so ranges are checked in parallel
against the state at the frontier, and only the first range that changes it moves the frontier.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import WILDCARD, mask, short_id, tokens
from tracewell.operators.order import with_halo
from tracewell.session import cut_lineage, materialize

HOT_ROWS = 500_000
OUT_ROWS = 10_000
# Distinct lines above which a bucket's lines are not moved to meet; positions whose bits fit a positive long.
HOT_LINES, WORD_BITS = 100_000, 63
BUCKET = ["source", "n_tokens"]


class Tree:
    """Clusters of one bucket. Templates are integer rows; 0 stands for the wildcard."""

    def __init__(self, depth: int, st: float, max_child: int, state: str | None = None):
        self.levels, self.st, self.max_child = depth - 3, st, max_child
        self.code = {WILDCARD: 0}
        self.word = [WILDCARD]
        self.children: dict[tuple, set] = {}
        self.leaf_of: list[tuple] = []
        self.leaves: dict[tuple, list] = {}
        self.changed = False
        self.memo: dict[tuple, int] = {}
        if state:
            saved = json.loads(state)
            self.children = {tuple(p): set(kids) for p, kids in saved["children"]}
            for path, template in zip(saved["leaf_of"], saved["templates"]):
                self._add(tuple(path), self._encode(template))
            self.changed = False

    def _encode(self, words: Sequence[str]) -> np.ndarray:
        row = np.empty(len(words), np.int32)
        for i, w in enumerate(words):
            c = self.code.get(w)
            if c is None:
                c = self.code[w] = len(self.word)
                self.word.append(w)
            row[i] = c
        return row

    def _find(self, words: Sequence[str]) -> tuple | None:
        path = ()
        for w in words[: self.levels]:
            kids = self.children.get(path, ())
            if w not in kids:
                if WILDCARD not in kids:
                    return None
                w = WILDCARD
            path += (w,)
        return path

    def _open(self, words: Sequence[str]) -> tuple:
        """Path of a new cluster. One child slot per node is kept for the wildcard."""
        path = ()
        for w in words[: self.levels]:
            kids = self.children.setdefault(path, set())
            if w not in kids:
                room = self.max_child - len(kids) - (WILDCARD not in kids)
                if room <= 0 or any("0" <= ch <= "9" for ch in w):
                    w = WILDCARD
                kids.add(w)
            path += (w,)
        return path

    def _add(self, path: tuple, row: np.ndarray) -> int:
        leaf = self.leaves.get(path)
        if leaf is None:
            leaf = self.leaves[path] = [np.zeros((4, len(row)), np.int32), np.zeros(4, np.int64), []]
        rows, wild, ids = leaf
        if len(ids) == len(rows):
            leaf[0] = rows = np.concatenate([rows, np.zeros_like(rows)])
            leaf[1] = wild = np.concatenate([wild, np.zeros_like(wild)])
        rows[len(ids)] = row
        wild[len(ids)] = np.count_nonzero(row == 0)
        ids.append(len(self.leaf_of))
        self.leaf_of.append(path)
        self.changed = True
        self.memo.clear()
        return ids[-1]

    def assign(self, words: Sequence[str]) -> int:
        """Cluster number of one line; merges it into its cluster or opens a new one."""
        key = tuple(words)
        known = self.memo.get(key)
        if known is not None:
            return known
        row = self._encode(words)
        path = self._find(words)
        leaf = self.leaves.get(path) if path is not None else None
        cluster = None
        if leaf is not None:
            rows, wild, ids = leaf
            k, n = len(ids), len(row)
            same = np.count_nonzero((rows[:k] == row) & (rows[:k] != 0), axis=1)
            best = int(np.argmax(same * (n + 1) + wild[:k]))
            if same[best] / n >= self.st:
                cluster = ids[best]
                differs = (rows[best] != row) & (rows[best] != 0)
                if differs.any():
                    rows[best][differs] = 0
                    wild[best] += np.count_nonzero(differs)
                    self.changed = True
                    self.memo.clear()
        if cluster is None:
            cluster = self._add(self._open(words), row)
        self.memo[key] = cluster
        return cluster

    def templates(self) -> list[list[str]]:
        out: list[list[str]] = [[]] * len(self.leaf_of)
        for rows, _, ids in self.leaves.values():
            for row, cluster in zip(rows, ids):
                out[cluster] = [self.word[c] for c in row]
        return out

    def state(self) -> str:
        return json.dumps(
            {
                "children": [[list(p), sorted(kids)] for p, kids in self.children.items()],
                "leaf_of": [list(p) for p in self.leaf_of],
                "templates": self.templates(),
            }
        )


def tokenize(lines: DataFrame, patterns: Sequence[str] = (), text: str = "template") -> DataFrame:
    """Mask and split each line: adds ``toks`` and ``n_tokens``."""
    toks = tokens(mask(text, list(patterns)))
    return lines.withColumn("toks", toks).withColumn("n_tokens", F.size("toks"))


def route_key(toks: Column, depth: int = 5) -> Column:
    """Leading tokens that route a line, those with digits as wildcard."""
    lead = F.slice(toks, 1, depth - 3)
    return F.transform(lead, lambda t: F.when(t.rlike(r"\d"), WILDCARD).otherwise(t))


def bucket_sizes(tokenized: DataFrame, depth: int = 5) -> DataFrame:
    """Lines per (source, n_tokens, routing tokens)."""
    return tokenized.groupBy(
        "source", "n_tokens", F.array_join(route_key(F.col("toks"), depth), " ").alias("route")
    ).agg(F.count(F.lit(1)).alias("cnt"))


def consensus(tokenized: DataFrame, depth: int = 5, hot_lines: int = HOT_LINES) -> DataFrame:
    """(source, n_tokens, route, template, n_lines, n_distinct): one template per routing bucket.

    A position is constant if all distinct lines of the bucket agree there, else the wildcard. There is
    no threshold and no order: equal lines are counted once, then every line of a bucket is held against
    its least one, and only the bits of the positions that differ are gathered, never the tokens. A bucket
    of one line is its template. At most lines / ``hot_lines`` buckets have more than ``hot_lines``; their
    least lines go to the lines, which stay where they are.
    """
    keys = ["source", "n_tokens", "route"]
    # tokens hold no blanks, so the joined text splits back
    whole = tokenized.where("n_tokens > 0").groupBy("source", F.array_join("toks", " ").alias("text"))
    distinct = materialize(whole.agg(F.count(F.lit(1)).alias("n")), "distinct-lines")
    toks = F.split("text", " ")
    route = F.array_join(route_key(toks, depth), " ").alias("route")
    placed = distinct.select("source", F.size(toks).alias("n_tokens"), route, "text", "n")
    buckets = materialize(
        placed.groupBy(*keys).agg(F.min("text").alias("low"), F.sum("n").alias("n_lines"), F.count(F.lit(1)).alias("n_distinct")),
        "buckets",
    )
    alone = buckets.where("n_distinct = 1").select(*keys, F.col("low").alias("template"), "n_lines", "n_distinct")
    several = buckets.where("n_distinct > 1").withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    hot, cold = several.where(F.col("n_distinct") > hot_lines), several.where(F.col("n_distinct") <= hot_lines)
    met = placed.join(F.broadcast(hot), same).unionByName(placed.join(cold, same)).where("text != low")
    # all lines of a bucket have the same words of bits, the last one shorter
    differ = F.zip_with(toks, F.split("low", " "), lambda a, b: (a != b).cast("long"))
    words = F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / WORD_BITS).cast("int"))
    bits = lambda w: F.aggregate(
        F.slice("differ", w * WORD_BITS + 1, F.lit(WORD_BITS)), F.lit(0).cast("long"), lambda all_, d: all_ * 2 + d
    )
    known = [*keys, "low", "n_lines", "n_distinct"]
    marked = met.withColumn("differ", differ).select(*known, F.posexplode(F.transform(words, bits)).alias("word", "mask"))
    folded = marked.groupBy(*known, "word").agg(F.bit_or("mask").alias("mask"))
    gathered = folded.groupBy(*known).agg(F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("masks"))

    def token(t: Column, i: Column) -> Column:
        word = F.floor(i / WORD_BITS).cast("int")
        length = F.least(F.lit(WORD_BITS), F.col("n_tokens") - word * WORD_BITS)
        bit = F.getbit(F.element_at("masks", word + 1)["mask"], length - 1 - i % WORD_BITS)
        return F.when(bit == 1, WILDCARD).otherwise(t)

    template = F.array_join(F.transform(F.split("low", " "), token), " ")
    return alone.unionByName(gathered.select(*keys, template.alias("template"), "n_lines", "n_distinct"))


def similarity(template: Column, toks: Column) -> Column:
    """Share of equal non-wildcard positions of two token lists of one length."""
    equal = F.filter(
        F.zip_with(template, toks, lambda a, b: (a == b) & (a != WILDCARD)), lambda x: x
    )
    return F.size(equal) / F.size(template)


def merge_template(template: Column, toks: Column) -> Column:
    return F.zip_with(template, toks, lambda a, b: F.when(a == b, a).otherwise(WILDCARD))


def adjacent_similarity(tokenized: DataFrame, chunk: int = 50_000) -> DataFrame:
    """Similarity and merged template of neighbouring lines with equal token count."""
    cut = with_halo(tokenized, "line_no", chunk, before=1)
    earlier = F.lag("toks").over(Window.partitionBy("source", "_chunk").orderBy("line_no"))
    pairs = cut.withColumn("_prev", earlier).filter(
        F.col("_own") & (F.size("_prev") == F.col("n_tokens")) & (F.col("n_tokens") > 0)
    )
    return pairs.select(
        "source",
        "line_no",
        similarity(F.col("_prev"), F.col("toks")).alias("similarity"),
        F.array_join(merge_template(F.col("_prev"), F.col("toks")), " ").alias("merged"),
    )


def mine_templates(
    lines: DataFrame,
    depth: int = 5,
    st: float = 0.5,
    max_child: int = 3,
    patterns: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
    content: bool = False,
) -> DataFrame:
    """(source, line_no, template): every line with the final template of its cluster.

    With ``content`` the raw line travels along, which spares a join of all lines afterwards.
    """
    raw = F.col("template") if content else F.lit(None).cast("string")
    # Three jobs read the masked lines; tokens hold no blanks, so the joined text splits back.
    tokenized = materialize(
        tokenize(lines, patterns).select(
            "source", "line_no", "n_tokens", raw.alias("content"), F.array_join("toks", " ").alias("text")
        ),
        "masked-lines",
    )
    # A line shorter than the routing depth never joins a cluster: its template is its own text.
    short = tokenized.filter(F.col("n_tokens") < depth - 2).select(
        "source", "line_no", "content", F.col("text").alias("template")
    )
    long = tokenized.filter(F.col("n_tokens") >= depth - 2)
    # At most rows / hot_rows buckets come back.
    hot = (
        long.groupBy(*BUCKET)
        .agg(F.count(F.lit(1)).alias("n"), F.max("line_no").alias("last"))
        .filter(F.col("n") > hot_rows)
        .collect()
    )
    args = (depth, st, max_child)
    columns = ["source", "line_no", *(["content"] if content else []), "template"]
    if not hot:
        return short.unionByName(_mine_whole(long, args)).select(columns)
    names = long.sparkSession.createDataFrame(
        [(r["source"], r["n_tokens"]) for r in hot], "source string, n_tokens int"
    )
    cold = long.join(F.broadcast(names), BUCKET, "left_anti")
    ranged = _mine_ranges(long.join(F.broadcast(names), BUCKET, "left_semi"), hot, args, hot_rows)
    return short.unionByName(_mine_whole(cold, args)).unionByName(ranged).select(columns)


def _mine_whole(long: DataFrame, args: tuple) -> DataFrame:
    """Buckets of bounded size: sorted partitions stream through, one open bucket at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tree, cluster = None, None, []
        names = ["source", "line_no", "content", "template"]
        out: dict[str, list] = {n: [] for n in names}

        def close() -> None:
            """The bucket is complete: its lines get their final templates."""
            if tree is not None:
                final = [" ".join(t) for t in tree.templates()]
                out["template"] += [final[c] for c in cluster]

        for pdf in batches:
            for s, n, i, raw, text in zip(*(pdf[c] for c in [*BUCKET, "line_no", "content", "text"])):
                if (s, n) != key:
                    close()
                    if len(out["template"]) >= OUT_ROWS:
                        yield pd.DataFrame(out)
                        out = {n: [] for n in names}
                    key, tree, cluster = (s, n), Tree(*args), []
                out["source"].append(s)
                out["line_no"].append(i)
                out["content"].append(raw)
                cluster.append(tree.assign(text.split(" ")))
        close()
        yield pd.DataFrame(out)

    placed = long.repartition(*BUCKET).sortWithinPartitions(*BUCKET, "line_no")
    return placed.mapInPandas(run, "source string, line_no long, content string, template string")


def _mine_ranges(long: DataFrame, hot: list, args: tuple, rows: int) -> DataFrame:
    """Hot buckets: find the exact tree state at the start of every line range, then assign."""
    spark = long.sparkSession
    stored = materialize(
        long.withColumn("chunk", F.floor(F.col("line_no") / rows).cast("long")), "hot-lines", "chunk"
    )
    last = {(r["source"], r["n_tokens"]): r["last"] // rows for r in hot}
    frontier = dict.fromkeys(last, 0)
    width = dict.fromkeys(last, 1)
    columns = "source string, n_tokens int, since long, state string"
    states = spark.createDataFrame([(s, n, 0, None) for s, n in last], columns)

    def check(key, data: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(*args, start["state"].iloc[0])
        for t in data.sort_values("line_no")["text"]:
            tree.assign(t.split(" "))
        state = tree.state() if tree.changed else None
        return pd.DataFrame(
            [(*key, tree.changed, state)], columns=["source", "n_tokens", "chunk", "changed", "state"]
        )

    latest = {k: 0 for k in last}
    while any(frontier[k] <= last[k] for k in last):
        todo = [
            (*k, c, latest[k])
            for k in last
            for c in range(frontier[k], min(frontier[k] + width[k], last[k] + 1))
        ]
        plan = spark.createDataFrame(todo, "source string, n_tokens int, chunk long, since long")
        start = plan.join(states, [*BUCKET, "since"]).select(*BUCKET, "chunk", "state")
        wanted = sorted({c for _, _, c, _ in todo})
        data = stored.filter(F.col("chunk").isin(wanted)).join(
            F.broadcast(plan.select(*BUCKET, "chunk")), [*BUCKET, "chunk"], "left_semi"
        )
        keys = [*BUCKET, "chunk"]
        result = cut_lineage(
            data.groupBy(*keys)
            .cogroup(start.groupBy(*keys))
            .applyInPandas(
                _skip_empty(check),
                "source string, n_tokens int, chunk long, changed boolean, state string",
            )
        )
        moved = {
            (r["source"], r["n_tokens"]): r["chunk"]
            for r in result.filter("changed").groupBy(*BUCKET).agg(F.min("chunk").alias("chunk")).collect()
        }
        picked = [(*k, c) for k, c in moved.items()]
        for k in last:
            if k in moved:
                frontier[k], width[k] = moved[k] + 1, 1
                latest[k] = moved[k] + 1
            else:
                frontier[k], width[k] = frontier[k] + width[k], width[k] * 2
        if picked:
            new = result.join(
                F.broadcast(spark.createDataFrame(picked, "source string, n_tokens int, chunk long")),
                keys,
            ).select(*BUCKET, (F.col("chunk") + 1).alias("since"), "state")
            states = cut_lineage(states.unionByName(new))

    def assign(key, data: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(*args, start["state"].iloc[0])
        data = data.sort_values("line_no")
        return pd.DataFrame(
            {
                "source": data["source"],
                "n_tokens": data["n_tokens"],
                "line_no": data["line_no"],
                "content": data["content"],
                "cluster": [tree.assign(t.split(" ")) for t in data["text"]],
            }
        )

    # New column ids: both sides of the later cogroup come from the same table.
    chunks = stored.select(*BUCKET, "chunk").distinct().toDF(*BUCKET, "chunk")
    starts = (
        chunks.join(states, BUCKET)
        .filter(F.col("since") <= F.col("chunk"))
        .groupBy(*BUCKET, "chunk")
        .agg(F.max_by("state", "since").alias("state"))
    )
    keys = [*BUCKET, "chunk"]
    assigned = (
        stored.groupBy(*keys)
        .cogroup(starts.groupBy(*keys))
        .applyInPandas(
            _skip_empty(assign),
            "source string, n_tokens int, line_no long, content string, cluster long",
        )
    )
    final = states.groupBy(*BUCKET).agg(F.max_by("state", "since").alias("state"))
    templates = final.select(
        *BUCKET,
        F.posexplode(
            F.from_json("state", "struct<templates:array<array<string>>>")["templates"]
        ).alias("cluster", "t"),
    ).select(*BUCKET, F.col("cluster").cast("long").alias("cluster"), F.array_join("t", " ").alias("template"))
    return assigned.join(templates, [*BUCKET, "cluster"]).select(
        "source", "line_no", "content", "template"
    )


def _skip_empty(fn):
    """A state without lines (or the reverse) gives no rows."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame()
        return fn(key, left, right)

    return run


def structured(lines: DataFrame, **mining) -> DataFrame:
    """LineId, Content, EventId, EventTemplate per line; ``mining`` goes to ``mine_templates``."""
    return mine_templates(lines, content=True, **mining).select(
        "source",
        (F.col("line_no") + 1).alias("LineId"),
        F.col("content").alias("Content"),
        short_id("template").alias("EventId"),
        F.col("template").alias("EventTemplate"),
    )


def template_summary(labelled: DataFrame, template: str, order: Column) -> DataFrame:
    """Distinct final templates with id and occurrences; equal texts of two clusters are one."""
    return labelled.groupBy("source", F.col(template).alias("EventTemplate")).agg(
        F.count(F.lit(1)).alias("Occurrences"), F.min(order).alias("first_line")
    ).withColumn("EventId", short_id("EventTemplate"))


def parameters(content: str, template: str) -> Column:
    """Texts behind the wildcards, matched lazily on the raw line; empty without a match."""
    t = F.regexp_replace(template, "<.{1,5}>", F.lit(WILDCARD))
    n = F.size(F.split(t, r"<\*>")) - 1
    quoted = F.regexp_replace(t, r"\\E", F.lit(r"\\E\\\\E\\Q"))
    spaced = F.regexp_replace(quoted, r"\s+", F.lit(r"\\E\\s+\\Q"))
    holes = F.regexp_replace(spaced, r"<\*>", F.lit(r"\\E(.*?)\\Q"))
    pattern = F.concat(F.lit(r"^\Q"), holes, F.lit(r"\E$"))
    none = F.array().cast("array<string>")
    return F.when(
        (n > 0) & F.rlike(F.col(content), pattern),
        F.transform(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
            lambda i: F.call_function("regexp_extract", F.col(content), pattern, i),
        ),
    ).otherwise(none)
