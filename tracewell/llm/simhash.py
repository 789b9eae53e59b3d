"""SimHash near-duplicates: fingerprints within a Hamming radius, found in BK-trees.

A fingerprint bit is set if it is set in over half of the hashes of a text's word shingles, repeats
included. Equal fingerprints are one node from the start, so copies cost nothing further.

Nodes are dealt to *shards*: the 64 bits are cut into bands, and two fingerprints that differ in at
most ``BANDS - AGREE`` bits agree in ``AGREE`` bands at least, so each choice of so many bands is one
key. A shard holds the fingerprints of many keys and one BK-tree per key: a child hangs at an edge
labelled with its Hamming distance to the parent, and a query at distance d from a node follows only
edges from d - radius to d + radius. Trees are built and searched level by level in NumPy. A subtree
that lies wholly in the query's own group is skipped, so a large family of near copies costs little
more than its tree. A key with more than ``PIECE`` fingerprints is cut into pieces, each with its own
tree, which is sent to every other piece: no group of rows is larger than two pieces.

A shard returns a forest of links, never all pairs, and components over the forests are the groups.

ASCII letters are lower-cased; words are runs of characters other than space and tab to carriage
return; a text with fewer words than a shingle has one shingle, a text without words (null is the
empty text) has the fingerprint zero, which links like any other. Rows with null or repeated keys
stay rows; a group's least key ignores nulls and is null if all are. An empty table gives an empty
result. Other columns are not read. A long text is hashed in slices.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import table, text_of
from tracewell.llm.ngram_join import components
from tracewell.session import materialize

N, SEED, RADIUS = 4, 42, 4
BANDS, AGREE = 6, 2
#: Rows of an average shard, and the fingerprints of one key above which it is cut into pieces.
SHARD, PIECE = 1 << 16, 1 << 17
#: Keys that hold a greater share of the rows than one in so many are joined by broadcast.
HOT_SHARE = 10_000
#: Bytes of text that are split into words at once, and open (query, node) pairs of a search.
SLICE, OPEN = 1 << 20, 1 << 18
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _bit_counts(words: list[bytes], n: int) -> tuple[np.ndarray, int]:
    """For each bit, highest first, the shingles whose hash has it; and the number of shingles."""
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.append(0, np.cumsum(lengths + 1))
    total = max(1, len(words) - n + 1)
    ends = (starts[min(n, len(words)) :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:total].tolist(), ends, strict=True)], ">u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, total, 1 << 16):
        some = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(some.view(np.uint8).reshape(len(some), 8), axis=1).sum(0, dtype=np.int64)
    return counts, total


def fingerprint_of(text: str, n: int = N, slice_bytes: int = SLICE) -> int:
    """The fingerprint as a signed 64-bit integer."""
    whole = text.encode()
    counts, total, at, carried = np.zeros(64, np.int64), 0, 0, []
    while at < len(whole):
        cut = _SPACE.search(whole, at + slice_bytes)
        end = cut.start() if cut else len(whole)
        words = carried + whole[at:end].lower().split()
        at = end
        if len(words) < n and (at < len(whole) or total):
            carried = words
            continue
        if words:
            some, shingles = _bit_counts(words, n)
            counts, total = counts + some, total + shingles
        carried = words[len(words) - n + 1 :]
    if carried and not total:  # white space to the end after fewer words than a shingle
        counts, total = _bit_counts(carried, n)
    return int(np.packbits(2 * counts > total).view(">i8")[0]) if total else 0


def fingerprint(n: int = N):
    """Pandas UDF: text to fingerprint."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint_of(t or "", n) for t in batch], dtype="int64")

    return of


class Trees:
    """BK-trees over fingerprints, one for each key; ``keys`` is sorted."""

    def __init__(self, prints: np.ndarray, keys: np.ndarray) -> None:
        n = len(prints)
        self.prints = prints
        self.key, self.root = np.unique(keys, return_index=True)
        self.levels = [self.root]
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        waiting = np.setdiff1d(np.arange(n), self.root, assume_unique=True)
        at = self.root[np.searchsorted(self.key, keys[waiting])]
        while len(waiting):
            code = at * 65 + np.bitwise_count(prints[waiting] ^ prints[at])
            order = np.argsort(code, kind="stable")
            waiting, code = waiting[order], code[order]
            first = np.append(True, code[1:] != code[:-1])
            child = waiting[first]
            parent[child], edge[child] = np.divmod(code[first], 65)
            self.levels.append(child)
            at = child[np.cumsum(first) - 1][~first]
            waiting = waiting[~first]
        inner = np.flatnonzero(parent >= 0)
        codes = parent[inner] * 65 + edge[inner]
        order = np.argsort(codes)
        self.parent, self.children, self.codes = parent, inner[order], codes[order]

    def label_range(self, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest label in the subtree of each node."""
        low, high = labels[: len(self.prints)].copy(), labels[: len(self.prints)].copy()
        for level in self.levels[:0:-1]:
            np.minimum.at(low, self.parent[level], low[level])
            np.maximum.at(high, self.parent[level], high[level])
        return low, high

    def search(self, prints: np.ndarray, roots: np.ndarray, mine: np.ndarray, labels: np.ndarray, radius: int):
        """Yield (query, node) pairs within the radius, without subtrees of the query's own label."""
        low, high = self.label_range(labels)
        stack = [(np.arange(len(prints)), roots)]
        while stack:
            query, node = stack.pop()
            if len(query) > OPEN:
                stack += [(query[:OPEN], node[:OPEN]), (query[OPEN:], node[OPEN:])]
                continue
            distance = np.bitwise_count(prints[query] ^ self.prints[node]).astype(np.int64)
            near = distance <= radius
            if near.any():
                yield query[near], node[near]
            first = np.searchsorted(self.codes, node * 65 + np.maximum(distance - radius, 0))
            last = np.searchsorted(self.codes, node * 65 + np.minimum(distance + radius, 64), side="right")
            width = last - first
            if not width.any():
                continue
            query = np.repeat(query, width)
            ordinal = np.arange(len(query)) - np.repeat(np.cumsum(width) - width, width)
            node = self.children[np.repeat(first, width) + ordinal]
            own = mine[query]
            go = (low[node] != own) | (high[node] != own)
            stack.append((query[go], node[go]))


def _united(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining those of ``a`` to those of ``b``; the least label stands for a group."""
    pairs = np.unique(np.stack([labels[a], labels[b]], 1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    if not len(pairs):
        return labels
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for x, y in pairs.tolist():
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    moved = np.arange(len(labels))
    for x in up:
        moved[x] = top(x)
    return moved[labels]


def forest(tree: Trees, prints: np.ndarray, roots: np.ndarray, start: int, labels: np.ndarray, radius: int) -> np.ndarray:
    """Labels of nodes and queries after all queries; query i has the label at ``start + i``."""
    at, width = 0, 64
    while at < len(prints):
        some = slice(at, at + width)
        mine = labels[start + at : start + at + width]
        found = list(tree.search(prints[some], roots[some], mine, labels, radius))
        if found:
            query, node = (np.concatenate(c) for c in zip(*found, strict=True))
            labels = _united(labels, start + at + query, node)
        at, width = at + width, min(2 * width, 1 << 13)
    return labels


def _shard_links(radius: int):
    """The links of one shard, or between two pieces of one key, as (source, target) forests."""
    schema = pa.schema([("source", pa.int64()), ("target", pa.int64())])

    def links(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("side", "ascending"), ("key", "ascending"), ("print", "ascending")])
        side, key, signed = (rows.column(c).to_numpy() for c in ("side", "key", "print"))
        prints = signed.view(np.uint64)
        n = int(np.searchsorted(side, 1))
        if n == len(side):  # no second piece: single members of a key have no one to meet
            _, code, members = np.unique(key, return_inverse=True, return_counts=True)
            several = members[code] > 1
            key, prints, signed = key[several], prints[several], signed[several]
            n = len(key)
        if not n:
            return schema.empty_table()
        tree = Trees(prints[:n], key[:n])
        start = n if n < len(key) else 0
        roots = tree.root[np.searchsorted(tree.key, key[start:])]
        labels = forest(tree, prints[start:], roots, start, np.arange(len(key)), radius)
        moved = np.flatnonzero(labels != np.arange(len(key)))
        return pa.table([signed[moved], signed[labels[moved]]], schema=schema)

    return links


def band_keys(value: Column, bands: int = BANDS, agree: int = AGREE) -> Column:
    """Array with a key for each choice of ``agree`` bands of the 64 bits."""
    borders = [64 * i // bands for i in range(bands + 1)]
    band = [
        F.shiftrightunsigned(value, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(borders, borders[1:])
    ]
    choice = list(combinations(range(bands), agree))
    keys = []
    for number, chosen in enumerate(choice):
        packed = reduce(lambda x, i: F.shiftleft(x, borders[i + 1] - borders[i]).bitwiseOR(band[i]), chosen, F.lit(number).cast("long"))
        keys.append(packed)
    return F.array(*keys)


def near_links(prints: DataFrame, radius: int = RADIUS, bands: int = BANDS, agree: int = AGREE) -> DataFrame:
    """(source, target) forests over the distinct values of the column ``print`` that join all within the radius."""
    if bands - agree < radius:
        raise ValueError("too few bands: near fingerprints would not share a key")
    spark = prints.sparkSession
    keyed = prints.select("print", F.explode(band_keys(F.col("print"), bands, agree)).alias("key"))
    choices = len(list(combinations(range(bands), agree)))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), prints.count() * choices // SHARD + 1)
    keyed = keyed.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    # a key above the bound makes its shard exceed it too; few shards do, so few keys are counted
    full = keyed.groupBy("shard").count().where(F.col("count") > PIECE).select("shard")
    hot = keyed.join(F.broadcast(full), "shard").groupBy("key").count().where(F.col("count") > PIECE)
    hot = materialize(hot.select("key", F.ceil(F.col("count") / PIECE).cast("int").alias("pieces")), "hot_keys")
    # at most rows / PIECE keys
    dealt = keyed.join(F.broadcast(hot), "key", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    own = F.pmod(F.xxhash64(F.lit("piece"), "print"), F.col("pieces")).cast("int")
    meets = lambda j: F.struct(
        F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), F.when(own > j, 1).otherwise(0).alias("side")
    )
    one = F.when(F.col("pieces") > 1, F.col("key")).alias("one")
    pieces = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), meets)
    met = dealt.select("print", "key", "shard", one, F.inline(pieces))
    return met.groupBy("shard", "one", "i", "j").applyInArrow(_shard_links(radius), "source long, target long")


def _spread_join(rows: DataFrame, labels: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join on ``key``; ``count`` says how many rows a label meets.

    Labels that meet more than one row in ``HOT_SHARE`` are at most so many, so they are broadcast;
    no other key is large enough to weigh on one task.
    """
    hot = F.col(count) * HOT_SHARE > total
    many = F.broadcast(labels.where(hot).drop(count))
    rest = rows.join(many, key, "left_anti").join(labels.where(~hot).drop(count), key)
    return rows.join(many, key).unionByName(rest)


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, radius: int = RADIUS) -> DataFrame:
    """(key, print, least): for each row its fingerprint and the least key of its linked group."""
    marked = materialize(docs.select(F.col(key).alias("own"), fingerprint(n)(text_of(text)).alias("print")), "fingerprints")
    nodes = materialize(marked.groupBy("print").agg(F.min("own").alias("own_least"), F.count("*").alias("rows")), "nodes")
    total = max(1, marked.count())
    links = materialize(near_links(nodes.select("print"), radius), "simhash_links")
    linked = components(links).withColumnRenamed("node", "print")
    linked = materialize(linked.join(nodes, "print"), "linked_nodes")
    groups = linked.groupBy("component").agg(F.min("own_least").alias("least"), F.count("*").alias("nodes"))
    joined = _spread_join(linked.select("print", "component", "rows"), materialize(groups, "groups"), "component", "nodes", total)
    alone = nodes.join(linked.select("print"), "print", "left_anti")
    labels = joined.select("print", "least", "rows").unionByName(alone.select("print", F.col("own_least").alias("least"), "rows"))
    found = _spread_join(marked, materialize(labels, "labels"), "print", "rows", total)
    return found.select(F.col("own").alias(key), "print", "least")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digits = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), F.col("least").alias("component_id"))


QUERIES = {"op11_simhash": op11_simhash}
SQL: dict[str, str] = {}
