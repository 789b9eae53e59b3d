"""N-gram Jaccard join by chosen paths: which documents share at least 0.8 of their word shingles.

Equal texts are one class from the start. Each class gets a sketch: its shingle set mapped to a fixed
number of min-wise tokens, so that sets with Jaccard similarity s share a share s of positions. A
*run* of the chosen-path join splits the classes on a sampled token: classes that share the token
fall into one bucket. Small buckets are compared by brute force on sketches. A large bucket first
compares all its classes with one pivot; those very near to it are linked and leave, as whatever is
near to them is linked to the pivot too. The rest is split again on another sampled token, until no
bucket is large. A class that was compared at depth d of a run met a partner at the threshold with
probability ``threshold ** d``; runs repeat for the classes whose own depths leave a chance above
``1 - recall`` that a partner was missed in all of them. A family of half-similar texts is split
deeply and so gets as many more runs as it needs, however few its classes are among all.

Brute force and pivots emit a forest of candidate links, never all pairs. Candidate links cut the
classes into clusters, and an exact check follows: within each cluster all pairs of shingle sets are
compared in blocks, so a cluster of near copies is spread over many tasks. A block returns one row
per class, its number of exact links and the label of its linked group in the block; components over
these labels are the groups.

Words are runs of characters other than space and tab to carriage return; a text with one to four
words has one shingle, one without words has none and equals only texts of the same characters. Null
is the empty text. Rows with null or repeated ids count as rows. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tracewell.llm.common import free_name, table, text_of
from tracewell.session import materialize, small_side

N, THRESHOLD, RECALL = 5, 0.8, 0.999
POSITIONS = 64
#: Similarity of sketches from which two classes become candidates, and from which a class leaves a
#: large bucket with its pivot. The first is four deviations of a sketch under the threshold (a pair at
#: the threshold falls below it once in 10,000 times); a class within the second of the pivot has all
#: its partners above the first.
CANDIDATE, LEAVES = 0.6, 0.9
BUCKET, BLOCK = 512, 256
#: Rows of small buckets that are compared in one group.
SHARD_ROWS = 1 << 15
#: Classes of clusters, 40 bytes each, that are sent to the texts; more meet the distinct texts by a shuffle.
SENT_CLASSES = 250_000
#: Large buckets, and their pivots, of at most 100 bytes each, that are sent to all rows of a level.
SENT_BUCKETS = 100_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_WORDS_KEPT = 300_000


class Shingler:
    """Hashes of word n-grams of whole texts."""

    def __init__(self, n: int) -> None:
        self.n, self.known = n, {}
        self.factors = (np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)

    def __call__(self, text: str) -> np.ndarray:
        if len(self.known) > _WORDS_KEPT:
            self.known.clear()
        known, hashed = self.known, []
        for w in _WORD.findall(text):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            hashed.append(h)
        words = np.array(hashed, np.uint64)
        if not len(words):
            return words
        width = min(self.n, len(words))
        total = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            total += words[k : k + len(total)] * self.factors[k]
        return mixed(total + np.uint64(width))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(shingles: np.ndarray, positions: int = POSITIONS) -> bytes:
    """Min-wise tokens by one permutation; an empty position copies from one that two sets agree on.

    Four bytes a token for the paths, then the last byte of each for comparisons.
    """
    if not len(shingles):
        return b""
    least = np.full(positions, np.iinfo(np.uint64).max)
    where = (shingles % np.uint64(positions)).astype(np.int64)
    np.minimum.at(least, where, shingles // np.uint64(positions))
    filled = least != np.iinfo(np.uint64).max
    out, empty, attempt = least.copy(), np.flatnonzero(~filled), 0
    while len(empty):
        seed = np.uint64((attempt << 32) + 1)
        donor = (mixed(empty.astype(np.uint64) + seed * np.uint64(positions)) % np.uint64(positions)).astype(np.int64)
        got = filled[donor]
        out[empty[got]] = least[donor[got]] + np.uint64(attempt + 1)
        empty, attempt = empty[~got], attempt + 1
    tokens = mixed(out)
    return tokens.astype("<u4").tobytes() + tokens.astype("u1").tobytes()


def sketcher(n: int):
    """Pandas UDF: text to its sketch."""

    @F.pandas_udf("binary")
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shingle = Shingler(n)
        for texts in batches:
            yield pd.Series([sketch(shingle(t)) for t in texts], dtype=object)

    return make


def shingle_sets(n: int):
    """Pandas UDF: text to its sorted distinct shingles, packed."""

    @F.pandas_udf("binary")
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shingle = Shingler(n)
        for texts in batches:
            yield pd.Series([np.unique(shingle(t)).tobytes() for t in texts], dtype=object)

    return make


def token_at(sketch_: Column, position: Column) -> Column:
    return F.substring(sketch_, position * 4 + 1, F.lit(4))


def short(sketch_: Column) -> Column:
    return F.substring(sketch_, 4 * POSITIONS + 1, F.lit(POSITIONS))


@F.pandas_udf(DoubleType())
def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of positions at which two short sketches have the same token."""
    if not len(a):
        return pd.Series([], dtype=float)
    x = np.frombuffer(b"".join(a), "u1").reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), "u1").reshape(len(b), -1)
    return pd.Series((x == y).mean(axis=1))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Label of each of ``n`` nodes: the least node of its component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _brute_force(shard: pa.Table) -> pa.Table:
    """A forest over the candidate pairs of each bucket of a shard."""
    bucket = shard.column("bucket").to_numpy()
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cids = shard.column("cid").to_pylist()
    x = np.frombuffer(b"".join(shard.column("short").to_pylist()), "u1").reshape(len(cids), -1)
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    ends = np.append(first[1:], len(bucket))
    source, target = [], []
    for lo, hi in zip(first[ends - first > 1].tolist(), ends[ends - first > 1].tolist(), strict=True):
        at = order[lo:hi]
        some = x[at]
        pairs = []
        for i in range(len(at) - 1):
            near = np.flatnonzero((some[i + 1 :] == some[i]).mean(axis=1) >= CANDIDATE)
            pairs.append(np.stack([np.full(len(near), i), near + i + 1]))
        root = _roots(len(at), *np.concatenate(pairs, axis=1))
        moved = np.flatnonzero(root != np.arange(len(at)))
        source += [cids[i] for i in at[moved]]
        target += [cids[i] for i in at[root[moved]]]
    schema = pa.schema([("source", pa.binary()), ("target", pa.binary())])
    return pa.table([source, target], schema=schema)


def text_id(text: str) -> Column:
    """The name of a text, never null, so that joins on it share one exchange of the texts."""
    return F.coalesce(F.unhex(F.md5(text_of(text))), F.lit(b""))


def classes(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(cid, sketch, copies, least): one row per distinct text."""
    whole = text_of(text)
    rows = docs.select(F.col(key).alias("key"), text_id(text).alias("cid"), sketcher(n)(whole).alias("sketch"))
    return rows.groupBy("cid").agg(
        F.first("sketch").alias("sketch"), F.count("*").alias("copies"), F.min("key").alias("least")
    )


def _position(bucket: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("position"), bucket), F.lit(POSITIONS)).cast("int")


def _split(rows: DataFrame) -> DataFrame:
    """The next level: each bucket by the token at a position that its path chooses."""
    token = token_at(F.col("sketch"), _position(F.col("bucket")))
    return rows.withColumn("bucket", F.xxhash64("bucket", token))


def _log_miss(depth: int) -> float:
    """Logarithm of the chance that a run parts two classes at the threshold within ``depth`` splits."""
    return math.log1p(-(THRESHOLD**depth))


def _sent(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Narrow rows written once, and their number; broadcast if they are few."""
    fixed = materialize(df, name)
    rows = fixed.count()
    return (F.broadcast(fixed) if rows <= SENT_BUCKETS else fixed), rows


def _runs(open_: DataFrame, first: int, runs: int) -> tuple[list[DataFrame], list[DataFrame], DataFrame | None]:
    """Some runs over ``open_`` (cid, sketch): what each level leaves in small buckets (bucket, cid, short),
    its links to pivots, and per class (cid, deeper), what depths below 1 add to its log miss.
    """
    run = lambda r: F.struct(F.xxhash64(r).alias("bucket"))
    rows = open_.select("cid", "sketch", F.inline(F.transform(F.sequence(F.lit(first), F.lit(first + runs - 1)), run)))
    small, links, deeper, depth = [], [], [], 0
    mark = F.xxhash64("cid")
    while True:
        rows, depth = _split(rows), depth + 1
        # at most one large bucket in BUCKET rows, so rows meet this list without moving
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min(mark).alias("mark"))
        full, n_full = _sent(sizes.where(F.col("size") > BUCKET).select("bucket", "mark"), "large_buckets")
        left = rows.join(full, "bucket", "left_anti") if n_full else rows
        small.append(left.select("bucket", "cid", short(F.col("sketch")).alias("short")))
        if not n_full:
            break
        pivots = rows.join(full, "bucket").where(mark == F.col("mark"))
        pivots, _ = _sent(pivots.select("bucket", F.col("cid").alias("pivot"), short(F.col("sketch")).alias("short")), "pivots")
        near = agreement(short(F.col("sketch")), "short").alias("near")
        to_pivot = materialize(rows.join(pivots, "bucket").select("bucket", "cid", "sketch", "pivot", near), "pivot_links")
        near = to_pivot.where((F.col("near") >= CANDIDATE) & (F.col("cid") != F.col("pivot")))
        links.append(near.select(F.col("cid").alias("source"), F.col("pivot").alias("target")))
        # at least the pivot leaves, and a bucket that stays whole gets another position
        rows = to_pivot.where(F.col("near") < LEAVES).select("bucket", "cid", "sketch")
        deeper.append(rows.select("cid", F.lit(_log_miss(depth + 1) - _log_miss(depth)).alias("more")))
    if not deeper:
        return small, links, None
    return small, links, reduce(DataFrame.unionByName, deeper).groupBy("cid").agg(F.sum("more").alias("deeper"))


def candidate_links(sketched: DataFrame, recall: float = RECALL) -> DataFrame:
    """(source, target): forests that join each near pair with probability ``recall`` at least.

    A batch of runs is as long as classes need that depth 1 parts from large buckets; the others take
    part in further batches, among themselves. A class that leaves has a chance below ``1 - recall`` of
    having missed a partner, whether or not the partner stays.
    """
    bound = math.log(1 - recall)
    batch = math.ceil(bound / _log_miss(1))
    small, links, first, rows = [], [], 0, 0
    open_, n_open = sketched.select("cid", "sketch", F.lit(0.0).alias("missed")), sketched.count()
    while n_open:
        left, found, deeper = _runs(open_, first, batch)
        small, links = small + left, links + found
        first, rows = first + batch, rows + n_open * batch
        if deeper is None:
            break
        missed = F.col("missed") + batch * _log_miss(1) + F.coalesce("deeper", F.lit(0.0))
        still = open_.join(deeper, "cid", "left").withColumn("missed", missed).drop("deeper")
        open_ = materialize(still.where(F.col("missed") > bound), "open_classes")
        n_open = open_.count()
    if not small:
        return sketched.select(F.col("cid").alias("source"), F.col("cid").alias("target"))
    # the small buckets of all levels and runs are compared together; a bucket's name is its path
    setting = int(sketched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shard = F.pmod(F.xxhash64(F.lit("shard"), "bucket"), F.lit(max(setting, rows // SHARD_ROWS + 1)))
    buckets = reduce(DataFrame.unionByName, small).withColumn("shard", shard)
    links.append(buckets.groupBy("shard").applyInArrow(_brute_force, "source binary, target binary"))
    return materialize(reduce(DataFrame.unionByName, links).distinct(), "candidate_links")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of (source, target) links, by contraction.

    Each round maps every node to its least neighbour, moves the links along and drops those that
    became loops or repeats, so the links shrink to nothing. Names are hashes, so chains of ever
    smaller neighbours are short.
    """
    ends = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    edges = materialize(links.where("source != target").select(*ends("source", "target")).distinct(), "edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        low = materialize(low.select("node", F.least("node", "near").alias("low")), "least_neighbours")
        if labels is None:
            labels = low.withColumnRenamed("low", "component")
        else:
            onward = low.withColumnsRenamed({"node": "component", "low": "onward"})
            moved = labels.join(onward, "component", "left")
            labels = materialize(moved.select("node", F.coalesce("onward", "component").alias("component")), "labels")
        left, right = (low.withColumnsRenamed({"node": c, "low": f"low_{c}"}) for c in ("a", "b"))
        moved = edges.join(left, "a").join(right, "b").where("low_a != low_b")
        edges = materialize(moved.select(*ends("low_a", "low_b")).distinct(), "edges")
        if edges.isEmpty():
            return labels


def _exact_links(threshold: float):
    """Links between two blocks of one cluster, or within one."""

    def check(rows: pa.Table) -> pa.Table:
        ids, copies = rows.column("cid").to_pylist(), np.array(rows.column("copies").to_pylist(), np.int64)
        side = np.array(rows.column("side").to_pylist())
        sets = [np.frombuffer(s, np.uint64) for s in rows.column("shingles").to_pylist()]
        size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), size)
        _, code, freq = np.unique(flat, return_inverse=True, return_counts=True)
        shared = freq[code] > 1
        owner, code = owner[shared], np.unique(code[shared], return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        common = np.zeros((len(sets), len(sets)), np.float32)
        width = max(1, (1 << 22) // len(sets))  # shingles per slice of the product
        for at in range(0, int(code[-1]) + 1 if len(code) else 0, width):
            lo, hi = np.searchsorted(code, [at, at + width])
            part = np.zeros((len(sets), min(width, int(code[hi - 1]) - at + 1)), np.float32)
            part[owner[lo:hi], code[lo:hi] - at] = 1
            common += part @ part.T
        both = size[:, None] + size[None, :] - common
        linked = (common > 0) & (common.astype(float) >= threshold * both.astype(float) - 1e-9)
        np.fill_diagonal(linked, False)
        if side.any():
            linked &= side[:, None] != side[None, :]
        root = _roots(len(ids), *np.nonzero(linked))
        schema = pa.schema([("cid", pa.binary()), ("partners", pa.int64()), ("root", pa.binary())])
        return pa.table([ids, linked @ copies, [ids[r] for r in root]], schema=schema)

    return check


def _texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (cid, ..) with the text of each class; copies are combined before any text moves."""
    one = lambda rows, *keys: rows.groupBy(*keys).agg(F.first("text").alias("text"))
    if wanted.count() <= SENT_CLASSES:
        return one(texts.join(F.broadcast(wanted), "cid"), *wanted.columns)
    return one(texts, "cid").join(wanted, "cid")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """(cid, copies, group, n_links, least): one row per distinct text.

    ``group`` names the connected group by the least ``cid`` in it; ``n_links`` counts the other
    documents within the threshold, copies included.
    """
    known = materialize(classes(docs, key, text, n), "text_classes")
    links = candidate_links(known.where(F.length("sketch") > 0), recall)
    clusters = materialize(components(links), "clusters").withColumnsRenamed({"node": "cid", "component": "cluster"})
    sized = clusters.join(clusters.groupBy("cluster").agg(F.count("*").alias("members")), "cluster")
    sized = materialize(sized.join(known.select("cid", "copies"), "cid"), "sized_classes")
    one = _texts_of(docs.select(text_id(text).alias("cid"), text_of(text).alias("text")), sized)
    sets = one.withColumn("shingles", shingle_sets(n)("text")).drop("text")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(F.lit("block"), "cid"), blocks).cast("int")
    # block pair (i, j): a class of block i meets the classes of block j once; one block meets itself
    meets = lambda j: F.struct(
        F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), F.when(own > j, 1).otherwise(0).alias("side")
    )
    keyed = sets.select("cid", "cluster", "copies", "shingles", F.inline(F.transform(F.sequence(F.lit(0), blocks - 1), meets)))
    checked = materialize(
        keyed.groupBy("cluster", "i", "j").applyInArrow(_exact_links(threshold), "cid binary, partners long, root binary"),
        "exact_links",
    )
    partners = checked.groupBy("cid").agg(F.sum("partners").alias("partners"))
    groups = components(checked.where("cid != root").select(F.col("cid").alias("source"), F.col("root").alias("target")))
    groups = groups.withColumnsRenamed({"node": "cid", "component": "group"})
    joined = known.drop("sketch").join(partners, "cid", "left").join(groups, "cid", "left")
    linked = F.coalesce("partners", F.lit(0)) + F.col("copies") - 1
    return joined.select("cid", "copies", F.coalesce("group", "cid").alias("group"), linked.alias("n_links"), "least")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each group: the one with the least id (nulls last), then the least row."""
    found = materialize(near_duplicates(docs, key, text, **options), "near_duplicates")
    groups = found.groupBy("group").agg(F.sum("copies").alias("rows"), F.min("least").alias("least"))
    several = found.select("cid", "group").join(groups.where("rows > 1"), "group").select("cid", "group", "least")
    cid, group, least = (free_name(docs, c) for c in ("cid", "group", "least"))
    several = small_side(several.withColumnsRenamed({"cid": cid, "group": group, "least": least}), SENT_CLASSES)
    keyed = docs.withColumn(cid, text_id(text))
    alone = keyed.join(several, cid, "left_anti").select(docs.columns)
    # rows with the least id of their group, which are few; the least of them stays
    some = keyed.join(several, cid).where(F.col(key).eqNullSafe(F.col(least)))
    best = some.groupBy(group).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return alone.unionByName(best.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = materialize(near_duplicates(docs), "near_duplicates")
    groups = found.groupBy("group").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    per_text = found.join(groups, "group").select("cid", "class_id", "class_size", "n_links", "copies")
    rows = docs.select("doc_id", text_id("text").alias("cid"))
    return rows.join(per_text, "cid").select("doc_id", "class_id", "class_size", "n_links", (F.col("copies") - 1).alias("n_copies"))


QUERIES = {"op5_ngram_jaccard_join": op5_ngram_jaccard_join}
SQL: dict[str, str] = {}
