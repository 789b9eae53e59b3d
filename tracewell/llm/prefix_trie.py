"""Prefix tries of conversations in double arrays: which beginnings conversations share, and what that saves.

A trie is packed into two arrays: the child of node s by turn id c lies in cell BASE[s] + c, and that
cell's CHECK names s. Ids are dense inside a shard. Equal conversations are one sequence with a count.
Sequences are sorted and cut into *prefix shards* by range, so a first turn that most conversations
share spreads over many shards, and two shards share only nodes on their outermost sequences. A shard
walks its sequences through the double array and adds up its nodes; all but the nodes on its
first and last sequence are finished then. These *border* nodes travel with the digest of their
prefix, are merged over all shards, and give their totals to the nodes above them.

Turns are ordered by number, then role, then text; a null number comes first, repeated rows stay. A
null role or text is the empty one. Rows without a conversation id take no part. A conversation
without turns is a member of the root. An empty table has no node. Other columns are not read. Texts
meet only to be ordered; after that a turn is a digest of 128 bits and a number of words. One
conversation is one sequence of such turns, so these meet in one row, whatever the length. Border
nodes are joined to all nodes above them, which costs the square of the outermost sequences' lengths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm.common import n_words, table, text_of
from tracewell.session import materialize, small_side

#: Conversations whose ids agree in the quotient by ``FAMILY`` share the beginning of the first of them.
FAMILY, SHARED = 20, 4
#: Turns in an average shard; ids of one sequence that are listed in one row.
SHARD_TURNS, LISTED_BITS = 1 << 17, 12
#: Free cells that are tried for several children before they go behind the used cells.
TRIES = 16

TURN = "array<struct<digest:string,words:long>>"
MEMBERS = f"key string, n long, least long, ends string, seq {TURN}"
NODES = """border boolean, key string, parent_key string, path array<string>, depth long, conv_id long,
parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends string"""


class DoubleArray:
    """A trie over sorted sequences of small positive ids; the root is cell 0."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.ids, self.offsets = ids, offsets
        self.length = np.diff(offsets)
        size = 2 * len(ids) + int(ids.max(initial=0)) + 2
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1)
        self.used = bytearray(size)
        self.used[0] = 1
        self.free, self.end = 1, 1
        state = np.zeros(len(self.length), np.int64)
        for depth in range(int(self.length.max(initial=0))):
            at = np.flatnonzero(self.length > depth)
            parent, code = state[at], ids[offsets[at] + depth]
            fresh = np.flatnonzero(np.append(True, (parent[1:] != parent[:-1]) | (code[1:] != code[:-1])))
            owners, codes = parent[fresh], code[fresh]
            first = np.flatnonzero(np.append(True, owners[1:] != owners[:-1]))
            for x, y in zip(first.tolist(), np.append(first[1:], len(owners)).tolist()):
                self.base[owners[x]] = self._place(np.sort(codes[x:y]).tolist())
            cells = self.base[owners] + codes
            self.check[cells] = owners
            state[at] = self.base[parent] + code
        self.base, self.check = self.base[: self.end], self.check[: self.end]

    def _place(self, codes: list[int]) -> int:
        """A base that puts all children into free cells, which are then taken."""
        used = self.used
        cell = self.free = used.index(0, self.free)
        low = codes[0]
        for _ in range(TRIES):
            if not any(self._taken(cell - low + c) for c in codes):
                break
            cell = used.index(0, cell + 1) if cell + 1 < self.end else self.end
        else:
            cell = max(cell, self.end)
        base = cell - low
        last = base + codes[-1]
        if last >= len(used):
            more = last + len(used)
            used.extend(bytes(more))
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, -1))
        for c in codes:
            used[base + c] = 1
        self.end = max(self.end, last + 1)
        return base

    def _taken(self, cell: int) -> bool:
        return cell < len(self.used) and self.used[cell] == 1

    def walk(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(depth, sequences, their cells) from the root downwards."""
        state = np.zeros(len(self.length), np.int64)
        yield 0, np.arange(len(state)), state
        for depth in range(int(self.length.max(initial=0))):
            at = np.flatnonzero(self.length > depth)
            cells = self.base[state[at]] + self.ids[self.offsets[at] + depth]
            if (self.check[cells] != state[at]).any():
                raise RuntimeError("a sequence leaves the trie")
            state[at] = cells
            yield depth + 1, at, cells


def _prefix_keys(digests: list[str]) -> list[str]:
    """A digest for each prefix, the empty one first."""
    running, keys = hashlib.sha256(), []
    for d in ["", *digests]:
        running.update(d.encode())
        keys.append(running.hexdigest())
    return keys


def _shard_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one shard of sorted sequences."""
    rows = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if rows is None:
        return
    seq = rows.column("seq").combine_chunks()
    digest, words_of = seq.flatten().field("digest"), seq.flatten().field("words").to_numpy(zero_copy_only=False)
    offsets = np.append(0, np.cumsum(seq.value_lengths().to_numpy(zero_copy_only=False)))
    coded = digest.dictionary_encode()
    trie = DoubleArray(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1, offsets)
    n, least = (rows.column(c).to_numpy() for c in ("n", "least"))
    size = max(1, len(trie.check))
    total, lowest = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
    depth_of, words, border = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size, bool)
    ends: dict[int, str] = {}
    key_of: dict[int, str] = {}
    path_of: dict[int, list[str]] = {}
    outer = {at: _prefix_keys(digest[offsets[at] : offsets[at + 1]].to_pylist()) for at in {0, len(n) - 1}}
    finished = rows.column("ends").to_pylist()
    levels = []
    for depth, at, cells in trie.walk():
        np.add.at(total, cells, n[at])
        np.minimum.at(lowest, cells, least[at])
        depth_of[cells] = depth
        if depth:
            words[cells] = words_of[offsets[at] + depth - 1]
        for k in np.flatnonzero(trie.length[at] == depth).tolist():
            ends[int(cells[k])] = finished[at[k]]
        for k, keys in outer.items():
            if depth < len(keys):
                cell = int(cells[np.searchsorted(at, k)])
                border[cell] = True
                key_of[cell], path_of[cell] = keys[depth], keys[: depth + 1]
        levels.append(np.unique(cells))
    children = np.zeros(size, np.int64)
    for level in levels[1:]:
        np.add.at(children, trie.check[level[~border[level]]], 1)
    leaves = ((children == 0) & ~border).astype(np.int64)
    saved = np.where(border, 0, (total - 1) * words)
    for level in levels[:0:-1]:  # what lies in subtrees of no border node is finished here
        inner = level[~border[level]]
        np.add.at(leaves, trie.check[inner], leaves[inner])
        np.add.at(saved, trie.check[inner], saved[inner])
    cells = np.concatenate(levels)
    parent = trie.check[cells] if len(trie.check) else np.full(1, -1)
    known = (parent >= 0) & ~border[parent]
    columns = [
        border[cells],
        [key_of.get(c) for c in cells.tolist()],
        [key_of.get(p) for p in parent.tolist()],
        [path_of.get(c) for c in cells.tolist()],
        depth_of[cells],
        lowest[cells],
        pa.array(np.where(known, lowest[parent], 0), pa.int64(), mask=~known),
        total[cells],
        children[cells],
        leaves[cells],
        saved[cells],
        words[cells],
        [ends.get(c) for c in cells.tolist()],
    ]
    kinds = [pa.bool_(), pa.string(), pa.string(), pa.list_(pa.string()), *[pa.int64()] * 8, pa.string()]
    names = [c.split()[0] for c in NODES.split(",")]
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
    yield from pa.Table.from_arrays(arrays, names).to_batches(max_chunksize=1 << 14)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per sequence from its sorted lists of ids; the digest runs on, so no list is ever whole."""
    key, kinds = None, [pa.string(), pa.int64(), pa.int64(), pa.string()]
    done: list[tuple] = []

    def send(kind: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*done, strict=True), [*kinds, kind], strict=True)]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, ["key", "n", "least", "ends", "seq"])

    seq = kind = None
    n = least = 0
    running = hashlib.sha256()
    for batch in batches:
        kind = batch.schema.field("seq").type
        plain = zip(*(batch.column(c).to_pylist() for c in ("key", "n", "least", "ids")), strict=True)
        for row, (own, some, lowest, ids) in enumerate(plain):
            if own != key:
                if key is not None:
                    done.append((key, n, least, running.hexdigest(), seq))
                    if len(done) == 1 << 12:
                        yield send(kind)
                key, n, least, running = own, some, lowest, hashlib.sha256(ids.encode())
                seq = batch.column("seq")[row].as_py()
            else:
                n, least = n + some, min(least, lowest)
                running.update(f",{ids}".encode())
    if key is not None:
        done.append((key, n, least, running.hexdigest(), seq))
        yield send(kind)


def sequences(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, seq): the turns of each conversation in order, as digests and numbers of words."""
    said = turns.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv_id"), F.col(turn).alias("turn"), text_of(role).alias("role"), text_of(text).alias("text")
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    # the length of the role keeps role and text apart
    whole = F.concat_ws(":", F.octet_length("role").cast("string"), F.concat("role", "text"))
    digest = F.substring(F.sha2(whole, 256), 1, 32).alias("digest")
    placed = said.select("conv_id", place.alias("place"), digest, n_words(F.col("text")).alias("words"))
    listed = F.sort_array(F.collect_list(F.struct("place", "digest", "words")))
    bare = F.transform(listed, lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words")))
    return placed.groupBy("conv_id").agg(bare.alias("seq"))


def n_shared(key: Column) -> Column:
    """How many turns of its family's first conversation a conversation begins with."""
    return (F.crc32(key.cast("string").cast("binary")) % SHARED).cast("int")


def rebuilt(known: DataFrame) -> DataFrame:
    """Each sequence with its first turns replaced by those of the first conversation of its family."""
    first = known.where(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("family"), F.slice("seq", 1, SHARED - 1).alias("head")
    )
    keyed = known.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY)
    n = n_shared(F.col("conv_id"))
    head = F.slice(F.coalesce("head", F.array().cast(TURN)), F.lit(1), n)
    return keyed.join(first, "family", "left").select("conv_id", F.concat(head, F.slice("seq", n + 1, F.size("seq"))).alias("seq"))


def prefix_trie(known: DataFrame) -> DataFrame:
    """One row per node of the trie over (conv_id, seq), with distinct ids."""
    spark = known.sparkSession
    key = F.sha2(F.array_join(F.col("seq.digest"), ""), 256)
    # ids of one sequence are listed by range, so a sequence of very many conversations is many short lists
    part = F.shiftright("conv_id", LISTED_BITS)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    listed = known.groupBy(key.alias("key"), part.alias("part")).agg(
        F.count("*").alias("n"), F.min("conv_id").alias("least"), ids.alias("ids"), F.first("seq").alias("seq")
    )
    listed = listed.repartition("key").sortWithinPartitions("key", "part")
    distinct = materialize(listed.select("key", "n", "least", "ids", "seq").mapInArrow(_members, MEMBERS), "sequences")
    turns = distinct.agg(F.sum(F.size("seq") + 1)).first()[0] or 0
    shards = turns // SHARD_TURNS + 1
    ranged = distinct.repartitionByRange(shards, "seq").sortWithinPartitions("seq")
    nodes = materialize(ranged.mapInArrow(_shard_nodes, NODES), "trie_nodes")
    outer = nodes.where("border").groupBy("key").agg(
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        *(F.max(c).alias(c) for c in ("words", "ends", "parent_key", "depth")),
        F.min("conv_id").alias("conv_id"),
        F.first("path").alias("path"),
    )
    outer = materialize(outer, "border_nodes")
    below = outer.groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("below"))
    outer = outer.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("below", F.lit(0)))
    own = outer.select(
        F.explode("path").alias("key"),
        (F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("n_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    totals = own.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens")))
    outer = outer.drop("n_leaves", "saved_tokens").join(totals, "key").withColumn("parent_conv_id", F.lit(None).cast("long"))
    columns = ["parent_key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    every = nodes.where("NOT border").select(columns).unionByName(outer.select(columns))
    above = small_side(outer.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above")))
    every = every.join(above, "parent_key", "left")
    return every.select(
        "conv_id",
        "depth",
        F.coalesce("parent_conv_id", "above").alias("parent_conv_id"),
        *("n_convs", "n_children", "n_leaves", "saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(sequences(table(spark, sf_dir, "conversations"))))


_BITS = "list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"

QUERIES = {"op12_prefix_trie": op12_prefix_trie}
SQL = {
    "op12_prefix_trie": f"""
WITH own AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}}
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), begun AS (
  SELECT conv_id, l, xor(list_reduce(list_concat([4294967295::BIGINT],
      list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
      lambda a, b: {_BITS}), 4294967295) % 4 AS h
  FROM own
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(f.l[1:c.h], []), c.l[c.h + 1:]) AS s
  FROM begun c LEFT JOIN own f ON f.conv_id = c.conv_id - c.conv_id % 20
), passed AS (
  SELECT conv_id, d, s[1:d] AS p, d = len(s) AS ends FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS members,
         CASE WHEN d = 0 THEN 0
              ELSE (count(*) - 1) * len(regexp_extract_all(p[d].t, '[^\\x20\\x09-\\x0D]+')) END AS saved
  FROM passed GROUP BY p, d
), below AS (
  SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
), full_nodes AS (
  SELECT n.*, coalesce(b.n_children, 0) AS n_children FROM nodes n LEFT JOIN below b ON n.p = b.p
), above AS (
  SELECT p[1:a] AS p, sum(saved) AS saved, sum((n_children = 0)::INT) AS leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_nodes) GROUP BY 1
)
SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.leaves::BIGINT AS n_leaves,
       s.saved::BIGINT AS saved_tokens, sha256(n.members) AS ends_sha256
FROM full_nodes n JOIN above s ON n.p = s.p LEFT JOIN nodes u ON n.d > 0 AND u.p = n.p[1:n.d - 1]"""
}
