"""Approximate nearest neighbours by largest inner product: NN-descent and greedy graph search.

Equal vectors are one node, so a vector that many rows share neither fills neighbour lists nor joins
itself; of its rows only the smallest ids can ever be among the nearest. Vectors get one more
component that makes all lengths equal, so near in angle means large in product.

*Graph.* Random hyperplanes deal the nodes to small buckets, whose best pairs start the neighbour
lists; one more deal at random links far groups and fills every list. Each round joins neighbours of
neighbours: every node sends its vector to the nodes in whose neighbourhood it is (their neighbours,
and a sample of those that have them as neighbour); there all pairs of the neighbourhood are
multiplied, and a pair that beats the last entry of a list and is not in it goes to that list; what a
block sends or offers to another is one row. Rounds end when lists hardly change.

*Search.* A query keeps a beam of the best nodes found. Every round expands those of its best
``EXPAND`` that are not expanded yet: their neighbours in the graph are scored and compete for the
beam, until none of these is left open; such a beam is ready and goes into no later round. An entry
only ever falls in its beam, so one below is done and needs no record. A query that is a row starts at
its own node and at ``ENTRIES`` shared ones. A query that still has fewer rows than asked for is
scored against all nodes, block by block.

Nodes live in blocks of about ``BLOCK``, and every step works on whole blocks in NumPy; a node's
vector goes once to each block that needs it. Blocks follow the nearest of at most ``CENTRES`` sampled
vectors, so a neighbourhood lies in few blocks whatever their number; every node is indexed. All
messages are joins or groupings of Spark, and every round is written to the shared folder. Found nodes
are scored again in double precision on the original vectors.

Vectors that are null, zero, hold nulls or non-finite components or have another length than most
take no part, nor do rows without an id. Repeated rows are rows. With fewer rows than asked for, all
are returned; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewell.llm.common import table
from tracewell.session import materialize

LIST, SAMPLE, TREES, LEAF, BLOCK = 32, 32, 4, 256, 2048
#: A node's best candidates outside its list that one neighbourhood hands on in a round; the next
#: round, which knows these, offers others.
OFFERS = 8
ROUNDS, QUIET = 8, 0.5
#: Entries of a beam, those of them that are expanded, and shared entry points.
BEAM, EXPAND, ENTRIES = 160, 160, 32
#: Sampled vectors by which nodes are laid out; bits of a node's number inside its block.
CENTRES, PLACE_BITS = 1024, 20
#: A row's number in its group above a node's, in one long.
OWNER_SHIFT = 42

#: Neighbourhoods that are multiplied at once.
BATCH = 64
#: Pairs of sender and centre that one task deals to messages.
EDGES = 1 << 20

_STATE = "block int, node long, vector binary, nodes binary, sims binary, changed int"
_MESSAGES = "to int, senders binary, vectors binary, lasts binary, lists binary, centres binary, counts binary"
_OFFERS = "block int, owners binary, nodes binary, sims binary"
_BEAM = "query long, query_vector binary, nodes binary, sims binary, expanded binary, open int"


def _flat(column: pa.ChunkedArray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a packed list column, and the number of each row."""
    array = column.cast(pa.large_binary()).combine_chunks()
    if not len(array):
        return np.zeros(0, dtype), np.zeros(0, np.int64)
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), dtype), np.diff(ends) // np.dtype(dtype).itemsize


def _matrix(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    return _flat(column, dtype)[0].reshape(len(column), -1)


def _lists(column: pa.ChunkedArray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a packed list column, and their rows."""
    values, lengths = _flat(column, dtype)
    return values, np.repeat(np.arange(len(lengths)), lengths)


def _falling(sim: np.ndarray) -> np.ndarray:
    """Unsigned numbers that order single floats from the largest down."""
    bits = (sim.astype("<f4") + np.float32(0)).view("<u4")
    return np.where(bits >> 31 == 1, bits, ~bits & 0x7FFFFFFF).astype(np.uint64)


def _best(owner: np.ndarray, node: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best different nodes of each owner (a small number), by owner and falling
    similarity; of entries for one node the first counts."""
    order = np.argsort(owner << OWNER_SHIFT | node, kind="stable")
    o, n = owner[order], node[order]
    order = order[np.append(True, (o[1:] != o[:-1]) | (n[1:] != n[:-1]))] if len(order) else order
    # by node now, so equal similarities stay in that order
    order = order[np.argsort(owner[order].astype(np.uint64) << np.uint64(32) | _falling(sim[order]), kind="stable")]
    o = owner[order]
    rank = np.arange(len(o)) - np.searchsorted(o, o)
    return order[rank < k]


def _packed(owner: np.ndarray, values: np.ndarray, count: int) -> list[bytes]:
    """The values of owners 0 to ``count`` - 1, which are in order."""
    ends = np.searchsorted(owner, np.arange(count + 1))
    return [values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def block_of(node: str) -> Column:
    return F.shiftright(node, PLACE_BITS).cast("int")


def _chain(x: np.ndarray) -> np.ndarray:
    """An order of the rows in which each is followed by the nearest one left."""
    left, at, order = np.ones(len(x), bool), 0, []
    for _ in range(len(x)):
        order.append(at)
        left[at] = False
        at = int(np.argmax(np.where(left, x @ x[at], -np.inf)))
    return np.array(order, int)


def _offers(members: np.ndarray, a: np.ndarray, b: np.ndarray, sim: np.ndarray, k: int) -> pa.Table:
    """The ``k`` best (b, sim) for each member index ``a``: one row per block that owns some of them."""
    keep = _best(a, b, sim, k)
    owner, near, sim = members[a[keep]], members[b[keep]], sim[keep].astype("<f4")
    order = np.argsort(owner >> PLACE_BITS, kind="stable")
    blocks, at = np.unique(owner[order] >> PLACE_BITS, return_inverse=True)
    packed = [_packed(at, v[order], len(blocks)) for v in (owner.astype("<i8"), near.astype("<i8"), sim)]
    schema = pa.schema([("block", pa.int32()), *((c, pa.binary()) for c in ("owners", "nodes", "sims"))])
    return pa.table([pa.array(blocks.astype(np.int32)), *(pa.array(p, pa.binary()) for p in packed)], schema=schema)


def _all_pairs(bucket: pa.Table) -> pa.Table:
    """The best pairs within a bucket."""
    members = bucket.column("node").to_numpy()
    x = _matrix(bucket.column("vector"), "<f4")
    sim = x @ x.T
    np.fill_diagonal(sim, -np.inf)
    k = min(LIST, len(members) - 1)
    if k < 1:
        return _offers(members, *(np.zeros(0, int),) * 2, np.zeros(0, np.float32), 1)
    near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    a = np.repeat(np.arange(len(members)), k)
    return _offers(members, a, near.ravel(), np.take_along_axis(sim, near, 1).ravel(), k)


def _messages(edges: pa.Table, state: pa.Table) -> pa.Table:
    """What the nodes of a block send to the blocks of their centres: one row per block it goes to, with each
    sender's vector, list (filled up with -1) and the similarity to beat."""
    names = [c.split()[0] for c in _MESSAGES.split(", ")]
    schema = pa.schema([("to", pa.int32()), *((c, pa.binary()) for c in names[1:])])
    if not edges.num_rows or not state.num_rows:
        return schema.empty_table()
    nodes, x = state.column("node").to_numpy(), _matrix(state.column("vector"), "<f4")
    near, row = _lists(state.column("nodes"), "<i8")
    sim, held = _flat(state.column("sims"), "<f4")
    lists, last = np.full((len(nodes), LIST), -1, "<i8"), np.full(len(nodes), -np.inf, "<f4")
    lists[row, np.arange(len(row)) - np.searchsorted(row, row)] = near
    last[held == LIST] = sim[np.cumsum(held)[held == LIST] - 1]
    sort, centre = np.argsort(nodes), edges.column("centre").to_numpy()
    sender = sort[np.searchsorted(nodes[sort], edges.column("sender").to_numpy())]
    order = np.lexsort((centre, sender, centre >> PLACE_BITS))
    sender, centre = sender[order], centre[order]
    # a centre that both lists and is listed by the sender counts once
    once = np.append(True, (sender[1:] != sender[:-1]) | (centre[1:] != centre[:-1]))
    sender, centre = sender[once], centre[once]
    to, starts = np.unique(centre >> PLACE_BITS, return_index=True)
    columns: list[list[bytes]] = [[] for _ in names[1:]]
    for lo, hi in zip(starts, np.append(starts[1:], len(centre)), strict=True):
        m, counts = np.unique(sender[lo:hi], return_counts=True)
        for column, values in zip(columns, (nodes[m], x[m], last[m], lists[m], centre[lo:hi], counts.astype("<i8")), strict=True):
            column.append(values.tobytes())
    return pa.table([pa.array(to.astype(np.int32)), *(pa.array(c, pa.binary()) for c in columns)], schema=schema)


def _local_join(block: pa.Table) -> pa.Table:
    """All pairs of each neighbourhood in a block; only what beats the last entry of a list goes on."""
    members, _ = _flat(block.column("senders"), "<i8")
    x = _flat(block.column("vectors"), "<f4")[0].reshape(len(members), -1)
    last, _ = _flat(block.column("lasts"), "<f4")
    # pairs that stand in a list already, as member * members + member
    listed, _ = _flat(block.column("lists"), "<i8")
    owner = np.repeat(np.arange(len(members)), LIST)
    sort = np.argsort(members)
    at = sort[np.minimum(np.searchsorted(members[sort], listed), len(members) - 1)]
    here = members[at] == listed
    known = np.unique(owner[here] * len(members) + at[here])
    centre, _ = _flat(block.column("centres"), "<i8")
    sender = np.repeat(np.arange(len(members)), _flat(block.column("counts"), "<i8")[0])
    order = np.lexsort((sender, centre))
    centre, sender = centre[order], sender[order]
    starts = np.flatnonzero(np.append(True, centre[1:] != centre[:-1]))
    sizes = np.diff(np.append(starts, len(centre)))
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    found: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, len(starts), BATCH):
        size = sizes[lo : lo + BATCH, None]
        slot = np.arange(size.max())
        m = sender[np.minimum(starts[lo : lo + BATCH, None] + slot, len(sender) - 1)]
        v = x[m]
        sim = v @ v.transpose(0, 2, 1)
        sim[:, slot, slot] = -np.inf
        use = (sim > last[m][:, :, None]) & (slot < size)[:, :, None] & (slot < size)[:, None, :]
        c, i, j = np.nonzero(use)
        pair = m[c, i] * len(members) + m[c, j]
        if len(known):
            new = known[np.minimum(np.searchsorted(known, pair), len(known) - 1)] != pair
            c, i, j = c[new], i[new], j[new]
        # rows with more than OFFERS candidates keep the best of them
        row, value = c * len(slot) + i, sim[c, i, j]
        order = np.argsort(row.astype(np.uint64) << np.uint64(32) | _falling(value), kind="stable")
        row = row[order]
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < OFFERS]
        c, i, j = c[order], i[order], j[order]
        found.append((m[c, i], m[c, j], value[order]))
    if not found:
        return _offers(members, *(np.zeros(0, int),) * 2, np.zeros(0, np.float32), 1)
    return _offers(members, *map(np.concatenate, zip(*found, strict=True)), LIST)


def _merge(block: pa.Table) -> pa.Table:
    """The lists of a block with what was offered to them."""
    is_state = block.column("vector").is_valid()
    state, offers = block.filter(is_state), block.filter(pa.compute.invert(is_state))
    nodes = state.column("node").to_numpy()
    listed, row = _lists(state.column("nodes"), "<i8")
    owners, _ = _flat(offers.column("owners"), "<i8")
    sort = np.argsort(nodes)
    owner = np.append(row, sort[np.searchsorted(nodes[sort], owners)])
    near = np.append(listed, _flat(offers.column("nodes"), "<i8")[0])
    sim = np.append(_flat(state.column("sims"), "<f4")[0], _flat(offers.column("sims"), "<f4")[0])
    old = np.arange(len(near)) < len(listed)
    keep = _best(owner, near, sim, LIST)
    changed = np.bincount(owner[keep], ~old[keep], len(nodes)).astype(np.int32)
    return pa.table(
        [state.column("block"), nodes, state.column("vector"), _packed(owner[keep], near[keep], len(nodes)),
         _packed(owner[keep], sim[keep], len(nodes)), changed],
        ["block", "node", "vector", "nodes", "sims", "changed"],
    )


def _longs(packed: str) -> Callable:
    """Pandas UDF: a packed list as an array of ids."""

    @F.pandas_udf("array<long>")
    def unpack(lists):
        return lists.map(lambda b: np.frombuffer(b, "<i8"))

    return unpack(packed)


def _pack_longs(values: Column) -> Column:
    @F.pandas_udf("binary")
    def pack(lists):
        return lists.map(lambda v: np.asarray(v, "<i8").tobytes())

    return pack(values)


class Index:
    """Neighbour lists over the distinct vectors of ``rows`` (id, vector)."""

    def __init__(self, rows: DataFrame, most_ids: int, seed: int = 0) -> None:
        size = F.size("vector")
        width = rows.where("vector is not null").groupBy(size.alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
        width = width.n if width else 0
        finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
        fine = rows.where(
            F.col("id").isNotNull() & (size == width) & (size > 0) & finite & F.exists("vector", lambda v: v != 0)
        )
        fine = fine.select("id", F.transform("vector", lambda v: v.cast("double")).alias("vector"))
        # the smallest ids are all that ties can show; a slot per hash keeps hot vectors spread
        slots = fine.groupBy("vector", F.pmod(F.xxhash64("id"), F.lit(64)).alias("slot"))
        some = slots.agg(F.slice(F.array_sort(F.collect_list("id")), 1, most_ids).alias("ids"))
        merged = some.groupBy("vector").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, most_ids).alias("ids"))
        length = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v).alias("length")
        distinct = materialize(merged.select("vector", "ids", length), "ann_distinct")
        n, longest = distinct.agg(F.count("*"), F.max("length")).first()
        self.count = n
        if n:
            self.nodes = materialize(self._placed(distinct, n), "ann_nodes")
            self.graph = self._build(longest, width + 1, seed)

    @staticmethod
    def _placed(distinct: DataFrame, n: int) -> DataFrame:
        """Nodes numbered inside blocks of about ``BLOCK`` that follow the nearest sampled vector."""
        mark = F.xxhash64("vector")
        wanted = min(CENTRES, 4 * (n // BLOCK) + 1)
        sample = distinct.orderBy(mark, "vector").select("vector").limit(wanted).collect()
        centres = np.array([r.vector for r in sample])
        centres /= np.linalg.norm(centres, axis=1)[:, None]
        centres = centres[_chain(centres)].astype(np.float32)

        @F.pandas_udf("int")
        def nearest_centre(vectors):
            import pandas as pd

            x = np.array(vectors.tolist(), np.float32).reshape(len(vectors), -1)
            return pd.Series(np.argmax(x @ centres.T, axis=1).astype(np.int32))

        coded = materialize(distinct.withColumn("code", nearest_centre("vector")), "ann_coded")
        sizes = coded.groupBy("code").agg(F.count("*").alias("size"))
        # one row per centre
        earlier = F.coalesce(F.sum("size").over(Window.orderBy("code").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = F.broadcast(sizes.withColumn("start", earlier))
        spread = F.pmod(F.xxhash64(F.lit("place"), "vector"), F.col("size"))
        block = F.floor((F.col("start") + spread) / BLOCK).cast("long")
        dealt = coded.join(starts, "code").select("vector", "ids", "length", block.alias("block"))
        place = F.row_number().over(Window.partitionBy("block").orderBy(mark, "vector")) - 1
        return dealt.select((F.shiftleft("block", PLACE_BITS) + place).alias("node"), "vector", "ids", "length")

    def _build(self, longest: float, width: int, seed: int) -> DataFrame:
        @F.pandas_udf("binary")
        def lifted(vectors, lengths):
            x = np.array(vectors.tolist()).reshape(len(vectors), -1)
            rest = np.sqrt(np.maximum(0.0, longest - lengths.to_numpy()))[:, None]
            import pandas as pd

            return pd.Series([r.tobytes() for r in np.hstack([x, rest]).astype("<f4")], dtype=object)

        bits = max(0, int(np.ceil(np.log2(self.count / LEAF))))
        planes = np.random.default_rng(seed).normal(size=(TREES, max(1, bits), width)).astype(np.float32)

        @F.pandas_udf("array<long>")
        def codes(vectors):
            x = _matrix(pa.chunked_array([pa.array(vectors, pa.binary())]), "<f4")
            weight = 1 << np.arange(bits)
            return __import__("pandas").Series(list(np.stack([(x @ p[:bits].T > 0) @ weight for p in planes], axis=1)))

        vectors = self.nodes.select(block_of("node").alias("block"), "node", lifted("vector", "length").alias("vector"))
        self.vectors = materialize(vectors, "ann_vectors")
        dealt = self.vectors.select("node", "vector", F.posexplode(codes("vector")).alias("tree", "code"))
        random = F.pmod(F.xxhash64(F.lit("random"), "node"), F.lit(1 << bits)).alias("code")
        dealt = dealt.unionByName(self.vectors.select("node", "vector", F.lit(-1).alias("tree"), random))
        sizes = dealt.groupBy("tree", "code").agg(F.count("*").alias("size"))
        part = F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("size") / LEAF)).alias("part")
        buckets = dealt.join(sizes, ["tree", "code"]).select("tree", "code", part, "node", "vector")
        offers = buckets.groupBy("tree", "code", "part").applyInArrow(_all_pairs, _OFFERS)
        empty = self.vectors.select("*", F.lit(b"").alias("nodes"), F.lit(b"").alias("sims"), F.lit(0).alias("changed"))
        state = self._merged(empty, offers)
        for _ in range(ROUNDS):
            state = self._round(state)
            if state.agg(F.sum("changed")).first()[0] < QUIET * self.count:
                break
        return self._with_reverse(state)

    def _merged(self, state: DataFrame, offers: DataFrame) -> DataFrame:
        both = state.unionByName(offers, allowMissingColumns=True)
        return materialize(both.groupBy("block").applyInArrow(_merge, _STATE), "ann_state")

    @staticmethod
    def _edges(state: DataFrame) -> DataFrame:
        return state.select("node", F.explode(_longs("nodes")).alias("near"))

    def _reverse(self, edges: DataFrame) -> DataFrame:
        """(node, near): a sample of the nodes that have ``node`` in their lists, a slot each."""
        slot = F.pmod(F.xxhash64("node", "near"), F.lit(SAMPLE)).alias("slot")
        sampled = edges.groupBy(F.col("near").alias("centre"), slot).agg(F.min_by("node", F.xxhash64("near", "node")).alias("n"))
        return sampled.select(F.col("centre").alias("node"), F.col("n").alias("near"))

    def _round(self, state: DataFrame) -> DataFrame:
        edges = self._edges(state)
        pairs = edges.unionByName(self._reverse(edges)).select(
            block_of("near").alias("block"), F.col("near").alias("sender"), F.col("node").alias("centre")
        )
        pairs = materialize(pairs, "ann_pairs")
        # a block with a node that very many others list sends in several parts
        parts = pairs.groupBy("block").agg(F.ceil(F.count("*") / EDGES).alias("parts"))
        part = F.pmod(F.xxhash64(block_of("centre")), F.col("parts")).alias("part")
        dealt = pairs.join(parts, "block").select("block", part, "sender", "centre")
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
        senders = state.join(parts, "block").select("block", each, "node", "vector", "nodes", "sims")
        keys = ["block", "part"]
        messages = dealt.groupBy(*keys).cogroup(senders.groupBy(*keys)).applyInArrow(_messages, _MESSAGES)
        offers = messages.groupBy("to").applyInArrow(_local_join, _OFFERS)
        return self._merged(state, offers)

    def _with_reverse(self, state: DataFrame) -> DataFrame:
        """(node, nears): the lists and a sample of the reverse ones."""
        edges = self._edges(state)
        both = edges.unionByName(self._reverse(edges))
        return materialize(both.groupBy("node").agg(F.collect_set("near").alias("nears")), "ann_graph")

    def search(self, starts: DataFrame) -> DataFrame:
        """(query, node): the best nodes found for each query node of ``starts`` (query)."""
        start = _pack_longs(F.array("query")).alias("nodes")
        beam = self._asked(starts.select("query")).select(
            "query", "query_vector", start, F.lit(b"\x00\x00\x80\x7f").alias("sims"), F.lit(b"\x00").alias("expanded")
        )
        beam = materialize(beam, "ann_beam")
        entries = self.nodes.select("node").orderBy(F.xxhash64(F.lit("entry"), "node")).limit(ENTRIES).collect()
        reached = starts.select("query", F.explode(F.lit([r.node for r in entries])).alias("near")).where("near != query")
        found = None
        while not beam.isEmpty():
            opened = beam.select("query", F.explode(_open_nodes("nodes", "expanded")).alias("node"))
            nears = opened.join(self.graph, "node").select("query", F.explode("nears").alias("near"))
            every = self._expand(beam, (reached.unionByName(nears) if reached else nears).distinct())
            reached = None
            # a beam without open entries is ready and goes into no later round
            ready = every.where("open = 0").select("query", F.explode(_longs("nodes")).alias("node"))
            found = found.unionByName(ready) if found else ready
            beam = every.where("open > 0")
        return found if found else starts.select("query", F.col("query").alias("node"))

    def _asked(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (query, ..) with the vectors of the queries."""
        queries = self.vectors.select(F.col("node").alias("query"), F.col("vector").alias("query_vector"))
        return wanted.join(queries, "query")

    def _expand(self, beam: DataFrame, reached: DataFrame) -> DataFrame:
        wanted = reached.groupBy("query", block_of("near").alias("block")).agg(F.collect_list("near").alias("nears"))
        least = F.when(F.octet_length("nodes") < 8 * BEAM, float("-inf")).otherwise(_last_sim("sims")).alias("least")
        asked = wanted.join(beam.select("query", "query_vector", least), "query")
        asked = asked.select("block", "query", "query_vector", "least", _pack_longs(F.col("nears")).alias("nears"))
        held = self.vectors.select("block", "node", "vector")
        scored = asked.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(_score, "query long, nodes binary, sims binary")
        both = beam.select("query", "query_vector", "nodes", "sims").unionByName(scored, allowMissingColumns=True)
        keyed = both.withColumn("part", block_of("query"))
        return materialize(keyed.groupBy("part").applyInArrow(_merge_beams, _BEAM), "ann_beam")

    def scan(self, starts: DataFrame, most: int) -> DataFrame:
        """(query, node): the ``most`` best nodes of every block for each query node of ``starts``."""
        blocks = self.vectors.select("block").distinct()
        listed = F.explode(blocks.agg(F.collect_list("block")).scalar()).alias("block")
        asked = self._asked(starts.select("query", listed)).select("block", "query", "query_vector")
        held = self.vectors.select(F.col("block").alias("home"), "node", "vector")
        found = asked.groupBy("block").cogroup(held.groupBy("home")).applyInArrow(_score_block(most), "query long, nodes binary")
        return found.select("query", F.explode(_longs("nodes")).alias("node"))


def _last_sim(packed: str) -> Column:
    @F.pandas_udf("float")
    def last(lists):
        return lists.map(lambda b: np.frombuffer(b, "<f4")[-1] if b else -np.inf).astype("float32")

    return last(packed)


def _open_nodes(nodes: str, expanded: str) -> Column:
    @F.pandas_udf("array<long>")
    def unexpanded(near, done):
        import pandas as pd

        return pd.Series(
            [
                np.frombuffer(n, "<i8")[:EXPAND][np.frombuffer(d, np.uint8)[:EXPAND] == 0]
                for n, d in zip(near, done, strict=True)
            ],
            dtype=object,
        )

    return unexpanded(nodes, expanded)


def _score(asked: pa.Table, held: pa.Table) -> pa.Table:
    """Products of queries with the nodes of one block, as far as they can enter the beam.

    A node's product does not depend on the other nodes of its call, so one that left a beam for
    better ones can never come back.
    """
    schema = pa.schema([("query", pa.int64()), ("nodes", pa.binary()), ("sims", pa.binary())])
    if not asked.num_rows or not held.num_rows:
        return schema.empty_table()
    nodes = held.column("node").to_numpy()
    order = np.argsort(nodes)
    nodes, x = nodes[order], _matrix(held.column("vector"), "<f4")[order]
    q = _matrix(asked.column("query_vector"), "<f4").copy()
    q[:, -1] = 0  # the query side of the product has no lift
    least = asked.column("least").to_numpy()
    near, lengths = _flat(asked.column("nears"), "<i8")
    at, ends = np.searchsorted(nodes, near), np.append(0, np.cumsum(lengths))
    query, packed, sims = asked.column("query").to_numpy(), [], []
    for i, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        sim = (x[at[lo:hi]] * q[i]).sum(axis=1)
        keep = np.flatnonzero(sim >= least[i])
        if len(keep) > BEAM:
            keep = keep[np.lexsort((near[lo + keep], -sim[keep]))[:BEAM]]
        packed.append(near[lo + keep].tobytes())
        sims.append(sim[keep].astype("<f4").tobytes())
    some = np.array([len(p) > 0 for p in packed])
    scored = pa.table([pa.array(query), pa.array(packed, pa.binary()), pa.array(sims, pa.binary())], schema=schema)
    return scored.filter(pa.array(some))


def _score_block(most: int):
    """The best nodes of one block for each query."""

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        schema = pa.schema([("query", pa.int64()), ("nodes", pa.binary())])
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        nodes, x = held.column("node").to_numpy(), _matrix(held.column("vector"), "<f4")
        q = _matrix(asked.column("query_vector"), "<f4").copy()
        q[:, -1] = 0
        packed = []
        for one in q:
            sim = x @ one
            k = min(most, len(sim))
            packed.append(nodes[np.argpartition(-sim, k - 1)[:k]].astype("<i8").tobytes())
        return pa.table([asked.column("query"), pa.array(packed, pa.binary())], schema=schema)

    return best


def _merge_beams(rows: pa.Table) -> pa.Table:
    """Beams with newly scored nodes; nodes that were open before count as expanded now."""
    is_beam = rows.column("query_vector").is_valid()
    beams, scored = rows.filter(is_beam), rows.filter(pa.compute.invert(is_beam))
    queries = beams.column("query").to_numpy()
    held, row = _lists(beams.column("nodes"), "<i8")
    offered, offer_row = _lists(scored.column("nodes"), "<i8")
    sort = np.argsort(queries)
    owner_row = sort[np.searchsorted(queries[sort], scored.column("query").to_numpy())]
    owner, near = np.append(row, owner_row[offer_row]), np.append(held, offered)
    sim = np.append(_flat(beams.column("sims"), "<f4")[0], _flat(scored.column("sims"), "<f4")[0])
    # an entry of the beam comes before its own second score
    keep = _best(owner, near, sim, BEAM)
    done, n = keep < len(held), len(queries)
    rank = np.arange(len(keep)) - np.searchsorted(owner[keep], owner[keep])
    still = np.bincount(owner[keep], ~done & (rank < EXPAND), n).astype(np.int32)
    return pa.table(
        [queries, beams.column("query_vector"), _packed(owner[keep], near[keep], n), _packed(owner[keep], sim[keep], n),
         _packed(owner[keep], done.astype(np.uint8), n), still],
        ["query", "query_vector", "nodes", "sims", "expanded", "open"],
    )


def nearest(rows: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest other rows found for each query row."""
    narrow = rows.select(F.col(key).alias("id"), F.col(vector).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    index = Index(narrow.select("id", "vector"), k + 1)
    result = "query_id long, rank int, vec_id long, score double"
    if not index.count:
        return rows.sparkSession.createDataFrame([], result)
    nodes = index.nodes
    asking = narrow.where("asks and id is not null").select("id", F.transform("vector", lambda v: v.cast("double")).alias("vector"))
    owners = asking.join(nodes.select("node", "vector"), "vector").select(F.col("id").alias("query_id"), F.col("node").alias("query"))
    owners = materialize(owners, "ann_queries")
    starts = owners.select("query").distinct()
    found = materialize(index.search(starts), "ann_found")
    # a query without enough rows is scored against all nodes; its own row is one of those counted
    held = found.join(nodes.select("node", F.size("ids").alias("n")), "node").groupBy("query").agg(F.sum("n").alias("n"))
    short = materialize(starts.join(held, "query", "left").where(f"coalesce(n, 0) < {k + 1}").select("query"), "ann_short")
    if not short.isEmpty():
        whole = index.scan(short, k + 1)
        found = materialize(found.join(short, "query", "left_anti").unionByName(whole), "ann_found_all")
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    queries = nodes.select(F.col("node").alias("query"), F.col("vector").alias("query_vector"))
    scored = found.join(queries, "query").join(nodes.select("node", "vector", "ids"), "node")
    scored = scored.select("query", "ids", product(F.col("query_vector"), F.col("vector")).alias("score"))
    # at most BEAM nodes per query: the list of one query is bounded
    per_query = scored.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "ids"))).alias("found"))
    member = lambda f: F.transform(f["ids"], lambda i: F.struct(f["s"].alias("s"), i.alias("id")))
    ranked = F.array_sort(F.flatten(F.transform("found", member)))
    own = owners.join(per_query, "query").select("query_id", ranked.alias("found"))
    own = own.select("query_id", F.slice(_without_one(F.col("found"), F.col("query_id")), 1, k).alias("found"))
    out = own.select("query_id", F.posexplode("found").alias("at", "f"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("f.id").alias("vec_id"), (-F.col("f.s")).alias("score"))


def _without_one(found: Column, own: Column) -> Column:
    """The list without one entry of the query's own id."""
    at = F.array_position(F.transform(found, lambda f: f["id"]), own).cast("int")
    return F.when(at > 0, F.concat(F.slice(found, F.lit(1), at - 1), F.slice(found, at + 1, F.size(found)))).otherwise(found)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op4_nearest_neighbours": op4_nearest_neighbours}
SQL: dict[str, str] = {}
