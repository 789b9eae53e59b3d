"""Sharding by histogram sort: exact byte counts below candidate keys until the splitters fit.

Documents are ordered by a 64-bit key: the upper 40 bits hash the text, so equal texts are
neighbours, and the lower 24 bits hash the other columns. The first histogram counts bytes and rows
between evenly spaced keys. An interval that holds a splitter whose nearest border is further off
than the tolerance is counted again between finer candidates, and so is one too large to number in
one task. Shards then follow from the borders, and one exchange numbers the rows of each interval;
the counts already tell where each interval starts in its shard.

Splitters stop at the coarsest border within the tolerance, so a group of equal texts is cut only
where it is too large to stay whole. Rows that are equal in every column share a key and a shard. A
null text has size 1; shards stay empty where there are fewer rows than shards; an empty table gives
an empty result. Columns that have the names of the results are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import free_name, table, text_of
from tracewell.session import materialize

#: Leading bits that the refinements look at after the first histogram; 40 ends the text's part.
LEVELS = (20, 30, 40, 52, 64)
FIRST_BITS = (10, 18)
INTERVAL_BYTES = 128 << 20


def sort_key(docs: DataFrame, text: str) -> Column:
    others = [F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(0)]
    tie = F.xxhash64(*others)
    return F.xxhash64(text_of(text)).bitwiseAND(F.lit(-1 << 24)).bitwiseOR(tie.bitwiseAND(F.lit((1 << 24) - 1)))


def _low(key: Column, bits: int) -> Column:
    """The lowest key with the same leading bits."""
    return key if bits == 64 else key.bitwiseAND(F.lit(-1 << (64 - bits)))


def _unsigned(low: int) -> int:
    return low % (1 << 64)


class Histogram:
    """Disjoint key intervals with exact bytes and rows; some are refined into finer ones."""

    def __init__(self, keys: DataFrame, shards: int, tolerance: float) -> None:
        self.keys, self.shards = keys, shards
        total = keys.agg(F.sum("size")).first()[0] or 0
        fewest, most = FIRST_BITS
        bits = min(most, max(fewest, math.ceil(math.log2(max(1, total / INTERVAL_BYTES)))))
        self.levels = (bits, *LEVELS)
        self.refined: list[list[int]] = []
        self.allowed = tolerance * total / shards
        self.too_large = max(INTERVAL_BYTES, total >> fewest) if total > INTERVAL_BYTES else total / 64
        self.total = total
        self.intervals = self._count(keys, bits)
        while wanted := self._unfit():
            self.refined.append(wanted)
            rows = keys.where(self.interval(F.col("key"), len(self.refined) - 1).isin(wanted))
            for low in wanted:
                del self.intervals[low]
            self.intervals |= self._count(rows, self.levels[len(self.refined)])

    def _count(self, rows: DataFrame, bits: int) -> dict[int, tuple[int, int, int]]:
        counted = rows.groupBy(_low(F.col("key"), bits).alias("low")).agg(
            F.sum("size").alias("bytes"), F.count("*").alias("rows")
        )
        return {r.low: (bits, r.bytes, r.rows) for r in counted.collect()}

    def interval(self, key: Column, depth: int | None = None) -> Column:
        """The interval of a key, named by its lowest key."""
        low = _low(key, self.levels[0])
        for refined, bits in zip(self.refined[:depth], self.levels[1:], strict=False):
            low = F.when(low.isin(refined), _low(key, bits)).otherwise(low)
        return low

    def _unfit(self) -> list[int]:
        """Intervals of the finest level yet that need finer candidates."""
        bits = self.levels[len(self.refined)]
        if bits == 64:
            return []
        out, below, k = [], 0, 1
        for low in sorted(self.intervals, key=_unsigned):
            level, size, _ = self.intervals[low]
            above = below + size
            off = False
            while k < self.shards and k * self.total <= above * self.shards:
                goal = k * self.total / self.shards
                off |= min(goal - below, above - goal) > self.allowed
                k += 1
            if level == bits and (off or size > self.too_large):
                out.append(low)
            below = above
        return out

    def placed(self) -> list[tuple[int, int, int]]:
        """(interval, shard, rows of the shard before it); each splitter takes its nearest border."""
        lows = sorted(self.intervals, key=_unsigned)
        out, below, shard, before = [], 0, 0, 0
        for low in lows:
            _, size, rows = self.intervals[low]
            nearest = int(math.floor((below + size / 2) * self.shards / max(1, self.total)))
            if (at := min(self.shards - 1, nearest)) > shard:
                shard, before = at, 0
            out.append((low, shard, before))
            below, before = below + size, before + rows
        return out


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.005, text: str = "text") -> DataFrame:
    """``docs`` with size, shard and slot; bytes per shard are equal within twice the tolerance.

    ``tolerance`` is the distance of a splitter from its exact place as a share of a shard. Where a
    border between single rows does not get that near, the nearest one is taken.
    """
    spark = docs.sparkSession
    rows = docs.drop("size", "shard", "slot")
    key, low = free_name(docs, "key"), free_name(docs, "low")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    # the same expression in both passes: a key depends on the row alone
    narrow = materialize(rows.select(sort_key(rows, text).alias("key"), size.alias("size")), "shard_keys")
    histogram = Histogram(narrow, shards, tolerance)
    # one row per interval: at most 2 ** 18 and 1,024 more for each refined one
    places = F.broadcast(spark.createDataFrame(histogram.placed(), f"`{low}` long, shard int, before long"))
    keyed = rows.withColumn(key, sort_key(rows, text)).withColumn("size", size)
    keyed = keyed.withColumn(low, histogram.interval(F.col(key)))
    ties = [F.col(f"`{c}`") for c, t in rows.dtypes if c != text and not t.startswith(("map", "variant"))]
    within = Window.partitionBy(low).orderBy(key, *ties)
    numbered = keyed.withColumn("slot", F.row_number().over(within).cast("long"))
    placed = numbered.join(places, low)
    return placed.withColumn("slot", F.col("slot") - 1 + F.col("before")).drop(key, low, "before")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs.withColumn("text_crc32", F.crc32(text_of("text")))).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op2_sharding": op2_sharding}
SQL: dict[str, str] = {}
