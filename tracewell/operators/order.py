"""Row order: dense positions, first occurrences and dictionaries.

Spark rows carry no order, so each table has explicit order columns. Numbering a group with one
window puts the whole group into one task; a group above ``hot_rows`` is therefore cut into
key-range buckets that are numbered in parallel and shifted by the running bucket totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import cut_lineage

HOT_ROWS = 2_000_000
KEY_WIDTH = 1_000_000


def key_range(c: str | Column, width: int = KEY_WIDTH) -> Column:
    """Range bucket of an integer order key; a unique key puts at most ``width`` rows in each."""
    return F.floor((F.col(c) if isinstance(c, str) else c) / F.lit(width)).cast("long")


def _before(value: Column, keys: Sequence[str | Column], order: Sequence[str | Column]) -> Column:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0).cast("long"))


def running_before(
    df: DataFrame,
    out: str,
    order: Sequence[str],
    bucket: Sequence[Column],
    group: Sequence[str] = (),
    value: Column | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` (default: the row count) over the earlier rows of the group.

    ``bucket`` must be non-decreasing along ``order`` and bound the rows of one value, as a range of
    a unique integer key does. Without a group all rows are bucketed.
    """
    value = F.lit(1).cast("long") if value is None else value.cast("long")
    group = list(group)
    names = [f"_b{i}" for i in range(len(bucket))]
    df = df.withColumn("_v", value)
    if group:
        hot = (
            df.groupBy(*group)
            .agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") > hot_rows)
            .select(*group, F.lit(True).alias("_hot"))
        )
        # At most rows / hot_rows groups can be hot, which bounds this broadcast.
        hot = F.broadcast(hot)
        cut = df.join(hot, group, "left")
        for name, b in zip(names, bucket):
            cut = cut.withColumn(name, F.when(F.col("_hot"), b.cast("long")).otherwise(F.lit(0)))
        hot_cut = df.join(hot, group)
        for name, b in zip(names, bucket):
            hot_cut = hot_cut.withColumn(name, b.cast("long"))
        cut = cut.drop("_hot")
    else:
        cut = df
        for name, b in zip(names, bucket):
            cut = cut.withColumn(name, b.cast("long"))
        hot_cut = cut
    totals = hot_cut.groupBy(*group, *names).agg(F.sum("_v").alias("_total"))
    shifts = totals.select(
        *group, *names, _before(F.col("_total"), group, names).alias("_shift")
    )
    local = cut.withColumn("_local", _before(F.col("_v"), [*group, *names], order))
    # The window above already partitions by these keys, so only the small side moves.
    return (
        local.join(shifts, [*group, *names], "left")
        .withColumn(out, F.col("_local") + F.coalesce(F.col("_shift"), F.lit(0).cast("long")))
        .drop("_v", "_local", "_shift", *names)
    )


def first_match(df: DataFrame, keys: Sequence[str], order: Column, payload: Sequence[str]) -> DataFrame:
    """The earliest row per key, as an aggregate with map-side combining."""
    best = F.min_by(F.struct(*payload), order).alias("_first")
    return df.groupBy(*keys).agg(best).select(*keys, "_first.*")


def distinct_first_seen(df: DataFrame, key: str, order: Column) -> DataFrame:
    """Distinct keys with the order value of their first row."""
    return df.groupBy(key).agg(F.min(order).alias("first_order"))


def global_rank(df: DataFrame, order: Sequence[str | Column], out: str) -> DataFrame:
    """0-based rank over all rows by a unique ``order``.

    The rows are range-partitioned on sampled bounds and checkpointed, so every partition is of
    similar size whatever the keys look like, and only one count per partition is summed up.
    """
    columns = df.columns
    ranged = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order))
    # The id holds the partition number above bit 33 and the row number inside it below.
    numbered = ranged.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    starts = sizes.select("_part", _before(F.col("_size"), [], ["_part"]).alias("_start"))
    # One row per partition.
    joined = numbered.withColumn("_part", part).join(F.broadcast(starts), "_part")
    local = F.col("_id") - F.shiftleft("_part", 33)
    return joined.select(*columns, (local + F.col("_start")).alias(out))


def group_rank(
    df: DataFrame, out: str, group: Sequence[str], order: Sequence[str], width: int = KEY_WIDTH
) -> DataFrame:
    """0-based position inside each group by ``order``, whatever the groups and keys look like.

    It is the global rank less that of the group's first row. The first rows meet per group and
    range of ``width`` ranks, so no task ever holds a whole group.
    """
    ranked = global_rank(df, [*group, *order], "_rank").withColumn("_range", key_range("_rank", width))
    first = ranked.groupBy(*group, "_range").agg(F.min("_rank").alias("_first"))
    first = first.withColumn("_first", F.min("_first").over(Window.partitionBy(*group)))
    placed = ranked.join(first, [*group, "_range"])
    return placed.withColumn(out, F.col("_rank") - F.col("_first")).drop("_rank", "_range", "_first")


def first_seen_dictionary(df: DataFrame, key: str, order: Column, id_col: str) -> DataFrame:
    """key -> 0-based id in first-seen order."""
    seen = distinct_first_seen(df, key, order)
    return global_rank(seen, ["first_order"], id_col).select(id_col, key)


def name_dictionary(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """key -> 0-based id in name order."""
    return global_rank(df.select(key).distinct(), [key], id_col).select(id_col, key)


def dense_index(
    df: DataFrame,
    out: str,
    group: Sequence[str],
    key: str,
    width: int = KEY_WIDTH,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """0-based dense position by a unique integer key inside each group."""
    return running_before(df, out, [key], [key_range(key, width)], group, hot_rows=hot_rows)


def with_halo(df: DataFrame, pos: str, chunk: int, before: int = 0, after: int = 0) -> DataFrame:
    """Cut a positioned series into chunks and copy each chunk's border rows to its neighbours.

    Adds ``_chunk`` and ``_own`` (true in the chunk that owns the row). A row is copied only when
    it lies within ``before`` rows ahead of, or ``after`` rows behind, another chunk's range.
    """
    p, c = F.col(pos), F.lit(chunk)
    home = F.floor(p / c).cast("long")
    first = F.greatest(F.lit(0).cast("long"), F.floor((p - F.lit(after)) / c).cast("long"))
    last = F.floor((p + F.lit(before)) / c).cast("long")
    return (
        df.withColumn("_home", home)
        .withColumn("_chunk", F.explode(F.sequence(first, last)))
        .withColumn("_own", F.col("_home") == F.col("_chunk"))
        .drop("_home")
    )
