"""Noise removal and sequence encoding on comma lists and event groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import comma_parts, non_empty
from tracewell.operators.order import global_rank
from tracewell.session import small_side


def _without(parts: Column, noise: Sequence[str]) -> Column:
    listed = F.array(*[F.lit(n) for n in noise]).cast("array<string>")
    return F.filter(parts, lambda x: ~F.array_contains(listed, x))


def remove_noise(lines: DataFrame, noise: Sequence[str], drop_empty: bool, line: str = "line") -> DataFrame:
    """Remove listed templates from each comma list; duplicates of other templates stay.

    With ``drop_empty`` a line left without any part disappears, else it becomes an empty line.
    """
    cleaned = lines.withColumn("_kept", _without(comma_parts(line), noise))
    if drop_empty:
        cleaned = cleaned.filter(F.size("_kept") > 0)
    return cleaned.withColumn(line, F.array_join("_kept", ", ")).drop("_kept")


def remove_noise_table(items: DataFrame, noise: DataFrame, item: str = "template") -> DataFrame:
    """The same on exploded lists, for a noise list too long to inline."""
    return items.join(noise.select(item).distinct(), item, "left_anti")


def multi_item(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines with more than one non-blank part, text unchanged."""
    return lines.filter(F.size(non_empty(comma_parts(line))) > 1)


def multi_item_groups(items: DataFrame, group: str, item: str = "item") -> DataFrame:
    """The exploded items of the groups with more than one non-blank part, counted over the whole group."""
    parts = F.sum(F.size(non_empty(comma_parts(item))))
    many = items.filter(F.col(item).isNotNull()).groupBy(group).agg(parts.alias("_parts")).filter("_parts > 1")
    return items.join(many.select(group), group, "left_semi")


def encode(events: DataFrame, dictionary: DataFrame, key: str = "template") -> DataFrame:
    """Attach the dictionary id of each event's template (a missing template counts as '').

    Events are never lost: one whose template the dictionary lacks fails the job.
    """
    filled = events.withColumn(key, F.coalesce(key, F.lit("")))
    named = dictionary.withColumn(key, F.coalesce(key, F.lit("")))
    ids = [c for c in dictionary.columns if c != key]
    joined = filled.join(small_side(named.groupBy(key).agg(*[F.min(c).alias(c) for c in ids])), key, "left")
    lost = F.raise_error(F.concat(F.lit("no dictionary id for "), key)).cast(dict(dictionary.dtypes)[ids[0]])
    return joined.withColumn(ids[0], F.coalesce(ids[0], lost))


def sequence_lines(
    encoded: DataFrame, group: Sequence[str], pos: str, item: str, sep: str, segment: int = 10_000
) -> DataFrame:
    """One separator-joined line per group, in event order.

    The row format is one of segments of ``segment`` events (``seg`` 0, 1, ...); each after the first
    begins with the separator, so plain concatenation is the line and no group is collected whole.
    """
    seg = F.floor(F.col(pos) / segment).cast("long").alias("seg")
    ordered = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(item).cast("string").alias("v"))))
    part = F.array_join(F.transform(ordered, lambda x: x["v"]), sep)
    lead = F.when(F.col("seg") > 0, F.lit(sep)).otherwise(F.lit(""))
    segments = encoded.groupBy(*group, seg).agg(part.alias("line"))
    return segments.withColumn("line", F.concat(lead, "line"))


def assign_parts(groups: DataFrame, order: Sequence[str], size: int = 500) -> DataFrame:
    """Number the groups in order and put ``size`` of them into each part."""
    numbered = global_rank(groups, order, "group_pos")
    return numbered.withColumn("part_id", F.floor(F.col("group_pos") / size).cast("long"))


def cap_parts(parts: DataFrame, last: int = 500) -> DataFrame:
    """Parts up to number ``last``: the stop rule of a bounded ingest."""
    return parts.filter(F.col("part_id") <= last)
