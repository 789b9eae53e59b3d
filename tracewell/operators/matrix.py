"""Multi-hot matrices in long form, sparse samples of their rows, and discretisation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.text import strip
from tracewell.operators.order import name_dictionary
from tracewell.session import small_side


def basket_members(lines: DataFrame, row_id: str, line: str = "line") -> DataFrame:
    """Distinct (row_id, var) of ', '-separated baskets."""
    items = F.array_distinct(F.split(strip(line), ", "))
    return lines.select(F.col(row_id).alias("row_id"), F.explode(items).alias("var"))


def row_sets(members: DataFrame) -> DataFrame:
    """(row_id, items): the sorted variable set of each row.

    Members are distinct, so a set never holds more items than there are variables.
    """
    return members.groupBy("row_id").agg(F.array_sort(F.collect_set("var")).alias("items"))


def set_patterns(sets: DataFrame) -> DataFrame:
    """Distinct sets with their weight; everything downstream counts patterns, not rows."""
    return sets.groupBy("items").agg(F.count(F.lit(1)).alias("weight"))


def variables(rows: DataFrame, column: str) -> DataFrame:
    """(v, name): the distinct names of a column, numbered in name order."""
    named = name_dictionary(rows.select(F.col(column).alias("name")).where(F.col(column).isNotNull()), "name", "v")
    return named.select(F.col("v").cast("int").alias("v"), "name")


def listed_variables(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """(v, name) of names that the caller lists, in that order."""
    return spark.createDataFrame(list(enumerate(names)), "v int, name string")


def _merged(items: DataFrame) -> DataFrame:
    return items.groupBy("items").agg(F.sum("weight").alias("weight"))


def item_samples(patterns: DataFrame, variables: DataFrame) -> DataFrame:
    """Set patterns as sparse samples: (items, weight) with the (v, c) of each member; c is 1.

    Members that are no variable are left out; a pattern of such members only has no items.
    """
    members = patterns.select("items", "weight", F.explode_outer("items").alias("name"))
    known = members.join(small_side(variables), "name", "left")
    item = F.when(F.col("v").isNotNull(), F.struct(F.col("v"), F.lit(1).alias("c")))
    found = known.groupBy("items", "weight").agg(F.array_sort(F.collect_list(item)).alias("found"))
    return _merged(found.select(F.col("found").alias("items"), "weight"))


def coded_samples(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Integer columns as sparse samples; the variable is the place of its column.

    Rows with a missing code take no part.
    """
    whole = rows.where(reduce(Column.__and__, (F.col(c).isNotNull() for c in columns)))
    items = F.array(*[F.struct(F.lit(i).alias("v"), F.col(c).cast("int").alias("c")) for i, c in enumerate(columns)])
    kept = F.filter(items, lambda x: x["c"] != 0)
    return whole.groupBy(kept.alias("items")).agg(F.count(F.lit(1)).alias("weight"))


def coded_names(rows: DataFrame, column: str) -> DataFrame:
    """Replace the values of a column by their numbers in name order; null stays null."""
    numbers = variables(rows, column).withColumnsRenamed({"name": column, "v": "_v"})
    return rows.join(small_side(numbers), column, "left").drop(column).withColumnRenamed("_v", column)


def counted_samples(rows: DataFrame, sample: Sequence[str], column: str, variables: DataFrame) -> DataFrame:
    """How often each variable occurs in a sample, as sparse samples."""
    counts = rows.groupBy(*sample, F.col(column).alias("name")).agg(F.count(F.lit(1)).cast("int").alias("c"))
    known = counts.join(small_side(variables), "name", "left")
    item = F.when(F.col("v").isNotNull(), F.struct("v", "c"))
    found = known.groupBy(*sample).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return _merged(found.select("items", F.lit(1).cast("long").alias("weight")))


def uniform_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Ordinal of ``value`` among equal-width bins; the maximum lands in the last one."""
    code = F.floor((value - low) * bins / (high - low))
    inside = F.greatest(F.lit(0), F.least(F.lit(bins - 1), code)).cast("int")
    return F.when(value.isNull(), F.lit(None).cast("int")).when(high > low, inside).otherwise(0)


def discretize(rows: DataFrame, columns: Sequence[str], bins: int = 5) -> DataFrame:
    """Replace each column by its equal-width bin; one pass finds all ranges."""
    ends = [f(c).alias(f"_{tag}_{c}") for c in columns for tag, f in (("lo", F.min), ("hi", F.max))]
    bounds = rows.agg(F.struct(*ends).alias("_r")).scalar()
    coded = rows.withColumn("_r", bounds)
    for c in columns:
        coded = coded.withColumn(c, uniform_bin(F.col(c), F.col(f"_r._lo_{c}"), F.col(f"_r._hi_{c}"), bins))
    return coded.drop("_r")
