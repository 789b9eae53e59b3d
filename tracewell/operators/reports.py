"""Frequency reports and lookups over flat events. All are one aggregate plus small joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions.text import strip
from tracewell.operators.order import first_match, global_rank
from tracewell.session import cut_lineage, small_side

KEYWORDS = ("make", "compile", "linker", "error")


def request_list(spark: SparkSession, values: Sequence[str], name: str) -> DataFrame:
    """Requested values with their position; duplicates stay."""
    rows = [(i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"pos long, {name} string")


def with_template(events: DataFrame) -> DataFrame:
    return events.filter(F.col("template").isNotNull() & (F.col("template") != ""))


def template_freq(events: DataFrame, order: Column) -> DataFrame:
    """Occurrences per template, most frequent first, ties in first-seen order."""
    counted = with_template(events).groupBy("template").agg(
        F.count(F.lit(1)).alias("occurrences"), F.min(order).alias("_first")
    )
    return counted.orderBy(F.desc("occurrences"), "_first").drop("_first")


def id_filter(events: DataFrame, column: str, ids: Sequence[str]) -> DataFrame:
    return events.filter(F.col(column).isin(list(ids)))


def files_with_all_ids(events: DataFrame, ids: Sequence[str], at_least: int = 2) -> DataFrame:
    """Files where every listed id occurs ``at_least`` times, by total count."""
    wanted = list(dict.fromkeys(ids))
    per_id = (
        id_filter(events, "dup_id", wanted)
        .groupBy("source_file", "dup_id")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .filter(F.col("cnt") >= at_least)
    )
    per_file = per_id.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n_ids"), F.sum("cnt").alias("total")
    )
    return (
        per_file.filter(F.col("n_ids") == len(wanted))
        .select("source_file", "total")
        .orderBy(F.desc("total"), "source_file")
    )


def matching_report(events: DataFrame, ids: Sequence[str], at_least: int = 2) -> DataFrame:
    """(place, line): the files of ``files_with_all_ids`` by falling total, each with its counts."""
    wanted = list(dict.fromkeys(ids))
    files = global_rank(files_with_all_ids(events, wanted, at_least), [F.desc("total"), "source_file"], "rank")
    files = cut_lineage(files)
    counts = id_filter(events, "dup_id", wanted).groupBy("source_file", "dup_id").agg(F.count(F.lit(1)).alias("cnt"))
    at = F.array_position(F.array(*[F.lit(i) for i in wanted]), F.col("dup_id"))
    start = 1 + F.col("rank") * (len(wanted) + 1)
    heads = files.select(start.alias("place"), F.format_string("File: %s - total %d", "source_file", "total").alias("line"))
    each = counts.join(small_side(files), "source_file").select(
        (start + at).alias("place"), F.format_string("  %s: %d", "dup_id", "cnt").alias("line")
    )
    none = f"No file holds every id at least {at_least} times" if files.isEmpty() else "Files by total occurrences of the ids"
    title = events.sparkSession.createDataFrame([(0, none)], "place long, line string")
    return title.unionByName(heads).unionByName(each)


def files_with_any_id(events: DataFrame, column: str, ids: Sequence[str]) -> DataFrame:
    """Per file the count of each listed id that occurs in it."""
    return (
        id_filter(events, column, ids)
        .groupBy("source_file", column)
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy("source_file", column)
    )


def keyword_counts(events: DataFrame, words: Sequence[str] = KEYWORDS) -> DataFrame:
    """Per file the events whose lower-cased template contains each keyword; zeros stay."""
    text = F.lower(F.coalesce("template", F.lit("")))
    return (
        events.groupBy("source_file")
        .agg(*[F.count_if(text.contains(w)).alias(w) for w in words])
        .orderBy("source_file")
    )


def top_ids(events: DataFrame, order: Column, n: int = 20) -> DataFrame:
    """The n most frequent dup_ids with the text of their first event."""
    kept = events.filter(F.col("dup_id").isNotNull() & (F.col("dup_id") != ""))
    counted = kept.groupBy("dup_id").agg(
        F.count(F.lit(1)).alias("frequency"),
        F.min(order).alias("_order"),
        F.min_by(F.struct("raw", "template"), order).alias("_first"),
    )
    return (
        counted.orderBy(F.desc("frequency"), "_order")
        .limit(n)
        .select("dup_id", "frequency", "_first.raw", "_first.template")
    )


def template_search(events: DataFrame, requested: DataFrame) -> DataFrame:
    """Occurrences and distinct files of requested templates, compared lower-cased and stripped.

    Counted per (template, file) first, so one task never holds a template's whole file set twice.
    """
    norm = F.lower(strip("template"))
    wanted = requested.select(F.lower(strip("template")).alias("norm")).distinct()
    per_file = (
        events.select(norm.alias("norm"), "source_file")
        .join(F.broadcast(wanted), "norm", "left_semi")  # a caller's request list
        .groupBy("norm", "source_file")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    per_template = per_file.groupBy("norm").agg(
        F.sum("cnt").alias("cnt"), F.count(F.lit(1)).alias("n_files")
    )
    asked = requested.withColumn("norm", F.lower(strip("template")))
    zero = F.lit(0).cast("long")
    return (
        asked.join(per_template, "norm", "left")
        .select(
            "pos",
            "template",
            F.coalesce("cnt", zero).alias("occurrences"),
            F.coalesce("n_files", zero).alias("n_files"),
        )
        .orderBy("pos")
    )


def template_search_files(events: DataFrame, requested: DataFrame) -> DataFrame:
    """The distinct files behind ``template_search``, one row each."""
    wanted = requested.select(F.lower(strip("template")).alias("norm")).distinct()
    return (
        events.select(F.lower(strip("template")).alias("norm"), "source_file")
        .join(F.broadcast(wanted), "norm", "left_semi")  # a caller's request list
        .groupBy("norm", "source_file")
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .orderBy("norm", "source_file")
    )


def lookup(
    events: DataFrame,
    requested: DataFrame,
    key: str,
    order: Column,
    payload: Sequence[str],
    missing: str = "NOT FOUND",
) -> DataFrame:
    """First event per requested key, in request order; absent keys are reported."""
    wanted = F.broadcast(requested.select(key).distinct())  # a caller's request list
    hits = first_match(events.join(wanted, key, "left_semi"), [key], order, payload)
    hits = hits.withColumn("_hit", F.lit(True))
    columns = [
        F.when(F.col("_hit"), F.col(p)).otherwise(F.lit(missing)).alias(p) for p in payload
    ]
    return requested.join(hits, key, "left").select("pos", key, *columns).orderBy("pos")


def line_counts(lines: DataFrame, source: str = "source") -> DataFrame:
    return lines.groupBy(source).agg(F.count(F.lit(1)).alias("n_lines"))


def relabel(rows: DataFrame, column: str, dictionary: DataFrame, id_col: str, key: str) -> DataFrame:
    """Replace ids by their template text."""
    return (
        rows.join(dictionary, rows[column] == dictionary[id_col])
        .drop(id_col)
        .withColumnRenamed(key, f"{column}_{key}")
    )


def next_template(
    pairs: DataFrame, top_k: int = 50, top_p: float = 0.95, temperature: float = 0.8
) -> DataFrame:
    """Distribution of the following template: tempered, cut to top-k and nucleus, renormalised.

    ``pairs`` holds (cur, next) rows; only their counts are ranked.
    """
    counted = pairs.groupBy("cur", "next").agg(F.count(F.lit(1)).alias("cnt"))
    by_cur = Window.partitionBy("cur")
    ranked = by_cur.orderBy(F.desc("cnt"), "next")
    total = counted.withColumn("_p", F.col("cnt") / F.sum("cnt").over(by_cur))
    tempered = total.withColumn("_t", F.pow("_p", F.lit(1.0 / temperature)))
    top = tempered.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= top_k)
    probs = top.withColumn("_q", F.col("_t") / F.sum("_t").over(by_cur))
    before = F.coalesce(
        F.sum("_q").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
    )
    kept = probs.withColumn("_before", before).filter(F.col("_before") < top_p)
    prob = F.col("_q") / F.sum("_q").over(by_cur)
    return kept.select("cur", "next", "cnt", prob.alias("prob"))
