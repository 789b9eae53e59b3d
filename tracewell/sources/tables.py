"""Adapters: the given Parquet tables in the roles of event groups, log lines and baskets."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.text import text_lines
from tracewell.operators.cleaning import sequence_lines
from tracewell.operators.order import dense_index, group_rank, key_range, running_before

# Events of one group that may share a row; longer groups span several rows (segments).
SEGMENT = 10_000
# Items of one range of the order, by which the positions in a group are found in parallel.
HOT_ITEMS = 1_000_000
# Items whose distinct pairs one task holds.
PART_ITEMS = 500_000
# Documents of a source above which it is cut into key ranges.
HOT_DOCS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event. A file is one day, a group one user of that day.

    (file_no, group_no, seq) is the total order: files, then groups, then arrival.
    """
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))
    return e.select(
        day.alias("file_no"),
        F.concat(F.lit("part_"), day.cast("string"), F.lit(".json")).alias("source_file"),
        F.col("user_id").alias("group_no"),
        F.col("user_id").cast("string").alias("group_key"),
        F.col("event_id").alias("seq"),
        F.col("event_id").cast("string").alias("event_id"),
        F.get_json_object("props", "$.k").alias("dup_id"),
        F.col("props").alias("raw"),
        F.col("event_type").alias("template"),
    )


def event_order() -> Column:
    return F.struct("file_no", "group_no", "seq")


def positioned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their 0-based position ``pos`` inside (file, group)."""
    return dense_index(events(spark, sf_dir), "pos", ["file_no", "source_file", "group_no", "group_key"], "seq")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template time series: (source, line_no, template), one source per user."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("source"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("template"),
    )
    return dense_index(e, "line_no", ["source"], "seq").select("source", "line_no", "template")


def flat_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, template) of the time series without positions: no shuffle."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("source"), F.col("event_type").alias("template")
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker series: (source, line_no, template), one source per conversation."""
    c = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("source"), "turn", F.col("role").alias("template")
    )
    return dense_index(c, "line_no", ["source"], "turn").select("source", "line_no", "template")


def doc_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0/1 traits of each document as columns."""
    text = F.col("text")
    traits = {
        "digit": text.rlike("[0-9]"),
        "english": F.col("lang") == "en",
        "long": F.col("n_chars") > 1500,
        "mail": text.contains("@"),
        "multiline": text.contains("\n"),
        "url": text.contains("http"),
    }
    return table(spark, sf_dir, "documents").select(*[c.cast("int").alias(n) for n, c in traits.items()])


def doc_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size measures of each document as columns."""
    text = F.col("text")
    lengths = {
        "chars": F.col("n_chars"),
        "commas": F.length(text) - F.length(F.replace(text, F.lit(","), F.lit(""))),
        "lines": F.size(F.split(text, "\n")),
        "words": F.size(F.split(text, " ")),
    }
    return table(spark, sf_dir, "documents").select(*[c.cast("double").alias(n) for n, c in lengths.items()])


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their non-blank lines as an array."""
    return table(spark, sf_dir, "documents").select(
        "source", "doc_id", text_lines("text").alias("parts")
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines: (source, line_no, template), numbered by (doc_id, position) per source."""
    docs = doc_lines(spark, sf_dir)
    numbered = running_before(
        docs,
        "_start",
        ["doc_id"],
        [key_range("doc_id", 10_000)],
        ["source"],
        value=F.size("parts"),
        hot_rows=HOT_DOCS,
    )
    return numbered.select(
        "source", "_start", F.posexplode("parts").alias("_i", "template")
    ).select("source", (F.col("_start") + F.col("_i")).alias("line_no"), "template")


def flat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines with their natural order columns instead of a dense number: no shuffle."""
    return doc_lines(spark, sf_dir).select(
        "source", "doc_id", F.posexplode("parts").alias("pos", "template")
    )


def basket_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, var): the distinct brands of each order.

    Few items repeat a brand of their order, so they are dealt before they are made distinct: a task
    holds one part's pairs, not those of a whole file split.
    """
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    named = item.join(part, item.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("row_id"), F.col("p_brand").alias("var")
    )
    return named.repartition(item.count() // PART_ITEMS + 1, "row_id", "var").distinct()


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, l_linenumber, l_partkey, l_suppkey, item): the brand of each item of an order."""
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return item.join(part, item.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("group_id"), "l_linenumber", "l_partkey", "l_suppkey", F.col("p_brand").alias("item")
    )


def item_lines(items: DataFrame) -> DataFrame:
    """(group_id, seg, line): the items of each order in line order, joined by ', '.

    Every order has the format of ``sequence_lines``: segments of SEGMENT items, numbered from 0.
    """
    key = ["l_linenumber", "l_partkey", "l_suppkey"]
    placed = group_rank(items.filter(F.col("item").isNotNull()), "pos", ["group_id"], key, HOT_ITEMS)
    return sequence_lines(placed, ["group_id"], "pos", "item", ", ", SEGMENT)


def group_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed-group JSON text assembled from the events: (file_no, source_file, group_no, seg, value).

    ``metadata`` is the raw text of the group's first 'signup' event, else null. Every segment of a
    long group carries it.
    """
    keys = ["file_no", "source_file", "group_no", "group_key"]
    signup = F.min_by(
        F.when(F.col("template") == "signup", F.col("raw")), F.when(F.col("template") == "signup", F.col("seq"))
    )
    e = positioned_events(spark, sf_dir)
    seg = F.floor(F.col("pos") / SEGMENT).alias("seg")
    item = F.struct("pos", "event_id", "dup_id", "raw", "template")
    grouped = e.groupBy(*keys, seg).agg(
        F.sort_array(F.collect_list(item)).alias("items"), signup.alias("metadata")
    )
    long = (
        events(spark, sf_dir)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), signup.alias("_metadata"))
        .filter(F.col("_n") > SEGMENT)
    )
    grouped = grouped.join(long, keys, "left").withColumn(
        "metadata", F.when(F.col("_n").isNotNull(), F.col("_metadata")).otherwise(F.col("metadata"))
    )
    group = F.transform("items", lambda x: F.struct(x.event_id, x.dup_id, x.raw, x.template))
    group = group.cast("array<struct<event_id:string,dup_id:string,raw:string,template:string>>")
    body = F.struct(F.col("metadata").alias("metadata"), group.alias("group"))
    return grouped.select(
        "file_no",
        "source_file",
        "group_no",
        "seg",
        F.to_json(F.create_map("group_key", body)).alias("value"),
    )
