"""Incremental ingest of part files and running counters with Structured Streaming."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.operators.cleaning import encode, sequence_lines
from tracewell.operators.order import global_rank
from tracewell.sources.groups import PART_NAME, explode_groups, flatten_groups, quarantine, valid_groups

DICTIONARY = "template_id long, template string, batch long"


def stream_parts(spark: SparkSession, path: str, files_per_trigger: int = 1_000) -> DataFrame:
    """Part files as a stream of whole documents (source_file, value)."""
    raw = (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("pathGlobFilter", "part_*.json")
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
    )
    named = raw.select(F.col("_metadata.file_name").alias("source_file"), "value")
    return named.filter(F.col("source_file").rlike(PART_NAME))


def _read_batches(spark: SparkSession, path: str, schema: str, below: int) -> DataFrame:
    try:
        stored = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return stored.filter(F.col("batch") < below)


def extend_dictionary(known: DataFrame, events: DataFrame) -> DataFrame:
    """Ids for templates not in ``known``: they continue after its highest id in first-seen order."""
    number = F.regexp_extract("source_file", r"(\d+)", 1).cast("long")
    fresh = (
        events.filter(F.col("template").isNotNull())
        .groupBy("template")
        .agg(F.min(F.struct(number.alias("part"), F.col("place"), F.col("pos"))).alias("at"))
        .join(known.select("template"), "template", "left_anti")
    )
    start = known.agg(F.coalesce(F.max("template_id") + 1, F.lit(0).cast("long"))).scalar()
    ranked = global_rank(fresh, ["at"], "_rank")
    return ranked.select((F.col("_rank") + start).alias("template_id"), "template")


def ingest_parts(spark: SparkSession, source: str, target: str, files_per_trigger: int = 1_000) -> StreamingQuery:
    """Read all new part files and append what they hold.

    ``events`` gets the events of valid groups, ``dictionary`` the templates not seen before,
    ``sequences`` a line of template ids per group (in segments, see ``sequence_lines``) and ``quarantine``
    the files that are no document. Events without a template take no part in a sequence. The stream
    checkpoint remembers finished files, so a restart continues where it stopped. Each micro-batch
    writes its own folders, so a repeated batch replaces its earlier attempt; ids never change.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        quarantine(batch).write.mode("overwrite").parquet(f"{target}/quarantine/batch={batch_id}")
        events = flatten_groups(valid_groups(explode_groups(batch)))
        path = f"{target}/events/batch={batch_id}"
        events.write.mode("overwrite").parquet(path)
        known = _read_batches(s, f"{target}/dictionary", DICTIONARY, batch_id)
        events = s.read.parquet(path)
        added = f"{target}/dictionary/batch={batch_id}"
        extend_dictionary(known, events).write.mode("overwrite").parquet(added)
        ids = known.select("template_id", "template").unionByName(s.read.parquet(added).select("template_id", "template"))
        encoded = encode(events.filter(F.col("template").isNotNull()), ids)
        lines = sequence_lines(encoded, ["source_file", "place", "group_key"], "pos", "template_id", " ")
        lines.write.mode("overwrite").parquet(f"{target}/sequences/batch={batch_id}")

    return (
        stream_parts(spark, source, files_per_trigger)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{target}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def running_counts(events: DataFrame) -> DataFrame:
    """Occurrences per template so far; run in update or complete mode."""
    return events.filter(F.col("template") != "").groupBy("template").agg(
        F.count(F.lit(1)).alias("occurrences")
    )
