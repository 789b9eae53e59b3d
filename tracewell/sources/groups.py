"""Keyed-group JSON: part-file scan, quarantine, validity filter, flattening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.text import piece_text
from tracewell.schema import KEYED_GROUPS

PART_NAME = r"^part_\d+\.json$"


def read_parts(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Whole part files as (source_file, value). Files are bounded by the 500 groups of a part.

    The name is that of the file, or of its folder ``source_file=<name>`` as ``write_group_parts`` leaves it.
    """
    df = spark.read.text(path, wholetext=True)
    name = F.col("source_file") if "source_file" in df.columns else F.col("_metadata.file_name")
    return part_names(df.select(name.alias("source_file"), "value"), strict)


def part_names(df: DataFrame, strict: bool = True) -> DataFrame:
    """Keep rows of part files by name."""
    name = F.col("source_file")
    if strict:
        return df.filter(name.rlike(PART_NAME))
    return df.filter(name.startswith("part_") & name.endswith(".json"))


def parse_documents(df: DataFrame) -> DataFrame:
    """Add ``doc``, null when the whole text is not one keyed-group document.

    The text is read as the only element of a list, so text behind a complete document counts too.
    """
    whole = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), T.ArrayType(KEYED_GROUPS))
    return df.withColumn("doc", F.when(F.size(whole) == 1, whole[0]))


def quarantine(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Malformed documents, one row each, instead of a failed job."""
    return parse_documents(df).filter(F.col("doc").isNull()).select(
        *keep, "source_file", F.lit("malformed JSON").alias("reason"), "value"
    )


def explode_groups(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per group: (source_file, place, group_key, metadata, group).

    ``place`` is the group's position in its file. A template that is a list of pieces becomes one
    string; one that is neither a string nor such a list becomes null.
    """
    whole = lambda e: F.struct(e["event_id"], e["dup_id"], e["raw"], piece_text(e["template"]).alias("template"))
    return (
        parse_documents(df)
        .select(*keep, "source_file", F.posexplode("doc").alias("place", "group_key", "_g"))
        .select(*keep, "source_file", "place", "group_key", "_g.metadata", F.transform("_g.group", whole).alias("group"))
    )


def valid_groups(groups: DataFrame) -> DataFrame:
    """Groups whose metadata and event list are both present."""
    return groups.filter(F.col("metadata").isNotNull() & F.col("group").isNotNull())


def flatten_groups(groups: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per event with its position; a missing list gives no rows."""
    return groups.select(
        *keep, "source_file", "place", "group_key", F.posexplode("group").alias("pos", "_e")
    ).select(*keep, "source_file", "place", "group_key", "pos", "_e.*")


def last_part(files: DataFrame) -> DataFrame:
    """Highest part number, -1 without any part: the resume point of a batch ingest."""
    number = F.regexp_extract("source_file", r"^part_(\d+)\.json$", 1).try_cast("long")
    return files.agg(F.coalesce(F.max(number), F.lit(-1).cast("long")).alias("last_part"))
