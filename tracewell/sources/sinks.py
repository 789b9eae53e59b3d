"""Writers. All write folders of part files in parallel; nothing is gathered into one file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.operators.cleaning import assign_parts
from tracewell.operators.matrix import coded_samples, listed_variables


def write_parts(groups: DataFrame, path: str, order: Sequence[str], size: int = 500) -> None:
    """Groups as JSON in folders ``part_id=<n>`` of ``size`` groups each.

    ``order`` names the columns that number the groups. Decimal values leave as double.
    """
    parts = assign_parts(decimals_to_double(groups), order, size).drop("group_pos")
    # The part number is spread over the tasks, and a part never spans two of them.
    parts.repartition("part_id").write.partitionBy("part_id").mode("overwrite").json(path)


def write_group_parts(groups: DataFrame, path: str, order: Sequence[str], size: int = 500) -> None:
    """(group_key, metadata, group) as keyed-group documents of ``size`` groups, which ``read_parts`` reads.

    A part is a folder ``source_file=part_<n>.json`` with one text file; a group is one line of it, so
    a part is written row by row and never held whole.
    """
    numbered = assign_parts(decimals_to_double(groups), order, size)
    last = numbered.count() - 1
    inside = F.col("group_pos") % size
    key = F.to_json(F.array("group_key"))
    body = F.to_json(F.struct("metadata", "group"))
    line = F.concat(
        F.when(inside == 0, "{").otherwise(","),
        F.substring(key, F.lit(2), F.length(key) - 2),
        F.lit(":"),
        body,
        F.when((inside == size - 1) | (F.col("group_pos") == last), "}").otherwise(""),
    )
    name = F.concat(F.lit("part_"), "part_id", F.lit(".json"))
    lines = numbered.select(name.alias("source_file"), "group_pos", line.alias("value")).repartition("source_file")
    ordered = lines.sortWithinPartitions("source_file", "group_pos").select("source_file", "value")
    ordered.write.partitionBy("source_file").mode("overwrite").text(path)


def write_report(report: DataFrame, path: str) -> None:
    """The lines (place, line) of a report as text, in order across the part files."""
    report.orderBy("place").select("line").write.mode("overwrite").text(path)


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Decimal columns, also nested ones, become double."""

    def plain(t: T.DataType) -> T.DataType:
        if isinstance(t, T.DecimalType):
            return T.DoubleType()
        if isinstance(t, T.ArrayType):
            return T.ArrayType(plain(t.elementType), t.containsNull)
        if isinstance(t, T.MapType):
            return T.MapType(plain(t.keyType), plain(t.valueType), t.valueContainsNull)
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(f.name, plain(f.dataType), f.nullable) for f in t])
        return t

    return df.select(*[F.col(f.name).cast(plain(f.dataType)).alias(f.name) for f in df.schema])


def write_lines(lined: DataFrame, path: str, order: Sequence[str], line: str = "line") -> None:
    """One text line per group, sorted by ``order`` across the part files.

    Segments (column ``seg``) of a group are joined first: a line of a text file is one row.
    """
    if "seg" in lined.columns:
        keys = [c for c in lined.columns if c not in ("seg", line)]
        parts = F.sort_array(F.collect_list(F.struct("seg", line)))
        whole = F.array_join(F.transform(parts, lambda p: p[line]), "").alias(line)
        lined = lined.groupBy(*keys).agg(whole)
    lined.orderBy(*[c for c in order if c != "seg"]).select(line).write.mode("overwrite").text(path)


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    """template <-> id pairs as JSON rows; either direction is a lookup on this table."""
    dictionary.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV with a header; arrays are joined by ', '."""
    flat = [
        F.array_join(F.col(f.name).cast("array<string>"), ", ").alias(f.name)
        if isinstance(f.dataType, T.ArrayType)
        else F.col(f.name)
        for f in df.schema
    ]
    writer = df.select(*flat).write.option("header", True).option("sep", sep).option("escape", '"')
    writer.mode("overwrite").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """CSV with a header, such as an edge table (source, target, relation)."""
    reader = spark.read.option("header", True).option("sep", sep).option("escape", '"')
    return reader.schema(schema).csv(path)


def read_binary_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A wide 0/1 CSV matrix as sparse samples with its columns as variables."""
    wide = spark.read.option("header", True).option("escape", '"').csv(path)
    numbered = wide.toDF(*[f"_{i}" for i in range(len(wide.columns))])
    return coded_samples(numbered, numbered.columns), listed_variables(spark, wide.columns)
