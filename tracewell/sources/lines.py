"""Text-line sources: plain lines, key/value lines, JSON lines and formatted raw logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.text import strip
from tracewell.operators.order import running_before


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Stripped non-blank lines of text files as (source, line_no, template), numbered per file.

    A text scan does not number its lines; ``monotonically_increasing_id`` rises with the file
    offset inside one file because splits are planned in offset order.
    """
    raw = (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("source"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("mid"),
            strip("value").alias("template"),
        )
        .filter(F.col("template") != "")
    )
    return running_before(
        raw, "line_no", ["block", "mid"], [F.col("block")], ["source"]
    ).select("source", "line_no", "template")


def kv_value(line: str | Column) -> Column:
    """Text after the first 'value:', stripped, without one outer bracket pair; null without it."""
    s = strip(line)
    at = F.instr(s, "value:")
    rest = strip(F.substring(s, at + F.lit(6), F.length(s)))
    bracketed = rest.startswith("[") & rest.endswith("]")
    inner = strip(F.substring(rest, F.lit(2), F.greatest(F.length(rest) - 2, F.lit(0))))
    return F.when(at > 0, F.when(bracketed, inner).otherwise(rest))


def none_text(c: Column) -> Column:
    """Null rendered as the word None."""
    return F.coalesce(c, F.lit("None"))


def kv_values(lines: DataFrame, line: str = "line", head: int | None = None) -> DataFrame:
    """Value of every key/value line, or of the first ``head`` lines."""
    if head is not None:
        lines = lines.filter(F.col("line_no") < head)
    return lines.withColumn("value", none_text(kv_value(line)))


def valid_json_head(lines: DataFrame, n: int = 100) -> DataFrame:
    """The first ``n`` lines that are one JSON value as a whole; others are skipped."""
    alone = F.try_parse_json(F.concat(F.lit("["), "line", F.lit("]")))
    ok = F.size(F.try_variant_get(alone, "$", "array<variant>")) == 1
    return lines.filter(ok).orderBy("line_no").limit(n)


def head_line(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("line_no") == 0)


def format_regex(log_format: str) -> tuple[list[str], str]:
    """Header names and anchored pattern of a '<Header>' format string."""
    headers, pattern = [], ""
    for literal, header in re.findall(r"([^<]*)(?:<([^<>]+)>)?", log_format):
        pattern += re.sub(r" +", r"\\s+", literal)
        if header:
            headers.append(header)
            pattern += "(.*?)"
    return headers, f"^{pattern}$"


def parse_log_format(
    lines: DataFrame, log_format: str, line: str = "line", order: str = "line_no",
    group: tuple[str, ...] = ("source",), bucket_width: int = 1_000_000,
) -> DataFrame:
    """One column per header; other lines are dropped and LineId counts the rest from 1."""
    headers, pattern = format_regex(log_format)
    text = strip(line)
    kept = lines.filter(text.rlike(pattern)).select(
        *group,
        order,
        *[F.regexp_extract(text, pattern, i + 1).alias(h) for i, h in enumerate(headers)],
    )
    numbered = running_before(
        kept, "_before", [order], [F.floor(F.col(order) / bucket_width)], group
    )
    line_id = (F.col("_before") + 1).alias("LineId")
    return numbered.select(*group, line_id, *headers)
