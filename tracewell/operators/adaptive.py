"""Adaptive bins: a bin closes on the line that brings its distinct templates to k.

The bin of a line depends on all earlier lines of its source. A long source is cut into chunks that
run in parallel from a guessed open bin; a chunk runs again only when the end of the chunk before it
differs from its guess. Bin starts merge quickly, so a few rounds settle all chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import cut_lineage, materialize

CHUNK = 500_000
OUT = "source string, line_no long, template string, bin long"


def _bins(templates, k: int, seen: set) -> tuple[list[int], set]:
    """Local bin number per line and the open bin's templates at the end."""
    out, current = [], 0
    for t in templates:
        out.append(current)
        seen.add(t)
        if len(seen) == k:
            current += 1
            seen = set()
    return out, seen


def bins_adaptive(
    lines: DataFrame, k: int = 5, chunk: int = CHUNK, unordered: DataFrame | None = None
) -> DataFrame:
    """Adds ``bin``, numbered from 0 per source. ``unordered`` holds the lines before numbering."""
    lines = lines.select("source", "line_no", "template")
    # At most rows / chunk sources are long.
    long = [
        (r["source"],)
        for r in (lines if unordered is None else unordered)
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > chunk)
        .collect()
    ]

    if not long:
        return _bins_whole(lines, k)
    names = F.broadcast(lines.sparkSession.createDataFrame(long, "source string"))
    short = _bins_whole(lines.join(names, "source", "left_anti"), k)
    return short.unionByName(_bins_chunked(lines.join(names, "source", "left_semi"), k, chunk))


def _bins_whole(lines: DataFrame, k: int) -> DataFrame:
    """Sources of bounded length: sorted partitions stream through, one open bin at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, current, seen = None, 0, set()
        for pdf in batches:
            out = []
            for s, t in zip(pdf["source"], pdf["template"]):
                if s != source:
                    source, current, seen = s, 0, set()
                out.append(current)
                seen.add(t)
                if len(seen) == k:
                    current, seen = current + 1, set()
            yield pdf.assign(bin=out)

    return lines.repartition("source").sortWithinPartitions("source", "line_no").mapInPandas(run, OUT)


def _bins_chunked(lines: DataFrame, k: int, chunk: int) -> DataFrame:
    stored = materialize(
        lines.withColumn("chunk", F.floor(F.col("line_no") / chunk).cast("long")), "chunked-lines"
    )
    keys = ["source", "chunk"]
    ends = "source string, chunk long, start array<string>, end array<string>, closed long"

    def state(key, data: pd.DataFrame, guess: pd.DataFrame) -> pd.DataFrame:
        if data.empty or guess.empty:
            return pd.DataFrame()
        start = list(guess["start"].iloc[0])
        number, seen = _bins(data.sort_values("line_no")["template"], k, set(start))
        closed = number[-1] + (not seen)
        return pd.DataFrame(
            [(*key, start, sorted(seen), closed)],
            columns=["source", "chunk", "start", "end", "closed"],
        )

    def run(guesses: DataFrame) -> DataFrame:
        data = stored.join(guesses.select(*keys), keys, "left_semi")
        return data.groupBy(*keys).cogroup(guesses.groupBy(*keys)).applyInPandas(state, ends)

    none = F.array().cast("array<string>")
    first = cut_lineage(stored.select(*keys).distinct().withColumn("start", none))
    known = cut_lineage(run(first))
    in_order = Window.partitionBy("source").orderBy("chunk")
    while True:
        wanted = known.withColumn("want", F.coalesce(F.lag("end").over(in_order), none))
        stale = cut_lineage(
            wanted.filter(F.col("want") != F.col("start")).select(*keys, F.col("want").alias("start"))
        )
        if stale.isEmpty():
            break
        known = cut_lineage(known.join(stale.select(*keys), keys, "left_anti").unionByName(run(stale)))
    before = F.coalesce(
        F.sum("closed").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    starts = known.withColumn("before", before.cast("long")).select(*keys, "start", "before")

    def number(key, data: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        data = data.sort_values("line_no")
        local, _ = _bins(data["template"], k, set(start["start"].iloc[0]))
        return pd.DataFrame(
            {
                "source": data["source"],
                "line_no": data["line_no"],
                "template": data["template"],
                "bin": [b + int(start["before"].iloc[0]) for b in local],
            }
        )

    return stored.groupBy(*keys).cogroup(starts.groupBy(*keys)).applyInPandas(number, OUT)
