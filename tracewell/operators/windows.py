"""Positional windows, bins and lags over (source, line_no, template) series.

Sliding operators work on fixed-length chunks with copied border rows, so a source that holds most
of the data is spread over many tasks and every row is shuffled once.

``unordered`` names the same lines before they were numbered: counting those spares a second pass
through the numbering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.order import KEY_WIDTH, key_range, running_before, with_halo
from tracewell.session import materialize, small_side

CHUNK = 50_000
# Places of a wide matrix, rows times columns, that one task builds.
WIDE_CELLS = 1 << 22


def frequent_templates(lines: DataFrame, min_freq: int = 5) -> DataFrame:
    """(source, template) pairs with at least ``min_freq`` lines."""
    return (
        lines.groupBy("source", "template")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .filter(F.col("cnt") >= min_freq)
    )


def frequent_lines(lines: DataFrame, min_freq: int = 5, unordered: DataFrame | None = None) -> DataFrame:
    """Lines of frequent templates only, renumbered densely per source."""
    frequent = small_side(frequent_templates(lines if unordered is None else unordered, min_freq))
    kept = lines.join(frequent, ["source", "template"], "left_semi")
    numbered = running_before(
        kept, "_new", ["line_no"], [key_range("line_no", KEY_WIDTH)], ["source"]
    )
    return numbered.select("source", F.col("_new").alias("line_no"), "template")


def frequent_slots(lines: DataFrame, min_freq: int = 5, unordered: DataFrame | None = None) -> DataFrame:
    """All lines at their old position; infrequent templates become null."""
    counted = frequent_templates(lines if unordered is None else unordered, min_freq)
    frequent = counted.select("source", "template", F.lit(True).alias("_keep"))
    return lines.join(small_side(frequent), ["source", "template"], "left").select(
        "source", "line_no", F.when(F.col("_keep"), F.col("template")).alias("template")
    )


def window_size(n: Column, f: Column, per_feature: int = 5, max_window: int = 30) -> Column:
    """Largest window in max_window..2 that leaves ``per_feature`` windows per template, else 2."""
    best = F.greatest(F.lit(2), F.least(F.lit(max_window), n - per_feature * f + 1))
    return F.when(f > 0, best.cast("long"))


def choose_window(lines: DataFrame) -> DataFrame:
    """Window size per source of already filtered lines."""
    per_template = lines.groupBy("source", "template").agg(F.count(F.lit(1)).alias("cnt"))
    sizes = per_template.groupBy("source").agg(
        F.sum("cnt").alias("n_lines"), F.count(F.lit(1)).alias("n_features")
    )
    return sizes.withColumn("window_size", window_size(F.col("n_lines"), F.col("n_features")))


def require_features(lines: DataFrame) -> DataFrame:
    """Stop with an error when no template survived the frequency filter."""
    if lines.isEmpty():
        raise ValueError("no template is frequent enough")
    return lines


def matrix_quality(sizes: DataFrame) -> DataFrame:
    """Windows per feature and a confidence label, from ``choose_window`` rows."""
    samples = F.greatest(F.col("n_lines") - F.col("window_size") + 1, F.lit(0).cast("long"))
    ratio = F.when(F.col("n_features") > 0, samples / F.col("n_features")).otherwise(F.lit(0.0))
    label = F.when(ratio >= 10, "high").when(ratio >= 5, "moderate").otherwise("low")
    return sizes.select(
        "source",
        "window_size",
        samples.alias("n_samples"),
        "n_features",
        F.round(ratio, 6).alias("ratio"),
        label.alias("confidence"),
    )


def _with_length(lines: DataFrame, unordered: DataFrame | None = None) -> DataFrame:
    """Line numbers are dense, so the length is a plain count that needs no numbering."""
    sizes = (lines if unordered is None else unordered).groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    return lines.join(small_side(sizes), "source")


def window_members(
    lines: DataFrame, w: int, chunk: int = CHUNK, unordered: DataFrame | None = None
) -> DataFrame:
    """Distinct (source, win, template) over all full windows of ``w`` lines.

    An occurrence adds only the windows that the previous occurrence of the same template does not
    reach already, so the rows come out distinct without a shuffle of the exploded windows.
    """
    cut = with_halo(_with_length(lines, unordered), "line_no", chunk, before=w - 1)
    near = Window.partitionBy("source", "_chunk", "template").orderBy("line_no")
    previous = F.lag("line_no").over(near)
    first = F.greatest(
        F.lit(0).cast("long"),
        F.col("line_no") - (w - 1),
        F.coalesce(F.col("_prev") + 1, F.lit(0).cast("long")),
    )
    last = F.least(F.col("line_no"), F.col("_n") - w)
    return (
        cut.withColumn("_prev", previous)
        .filter("_own")
        .withColumn("_first", first)
        .withColumn("_last", last)
        .filter(F.col("_first") <= F.col("_last"))
        .select("source", F.explode(F.sequence("_first", "_last")).alias("win"), "template")
    )


def window_sets(lines: DataFrame, w: int, chunk: int = CHUNK) -> DataFrame:
    """(source, win, items): the sorted template set of each full window, one row per window."""
    cut = with_halo(lines, "line_no", chunk, after=w - 1)
    near = Window.partitionBy("source", "_chunk").orderBy("line_no").rowsBetween(0, w - 1)
    return (
        cut.withColumn("_len", F.count(F.lit(1)).over(near))
        .withColumn("items", F.array_sort(F.collect_set("template").over(near)))
        .filter(F.col("_own") & (F.col("_len") == w))
        .select("source", F.col("line_no").alias("win"), "items")
    )


def bins_open(lines: DataFrame, size: int = 60) -> DataFrame:
    """Fixed bins, numbered from 1; the last one may be short."""
    return lines.withColumn("bin", F.floor(F.col("line_no") / size).cast("long") + 1)


def bins_clamped(lines: DataFrame, size: int = 60, unordered: DataFrame | None = None) -> DataFrame:
    """Fixed bins whose short tail joins the last full bin; a short source has one bin."""
    full = F.greatest(F.lit(1).cast("long"), F.floor(F.col("_n") / size).cast("long"))
    number = F.floor(F.col("line_no") / size).cast("long") + 1
    return _with_length(lines, unordered).withColumn("bin", F.least(number, full)).drop("_n")


def bin_counts(binned: DataFrame) -> DataFrame:
    return binned.groupBy("source", "template", "bin").agg(F.count(F.lit(1)).alias("cnt"))


def bin_matrix(binned: DataFrame) -> DataFrame:
    """Template x bin counts per source with zeros, in long form.

    The bins are counted first; each template then spreads over its source's bin range.
    """
    counts = bin_counts(binned)
    templates = counts.groupBy("source", "template").agg(F.max("bin").alias("_m"))
    last = templates.groupBy("source").agg(F.max("_m").alias("_last"))
    cells = templates.join(last, "source").select(
        "source", "template", F.explode(F.sequence(F.lit(1).cast("long"), "_last")).alias("bin")
    )
    return cells.join(counts, ["source", "template", "bin"], "left").select(
        "source", "template", "bin", F.coalesce("cnt", F.lit(0).cast("long")).alias("cnt")
    )


def wide_matrix(cells: DataFrame, rows: str, columns: str, value: str) -> DataFrame:
    """Wide form for export; the column side must be small.

    A row under construction has a place for every column, so the cells are counted and dealt to as many
    parts as keep the places of one part under ``WIDE_CELLS``.
    """
    fixed = materialize(cells.select(rows, columns, value), "matrix-cells")
    places = fixed.count() * fixed.select(columns).distinct().count()
    dealt = fixed.repartition(places // WIDE_CELLS + 1, rows)
    return dealt.groupBy(rows).pivot(columns).agg(F.first(value)).na.fill(0)


def lag_pairs(lines: DataFrame, maxlag: int = 3, chunk: int = CHUNK) -> DataFrame:
    """(source, line_no, template, lag, earlier): each line with the lines 1..maxlag before it."""
    cut = with_halo(lines, "line_no", chunk, after=0, before=maxlag)
    near = Window.partitionBy("source", "_chunk").orderBy("line_no")
    pairs = [
        F.struct(
            F.lit(k).alias("lag"),
            F.lag("template", k).over(near).alias("earlier"),
            F.lag("line_no", k).over(near).alias("at"),
        )
        for k in range(1, maxlag + 1)
    ]
    return (
        cut.withColumn("_pairs", F.array(*pairs))
        .filter("_own")
        .select("source", "line_no", "template", F.inline("_pairs"))
        .filter(F.col("at").isNotNull())
        .drop("at")
    )


def following(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(cur, next): adjacent templates of each source."""
    return lag_pairs(lines, 1, chunk).select(
        F.col("earlier").alias("cur"), F.col("template").alias("next")
    )


def lag_cooccurrence(lines: DataFrame, maxlag: int = 3, chunk: int = CHUNK) -> DataFrame:
    """How often ``src`` precedes ``dst`` by each lag."""
    return (
        lag_pairs(lines, maxlag, chunk)
        .groupBy(F.col("earlier").alias("src"), F.col("template").alias("dst"), "lag")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
