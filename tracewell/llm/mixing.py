"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's target divided by its size gives its copies: the whole part is certain, the rest is an
inclusion probability. Every document gets a uniform number from a hash of its content; its rank
number is the odds of that number divided by the odds of its inclusion probability (Rosen's Pareto
sampling). The documents with the smallest rank numbers are taken until their words come nearest to
what the whole copies left open, so the sample has a fixed size in words. The cut is found by
counting words below candidate rank numbers in a histogram that is refined bit by bit: no source is
ever sorted or gathered.

Words are runs of characters other than space and tab to carriage return. A null text has none. A
null source is a source and comes last. Rows equal in id and text are taken alike. Sources without
words have target 0. Empty tables stay empty. Result columns replace columns of the same name. The
sources' totals, one row per source, go through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import free_name, n_words, table, text_of
from tracewell.session import materialize, small_side

#: Bits of a rank key and bits by which a round refines the cut.
KEY_BITS, STEP = 50, 10


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """``share`` of all words split by weight; what passes ``most`` times a size is reshared."""
    total = share * sum(sizes)
    fixed: dict[int, float] = {}
    while True:
        rest = [i for i in range(len(sizes)) if i not in fixed]
        left, weight = total - sum(fixed.values()), sum(weights[i] for i in rest)
        shares = {i: left * weights[i] / weight for i in rest}
        over = {i: most * sizes[i] for i in rest if shares[i] > most * sizes[i]}
        if not over:
            return [fixed.get(i, shares.get(i, 0.0)) for i in range(len(sizes))]
        fixed |= over


def source_plan(
    docs: DataFrame, weights: tuple[float, ...], share: float, most: float, source: str
) -> DataFrame:
    """(source, source_size, target, whole, wanted, odds): one row per source of the sized ``docs``."""
    found = docs.groupBy(source).agg(F.sum("size").alias("size")).collect()
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [r.size for r in found]
    cycle = [weights[i % len(weights)] for i in range(len(found))]
    goal = targets(sizes, cycle, share, most) if found else []
    rows = []
    for r, target in zip(found, goal, strict=True):
        whole = min(int(most), int(target // r.size)) if r.size else 0
        wanted = max(0.0, target - whole * r.size)
        p = wanted / r.size if r.size else 0.0
        rows.append((r[0], r.size, float(target), whole, wanted, p / (1 - p) if 0 < p < 1 else None))
    kind = dict(docs.dtypes)[source]
    return docs.sparkSession.createDataFrame(
        rows, f"source {kind}, source_size long, target double, whole int, wanted double, odds double"
    )


def rank_key(uniform_of: list[Column], seed: int, odds: Column, weight: Column) -> Column:
    """Random odds over inclusion odds, as a whole number of ``KEY_BITS`` bits in the same order."""
    draw = F.xxhash64(F.lit(seed), *uniform_of).bitwiseAND(F.lit((1 << 52) - 1))
    u = (draw.cast("double") + 0.5) / float(1 << 52)
    rank = (u / (1 - u)) / (odds * weight)
    return F.floor(rank / (1 + rank) * float(1 << KEY_BITS)).cast("long")


def cuts(ranked: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, cut): rank keys under the cut have words nearest to what their source wants.

    Each round knows per source the words under an interval of keys that holds the cut, and counts
    the words of its ``2 ** STEP`` parts.
    """
    state = plan.select("source", "wanted", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("under"))
    for shift in range(KEY_BITS - STEP, -1, -STEP):
        width = 1 << STEP
        open_rows = ranked.join(small_side(state), F.col("rank_source").eqNullSafe(F.col("source"))).where(
            F.shiftright("key", shift + STEP) == F.shiftright("low", shift + STEP)
        )
        part = F.shiftright("key", shift).bitwiseAND(F.lit(width - 1))
        counted = open_rows.groupBy("source", "wanted", "low", "under", part.alias("part")).agg(
            F.sum("size").alias("words")
        )
        # at most 2 ** STEP rows per source: a bounded window
        upto = Window.partitionBy("source").orderBy("part")
        running = counted.withColumn("upto", F.col("under") + F.sum("words").over(upto))
        reached = F.when(F.col("upto") >= F.col("wanted"), F.struct("part", (F.col("upto") - F.col("words")).alias("u")))
        last = F.max(F.struct("part", (F.col("upto") - F.col("words")).alias("u")))
        at = running.groupBy("source", "wanted", "low").agg(F.coalesce(F.min(reached), last).alias("at"))
        state = at.select(
            "source",
            "wanted",
            (F.col("low") + F.col("at.part") * F.lit(1 << shift)).alias("low"),
            F.col("at.u").alias("under"),
        )
    # the key that crosses the wanted words stays out if that is nearer
    final = small_side(state)
    crossing = ranked.join(final, F.col("rank_source").eqNullSafe(F.col("source")) & (F.col("key") == F.col("low")))
    ends = crossing.groupBy("source", "wanted", "low", "under").agg(F.sum("size").alias("words"))
    nearer = F.col("under") + F.col("words") - F.col("wanted") <= F.col("wanted") - F.col("under")
    return ends.select("source", (F.col("low") + F.when(nearer, 1).otherwise(0)).alias("cut"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weight: Column | None = None,
) -> DataFrame:
    """``docs`` with size, source_size, target and copies.

    ``weights`` repeat over the sources in code-point order. ``weight`` scales the inclusion odds of
    single documents within their source; without it all documents of a source have the same.
    """
    names = ["size", "source_size", "target", "copies"]
    rows = docs.drop(*[c for c in docs.columns if c in names])
    size = n_words(text_of(text))
    own, packed, of = (free_name(docs, c) for c in ("own_weight", "source_plan", "mix_source"))
    identity = [F.col(key), F.xxhash64(text_of(text))]
    draw = F.xxhash64(F.lit(seed), *identity)
    narrow = materialize(
        rows.select(
            F.col(source).alias("rank_source"),
            size.alias("size"),
            draw.alias("draw"),
            (weight if weight is not None else F.lit(1.0)).alias("own"),
        ),
        "mix_sizes",
    )
    sized = narrow.withColumnRenamed("rank_source", "source")
    plan = source_plan(sized, weights, share, most, "source")
    plan = small_side(plan)
    drawn = narrow.join(plan, F.col("rank_source").eqNullSafe(F.col("source"))).where("wanted > 0 and size > 0")
    ranked = drawn.select(
        "rank_source", "size", rank_key([F.col("draw")], seed, F.col("odds"), F.col("own")).alias("key")
    )
    ranked = materialize(ranked, "mix_ranks")
    wanted = plan.where("wanted > 0")
    cut = plan.join(
        small_side(cuts(ranked, wanted)).select(F.col("source").alias(of), "cut"),
        F.col("source").eqNullSafe(F.col(of)),
        "left",
    ).drop(of)
    cut = small_side(cut.select(F.col("source").alias(of), F.struct("*").alias(packed)))
    whole = rows.withColumn("size", size).withColumn(own, weight if weight is not None else F.lit(1.0))
    placed = whole.join(cut, F.col(source).eqNullSafe(F.col(of)), "left")
    number = rank_key([draw], seed, F.col(f"{packed}.odds"), F.col(own))
    extra = (F.col("size") > 0) & (F.col(f"{packed}.wanted") > 0) & (number < F.col(f"{packed}.cut"))
    copies = (F.col(f"{packed}.whole") + F.when(extra, 1).otherwise(0)).cast("int")
    found = [F.col(f"{packed}.{c}").alias(c) for c in ("source_size", "target")]
    return placed.select("*", *found, copies.alias("copies")).drop(own, of, packed)


def repeat(mixed: DataFrame) -> DataFrame:
    """Each document as many times as the mix takes it."""
    copy = free_name(mixed, "copy")
    return mixed.where("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), "copies"))).drop(copy)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    taken = (F.col("copies") * F.col("size")).cast("long").alias("taken")
    return mix(docs).select("doc_id", "size", "source_size", "target", taken, "source", "copies")


QUERIES = {"op8_mixing": op8_mixing}
SQL: dict[str, str] = {}
