"""Quality rules: a decision list learned from labelled statistics, in DataFrame operations only.

Every text gets the same statistics. Sequential covering then learns, from all labelled documents,
rules of threshold conditions that reject: a rule grows by the condition with the best information
gain over the rows that no earlier rule covers, and is pruned from its end on rows held out of the
growing. A rule that is not precise enough on those gives way to the one grown from the next best
start, until every statistic has had its turn in both directions; a later try must also be better
than chance allows among so many. The list becomes one conditional expression of Spark, first match
first.

Candidate thresholds lie halfway between neighbouring quantiles of each statistic, over all labelled
rows and over those to reject. The quantiles grow dense towards both ends and include them, so that a
rare kind in the tail of a statistic has its thresholds. One grouped count per step gives the gains
of all candidates, so the driver sees a few thousand numbers a step and never a row.

A null text has no words. Rows with equal or null ids are judged one by one; a label counts once per
id, the worse one if they differ. Without labels the list is empty and only the base limits hold.
Result columns replace columns of the same name. Empty tables stay empty.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import SPACE, free_name, table, text_of
from tracewell.session import materialize

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (*BASE, "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks")
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: The outermost quantile step is halved so many times towards both ends.
TAIL = 8
#: Chance, over all tries for a rule, of taking one that is no better than any rows.
CHANCE = 0.01

#: Statistics that conditions test: name to expression over the counts.
RATIOS = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols_per_char": ("n_symbols", "word_chars"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "distinct_words": ("n_distinct", "n_words"),
    "upper_per_char": ("n_upper", "word_chars"),
    "digits_per_char": ("n_digits", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts and those that the ratios need."""
    rows = docs.drop(*[c for c in docs.columns if c in COUNTS])
    w, grams, twice, lines = (free_name(docs, f"stat_{c}") for c in ("words", "grams", "twice", "lines"))
    body = text_of(text)
    inner = F.btrim(body, F.lit(" \t\n\x0b\f\r"))
    none = F.array().cast("array<string>")
    found = rows.withColumn(w, F.when(inner == "", none).otherwise(F.split(inner, SPACE, -1))).withColumn(
        lines, F.filter(F.split(body, "\n", -1), lambda line: F.btrim(line, F.lit(" \t\n\x0b\f\r")) != "")
    )
    n = F.size(w)
    window = lambda i: F.xxhash64(F.col(w)[i], F.col(w)[i + 1], F.col(w)[i + 2])
    empty = F.array().cast("array<bigint>")
    found = found.withColumn(
        grams, F.when(n < 3, empty).otherwise(F.transform(F.sequence(F.lit(0), n - 3), window))
    )
    # only a text with a repeated window pays for the sort
    marked = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    repeats = F.size(F.array_distinct(grams)) < F.size(grams)
    found = found.withColumn(twice, F.when(repeats, marked))
    equal = lambda x, j: F.coalesce(F.try_element_at(F.col(twice), j)["g"] == x["g"], F.lit(False))
    # positions of element j are 1-based: its neighbours are j (before) and j + 2 (after)
    in_run = lambda x, j: F.when(j > 0, equal(x, j)).otherwise(False) | equal(x, j + 2)
    starts = F.sort_array(F.transform(F.filter(F.col(twice), in_run), lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    solid = F.regexp_replace(body, SPACE, "")
    counts = {
        "n_words": n,
        "word_chars": F.length(solid),
        "n_symbols": _count(body, "#*$%&|<>"),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.when(F.col(twice).isNull(), 0).otherwise(covered),
        "n_lines": F.size(lines),
        "n_distinct": F.size(F.array_distinct(w)),
        "n_upper": _count(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_digits": _count(body, "0123456789"),
        "n_marks": _count(body, "!?;:=_~^+/"),
    }
    # a generator keeps filters on the counts above it: pushed down, they would compute them again
    counted = F.stack(F.lit(1), *[c.cast("long") for c in counts.values()]).alias(*counts)
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], counted)


def base_failed() -> Column:
    """The fixed limits: too few words, or more than half of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def ratio(name: str) -> Column:
    top, bottom = RATIOS[name]
    value = F.col(top).cast("double")
    return F.coalesce(F.try_divide(value, F.col(bottom)), F.lit(0.0)) if bottom else value


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    cut: float

    def column(self) -> Column:
        return ratio(self.name) > self.cut if self.above else ratio(self.name) <= self.cut

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """Information gain of a condition that keeps ``p`` of ``p0`` rows to reject and ``n`` of ``n0`` others."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _by_chance(p: int, n: int, share: float) -> float:
    """The probability that of ``p + n`` rows at least ``p`` are to reject, if ``share`` of all are."""
    if not 0 < share < 1:
        return float(share >= 1)
    odds = math.log(share), math.log1p(-share)
    ways = lambda k: math.lgamma(p + n + 1) - math.lgamma(k + 1) - math.lgamma(p + n - k + 1)
    return sum(math.exp(ways(k) + k * odds[0] + (p + n - k) * odds[1]) for k in range(p, p + n + 1))


class Learner:
    """Sequential covering over ``labelled``: the ratios, ``reject`` and ``held`` per row."""

    def __init__(self, labelled: DataFrame, quantiles: int, most_rules: int, most_conditions: int, precision: float):
        self.most_rules, self.most_conditions = most_rules, most_conditions
        self.precision = precision
        tail = [1 / (quantiles * 2**i) for i in range(1, TAIL + 1)]
        steps = sorted({i / quantiles for i in range(quantiles + 1)} | set(tail) | {1 - t for t in tail})
        sides = {"all": F.lit(True), "bad": F.col("reject")}
        wanted = [
            F.percentile_approx(F.when(rows, ratio(r)), steps, 10_000).alias(f"{side}_{r}")
            for side, rows in sides.items()
            for r in RATIOS
        ]
        found = labelled.agg(*wanted).first()
        values = {r: sorted({v for side in sides for v in found[f"{side}_{r}"] or []}) for r in RATIOS}
        # halfway between neighbouring quantiles, so that a condition keeps a margin to both sides
        self.cuts = {r: cuts for r in RATIOS if (cuts := [(a + b) / 2 for a, b in pairwise(values[r])])}
        self.rows = materialize(labelled.select("*", *map(self._bin, self.cuts)), "binned_statistics")

    def _bin(self, name: str) -> Column:
        """The number of cuts that the ratio passes."""
        value = ratio(name)
        passed = F.filter(F.array(*map(F.lit, self.cuts[name])), lambda cut: cut < value)
        return F.size(passed).cast("int").alias(f"bin_{name}")

    def _tally(self, open_rows: DataFrame) -> dict[str, list[tuple[int, int, int]]]:
        """Per ratio: (bin, rows to reject, others); bin b holds the values above b of its cuts."""
        bins = [F.struct(F.lit(name).alias("name"), F.col(f"bin_{name}").alias("bin")) for name in self.cuts]
        counted = open_rows.select(F.explode(F.array(*bins)).alias("b"), "reject").groupBy("b")
        out: dict[str, list[tuple[int, int, int]]] = {}
        for r in counted.agg(F.count_if("reject").alias("p"), F.count("*").alias("all")).collect():
            out.setdefault(r.b.name, []).append((r.b.bin, r.p, r.all - r.p))
        return out

    def _candidates(self, open_rows: DataFrame) -> list[tuple[float, Condition, int, int]]:
        """Gain, condition and the rows that it keeps, to reject and others, of all conditions with a gain."""
        out = []
        for name, bins in self._tally(open_rows).items():
            p0, n0 = sum(b[1] for b in bins), sum(b[2] for b in bins)
            if not p0 or not n0:
                continue
            for k, cut in enumerate(self.cuts[name]):
                p, n = (sum(b[i] for b in bins if b[0] <= k) for i in (1, 2))
                for above, (x, y) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                    if (gain := _gain(x, y, p0, n0)) > 1e-9:
                        out.append((gain, Condition(name, above, cut), x, y))
        return out

    def _starts(self, open_rows: DataFrame) -> list[tuple[Condition, int]]:
        """Per statistic and direction the cut of most gain, and the precise one of most gain; best first."""
        best: dict[tuple, tuple[float, Condition, int]] = {}
        for gain, condition, p, n in self._candidates(open_rows):
            for precise in {False, p >= self.precision * (p + n)}:
                at = (condition.name, condition.above, precise)
                if at not in best or gain > best[at][0]:
                    best[at] = gain, condition, n
        ordered = sorted(best.values(), key=lambda b: -b[0])
        return list({condition: n for _, condition, n in ordered}.items())

    def _grow(self, open_rows: DataFrame, start: Condition, others: int) -> list[Condition]:
        grown, n = [start], others
        rows = open_rows.where(start.column())
        while n and len(grown) < self.most_conditions:
            _, condition, _, n = max(self._candidates(rows), key=lambda c: c[0], default=(0, None, 0, 0))
            if condition is None:
                break
            grown.append(condition)
            rows = rows.where(condition.column())
        return grown

    def _prune(self, left: DataFrame, grown: list[Condition]) -> tuple[list[Condition], int, int]:
        """The shortest start of the rule that is worth most on held rows, and what it covers there."""
        tests = [Rule(tuple(grown[:k])).column() for k in range(1, len(grown) + 1)]
        counts = left.where("held").agg(
            *[F.count_if(t & F.col("reject")).alias(f"p{k}") for k, t in enumerate(tests)],
            *[F.count_if(t & ~F.col("reject")).alias(f"n{k}") for k, t in enumerate(tests)],
        ).first()
        worth = [
            ((p - n) / (p + n) if p + n else -1.0, -k, p, n)
            for k in range(len(tests))
            for p, n in [(counts[f"p{k}"], counts[f"n{k}"])]
        ]
        _, k, p, n = max(worth)
        return grown[: 1 - k], p, n

    def _next(self, left: DataFrame) -> Rule | None:
        """The first rule, from the best start on, that is precise on held rows."""
        starts = self._starts(left.where("not held"))
        held = left.where("held").agg(F.count_if("reject").alias("p"), F.count("*").alias("all")).first() if starts else None
        for tries, (start, others) in enumerate(starts):
            kept, p, n = self._prune(left, self._grow(left.where("not held"), start, others))
            if not p or p < self.precision * (p + n):
                continue
            # among many tries some rule is precise on a few rows by chance
            if not tries or _by_chance(p, n, held.p / held.all) < CHANCE / len(starts):
                return Rule(tuple(kept))
        return None

    def rules(self) -> list[Rule]:
        out, left = [], self.rows
        while self.cuts and len(out) < self.most_rules and (rule := self._next(left)):
            out.append(rule)
            left = left.where(~rule.column())
        return out


def count(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, counts) of all documents, written once: whatever follows never moves a text."""
    narrow = docs.select(F.col(key).alias("doc_key"), F.col(text).alias("text"))
    return materialize(statistics(narrow).drop("text"), "statistics").withColumnRenamed("doc_key", key)


def learn(
    counted: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    good: Column | None = None,
    quantiles: int = 40,
    most_rules: int = 8,
    most_conditions: int = 4,
    precision: float = 0.95,
) -> list[Rule]:
    """The decision list from all labelled rows of ``count``; a third, by hash, is held for pruning.

    Rows that fail the base limits are no examples: those limits decide them already.
    """
    good = F.col("quality") == 1 if good is None else good
    worst = labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(good).alias("good"))
    labelled = counted.join(worst.where("good is not null"), key).where(~base_failed())
    inputs = sorted({c for pair in RATIOS.values() for c in pair if c})
    narrow = labelled.select(
        *inputs, (~F.col("good")).alias("reject"), (F.pmod(F.xxhash64(F.lit(7), key), F.lit(3)) == 0).alias("held")
    )
    return Learner(materialize(narrow, "labelled_statistics"), quantiles, most_rules, most_conditions, precision).rules()


def verdict(rules: list[Rule]) -> Column:
    """The first rule that rejects a row, else null."""
    out = F.when(base_failed(), F.lit("base limits"))
    for rule in rules:
        out = out.when(rule.column(), F.lit(str(rule)))
    return out


def judge(docs: DataFrame, rules: list[Rule], text: str = "text", reason: str = "rejected_by") -> DataFrame:
    """``docs`` with their statistics and the rule that rejects them."""
    return statistics(docs, text).withColumn(reason, verdict(rules))


def keep(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns only."""
    packed = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    return judge(packed, rules).where("rejected_by IS NULL").select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count(docs)
    rules = learn(counted, table(spark, sf_dir, "labels"))
    return counted.withColumn("rejected_by", verdict(rules)).select(
        "doc_id", *BASE, base_failed().alias("base_failed"), F.col("rejected_by").isNull().alias("kept"), "rejected_by"
    )


QUERIES = {"op10_quality_rules": op10_quality_rules}
SQL: dict[str, str] = {}
