"""Personal data: fixed patterns, and terms that reveal what the patterns protect.

The patterns find emails, IP addresses, cards and phones. Each value found is a protected entity.
The corpus then tells which terms give an entity away. A term stands *near* an entity if at most
``window`` words lie between, across lines too. Of all lines that hold the term, those where it stands
near the entity estimate P(entity | term). As few lines prove little, the estimate is taken at the
lower end of its confidence interval, where different lines count for the entity, so copies of a line prove
nothing, and every line away from it counts against. A term discloses if that bound reaches
``bound`` and lies ``bits`` of information above the share of documents with the entity. Neither
moves with the size of the corpus. Disclosing terms are marked in every document, with or without
the entity, and the sanitised text replaces every span by its kind.

Everything is DataFrame operations. Texts are neither copied nor shuffled: what leaves a document are
terms near entities, counts of terms that stand near one, and the few documents with a passing term.
A null text is empty and has no spans. Rows are handled one by one, so null or repeated ids do no
harm. Empty tables stay empty; result columns replace columns of the same name. Spans count code
points, the end is exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import free_name, table, text_of
from tracewell.session import materialize, small_side

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns. No match starts inside a run of its first characters, so the look-behind
#: only saves scans; ``\G`` keeps a start right behind the previous match. What follows a repetition
#: never begins with one of its characters, so the repetitions need no way back.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
#: Words between a term and an entity, and the confidence of the bound in standard deviations.
WINDOW, DEVIATIONS = 24, 1.645
BOUND, BITS = 0.4, 4.0
#: Terms are runs of letters and digits of at least this length, in lower case.
TERM = r"[\p{L}\p{N}]{2,}+"
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _sums(steps: Column) -> Column:
    return F.aggregate(
        steps,
        F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("out")),
        lambda a, x: F.struct(
            (a["s"] + x).alias("s"), F.concat(a["out"], F.array((a["s"] + x).cast("int"))).alias("out")
        ),
        lambda a: a["out"],
    )


def prefix_sums(steps: Column) -> Column:
    """Running totals of a non-empty array, in blocks: an array grows by copying."""
    count = F.ceil(F.size(steps) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: _sums(F.slice(steps, b * BLOCK + 1, BLOCK)))
    shifted = lambda sums, ends: F.flatten(
        F.transform(sums, lambda s, b: F.transform(s, lambda x: x + F.when(b > 0, ends[b - 1]).otherwise(0)))
    )
    # ends[b - 1] is read only for b > 0; index 0 stands in before
    safe = lambda sums, ends: shifted(sums, F.concat(ends, F.array(F.lit(0))))
    return let(blocks, lambda sums: let(_sums(F.transform(sums, lambda s: F.element_at(s, -1))), lambda e: safe(sums, e)))


def spans_of(text: Column, pattern: Column, found: Column) -> Column:
    """Array of (start, end, value) of the matches ``found``; the pieces between them give the places."""
    steps = lambda pieces: F.transform(found, lambda f, i: (F.length(pieces[i]) + F.length(f)).cast("int"))
    ends = lambda pieces: let(steps(pieces), prefix_sums)
    span = lambda f, end: F.struct((end - F.length(f)).cast("int").alias("start"), end.alias("end"), f.alias("value"))
    made = let(F.split(text, pattern, -1), lambda pieces: F.zip_with(found, ends(pieces), span))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(F.size(found) > 0, made).otherwise(none)


def _luhn(digits: Column) -> Column:
    digit = lambda i: F.substring(digits, -i, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.regexp_like(value, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15)


def _valid_span(kind: str, span: Column) -> Column:
    return valid(kind, span["value"])


def find_base(docs: DataFrame, text: str = "text", result: str = "base") -> DataFrame:
    """``docs`` with a struct of span arrays, one per kind."""
    raw = {k: free_name(docs, f"found_{k}") for k in KINDS}
    whole = text_of(text)
    found = docs.drop(result).select(
        "*", *[F.regexp_extract_all(whole, F.lit(PATTERNS[k]), F.lit(0)).alias(raw[k]) for k in KINDS]
    )
    spans = [
        F.filter(spans_of(whole, F.lit(PATTERNS[k]), F.col(raw[k])), partial(_valid_span, k)).alias(k) for k in KINDS
    ]
    return found.withColumn(result, F.struct(*spans)).drop(*raw.values())


def has_base(base: str = "base") -> Column:
    return F.greatest(*[F.size(f"{base}.{k}") for k in KINDS]) > 0


def _entity(kind: str, span: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), span["value"])


def entities_of(base: str) -> Column:
    """The different values of all spans, with their kinds."""
    return F.array_distinct(F.flatten(F.array(*[F.transform(f"{base}.{k}", partial(_entity, k)) for k in KINDS])))


def _terms(line: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit(TERM), F.lit(0)))


def _kind_of(word: Column) -> Column:
    """The kind of a word that is a whole valid base match, else null."""
    shape = {"email": word.contains("@"), "phone": word.startswith("+"), "ip": word.contains("."), "card": F.lit(True)}
    kind = F.when(F.lit(False), F.lit(""))
    for k, looks in shape.items():
        kind = kind.when(looks, F.when(valid(k, word), F.lit(k)))
    return F.when(F.regexp_like(word, F.lit("[@+0-9]")), kind)


#: Base matches, line ends and terms in the order of the text.
_WORDS = "|".join([PATTERNS["email"], PATTERNS["phone"], PATTERNS["ip"], PATTERNS["card"], r"\n", TERM])
_SEP = "\x01"


def _near_terms(text: Column, window: int) -> Column:
    """Array of "entity, line number, line hash, term" for all terms near an entity, each line once."""
    found = F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0))
    line = lambda tokens: let(F.transform(tokens, lambda t: (t == "\n").cast("int")), prefix_sums)
    token = lambda t, n: F.struct(t.alias("t"), n.alias("line"), _kind_of(t).alias("kind"))
    words = lambda tokens: F.filter(F.zip_with(tokens, line(tokens), token), lambda w: w["t"] != "\n")
    place = lambda w, i: F.struct(F.concat_ws(":", w["kind"], w["t"]).alias("entity"), i.alias("at"), w["kind"].alias("kind"))
    marks = lambda some: F.filter(F.transform(some, place), lambda m: m["kind"].isNotNull())
    first = lambda m: F.greatest(m["at"] - window - 1, F.lit(0))
    around = lambda some, m: F.slice(some, first(m) + 1, m["at"] - first(m) + window + 2)

    def entries(some: Column, hashes: Column) -> Column:
        entry = lambda m, w: F.concat_ws(_SEP, m["entity"], w["line"], hashes[w["line"]], F.lower(w["t"]))
        plain = lambda m: F.filter(around(some, m), lambda w: w["kind"].isNull() & F.regexp_like(w["t"], F.lit(f"^{TERM}$")))
        return F.array_distinct(F.flatten(F.transform(marks(some), lambda m: F.transform(plain(m), lambda w: entry(m, w)))))

    hashes = F.transform(F.split(text, "\n", -1), lambda x: F.xxhash64(x))
    made = let(found, lambda tokens: let(words(tokens), lambda some: let(hashes, lambda h: entries(some, h))))
    return F.when(F.size(found) > 0, made).otherwise(F.array().cast("array<string>"))


def lower_bound(hits: Column, misses: Column, deviations: float = DEVIATIONS) -> Column:
    """Lower end of the score interval of the share hits / (hits + misses)."""
    n, z2 = hits + misses, deviations * deviations
    middle = hits / n + z2 / (2 * n)
    spread = deviations * F.sqrt(hits / n * (misses / n) / n + z2 / (4 * n * n))
    return (middle - spread) / (1 + z2 / n)


def disclosing_terms(
    docs: DataFrame, text: str = "text", window: int = WINDOW, bound: float = BOUND, bits: float = BITS
) -> DataFrame:
    """(entity, term): terms of the corpus that reveal an entity of its documents."""
    whole = docs.select(text_of(text).alias("text"))
    hits = find_base(whole, "text").where(has_base())
    hits = hits.select(entities_of("base").alias("entities"), _near_terms(F.col("text"), window).alias("near"))
    hits = materialize(hits, "entity_terms")
    part = {name: F.col("entry")[i].alias(name) for i, name in enumerate(("entity", "place", "line", "term"))}
    # copies of a line meet here, so a hot line is one row from now on
    entries = hits.select(F.explode("near").alias("near")).select(F.split("near", _SEP, -1).alias("entry"))
    lines = entries.groupBy(part["entity"], part["term"], part["line"]).agg(F.count("*").alias("copies"))
    pairs = lines.groupBy("entity", "term").agg(F.count("*").alias("different"), F.sum("copies").alias("both"))
    pairs = pairs.where(lower_bound(F.col("different"), F.lit(0)) >= bound)
    entities = hits.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("entity_docs"))
    n_docs = docs.count()
    share = F.col("entity_docs") / F.lit(max(1, n_docs))
    pairs = materialize(pairs.join(entities, "entity").where(F.lit(bound) / share >= 2.0**bits), "entity_pairs")
    asked = small_side(pairs.select("term").distinct())
    corpus = whole.select(F.explode(F.split("text", "\n", -1)).alias("line"))
    counted = corpus.select(F.explode(_terms(F.col("line"))).alias("term")).join(asked, "term", "left_semi")
    counted = counted.groupBy("term").agg(F.count("*").alias("term_lines"))
    away = F.greatest(F.col("term_lines") - F.col("both"), F.lit(0))
    known = pairs.join(counted, "term").withColumn("chance", lower_bound(F.col("different"), away))
    return known.where((F.col("chance") >= bound) & (F.log2(F.col("chance") / share) >= bits)).select("entity", "term")


def mark(
    docs: DataFrame, text: str = "text", window: int = WINDOW, bound: float = BOUND, bits: float = BITS
) -> DataFrame:
    """``docs`` with ``base`` and ``terms``: the spans of the patterns and of disclosing terms."""
    rows = docs.drop("base", "terms")
    based = find_base(rows, text)
    key, found, names = (free_name(based, c) for c in ("text_key", "found_terms", "disclosing"))
    passing = small_side(disclosing_terms(rows, text, window, bound, bits).select("term").distinct())
    whole = text_of(text)
    if passing.isEmpty():
        return based.withColumn("terms", F.array().cast("array<struct<start:int,end:int,value:string>>"))
    # which terms a document holds depends on its text alone; the list is bounded by its distinct terms
    text_key = F.unhex(F.md5(whole)).alias(key)
    per_text = (
        rows.select(text_key, F.explode(_terms(whole)).alias("term"))
        .join(passing, "term")
        .groupBy(key)
        .agg(F.array_sort(F.collect_set("term")).alias(names))
    )
    marked = based.select("*", text_key).join(small_side(per_text), key, "left")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(names, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    matches = F.when(F.col(names).isNotNull(), F.regexp_extract_all(whole, pattern, F.lit(0)))
    marked = marked.withColumn(found, F.coalesce(matches, F.array().cast("array<string>")))
    base = F.flatten(F.array(*[F.col(f"base.{k}") for k in KINDS]))
    apart = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    spans = F.filter(spans_of(whole, F.coalesce(pattern, F.lit("$")), F.col(found)), apart)
    return marked.withColumn("terms", spans).drop(key, names, found)


def _listed_span(kind: str, span: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), span["start"], span["end"])


def _labelled_span(kind: str, span: Column) -> Column:
    return F.struct(span["start"].alias("start"), span["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("label"))


def listed(kinds: dict[str, str]) -> Column:
    """``kind:start:end`` of all spans, by kind as listed, then start."""
    parts = [F.transform(spans, partial(_listed_span, kind)) for kind, spans in kinds.items()]
    return F.array_join(F.flatten(F.array(*parts)), ",")


BASE_SPANS = {k: f"base.{k}" for k in KINDS}


def sanitise(marked: DataFrame, text: str = "text") -> DataFrame:
    """The text with every span replaced by its kind; overlapping spans go as one."""
    kinds = BASE_SPANS | {"term": "terms"}
    every = F.sort_array(F.flatten(F.array(*[F.transform(x, partial(_labelled_span, k)) for k, x in kinds.items()])))
    whole = text_of(text)
    cut = lambda start, length: F.substring(whole, start + 1, length)
    step = lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], cut(a["at"], s["start"] - a["at"]), s["label"])).alias("out"),
    )
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    replaced = F.aggregate(every, start, step, lambda a: F.concat(a["out"], cut(a["at"], F.length(whole))))
    touched = (F.size("terms") > 0) | has_base()
    return marked.withColumn(text, F.when(touched, replaced).otherwise(F.col(text)))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select(
        "doc_id",
        *[F.size(f"base.{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(BASE_SPANS), 256).alias("base_sha256"),
        listed(BASE_SPANS | {"term": "terms"}).alias("spans"),
    )


QUERIES = {"op3_pii": op3_pii}
SQL: dict[str, str] = {}
