"""Chat formatting: a template and a role automaton, in DataFrame operations only.

The template is data: per role an opening and a closing marker and whether its text is trained on.
The automaton is a table of transitions over roles; a conversation is valid if it ends in an
accepting state. Every conversation is formatted, valid or not, as segments with a loss flag; their
concatenation is the training text. Only texts of trained roles carry the flag.

Control strings inside texts and roles are escaped: a backslash is doubled, and one is put behind
the first character of a control string. So markers occur in the output only where the template puts
them, and the turns can be read back.

Turns are ordered by number, then role, then text; a null number comes first, repeated rows stay.
Null texts and roles are empty. A role outside the template gets a generic marker with its name.
A null conversation id is a conversation. Empty tables stay empty. Other columns are not read. One
conversation is one training text, so its turns meet in one row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import table, text_of


@dataclass(frozen=True)
class Role:
    open: str
    close: str
    trained: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Role] = field(
        default_factory=lambda: {
            "system": Role("<<SYS>>", "<</SYS>>"),
            "user": Role("[INST]", "[/INST]"),
            "assistant": Role("[REPLY]", "</s>", trained=True),
        }
    )
    #: Any other role: marker, its name, marker, its text, marker.
    other: tuple[str, str, str] = ("[TURN]", "[AS]", "[/TURN]")
    #: (state, role) to state.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "asked",
            ("start", "user"): "told",
            ("asked", "user"): "told",
            ("told", "assistant"): "answered",
            ("answered", "user"): "told",
        }
    )
    accepting: tuple[str, ...] = ("answered",)
    #: Also escaped in texts, though the template itself does not use it.
    reserved: tuple[str, ...] = ("<s>",)

    def controls(self) -> list[str]:
        own = [m for r in self.roles.values() for m in (r.open, r.close)]
        return sorted({*own, *self.other, *self.reserved}, key=lambda m: (-len(m), m))


def escape(text: Column, template: Template) -> Column:
    starts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template.controls())
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({starts})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _segment(text: Column | str, loss: bool) -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    return F.struct(text.alias("text"), F.lit(loss).alias("loss"))


def _segments(role: Column, text: Column, template: Template) -> Column:
    head, middle, tail = template.other
    generic = F.array(
        _segment(F.concat(F.lit(f"{head} "), escape(role, template), F.lit(f" {middle} ")), False),
        _segment(escape(text, template), False),
        _segment(f" {tail}", False),
    )
    out = generic
    for name, r in template.roles.items():
        own = F.array(
            _segment(f"{r.open} ", False), _segment(escape(text, template), r.trained), _segment(f" {r.close}", False)
        )
        out = F.when(role == name, own).otherwise(out)
    return out


def _state(turns: Column, template: Template) -> Column:
    moves = F.create_map(*[F.lit(x) for (s, r), to in template.moves.items() for x in (f"{s} {r}", to)])
    step = lambda s, t: F.coalesce(F.try_element_at(moves, F.concat_ws(" ", s, t["role"])), F.lit("broken"))
    return F.aggregate(turns, F.lit("start"), step)


def format_chats(
    turns: DataFrame,
    template: Template | None = None,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """(key, valid, segments, formatted): one row per conversation."""
    template = template or Template()
    row = F.struct(F.col(turn).alias("turn"), text_of(role).alias("role"), text_of(text).alias("text"))
    grouped = turns.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    parts = F.flatten(F.transform("turns", lambda t: _segments(t["role"], t["text"], template)))
    formatted = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return (
        grouped.withColumn("valid", _state(F.col("turns"), template).isin(*template.accepting))
        .withColumn("segments", parts)
        .select(key, "valid", "segments", formatted.alias("formatted"))
    )


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a training text: array of (role, text)."""
    template = template or Template()
    head, middle, tail = map(re.escape, template.other)
    opens = "|".join(f"{re.escape(r.open)} " for r in template.roles.values())
    closes = "|".join(re.escape(r.close) for r in template.roles.values())
    pattern = F.lit(f"(?s)(?:({opens})|{head} (.*?) {middle} )(.*?) (?:{closes}|{tail})")
    found = [F.regexp_extract_all(formatted, pattern, F.lit(i)) for i in (1, 2, 3)]
    name = lambda t: reduce(
        lambda rest, item: F.when(t["0"] == f"{item[1].open} ", item[0]).otherwise(rest),
        template.roles.items(),
        unescape(t["1"]),
    )
    zipped = F.arrays_zip(*[f.alias(str(i)) for i, f in enumerate(found)])
    return F.transform(zipped, lambda t: F.struct(name(t).alias("role"), unescape(t["2"]).alias("text")))


def loss_text(segments: Column) -> Column:
    """All text under the loss flag, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    out = format_chats(turns.unionByName(probe))
    out = out.withColumn("turns", read_back(F.col("formatted"))).withColumn("loss_part", loss_text(F.col("segments")))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss_part").cast("long").alias("loss_chars"),
        F.sha2("loss_part", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


_TWIN = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, regexp_replace(
    regexp_replace(replace(text, '\\', '\\\\'), '<(<SYS>>|</SYS>>|/s>|s>)', '<\\\\\\1', 'g'),
    '\\[(INST\\]|/INST\\]|REPLY\\]|TURN\\]|AS\\]|/TURN\\])', '[\\\\\\1', 'g') AS safe
  FROM turns
), sized AS (
  SELECT *, length(safe) + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 13
    ELSE 21 + length(role) END AS chars, lag(role) OVER w AS before, lead(role) OVER w AS behind
  FROM escaped WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN before IS NULL AND behind IS NOT DISTINCT FROM 'user'
    WHEN 'user' THEN (before IS NULL OR before IN ('system', 'assistant')) AND behind IS NOT DISTINCT FROM 'assistant'
    WHEN 'assistant' THEN before IS NOT DISTINCT FROM 'user' AND (behind IS NULL OR behind = 'user')
    ELSE false END) AS valid
FROM sized GROUP BY conv_id
"""

QUERIES = {"op9_chat_format": op9_chat_format}
SQL = {"op9_chat_format": _TWIN}
