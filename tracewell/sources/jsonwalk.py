"""Template extraction from JSON of unknown depth, and from flat records, with VARIANT."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.order import first_match
from tracewell.session import cut_lineage


def _text(c):
    """Variant value as text; a JSON null is rendered as None."""
    return F.coalesce(F.try_variant_get(c, "$", "string"), F.lit("None"))


def walk_templates(docs: DataFrame, keys: list[str], levels: int = 8) -> DataFrame:
    """Every ``group[].template`` at any depth, in pre-order: a node's own group items come first.

    Children are visited in document order. VARIANT gives the types of the values but sorts the keys
    of an object, so each node also carries its text, whose keys keep their order.

    Each step opens one nesting level of all documents at once and passes found templates on, so a
    document is parsed once. After ``levels`` steps the rows are checkpointed, and the walk goes on
    while any node is open. ``path`` is the list of child numbers from the root, so sorting by it
    restores the walk.
    """
    rows = docs.select(
        *keys,
        F.array().cast("array<int>").alias("path"),
        F.try_parse_json("json").alias("node"),
        F.col("json").alias("text"),
        F.lit(None).cast("string").alias("template"),
    ).filter(F.col("node").isNotNull())
    while True:
        for _ in range(levels):
            rows = _open_level(rows, keys)
        rows = cut_lineage(rows)
        if rows.filter(F.col("node").isNotNull()).isEmpty():
            return rows.select(*keys, "path", "template")


def unique_templates(walked: DataFrame, keys: list[str]) -> DataFrame:
    """Each template once, where the walk meets it first: (keys, path, template)."""
    return first_match(walked, ["template"], F.struct(*keys, "path"), [*keys, "path"]).select(*keys, "path", "template")


def _open_level(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Replace each open node by its templates and its child nodes; keep found templates."""
    path, node, text = F.col("path"), F.col("node"), F.col("text")
    no_node, no_text = F.lit(None).cast("variant"), F.lit(None).cast("string")

    def row(at, inner, json, template):
        return F.struct(at.alias("path"), inner.alias("node"), json.alias("text"), template.alias("template"))

    def item(x, i):
        fields = F.map_keys(F.try_variant_get(x, "$", "map<string,variant>"))
        has = F.schema_of_variant(x).startswith("OBJECT") & F.array_contains(fields, "template")
        found = F.regexp_replace(_text(F.try_variant_get(x, "$.template", "variant")), r"\n+$", "")
        # -1 sorts a node's own items before the items of its children.
        return row(F.concat(path, F.array(F.lit(-1), i)), no_node, no_text, F.when(has, found))

    def child(x, json, i):
        open_ = F.schema_of_variant(x).rlike("^(OBJECT|ARRAY)")
        return row(F.concat(path, F.array(i)), F.when(open_, x), F.when(open_, json), no_text)

    items = F.transform(F.try_variant_get(node, "$.group", "array<variant>"), item)
    fields, written = F.try_variant_get(node, "$", "map<string,variant>"), F.from_json(text, "map<string,string>")
    ranked = lambda m: F.array_sort(F.transform(F.map_keys(m), lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    values, texts = F.map_values(fields), F.map_values(written)
    # both lists of keys in one order: which value of the object is which part of the text
    of_object = F.zip_with(ranked(fields), ranked(written), lambda v, t: child(values[v["i"]], texts[t["i"]], t["i"]))
    elements, parts = F.try_variant_get(node, "$", "array<variant>"), F.from_json(text, "array<string>")
    of_array = F.transform(elements, lambda x, i: child(x, parts[i], i))
    children = F.when(F.schema_of_variant(node).startswith("ARRAY"), of_array).otherwise(of_object)
    same = F.array(row(path, no_node, no_text, F.col("template")))
    none = F.filter(same, lambda x: F.lit(False))
    opened = F.concat(F.coalesce(items, none), F.coalesce(children, none))
    return rows.select(*keys, F.inline(F.when(node.isNull(), same).otherwise(opened))).filter(
        F.col("node").isNotNull() | F.col("template").isNotNull()
    )


def flat_records(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Top-level (dup_id, template) of a list of records or of a single record."""
    parsed = docs.select(*keys, F.try_parse_json("json").alias("v"))
    items = F.coalesce(
        F.try_variant_get("v", "$", "array<variant>"),
        F.when(F.col("v").isNotNull(), F.array("v")),
    )
    rows = parsed.select(*keys, F.posexplode(items).alias("pos", "item"))
    return rows.filter(F.schema_of_variant("item").startswith("OBJECT")).select(
        *keys,
        "pos",
        F.try_variant_get("item", "$.dup_id", "string").alias("dup_id"),
        F.try_variant_get("item", "$.template", "string").alias("template"),
    )
