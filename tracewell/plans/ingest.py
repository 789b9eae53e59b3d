"""Sources, sinks, group filters and sequence encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import cleaning, order, reports, windows
from tracewell.plans.fragments import (
    BASKETS,
    BASKET_LINES,
    EVENTS,
    FLAT_LINES,
    GROUPS,
    LINES,
    POSITIONED,
    SERIES,
)
from tracewell.session import shared_folder
from tracewell.sources import groups, jsonwalk, lines, sinks, tables

REQUESTED = ["7", "42", "7", "1000"]
NOISE = ["Brand#11", "Brand#23"]


def _group_sizes(g):
    """One row per group from the rows of its segments."""
    whole = g.groupBy("source_file", "group_key").agg(
        F.max("metadata").alias("metadata"), F.sum(F.size("group")).cast("int").alias("n_events")
    )
    return whole.select("source_file", "group_key", "metadata", "n_events")


def _flat_events(spark, sf):
    """The events of the group documents; a segment's positions continue those before it."""
    flat = groups.flatten_groups(groups.explode_groups(tables.group_documents(spark, sf), ("seg",)), ("seg",))
    pos = (F.col("seg") * tables.SEGMENT + F.col("pos")).cast("int")
    return flat.withColumn("pos", pos).drop("seg", "place")


def src_groups(spark, sf):
    return _group_sizes(groups.explode_groups(tables.group_documents(spark, sf)))


def src_part_scan(spark, sf):
    e = tables.events(spark, sf).select("source_file")
    # Every file also has a backup whose name fails the strict pattern.
    names = e.select(
        F.explode(F.array("source_file", F.regexp_replace("source_file", "part_", "part_old"))).alias("source_file")
    )
    strict = F.col("source_file").rlike(groups.PART_NAME)
    return groups.part_names(names, strict=False).groupBy("source_file", strict.alias("strict")).agg(
        F.count(F.lit(1)).alias("n_events")
    )


def src_quarantine(spark, sf):
    docs = tables.group_documents(spark, sf)
    # Groups without a signup arrive cut off in the middle.
    whole = F.col("value").contains('"metadata":')
    half = F.substring(F.col("value"), F.lit(1), (F.length("value") / 2).cast("int"))
    broken = docs.withColumn("value", F.when(whole, F.col("value")).otherwise(half))
    bad = groups.quarantine(broken, ("group_no",)).groupBy("source_file", "reason")
    return bad.agg(F.count_distinct("group_no").alias("n_docs"))


def parts_round_trip(spark, sf):
    """Groups written as part files of 500 and read again: groups and events of each part."""
    given = groups.explode_groups(tables.group_documents(spark, sf), ("file_no", "group_no", "seg"))
    # users recur from file to file and in segments, keys of a part must not
    unique = given.withColumn("group_key", F.concat_ws(":", "source_file", "group_key", "seg"))
    path = shared_folder(spark, "parts")
    sinks.write_group_parts(unique, path, ["file_no", "group_no", "seg"])
    back = groups.explode_groups(groups.read_parts(spark, path))
    return back.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_groups"), F.sum(F.size("group")).alias("n_events"))


def csv_round_trip(spark, sf):
    """Template counts written as CSV with an unusual separator and read again."""
    counted = tables.events(spark, sf).groupBy("template", "dup_id").agg(F.count(F.lit(1)).alias("cnt"))
    path = shared_folder(spark, "csv")
    sinks.write_csv(counted, path, "\u00a1")
    return sinks.read_csv(spark, path, "template string, dup_id string, cnt long", "\u00a1")


def dictionary_round_trip(spark, sf):
    """The template dictionary written as JSON and read again."""
    path = shared_folder(spark, "dictionary")
    sinks.write_dictionary(event_dictionary(spark, sf), path)
    return spark.read.schema("template_id long, template string").json(path)


def lines_round_trip(spark, sf):
    """A line of templates per group written as text and read again: how often each line occurs."""
    keys = ["file_no", "group_no"]
    lined = cleaning.sequence_lines(tables.positioned_events(spark, sf), keys, "pos", "template", " ", tables.SEGMENT)
    path = shared_folder(spark, "lines")
    sinks.write_lines(lined, path, keys)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("cnt"))


def matrix_round_trip(spark, sf):
    """The 0/1 matrix of brands per order written as wide CSV and read again as weighted samples."""
    wide = windows.wide_matrix(tables.basket_items(spark, sf).withColumn("one", F.lit(1)), "row_id", "var", "one")
    path = shared_folder(spark, "matrix")
    sinks.write_csv(wide.drop("row_id"), path)
    samples, names = sinks.read_binary_matrix(spark, path)
    held = samples.select("weight", F.explode("items.v").alias("v"))
    return held.join(names, "v").groupBy(F.col("name").alias("brand")).agg(F.sum("weight").alias("orders"))


def _walked(spark, sf):
    turns = tables.table(spark, sf, "conversations")
    inner = F.struct(F.array(F.struct(F.col("role").alias("template"))).alias("group"))
    item = F.struct(inner.alias("sub"), F.col("text").alias("template"))
    body = F.struct(F.array(item).alias("group"), F.col("role").alias("metadata"))
    docs = turns.select("conv_id", "turn", F.to_json(F.struct(body.alias("turn"))).alias("json"))
    return jsonwalk.walk_templates(docs, ["conv_id", "turn"])


def json_unique_templates(spark, sf):
    """Each template of the walk once, with the turn that shows it first."""
    found = jsonwalk.unique_templates(_walked(spark, sf), ["conv_id", "turn"])
    return found.where("template IS NOT NULL").select("template", "conv_id", "turn")


def json_walk_templates(spark, sf):
    walked = _walked(spark, sf)
    return walked.withColumn("path", F.array_join(F.col("path").cast("array<string>"), "/"))


def json_path_templates(spark, sf):
    return _flat_events(spark, sf).filter(F.col("template").isNotNull()).select("source_file", "group_key", "pos", "template")


def kv_value_extract(spark, sf):
    e = tables.events(spark, sf)
    key = F.concat(F.lit("key: "), "event_id")
    full = F.concat(key, F.lit(", value: ["), "template", F.lit(", value: "), "raw", F.lit(" ] "))
    rows = e.select("event_id", F.when(F.col("template") == "view", key).otherwise(full).alias("line"))
    return lines.kv_values(rows).select("event_id", "value")


def jsonl_head_valid(spark, sf):
    e = tables.events(spark, sf)
    text = F.when(F.col("template") == "view", F.concat(F.lit("{"), "raw")).otherwise(F.col("raw"))
    return lines.valid_json_head(e.select(F.col("seq").alias("line_no"), text.alias("line")))


def log_format_parse(spark, sf):
    e = tables.table(spark, sf, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    full = F.concat(day, F.lit("  "), F.upper("event_type"), F.lit(" [web] user: "), "props")
    line = F.when(F.col("event_type") == "view", day).otherwise(full)
    raw = e.select(
        F.col("user_id").cast("string").alias("source"), F.col("event_id").alias("line_no"), line.alias("line")
    )
    return lines.parse_log_format(raw, "<Date> <Level> [web] <Component>: <Content>".replace("[web]", r"\[web\]"))


def flat_record_lookup(spark, sf):
    e = tables.events(spark, sf)
    record = F.to_json(F.struct("dup_id", "template"))
    listed = F.concat(F.lit("[1, "), record, F.lit("]"))
    docs = e.select(
        "file_no", "group_no", "seq",
        F.when(F.col("template") == "view", listed).otherwise(record).alias("json"),
    )
    rows = jsonwalk.flat_records(docs, ["file_no", "group_no", "seq"])
    asked = reports.request_list(spark, REQUESTED, "dup_id")
    at = F.struct("file_no", "group_no", "seq", "pos")
    return reports.lookup(rows, asked, "dup_id", at, ["template"])


def group_keys(spark, sf):
    return tables.events(spark, sf).select("file_no", "source_file", "group_no", "group_key").distinct()


def _parts(spark, sf):
    return cleaning.assign_parts(group_keys(spark, sf), ["file_no", "group_no"])


def part_assign(spark, sf):
    return _parts(spark, sf).select("source_file", "group_key", "group_pos", "part_id")


def part_cap(spark, sf):
    return cleaning.cap_parts(_parts(spark, sf), 3).groupBy("part_id").agg(F.count(F.lit(1)).alias("n_groups"))


def event_dictionary(spark, sf):
    return order.first_seen_dictionary(
        tables.events(spark, sf), "template", tables.event_order(), "template_id"
    )


def _encoded(spark, sf):
    return cleaning.encode(tables.positioned_events(spark, sf), event_dictionary(spark, sf))


def seq_encode(spark, sf):
    return _encoded(spark, sf).select("source_file", "group_key", "pos", "template_id")


def seq_lines(spark, sf):
    return cleaning.sequence_lines(_encoded(spark, sf), ["source_file", "group_key"], "pos", "template_id", " ")


def group_lines(spark, sf):
    e = reports.with_template(tables.positioned_events(spark, sf))
    return cleaning.sequence_lines(e, ["source_file", "group_key"], "pos", "template", ", ")


def valid_groups(spark, sf):
    g = groups.valid_groups(groups.explode_groups(tables.group_documents(spark, sf)))
    return _group_sizes(g).drop("metadata")


def events_flat(spark, sf):
    return _flat_events(spark, sf)


def last_part(spark, sf):
    return groups.last_part(tables.events(spark, sf).select("source_file"))


def multi_item_groups(spark, sf):
    return tables.item_lines(cleaning.multi_item_groups(tables.order_items(spark, sf), "group_id"))


def noise_clean_drop(spark, sf):
    # Item by item: a line is the join of its items, and one whose items are all noise has no row.
    return tables.item_lines(cleaning.remove_noise(tables.order_items(spark, sf), NOISE, drop_empty=True, line="item"))


def noise_clean_keep(spark, sf):
    items = tables.order_items(spark, sf)
    kept = cleaning.remove_noise(items, NOISE, drop_empty=True, line="item")
    emptied = items.select("group_id").distinct().join(kept.select("group_id").distinct(), "group_id", "left_anti")
    empty = emptied.select("group_id", F.lit(0).cast("long").alias("seg"), F.lit("").alias("line"))
    return tables.item_lines(kept).unionByName(empty)


def template_dict(spark, sf):
    return order.first_seen_dictionary(
        tables.flat_lines(spark, sf), "template", F.struct("doc_id", "pos"), "template_id"
    )


QUERIES = {
    "parts_round_trip": parts_round_trip,
    "csv_round_trip": csv_round_trip,
    "dictionary_round_trip": dictionary_round_trip,
    "lines_round_trip": lines_round_trip,
    "matrix_round_trip": matrix_round_trip,
    "json_unique_templates": json_unique_templates,
    "src_groups": src_groups,
    "src_part_scan": src_part_scan,
    "src_quarantine": src_quarantine,
    "src_lines": tables.lines,
    "json_walk_templates": json_walk_templates,
    "json_path_templates": json_path_templates,
    "kv_value_extract": kv_value_extract,
    "jsonl_head_valid": jsonl_head_valid,
    "head_line": lambda spark, sf: lines.head_line(tables.lines(spark, sf)),
    "log_format_parse": log_format_parse,
    "flat_record_lookup": flat_record_lookup,
    "part_assign": part_assign,
    "part_cap": part_cap,
    "seq_encode": seq_encode,
    "seq_lines": seq_lines,
    "group_lines": group_lines,
    "valid_groups": valid_groups,
    "events_flat": events_flat,
    "last_part": last_part,
    "noise_clean_drop": noise_clean_drop,
    "noise_clean_keep": noise_clean_keep,
    "multi_item_groups": multi_item_groups,
    "template_dict": template_dict,
    "var_dict": lambda spark, sf: order.name_dictionary(tables.flat_lines(spark, sf), "template", "var_id"),
    "dense_line_no": tables.series,
    "distinct_first_seen": lambda spark, sf: order.distinct_first_seen(
        tables.flat_lines(spark, sf), "template", F.struct("doc_id", "pos")
    ).select("template", "first_order.doc_id", "first_order.pos"),
    "first_match": lambda spark, sf: order.first_match(
        tables.events(spark, sf), ["dup_id"], tables.event_order(), ["event_id", "template"]
    ),
}

_NOISE_SQL = """list_filter(list_transform(string_split(trim(line), ','), lambda x: trim(x)),
              lambda x: x NOT IN ('Brand#11', 'Brand#23'))"""
_DICT = "di AS (SELECT template, row_number() OVER (ORDER BY f) - 1 AS template_id FROM (SELECT template, min((file_no, group_no, seq)) AS f FROM ev GROUP BY template))"

SQL = {
    "parts_round_trip": f"""WITH {GROUPS}, nu AS (SELECT n_events, (row_number() OVER (ORDER BY file_no, group_no) - 1) // 500 AS part FROM gr)
        SELECT 'part_' || part || '.json' AS source_file, count(*) AS n_groups, sum(n_events)::BIGINT AS n_events FROM nu GROUP BY part""",
    "csv_round_trip": f"WITH {EVENTS} SELECT template, dup_id, count(*) AS cnt FROM ev GROUP BY ALL",
    "dictionary_round_trip": f"WITH {EVENTS}, {_DICT} SELECT template_id, template FROM di",
    "lines_round_trip": f"""WITH {POSITIONED}, li AS (SELECT string_agg(template, ' ' ORDER BY pos) AS line FROM pe GROUP BY file_no, group_no)
        SELECT line, count(*) AS cnt FROM li GROUP BY line""",
    "matrix_round_trip": f"WITH {BASKETS} SELECT var AS brand, count(*) AS orders FROM bk GROUP BY var",
    "json_unique_templates": """WITH w AS (SELECT conv_id, turn, 0 AS deep, regexp_replace(text, '\\n+$', '') AS template FROM conversations
          UNION ALL SELECT conv_id, turn, 1, role FROM conversations)
        SELECT template, arg_min(conv_id, (conv_id, turn, deep)) AS conv_id, arg_min(turn, (conv_id, turn, deep)) AS turn FROM w
        WHERE template IS NOT NULL GROUP BY template""",
    "src_groups": f"WITH {GROUPS} SELECT source_file, group_key, metadata, n_events FROM gr",
    "src_part_scan": f"""WITH {EVENTS} SELECT source_file, true AS strict, count(*) AS n_events FROM ev GROUP BY source_file
        UNION ALL SELECT replace(source_file, 'part_', 'part_old'), false, count(*) FROM ev GROUP BY source_file""",
    "src_quarantine": f"""WITH {GROUPS} SELECT source_file, 'malformed JSON' AS reason, count(*) AS n_docs
        FROM gr WHERE metadata IS NULL GROUP BY source_file""",
    "src_lines": f"WITH {LINES} SELECT source, line_no, template FROM ln",
    "json_walk_templates": """SELECT conv_id, turn, '0/-1/0' AS path, regexp_replace(text, '\\n+$', '') AS template FROM conversations
        UNION ALL SELECT conv_id, turn, '0/0/0/0/-1/0', role FROM conversations""",
    "json_path_templates": f"WITH {POSITIONED} SELECT source_file, group_key, pos, template FROM pe",
    "kv_value_extract": f"""WITH {EVENTS}, li AS (SELECT event_id, CASE WHEN template = 'view' THEN 'key: ' || event_id
            ELSE 'key: ' || event_id || ', value: [' || template || ', value: ' || raw || ' ]' END AS line FROM ev),
        va AS (SELECT event_id, line, trim(substr(line, strpos(line, 'value:') + 6)) AS v FROM li)
        SELECT event_id, CASE WHEN strpos(line, 'value:') = 0 THEN 'None'
            WHEN starts_with(v, '[') AND ends_with(v, ']') THEN trim(substr(v, 2, length(v) - 2)) ELSE v END AS value FROM va""",
    "jsonl_head_valid": f"""WITH {EVENTS}, li AS (SELECT seq AS line_no, CASE WHEN template = 'view' THEN '{{' || raw ELSE raw END AS line FROM ev)
        SELECT line_no, line FROM li WHERE json_valid(line) ORDER BY line_no LIMIT 100""",
    "head_line": f"WITH {LINES} SELECT source, line_no, template FROM ln WHERE line_no = 0",
    "log_format_parse": r"""WITH li AS (SELECT CAST(user_id AS VARCHAR) AS source, event_id,
            CASE WHEN event_type = 'view' THEN strftime(ts, '%Y-%m-%d')
                 ELSE strftime(ts, '%Y-%m-%d') || '  ' || upper(event_type) || ' [web] user: ' || props END AS line FROM events),
        ok AS (SELECT *, '^(.*?)\s+(.*?)\s+\[web\]\s+(.*?):\s+(.*?)$' AS p FROM li WHERE regexp_matches(line, '^(.*?)\s+(.*?)\s+\[web\]\s+(.*?):\s+(.*?)$'))
        SELECT source, row_number() OVER (PARTITION BY source ORDER BY event_id) AS "LineId",
            regexp_extract(line, '^(.*?)\s+(.*?)\s+\[web\]\s+(.*?):\s+(.*?)$', 1) AS "Date",
            regexp_extract(line, '^(.*?)\s+(.*?)\s+\[web\]\s+(.*?):\s+(.*?)$', 2) AS "Level",
            regexp_extract(line, '^(.*?)\s+(.*?)\s+\[web\]\s+(.*?):\s+(.*?)$', 3) AS "Component",
            regexp_extract(line, '^(.*?)\s+(.*?)\s+\[web\]\s+(.*?):\s+(.*?)$', 4) AS "Content" FROM ok""",
    "flat_record_lookup": f"""WITH {EVENTS}, rq AS (SELECT * FROM (VALUES (0, '7'), (1, '42'), (2, '7'), (3, '1000')) t(pos, dup_id)),
        hit AS (SELECT dup_id, arg_min(template, (file_no, group_no, seq)) AS template FROM ev GROUP BY dup_id)
        SELECT CAST(pos AS BIGINT) AS pos, dup_id, coalesce(template, 'NOT FOUND') AS template FROM rq LEFT JOIN hit USING (dup_id)""",
    "part_assign": f"""WITH {GROUPS}, o AS (SELECT *, row_number() OVER (ORDER BY file_no, group_no) - 1 AS group_pos FROM gr)
        SELECT source_file, group_key, group_pos, group_pos // 500 AS part_id FROM o""",
    "part_cap": f"""WITH {GROUPS}, o AS (SELECT (row_number() OVER (ORDER BY file_no, group_no) - 1) // 500 AS part_id FROM gr)
        SELECT part_id, count(*) AS n_groups FROM o WHERE part_id <= 3 GROUP BY part_id""",
    "seq_encode": f"WITH {POSITIONED}, {_DICT} SELECT source_file, group_key, pos, template_id FROM pe JOIN di USING (template)",
    "seq_lines": f"""WITH {POSITIONED}, {_DICT} SELECT source_file, group_key, pos // 10000 AS seg,
        CASE WHEN min(pos) >= 10000 THEN ' ' ELSE '' END || string_agg(CAST(template_id AS VARCHAR), ' ' ORDER BY pos) AS line FROM pe JOIN di USING (template) GROUP BY ALL""",
    "group_lines": f"""WITH {POSITIONED} SELECT source_file, group_key, pos // 10000 AS seg,
        CASE WHEN min(pos) >= 10000 THEN ', ' ELSE '' END || string_agg(template, ', ' ORDER BY pos) AS line FROM pe WHERE template <> '' GROUP BY ALL""",
    "valid_groups": f"WITH {GROUPS} SELECT source_file, group_key, n_events FROM gr WHERE metadata IS NOT NULL",
    "events_flat": f"WITH {POSITIONED} SELECT source_file, group_key, pos, event_id, dup_id, raw, template FROM pe",
    "last_part": f"WITH {EVENTS} SELECT max(CAST(regexp_extract(source_file, 'part_(\\d+)', 1) AS BIGINT)) AS last_part FROM ev",
    "noise_clean_drop": f"""WITH {BASKET_LINES}, k AS (SELECT group_id, {_NOISE_SQL} AS kept FROM bl)
        SELECT group_id, CAST(0 AS BIGINT) AS seg, array_to_string(kept, ', ') AS line FROM k WHERE len(kept) > 0""",
    "noise_clean_keep": f"""WITH {BASKET_LINES}, k AS (SELECT group_id, {_NOISE_SQL} AS kept FROM bl)
        SELECT group_id, CAST(0 AS BIGINT) AS seg, coalesce(array_to_string(kept, ', '), '') AS line FROM k""",
    "multi_item_groups": f"""WITH {BASKET_LINES} SELECT group_id, CAST(0 AS BIGINT) AS seg, line FROM bl
        WHERE len(list_filter(string_split(line, ','), lambda x: trim(x) <> '')) > 1""",
    "template_dict": f"""WITH {FLAT_LINES}, f AS (SELECT template, min((doc_id, pos)) AS f FROM fl GROUP BY template)
        SELECT row_number() OVER (ORDER BY f) - 1 AS template_id, template FROM f""",
    "var_dict": f"""WITH {FLAT_LINES}, d AS (SELECT DISTINCT template FROM fl)
        SELECT row_number() OVER (ORDER BY template) - 1 AS var_id, template FROM d""",
    "dense_line_no": f"WITH {SERIES} SELECT source, line_no, template FROM se",
    "distinct_first_seen": f"""WITH {FLAT_LINES}, f AS (SELECT template, doc_id, pos, row_number() OVER (PARTITION BY template ORDER BY doc_id, pos) AS r FROM fl)
        SELECT template, doc_id, pos FROM f WHERE r = 1""",
    "first_match": f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY dup_id ORDER BY file_no, group_no, seq) AS n FROM ev)
        SELECT dup_id, event_id, template FROM r WHERE n = 1""",
}


