"""Frequency reports, lookups, transitions and the text-preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import corpus, graph, reports, windows
from tracewell.plans.fragments import EVENTS, LINES, PHRASES, TRANSITIONS
from tracewell.plans.ingest import REQUESTED, event_dictionary
from tracewell.sources import tables

EVENT_IDS = ["17", "3", "999999999999"]
TEMPLATES = [" Error", "click", "missing template"]
_SIGNATURE = "tokens128_frac0.9_split=comma+newline"


def _events(spark, sf):
    return tables.events(spark, sf)


def _phrases(spark, sf):
    return corpus.phrases(tables.table(spark, sf, "documents"), ["doc_id"])


def _phrase_id():
    return F.concat_ws(":", "doc_id", "phrase_no")


def dup_lookup(spark, sf):
    asked = reports.request_list(spark, REQUESTED, "dup_id")
    return reports.lookup(_events(spark, sf), asked, "dup_id", tables.event_order(), ["template"])


def event_lookup(spark, sf):
    asked = reports.request_list(spark, EVENT_IDS, "event_id")
    return reports.lookup(
        _events(spark, sf), asked, "event_id", tables.event_order(), ["template", "dup_id", "source_file"]
    )


def template_search(spark, sf):
    asked = reports.request_list(spark, TEMPLATES, "template")
    return reports.template_search(_events(spark, sf), asked)


def next_template(spark, sf):
    dist = reports.next_template(windows.following(tables.series(spark, sf)))
    return dist.withColumn("prob", F.round("prob", 6))


def endpoints(spark, sf):
    """Endpoint table of the transition graph: undirected unless one way is clearly more frequent."""
    pairs = windows.following(tables.series(spark, sf)).filter(F.col("cur") != F.col("next"))
    counted = pairs.groupBy(F.least("cur", "next").alias("i"), F.greatest("cur", "next").alias("j")).agg(
        F.count_if(F.col("cur") < F.col("next")).alias("ij"),
        F.count_if(F.col("cur") > F.col("next")).alias("ji"),
    )
    d = F.col("ij") - F.col("ji")
    even = d * d <= F.col("ij") + F.col("ji")
    return counted.select(
        "i",
        "j",
        F.when(even | (d > 0), -1).otherwise(1).alias("at_i"),
        F.when(even | (d < 0), -1).otherwise(1).alias("at_j"),
    )


def edges(spark, sf):
    return graph.classify_endpoints(endpoints(spark, sf))


def template_by_id(spark, sf):
    """Transition counts between dictionary ids, with the source id resolved to its text."""
    d = event_dictionary(spark, sf)
    pairs = windows.following(tables.series(spark, sf)).groupBy("cur").agg(F.count(F.lit(1)).alias("cnt"))
    coded = pairs.join(d, pairs.cur == d.template).select(F.col("template_id").alias("node"), "cnt")
    return reports.relabel(coded, "node", event_dictionary(spark, sf), "template_id", "template")


def ancestor_descendant(spark, sf):
    nodes = _events(spark, sf).select("template").distinct()
    return graph.first_neighbours(nodes, edges(spark, sf))


def customer_orders(spark, sf):
    o = tables.table(spark, sf, "orders")
    return o.select(
        F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("o"), "o_orderkey").alias("target")
    )


QUERIES = {
    "template_freq": lambda spark, sf: reports.template_freq(_events(spark, sf), tables.event_order()),
    "id_filter": lambda spark, sf: reports.id_filter(_events(spark, sf), "dup_id", REQUESTED).select(
        "source_file", "group_key", "event_id", "dup_id", "template"
    ),
    "files_all_ids": lambda spark, sf: reports.files_with_all_ids(_events(spark, sf), REQUESTED[:2]),
    "match_report": lambda spark, sf: reports.matching_report(_events(spark, sf), REQUESTED[:2]),
    "files_any_id": lambda spark, sf: reports.files_with_any_id(_events(spark, sf), "dup_id", REQUESTED),
    "keyword_counts": lambda spark, sf: reports.keyword_counts(_events(spark, sf)),
    "top_dup_ids": lambda spark, sf: reports.top_ids(_events(spark, sf), tables.event_order()),
    "template_search": template_search,
    "dup_lookup": dup_lookup,
    "event_lookup": event_lookup,
    "line_counts": lambda spark, sf: reports.line_counts(tables.flat_lines(spark, sf)),
    "template_by_id": template_by_id,
    "next_template": next_template,
    "edge_classify": edges,
    "edge_report": lambda spark, sf: graph.edge_report(edges(spark, sf)),
    "undirected_pairs": lambda spark, sf: graph.undirected_pairs(edges(spark, sf)),
    "drop_node": lambda spark, sf: graph.drop_node(edges(spark, sf), "error"),
    "ancestor_descendant": ancestor_descendant,
    "wcc": lambda spark, sf: graph.weak_components(customer_orders(spark, sf)),
    "dag_extensions": lambda spark, sf: graph.acyclic_orientations(edges(spark, sf)),
    "phrases": _phrases,
    "head_fraction": lambda spark, sf: corpus.head_fraction(tables.table(spark, sf, "documents"), "doc_id"),
    "hash_split": lambda spark, sf: corpus.hash_split(_phrases(spark, sf), _phrase_id()).select(
        "doc_id", "phrase_no", "split"
    ),
    "truncate_tokens": lambda spark, sf: corpus.truncate_tokens(_phrases(spark, sf), "phrase"),
    "token_len_stats": lambda spark, sf: corpus.token_length_stats(tables.flat_lines(spark, sf), "template"),
    "corpus_fingerprint": lambda spark, sf: corpus.fingerprint(
        _phrases(spark, sf), F.concat_ws(":", "doc_id", "phrase_no", "phrase"), _SIGNATURE
    ),
}

_RQ = "rq AS (SELECT * FROM (VALUES (0, '7'), (1, '42'), (2, '7'), (3, '1000')) t(pos, dup_id))"

SQL = {
    "template_freq": f"WITH {EVENTS} SELECT template, count(*) AS occurrences FROM ev WHERE template <> '' GROUP BY template",
    "id_filter": f"WITH {EVENTS} SELECT source_file, group_key, event_id, dup_id, template FROM ev WHERE dup_id IN ('7', '42', '1000')",
    "files_all_ids": f"""WITH {EVENTS}, c AS (SELECT source_file, count(*) FILTER (WHERE dup_id = '7') AS a, count(*) FILTER (WHERE dup_id = '42') AS b
        FROM ev GROUP BY source_file) SELECT source_file, a + b AS total FROM c WHERE least(a, b) >= 2""",
    "match_report": f"""WITH {EVENTS}, c AS (SELECT source_file, count(*) FILTER (WHERE dup_id = '7') AS a, count(*) FILTER (WHERE dup_id = '42') AS b
          FROM ev GROUP BY source_file),
        f AS (SELECT source_file, a, b, row_number() OVER (ORDER BY a + b DESC, source_file) - 1 AS rank FROM c WHERE least(a, b) >= 2)
        SELECT 0::BIGINT AS place, CASE WHEN EXISTS (SELECT 1 FROM f) THEN 'Files by total occurrences of the ids'
          ELSE 'No file holds every id at least 2 times' END AS line
        UNION ALL SELECT 1 + 3 * rank, 'File: ' || source_file || ' - total ' || (a + b) FROM f
        UNION ALL SELECT 2 + 3 * rank, '  7: ' || a FROM f UNION ALL SELECT 3 + 3 * rank, '  42: ' || b FROM f""",
    "files_any_id": f"""WITH {EVENTS} SELECT source_file, dup_id, count(*) AS cnt FROM ev
        WHERE dup_id IN ('7', '42', '1000') GROUP BY ALL""",
    "keyword_counts": f"""WITH {EVENTS} SELECT source_file, count(*) FILTER (WHERE contains(lower(template), 'make')) AS make,
        count(*) FILTER (WHERE contains(lower(template), 'compile')) AS compile,
        count(*) FILTER (WHERE contains(lower(template), 'linker')) AS linker,
        count(*) FILTER (WHERE contains(lower(template), 'error')) AS error FROM ev GROUP BY source_file""",
    "top_dup_ids": f"""WITH {EVENTS}, c AS (SELECT dup_id, count(*) AS frequency, min((file_no, group_no, seq)) AS f,
        arg_min(raw, (file_no, group_no, seq)) AS raw, arg_min(template, (file_no, group_no, seq)) AS template
        FROM ev WHERE dup_id <> '' GROUP BY dup_id)
        SELECT dup_id, frequency, raw, template FROM c ORDER BY frequency DESC, f LIMIT 20""",
    "template_search": f"""WITH {EVENTS}, rq AS (SELECT * FROM (VALUES (0, ' Error'), (1, 'click'), (2, 'missing template')) t(pos, template))
        SELECT CAST(rq.pos AS BIGINT) AS pos, rq.template, count(ev.seq) AS occurrences, count(DISTINCT ev.source_file) AS n_files
        FROM rq LEFT JOIN ev ON lower(trim(ev.template)) = lower(trim(rq.template)) GROUP BY rq.pos, rq.template""",
    "dup_lookup": f"""WITH {EVENTS}, {_RQ}, hit AS (SELECT dup_id, arg_min(template, (file_no, group_no, seq)) AS template FROM ev GROUP BY dup_id)
        SELECT CAST(pos AS BIGINT) AS pos, dup_id, coalesce(template, 'NOT FOUND') AS template FROM rq LEFT JOIN hit USING (dup_id)""",
    "event_lookup": f"""WITH {EVENTS}, rq AS (SELECT * FROM (VALUES (0, '17'), (1, '3'), (2, '999999999999')) t(pos, event_id))
        SELECT CAST(pos AS BIGINT) AS pos, event_id, coalesce(template, 'NOT FOUND') AS template, coalesce(dup_id, 'NOT FOUND') AS dup_id,
        coalesce(source_file, 'NOT FOUND') AS source_file FROM rq LEFT JOIN ev USING (event_id)""",
    "line_counts": f"WITH {LINES} SELECT source, count(*) AS n_lines FROM ln GROUP BY source",
    "template_by_id": f"""WITH {TRANSITIONS}, {EVENTS}, c AS (SELECT cur, count(*) AS cnt FROM nx GROUP BY cur),
        di AS (SELECT template, row_number() OVER (ORDER BY f) - 1 AS template_id FROM (SELECT template, min((file_no, group_no, seq)) AS f FROM ev GROUP BY template))
        SELECT template_id AS node, cnt, template AS node_template FROM c JOIN di ON cur = template""",
    "next_template": f"""WITH {TRANSITIONS}, c AS (SELECT cur, next, count(*) AS cnt FROM nx GROUP BY ALL),
        t AS (SELECT *, pow(cnt / sum(cnt) OVER (PARTITION BY cur), 1.0 / 0.8) AS t FROM c),
        k AS (SELECT *, row_number() OVER (PARTITION BY cur ORDER BY cnt DESC, next) AS r FROM t),
        q AS (SELECT *, t / sum(t) OVER (PARTITION BY cur) AS q FROM k WHERE r <= 50),
        b AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY cur ORDER BY cnt DESC, next ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q),
        n AS (SELECT * FROM b WHERE before < 0.95)
        SELECT cur, next, cnt, round(q / sum(q) OVER (PARTITION BY cur), 6) AS prob FROM n""",
    "edge_classify": f"WITH {TRANSITIONS} SELECT source, target, relation FROM ed",
    "edge_report": f"""WITH {TRANSITIONS} SELECT (SELECT count(DISTINCT n) FROM (SELECT source AS n FROM ed UNION ALL SELECT target FROM ed)) AS n_variables,
        count(*) FILTER (WHERE relation = 'directed') AS directed, count(*) FILTER (WHERE relation = 'bidirectional') AS bidirectional,
        count(*) FILTER (WHERE relation = 'undirected') AS undirected FROM ed""",
    "undirected_pairs": f"WITH {TRANSITIONS} SELECT a.source AS x, a.target AS y FROM ed a JOIN ed b ON a.source = b.target AND a.target = b.source WHERE a.source < a.target",
    "drop_node": f"WITH {TRANSITIONS} SELECT source, target, relation FROM ed WHERE source <> 'error' AND target <> 'error'",
    "ancestor_descendant": f"""WITH {TRANSITIONS}, t AS (SELECT DISTINCT template FROM se)
        SELECT template, coalesce((SELECT min(source) FROM ed WHERE relation = 'directed' AND target = template), 'NA') AS ancestor,
        coalesce((SELECT min(target) FROM ed WHERE relation = 'directed' AND source = template), 'NA') AS descendant FROM t""",
    "wcc": """WITH RECURSIVE ed AS (SELECT 'c' || o_custkey AS a, 'o' || o_orderkey AS b FROM orders),
        p AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
        r AS (SELECT a AS node, a AS other FROM p UNION SELECT r.node, p.b FROM r JOIN p ON r.other = p.a)
        SELECT node, min(other) AS component FROM r GROUP BY node""",
    "dag_extensions": f"""WITH RECURSIVE {TRANSITIONS}, up AS (SELECT row_number() OVER (ORDER BY source, target) - 1 AS k, source AS x, target AS y
            FROM ed WHERE relation = 'undirected' AND source < target),
        cd AS (SELECT unnest(range(CAST(pow(2, (SELECT count(*) FROM up)) AS BIGINT))) AS code),
        ce AS (SELECT code, source AS a, target AS b FROM cd, ed WHERE relation = 'directed'
            UNION ALL SELECT code, CASE WHEN (code >> k) & 1 = 0 THEN x ELSE y END, CASE WHEN (code >> k) & 1 = 0 THEN y ELSE x END FROM cd, up),
        r AS (SELECT code, a, b FROM ce UNION SELECT r.code, r.a, ce.b FROM r JOIN ce ON r.code = ce.code AND r.b = ce.a)
        SELECT code FROM cd WHERE code NOT IN (SELECT code FROM r WHERE a = b)""",
    "phrases": f"WITH {PHRASES} SELECT doc_id, phrase_no, phrase FROM ph",
    "head_fraction": f"""WITH {PHRASES}, n AS (SELECT *, row_number() OVER (ORDER BY doc_id, phrase_no) - 1 AS i, count(*) OVER () AS n FROM ph)
        SELECT doc_id, phrase_no, phrase FROM n WHERE i < greatest(1, CAST(floor(n * 0.9::DOUBLE) AS BIGINT))""",
    "hash_split": f"""WITH {PHRASES} SELECT doc_id, phrase_no,
        CASE WHEN CAST('0x' || substr(md5(doc_id || ':' || phrase_no || ':42'), 1, 15) AS BIGINT) % 100 < 10 THEN 'eval' ELSE 'train' END AS split FROM ph""",
    "truncate_tokens": rf"""WITH {PHRASES}, t AS (SELECT doc_id, phrase_no, regexp_split_to_array(phrase, '\s+') AS t FROM ph)
        SELECT doc_id, phrase_no, array_to_string(t[1:128], ' ') AS phrase, len(t) AS n_tokens FROM t""",
    "token_len_stats": rf"""WITH {LINES}, t AS (SELECT len(regexp_split_to_array(template, '\s+')) AS n FROM ln)
        SELECT count(*) AS n_lines, round(avg(n), 6) AS avg_tokens, max(n) AS max_tokens FROM t""",
    "corpus_fingerprint": f"""WITH {PHRASES} SELECT bit_xor(CAST('0x' || substr(md5(doc_id || ':' || phrase_no || ':' || phrase), 1, 15) AS BIGINT)) AS content_hash,
        count(*) AS n_rows, '{_SIGNATURE}' AS signature FROM ph""",
}

