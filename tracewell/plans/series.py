"""Windows, bins, lags and template mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import adaptive, drain, windows
from tracewell.plans.fragments import FREQUENT, LINES, SERIES
from tracewell.sources import tables

# Fixed masking patterns of the mining queries: web addresses, numbers of two and more digits.
MASKS = [r"https?://[^ ]+", r"[0-9]{2,}"]


def _frequent(spark, sf):
    return windows.frequent_lines(tables.lines(spark, sf), unordered=tables.flat_lines(spark, sf))


def _tokenized(spark, sf):
    return drain.tokenize(tables.lines(spark, sf), MASKS)


def _mined(spark, sf):
    return drain.mine_templates(tables.lines(spark, sf), patterns=MASKS)


def drain_structured(spark, sf):
    return drain.structured(tables.lines(spark, sf), patterns=MASKS)


def template_summary(spark, sf):
    return drain.template_summary(_mined(spark, sf), "template", F.col("line_no"))


def drain_params(spark, sf):
    found = drain_structured(spark, sf).withColumn("params", drain.parameters("Content", "EventTemplate"))
    return found.select("source", "LineId", "EventId", F.array_join("params", " | ").alias("ParameterList"))


def template_similarity(spark, sf):
    pairs = drain.adjacent_similarity(_tokenized(spark, sf))
    return pairs.withColumn("similarity", F.round("similarity", 6))


QUERIES = {
    "frequent_lines": _frequent,
    "frequent_slots": lambda spark, sf: windows.frequent_slots(
        tables.lines(spark, sf), unordered=tables.flat_lines(spark, sf)
    ),
    "choose_window": lambda spark, sf: windows.choose_window(_frequent(spark, sf)),
    "matrix_quality": lambda spark, sf: windows.matrix_quality(windows.choose_window(_frequent(spark, sf))),
    "win_sets": lambda spark, sf: windows.window_members(
        tables.series(spark, sf), 5, unordered=tables.flat_series(spark, sf)
    ),
    "win_rows": lambda spark, sf: windows.window_sets(tables.series(spark, sf), 5).withColumn(
        "items", F.array_join("items", ",")
    ),
    "bin_open": lambda spark, sf: windows.bins_open(tables.lines(spark, sf)),
    "bin_clamped": lambda spark, sf: windows.bins_clamped(
        tables.lines(spark, sf), unordered=tables.flat_lines(spark, sf)
    ),
    "bin_counts": lambda spark, sf: windows.bin_counts(windows.bins_open(tables.lines(spark, sf))),
    "bin_matrix_dense": lambda spark, sf: windows.bin_matrix(
        windows.bins_clamped(tables.series(spark, sf), 10, tables.flat_series(spark, sf))
    ),
    "bin_adaptive": lambda spark, sf: adaptive.bins_adaptive(
        tables.series(spark, sf), unordered=tables.flat_series(spark, sf)
    ),
    "lag_pairs": lambda spark, sf: windows.lag_pairs(tables.series(spark, sf)),
    "lag_cooccurrence": lambda spark, sf: windows.lag_cooccurrence(tables.series(spark, sf)),
    "drain_tokens": lambda spark, sf: _tokenized(spark, sf).select(
        "source", "line_no", F.array_join("toks", " ").alias("masked"), "n_tokens"
    ),
    "drain_buckets": lambda spark, sf: drain.bucket_sizes(_tokenized(spark, sf)),
    # a template does not depend on the numbers of its lines
    "template_consensus": lambda spark, sf: drain.consensus(drain.tokenize(tables.flat_lines(spark, sf), MASKS)),
    "template_similarity": template_similarity,
    "drain_exact": _mined,
    "drain_structured": drain_structured,
    "template_summary": template_summary,
    "drain_params": drain_params,
}

_TOKENS = LINES + r""", mk AS (
  SELECT source, line_no, regexp_replace(regexp_replace(template, 'https?://[^ ]+', '<*>', 'g'),
         '[0-9]{2,}', '<*>', 'g') AS masked FROM ln)
, tk AS (SELECT source, line_no, regexp_split_to_array(regexp_replace(masked, '^\s+|\s+$', '', 'g'), '\s+') AS toks FROM mk)"""

SQL = {
    "frequent_lines": f"WITH {FREQUENT} SELECT source, line_no, template FROM fr",
    "frequent_slots": f"""WITH {FREQUENT} SELECT ln.source, ln.line_no, fq.template AS template
        FROM ln LEFT JOIN fq ON ln.source = fq.source AND ln.template = fq.template""",
    "choose_window": f"""WITH {FREQUENT} SELECT source, count(*) AS n_lines, count(DISTINCT template) AS n_features,
        greatest(2, least(30, count(*) - 5 * count(DISTINCT template) + 1)) AS window_size FROM fr GROUP BY source""",
    "matrix_quality": f"""WITH {FREQUENT}, s AS (SELECT source, count(*) AS n, count(DISTINCT template) AS n_features FROM fr GROUP BY source),
        w AS (SELECT *, greatest(2, least(30, n - 5 * n_features + 1)) AS window_size FROM s),
        q AS (SELECT source, window_size, greatest(n - window_size + 1, 0) AS n_samples, n_features FROM w)
        SELECT source, window_size, n_samples, n_features, round(n_samples / n_features, 6) AS ratio,
        CASE WHEN n_samples / n_features >= 10 THEN 'high' WHEN n_samples / n_features >= 5 THEN 'moderate' ELSE 'low' END AS confidence FROM q""",
    "win_sets": f"""WITH {SERIES}, n AS (SELECT source, count(*) AS n FROM se GROUP BY source)
        SELECT DISTINCT a.source, a.line_no AS win, b.template FROM se a JOIN n ON a.source = n.source AND a.line_no <= n.n - 5
        JOIN se b ON a.source = b.source AND b.line_no BETWEEN a.line_no AND a.line_no + 4""",
    "win_rows": f"""WITH {SERIES}, n AS (SELECT source, count(*) AS n FROM se GROUP BY source)
        SELECT a.source, a.line_no AS win, string_agg(DISTINCT b.template, ',' ORDER BY b.template) AS items
        FROM se a JOIN n ON a.source = n.source AND a.line_no <= n.n - 5
        JOIN se b ON a.source = b.source AND b.line_no BETWEEN a.line_no AND a.line_no + 4 GROUP BY ALL""",
    "bin_open": f"WITH {LINES} SELECT source, line_no, template, line_no // 60 + 1 AS bin FROM ln",
    "bin_clamped": f"""WITH {LINES} SELECT source, line_no, template,
        least(line_no // 60 + 1, greatest(1, count(*) OVER (PARTITION BY source) // 60)) AS bin FROM ln""",
    "bin_counts": f"WITH {LINES} SELECT source, template, line_no // 60 + 1 AS bin, count(*) AS cnt FROM ln GROUP BY ALL",
    "bin_matrix_dense": f"""WITH {SERIES}, b AS (SELECT source, template,
            least(line_no // 10 + 1, greatest(1, count(*) OVER (PARTITION BY source) // 10)) AS bin FROM se),
        t AS (SELECT DISTINCT source, template FROM b), d AS (SELECT DISTINCT source, bin FROM b)
        SELECT t.source, t.template, d.bin, count(b.bin) AS cnt FROM t JOIN d ON t.source = d.source
        LEFT JOIN b ON b.source = t.source AND b.template = t.template AND b.bin = d.bin GROUP BY ALL""",
    "bin_adaptive": f"""WITH RECURSIVE {SERIES}, st AS (
          SELECT source, line_no, template, CAST(0 AS BIGINT) AS bin, [template] AS seen FROM se WHERE line_no = 0
          UNION ALL
          SELECT se.source, se.line_no, se.template, CASE WHEN len(st.seen) = 5 THEN st.bin + 1 ELSE st.bin END,
            CASE WHEN len(st.seen) = 5 THEN [se.template]
                 WHEN list_contains(st.seen, se.template) THEN st.seen ELSE list_append(st.seen, se.template) END
          FROM st JOIN se ON se.source = st.source AND se.line_no = st.line_no + 1)
        SELECT source, line_no, template, bin FROM st""",
    "lag_pairs": f"""WITH {SERIES} SELECT a.source, a.line_no, a.template, k.lag, b.template AS earlier
        FROM se a, (SELECT unnest([1, 2, 3])::BIGINT AS lag) k JOIN se b ON b.source = a.source AND b.line_no = a.line_no - k.lag""",
    "lag_cooccurrence": f"""WITH {SERIES} SELECT b.template AS src, a.template AS dst, k.lag, count(*) AS cnt
        FROM se a, (SELECT unnest([1, 2, 3])::BIGINT AS lag) k JOIN se b ON b.source = a.source AND b.line_no = a.line_no - k.lag GROUP BY ALL""",
    "drain_tokens": f"WITH {_TOKENS} SELECT source, line_no, array_to_string(toks, ' ') AS masked, len(toks) AS n_tokens FROM tk",
    "drain_buckets": f"""WITH {_TOKENS} SELECT source, len(toks) AS n_tokens,
        array_to_string(list_transform(toks[1:2], lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END), ' ') AS route,
        count(*) AS cnt FROM tk GROUP BY ALL""",
    "template_consensus": f"""WITH {_TOKENS}, bu AS (SELECT source, len(toks) AS n_tokens,
          array_to_string(list_transform(toks[1:2], lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END), ' ') AS route,
          toks, count(*) AS n FROM tk WHERE len(toks) > 0 GROUP BY ALL)
        , po AS (SELECT source, n_tokens, route, unnest(toks) AS tok, unnest(range(1, n_tokens + 1)) AS pos FROM bu)
        , co AS (SELECT source, n_tokens, route, pos, CASE WHEN count(DISTINCT tok) = 1 THEN min(tok) ELSE '<*>' END AS tok FROM po GROUP BY ALL)
        , te AS (SELECT source, n_tokens, route, string_agg(tok, ' ' ORDER BY pos) AS template FROM co GROUP BY ALL)
        SELECT te.*, s.n_lines, s.n_distinct FROM te JOIN (SELECT source, n_tokens, route, sum(n)::BIGINT AS n_lines, count(*) AS n_distinct
          FROM bu GROUP BY ALL) s USING (source, n_tokens, route)""",
    "template_similarity": f"""WITH {_TOKENS}, p AS (SELECT b.source, b.line_no, list_zip(a.toks, b.toks) AS z, len(b.toks) AS n
          FROM tk a JOIN tk b ON a.source = b.source AND b.line_no = a.line_no + 1 AND len(a.toks) = len(b.toks))
        SELECT source, line_no, round(len(list_filter(z, lambda x: x[1] = x[2] AND x[1] <> '<*>')) / n, 6) AS similarity,
        array_to_string(list_transform(z, lambda x: CASE WHEN x[1] = x[2] THEN x[1] ELSE '<*>' END), ' ') AS merged FROM p""",
}
