"""Common table expressions that state the table adapters in SQL."""

EVENTS = """ev AS (
  SELECT date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS file_no,
         'part_' || CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS VARCHAR) || '.json' AS source_file,
         user_id AS group_no, CAST(user_id AS VARCHAR) AS group_key, event_id AS seq,
         CAST(event_id AS VARCHAR) AS event_id, json_extract_string(props, '$.k') AS dup_id,
         props AS raw, event_type AS template
  FROM events)"""

POSITIONED = (
    EVENTS
    + """, pe AS (
  SELECT *, row_number() OVER (PARTITION BY file_no, group_no ORDER BY seq) - 1 AS pos FROM ev)"""
)

GROUPS = (
    POSITIONED
    + """, gr AS (
  SELECT file_no, source_file, group_no, group_key, count(*) AS n_events,
         min_by(raw, pos) FILTER (WHERE template = 'signup') AS metadata
  FROM pe GROUP BY ALL)"""
)

SERIES = """se AS (
  SELECT CAST(user_id AS VARCHAR) AS source,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS line_no,
         event_type AS template
  FROM events)"""

FLAT_LINES = r"""fl AS (
  SELECT source, doc_id, unnest(parts) AS template, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS pos
  FROM (SELECT source, doc_id,
               list_filter(list_transform(string_split(text, chr(10)),
                                          lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
                           lambda x: x <> '') AS parts
        FROM documents))"""

LINES = (
    FLAT_LINES
    + """, ln AS (
  SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) - 1 AS line_no, template
  FROM fl)"""
)

FREQUENT = (
    LINES
    + """, fq AS (
  SELECT source, template FROM ln GROUP BY source, template HAVING count(*) >= 5)
, fr AS (
  SELECT source, row_number() OVER (PARTITION BY source ORDER BY line_no) - 1 AS line_no, template
  FROM ln SEMI JOIN fq USING (source, template))"""
)

BASKETS = """bk AS (
  SELECT DISTINCT l_orderkey AS row_id, p_brand AS var FROM lineitem JOIN part ON l_partkey = p_partkey)"""

BASKET_LINES = """bl AS (
  SELECT l_orderkey AS group_id, string_agg(p_brand, ', ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS line
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)"""

PHRASES = r"""ph AS (
  SELECT doc_id, unnest(parts) AS phrase, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS phrase_no
  FROM (SELECT doc_id,
               list_filter(list_transform(regexp_split_to_array(text, '[,\n]+'),
                                          lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
                           lambda x: x <> '') AS parts
        FROM documents))"""

# Transition graph of the series: an edge is directed when one direction is clearly more frequent.
TRANSITIONS = (
    SERIES
    + """, nx AS (
  SELECT a.template AS cur, b.template AS next
  FROM se a JOIN se b ON a.source = b.source AND b.line_no = a.line_no + 1)
, tp AS (
  SELECT least(cur, next) AS i, greatest(cur, next) AS j,
         count(*) FILTER (WHERE cur < next) AS ij, count(*) FILTER (WHERE cur > next) AS ji
  FROM nx WHERE cur <> next GROUP BY ALL)
, ep AS (
  SELECT i, j,
         CASE WHEN (ij - ji) * (ij - ji) <= ij + ji THEN -1 WHEN ij > ji THEN -1 ELSE 1 END AS at_i,
         CASE WHEN (ij - ji) * (ij - ji) <= ij + ji THEN -1 WHEN ij > ji THEN 1 ELSE -1 END AS at_j
  FROM tp)
, ed AS (
  SELECT i AS source, j AS target, 'directed' AS relation FROM ep WHERE at_i = -1 AND at_j = 1
  UNION ALL SELECT j, i, 'directed' FROM ep WHERE at_i = 1 AND at_j = -1
  UNION ALL SELECT i, j, 'undirected' FROM ep WHERE at_i = -1 AND at_j = -1
  UNION ALL SELECT j, i, 'undirected' FROM ep WHERE at_i = -1 AND at_j = -1)"""
)
