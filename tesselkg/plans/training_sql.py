"""The SQL the general training-data queries are checked against (DuckDB)."""

PLAIN_ID = r"""coalesce(trim(url_decode(replace(regexp_extract({c}, '^\s*<?\s*(?:http://kg\.example/resource/)?(.*?)\s*>?\s*$', 1), '+', '%2B'))), {c})"""
SHORT = r"""trim(regexp_replace(regexp_replace(regexp_extract({c}, '^\s*<?\s*(.*?)\s*>?\s*$', 1), '^http://kg\.example/ontology/', 'dbo:'), '^http://kg\.example/property/', 'dbp:'))"""

STATEMENTS = rf"""
said AS (
  SELECT {PLAIN_ID.format(c="subject")} AS entity_id, {SHORT.format(c="predicate")} AS predicate, obj AS txt, loaded_at AS ts, 1 AS src, row_id FROM triples
  UNION ALL
  SELECT {PLAIN_ID.format(c="entity_id")}, {SHORT.format(c="k")}, attributes ->> ('$."' || k || '"'), loaded_at, 0, row_id
  FROM (SELECT *, unnest(json_keys(attributes)) AS k FROM (SELECT entity_id, loaded_at, row_id, CASE WHEN json_valid(attributes) AND json_type(attributes) = 'OBJECT' THEN attributes END AS attributes FROM entities))
),
bare AS (
  SELECT entity_id, predicate, ts, src, row_id,
    trim(regexp_replace(trim(txt, E' \t\n'), '(?s)^"(.*)"(@[A-Za-z][A-Za-z0-9-]*|\^\^\S+)?$', '\1'), E' \t\n') AS t
  FROM said WHERE txt IS NOT NULL AND entity_id IS NOT NULL
)"""

READERS = {
    "date": r"""strftime(coalesce(try_cast(t AS date),
      CASE WHEN regexp_matches(t, '^\d{4}-\d\d-\d\dT') THEN try_cast(t[:10] AS date) END,
      CASE WHEN regexp_matches(t, '^\d{8}$') THEN try_strptime(t, '%Y%m%d')::date END,
      try_strptime(t, '%d %B %Y')::date, try_strptime(t, '%d %b %Y')::date, try_strptime(t, '%B %d, %Y')::date, try_strptime(t, '%b %d, %Y')::date), '%Y-%m-%d')""",
    "int": r"""CASE
      WHEN regexp_matches(t, '^\d+(\.0+)?( min| minutes)?$') THEN try_cast(regexp_extract(t, '^\d+') AS int)::varchar
      WHEN regexp_matches(t, '^PT\d+M$') THEN regexp_extract(t, '\d+')
      WHEN regexp_matches(t, '^\d+ h \d+ min$') THEN cast(60 * regexp_extract(t, '^(\d+) h (\d+)', 1)::int + regexp_extract(t, '^(\d+) h (\d+)', 2)::int AS varchar) END""",
    "bigint": r"""CASE
      WHEN regexp_matches(t, '^(\$)?\d[\d,]*(\.\d+)?$') THEN cast(cast(round(try_cast(regexp_replace(t, '[$,]', '', 'g') AS decimal(24,6))) AS bigint) AS varchar)
      WHEN regexp_matches(t, '^\d\.\d+E\+\d\d$') THEN cast(cast(round(try_cast(t AS double)) AS bigint) AS varchar)
      WHEN regexp_matches(t, '^(US\$ )?[\d.]+(M| million)$') THEN cast(cast(round(regexp_extract(t, '([\d.]+)')::double * 1000000) AS bigint) AS varchar) END""",
    "decimal(3,1)": r"""CASE WHEN regexp_matches(t, '^\d{1,2}([.,]\d+)?( ?/ ?10)?$') THEN cast(cast(replace(regexp_extract(t, '^[\d.,]+'), ',', '.') AS decimal(3,1)) AS varchar) END""",
    "boolean": r"""CASE WHEN lower(t) IN ('true', 't', 'yes', 'y', '1') THEN 'true' WHEN lower(t) IN ('false', 'f', 'no', 'n', '0') THEN 'false' END""",
    "string": r"""CASE WHEN lower(t) NOT IN ('', '-', '?', 'n/a', 'tba', 'unknown', 'to be confirmed', 'see notes') THEN trim(regexp_replace(replace(t, '_', ' '), '\s+', ' ', 'g')) END""",
}
READ = f"""
cells AS (
  SELECT entity_id, attr, ts, src, row_id, CASE attr_type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in READERS.items())} END AS val
  FROM bare JOIN (SELECT DISTINCT * FROM attribute_columns) USING (predicate)
),
won AS (SELECT * FROM cells WHERE val IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity_id, attr ORDER BY ts DESC, src DESC, row_id DESC) = 1)"""
NARROW = ("boolean", "date", "int", "decimal(3,1)", "bigint")
P2_DISCOVERED = f"""WITH {STATEMENTS}, known AS (SELECT predicate AS attr, t FROM bare WHERE predicate IS NOT NULL AND lower(t) NOT IN ('', '-', '?', 'n/a', 'tba', 'unknown', 'to be confirmed', 'see notes')),
counted AS (SELECT attr, count(*) AS n, {", ".join(f"count({READERS[k]}) AS n{i}" for i, k in enumerate(NARROW))} FROM known GROUP BY 1)
SELECT attr, CASE {" ".join(f"WHEN n{i} >= 0.9 * n THEN '{k}'" for i, k in enumerate(NARROW))} ELSE 'string' END AS attr_type, n, CASE {" ".join(f"WHEN n{i} >= 0.9 * n THEN n{i}" for i in range(len(NARROW)))} ELSE n END AS n_readable FROM counted"""

P2_FOUND = f"WITH {STATEMENTS}, {READ} SELECT entity_id, attr, val FROM won"

P2_WIDE = f"""WITH {STATEMENTS}, {READ}
SELECT entity_id,
  max(val) FILTER (attr = 'budget') AS budget,
  max(val) FILTER (attr = 'country_name') AS country_name,
  max(val) FILTER (attr = 'gross') AS gross,
  max(val) FILTER (attr = 'in_colour') AS in_colour,
  max(val) FILTER (attr = 'release_date') AS release_date,
  max(val) FILTER (attr = 'runtime_min') AS runtime_min,
  max(val) FILTER (attr = 'score') AS score,
  max(val) FILTER (attr = 'spoken_language') AS spoken_language
FROM won
GROUP BY entity_id"""

P2_SCHEMA = f"""WITH {STATEMENTS}, fed AS (SELECT attr, min(attr_type) AS declared FROM attribute_columns GROUP BY 1),
known AS (SELECT attr, t FROM bare JOIN (SELECT DISTINCT predicate, attr FROM attribute_columns) USING (predicate) WHERE lower(t) NOT IN ('', '-', '?', 'n/a', 'tba', 'unknown', 'to be confirmed', 'see notes')),
counted AS (SELECT attr, count(*) AS n, {", ".join(f"count({READERS[k]}) AS n{i}" for i, k in enumerate(NARROW))} FROM known GROUP BY 1),
found AS (SELECT *, CASE {" ".join(f"WHEN n{i} >= 0.9 * n THEN '{k}'" for i, k in enumerate(NARROW))} ELSE 'string' END AS discovered FROM counted)
SELECT attr, declared AS attr_type, discovered, n, CASE declared {" ".join(f"WHEN '{k}' THEN n{i}" for i, k in enumerate(NARROW))} ELSE n END AS n_readable FROM fed JOIN found USING (attr)"""

SIDES = f"""
refs AS (
  SELECT row_id, 'head' AS side, {PLAIN_ID.format(c="head_entity_id")} AS id, loaded_at AS ts FROM relations
  UNION ALL SELECT row_id, 'tail', {PLAIN_ID.format(c="tail_entity_id")}, loaded_at FROM relations
),
held AS (SELECT {PLAIN_ID.format(c="entity_id")} AS id, loaded_at AS since, coalesce(deleted_at, timestamptz '9999-01-01') AS until FROM entities),
probed AS (
  SELECT row_id, side, r.ts, CASE WHEN count(h.id) = 0 THEN 'missing'
    WHEN bool_or(h.since <= r.ts AND h.until > r.ts) THEN '' WHEN bool_or(h.since <= r.ts) THEN 'deleted' ELSE 'late' END AS reason
  FROM refs r LEFT JOIN held h ON r.id = h.id WHERE r.id IS NOT NULL GROUP BY ALL
)"""

SQL = {
    "p2_found": P2_FOUND,
    "p2_wide": P2_WIDE,
    "p5_found": """
SELECT field_name, hot_key FROM (
  SELECT 'relation_type' AS field_name, relation_type AS hot_key, count(*) AS n FROM relations GROUP BY 2
  UNION ALL SELECT 'head_entity_id', head_entity_id, count(*) FROM relations GROUP BY 2
  UNION ALL SELECT 'tail_entity_id', tail_entity_id, count(*) FROM relations GROUP BY 2)
WHERE hot_key IS NOT NULL AND n >= 0.02 * (SELECT count(*) FROM relations)""",
    "p5_key_counts": """
SELECT 'relation_type' AS field_name, relation_type AS key, count(*) AS n FROM relations GROUP BY 2
UNION ALL SELECT 'head_entity_id', head_entity_id, count(*) FROM relations GROUP BY 2
UNION ALL SELECT 'tail_entity_id', tail_entity_id, count(*) FROM relations GROUP BY 2""",
    "p5_join_rollup": f"""
SELECT relation_type, entity_type, count(*) AS pairs, round(sum(r.confidence), 3) AS sum_confidence, count(r.confidence) AS n_confidence
FROM relations r JOIN entities e ON {PLAIN_ID.format(c="r.tail_entity_id")} = {PLAIN_ID.format(c="e.entity_id")} GROUP BY 1, 2""",
    "p5_path_counts": f"""
SELECT a.relation_type AS first_kind, b.relation_type AS second_kind, count(*) AS paths
FROM (SELECT relation_type, {PLAIN_ID.format(c="tail_entity_id")} AS m FROM relations) a JOIN (SELECT relation_type, {PLAIN_ID.format(c="head_entity_id")} AS m FROM relations) b USING (m) GROUP BY 1, 2""",
    "p2_discovered": P2_DISCOVERED,
    "p2_schema": P2_SCHEMA,
    "p2_typed": f"""WITH wide AS ({P2_WIDE})
SELECT entity_id, budget::bigint AS budget, country_name, gross::bigint AS gross, in_colour::boolean AS in_colour, release_date::date AS release_date, runtime_min::int AS runtime_min, score::decimal(3,1) AS score, spoken_language FROM wide""",
    "p7_found": f"WITH {SIDES} SELECT row_id, side FROM probed WHERE reason <> ''",
    "p7_report": f"""WITH {SIDES}
SELECT 'relations' AS table_name, side, strftime(ts AT TIME ZONE 'UTC', '%Y-%m') AS period, count(*) AS n_refs, count(*) FILTER (reason <> '') AS n_orphans,
  count(*) FILTER (reason = 'missing') AS n_missing, count(*) FILTER (reason = 'late') AS n_late, count(*) FILTER (reason = 'deleted') AS n_deleted
FROM probed GROUP BY 1, 2, 3""",
}
