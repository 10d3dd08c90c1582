"""Extraction and profiling: format detection, flattening, tables, columns, text functions."""

from lakewright.plans.dialect import relation, sql_query

relation(
    "cells",
    """SELECT doc_id, 'source' AS col, 1 AS ord, source AS cell FROM documents UNION ALL SELECT doc_id, 'lang', 2, lang FROM documents UNION ALL SELECT doc_id, 'n_chars', 3, CAST(n_chars AS STRING) FROM documents
    UNION ALL SELECT doc_id, 'first_word', 4, regexp_extract(text, '^([^ ]*)', 1) FROM documents UNION ALL SELECT d.doc_id, 'quality', 5, CAST(quality AS STRING) FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
relation("cell_counts", "SELECT col, cell, count(*) AS n, min(doc_id) AS first_doc FROM cells WHERE cell IS NOT NULL AND cell <> '' GROUP BY col, cell")
relation("cell_patterns", """SELECT c.*, CASE WHEN length(cell) > 500 THEN NULL WHEN matches(cell, '^[0-9]+$') THEN 'integer' WHEN matches(cell, '^[0-9]+[.][0-9]+$') THEN 'number' WHEN matches(cell, '^[a-z]{2}$') THEN 'language'
  WHEN matches(cell, '^src[0-9]+$') THEN 'source' WHEN matches(cell, '^[A-Za-z]+$') THEN 'word' END AS pattern FROM cells c WHERE cell IS NOT NULL AND cell <> ''""")
relation("column_stats", "SELECT col, round(CAST(count(CASE WHEN cell <> '' THEN 1 END) AS DOUBLE) / count(*), 4) AS fill_rate, count(DISTINCT CASE WHEN cell <> '' THEN cell END) AS distinct_values FROM cells GROUP BY col")
relation("column_patterns", "SELECT col, pattern, n, row_number() OVER (PARTITION BY col ORDER BY n DESC, pattern) AS place FROM (SELECT col, pattern, count(*) AS n FROM cell_patterns WHERE pattern IS NOT NULL GROUP BY col, pattern) p")
relation("column_profiles", "SELECT s.col, s.fill_rate, s.distinct_values, coalesce(p.pattern, 'none') AS pattern, coalesce(p.n, 0) AS hits FROM column_stats s LEFT JOIN column_patterns p ON p.col = s.col AND p.place = 1")

sql_query("column_profile", "SELECT col, fill_rate, distinct_values, pattern, hits FROM column_profiles")
sql_query("column_top_values", "SELECT col, cell, n FROM (SELECT c.*, row_number() OVER (PARTITION BY col ORDER BY n DESC, first_doc, cell) AS place FROM cell_counts c) r WHERE place <= 5")
sql_query("pattern_match", "SELECT col, coalesce(pattern, 'none') AS pattern, count(*) AS n FROM cell_patterns GROUP BY col, coalesce(pattern, 'none')")
sql_query("table_fingerprint", "SELECT substr(sha(max(CASE WHEN col = 'first_word' THEN k END) || '|' || max(CASE WHEN col = 'lang' THEN k END) || '|' || max(CASE WHEN col = 'n_chars' THEN k END)), 1, 16) AS fingerprint FROM (SELECT col, col || ':' || pattern || ':' || CAST(CAST(round(fill_rate * 10000, 0) AS BIGINT) AS STRING) AS k FROM column_profiles) c")
sql_query("granularity", "SELECT col, CASE WHEN distinct_values * 10 < hits THEN 'aggregate' WHEN fill_rate >= 0.9 THEN 'entity' ELSE 'entity_candidate' END AS verdict FROM column_profiles")
sql_query("header_row", "SELECT col, min(CASE WHEN NOT matches(cell, '^[0-9.]+$') THEN doc_id END) AS header_doc, min(doc_id) AS first_doc FROM cells WHERE cell IS NOT NULL AND cell <> '' GROUP BY col")
sql_query("preview", "SELECT col, cell, doc_id FROM (SELECT c.*, row_number() OVER (PARTITION BY col ORDER BY doc_id) AS place FROM cells c) r WHERE place <= 5")
sql_query("entity_rows", "SELECT doc_id, 'row:' || CAST(doc_id AS STRING) AS receipt, names_of(col || '=' || cell) AS cells FROM cells WHERE col <> 'first_word' AND cell IS NOT NULL GROUP BY doc_id")
sql_query("largest_table", "SELECT source AS sheet, n FROM (SELECT source, n, row_number() OVER (ORDER BY n DESC, first_doc) AS place FROM (SELECT source, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY source) s) r WHERE place = 1")
sql_query("sheet_preview", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents) r WHERE place <= 4")
sql_query("column_automap", "SELECT prop, min(col) AS col FROM (SELECT prop, replace_all(lower(prop), '[^a-z0-9]', '') AS p FROM (SELECT DISTINCT prop FROM declared UNION SELECT 'n_chars' UNION SELECT 'Source' UNION SELECT 'Lang') d) a JOIN (SELECT DISTINCT col, replace_all(lower(col), '[^a-z0-9]', '') AS c FROM cells) b ON p = c GROUP BY prop HAVING count(*) = 1")
sql_query("rows_to_observations", "SELECT 'document:' || CAST(doc_id AS STRING) AS entity_id, col AS property_id, cell AS value, 'row:' || CAST(doc_id AS STRING) || '/col:' || CAST(ord AS STRING) AS selector FROM cells WHERE cell IS NOT NULL AND cell <> '' AND col <> 'first_word' AND NOT (col = 'n_chars' AND NOT matches(cell, '^[0-9]+$'))")
sql_query("detect_format", """SELECT page_id, CASE WHEN begins(html, '%PDF-') THEN 'pdf' WHEN begins(html, 'PK') THEN 'zip' WHEN matches(html, '^[ ]*[{]') THEN 'json' WHEN matches(lower(substr(html, 1, 200)), '<(!doctype html|html)') THEN 'html' WHEN begins(html, '<?xml') THEN 'xml' ELSE 'csv' END AS format, length(html) AS chars FROM pages""")
sql_query("format_from_mime", "SELECT page_id, CASE WHEN matches(lower(url), '[.]html?([?#]|$)') THEN 'html' WHEN matches(lower(url), '[.]csv([?#]|$)') THEN 'csv' WHEN matches(lower(url), '[.]json([?#]|$)') THEN 'json' ELSE 'unknown' END AS format FROM pages")
sql_query("html_links", "SELECT page_id, href, count(*) AS n FROM hrefs GROUP BY page_id, href")
sql_query("dom_skeleton", "SELECT page_id, skeleton FROM page_rows")
sql_query("page_text", "SELECT page_id, trim(replace_all(replace_all(replace_all(html, '<(script|style)>[^<]*</(script|style)>', ' '), '<[^>]*>', ' '), '[ \t\n\r]+', ' ')) AS text FROM pages")
sql_query("challenge_flag", "SELECT page_id, matches(lower(html), 'captcha|verify you are human|access denied|please log ?in') AS challenged FROM pages")
sql_query("text_rows_split", "SELECT doc_id, length_of(regex_all(text, '([^|]+)', 1)) AS cells FROM documents WHERE has(text, ' | ')")
sql_query("parse_jsonl", "SELECT event_type, min(key_of(props)) AS lowest, max(key_of(props)) AS highest, count(DISTINCT key_of(props)) AS keys FROM events GROUP BY event_type")
sql_query("record_instances", "SELECT o_orderkey, CASE WHEN count(DISTINCT l_suppkey) > 4 THEN 'ambiguous_multiple_values:supplier' WHEN count(l_suppkey) = 0 THEN 'missing_or_ambiguous_identifier' ELSE 'ok' END AS gap, count(l_suppkey) AS instances FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
sql_query("record_granularity", "SELECT template, CASE WHEN count(DISTINCT skeleton) = 1 THEN 'uniform' ELSE 'mixed' END AS verdict, count(*) AS pages FROM page_types GROUP BY template")
sql_query("normalize_identifier", "SELECT doc_id, lower(trim(replace_all(text, '[ \t\n\r]+', ' '))) AS identifier FROM documents")
sql_query("normalize_ascii", "SELECT c_custkey, replace_all(lower(c_name), '[^a-z0-9]', '') AS lookup FROM customer")
sql_query("label_key", "SELECT p_partkey, join_list(regex_all(lower(p_name), '[a-z0-9]+', 0), ' ') AS label FROM part")
sql_query("token_sets", "SELECT token, count(*) AS n FROM (SELECT each_of(regex_all(lower(p_name || ' ' || p_type), '[a-z0-9]{4,}', 0)) AS token FROM part) t WHERE token NOT IN ('with', 'from', 'that') GROUP BY token")
sql_query("collapse_cap", "SELECT doc_id, substr(trim(replace_all(text, '[ \t\n\r]+', ' ')), 1, 160) AS snippet FROM documents")
sql_query("number_clauses", "SELECT doc_id, length_of(regex_all(text, '[0-9]+', 0)) AS numbers FROM documents WHERE matches(text, '[0-9]')")
sql_query("unrepeat", "SELECT n_nationkey, CASE WHEN twice = once || ' ' || once THEN once ELSE twice END AS name FROM (SELECT n_nationkey, n_name AS once, CASE WHEN n_nationkey % 2 = 0 THEN n_name || ' ' || n_name ELSE n_name || ' x' END AS twice FROM nation) n")
sql_query("slug_humanize", "SELECT p_partkey, replace_all(lower(p_name), '[^a-z0-9]+', '-') AS slug, replace(p_brand, '#', ' ') AS human FROM part")
sql_query("slug_unique", "SELECT p_partkey, slug || CASE WHEN place > 1 THEN '-' || CAST(place AS STRING) ELSE '' END AS property_id FROM (SELECT p_partkey, slug, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS place FROM (SELECT p_partkey, replace_all(lower(p_brand), '[^a-z0-9]+', '-') AS slug FROM part) s) r")
sql_query("redact", "SELECT doc_id, replace_all(text, '(password|secret|token|api_key)[ ]*[:=][ ]*[^ \n]+', '[redacted]') AS redacted FROM documents WHERE matches(text, '(password|secret|token|api_key)[ ]*[:=]')")
sql_query("coerce_cells", "SELECT col, count_if(matches(cell, '^-?[0-9]+$')) AS integers, count_if(lower(cell) IN ('true', 'yes', '1')) AS trues, count_if(cell = '') AS blanks FROM cells WHERE cell IS NOT NULL GROUP BY col")
sql_query("array_map_ops", "SELECT lang, names_of(source) AS sources, count(DISTINCT source) AS n FROM documents GROUP BY lang")
sql_query("pointer_build", "SELECT page_id, '/' || replace(replace(path, '~', '~0'), '/', '~1') AS pointer FROM page_rows")
sql_query("fingerprints", "SELECT sha(host || '|' || template) AS fingerprint, count(*) AS n FROM page_types GROUP BY host, template")
sql_query("parse_verdict", "SELECT conv_id, turn, CASE WHEN matches(lower(text), 'unsafe|inject') THEN 'flagged' WHEN matches(lower(text), 'safe|ok') THEN 'safe' ELSE 'unknown' END AS verdict FROM conversations")
relation("text_lines", "SELECT doc_id, each_of(regex_all(text, '([^\n]+)', 1)) AS line FROM documents WHERE has(text, '|')")
# table lines hold a bar; a line of bars, dashes, colons and blanks divides header from body
relation("table_lines", "SELECT doc_id, replace_all(replace_all(trim(line), '^[|]', ''), '[|]$', '') AS inner_line, matches(line, '^[ |:-]*-[ |:-]*$') AS divides FROM text_lines WHERE has(line, '|')")
sql_query("md_table_rows", "SELECT doc_id, inner_line, trim(part(inner_line, '|', 1)) AS first_cell, 1 + length(inner_line) - length(replace(inner_line, '|', '')) AS cells, count(*) AS n FROM table_lines WHERE NOT divides GROUP BY doc_id, inner_line")
