"""Silver: admission of observations, identifiers, append with conflict-ignore, membership."""

from lakewright.plans.dialect import relation, sql_query

relation("property_types", "SELECT 'order_date' AS typed, 'date' AS datatype UNION ALL SELECT 'ship_date', 'date' UNION ALL SELECT 'customer_key', 'integer' UNION ALL SELECT 'order_key', 'integer' UNION ALL SELECT 'supplier_key', 'integer'")
relation(
    "obs_reasons",
    """SELECT o.*, datatype, CASE
      WHEN entity_id IS NULL OR entity_id = '' THEN 'entity id is empty'
      WHEN NOT matches(entity_id, '^(customer|supplier|order):[0-9]+$') THEN 'entity id has another class'
      WHEN value IS NULL THEN 'value is null'
      WHEN confidence IS NULL OR confidence < 0 OR confidence > 1 THEN 'confidence is out of range'
      WHEN datatype = 'date' AND NOT matches(value, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 'value is no date'
      WHEN datatype = 'integer' AND NOT matches(value, '^-?[0-9]+$') THEN 'value is no integer'
      WHEN source_id IS NULL THEN 'source is missing' END AS reason
    FROM obs o LEFT JOIN property_types ON typed = property_id""",
)
relation("silver", "SELECT DISTINCT run_id, entity_id, entity_class, property_id, value, source_id, source_type, authority_tier, publisher_id, confidence, step, value_id FROM obs_reasons WHERE reason IS NULL")
# Distinct publishers, sources and values are numbered by windows, so that one pass over silver serves all that follows.
relation(
    "numbered",
    """SELECT s.*, rank, CAST(dense_rank() OVER (PARTITION BY entity_id, property_id, value ORDER BY coalesce(nullif(publisher_id, ''), source_id)) AS BIGINT) AS publisher_no,
    CAST(dense_rank() OVER (PARTITION BY entity_id, property_id, value ORDER BY source_id) AS BIGINT) AS source_no, CAST(dense_rank() OVER (PARTITION BY entity_id, property_id ORDER BY value) AS BIGINT) AS value_no
    FROM silver s JOIN tiers ON tier = authority_tier""",
)
relation(
    "corroborated",
    """SELECT n.*, max(publisher_no) OVER (PARTITION BY entity_id, property_id, value) AS corroboration, max(rank) OVER (PARTITION BY entity_id, property_id, value) AS best_tier,
    max(source_no) OVER (PARTITION BY entity_id, property_id, value) AS sources, max(confidence) OVER (PARTITION BY entity_id, property_id, value) AS best_confidence, max(value_no) OVER (PARTITION BY entity_id, property_id) AS n_values FROM numbered n""",
)

sql_query("obs_validate", "SELECT entity_class, coalesce(reason, 'accepted') AS outcome, count(*) AS n FROM obs_reasons GROUP BY entity_class, coalesce(reason, 'accepted')")
sql_query("datatype_check", "SELECT property_id, coalesce(datatype, 'string') AS datatype, count_if(reason IS NULL) AS valid, count_if(reason IS NOT NULL) AS invalid FROM obs_reasons GROUP BY property_id, coalesce(datatype, 'string')")
sql_query("corroboration", "SELECT entity_id, property_id, value, source_id, value_id, corroboration FROM corroborated WHERE property_id IN ('priority', 'status') AND entity_class = 'customer'")
sql_query("silver_scan_run", "SELECT run_id, entity_id, property_id, value, value_id FROM silver WHERE run_id = 'run-0' AND entity_class = 'supplier'")
sql_query("value_ids", "SELECT DISTINCT value_id, entity_id, property_id FROM obs WHERE entity_class = 'customer'")
sql_query("observation_ids", "SELECT sha('{\"class\":\"' || entity_class || '\",\"entity\":\"' || entity_id || '\",\"property\":\"' || property_id || '\",\"value\":\"' || value || '\"}') AS observation_id, count(*) AS n FROM silver WHERE entity_class = 'supplier' GROUP BY 1")
sql_query("entity_ids", "SELECT DISTINCT entity_class, sha(entity_id) AS entity_hash FROM silver WHERE entity_class <> 'order'")
sql_query("emit_validate", "SELECT property_id, matches(value_id, '^val:[0-9a-f]{24}$') AS key_ok, confidence BETWEEN 0 AND 1 AS confidence_ok, count(*) AS n FROM obs GROUP BY 1, 2, 3")
# an append that ignores ids which the target has: the target holds the runs of even orders
relation("silver_target", "SELECT DISTINCT value_id FROM silver WHERE source_id IN ('src0', 'src2')")
sql_query("silver_upsert_ignore", "SELECT count(*) AS offered, count_if(t.value_id IS NULL) AS inserted, count_if(t.value_id IS NOT NULL) AS ignored FROM (SELECT DISTINCT value_id FROM silver) s LEFT JOIN silver_target t ON s.value_id = t.value_id")
sql_query("silver_union", "SELECT source_id, count(*) AS n FROM (SELECT value_id, source_id FROM silver UNION SELECT value_id, source_id FROM silver WHERE source_id = 'src1') u GROUP BY source_id")
sql_query(
    "membership",
    """SELECT c_custkey AS id, 'customer:' || CAST(c_custkey AS STRING) AS entity_id, listed IS NOT NULL AS listed FROM customer
    LEFT JOIN (SELECT DISTINCT o_custkey AS listed FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00') l ON listed = c_custkey""",
)
sql_query("bronze_put_dedup", "SELECT 'sha256:' || sha(text) AS bronze_key, count(*) AS puts, min(doc_id) AS first_doc FROM documents GROUP BY 1")
sql_query("key_grammar", """SELECT key, matches(key, '^(sha256:[0-9a-f]{64}|(gold|runs)/[A-Za-z0-9_./-]+)$') AND NOT matches(key, '(^|/)[.][.]?(/|$)') AS valid FROM (
  SELECT bronze_key AS key FROM page_rows UNION ALL SELECT 'gold/run-0/../x' UNION ALL SELECT 'runs/a/b.json' UNION ALL SELECT 'sha256:abc' UNION ALL SELECT './x' UNION ALL SELECT 'gold/./x') k""")
sql_query("cache_hit_split", "SELECT h AS request, count(*) AS n, min(doc_id) AS first_doc, CASE WHEN min(doc_id) % 2 = 0 THEN 'hit' ELSE 'fetch' END AS plan FROM (SELECT doc_id, sha(coalesce(source, '') || ':' || text) AS h FROM documents) d GROUP BY h")
sql_query("canonical_json", """SELECT event_id, '{"id":' || CAST(event_id AS STRING) || ',"type":"' || event_type || '"}' AS canonical, sha('{"id":' || CAST(event_id AS STRING) || ',"type":"' || event_type || '"}') AS digest FROM events""")
