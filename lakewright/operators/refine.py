"""Gold: value choice, evidence, entities, links, rule flags and their checks."""

from lakewright.plans.dialect import relation, sql_query

# Candidates of one value form a group; groups rank by best tier, sources, best confidence, then canonical text; within
# the first group its best observation speaks for it.
relation(
    "ranked_values",
    """SELECT DISTINCT entity_id, entity_class, property_id, value, sources, best_tier, n_values,
    CAST(dense_rank() OVER (PARTITION BY entity_id, property_id ORDER BY best_tier DESC, sources DESC, best_confidence DESC, value) AS BIGINT) AS place FROM corroborated""",
)
relation(
    "gold_fields",
    """SELECT entity_id, entity_class, property_id, value, value_id, source_id, source_type, step, best_confidence AS confidence, n_values, sources, CASE WHEN n_values = 1 THEN 'gold' ELSE 'conflict' END AS status FROM (
      SELECT c.*, row_number() OVER (PARTITION BY entity_id, property_id ORDER BY best_tier DESC, sources DESC, best_confidence DESC, value, rank DESC, confidence DESC, source_id, value_id, coalesce(step, -1)) AS place FROM corroborated c
    ) r WHERE place = 1""",
)
relation("declared", """SELECT 'customer' AS class, 'customer_key' AS prop, TRUE AS dod UNION ALL SELECT 'customer', 'name', TRUE UNION ALL SELECT 'customer', 'segment', TRUE UNION ALL SELECT 'customer', 'nation', TRUE
  UNION ALL SELECT 'customer', 'priority', TRUE UNION ALL SELECT 'customer', 'status', FALSE UNION ALL SELECT 'supplier', 'supplier_key', TRUE UNION ALL SELECT 'supplier', 'name', TRUE UNION ALL SELECT 'supplier', 'nation', FALSE
  UNION ALL SELECT 'order', 'order_key', TRUE UNION ALL SELECT 'order', 'order_date', TRUE UNION ALL SELECT 'order', 'customer_ref', FALSE UNION ALL SELECT 'order', 'ship_date', FALSE UNION ALL SELECT 'order', 'status', FALSE""")
relation("entities", "SELECT DISTINCT entity_id, entity_class FROM obs_reasons WHERE reason IS NULL")
# Dense over the declared properties: what was not observed is a missing field.
relation(
    "fields",
    """SELECT e.entity_id, class AS entity_class, prop AS property_id, dod, value, value_id, source_id, source_type, step, coalesce(confidence, 0) AS confidence, coalesce(n_values, 0) AS n_values, coalesce(sources, 0) AS sources, coalesce(status, 'missing') AS status
    FROM entities e JOIN declared ON class = e.entity_class LEFT JOIN gold_fields g ON g.entity_id = e.entity_id AND g.property_id = prop""",
)
relation("present", "SELECT entity_id, entity_class, property_id, value, value_id, dod FROM gold_fields JOIN declared ON class = entity_class AND prop = property_id WHERE status = 'gold' AND value_id IS NOT NULL")
relation("relation_specs", "SELECT 'same_nation' AS relation_id, 'customer' AS domain_class, 'nation' AS domain_prop, 'supplier' AS range_class, 'nation' AS range_prop UNION ALL SELECT 'placed_by', 'order', 'customer_ref', 'customer', 'customer_key'")
relation(
    "gold_links",
    """SELECT DISTINCT relation_id, s.entity_id AS source, t.entity_id AS target, s.value_id AS via FROM relation_specs
    JOIN present s ON s.entity_class = domain_class AND s.property_id = domain_prop
    JOIN present t ON t.entity_class = range_class AND t.property_id = range_prop AND t.value = s.value WHERE s.entity_id <> t.entity_id""",
)
# links by value hub: who has a link, and how many, without listing the pairs
relation("value_hubs", "SELECT entity_class AS hub_class, property_id AS hub_prop, value AS hub, count(DISTINCT entity_id) AS held, min(entity_id) AS low, max(entity_id) AS high FROM present GROUP BY entity_class, property_id, value")
relation(
    "link_counts",
    """SELECT relation_id, s.entity_id AS source, CAST(sum(held - CASE WHEN domain_class = range_class AND domain_prop = range_prop THEN 1 ELSE 0 END) AS BIGINT) AS links FROM relation_specs
    JOIN present s ON s.entity_class = domain_class AND s.property_id = domain_prop
    JOIN value_hubs ON hub_class = range_class AND hub_prop = range_prop AND hub = s.value WHERE low <> s.entity_id OR high <> s.entity_id GROUP BY relation_id, s.entity_id""",
)
relation("linked", "SELECT relation_id, source FROM link_counts")
relation(
    "gold_flags",
    """SELECT a.entity_id, 'shipped_before_order' AS rule_id, a.value_id AS first_id, b.value_id AS second_id FROM present a JOIN present b ON a.entity_id = b.entity_id
      WHERE a.property_id = 'ship_date' AND b.property_id = 'order_date' AND CAST(a.value AS DATE) < CAST(b.value AS DATE)
    UNION ALL SELECT entity_id, 'urgent_open', value_id, CAST(NULL AS STRING) FROM present WHERE entity_class = 'order' AND property_id = 'status' AND value = 'O'
    UNION ALL SELECT a.entity_id, 'same_value', a.value_id, b.value_id FROM present a JOIN present b ON a.entity_id = b.entity_id
      WHERE a.property_id = 'nation' AND b.property_id IN ('customer_key', 'supplier_key') AND a.value = b.value""",
)

sql_query("rank_values", "SELECT entity_id, property_id, value, place, sources, best_tier FROM ranked_values WHERE property_id IN ('priority', 'status') AND entity_class = 'customer'")
sql_query("resolve_values", "SELECT entity_id, property_id, value, status, n_values, round(confidence, 6) AS confidence FROM gold_fields WHERE entity_class = 'customer'")
sql_query("representative_obs", "SELECT entity_id, property_id, value_id, source_id FROM gold_fields WHERE property_id = 'priority'")
sql_query(
    "evidence_union",
    """SELECT g.entity_id, g.property_id, g.status, names_of(s.source_id || '/' || s.source_type) AS evidence FROM gold_fields g
    JOIN silver s ON s.entity_id = g.entity_id AND s.property_id = g.property_id AND (g.status = 'conflict' OR s.value = g.value) WHERE g.property_id = 'priority' GROUP BY g.entity_id, g.property_id, g.status""",
)
sql_query("entity_assembly", "SELECT entity_id, entity_class, count(*) AS declared_properties, count_if(status = 'gold') AS gold, count_if(status = 'conflict') AS conflict, count_if(status = 'missing') AS missing, names_of(CASE WHEN status = 'gold' THEN property_id || '=' || value END) AS properties FROM fields WHERE entity_class <> 'order' GROUP BY entity_id, entity_class")
sql_query("present_fields", "SELECT entity_class, property_id, count(*) AS n FROM present GROUP BY entity_class, property_id")
sql_query("gold_values_index", "SELECT value_id, min(entity_id) AS entity_id, min(property_id) AS property_id, count(*) AS n FROM gold_fields WHERE entity_class = 'customer' GROUP BY value_id")
sql_query(
    "relation_links",
    "SELECT relation_id, source, target, via FROM link_sources JOIN link_targets ON target_relation = relation_id AND target_value = value AND place = salt WHERE (relation_id = 'placed_by' OR source LIKE 'customer:1%') AND source <> target",
    "SELECT relation_id, source, target, via FROM gold_links WHERE relation_id = 'placed_by' OR source LIKE 'customer:1%'",
    shared=("sourced_ends",),
)
# the links of all pairs are as many as the square of a segment: each member is given once, and is linked, both ways, to the other `links` members of its segment
sql_query(
    "relation_symmetric",
    """SELECT m.value AS segment, m.entity_id AS member, n - 1 AS links FROM (SELECT DISTINCT value, entity_id FROM present WHERE property_id = 'segment') m
    JOIN (SELECT value AS hub, count(DISTINCT entity_id) AS n FROM present WHERE property_id = 'segment' GROUP BY value) g ON hub = m.value WHERE n > 1""",
)
sql_query(
    "links_verify",
    "SELECT relation_id, CAST(sum(domains * ranges) AS BIGINT) AS links, CAST(coalesce(sum(known_domains * known_ranges), 0) AS BIGINT) AS verified FROM verified_hubs WHERE domains > 0 AND ranges > 0 GROUP BY relation_id",
    "SELECT relation_id, count(*) AS links, count_if(s.entity_id IS NOT NULL AND t.entity_id IS NOT NULL) AS verified FROM gold_links LEFT JOIN entities s ON s.entity_id = source LEFT JOIN entities t ON t.entity_id = target GROUP BY relation_id",
    shared=("end_values",),
)
sql_query("links_dangling", "SELECT o_orderkey, o_custkey FROM orders LEFT JOIN (SELECT entity_id AS known FROM entities WHERE entity_class = 'customer') e ON known = 'customer:' || CAST(o_custkey + o_orderkey % 3 AS STRING) WHERE known IS NULL")
sql_query("rule_flags", "SELECT rule_id, entity_id, first_id, second_id FROM gold_flags")
sql_query(
    "signal_counts",
    "SELECT rule_id AS signal, n, entities FROM flag_counts UNION ALL SELECT relation_id, CAST(sum(domains * ranges) AS BIGINT), CAST(sum(domains) AS BIGINT) FROM link_hubs WHERE domains > 0 AND ranges > 0 GROUP BY relation_id",
    "SELECT rule_id AS signal, count(*) AS n, count(DISTINCT entity_id) AS entities FROM gold_flags GROUP BY rule_id UNION ALL SELECT relation_id, count(*), count(DISTINCT source) FROM gold_links GROUP BY relation_id",
    shared=(),
)
sql_query("date_before", "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE) AS before FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
sql_query("value_state", "SELECT entity_class, property_id, CASE WHEN status = 'gold' AND confidence < 0.5 THEN 'weak' ELSE status END AS state, count(*) AS n FROM fields GROUP BY 1, 2, 3")
sql_query("value_steps", "SELECT g.entity_id, g.property_id, g.value_id, step_id, run_id, phase FROM gold_fields g JOIN trace ON event_id = step WHERE g.property_id = 'priority'")
sql_query("untraceable_values", "SELECT g.entity_id, g.property_id, g.value_id FROM gold_fields g LEFT JOIN trace ON event_id = step WHERE g.entity_class = 'customer' AND event_id IS NULL")
sql_query("evidence_missing", "SELECT property_id, count(*) AS n FROM silver s LEFT JOIN (SELECT DISTINCT source_id AS known FROM trace) t ON known = source_id WHERE known IS NULL GROUP BY property_id")
sql_query("conflicts_table", "SELECT entity_class, property_id, count_if(status = 'conflict') AS conflict, count_if(status = 'gold') AS gold, count_if(sources > 1) AS multi_source, count_if(status = 'missing') AS missing FROM fields GROUP BY entity_class, property_id")
sql_query("completeness_heatmap", "SELECT entity_id, property_id, CASE status WHEN 'gold' THEN 'full' WHEN 'conflict' THEN 'conflict' ELSE 'empty' END AS state FROM fields WHERE dod AND entity_class = 'customer'")
sql_query("coverage_matrix", "SELECT source_id, property_id, n, CASE WHEN n * 4 > 3 * top THEN 3 WHEN n * 2 > top THEN 2 ELSE 1 END AS level FROM (SELECT source_id, property_id, n, max(n) OVER () AS top FROM (SELECT source_id, property_id, count(DISTINCT entity_id) AS n FROM silver GROUP BY source_id, property_id) c) m")
sql_query("entity_lookup", "SELECT q.c_custkey, CASE WHEN count(DISTINCT entity_id) = 1 THEN min(entity_id) WHEN count(DISTINCT entity_id) > 1 THEN 'CONFLICT' END AS found FROM customer q LEFT JOIN present ON property_id = 'name' AND lower(trim(value)) = lower(trim(c_name)) GROUP BY q.c_custkey")
sql_query("entity_list", "SELECT entity_id, entity_class, CASE WHEN min(CASE WHEN status = 'gold' THEN 1 ELSE 0 END) = 1 THEN 'complete' WHEN max(CASE WHEN status = 'gold' THEN 1 ELSE 0 END) = 1 THEN 'partial' ELSE 'none' END AS bucket FROM fields WHERE dod AND entity_class IN ('customer', 'supplier') AND has(entity_id, '1') GROUP BY entity_id, entity_class")
sql_query(
    "entity_page",
    "SELECT f.entity_id, f.property_id, f.status, f.value, f.value_id, coalesce(links, 0) AS links FROM page_fields f LEFT JOIN source_links ON source = f.entity_id",
    "SELECT f.entity_id, f.property_id, f.status, f.value, f.value_id, coalesce(l.links, 0) AS links FROM fields f LEFT JOIN (SELECT source, CAST(sum(links) AS BIGINT) AS links FROM link_counts GROUP BY source) l ON source = f.entity_id",
    shared=("end_values",),
)
sql_query("produced", "SELECT entity_class, count(DISTINCT entity_id) AS entities, count(*) AS gold_values, count(DISTINCT source_id) AS sources, count(DISTINCT source_type) AS source_classes FROM gold_fields WHERE status = 'gold' GROUP BY entity_class")
sql_query("receipts_topk", "SELECT property_id, entity_id, value_id FROM (SELECT property_id, entity_id, value_id, row_number() OVER (PARTITION BY property_id ORDER BY confidence DESC, sources DESC, entity_id) AS place FROM gold_fields) r WHERE place = 1")
