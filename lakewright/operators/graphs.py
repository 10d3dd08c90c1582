"""Entity, lineage and site graphs: edges, neighbourhoods, clusters, ancestors, crawl frontiers."""

from lakewright.plans.dialect import relation, sql_query

relation("edges_all", "SELECT relation_id, least(source, target) AS a, greatest(source, target) AS b, count(*) AS n FROM gold_links WHERE source <> target GROUP BY relation_id, least(source, target), greatest(source, target)")
relation("neighbours", "SELECT a AS x, b AS y FROM edges_all UNION SELECT b, a FROM edges_all")

# one hop leads from entities to the values they are linked by, and on to all that hold these at the far end
relation("first_hubs", "SELECT DISTINCT far_class, far_prop, value AS hub FROM faced WHERE entity_id = 'customer:1'")
relation("first_stop", "SELECT entity_id FROM end_values JOIN first_hubs ON entity_class = far_class AND property_id = far_prop AND value = hub")
relation("second_hubs", "SELECT DISTINCT far_class, far_prop, value AS hub FROM faced JOIN (SELECT entity_id AS stop FROM first_stop) s ON stop = entity_id")
relation("second_stop", "SELECT entity_id FROM end_values JOIN second_hubs ON entity_class = far_class AND property_id = far_prop AND value = hub")

sql_query("graph_edges", "SELECT relation_id, a, b, n FROM edges_all WHERE relation_id = 'placed_by'")
sql_query(
    "graph_degree",
    "SELECT node, degree FROM degrees",
    "SELECT x AS node, count(*) AS degree FROM neighbours GROUP BY x",
    shared=("end_values",),
)
sql_query(
    "graph_bfs",
    "SELECT node, min(d) AS distance FROM (SELECT 'customer:1' AS node, 0 AS d UNION ALL SELECT entity_id, 1 FROM first_stop UNION ALL SELECT entity_id, 2 FROM second_stop) r GROUP BY node",
    "SELECT node, min(d) AS distance FROM (SELECT 'customer:1' AS node, 0 AS d UNION ALL SELECT y, 1 FROM neighbours WHERE x = 'customer:1' UNION ALL SELECT q.y, 2 FROM neighbours p JOIN neighbours q ON q.x = p.y WHERE p.x = 'customer:1') r GROUP BY node",
    shared=("end_values",),
)
sql_query(
    "graph_context",
    """SELECT DISTINCT entity_id AS node FROM end_values JOIN (SELECT DISTINCT far_class, far_prop, value AS hub FROM faced WHERE entity_id LIKE 'customer:1%') h
    ON entity_class = far_class AND property_id = far_prop AND hub = value WHERE entity_id NOT LIKE 'customer:1%'""",
    "SELECT DISTINCT y AS node FROM neighbours WHERE x LIKE 'customer:1%' AND y NOT LIKE 'customer:1%'",
    shared=("end_values",),
)
sql_query(
    "graph_node_cap",
    "SELECT node, row_number() OVER (ORDER BY degree DESC, node) AS place FROM (SELECT node, degree FROM degrees ORDER BY degree DESC, node LIMIT 40) g",
    "SELECT node, place FROM (SELECT node, row_number() OVER (ORDER BY degree DESC, node) AS place FROM (SELECT x AS node, count(*) AS degree FROM neighbours GROUP BY x) g) r WHERE place <= 40",
    shared=("end_values",),
)
# a hub of a relation: all entities that hold one of its values; drawn only where it replaces more lines than it draws
sql_query(
    "value_clusters",
    """SELECT relation_id, hub, domains + ranges AS members, domains * ranges AS edges FROM (
      SELECT relation_id, lower(trim(value)) AS hub, count(DISTINCT CASE WHEN entity_class = domain_class AND property_id = domain_prop THEN entity_id END) AS domains,
      count(DISTINCT CASE WHEN entity_class = range_class AND property_id = range_prop THEN entity_id END) AS ranges
      FROM present JOIN relation_specs ON (entity_class = domain_class AND property_id = domain_prop) OR (entity_class = range_class AND property_id = range_prop) GROUP BY relation_id, lower(trim(value))
    ) h WHERE domains + ranges >= 3 AND domains * ranges > domains + ranges""",
    """WITH RECURSIVE e AS (SELECT DISTINCT relation_id, lower(trim(d.value)) AS hub, d.entity_id AS a, r.entity_id AS b FROM relation_specs JOIN present d ON d.entity_class = domain_class AND d.property_id = domain_prop
      JOIN present r ON r.entity_class = range_class AND r.property_id = range_prop AND lower(trim(r.value)) = lower(trim(d.value))),
    m AS (SELECT relation_id, hub, a AS x FROM e UNION SELECT relation_id, hub, b FROM e)
    SELECT e.relation_id, e.hub, members, edges FROM (SELECT relation_id, hub, count(*) AS edges FROM e GROUP BY ALL) e JOIN (SELECT relation_id, hub, count(*) AS members FROM m GROUP BY ALL) m ON m.relation_id = e.relation_id AND m.hub = e.hub
    WHERE members >= 3 AND edges > members""",
)
relation("site_pages", "SELECT page_id, host, template, skeleton FROM page_types")
sql_query("site_types", "SELECT template, skeleton, count(*) AS pages, count(DISTINCT host) AS hosts, min(page_id) AS sample FROM site_pages GROUP BY template, skeleton")
sql_query("site_type_edges", "SELECT t.template AS from_type, e.followed, e.reason, count(*) AS n FROM link_edges e JOIN site_pages t ON t.page_id = e.page_id GROUP BY t.template, e.followed, e.reason")
sql_query("site_edges", "SELECT e.page_id, count(*) AS links, count(p.host) AS known FROM link_edges e LEFT JOIN (SELECT DISTINCT host FROM page_rows) p ON 'http://' || p.host = substr(e.to_url, 1, length(p.host) + 7) AND p.host = e.from_host GROUP BY e.page_id")
sql_query("unfetched_reasons", "SELECT reason, count(*) AS n, min(to_url) AS first_url FROM link_edges WHERE NOT followed GROUP BY reason")
sql_query("link_policy", "SELECT CASE WHEN begins(href, '#') THEN 'fragment' WHEN matches(href, '^(mailto|javascript|tel):') THEN 'scheme' WHEN matches(lower(href), '[.](css|js|png|jpg|gif|svg)$') THEN 'asset' ELSE 'follow' END AS decision, count(*) AS n FROM hrefs GROUP BY 1")
sql_query("pages_collect", "SELECT host, page_id, template, place FROM (SELECT t.*, row_number() OVER (PARTITION BY host ORDER BY length(path), page_id) AS place FROM page_types t) r WHERE place <= 5")
