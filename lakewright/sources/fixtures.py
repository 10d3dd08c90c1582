"""Evidence relations over the driver tables: observations, traces, calls, jobs, pages, leads.

All derivations use integer and string arithmetic, so any engine derives the same rows.
"""

from lakewright.plans.dialect import relation

relation("event_count", "SELECT count(*) AS n FROM events")
relation("customer_properties", "SELECT 'customer_key' AS property_id UNION ALL SELECT 'name' UNION ALL SELECT 'segment' UNION ALL SELECT 'nation'")
relation("supplier_properties", "SELECT 'supplier_key' AS property_id UNION ALL SELECT 'name' UNION ALL SELECT 'nation'")
relation("claim_properties", "SELECT 'priority' AS property_id UNION ALL SELECT 'status'")
relation("order_properties", "SELECT 'order_key' AS property_id UNION ALL SELECT 'customer_ref' UNION ALL SELECT 'order_date' UNION ALL SELECT 'ship_date' UNION ALL SELECT 'status'")
relation("ship_dates", "SELECT l_orderkey, day_of(min(l_shipdate)) AS ship_date FROM lineitem GROUP BY l_orderkey")

relation(
    "obs_master",
    """SELECT 'customer:' || CAST(c_custkey AS STRING) AS entity_id, 'customer' AS entity_class, property_id,
    CASE property_id WHEN 'customer_key' THEN CAST(c_custkey AS STRING) WHEN 'name' THEN c_name WHEN 'segment' THEN c_mktsegment ELSE CAST(c_nationkey AS STRING) END AS value,
    'src_master' AS source_id, 'type_master' AS source_type, 'primary' AS authority_tier, CAST(NULL AS STRING) AS publisher_id, 0.9 AS confidence, CAST(NULL AS BIGINT) AS step
    FROM customer CROSS JOIN customer_properties WHERE NOT (property_id = 'segment' AND c_custkey % 7 = 0)
    UNION ALL
    SELECT 'supplier:' || CAST(s_suppkey AS STRING), 'supplier', property_id,
    CASE property_id WHEN 'supplier_key' THEN CAST(s_suppkey AS STRING) WHEN 'name' THEN s_name ELSE CAST(s_nationkey AS STRING) END,
    'src_master', 'type_master', 'primary', CAST(NULL AS STRING), 0.9, CAST(NULL AS BIGINT)
    FROM supplier CROSS JOIN supplier_properties""",
)
relation(
    "obs_orders",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 101 = 0 THEN 'bad:' ELSE 'customer:' END || CAST(o_custkey AS STRING) AS entity_id, 'customer' AS entity_class, property_id,
    CASE property_id WHEN 'priority' THEN o_orderpriority ELSE o_orderstatus END AS value
    FROM orders CROSS JOIN claim_properties WHERE o_orderkey % 11 = 0
    UNION ALL
    SELECT o_orderkey, CASE WHEN o_orderkey % 101 = 0 THEN 'bad:' ELSE 'order:' END || CAST(o_orderkey AS STRING), 'order', property_id,
    CASE property_id WHEN 'order_key' THEN CAST(o_orderkey AS STRING) WHEN 'customer_ref' THEN CAST(o_custkey AS STRING) WHEN 'order_date' THEN day_of(o_orderdate) WHEN 'ship_date' THEN ship_date ELSE o_orderstatus END
    FROM orders LEFT JOIN ship_dates ON l_orderkey = o_orderkey CROSS JOIN order_properties WHERE property_id <> 'ship_date' OR ship_date IS NOT NULL""",
)
relation(
    "obs",
    """SELECT 'run-0' AS run_id, entity_id, entity_class, property_id, value, source_id, source_type, authority_tier, publisher_id, confidence, step,
    'val:' || substr(sha('["' || entity_id || '","' || property_id || '","' || value || '","' || source_id || '"]'), 1, 24) AS value_id
    FROM (
      SELECT entity_id, entity_class, property_id, value, source_id, source_type, authority_tier, publisher_id, CAST(confidence AS DOUBLE) AS confidence, step FROM obs_master
      UNION ALL
      SELECT entity_id, entity_class, property_id, value, 'src' || CAST(o_orderkey % 5 AS STRING), 'type' || CAST(o_orderkey % 3 AS STRING),
      CASE o_orderkey % 5 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' WHEN 2 THEN 'low' WHEN 3 THEN 'review' ELSE 'unknown' END,
      CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'name:pub' || CAST(o_orderkey % 4 AS STRING) END,
      CASE WHEN o_orderkey % 97 = 0 THEN 1.5 ELSE CAST((o_orderkey % 10) + 1 AS DOUBLE) / 10 END, o_orderkey % n
      FROM obs_orders CROSS JOIN event_count
    ) x""",
)
relation(
    "trace",
    """SELECT event_id, 'step:' || CAST(event_id AS STRING) AS step_id, 'run-' || CAST(user_id % 4 AS STRING) AS run_id, 's' || CAST(user_id AS STRING) AS session_id, user_id, 1 + event_id % 5 AS phase,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'src' || CAST(user_id % 5 AS STRING) END AS source_id,
    CASE event_type WHEN 'view' THEN 'D0' WHEN 'click' THEN 'D1' WHEN 'purchase' THEN 'S1' WHEN 'signup' THEN 'S2' END AS mode,
    CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'hard_stop' WHEN event_type = 'error' AND event_id % 3 = 1 THEN 'limit_kill' WHEN event_type = 'error' THEN 'failure' WHEN event_type = 'signup' AND event_id % 4 = 0 THEN 'loop' END AS event,
    lag(event_id) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS parent_id,
    event_type IN ('purchase', 'signup') AS priced, key_of(props) * 10 AS input_tokens, key_of(props) AS output_tokens,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(value / 10000 AS DECIMAL(12, 6)) END AS est_usd, 'm' || CAST(event_id % 3 AS STRING) AS model, ts, micros(ts) AS us, event_type, value
    FROM events""",
)
relation(
    "calls",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 'step:x' || CAST(event_id AS STRING) ELSE 'step:' || CAST(event_id AS STRING) END AS step_id,
    CASE WHEN event_id % 3 = 0 THEN 'run-' || CAST(user_id % 4 AS STRING) END AS run_id, CASE WHEN event_id % 17 = 0 THEN 'other' ELSE 's' || CAST(user_id AS STRING) END AS session_id,
    CASE WHEN event_id % 4 = 0 THEN 'aux' ELSE 'primary' END AS upstream, CASE event_id % 3 WHEN 0 THEN 'decide' WHEN 1 THEN 'screen' ELSE 'extract' END AS purpose, 'm' || CAST(event_id % 3 AS STRING) AS model,
    CASE WHEN event_id % 19 = 0 THEN 500 ELSE 200 END AS status, key_of(props) * 7 + 5 AS latency_ms, key_of(props) * 10 AS input_tokens, key_of(props) AS output_tokens, CAST(value / 10000 AS DECIMAL(12, 6)) AS est_usd, micros(ts) AS us, ts
    FROM events WHERE event_type IN ('purchase', 'signup', 'view')""",
)
relation(
    "jobs",
    """SELECT event_id, 'job' || CAST(idiv(event_id, 2) AS STRING) AS job_id, 'step:' || CAST(event_id AS STRING) AS step_id, 'src' || CAST(user_id % 5 AS STRING) AS source_id,
    CASE event_id % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'memory' WHEN 2 THEN 'pids' END AS failure_reason, ts, micros(ts) AS us,
    event_id % 2 AS created, idiv(event_id, 2) % 2 AS sealed, idiv(event_id, 4) % 2 AS ran, idiv(event_id, 8) % 2 AS collected
    FROM events WHERE event_type = 'error'""",
)
relation(
    "page_rows",
    """SELECT page_id, url, html, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
    'sha256:' || sha(html) AS bronze_key, sha(join_list(regex_all(html, '<([a-z][a-z0-9]*)', 1), ' ')) AS skeleton FROM pages""",
)
relation("page_types", "SELECT page_id, host, path, skeleton, replace_all(replace_all(path, '[0-9]+', '{id}'), '/$', '') AS template FROM page_rows")
relation("hrefs", """SELECT page_id, host, each_of(regex_all(html, 'href="([^"]*)"', 1)) AS href FROM page_rows""")
relation("link_edges", "SELECT page_id, host AS from_host, 'http://' || host || href AS to_url, page_id % 2 = 0 AS followed, CASE page_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'depth' ELSE 'robots' END AS reason, href FROM hrefs")
relation("publishers", "SELECT 'example.com' AS domain, 'primary' AS tier UNION ALL SELECT 'example.org', 'secondary' UNION ALL SELECT 'example.net', 'review' UNION ALL SELECT 'spam-farm.example.org', 'low'")
relation(
    "leads",
    """SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS url, host, CASE page_id % 3 WHEN 0 THEN 'ckan' WHEN 1 THEN 'web' ELSE 'model' END AS provider,
    CAST(page_id % 10 AS DOUBLE) / 10 AS score, 'p' || CAST(page_id % 4 AS STRING) AS property_id FROM page_rows""",
)
relation("tiers", "SELECT 'primary' AS tier, 4 AS rank UNION ALL SELECT 'secondary', 3 UNION ALL SELECT 'low', 2 UNION ALL SELECT 'review', 1 UNION ALL SELECT 'unknown', 0")
relation("prices", "SELECT 'm0' AS model, 3 AS usd_in, 15 AS usd_out UNION ALL SELECT 'm1', 1, 5 UNION ALL SELECT 'm2', 0, 0")
