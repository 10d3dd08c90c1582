"""Discovery: leads, ranking, authority, urls; greedy choices as window plans."""

from lakewright.plans.dialect import relation, sql_query

relation("lead_merged", "SELECT url, min(host) AS host, count(DISTINCT provider) AS providers, names_of(provider) AS provider_names, names_of(property_id) AS properties, max(score) AS score FROM leads GROUP BY url")
relation("host_tiers", "SELECT DISTINCT host, domain, tier FROM (SELECT DISTINCT host FROM page_rows) h JOIN publishers ON host = domain OR finishes(host, '.' || domain)")
relation("authority", "SELECT h.host, CASE min(CASE tier WHEN 'review' THEN 0 WHEN 'low' THEN 1 WHEN 'secondary' THEN 2 WHEN 'primary' THEN 3 END) WHEN 0 THEN 'review' WHEN 1 THEN 'low' WHEN 2 THEN 'secondary' WHEN 3 THEN 'primary' ELSE 'unknown' END AS tier FROM (SELECT DISTINCT host FROM page_rows) h LEFT JOIN host_tiers t ON t.host = h.host GROUP BY h.host")
relation("lead_scores", "SELECT m.*, CASE WHEN a.tier = 'primary' THEN 100 WHEN a.tier = 'review' THEN 40 ELSE 0 END + 10 * (providers - 1) + 5 * score AS rank_score FROM lead_merged m JOIN authority a ON a.host = m.host")

sql_query("lead_merge", "SELECT url, providers, provider_names, properties, score FROM lead_merged")
sql_query("fair_topk", "SELECT url, host, turn FROM (SELECT url, host, turn, row_number() OVER (ORDER BY turn, rank_score DESC, url) AS place FROM (SELECT url, host, rank_score, row_number() OVER (PARTITION BY host ORDER BY rank_score DESC, url) AS turn FROM lead_scores) p WHERE turn <= 2) q WHERE place <= 30")
sql_query("authority_tier", "SELECT host, tier FROM authority")
sql_query("authority_matrix", "SELECT r_name AS class, n_name AS level, min(CASE WHEN n_nationkey % 3 = 0 THEN 'primary' WHEN n_nationkey % 3 = 1 THEN 'secondary' ELSE 'review' END) AS tier FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name")
sql_query("domain_allow", "SELECT h.host, count(domain) > 0 AS allowed FROM (SELECT DISTINCT host FROM page_rows) h LEFT JOIN publishers ON tier <> 'low' AND (h.host = domain OR finishes(h.host, '.' || domain)) GROUP BY h.host")
sql_query("public_url", "SELECT page_id, matches(url, '^https?://[^/@]*[.][^/@]*(/|$|[?#])') AND NOT matches(url, '^https?://(localhost|127[.]|10[.])') AS public FROM pages")
sql_query("static_asset", "SELECT href, CASE WHEN matches(lower(href), '[.](css|js|png|jpe?g|gif|svg|ico|woff2?)([?#]|$)') THEN 'suffix' WHEN matches(lower(href), '/(static|assets|images)/') THEN 'segment' ELSE 'keep' END AS reason, count(*) AS n FROM hrefs GROUP BY href")
sql_query("portal_cue", "SELECT page_id, has(lower(url), 'data') OR has(lower(html), 'open data') OR has(lower(html), 'licens') AS cue FROM pages")
sql_query("discovery_funnel", "SELECT provider, count(*) AS leads, count_if(page_id % 2 = 0) AS captured, count_if(page_id % 4 = 0) AS accepted, round(CAST(100 AS DOUBLE) * count_if(page_id % 4 = 0) / count(*), 6) AS percent FROM leads GROUP BY provider")
sql_query("coverage_gaps", "SELECT property_id, count(DISTINCT host) AS hosts, greatest(CAST(40 AS BIGINT) - count(DISTINCT host), 0) AS gap FROM leads WHERE score >= 0.5 GROUP BY property_id")
sql_query("search_relevance", "SELECT page_id, 3 * CASE WHEN has(lower(path), 'en') THEN 1 ELSE 0 END + CASE WHEN has(lower(html), 'the') THEN 1 ELSE 0 END + CASE WHEN begins(host, 'www') THEN 100 ELSE 0 END AS relevance FROM page_rows")
sql_query("objective_priority", "SELECT host, row_number() OVER (ORDER BY CASE WHEN tier = 'primary' THEN 0 ELSE 1 END, round(CAST(hinted AS DOUBLE) / 4, 3) DESC, host) AS place FROM (SELECT a.host, a.tier, count(DISTINCT property_id) AS hinted FROM authority a JOIN leads l ON l.host = a.host GROUP BY a.host, a.tier) o")
sql_query("ckan_score", "SELECT page_id, greatest(0.0, least(8.0, CASE WHEN finishes(path, '.html') THEN 0.0 ELSE 1.5 END + CASE WHEN length(html) > 3000 THEN 2.25 ELSE 1.25 END - CASE WHEN has(path, 'aggregate') THEN 4 ELSE 0 END)) AS score FROM page_rows")
sql_query("url_dedup", "SELECT lower(regexp_extract(url, '^([^?#]*)', 1)) AS identity, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1")
sql_query("needs_spider", "SELECT DISTINCT l.host FROM leads l LEFT JOIN (SELECT DISTINCT host AS done FROM leads WHERE score >= 0.8) d ON done = l.host WHERE done IS NULL")
sql_query("query_rotation", "SELECT page_id, page_id % 3 AS variant, CASE page_id % 3 WHEN 0 THEN host WHEN 1 THEN host || ' data' ELSE 'list ' || host END AS query FROM page_rows")
sql_query("capability_verdicts", "SELECT template, CASE WHEN has(template, '{id}') THEN 'detail' WHEN count(*) > 5 THEN 'listing' ELSE 'unknown' END AS verdict, count(*) AS n FROM page_types GROUP BY template")
sql_query("portal_children", "SELECT host, url, place FROM (SELECT host, url, row_number() OVER (PARTITION BY host ORDER BY score DESC, url) AS place FROM lead_merged WHERE score > 0.3) r WHERE place <= 3")
sql_query("url_template", "SELECT page_id, template FROM page_types")
sql_query("url_canonical", "SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) || regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^#]*)', 1) AS canonical FROM pages")
sql_query("registrable_domain", "SELECT host, part(host, '.', -2) || '.' || part(host, '.', -1) AS domain, count(*) AS pages FROM page_rows GROUP BY host")
sql_query("dataset_suffix", "SELECT page_id, regexp_extract(lower(path), '[.]([a-z0-9]{1,5})$', 1) AS suffix FROM page_rows")
sql_query("fuzzy_tokens", "SELECT a.n_name AS a, b.n_name AS b, lev(a.n_name, b.n_name) AS distance FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey WHERE substr(a.n_name, 1, 5) = substr(b.n_name, 1, 5) OR (length(a.n_name) >= 4 AND lev(a.n_name, b.n_name) <= 2)")
