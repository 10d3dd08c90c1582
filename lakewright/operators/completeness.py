"""Completeness queries over gold entities (counts, shares, relations) and class metrics."""

from lakewright.plans.dialect import relation, sql_query

relation("class_sizes", "SELECT class, count(*) AS n FROM (SELECT DISTINCT class FROM declared) c JOIN entities ON entity_class = class GROUP BY class")
relation("completeness", "SELECT entity_id, entity_class, CAST(count_if(status = 'gold' AND value_id IS NOT NULL) AS DOUBLE) / count(*) AS ratio FROM fields WHERE dod GROUP BY entity_id, entity_class")
relation("dod_1", "SELECT CAST(count(*) AS DOUBLE) AS actual FROM entities WHERE entity_class = 'customer'")
relation("dod_2", "SELECT CAST(count(DISTINCT entity_id) AS DOUBLE) AS actual FROM present WHERE entity_class = 'order' AND property_id = 'status' AND value = 'F'")
relation("dod_3", "SELECT CAST(count(*) AS DOUBLE) AS actual FROM (SELECT entity_id FROM present WHERE entity_class = 'customer' AND property_id IN ('name', 'segment') GROUP BY entity_id HAVING count(DISTINCT property_id) = 2) x")
relation("dod_4", "SELECT CAST(count(DISTINCT source_type) AS DOUBLE) AS actual FROM gold_fields WHERE status = 'gold'")
relation("dod_5", "SELECT CAST(count_if(source_id IS NULL) AS DOUBLE) AS actual FROM gold_fields WHERE status = 'gold'")
relation("dod_6", "SELECT CAST(count_if(ratio >= 0.8) AS DOUBLE) AS actual FROM completeness WHERE entity_class = 'customer'")
relation("dod_7", "SELECT coalesce(avg(CASE WHEN ratio >= 0.8 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 0.0) AS actual FROM completeness JOIN (SELECT source FROM linked WHERE relation_id = 'same_nation') l ON source = entity_id WHERE entity_class = 'customer'")
relation("dod_8", "SELECT CAST(count(*) AS DOUBLE) AS actual FROM linked WHERE relation_id = 'placed_by'")
relation("dod_9", "SELECT CASE WHEN count(*) = 0 THEN 0.0 ELSE CAST(count(source) AS DOUBLE) / count(*) END AS actual FROM entities LEFT JOIN (SELECT source FROM linked WHERE relation_id = 'placed_by') l ON source = entity_id WHERE entity_class = 'order'")
CRITERIA = (
    ("c1", "count_entities customer", ">=", 100), ("c2", "count_entities order status eq F", ">=", 1), ("c3", "count_entities_with_properties customer name, segment", ">=", 100),
    ("c4", "count_distinct_source_classes", ">=", 3), ("c5", "count_values_without_evidence", "<=", 0), ("c6", "entities_meeting_completeness customer 0.8", ">=", 50),
    ("c7", "entities_meeting_completeness customer 0.8 share same_nation", ">=", 0.5), ("c8", "count_entities_with_relation placed_by", ">=", 1), ("c9", "count_entities_with_relation placed_by share", ">=", 0.9),
)
relation(
    "dod_results",
    " UNION ALL ".join(
        f"SELECT '{c}' AS criterion_id, '{what}' AS query, '{op}' AS operator, CAST({target} AS DOUBLE) AS target, CAST(actual AS DOUBLE) AS actual FROM dod_{c[1:]}"
        for c, what, op, target in CRITERIA
    ),
)
_COMPARED = "SELECT r.*, CASE operator WHEN '>=' THEN actual >= target WHEN '<=' THEN actual <= target WHEN '>' THEN actual > target WHEN '<' THEN actual < target WHEN '!=' THEN actual <> target ELSE actual = target END AS met FROM {} r"
relation("dod_compared", _COMPARED.format("dod_results"))
# the same from one row an entity, which is written once, as is the row of all counts
relation("profile_results", " UNION ALL ".join(f"SELECT '{c}' AS criterion_id, '{what}' AS query, '{op}' AS operator, CAST({target} AS DOUBLE) AS target, CAST({c} AS DOUBLE) AS actual FROM profile_counts" for c, what, op, target in CRITERIA))
relation("profile_compared", _COMPARED.format("profile_results"))
_PROFILE = ("entity_profile", "profile_counts")

for number, name in enumerate(("count_entities", "conditions_filter", "with_properties", "source_classes", "no_evidence", "completeness_count", "completeness_share", "relation_count", "relation_share"), 1):
    sql_query(name if name == "conditions_filter" else f"dod_{name}", f"SELECT round(actual, 6) AS actual FROM dod_{number}")
sql_query("dod_report", "SELECT criterion_id, query, operator, target, round(actual, 6) AS actual, met FROM dod_compared UNION ALL SELECT 'c10', 'unresolved', '>=', CAST(1 AS DOUBLE), CAST(NULL AS DOUBLE), FALSE", shared=("gold_fields", "entities", "linked"))
sql_query(
    "dod_compare",
    "SELECT operator, count(*) AS n, count_if(met) AS met FROM profile_compared GROUP BY operator",
    "SELECT operator, count(*) AS n, count_if(met) AS met FROM dod_compared GROUP BY operator",
    shared=_PROFILE,
)
sql_query(
    "dod_coverage",
    "SELECT coalesce(p.criterion_id, d.criterion_id) AS criterion_id, p.criterion_id IS NOT NULL AS asked, d.criterion_id IS NOT NULL AS compiled FROM (SELECT criterion_id FROM profile_results WHERE criterion_id <> 'c4' UNION ALL SELECT 'c11') p FULL JOIN profile_results d ON p.criterion_id = d.criterion_id",
    "SELECT coalesce(p.criterion_id, d.criterion_id) AS criterion_id, p.criterion_id IS NOT NULL AS asked, d.criterion_id IS NOT NULL AS compiled FROM (SELECT criterion_id FROM dod_results WHERE criterion_id <> 'c4' UNION ALL SELECT 'c11') p FULL JOIN dod_results d ON p.criterion_id = d.criterion_id",
    shared=_PROFILE,
)
sql_query(
    "dod_gaps",
    "SELECT criterion_id, round(target - actual, 6) AS gap, 1 AS iteration FROM profile_compared WHERE NOT met",
    "SELECT criterion_id, round(target - actual, 6) AS gap, 1 AS iteration FROM dod_compared WHERE NOT met",
    shared=_PROFILE,
)
sql_query("m_entities_total", "SELECT c.class, coalesce(n, 0) AS entities FROM (SELECT DISTINCT class FROM declared UNION SELECT 'region') c LEFT JOIN class_sizes s ON s.class = c.class")
sql_query("m_entities_meeting_dod", "SELECT entity_class, count_if(ratio >= 0.8) AS meeting, count(*) AS entities FROM completeness GROUP BY entity_class")
sql_query("m_property_completeness", "SELECT entity_class, property_id, round(avg(CASE WHEN status = 'gold' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS share FROM fields GROUP BY entity_class, property_id")
sql_query("m_source_classes", "SELECT entity_class, count(DISTINCT source_type) AS source_classes FROM gold_fields WHERE status = 'gold' GROUP BY entity_class")
sql_query("m_no_evidence", "SELECT entity_class, count_if(step IS NULL) AS without_step, count_if(source_id IS NULL) AS without_source FROM gold_fields WHERE status = 'gold' GROUP BY entity_class")
sql_query("m_taxonomy_coverage", "SELECT r_name AS region, count(DISTINCT n_nationkey) AS nations, count(DISTINCT c_nationkey) AS covered, round(CAST(count(DISTINCT c_nationkey) AS DOUBLE) / count(DISTINCT n_nationkey), 6) AS share FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT DISTINCT c_nationkey FROM customer) c ON c_nationkey = n_nationkey GROUP BY r_name")
sql_query("taxonomy_levels", "SELECT 1 AS level, 'region:' || CAST(r_regionkey AS STRING) AS node, r_name AS label FROM region UNION ALL SELECT 2, 'region:' || CAST(n_regionkey AS STRING) || '/' || CAST(n_nationkey AS STRING), n_name FROM nation")
sql_query("taxonomy_stats", "SELECT level, parent, count(*) AS nodes FROM (SELECT 1 AS level, 'root' AS parent FROM region UNION ALL SELECT 2, 'region:' || CAST(n_regionkey AS STRING) FROM nation) t GROUP BY GROUPING SETS ((level), (level, parent))")
sql_query("ontology_gaps", "SELECT entity_id, names_of(property_id) AS missing FROM fields WHERE dod AND status = 'missing' AND entity_class = 'customer' GROUP BY entity_id")
sql_query("metrics_cross_check", "SELECT a.entity_class, round(a.share, 6) AS engine, round(b.share, 6) AS console, abs(a.share - b.share) < 0.000001 AS agree FROM (SELECT entity_class, avg(ratio) AS share FROM completeness GROUP BY entity_class) a JOIN (SELECT entity_class, CAST(count_if(status = 'gold' AND value_id IS NOT NULL) AS DOUBLE) / count(*) AS share FROM fields WHERE dod GROUP BY entity_class) b ON a.entity_class = b.entity_class")
sql_query("high_stakes", "SELECT DISTINCT prop AS property_id FROM declared WHERE prop IN ('status') OR (dod AND prop LIKE 'is_%')")
sql_query("target_set_algebra", "SELECT prop, count_if(side = 'allowed') > 0 AS allowed, count_if(side = 'seen') > 0 AS seen FROM (SELECT prop, 'allowed' AS side FROM declared WHERE dod UNION ALL SELECT property_id, 'seen' FROM gold_fields) t GROUP BY prop")
sql_query("hint_coverage", "SELECT class, count(*) AS target, count(hinted) AS covered, names_of(CASE WHEN hinted IS NULL THEN prop END) AS uncovered FROM declared LEFT JOIN (SELECT DISTINCT property_id AS hinted, entity_class AS ec FROM silver WHERE source_id = 'src1') h ON hinted = prop AND ec = class GROUP BY class")
sql_query("set_equality", "SELECT (SELECT count(*) FROM (SELECT prop FROM declared EXCEPT SELECT property_id FROM silver) x) AS unseen, (SELECT count(*) FROM (SELECT property_id FROM silver EXCEPT SELECT prop FROM declared) y) AS undeclared")
sql_query("run_diff_added", "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 1 EXCEPT SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0")
sql_query("run_diff_removed", "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0 EXCEPT SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 1")
sql_query("run_diff_changed", "SELECT coalesce(a.k, b.k) AS o_orderkey, a.s AS before, b.s AS after FROM (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 10 <> 0) a FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 37 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 10 <> 1) b ON a.k = b.k WHERE a.s IS DISTINCT FROM b.s")
sql_query("run_metric_delta", "SELECT metric, a, b, b - a AS delta FROM (SELECT 'orders' AS metric, count_if(o_orderkey % 10 <> 0) AS a, count_if(o_orderkey % 10 <> 1) AS b FROM orders UNION ALL SELECT 'finished', count_if(o_orderkey % 10 <> 0 AND o_orderstatus = 'F'), count_if(o_orderkey % 10 <> 1 AND o_orderstatus = 'F' AND o_orderkey % 37 <> 0) FROM orders) m")
sql_query("multiset_score", "SELECT CAST(sum(least(a, b)) AS BIGINT) AS both_sides, CAST(sum(a) AS BIGINT) AS expected, CAST(sum(b) AS BIGINT) AS extracted, round(CAST(sum(least(a, b)) AS DOUBLE) / sum(b), 6) AS precision_share, round(CAST(sum(least(a, b)) AS DOUBLE) / sum(a), 6) AS coverage FROM (SELECT o_orderpriority || o_orderstatus AS k, count_if(o_orderkey % 10 <> 0) AS a, count_if(o_orderkey % 10 <> 1) AS b FROM orders GROUP BY 1) c")
