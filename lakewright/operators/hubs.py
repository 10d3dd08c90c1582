"""What holds by entity and by value, from one shuffle of the accepted observations, and links counted by value hub, without pairs.

Spark's side of queries whose SQL lists pairs or chooses values by windows.  An entity has one class, which its id begins with.  A field with a single value
is gold, so what is present needs no ranks.  All that hold one value of a relation's property are a hub; a relation links every member
of a hub's domain side to every member of its range side.  The two ends of a relation are of two classes, and the far ends of a class's properties are
of different classes (a test holds both), so no pair is there twice and none is of one entity.
"""

from lakewright.plans.dialect import relation

#: The properties that relations match by.
END_PROPERTIES = ("nation", "customer_ref", "customer_key")

relation("accepted", "SELECT entity_id, entity_class, property_id, value, source_id, source_type, rank, confidence, step FROM obs_reasons JOIN tiers ON tier = authority_tier WHERE reason IS NULL")
relation("ends", "SELECT relation_id, TRUE AS domain, domain_class AS class, domain_prop AS prop, range_class AS far_class, range_prop AS far_prop FROM relation_specs UNION ALL SELECT relation_id, FALSE, range_class, range_prop, domain_class, domain_prop FROM relation_specs")
relation("far_ends", "SELECT DISTINCT class AS near_class, prop AS near_prop, far_class, far_prop FROM ends")
# the present values by which entities are linked
relation(
    "end_values",
    f"""SELECT entity_id, entity_class, property_id, min(value) AS value FROM accepted JOIN declared ON class = entity_class AND prop = property_id
    WHERE property_id IN {END_PROPERTIES} GROUP BY entity_id, entity_class, property_id HAVING min(value) = max(value)""",
)
relation("faced", "SELECT entity_id, far_class, far_prop, value FROM end_values JOIN far_ends ON near_class = entity_class AND near_prop = property_id")
relation("degrees", "SELECT f.entity_id AS node, CAST(sum(held) AS BIGINT) AS degree FROM faced f JOIN (SELECT entity_class, property_id, value AS hub, count(*) AS held FROM end_values GROUP BY entity_class, property_id, value) h ON entity_class = far_class AND property_id = far_prop AND hub = f.value GROUP BY f.entity_id")
# by relation and value: members on either side, with the rows of `entities` that they join to (one if there is none), and those that are known there
relation("entity_rows", "SELECT entity_id AS known_id, size(collect_set(entity_class)) AS times FROM obs_reasons WHERE reason IS NULL GROUP BY entity_id")
relation(
    "verified_hubs",
    """SELECT relation_id, value, sum(CASE WHEN domain THEN coalesce(times, 1) ELSE 0 END) AS domains, sum(CASE WHEN domain THEN 0 ELSE coalesce(times, 1) END) AS ranges,
    sum(CASE WHEN domain THEN times END) AS known_domains, sum(CASE WHEN domain THEN NULL ELSE times END) AS known_ranges
    FROM end_values JOIN ends ON class = entity_class AND prop = property_id LEFT JOIN entity_rows ON known_id = entity_id GROUP BY relation_id, value""",
)
relation("link_hubs", "SELECT relation_id, value, count_if(domain) AS domains, count_if(NOT domain) AS ranges FROM end_values JOIN ends ON class = entity_class AND prop = property_id GROUP BY relation_id, value")
# by entity: how often each rule holds
relation(
    "flagged_values",
    """SELECT entity_id, entity_class, property_id, min(value) AS value FROM (
      SELECT entity_id, entity_class, property_id, value FROM accepted JOIN declared ON class = entity_class AND prop = property_id
      WHERE property_id IN ('ship_date', 'order_date', 'nation', 'customer_key', 'supplier_key') OR (entity_class = 'order' AND property_id = 'status') DISTRIBUTE BY entity_id
    ) a GROUP BY entity_id, entity_class, property_id HAVING min(value) = max(value)""",
)
relation(
    "flag_counts",
    """SELECT rule_id, CAST(sum(n) AS BIGINT) AS n, count(*) AS entities FROM (
      SELECT entity_id, stack(3, 'shipped_before_order', CASE WHEN CAST(shipped AS DATE) < CAST(ordered AS DATE) THEN 1 ELSE 0 END, 'urgent_open', open, 'same_value', same) AS (rule_id, n) FROM (
        SELECT entity_id, max(CASE WHEN property_id = 'ship_date' THEN value END) AS shipped, max(CASE WHEN property_id = 'order_date' THEN value END) AS ordered, CAST(count_if(entity_class = 'order' AND property_id = 'status' AND value = 'O') AS INT) AS open,
        CASE WHEN max(CASE WHEN property_id = 'customer_key' THEN value END) = max(CASE WHEN property_id = 'nation' THEN value END) THEN 1 ELSE 0 END
        + CASE WHEN max(CASE WHEN property_id = 'supplier_key' THEN value END) = max(CASE WHEN property_id = 'nation' THEN value END) THEN 1 ELSE 0 END AS same
        FROM flagged_values GROUP BY entity_id
      ) e
    ) f WHERE n > 0 GROUP BY rule_id""",
)
# links as pairs where pairs are asked for: hubs of many members are dealt to SALTS tasks; no pair is there twice, so nothing is made distinct
WIDE, SALTS = 1024, 16
_VALUE_ID = """'val:' || substr(sha('["' || entity_id || '","' || property_id || '","' || value || '","' || source_id || '"]'), 1, 24)"""
relation(
    "sourced_ends",
    f"""SELECT entity_id, entity_class, property_id, value, best.source_id AS source_id FROM (
      SELECT entity_id, entity_class, property_id, min(value) AS value, min(struct(-rank AS tier, -confidence AS sure, source_id AS source_id)) AS best FROM accepted JOIN declared ON class = entity_class AND prop = property_id
      WHERE property_id IN {END_PROPERTIES} GROUP BY entity_id, entity_class, property_id HAVING min(value) = max(value)) v""",
)
relation("wide_hubs", f"SELECT relation_id AS wide_relation, value AS wide_value FROM sourced_ends JOIN ends ON class = entity_class AND prop = property_id WHERE NOT domain GROUP BY relation_id, value HAVING count(*) > {WIDE}")
relation(
    "link_sources",
    f"""SELECT /*+ BROADCAST(wide_hubs) */ relation_id, entity_id AS source, value, {_VALUE_ID} AS via, CASE WHEN wide_value IS NULL THEN -1 ELSE pmod(hash(entity_id), {SALTS}) END AS salt
    FROM sourced_ends JOIN ends ON class = entity_class AND prop = property_id LEFT JOIN wide_hubs ON wide_relation = relation_id AND wide_value = value WHERE domain""",
)
relation(
    "link_targets",
    f"""SELECT /*+ BROADCAST(wide_hubs) */ relation_id AS target_relation, value AS target_value, entity_id AS target, explode(CASE WHEN wide_value IS NULL THEN array(-1) ELSE sequence(0, {SALTS - 1}) END) AS place
    FROM sourced_ends JOIN ends ON class = entity_class AND prop = property_id LEFT JOIN wide_hubs ON wide_relation = relation_id AND wide_value = value WHERE NOT domain""",
)
# what the criteria ask of an entity, in one row
relation(
    "entity_profile",
    """SELECT entity_id, entity_class, count_if(gold AND dod) AS filled, collect_set(CASE WHEN gold THEN best.source_type END) AS types, count_if(gold AND best.source_id IS NULL) AS unsourced, count_if(gold AND prop IN ('name', 'segment')) AS named,
    max(CASE WHEN gold AND prop = 'status' THEN value END) AS status, max(CASE WHEN gold AND prop = 'nation' THEN value END) AS nation, max(CASE WHEN gold AND prop = 'customer_ref' THEN value END) AS customer_ref, max(CASE WHEN gold AND prop = 'customer_key' THEN value END) AS customer_key
    FROM (
      SELECT entity_id, entity_class, property_id, min(value) AS value, min(value) = max(value) AS gold, min(struct(-rank AS tier, -confidence AS sure, source_id AS source_id, coalesce(step, -1) AS step, source_type AS source_type)) AS best
      FROM (SELECT entity_id, entity_class, property_id, value, rank, confidence, source_id, step, source_type FROM accepted DISTRIBUTE BY entity_id) a GROUP BY entity_id, entity_class, property_id
    ) v LEFT JOIN declared ON class = entity_class AND prop = property_id GROUP BY entity_id, entity_class""",
)
relation("profile_ratios", "SELECT entity_id, entity_class, nation, CAST(filled AS DOUBLE) / asked AS ratio FROM entity_profile JOIN (SELECT class, count_if(dod) AS asked FROM declared GROUP BY class) d ON class = entity_class WHERE asked > 0")
relation("supplier_nations", "SELECT DISTINCT nation AS held FROM entity_profile WHERE entity_class = 'supplier' AND nation IS NOT NULL")
relation("customer_keys", "SELECT DISTINCT customer_key AS held FROM entity_profile WHERE entity_class = 'customer' AND customer_key IS NOT NULL")
relation(
    "profile_counts",
    """SELECT c1, c2, c3, c4, c5, c6, c7, c8, CASE WHEN orders = 0 THEN 0.0 ELSE CAST(c8 AS DOUBLE) / orders END AS c9 FROM (
      SELECT count_if(entity_class = 'customer') AS c1, count_if(entity_class = 'order' AND status = 'F') AS c2, count_if(entity_class = 'customer' AND named = 2) AS c3, coalesce(sum(unsourced), 0) AS c5, count_if(entity_class = 'order') AS orders FROM entity_profile) a
    CROSS JOIN (SELECT count(DISTINCT type) AS c4 FROM (SELECT explode(types) AS type FROM entity_profile) t) b
    CROSS JOIN (SELECT count_if(ratio >= 0.8) AS c6 FROM profile_ratios WHERE entity_class = 'customer') c
    CROSS JOIN (SELECT coalesce(avg(CASE WHEN ratio >= 0.8 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 0.0) AS c7 FROM profile_ratios JOIN supplier_nations ON held = nation WHERE entity_class = 'customer') d
    CROSS JOIN (SELECT count(*) AS c8 FROM entity_profile JOIN customer_keys ON held = customer_ref WHERE entity_class = 'order') e""",
)
# every field's value by tier, sources, confidence and text, and the best observation of that value
relation(
    "chosen_values",
    """SELECT entity_id, entity_class, property_id, count(*) AS n_values, min(struct(-best_tier AS tier, -sources AS sources, -best_confidence AS sure, value AS value, best.source_id AS source_id)) AS g FROM (
      SELECT entity_id, entity_class, property_id, value, max(top) AS best_tier, count(*) AS sources, max(surest) AS best_confidence, min(struct(best.tier AS tier, best.sure AS sure, source_id AS source_id)) AS best FROM (
        SELECT entity_id, entity_class, property_id, value, source_id, max(rank) AS top, max(confidence) AS surest, min(struct(-rank AS tier, -confidence AS sure)) AS best
        FROM (SELECT entity_id, entity_class, property_id, value, source_id, rank, confidence FROM accepted DISTRIBUTE BY entity_id) a GROUP BY entity_id, entity_class, property_id, value, source_id
      ) s GROUP BY entity_id, entity_class, property_id, value
    ) v GROUP BY entity_id, entity_class, property_id""",
)
relation(
    "page_fields",
    f"""SELECT entity_id, property_id, CASE WHEN n_values IS NULL THEN 'missing' WHEN n_values = 1 THEN 'gold' ELSE 'conflict' END AS status, value, {_VALUE_ID} AS value_id FROM (
      SELECT entity_id, prop AS property_id, held[prop].n_values AS n_values, held[prop].value AS value, held[prop].source_id AS source_id FROM (
        SELECT entity_id, entity_class, map_from_entries(collect_list(struct(property_id, struct(n_values AS n_values, g.value AS value, g.source_id AS source_id)))) AS held FROM chosen_values GROUP BY entity_id, entity_class
      ) e JOIN declared ON class = entity_class
    ) f""",
)
relation(
    "source_links",
    """SELECT entity_id AS source, CAST(sum(ranges) AS BIGINT) AS links FROM end_values JOIN ends ON class = entity_class AND prop = property_id
    JOIN (SELECT entity_class AS hub_class, property_id AS hub_prop, value AS hub, count(*) AS ranges FROM end_values GROUP BY entity_class, property_id, value) h ON hub_class = far_class AND hub_prop = far_prop AND hub = value WHERE domain GROUP BY entity_id""",
)
