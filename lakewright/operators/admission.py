"""Admission of typed observations: every check in its order, the first that fails names the reason.

`claims` are observations whose value is the text of a JSON scalar, so that its type is kept; `ontology` lists the properties of each class with
their datatypes; `claim_run` names the run's backend.  Callers give frames of their own under these names.
"""

from lakewright.plans.dialect import relation, sql_query

relation("ontology", " UNION ALL ".join(f"SELECT 'order' AS class, '{p}' AS property, '{t}' AS datatype" for p, t in (
    ("name", "xsd:string"), ("flag", "http://www.w3.org/2001/XMLSchema#boolean"), ("count", "Integer"), ("size", "xsd:nonNegativeInteger"), ("price", "decimal"), ("day", "date"), ("at", "xsd:dateTime"), ("home", "anyURI"), ("tint", "xsd:color"),
)) + " UNION ALL SELECT 'customer', 'nick', 'string'")
relation("claim_run", "SELECT 'live' AS run_backend")

#: Variant of the fixture -> (property, JSON value, what becomes of it).
VARIANTS = (
    ("name", '"x"', None), ("name", "5", "string"), ("flag", "true", None), ("flag", '"true"', "boolean"), ("count", "12", None), ("count", "1.5", "integer"), ("count", "true", "integer"), ("size", "0", None),
    ("size", "-3", "negative"), ("price", "1.25", None), ("price", '"1.25"', "number"), ("day", '"2024-02-29"', None), ("day", '"2023-02-29"', "date"), ("day", '"2024-2-9"', "date"), ("at", '"2024-01-02T03:04:05+00:00"', None),
    ("at", '"2024-01-02T03:04:05"', "timezone"), ("at", '"noon"', "timestamp"), ("home", '"https://a.x/b"', None), ("home", '"a/b"', "uri"), ("tint", '"red"', "datatype"), ("name", "null", "scalar"), ("name", "[1]", "scalar"),
    ("name", '"x"', "class"), ("name", '"x"', "entity id"), ("nick", '"x"', "property"), ("name", '"x"', "confidence"), ("name", '"x"', "confidence"), ("name", '"x"', "tier"), ("name", '"x"', "publisher"), ("name", '"x"', "value id"), ("name", '"x"', "evidence"), ("name", '"x"', "backend"),
    ("at", '"2024-01-02T99:99:99+00:00"', "timestamp"), ("at", '"2024-01-02T23:59:59+24:00"', "timestamp"), ("at", '"2024-01-02T23:59:59.5-23:59"', None), ("price", "1e400", "number"), ("price", "1e308", None),
)
_CASE = lambda i: "CASE v " + " ".join(f"WHEN {k} THEN {_text(x[i])}" for k, x in enumerate(VARIANTS)) + " END"


def _text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x + "'"


relation(
    "claims",
    f"""SELECT n, CASE WHEN v = 31 THEN 'replay' ELSE 'live' END AS backend, CASE WHEN v = 22 THEN 'planet' ELSE 'order' END AS entity_class, entity_id, property_id, value, CASE v WHEN 25 THEN CAST(1.5 AS DOUBLE) WHEN 26 THEN NULL ELSE CAST(0.5 AS DOUBLE) END AS confidence,
    CASE WHEN v = 27 THEN 'gold' ELSE 'low' END AS authority_tier, CASE v WHEN 28 THEN '' WHEN 0 THEN NULL ELSE 'p' END AS publisher_id, CASE WHEN v = 30 THEN 0 ELSE 1 END AS evidence,
    'val:' || substr(sha(CASE WHEN v = 29 THEN 'x' ELSE entity_id END || '|' || property_id || '|' || value), 1, 24) AS value_id
    FROM (SELECT o_orderkey AS n, v, CASE WHEN v = 23 THEN 'thing:' ELSE 'order:' END || CAST(o_orderkey AS STRING) AS entity_id, {_CASE(0)} AS property_id, {_CASE(1)} AS value FROM (SELECT o_orderkey, o_orderkey % {len(VARIANTS)} AS v FROM orders) o) c""",
)
# the last word of a datatype's name, whatever prefix it has; the value without quotes if it is a string
relation(
    "claim_types",
    """SELECT c.*, run_backend, class_known, property, lower(regexp_extract(datatype, '([^#/:]*)$', 1)) AS kind, matches(value, '^".*"$') AS is_text, CASE WHEN matches(value, '^".*"$') THEN substr(value, 2, length(value) - 2) END AS words
    FROM claims c CROSS JOIN claim_run LEFT JOIN ontology ON class = entity_class AND property = property_id LEFT JOIN (SELECT DISTINCT class AS class_known FROM ontology) k ON class_known = entity_class""",
)
relation(
    "admission_reasons",
    """SELECT n, entity_class, entity_id, property_id, value, value_id, CASE
      WHEN backend IS NULL OR backend <> run_backend THEN 'backend'
      WHEN class_known IS NULL THEN 'class'
      WHEN entity_id IS NULL OR NOT begins(entity_id, entity_class || ':') THEN 'entity id'
      WHEN property IS NULL THEN 'property'
      WHEN value IS NULL OR value = 'null' OR begins(value, '{') OR begins(value, '[') THEN 'scalar'
      WHEN kind IN ('string', 'text', 'normalizedstring', 'token') THEN CASE WHEN NOT is_text THEN 'string' END
      WHEN kind IN ('boolean', 'bool') THEN CASE WHEN value NOT IN ('true', 'false') THEN 'boolean' END
      WHEN kind IN ('integer', 'int', 'long', 'nonnegativeinteger') THEN CASE WHEN NOT matches(value, '^-?[0-9]+$') THEN 'integer' WHEN kind = 'nonnegativeinteger' AND matches(value, '^-0*[1-9]') THEN 'negative' END
      WHEN kind IN ('number', 'decimal', 'float', 'double') THEN CASE WHEN NOT matches(value, '^-?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?$') OR NOT coalesce(abs(TRY_CAST(value AS DOUBLE)) <= 1.7976931348623157E308, FALSE) THEN 'number' END
      WHEN kind = 'date' THEN CASE WHEN words IS NULL OR NOT matches(words, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') OR TRY_CAST(words AS DATE) IS NULL THEN 'date' END
      WHEN kind IN ('datetime', 'date-time') THEN CASE WHEN words IS NULL OR NOT matches(words, '^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9]([.][0-9]+)?)?(Z|[+-]([01][0-9]|2[0-3]):?[0-5][0-9])?)?$') OR TRY_CAST(substr(words, 1, 10) AS DATE) IS NULL THEN 'timestamp'
        WHEN NOT matches(words, '(Z|[+-][0-9]{2}:?[0-9]{2})$') OR length(words) <= 10 THEN 'timezone' END
      WHEN kind IN ('uri', 'url', 'anyuri') THEN CASE WHEN words IS NULL OR NOT matches(words, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'uri' END
      ELSE 'datatype' END AS type_reason, CASE
      WHEN confidence IS NULL OR confidence < 0 OR confidence > 1 OR confidence <> confidence THEN 'confidence'
      WHEN authority_tier IS NULL OR authority_tier NOT IN ('primary', 'secondary', 'low', 'review', 'unknown') THEN 'tier'
      WHEN publisher_id = '' THEN 'publisher'
      WHEN value_id IS NULL OR value_id <> 'val:' || substr(sha(entity_id || '|' || property_id || '|' || value), 1, 24) THEN 'value id'
      WHEN evidence IS NULL OR evidence = 0 THEN 'evidence' END AS other_reason FROM claim_types""",
)
_EXPECTED = " UNION ALL ".join(f"SELECT {k} AS v, {_text(x[0])} AS property_id, CAST({_text(x[2])} AS VARCHAR) AS reason" for k, x in enumerate(VARIANTS))
sql_query(
    "admission",
    "SELECT n, property_id, coalesce(type_reason, other_reason) AS reason FROM admission_reasons",
    f"SELECT o_orderkey AS n, property_id, reason FROM orders JOIN ({_EXPECTED}) e ON v = o_orderkey % {len(VARIANTS)}",
)
sql_query(
    "admission_counts",
    "SELECT coalesce(type_reason, other_reason, 'accepted') AS outcome, count(*) AS n FROM admission_reasons GROUP BY coalesce(type_reason, other_reason, 'accepted')",
    f"SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS n FROM orders JOIN ({_EXPECTED}) e ON v = o_orderkey % {len(VARIANTS)} GROUP BY 1",
)

# Conditions: an entity meets a query if all its conditions hold on gold values; a property that is missing or not gold fails every operator.
# A query whose condition is null has none: every entity of its class meets it.
relation(
    "asked",
    """SELECT 'q1' AS query_id, 'order' AS query_class, 'status' AS cond_prop, 'eq' AS cond_op, 'F' AS cond_value UNION ALL SELECT 'q1', 'order', 'ship_date', 'exists', NULL
    UNION ALL SELECT 'q2', 'order', 'status', 'ne', 'F' UNION ALL SELECT 'q3', 'customer', 'segment', 'exists', NULL UNION ALL SELECT 'q3', 'customer', 'nation', 'eq', '3' UNION ALL SELECT 'q4', NULL, 'name', 'exists', NULL
    UNION ALL SELECT 'q5', 'customer', NULL, NULL, NULL""",
)
sql_query(
    "conditions_match",
    """SELECT query_id, entity_id FROM (SELECT DISTINCT query_id, query_class, cond_prop, cond_op, cond_value, conditions FROM (SELECT a.*, count(*) OVER (PARTITION BY query_id) AS conditions FROM asked a) w) q
    JOIN present ON property_id = cond_prop AND (query_class IS NULL OR entity_class = query_class) AND (cond_op = 'exists' OR (cond_op = 'eq' AND value = cond_value) OR (cond_op = 'ne' AND value <> cond_value))
    GROUP BY query_id, entity_id, conditions HAVING count(*) = conditions
    UNION ALL SELECT query_id, entity_id FROM asked JOIN entities ON query_class IS NULL OR entity_class = query_class WHERE cond_prop IS NULL""",
    """SELECT 'q1' AS query_id, a.entity_id FROM present a JOIN present b ON b.entity_id = a.entity_id WHERE a.entity_class = 'order' AND a.property_id = 'status' AND a.value = 'F' AND b.property_id = 'ship_date'
    UNION ALL SELECT 'q2', entity_id FROM present WHERE entity_class = 'order' AND property_id = 'status' AND value <> 'F'
    UNION ALL SELECT 'q3', a.entity_id FROM present a JOIN present b ON b.entity_id = a.entity_id WHERE a.entity_class = 'customer' AND a.property_id = 'segment' AND b.property_id = 'nation' AND b.value = '3'
    UNION ALL SELECT 'q4', entity_id FROM present WHERE property_id = 'name'
    UNION ALL SELECT 'q5', entity_id FROM entities WHERE entity_class = 'customer'""",
)
