"""Chains of parents and breadth-first depths over any number of hops, in a logarithmic number of joins or one join a level.

`ancestors` doubles pointers: after k rounds every step knows what lies on the 2 ** k steps above it, so a chain of a million steps takes
twenty joins, without a recursion limit.  What never ends is a cycle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.plans.dialect import LazyOracle, frame, relation
from lakewright.plans.registry import query
from lakewright.plans.written import written


def ancestors(steps: DataFrame) -> DataFrame:
    """(node, above, low, marks, broken) of every row of steps(node, up, mark); node is unique.

    above is the number of ancestors, low the smallest node among the step and them, marks the distinct marks of the ancestors (not the step's
    own); broken says that the chain holds a parent that is not there, or a cycle, and so cannot be followed to its end.  A null up ends a chain.
    """
    known = steps.select(F.col("node").alias("_p"))
    found = steps.join(known, F.col("up") == F.col("_p"), "left")
    missing = F.col("up").isNotNull() & F.col("_p").isNull()
    marks = F.array().cast(f"array<{steps.schema['mark'].dataType.simpleString()}>")
    state = written(found.select("node", F.when(~missing, F.col("up")).alias("up"), "mark", F.lit(0).cast("long").alias("above"), F.col("node").alias("low"), marks.alias("marks"), missing.alias("broken")))
    for _ in range(2 + math.ceil(math.log2(1 + state.count()))):
        live = state.where("up is not null")
        if live.isEmpty():
            break
        over = state.select(F.col("node").alias("up"), *(F.col(c).alias(f"_{c}") for c in ("up", "mark", "above", "low", "marks", "broken")))
        own = F.when(F.col("_mark").isNotNull(), F.array("_mark")).otherwise(marks)
        climbed = live.join(over, "up").select(
            "node", F.col("_up").alias("up"), "mark", (F.col("above") + 1 + F.col("_above")).alias("above"), F.least("low", "_low").alias("low"),
            F.array_distinct(F.concat("marks", own, "_marks")).alias("marks"), (F.col("broken") | F.col("_broken")).alias("broken"),
        )
        state = written(state.where("up is null").unionByName(climbed))
    return state.select("node", "above", "low", "marks", (F.col("broken") | F.col("up").isNotNull()).alias("broken"))


def breadth_first(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(space, node, depth) of all nodes that the directed edges(space, a, b) reach from seeds(space, node); one join per level, visited nodes never again."""
    edges = written(edges.where("a <> b").distinct())
    frontier = reached = written(seeds.distinct().withColumn("depth", F.lit(0)))
    while True:
        near = frontier.join(edges, (frontier["space"] == edges["space"]) & (frontier["node"] == edges["a"])).select(frontier["space"], F.col("b").alias("node"), (F.col("depth") + 1).alias("depth"))
        frontier = written(near.distinct().join(reached.select("space", "node"), ["space", "node"], "left_anti"))
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)


# steps whose parents are missing now and then, or themselves
relation("step_chain", "SELECT event_id, CASE WHEN event_id % 97 = 0 THEN -event_id WHEN event_id % 101 = 0 THEN event_id ELSE parent_id END AS parent_id, event, event_type, source_id FROM trace")
relation("host_places", "SELECT host, template, row_number() OVER (PARTITION BY host ORDER BY page_id) AS place FROM page_types")
# a page links to two later pages of its host
relation("type_links", "SELECT DISTINCT f.host, f.template AS from_type, t.template AS to_type FROM host_places f JOIN host_places t ON t.host = f.host AND (t.place = 2 * f.place OR t.place = 2 * f.place + 1)")


@query(
    "quarantine_ancestor",
    LazyOracle(
        """WITH RECURSIVE walk AS (
      SELECT event_id AS root, source_id AS shot, parent_id AS up, [event_id] AS seen, FALSE AS stopped FROM step_chain WHERE event_type = 'signup'
      UNION ALL
      SELECT root, shot, CASE WHEN list_contains(seen, up) OR p.event_id IS NULL OR (p.event = 'hard_stop' AND p.source_id = shot) THEN NULL ELSE p.parent_id END, list_append(seen, up),
        coalesce(list_contains(seen, up) OR p.event_id IS NULL OR (p.event = 'hard_stop' AND p.source_id = shot), FALSE)
      FROM walk LEFT JOIN step_chain p ON p.event_id = up WHERE up IS NOT NULL
    ) SELECT root, bool_or(stopped) AS quarantined FROM walk GROUP BY root"""
    ),
)
def quarantine_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a step stands under a stop on its own source, or on a chain that cannot be followed to its end: it fails closed."""
    steps = written(frame(spark, sf_dir, "step_chain"))
    state = ancestors(steps.select(F.col("event_id").alias("node"), F.col("parent_id").alias("up"), F.when(F.col("event") == "hard_stop", F.col("source_id")).alias("mark")))
    asked = steps.where("event_type = 'signup'").select(F.col("event_id").alias("node"), "source_id")
    return state.join(asked, "node").select(F.col("node").alias("root"), (F.col("broken") | F.coalesce(F.array_contains("marks", F.col("source_id")), F.lit(False))).alias("quarantined"))


@query(
    "lineage_recursive",
    LazyOracle(
        """WITH RECURSIVE chain AS (
      SELECT event_id AS root, event_id AS node, parent_id, 0 AS depth FROM trace WHERE event_type = 'purchase'
      UNION ALL
      SELECT root, event_id, p.parent_id, depth + 1 FROM chain c JOIN (SELECT event_id, parent_id FROM trace) p ON p.event_id = c.parent_id
    ) SELECT root, count(*) AS steps, max(depth) AS depth, min(node) AS origin FROM chain GROUP BY root"""
    ),
)
def lineage_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of parents of every purchase, of any length."""
    steps = written(frame(spark, sf_dir, "trace").select("event_id", "parent_id", "event_type"))
    state = ancestors(steps.select(F.col("event_id").alias("node"), F.col("parent_id").alias("up"), F.lit(None).cast("string").alias("mark")))
    asked = steps.where("event_type = 'purchase'").select(F.col("event_id").alias("node"))
    return state.join(asked, "node").select(F.col("node").alias("root"), (F.col("above") + 1).alias("steps"), F.col("above").cast("int").alias("depth"), F.col("low").alias("origin"))


@query(
    "site_depth",
    LazyOracle(
        """WITH RECURSIVE reach AS (
      SELECT host, template AS node, 0 AS depth, [template] AS path FROM host_places WHERE place = 1
      UNION ALL
      SELECT r.host, e.to_type, depth + 1, list_append(path, e.to_type) FROM reach r JOIN type_links e ON e.host = r.host AND e.from_type = node WHERE NOT list_contains(path, e.to_type)
    ), nearest AS (SELECT host, node, min(depth) AS depth FROM reach GROUP BY host, node)
    SELECT t.host, t.template, depth FROM (SELECT DISTINCT host, template FROM host_places) t LEFT JOIN nearest n ON n.host = t.host AND node = t.template"""
    ),
)
def site_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks from a site's first page type to each of its types; null where none leads."""
    places = frame(spark, sf_dir, "host_places")
    links = frame(spark, sf_dir, "type_links").select(F.col("host").alias("space"), F.col("from_type").alias("a"), F.col("to_type").alias("b"))
    seeds = places.where("place = 1").select(F.col("host").alias("space"), F.col("template").alias("node"))
    depths = breadth_first(links, seeds).withColumnsRenamed({"space": "host", "node": "template"})
    return places.select("host", "template").distinct().join(depths, ["host", "template"], "left")
