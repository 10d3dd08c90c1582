"""The engine over a user's own data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakewright.plans import registry
from lakewright.plans.dialect import run_sql


class Lake:
    """Named frames and everything that derives from them.

    >>> lake = Lake(spark, obs=observations)
    >>> lake.relation("gold_fields")      # resolved values
    >>> lake.sql("SELECT * FROM dod_compared WHERE NOT met")

    Any relation (obs, trace, calls, jobs, ...) or table may be given; what is not given derives from the tables
    below `folder`.  An obs frame has run_id, entity_id, entity_class, property_id, value, source_id, source_type,
    authority_tier, publisher_id, confidence, step and value_id; a declared frame (class, prop, dod) replaces the ontology.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, **given: DataFrame):
        registry.load()
        self.spark, self.folder, self.given = spark, folder, given

    def relation(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, text: str) -> DataFrame:
        return run_sql(self.spark, self.folder, text, self.given)
