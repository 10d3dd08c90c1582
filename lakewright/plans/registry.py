"""The registered queries: name -> (DataFrame builder, DuckDB twin or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, object] = {}


def query(name: str, oracle: object | None = None) -> Callable[[Query], Query]:
    """Registers a query function under a name, with its DuckDB SQL if it has one."""

    def add(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = f
        if oracle:
            _oracles[name] = oracle
        return f

    return add


def load() -> None:
    """Imports the modules that register queries."""
    import importlib

    for module in ("sources.fixtures", "operators.silver", "operators.refine", "operators.hubs", "operators.completeness", "operators.telemetry", "operators.graphs", "operators.chains", "operators.admission", "operators.discovery", "operators.extraction", "operators.ranking", "operators.sinks", "operators.replay", "operators.crawl", "operators.site_graph", "operators.fair_choice", "operators.fuzzy", "functions.documents", "functions.failure_kinds", "functions.text_rules", "functions.json_records", "functions.profiler", "functions.record_mapping", "functions.line_diff", "functions.page_nodes", "functions.xml_records", "streaming.feeds", "streaming.tails"):
        importlib.import_module(f"lakewright.{module}")


def queries() -> dict[str, Query]:
    load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    load()
    return {name: str(sql) for name, sql in _oracles.items()}
