"""Relations and queries as declarative SQL, rendered for Spark (execution) or DuckDB (verification).

A relation is a named SELECT over driver tables and other relations; a query is a SELECT over
them.  Rendering puts the relations that a query needs in front of it as common table expressions,
so Catalyst sees one plan: it prunes columns, pushes filters into the scans and reuses exchanges.

The few expressions whose spelling differs between the engines are written as macros:
idiv(a, b), sha(x), key_of(json), matches(x, 'regex'), micros(ts), names_of(x), items(x), nth(x, n), part(x, sep, n).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakewright.plans import registry
from lakewright.plans.written import written

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_relations: dict[str, str] = {}

_MACROS: dict[str, tuple[str, str]] = {
    "idiv": ("({0} div {1})", "({0} // {1})"),
    "sha": ("sha2({0}, 256)", "sha256({0})"),
    "key_of": ("CAST(get_json_object({0}, '$.k') AS BIGINT)", "CAST(json_extract_string({0}, '$.k') AS BIGINT)"),
    "matches": ("({0} RLIKE {1})", "regexp_matches({0}, {1})"),
    "micros": ("unix_micros(CAST({0} AS TIMESTAMP))", "epoch_us({0})"),
    "names_of": ("array_join(array_sort(collect_set({0})), ',')", "coalesce(array_to_string(list_sort(list_distinct(list({0}))), ','), '')"),
    "regex_all": ("regexp_extract_all({0}, {1}, {2})", "regexp_extract_all({0}, {1}, {2})"),
    "join_list": ("array_join({0}, {1})", "array_to_string({0}, {1})"),
    "length_of": ("CAST(size({0}) AS BIGINT)", "CAST(len({0}) AS BIGINT)"),
    "replace_all": ("regexp_replace({0}, {1}, {2})", "regexp_replace({0}, {1}, {2}, 'g')"),
    "each_of": ("explode({0})", "unnest({0})"),
    "part": ("split_part({0}, {1}, {2})", "split_part({0}, {1}, {2})"),
    "day_of": ("date_format({0}, 'yyyy-MM-dd')", "strftime({0}, '%Y-%m-%d')"),
    "second_of": ("date_format({0}, 'yyyy-MM-dd HH:mm:ss')", "strftime({0}, '%Y-%m-%d %H:%M:%S')"),
    "has": ("contains({0}, {1})", "contains({0}, {1})"),
    "begins": ("startswith({0}, {1})", "starts_with({0}, {1})"),
    "finishes": ("endswith({0}, {1})", "ends_with({0}, {1})"),
    "upto": ("sequence(CAST(1 AS BIGINT), {0})", "range(CAST(1 AS BIGINT), {0} + 1)"),
    "lev": ("levenshtein({0}, {1})", "levenshtein({0}, {1})"),
}


def relation(name: str, sql: str) -> None:
    """Names a SELECT; later relations and queries may read it."""
    if name in _relations or name in TABLES:
        raise ValueError(f"relation {name} is defined twice")
    _relations[name] = sql.strip()


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """The comma-separated arguments from the parenthesis at `at`, and the place after the closing one."""
    depth, quoted, start, found = 0, False, at + 1, []
    for i in range(at, len(text)):
        c = text[i]
        if c == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if not depth:
                return [*found, text[start:i].strip()], i + 1
        elif c == "," and depth == 1:
            found.append(text[start:i].strip())
            start = i + 1
    raise ValueError(f"unbalanced parentheses: {text[at : at + 60]}")


def expand(text: str, engine: str) -> str:
    """Replaces macros, innermost last."""
    pattern = re.compile(rf"\b({'|'.join(_MACROS)})\(")
    at = 0
    while m := pattern.search(text, at):
        arguments, end = _arguments(text, m.end() - 1)
        shape = _MACROS[m[1]][engine == "duckdb"]
        done = shape.format(*(expand(a, engine) for a in arguments))
        text = text[: m.start()] + done + text[end:]
        at = m.start() + len(done)
    return text


def needed(sql: str, given: frozenset[str] = frozenset()) -> tuple[list[str], list[str]]:
    """(relations in dependency order, tables) that a SELECT reads; given relations count as tables."""
    order: list[str] = []
    tables: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_][a-z0-9_]*)\b", text, re.I)):
            if word in given or word in TABLES:
                if word not in tables:
                    tables.append(word)
            elif word in _relations and word not in order:
                visit(_relations[word])
                order.append(word)

    visit(sql)
    return order, tables


def render(sql: str, engine: str, given: frozenset[str] = frozenset()) -> str:
    """The whole statement for one engine.  A query may itself begin with WITH RECURSIVE."""
    order, _ = needed(sql, given)
    ctes = [f"{name} AS (\n{_relations[name]}\n)" for name in order]
    body = sql.strip()
    recursive = re.match(r"WITH\s+RECURSIVE\s", body, re.I)
    if recursive:
        text = f"WITH RECURSIVE {', '.join([*ctes, body[recursive.end() :]])}"
    elif ctes:
        text = f"WITH {', '.join(ctes)}\n{body}"
    else:
        text = body
    return expand(text, engine)


def run_sql(spark: SparkSession, sf_dir: str | None, sql: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """The SELECT as a DataFrame over the tables of sf_dir; given frames stand for the tables or relations they name."""
    given = given or {}
    _, tables = needed(sql, frozenset(given))
    text = render(sql, "spark", frozenset(given))
    frames = {t: given[t] if t in given else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    if not frames:
        return spark.sql(text)
    text = text.replace("{", "{{").replace("}", "}}")
    text = re.sub(rf"\b(FROM|JOIN)(\s+)({'|'.join(frames)})\b", r"\1\2{\3}", text, flags=re.I)
    return spark.sql(text, **frames)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation as a DataFrame."""
    return run_sql(spark, sf_dir, f"SELECT * FROM {name}")


def sql_query(name: str, sql: str, oracle: str | None = None, shared: tuple[str, ...] = ()) -> Callable[[SparkSession, str], DataFrame]:
    """Registers a query: Spark runs it, DuckDB verifies it, by a statement of its own if one is given.

    Shared relations, in the order of their dependence, are written once before the query reads them several times.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given: dict[str, DataFrame] = {}
        for part in shared:
            given[part] = written(run_sql(spark, sf_dir, _relations[part], given))
        return run_sql(spark, sf_dir, sql, given)

    run.__name__, run.__doc__ = name, sql
    return registry.query(name, LazyOracle(oracle or sql))(run)


class LazyOracle:
    """The DuckDB text, rendered on demand: relations may be defined after the query."""

    def __init__(self, sql: str):
        self.sql = sql

    def __str__(self) -> str:
        return render(self.sql, "duckdb")
