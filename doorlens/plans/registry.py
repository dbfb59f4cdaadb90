"""Where queries register themselves, each with the SQL its result must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from doorlens.plans.analogs import Tables, with_views

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers `build(tables) -> DataFrame`; `sql` may name any derived view."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            _SQL[name] = sql
        return build

    return register


def load() -> None:
    from doorlens.plans import aggregates, filters, graphs, jobs, joins, landed, scalars, scans, windows  # noqa: F401


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    load()
    return {name: with_views(sql) for name, sql in _SQL.items()}
