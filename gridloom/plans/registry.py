"""All queries of the cube operators and their SQL twins, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.cube import CTES

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None, cube: bool = True):
    """Register a function under its name; ``sql`` is a SELECT over the cube's common tables, or a list of further ones and the SELECT."""

    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = (f"WITH {"RECURSIVE " if "FROM reach" in sql else ""}{CTES}, {sql.strip()[5:]}" if sql.strip().startswith("WITH ") else f"WITH {CTES} {sql.strip()}") if cube else sql.strip()
        return f

    return add


def _load() -> None:
    from . import aggregates, checks, curves, domains, explain, geometry, levels, models, ordered, places, products, projections, relational, scenarios  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
