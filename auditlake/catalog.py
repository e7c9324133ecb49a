"""Named queries over the test tables, with the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` together with its SQL."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return add


def _load() -> None:
    from auditlake.queries import audits, candidates, records, screening, star  # noqa: F401


def queries() -> dict[str, Query]:
    """Every query of the core."""
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """The SQL of every query of the core that has one."""
    _load()
    return dict(_ORACLES)
