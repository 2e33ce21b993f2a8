"""Names of the core queries, with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
#: Modules that register queries when they are imported.
_MODULES = (
    "corvane.operators.tokens",
    "corvane.operators.ngrams",
    "corvane.operators.search",
    "corvane.operators.relations",
    "corvane.operators.similarity",
    "corvane.operators.windows",
    "corvane.operators.concordance",
    "corvane.operators.quality",
    "corvane.operators.star",
    "corvane.operators.alignment",
    "corvane.operators.lookup",
    "corvane.operators.repair",
    "corvane.operators.assembly",
    "corvane.streaming.events",
)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its DuckDB SQL where there is one."""

    def keep(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return keep


def _load() -> None:
    from importlib import import_module

    for module in _MODULES:
        import_module(module)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
