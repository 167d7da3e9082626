"""Registry of the queries over the given tables, with their DuckDB statements."""

from __future__ import annotations

_QUERIES: dict = {}
_ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    """Decorator: register a (spark, sf_dir) function as query `name`."""

    def add(build):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = build
        if sql is not None:
            _ORACLES[name] = sql
        return build

    return add


def _load() -> None:
    from rowforge.plans import generation, labels, streams, tables, whole  # noqa: F401  registers their queries


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(_ORACLES)
