"""All grid queries over the driver's tables: name -> plan, name -> SQL."""

from __future__ import annotations

from gridweave.plans import registry


def queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)


def _load() -> None:
    from gridweave.plans import queries_checks, queries_graph, queries_market, queries_relational, queries_series  # noqa: F401
