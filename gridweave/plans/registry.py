"""Where query modules enter their plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridweave.plans.roles import Roles, with_roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of the roles as a query, with its SQL if there is one."""

    def enter(build):
        QUERIES[build.__name__] = lambda spark, sf_dir: build(Roles(spark, sf_dir))
        if sql is not None:
            ORACLES[build.__name__] = with_roles(sql)
        return build

    return enter
