"""Grid roles over the driver's tables: one SQL text per role, valid in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from gridweave.session import ship

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_D = lambda text: f"CAST({text} AS DOUBLE)"

ROLES = {
    "bus": f"""SELECT s_suppkey AS bus_id, CAST(CASE s_suppkey % 3 WHEN 0 THEN 380 WHEN 1 THEN 220 ELSE 110 END AS INT) AS v_nom,
        {_D("6")} + {_D("(s_suppkey * 37) % 1000")} * {_D("0.009")} AS x, {_D("47.5")} + {_D("(s_suppkey * 61) % 1000")} * {_D("0.0075")} AS y,
        n_name AS country, s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "line": f"""SELECT o_orderkey AS line_id, o_custkey % (SELECT count(*) FROM supplier) AS bus0, o_orderkey % (SELECT count(*) FROM supplier) AS bus1,
        CAST(CASE o_orderkey % 3 WHEN 0 THEN 380 WHEN 1 THEN 220 ELSE 110 END AS INT) AS v_nom,
        {_D("o_orderkey % 7 + 1")} * {_D("0.01")} AS r, {_D("o_orderkey % 11 + 1")} * {_D("0.1")} AS x, {_D("o_orderkey % 5")} * {_D("0.000001")} AS b, {_D("0")} AS g,
        o_totalprice / {_D("1000")} AS s_nom, {_D("o_custkey % 50 + 1")} AS length, CAST(3 * (1 + o_orderkey % 3) AS INT) AS cables FROM orders""",
    # stretches of six buses in a row, every second segment doubled: chains, parallels and dead ends
    "stretch": f"""SELECT s_suppkey * 2 + k AS line_id, s_suppkey AS bus0, s_suppkey + 1 AS bus1, {_D("s_suppkey % 7 + 1 + k")} * {_D("0.1")} AS r, {_D("s_suppkey % 5 + 2 + k")} * {_D("0.5")} AS x,
        {_D("s_suppkey % 4")} * {_D("0.25")} AS b, {_D("0")} AS g, {_D("100 + s_suppkey % 90")} AS s_nom, {_D("s_suppkey % 11 + 1")} AS length
        FROM supplier CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) kk WHERE s_suppkey % 6 <> 5 AND s_suppkey + 1 < (SELECT count(*) FROM supplier) AND (k = 0 OR s_suppkey % 2 = 0)""",
    "gen": f"""SELECT p_partkey AS generator_id, p_partkey % (SELECT count(*) FROM supplier) AS bus, p_type AS carrier, {_D("p_size")} AS p_nom, p_retailprice AS cost, p_name AS name FROM part""",
    "ev": f"""SELECT event_id, user_id AS load_id, event_type AS carrier, ts, date_trunc('hour', ts) AS hr, value AS mw, props FROM events""",
}


class Roles:
    """Tables and roles of one data directory as DataFrames: ``Roles(spark, dir).bus``.

    Only what is asked for is read; a role's tables become temporary views while its
    text is analysed.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = ship(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        if name not in ROLES:
            raise AttributeError(name)
        for t in TABLES:
            if re.search(rf"\b{t}\b", ROLES[name]):
                getattr(self, t).createOrReplaceTempView(t)
        return self.spark.sql(ROLES[name])


def with_roles(sql: str) -> str:
    """SQL for DuckDB: role texts as common table expressions before the query."""
    used = [r for r in ROLES if re.search(rf"\b{r}\b", sql)]
    if not used:
        return sql
    head = ", ".join(f"{r} AS ({ROLES[r]})" for r in used)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[len('WITH '):]}"
    return f"WITH {head} {body}"
