"""Tables with many rows of one name or at one place: copies are not expanded into all pairs, and results are those of SQL."""

import pytest
from pyspark.sql import functions as F

from gridweave.functions import text
from gridweave.operators import spatial, validate
from gridweave.plans import catalogue


def most_joined(df) -> int:
    """Runs ``df``; the most rows that one of its joins made."""
    df.collect()

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        metric = node.metrics().get("numOutputRows")
        own = metric.get().value() if "Join" in kind and metric.isDefined() else 0
        below = node.children()
        return max([own, *(walk(below.apply(k)) for k in range(below.size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def test_fuzzy_top_compares_each_name_once(spark):
    names = spark.range(3000).select("id", F.when(F.col("id") % 1000 == 0, "Neu Bern").otherwise("Neu Berg").alias("name"))
    out = text.fuzzy_top(names, names.select(F.col("id").alias("cand_id"), F.col("name").alias("cand_name")), F.substring("name", 1, 2), 0.8, 3)
    assert most_joined(out) <= 9000
    rows = {}
    for r in out.collect():
        rows.setdefault(r["id"], []).append((r["rank"], r["cand_id"], r["score"]))
    assert len(rows) == 3000 and sorted(rows[5]) == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0)]
    assert sorted(rows[0]) == [(1, 0, 1.0), (2, 1000, 1.0), (3, 2000, 1.0)]


def test_generation_audit_meets_each_place_once(spark):
    units = spark.range(2000).selectExpr("id AS generator_id", "id AS bus", "'gas' AS carrier", "if(id % 10 = 7, 'none', 'gas') AS family", "if(id % 5 = 4, 50.0D, 400.0D) AS p_nom", "380 AS v_nom", "9.0D + id % 4 AS x", "50.0D AS y")
    plants = spark.range(1000).selectExpr("concat('P', lpad(1000 - id, 4, '0')) AS name", "'gas' AS family", "if(id = 999, 100.0D, 300.0D) AS mw", "if(id % 2 = 0, 9.0D, 30.0D) AS x", "50.0D AS y")
    capacity = units.selectExpr("bus", "1000.0D AS cap")
    out = validate.generation_audit(units, capacity, plants)
    assert most_joined(out) <= 2000
    rows = {r["generator_id"]: (r["plant"], r["km"], r["issues"]) for r in out.collect()}
    # place 9 has a plant (the least name of 500); place 10 is 71.5 km from it; a family without plants, small units
    assert rows[10] == ("P0002", 71.5 * 2, "GHOST") and rows[1] == ("P0002", 71.5, "GHOST") and rows[7] == (None, None, "GHOST")
    assert set(rows) == {k for k in range(2000) if k % 5 != 4 and k % 4 != 0}


def _crowded(spark):
    """2000 points at two places, 900 buses at three: by voltage 380 nearer, 220 farther, 110 far."""
    points = spark.range(2000).selectExpr("id", "9.0D + id % 2 AS x", "50.0D AS y", "220 AS want")
    buses = spark.range(900).selectExpr("900 - id AS bus_id", "element_at(array(380, 220, 110), cast(id % 3 + 1 AS int)) AS v_nom", "9.0D + 0.1D * (id % 3 + 1) AS x", "50.0D AS y")
    return points, buses


def test_nearest_within_meets_each_place_once(spark):
    points, buses = _crowded(spark)
    out = spatial.nearest_within(points, buses, "id", 30, 3)
    assert most_joined(out) <= 6000
    rows = {}
    for r in out.collect():
        rows.setdefault(r["id"], []).append((r["rank"], r["b_bus_id"], round(r["km"], 6)))
    assert set(rows) == set(range(0, 2000, 2))  # the other place is 50 km away
    assert all(sorted(v) == [(1, 3, 7.15), (2, 6, 7.15), (3, 9, 7.15)] for v in rows.values())


def test_nearest_preferring_meets_each_place_once(spark):
    points, buses = _crowded(spark)
    for close, expected in ((15, (2, 14.3, True)), (10, (3, 7.15, False))):
        out = spatial.nearest_preferring(points, buses, "id", "want", 30, close)
        assert most_joined(out) <= 2000
        rows = {r["id"]: (r["bus_id"], round(r["km"], 6), r["preferred"]) for r in out.collect()}
        assert rows == dict.fromkeys(range(0, 2000, 2), expected)


def test_tiered_match_meets_each_place_once(spark, tmp_path):
    spark.range(2000).selectExpr("id * 1000 AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(1, 901).selectExpr("id * 1000 AS s_suppkey", "0 AS s_nationkey", "'S' AS s_name").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.sql("SELECT 0 AS n_nationkey, 'N' AS n_name").write.parquet(f"{tmp_path}/nation.parquet")
    out = catalogue.queries()["tiered_match"](spark, str(tmp_path))
    assert most_joined(out) <= 2000
    # all at one place: the least bus of 380 kV (an id divisible by 3)
    assert {tuple(r) for r in out.collect()} == {(k * 1000, 1, 3000, 0.0) for k in range(2000)}
