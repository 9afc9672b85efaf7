"""Queries that read all of their table, whatever the ids."""

import duckdb

from gridweave.plans import catalogue


def test_fuzzy_top_matches_reads_all_parts(spark, tmp_path):
    names = ["neu berg", "neu berg", "neu bern", "neu berg", "alt tal", "neu berg", "neu berg"]
    rows = [(k, name) for k, name in enumerate(names, 1)]  # only 7 is divisible by 7, so no two of them are
    spark.createDataFrame(rows, "p_partkey long, p_name string").selectExpr("*", "'X' AS p_type").write.parquet(f"{tmp_path}/part.parquet")
    found = {tuple(r) for r in catalogue.queries()["fuzzy_top_matches"](spark, str(tmp_path)).collect()}
    best = {1: (2, 4, 6), 2: (1, 4, 6), 4: (1, 2, 6), 6: (1, 2, 4), 7: (1, 2, 4)}
    expected = {(k, rank, other, 1.0) for k, others in best.items() for rank, other in enumerate(others, 1)}
    expected |= {(3, rank, other, 0.875) for rank, other in enumerate((1, 2, 4), 1)}
    assert found == expected
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert set(con.execute(catalogue.oracle_sql()["fuzzy_top_matches"]).fetchall()) == expected
