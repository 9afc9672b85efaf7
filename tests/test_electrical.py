"""Closed-form values of the electrical algebra."""

import pytest
from pyspark.sql import functions as F

from gridweave.functions import electrical

LINES = "chain int, a long, c long, r double, x double, b double, g double, s_nom double, length double"


def frame(spark, rows):
    return spark.createDataFrame(rows, LINES)


def test_parallel(spark):
    rows = [(1, 1, 2, 2.0, 6.0, 0.1, 0.0, 100.0, 10.0), (1, 1, 2, 2.0, 6.0, 0.2, 0.0, 300.0, 20.0)]
    r = electrical.parallel_lines(frame(spark, rows), ["chain"]).first()
    assert (r["r"], r["x"], r["s_nom"], r["length"], r["num_parallel"]) == (1.0, 3.0, 400.0, 17.5, 2)
    assert r["b"] == pytest.approx(0.3)


def test_series(spark):
    rows = [(1, 1, 2, 1.0, 3.0, 0.5, 0.0, 150.0, 10.0), (1, 2, 3, 1.5, 4.5, 0.5, 0.0, 200.0, 12.0), (1, 3, 4, 2.0, 6.0, 0.25, 0.0, 180.0, 15.0)]
    r = electrical.series_lines(frame(spark, rows), ["chain"]).first()
    assert (r["r"], r["x"], r["s_nom"], r["length"], r["b"]) == (4.5, 13.5, 150.0, 37.0, 0.125)
    rows[0] = (*rows[0][:5], 0.0, *rows[0][6:])
    assert electrical.series_lines(frame(spark, rows), ["chain"]).first()["b"] == 0


@pytest.mark.parametrize("bad", [0.0, -1.0])
def test_errors(spark, bad):
    df = spark.createDataFrame([(bad,), (1.0,)], "z double")
    with pytest.raises(Exception, match="positive"):
        df.agg(electrical.parallel_impedance("z")).collect()
    if bad < 0:
        with pytest.raises(Exception, match="negative"):
            df.agg(electrical.series_impedance("z")).collect()
        with pytest.raises(Exception, match="negative"):
            df.agg(electrical.total_capacity("z")).collect()
    with pytest.raises(Exception, match="positive"):
        df.limit(0).agg(electrical.parallel_impedance("z")).collect()


def test_lengths_and_centroids(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (1, 4.0, 2.0, 3.0)], "k int, x double, y double, w double")
    assert electrical.centroid(df, ["k"], "w").first()[1:] == (3.0, 1.5)
    assert electrical.centroid(df, ["k"]).first()[1:] == (2.0, 1.0)
    with pytest.raises(Exception, match="positive"):
        electrical.centroid(df.withColumn("w", F.lit(0.0)), ["k"], "w").collect()


def test_filling_by_similarity(spark):
    lines = spark.createDataFrame([(1, 110.0, 6, 9.0, 9.0, 9.0, 9.0, 10.0, True), (2, 110.0, 6, 9.0, 9.0, 9.0, 9.0, 0.005, True), (3, 110.0, 6, 9.0, 9.0, 9.0, 9.0, 10.0, False)], "line_id int, v_nom double, cables int, r double, x double, b double, s_nom double, length double, doubtful boolean")
    like = spark.createDataFrame([(110.0, 6, 0.1, 0.4, 0.01, 130.0)], "v_nom double, cables int, r_km double, x_km double, b_km double, s_circuit double")
    rows = {r["line_id"]: r for r in electrical.fill_by_similarity(lines, like).collect()}
    assert (rows[1]["r"], rows[1]["x"], rows[1]["b"], rows[1]["s_nom"]) == (0.5, 2.0, 0.2, 260.0)
    assert rows[2]["r"] == rows[3]["r"] == 9.0 and not rows[2]["filled"]
