"""Names."""

import pytest
from pyspark.sql import functions as F

from gridweave.functions import text


def one(spark, name, expression):
    return spark.createDataFrame([(name,)], "name string").select(expression(F.col("name"))).first()[0]


@pytest.mark.parametrize(
    "name, want",
    [("Umspannwerk Köln 380 kV", "koeln"), ("UW Hamm", "hamm"), ("Station Bad Str. 4", "bad strasse"), ("Mühlheim (alt)", "muehlheim"), ("Grafen Ost", "grafen"), (None, ""), ("  ", ""), ("Haupt-Werk", "hauptwerk")],
)
def test_normalised(spark, name, want):
    assert one(spark, name, text.normalised) == want


def test_parts(spark):
    name = "Werk Süd 380 kV 2"
    assert one(spark, name, text.voltage_in) == 380 and one(spark, name, text.direction_in) == "Süd" and one(spark, name, text.number_in) == 2
    assert one(spark, "w123", text.osm_number) == 123 and one(spark, "x", text.osm_number) is None
    assert one(spark, "/ 380kV / Berg / Trafo", text.path_name) == "Berg"


def test_ratio():
    assert text.weighted_ratio("neu berg", "berg neu") == pytest.approx(0.95)
    assert text.weighted_ratio("berg", "berg") == 1 and text.weighted_ratio("", "berg") == 0
    assert text.weighted_ratio("berg", "umspannwerk berg") >= 0.9 > text.weighted_ratio("berg", "tal")


def test_confidence(spark):
    of = lambda kind, score: spark.range(1).select(text.name_confidence(F.lit(kind), F.lit(score).cast("double"))).first()[0]
    assert of("san_name_exact", None) == 0.95 and of("san_name_fuzzy", 1.0) == pytest.approx(0.85) and of("unknown", 0.5) == 0.5
