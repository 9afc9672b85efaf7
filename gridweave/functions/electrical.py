"""Electrical algebra as aggregate expressions, and scalar checks with the same contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _guard(ok: Column, value: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def parallel_impedance(z: str) -> Column:
    """1 / sum(1 / z) over a group; an error if the group is empty or any value is not positive."""
    return _guard((F.count(z) > 0) & (F.min(z) > 0), F.try_divide(F.lit(1.0), F.sum(F.try_divide(F.lit(1.0), F.col(z)))), f"parallel impedance needs positive {z}")


def series_impedance(z: str) -> Column:
    """Sum over a group; an error if it is empty or any value is negative."""
    return _guard((F.count(z) > 0) & (F.min(z) >= 0), F.sum(z), f"series impedance needs non-negative {z}")


def total_capacity(s: str) -> Column:
    return _guard((F.count(s) > 0) & (F.min(s) >= 0), F.sum(s), f"capacity needs non-negative {s}")


def bottleneck_capacity(s: str) -> Column:
    return _guard((F.count(s) > 0) & (F.min(s) >= 0), F.min(s), f"capacity needs non-negative {s}")


def weighted_length(length: str, weight: str) -> Column:
    """Mean length weighted by ``weight``; an error if the weights add up to nothing."""
    return _guard(F.sum(weight) > 0, F.sum(F.col(length) * F.col(weight)) / F.sum(weight), f"the total of {weight} must be positive")


def parallel_lines(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One equivalent line per group of parallel ones: r and x harmonic, b, g and s_nom added, length weighted by s_nom."""
    return df.groupBy(*keys).agg(
        parallel_impedance("r").alias("r"),
        parallel_impedance("x").alias("x"),
        F.sum(F.coalesce("b", F.lit(0.0))).alias("b"),
        F.sum(F.coalesce("g", F.lit(0.0))).alias("g"),
        F.sum("s_nom").alias("s_nom"),
        weighted_length("length", "s_nom").alias("length"),
        F.count("*").alias("num_parallel"),
    )


def series_lines(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One equivalent line per chain: r, x, g and length added, b as 1 / sum(1 / b) if none is 0, s_nom the least."""
    b = F.coalesce("b", F.lit(0.0))
    return df.groupBy(*keys).agg(
        series_impedance("r").alias("r"),
        series_impedance("x").alias("x"),
        F.when(F.min(F.abs(b)) > 0, 1 / F.sum(F.when(b != 0, 1 / b))).otherwise(0.0).alias("b"),
        F.sum(F.coalesce("g", F.lit(0.0))).alias("g"),
        F.min("s_nom").alias("s_nom"),
        F.sum("length").alias("length"),
        F.count("*").alias("num_segments"),
    )


def per_km(df: DataFrame) -> DataFrame:
    """r_km and x_km; rows without positive length are an error."""
    length = F.col("length")
    return df.withColumn("r_km", _guard(length > 0, F.col("r") / length, "length must be positive")).withColumn("x_km", _guard(length > 0, F.col("x") / length, "length must be positive"))


def centroid(df: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """x and y of each group, weighted if a weight is named."""
    if weight is None:
        return df.groupBy(*keys).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return df.groupBy(*keys).agg(weighted_length("x", weight).alias("x"), weighted_length("y", weight).alias("y"))


def fill_by_similarity(lines: DataFrame, medians: DataFrame, short: float = 0.01) -> DataFrame:
    """Take r, x, b and s_nom of doubtful lines from per-km medians of their like.

    medians: (v_nom, cables, r_km, x_km, b_km, s_circuit). A line has cables // 3
    circuits (one at least): r and x shrink with them, b and s_nom grow. Lines of at
    most ``short`` kilometres keep their values. Column ``doubtful`` says which to fill.
    """
    like = medians.select(F.col("v_nom").alias("_v"), F.col("cables").alias("_c"), "r_km", "x_km", "b_km", "s_circuit")
    n = F.greatest(F.lit(1), F.floor(F.coalesce("cables", F.lit(3)) / 3))
    fill = F.col("doubtful") & (F.col("length") > short) & F.col("r_km").isNotNull()
    out = lines.join(like, (F.col("v_nom") == F.col("_v")) & (F.col("cables") == F.col("_c")), "left").withColumn("_fill", F.coalesce(fill, F.lit(False)))
    for c, value in (("r", F.col("r_km") * F.col("length") / n), ("x", F.col("x_km") * F.col("length") / n), ("b", F.col("b_km") * F.col("length") * n), ("s_nom", F.col("s_circuit") * n)):
        out = out.withColumn(c, F.when(F.col("_fill"), value).otherwise(F.col(c)))
    return out.withColumn("filled", F.col("_fill")).drop("_v", "_c", "r_km", "x_km", "b_km", "s_circuit", "_fill")


def default_by_voltage(trafos: DataFrame, defaults: DataFrame, least_x: float = 0.001) -> DataFrame:
    """Transformers whose x is below ``least_x`` though they have capacity take r and x of their voltage pair (v_low, v_high)."""
    dims = defaults.select(F.col("v_low").alias("_l"), F.col("v_high").alias("_h"), F.col("r").alias("_r"), F.col("x").alias("_x"))
    out = trafos.join(F.broadcast(dims), (F.least("v0", "v1") == F.col("_l")) & (F.greatest("v0", "v1") == F.col("_h")), "left")
    use = (F.col("x") < least_x) & (F.col("s_nom") > 0) & F.col("_x").isNotNull()
    return out.withColumn("r", F.when(use, F.col("_r")).otherwise(F.col("r"))).withColumn("x", F.when(use, F.col("_x")).otherwise(F.col("x"))).drop("_l", "_h", "_r", "_x")
