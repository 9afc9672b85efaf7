"""Hourly series: profiles, resampling, filling gaps, smoothing, arrays to rows and back."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOURS = 8760


def hours(spark: SparkSession, year: int = 2025, n: int = HOURS) -> DataFrame:
    """hour, ts, doy, hod, dow (Monday 0) and month of a year's hours."""
    base = spark.range(n).select(F.col("id").cast("int").alias("hour"), F.expr(f"timestamp '{year}-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id as int))").alias("ts"))
    return base.select("hour", "ts", F.dayofyear("ts").alias("doy"), F.hour("ts").alias("hod"), F.weekday("ts").alias("dow"), F.month("ts").alias("month"))


def bell(x: Column, middle: float, width: float) -> Column:
    return F.exp(-0.5 * F.pow((x - middle) / width, F.lit(2)))


def standard_profiles(spark: SparkSession, year: int = 2025) -> DataFrame:
    """(hour, household, cts, industry): standard load profiles that add up to 1 over the year."""
    h, doy, hod, dow = hours(spark, year), F.col("doy"), F.col("hod").cast("double"), F.col("dow")
    season = F.cos(2 * math.pi * (doy - 15) / 365)
    week = lambda saturday, sunday: F.when(dow == 6, sunday).when(dow == 5, saturday).otherwise(1.0)
    shapes = {
        "household": (1 + 0.20 * season) * (0.50 + 0.20 * bell(hod, 7.5, 1.8) + 0.35 * bell(hod, 18.5, 2.2) + 0.10 * bell(hod, 12.5, 2.0)) * week(0.90, 0.80 + 0.05 * bell(hod, 12, 3)),
        "cts": (1 + 0.08 * season) * (0.40 + 0.55 * bell(hod, 13, 4.0) + 0.15 * bell(hod, 10, 2.0)) * week(0.70, 0.50),
        "industry": (1 + 0.03 * season) * (0.85 + 0.15 * bell(hod, 14, 6.0)) * week(0.85, 0.75),
    }
    raw = h.select("hour", *(v.alias(k) for k, v in shapes.items()))
    whole = raw.agg(*(F.sum(k).alias(f"_{k}") for k in shapes))
    return raw.crossJoin(F.broadcast(whole)).select("hour", *((F.col(k) / F.col(f"_{k}")).alias(k) for k in shapes))


def load_series(loads: DataFrame, profiles: DataFrame, household_share: float = 134.0 / 258.0) -> DataFrame:
    """loads (load_id, carrier, annual_mwh) with p_set, an array of hourly MW; carriers without profile are left out.

    The blended household and commerce profile is scaled to add up to 1 again.
    """
    blend = household_share * F.col("household") + (1 - household_share) * F.col("cts")
    long = profiles.select("hour", F.explode(F.create_map(F.lit("residential_cts"), blend, F.lit("industry"), F.col("industry"), F.lit("large_industry"), F.col("industry"))).alias("carrier", "v"))
    arrays = long.groupBy("carrier").agg(F.transform(F.array_sort(F.collect_list(F.struct("hour", "v"))), lambda s: s["v"]).alias("profile"))
    scaled = arrays.withColumn("profile", F.transform("profile", lambda v: v / F.aggregate("profile", F.lit(0.0), lambda a, x: a + x)))
    return loads.join(F.broadcast(scaled), "carrier").withColumn("p_set", F.transform("profile", lambda v: v * F.col("annual_mwh"))).drop("profile")


def to_rows(df: DataFrame, id_col: str, series: str, value: str = "value") -> DataFrame:
    """One row per hour of an array column."""
    return df.select(id_col, F.posexplode(series).alias("hour", value))


def to_arrays(df: DataFrame, id_col: str, value: str, hour: str = "hour") -> DataFrame:
    """One array per id, in order of the hour."""
    return df.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct(hour, value))), lambda s: s[value]).alias("series"))


def mean_profiles(df: DataFrame, keys: Sequence[str], series: str, weight: str) -> DataFrame:
    """Per group the mean of its series weighted by ``weight``, hour by hour."""
    long = df.select(*keys, weight, F.posexplode(series).alias("hour", "_v"))
    total = F.sum(weight)
    means = long.groupBy(*keys, "hour").agg(F.when(total > 0, F.sum(F.col(weight) * F.col("_v")) / total).otherwise(F.avg("_v")).alias("_m"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("hour", "_m"))), lambda s: s["_m"]).alias("series"))


def hourly_mean(df: DataFrame, ts: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.date_trunc("hour", ts).alias("hr")).agg(F.avg(value).alias("mean"))


def blocks_of_hours(df: DataFrame, id_col: str, n: int, whole: bool = True) -> DataFrame:
    """Means of blocks of n hours (24: days; 168: weeks); incomplete blocks go if ``whole``."""
    out = df.groupBy(id_col, F.floor(F.col("hour") / n).cast("int").alias("block")).agg(F.avg("value").alias("mean"), F.count("*").alias("_n"))
    return (out.where(F.col("_n") == n) if whole else out).drop("_n")


def moving_average(value: str, n: int, keys: Sequence[str], hour: str = "hour") -> Column:
    """The centred mean of n hours, missing neighbours counting as 0 (an even window looks one hour further back)."""
    w = Window.partitionBy(*keys).orderBy(hour).rowsBetween(-(n // 2), n - 1 - n // 2)
    return F.coalesce(F.sum(value).over(w), F.lit(0.0)) / n


def nearest_in_time(grid: DataFrame, series: DataFrame, tolerance_s: int, keys: Sequence[str] = ()) -> DataFrame:
    """For each grid (keys, ts) the value of the nearest series (keys, ts, value) row within the tolerance; the earlier one on a tie.

    One union and two running windows instead of a range join.
    """
    both = grid.select(*keys, "ts", F.lit(True).alias("_g"), F.lit(None).cast("double").alias("_v")).unionByName(series.where("value is not null").select(*keys, "ts", F.lit(False).alias("_g"), F.col("value").cast("double").alias("_v")))
    point = F.when(~F.col("_g"), F.struct(F.col("ts").alias("t"), F.col("_v").alias("v")))
    back = Window.partitionBy(*keys).orderBy("ts", "_g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*keys).orderBy(F.desc("ts"), "_g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_b", F.last(point, ignorenulls=True).over(back)).withColumn("_a", F.last(point, ignorenulls=True).over(ahead)).where("_g")
    s = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    db, da = s(F.col("ts")) - s(F.col("_b.t")), s(F.col("_a.t")) - s(F.col("ts"))
    use_b = db.isNotNull() & (db <= tolerance_s) & (da.isNull() | (db <= da))
    return found.select(*keys, "ts", F.when(use_b, F.col("_b.v")).when(da <= tolerance_s, F.col("_a.v")).alias("value"))


def interpolated(df: DataFrame, keys: Sequence[str] = (), at: str = "hour", value: str = "value") -> DataFrame:
    """Nulls filled on the line between the values around them; the first and last value hold at the edges."""
    back = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(at).cast("double").alias("t"), F.col(value).alias("v")))
    b, a = F.last(point, ignorenulls=True).over(back), F.first(point, ignorenulls=True).over(ahead)
    out = df.withColumn("_b", b).withColumn("_a", a)
    t = (F.col(at).cast("double") - F.col("_b.t")) / (F.col("_a.t") - F.col("_b.t"))
    line = F.when(F.col("_b").isNull(), F.col("_a.v")).when(F.col("_a").isNull(), F.col("_b.v")).otherwise(F.col("_b.v") + t * (F.col("_a.v") - F.col("_b.v")))
    return out.withColumn(value, F.coalesce(F.col(value), line)).drop("_b", "_a")


def autoregressive(noise: str, factor: float = 0.85) -> Column:
    """n[h] = factor * n[h-1] + e[h] over an array of e."""
    start = F.struct(F.lit(0.0).alias("n"), F.array().cast("array<double>").alias("out"))
    step = lambda a, e: F.struct((a["n"] * factor + e).alias("n"), F.array_append(a["out"], a["n"] * factor + e).alias("out"))
    return F.aggregate(noise, start, step, lambda a: a["out"])


def capacity_factor(generation: Column, installed: Column) -> Column:
    return F.when(installed > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), generation / installed)))


def curtailment(potential: Column, realised: Column) -> Column:
    return F.greatest(F.lit(0.0), potential - realised)


def clamped(low: Column, value: Column, high: Column) -> Column:
    return F.least(F.greatest(low, value), high)


def full_matrix(ids: DataFrame, id_col: str, series: DataFrame, n: int, default: float = 1.0) -> DataFrame:
    """(id, hour, value) for all ids and hours below n; ``default`` where a series has nothing."""
    grid = ids.select(id_col).withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    s = series.select(F.col(id_col).alias("_i"), F.col("hour").alias("_h"), F.col("value").alias("_v"))
    return grid.join(s, (F.col(id_col) == F.col("_i")) & (F.col("hour") == F.col("_h")), "left").select(id_col, "hour", F.coalesce("_v", F.lit(default)).alias("value"))


def weather_state(n: int = HOURS, seed: int = 42) -> dict[str, np.ndarray]:
    """Standardised cloud and wind noise: white noise smoothed over 96 and 288 hours (fixed seed, small, on the driver)."""
    rng = np.random.RandomState(seed)
    out = {}
    for name, window in (("cloud", 96), ("wind", 288)):
        x = np.convolve(rng.standard_normal(n), np.ones(window) / window, mode="same")
        out[name] = (x - x.mean()) / x.std()
    return out


def solar_factor(lat: Column, doy: Column, hod: Column, cloud: Column) -> Column:
    """Sine of the sun's height, dimmed by clouds; 0 at night. Scale to a yearly mean afterwards."""
    tilt = F.radians(23.45 * F.sin(2 * math.pi * (284 + doy) / 365))
    angle = F.radians(15.0 * (hod - 12))
    height = F.sin(F.radians(lat)) * F.sin(tilt) + F.cos(F.radians(lat)) * F.cos(tilt) * F.cos(angle)
    return F.greatest(F.lit(0.0), height) * F.least(F.lit(1.0), F.greatest(F.lit(0.15), 0.7 - 0.25 * cloud))


def wind_factor(speed: Column, cut_in: float = 3.0, rated: float = 12.0, cut_out: float = 25.0) -> Column:
    """Cubic between cut-in and rated speed, 1 up to cut-out, 0 elsewhere."""
    cubic = (F.pow(speed, F.lit(3)) - cut_in**3) / (rated**3 - cut_in**3)
    return F.when((speed < cut_in) | (speed > cut_out), 0.0).when(speed >= rated, 1.0).otherwise(cubic)


def scaled_to_mean(df: DataFrame, keys: Sequence[str], value: str, mean: Column) -> DataFrame:
    """Series scaled to a wanted mean and cut at 1."""
    actual = F.avg(value).over(Window.partitionBy(*keys))
    return df.withColumn(value, F.when(actual > 0, F.least(F.lit(1.0), F.col(value) * mean / actual)).otherwise(0.0))


def first_mondays(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Hours of the seven days from the first Monday of each month."""
    month = F.date_trunc("month", ts)
    monday = F.date_add(month, F.pmod(7 - F.weekday(month), F.lit(7)))
    day = F.to_date(ts)
    return df.where((day >= monday) & (day < F.date_add(monday, 7)))
