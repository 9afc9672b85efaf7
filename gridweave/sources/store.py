"""Scenario-versioned component tables as partitioned Parquet, and the other sources and sinks."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the component tables; inference is never used.
SCHEMAS = {
    "bus": "bus_id long, v_nom double, carrier string, x double, y double, country string",
    "line": "line_id long, bus0 long, bus1 long, carrier string, r double, x double, g double, b double, s_nom double, length double, cables int, v_nom double, num_parallel double, capital_cost double, lifetime double",
    "transformer": "trafo_id long, bus0 long, bus1 long, r double, x double, s_nom double, tap_ratio double, phase_shift double",
    "link": "link_id long, bus0 long, bus1 long, carrier string, p_nom double, length double, efficiency double, p_min_pu double, p_max_pu double",
    "generator": "generator_id long, bus long, carrier string, p_nom double, p_min_pu double, p_max_pu double, marginal_cost double, efficiency double, lifetime double",
    "storage": "storage_id long, bus long, carrier string, p_nom double, max_hours double, efficiency_store double, efficiency_dispatch double",
    "load": "load_id long, bus long, carrier string, p_set double, sign double",
    "load_timeseries": "load_id long, p_set array<double>",
    "generator_timeseries": "generator_id long, p_max_pu array<double>, p_min_pu array<double>",
}


class Store:
    """Components of all scenarios below one folder: ``<root>/<component>/scn_name=<scenario>/``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def read(self, component: str, scenario: str) -> DataFrame:
        """One scenario; only its partition is listed and read. A scenario without the component is empty."""
        return self.read_all(component).where(F.col("scn_name") == scenario)

    def read_all(self, component: str) -> DataFrame:
        schema = T.StructType.fromDDL(SCHEMAS[component] + ", scn_name string")
        path = f"{self.root}/{component}"
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def hours(self, component: str, scenario: str, column: str, start: int, stop: int) -> DataFrame:
        """A series component with ``column`` cut to hours start (from 0) to before stop."""
        return self.read(component, scenario).withColumn(column, F.slice(column, start + 1, stop - start))

    def overwrite(self, component: str, scenario: str, df: DataFrame) -> None:
        """Replace one scenario's rows and nothing else (dynamic partition overwrite)."""
        shaped = conformed(df, SCHEMAS[component]).withColumn("scn_name", F.lit(scenario))
        shaped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scn_name").parquet(f"{self.root}/{component}")

    def append(self, component: str, scenario: str, df: DataFrame) -> None:
        conformed(df, SCHEMAS[component]).withColumn("scn_name", F.lit(scenario)).write.mode("append").partitionBy("scn_name").parquet(f"{self.root}/{component}")

    def copy(self, source: str, target: str, components: Sequence[str] = tuple(SCHEMAS)) -> None:
        """A new scenario with the rows of another, whatever the target held before."""
        for c in components:
            self.overwrite(c, target, self.read(c, source).drop("scn_name"))


def conformed(df: DataFrame, schema: str) -> DataFrame:
    """Columns in order and type of the schema; missing ones are null, others go."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)))


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def by_header(df: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """Columns found by what their header contains: {name: part of the header, letter case aside}; null if none does."""
    out = []
    for name, part in wanted.items():
        hit = next((c for c in df.columns if part.lower() in c.lower()), None)
        out.append((F.col(f"`{hit}`") if hit else F.lit(None).cast("string")).alias(name))
    return df.select(*out)


def json_series(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Cached series files of [epoch milliseconds, value] points: (ts, value), first of each time, within [start, end)."""
    points = spark.read.schema("series array<array<double>>").option("multiLine", True).json(path).select(F.explode("series").alias("p"))
    rows = points.select(F.timestamp_millis(F.col("p")[0].cast("long")).alias("ts"), F.col("p")[1].alias("value"))
    inside = rows.where(F.col("value").isNotNull() & (F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
    return inside.groupBy("ts").agg(F.min("value").alias("value"))


def profile_column(df: DataFrame, names: Sequence[str], least: int = 8760) -> DataFrame | None:
    """(hour, value) from the first of the named columns that exists, or None if there is none or too few rows."""
    hit = next((n for n in names if n in df.columns), None)
    if hit is None or df.count() < least:
        return None
    return df.select("hour", F.col(hit).cast("double").alias("value"))


def features(df: DataFrame, properties: Sequence[str]) -> DataFrame:
    """One GeoJSON feature (text) per row that has a position."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))
    return df.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(F.to_json(feature).alias("feature"))


def json_row(df: DataFrame) -> DataFrame:
    """Rows fit for JSON: infinite and undefined numbers become null, times ISO text."""

    def clean(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias(f.name)
        if isinstance(f.dataType, T.TimestampType):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(f.name)
        return c

    return df.select(*map(clean, df.schema.fields))


def next_version(names: Sequence[str], prefix: str) -> str:
    """prefix_vN with the least N that no name has reached."""
    taken = [int(m[1]) for n in names if (m := re.search(rf"{re.escape(prefix)}_v(\d+)", n))]
    return f"{prefix}_v{max(taken, default=0) + 1}"
