"""The read-only query interface: each function answers one request with a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions.scalars import array_total
from gridweave.operators import relational as rel
from gridweave.operators.spatial import points_in_polygons
from gridweave.sources.store import Store, json_row


def list_generators(store: Store, scenario: str, carriers: Sequence[str] | None = None, v_nom: Sequence[float] | None = None, least: float | None = None, most: float | None = None, country: str | None = None, bbox=None, limit: int = 5000) -> DataFrame:
    """Generators with their bus, largest first; at most ``limit`` (1 to 50 000)."""
    gens = rel.conjunction(store.read("generator", scenario), {"carrier": carriers} if carriers else None, {"p_nom": least} if least is not None else None, {"p_nom": most} if most is not None else None)
    buses = rel.conjunction(store.read("bus", scenario), {k: v for k, v in (("v_nom", v_nom), ("country", [country] if country else None)) if v}, bbox=bbox)
    joined = gens.drop("scn_name").join(buses.select(F.col("bus_id").alias("_b"), "v_nom", "country", "x", "y"), F.col("bus") == F.col("_b")).drop("_b")
    return joined.orderBy(F.desc_nulls_last("p_nom"), "generator_id").limit(min(50_000, max(1, limit)))


def generator_carriers(store: Store, scenario: str) -> DataFrame:
    return rel.rollup_by(store.read("generator", scenario), "carrier", "p_nom")


def generator(store: Store, scenario: str, generator_id: int) -> DataFrame:
    one = store.read("generator", scenario).where(F.col("generator_id") == generator_id)
    return json_row(one.join(store.read("bus", scenario).select(F.col("bus_id").alias("bus"), "v_nom", "country", "x", "y"), "bus"))


def list_loads(store: Store, scenario: str, carriers: Sequence[str] | None = None, least: float | None = None, bbox=None, limit: int = 5000) -> DataFrame:
    """Loads with the peak of their series (their set value without one), largest first."""
    loads = rel.conjunction(store.read("load", scenario), {"carrier": carriers} if carriers else None)
    if least is not None:
        loads = loads.where(F.abs("p_set") >= least)
    peaks = store.read("load_timeseries", scenario).select("load_id", F.array_max("p_set").alias("peak"), array_total(F.col("p_set")).alias("annual_mwh"))
    buses = rel.conjunction(store.read("bus", scenario), bbox=bbox).select(F.col("bus_id").alias("bus"), "x", "y", "country")
    out = loads.drop("scn_name").join(peaks, "load_id", "left").join(buses, "bus").withColumn("peak", F.coalesce("peak", F.abs("p_set")))
    return out.orderBy(F.desc_nulls_last(F.abs("p_set")), "load_id").limit(min(50_000, max(1, limit)))


def load_carriers(store: Store, scenario: str) -> DataFrame:
    return rel.rollup_by(store.read("load", scenario).withColumn("p_set", F.abs("p_set")), "carrier", "p_set")


def loads_by_county(store: Store, scenario: str, counties: DataFrame) -> DataFrame:
    """(poly_id, carrier, ...): peak and energy of the loads in each county, with the county's totals."""
    loads = list_loads(store, scenario, limit=50_000)
    placed = points_in_polygons(loads.select("load_id", "carrier", "peak", "annual_mwh", "x", "y"), counties)
    return rel.two_level(placed, "poly_id", "carrier", "peak")


def county_detail(store: Store, scenario: str, counties: DataFrame, county, k: int = 10) -> DataFrame:
    """The k largest buses of one county with their carriers; grouped before the limit, so totals are whole."""
    loads = list_loads(store, scenario, limit=50_000)
    placed = points_in_polygons(loads.select("load_id", "bus", "carrier", "peak", "x", "y"), counties.where(F.col("poly_id") == county))
    return rel.map_by(placed, "bus", "carrier", "peak").orderBy(F.desc("total"), "bus").limit(k)


def topology(store: Store, scenario: str, v_nom: Sequence[float] | None = None, countries: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """buses, lines, transformers and links of the chosen voltages and countries; no bus means no line."""
    buses = rel.conjunction(store.read("bus", scenario), {k: v for k, v in (("v_nom", v_nom), ("country", countries)) if v})
    lines = rel.annotate_parallel(rel.edges_inside(store.read("line", scenario), buses))
    return {"buses": buses, "lines": lines, "transformers": rel.edges_inside(store.read("transformer", scenario), buses), "links": rel.edges_inside(store.read("link", scenario), buses)}


def enriched_topology(store: Store, scenario: str, v_nom: Sequence[float] | None = None, countries: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The same with capacity and load per bus, in total and by carrier."""
    out = topology(store, scenario, v_nom, countries)
    cap = rel.map_by(store.read("generator", scenario), "bus", "carrier", "p_nom").select(F.col("bus").alias("_g"), F.col("total").alias("capacity"), F.col("parts").alias("capacity_by_carrier"))
    load = rel.map_by(store.read("load", scenario).withColumn("p_set", F.abs("p_set")), "bus", "carrier", "p_set").select(F.col("bus").alias("_l"), F.col("total").alias("load"), F.col("parts").alias("load_by_carrier"))
    buses = out["buses"].join(cap, F.col("bus_id") == F.col("_g"), "left").join(load, F.col("bus_id") == F.col("_l"), "left").drop("_g", "_l")
    out["buses"] = buses.withColumn("net", F.coalesce("capacity", F.lit(0.0)) - F.coalesce("load", F.lit(0.0)))
    return out


def bus_detail(store: Store, scenario: str, bus_id: int) -> DataFrame:
    """One bus with the numbers of its lines and transformers."""
    out = store.read("bus", scenario).where(F.col("bus_id") == bus_id)
    for name, component, key in (("line_degree", "line", "line_id"), ("trafo_degree", "transformer", "trafo_id")):
        ends = rel.edge_endpoints(store.read(component, scenario), key).where(F.col("bus") == bus_id).agg(F.count("*").alias(name))
        out = out.crossJoin(F.broadcast(ends))
    return json_row(out.drop("scn_name"))
