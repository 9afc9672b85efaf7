"""Allocation: units to places to nodes, and splits that keep their totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridweave.operators.relational import first_of_list, mode_by


def equal_split(totals: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Split (key, mw, units) over the k nodes (key, bus) of each key: mw / k each, units div k, the rest to the first ones."""
    w = Window.partitionBy(key)
    ranked = nodes.withColumn("_k", F.count("*").over(w)).withColumn("_rn", F.row_number().over(w.orderBy("bus")))
    return totals.join(ranked, key).select(key, "bus", (F.col("mw") / F.col("_k")).alias("mw"), (F.floor(F.col("units") / F.col("_k")) + (F.col("_rn") <= F.col("units") % F.col("_k")).cast("long")).alias("units"))


def share_of(weight: Column, keys: Sequence[str]) -> Column:
    """Weight over its group's total; equal shares where the total is 0."""
    w = Window.partitionBy(*keys)
    total = F.sum(weight).over(w)
    return F.when(total > 0, weight / total).otherwise(1 / F.count("*").over(w))


def proportional_split(totals: DataFrame, nodes: DataFrame, key: str, alpha: Column) -> DataFrame:
    """Split (key, mw) over nodes (key, bus, degree) by degree ** alpha; a missing degree counts as 1."""
    both = totals.join(nodes, key).withColumn("_w", F.pow(F.coalesce(F.col("degree"), F.lit(1)).cast("double"), alpha))
    return both.withColumn("mw", F.col("mw") * share_of(F.col("_w"), [key])).drop("_w")


def split_or_nearest(totals: DataFrame, nodes: DataFrame, key: str, alpha: Column, places: DataFrame, buses: DataFrame) -> DataFrame:
    """proportional_split where a key has nodes; all to the nearest bus of its place (key, x, y) otherwise."""
    from gridweave.operators.spatial import nearest

    inside = proportional_split(totals, nodes, key, alpha).select(key, "bus", "mw")
    left = totals.join(nodes.select(key).distinct(), key, "left_anti")
    found = nearest(left.join(places, key), buses, key)
    return inside.unionByName(left.join(found, key).select(key, F.col("bus_id").alias("bus"), "mw"))


def national_split(total: float, weights: DataFrame, weight: str) -> DataFrame:
    """Column mw: the total by weight, at least 1 each; the grand total is one aggregated row, not a window."""
    w = F.greatest(F.coalesce(F.col(weight), F.lit(1.0)), F.lit(1.0))
    whole = weights.agg(F.sum(w).alias("_all"))
    return weights.crossJoin(F.broadcast(whole)).withColumn("mw", F.lit(float(total)) * w / F.col("_all")).drop("_all")


def border_split(capacity: DataFrame, lines: DataFrame, border: str) -> DataFrame:
    """Split (border, mw) over the buses of its lines (border, bus, s_nom) by share of incident capacity; equal if that is 0."""
    at = lines.groupBy(border, "bus").agg(F.sum("s_nom").alias("_s"))
    return capacity.join(at, border).withColumn("mw", F.col("mw") * share_of(F.col("_s"), [border])).drop("_s")


def disaggregated(dispatch: DataFrame, units: DataFrame, least: float = 1e-3) -> DataFrame:
    """Dispatch (hour, fuel, mw) to units (hour, fuel, unit, p_nom, available): by availability, by p_nom if none is available."""
    w = Window.partitionBy("hour", "fuel")
    live, rated = F.sum("available").over(w), F.sum("p_nom").over(w)
    share = F.when(live > least, F.col("available") / live).when(rated > 0, F.col("p_nom") / rated).otherwise(0.0)
    return units.withColumn("_share", share).join(dispatch, ["hour", "fuel"]).select("hour", "fuel", "unit", (F.col("mw") * F.col("_share")).alias("mw"))


def storage_disaggregated(dispatch: DataFrame, units: DataFrame, round_trip: float = 0.75) -> DataFrame:
    """Discharge (hour, mw) to units (unit, p_nom) by p_nom; idle hours charge evenly what the discharge needs, at most p_nom."""
    rated = units.agg(F.sum("p_nom").alias("_all"))
    need = dispatch.agg((F.sum(F.greatest("mw", F.lit(0.0))) / round_trip).alias("_need"), F.sum((F.col("mw") <= 0).cast("int")).alias("_idle"))
    base = dispatch.crossJoin(F.broadcast(rated)).crossJoin(F.broadcast(need))
    flat = F.when(F.col("_idle") > 0, -F.least(F.col("_need") / F.col("_idle"), F.col("_all"))).otherwise(0.0)
    whole = base.withColumn("_mw", F.when(F.col("mw") > 0, F.col("mw")).otherwise(flat))
    return whole.crossJoin(F.broadcast(units)).select("hour", "unit", (F.col("_mw") * F.col("p_nom") / F.col("_all")).alias("mw"))


def by_headroom(deltas: DataFrame, units: DataFrame) -> DataFrame:
    """(bus, carrier, delta) back to units (bus, carrier, unit, up, down) by the headroom in the delta's direction."""
    both = units.join(deltas, ["bus", "carrier"]).withColumn("_room", F.when(F.col("delta") >= 0, F.col("up")).otherwise(F.col("down")))
    w = Window.partitionBy("bus", "carrier")
    total = F.sum("_room").over(w)
    return both.select("bus", "carrier", "unit", F.when(total > 0, F.col("delta") * F.col("_room") / total).otherwise(0.0).alias("delta"))


def locations(units: DataFrame, locations_: DataFrame, connections: DataFrame, carrier_of: Column) -> DataFrame:
    """Units to one row per location: unit -> location -> first grid connection, then sums and modes.

    units: (unit_id, location_id, carrier_text, kw, x, y); locations_: (location_id,
    connection_list); connections: (connection_id, kv). Keeps units without
    location or connection.
    """
    placed = (
        units.join(locations_.select("location_id", first_of_list("connection_list").alias("_c")), "location_id", "left")
        .join(connections.select(F.col("connection_id").alias("_c"), F.col("kv")), "_c", "left")
        .withColumn("carrier", carrier_of)
    )
    sums = placed.groupBy("location_id").agg(F.sum(F.col("kw") / 1000).alias("mw"), F.count("*").alias("units"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.max("kv").alias("kv"))
    return sums.join(mode_by(placed, ["location_id"], "carrier", "carrier"), "location_id", "left")


def node_totals(matched: DataFrame) -> DataFrame:
    """(bus, carrier): mw and units added, whether any member was estimated."""
    return matched.groupBy("bus", "carrier").agg(F.sum("mw").alias("mw"), F.sum("units").alias("units"), F.bool_or("estimated").alias("estimated"))


def gas_class(v_nom: Column, p_nom: Column) -> Column:
    """Gas units at 380 kV, or of 50 MW and more at 220 kV, are combined-cycle; the others give heat."""
    return F.when((v_nom == 380) | ((v_nom == 220) & (p_nom >= 50)), "gas_ccgt").otherwise("gas_chp")


def relocated(generators: DataFrame, buses: DataFrame, threshold: float, skip: Sequence[str] = (), slack_km: float = 5.0) -> DataFrame:
    """generators (generator_id, carrier, p_nom, bus, x, y, v_nom) with ``new_bus``: big ones below extra-high voltage move.

    They go to the nearest 380 kV bus if it is at most ``slack_km`` farther than the
    nearest 220 kV bus, to that one otherwise; the others keep their bus.
    """
    from gridweave.operators.spatial import nearest

    movers = generators.where((F.col("p_nom") >= threshold) & (F.col("v_nom") < 220) & ~F.col("carrier").isin(list(skip) or [""]))
    d = {kv: nearest(movers, buses.where(F.col("v_nom") == kv), "generator_id").select("generator_id", F.col("bus_id").alias(f"_b{kv}"), F.col("km").alias(f"_d{kv}")) for kv in (380, 220)}
    best = movers.select("generator_id").join(d[380], "generator_id", "left").join(d[220], "generator_id", "left")
    target = F.when(F.col("_b220").isNull() | (F.col("_d380") <= F.col("_d220") + slack_km), F.col("_b380")).otherwise(F.coalesce("_b220", "_b380"))
    return generators.join(best.select("generator_id", target.alias("_to")), "generator_id", "left").withColumn("new_bus", F.coalesce("_to", "bus")).drop("_to")
