"""Checks of a scenario: one row per check, and tables of defects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.operators.graph import components, connectivity_degree, pockets
from gridweave.operators.relational import edge_endpoints, orphans, with_both_ends
from gridweave.operators.spatial import nearest
from gridweave.session import stored


def _check(name: str, bad: DataFrame) -> DataFrame:
    return bad.agg(F.count("*").alias("found")).select(F.lit(name).alias("check"), "found", (F.col("found") == 0).alias("ok"))


def scenario_checks(buses: DataFrame, lines: DataFrame, trafos: DataFrame, units: DataFrame) -> DataFrame:
    """(check, found, ok): duplicate ids, loose ends, self-loops, bad parameters, voltage mismatches, loose parts."""
    ends = with_both_ends(lines, buses, ["v_nom"])
    all_edges = lines.select("bus0", "bus1").unionByName(trafos.select("bus0", "bus1"))
    loose = all_edges.select(F.explode(F.array("bus0", "bus1")).alias("bus"))
    parts = components(buses, all_edges).select("component").distinct()
    checks = [
        _check("duplicate bus ids", buses.groupBy("bus_id").count().where("count > 1")),
        _check("duplicate line ids", lines.groupBy("line_id").count().where("count > 1")),
        _check("edges without bus", orphans(loose, buses, "bus", "bus_id")),
        _check("units without bus", orphans(units, buses, "bus", "bus_id")),
        _check("line loops", lines.where("bus0 = bus1")),
        _check("x not positive", lines.where("x <= 0")),
        _check("s_nom not positive", lines.where("s_nom <= 0")),
        _check("line between voltages", ends.where("v_nom0 <> v_nom1")),
        parts.agg(F.count("*").alias("found")).select(F.lit("islands").alias("check"), "found", (F.col("found") <= 1).alias("ok")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def same_components(before: DataFrame, after: DataFrame) -> DataFrame:
    """Whether two component tables have as many components."""
    a, b = (df.agg(F.countDistinct("component").alias(n)) for df, n in ((before, "n_before"), (after, "n_after")))
    return a.crossJoin(b).withColumn("ok", F.col("n_before") == F.col("n_after"))


def load_balance(loads: DataFrame, demand: DataFrame) -> DataFrame:
    """Annual energy of the loads against what was to be placed, by carrier."""
    a = loads.groupBy("carrier").agg(F.sum("annual_mwh").alias("placed"))
    return a.join(demand.groupBy("carrier").agg(F.sum("annual_mwh").alias("wanted")), "carrier", "full").withColumn("diff_pct", F.when(F.col("wanted") != 0, (F.col("placed") - F.col("wanted")) / F.col("wanted") * 100))


_COLUMNS = ("class", "key", "bus0", "bus1", "value", "hint")


def _defects(df: DataFrame, kind: str, key: Column, value: Column, hint: str, bus0: Column | None = None, bus1: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("long")
    return df.select(F.lit(kind).alias("class"), key.cast("long").alias("key"), (none if bus0 is None else bus0).alias("bus0"), (none if bus1 is None else bus1).alias("bus1"), value.cast("double").alias("value"), F.lit(hint).alias("hint"))


def defects(buses: DataFrame, lines: DataFrame, trafos: DataFrame, units: DataFrame, loads: DataFrame, peak: DataFrame, over: float = 1.0, crowded_mw: float = 1500.0) -> DataFrame:
    """Six classes of defects in one table, worst first within a class.

    A: a pocket behind at most one transformer bus with an overloaded line; B: an overloaded
    line to a dead end; C: a short dummy line; D: units or loads on an isolated bus; E: a
    bus with too much capacity; F: several buses of one voltage at one place. peak: (line_id, mw).
    """
    rated = lines.join(peak, "line_id").withColumn("loading", F.abs("mw") / F.expr("nullif(s_nom, 0)"))
    low = lines.where("v_nom = 110")
    boundary = edge_endpoints(trafos, "trafo_id").select(F.col("bus").alias("bus_id")).distinct()
    of = pockets(low, boundary)
    feeds = of.groupBy("pocket").agg(F.count_if(~F.col("inner")).alias("feeds"), F.count_if("inner").alias("buses"))
    hot = edge_endpoints(rated.where(F.col("loading") > over)).join(of.where("inner"), "bus").groupBy("pocket").agg(F.countDistinct("edge").alias("hot"))
    a = feeds.where("feeds <= 1").join(hot, "pocket")
    degree = connectivity_degree(lines, trafos)
    ends = degree.where("degree = 1").select(F.col("bus").alias("_d"))
    radial = rated.where(F.col("loading") > over)
    touching = edge_endpoints(radial).join(ends, F.col("bus") == F.col("_d"), "left_semi").select("edge").distinct()
    b = radial.join(touching, F.col("line_id") == F.col("edge"), "left_semi")
    c = lines.where("length < 0.05 and x < 0.001")
    placed = units.select("bus", F.col("p_nom").alias("mw")).unionByName(loads.select("bus", F.col("p_set").alias("mw")))
    d = placed.groupBy("bus").agg(F.sum("mw").alias("mw")).join(degree.select(F.col("bus").alias("_b")), F.col("bus") == F.col("_b"), "left_anti")
    e = units.groupBy("bus").agg(F.sum("p_nom").alias("mw")).where(F.col("mw") > crowded_mw)
    f = buses.groupBy(F.round("x", 4).alias("rx"), F.round("y", 4).alias("ry"), "v_nom").agg(F.count("*").alias("n"), F.min("bus_id").alias("bus_id")).where("n > 1")
    parts = [
        _defects(a, "A", F.col("pocket"), F.col("hot"), "second transformer"),
        _defects(b, "B", F.col("line_id"), F.col("loading"), "parallel circuit", F.col("bus0"), F.col("bus1")),
        _defects(c, "C", F.col("line_id"), F.col("length"), "merge ends", F.col("bus0"), F.col("bus1")),
        _defects(d, "D", F.col("bus"), F.col("mw"), "connect bus", F.col("bus")),
        _defects(e, "E", F.col("bus"), F.col("mw"), "spread units", F.col("bus")),
        _defects(f, "F", F.col("bus_id"), F.col("n"), "merge buses", F.col("bus_id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*_COLUMNS).orderBy("class", F.desc("value"), "key")


def generation_audit(units: DataFrame, capacity: DataFrame, plants: DataFrame, family: str = "family", far_km: float = 25.0) -> DataFrame:
    """Units (generator_id, bus, carrier, family, p_nom, v_nom, x, y) with their issues, joined by '; '.

    GHOST: large and no real plant (name, family, mw, x, y) of its family near; AGGREGATION:
    far larger than the nearest; VOLT_MISMATCH: large at low voltage; EVAC_DEFICIT: more than
    the bus's lines carry (capacity: bus, cap); OVERSIZED: beyond any single unit. Plants and
    units without a position are near nothing; of plants equally near the least name counts.
    """
    real = plants.where("x is not null and y is not null").groupBy(F.col(family).alias("_f"), "x", "y").agg(F.min(F.struct(F.col("name").alias("plant"), F.col("mw").alias("plant_mw"))).alias("bus_id"))
    # units of a family at one place have the same nearest plant
    big = units.where("p_nom >= 100").select(F.col(family).alias("_f"), "x", "y").distinct()
    some = big.join(real.select(F.col("_f").alias("_r")).distinct(), F.col("_f") == F.col("_r"), "left_semi")
    places = stored(some.withColumn("_place", F.struct("_f", "x", "y")))
    # the last of seven rings, 4096 times the first, is wider than the map
    found = nearest(places, stored(real), "_place", first_km=25.0, rings=7, same=["_f"])
    best = found.select(F.col("_place._f").alias("_f"), F.col("_place.x").alias("_x"), F.col("_place.y").alias("_y"), F.struct("km", "bus_id.plant", "bus_id.plant_mw").alias("_p"))
    near = (F.col("p_nom") >= 100) & (F.col(family) == F.col("_f")) & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))
    all_ = units.join(best, near, "left").join(capacity.select(F.col("bus").alias("_b"), "cap"), F.col("bus") == F.col("_b"), "left")
    km, mw = F.col("_p.km"), F.col("p_nom")
    issues = F.array_compact(
        F.array(
            F.when((mw >= 100) & (km.isNull() | (km > far_km)), "GHOST"),
            F.when((km <= far_km) & (mw > 1.5 * F.col("_p.plant_mw")), "AGGREGATION"),
            F.when((mw >= 300) & (F.col("v_nom") < 220), "VOLT_MISMATCH"),
            F.when(mw > F.coalesce("cap", F.lit(0.0)), "EVAC_DEFICIT"),
            F.when(mw > 2000, "OVERSIZED"),
        )
    )
    return all_.select("generator_id", "bus", "carrier", "p_nom", F.col("_p.plant").alias("plant"), km.alias("km"), F.array_join(issues, "; ").alias("issues")).where("issues <> ''")


def flow_kpis(flow: DataFrame, lines: DataFrame) -> DataFrame:
    """One row: lines, share ever overloaded, line-hours over 100 %, peak loading."""
    rated = flow.join(lines.select("line_id", "s_nom"), "line_id").withColumn("l", F.abs("mw") / F.expr("nullif(s_nom, 0)"))
    per = rated.groupBy("line_id").agg(F.max("l").alias("peak"), F.count_if(F.col("l") > 1).alias("over"))
    return per.agg(F.count("*").alias("lines"), F.avg((F.col("over") > 0).cast("double")).alias("share_over"), F.sum("over").alias("line_hours"), F.max("peak").alias("peak"))


def by_voltage(buses: DataFrame, lines: DataFrame) -> DataFrame:
    """(v_nom, buses, lines, km, degree1, degree2, degree3): the metrics that builds are compared by."""
    d = connectivity_degree(lines).select(F.col("bus").alias("_b"), "degree")
    b = buses.join(d, F.col("bus_id") == F.col("_b"), "left").groupBy("v_nom").agg(F.count("*").alias("buses"), *(F.count_if(F.col("degree") == k if k < 3 else F.col("degree") >= k).alias(f"degree{k}") for k in (1, 2, 3)))
    l = lines.groupBy(F.col("v_nom").alias("_v")).agg(F.count("*").alias("lines"), F.sum("length").alias("km"))
    return b.join(l, F.col("v_nom") == F.col("_v"), "left").select("v_nom", "buses", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("km", F.lit(0.0)).alias("km"), "degree1", "degree2", "degree3")
