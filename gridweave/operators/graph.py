"""Graph operators on bus and edge tables: degrees, components, chains, merging, pruning, mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions.electrical import parallel_lines, series_lines
from gridweave.operators.components import connected_components
from gridweave.operators.relational import edge_endpoints
from gridweave.session import discard, stored


def simple_edges(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b: self-loops dropped, parallel edges collapsed."""
    return edges.where("bus0 <> bus1").select(F.least("bus0", "bus1").alias("a"), F.greatest("bus0", "bus1").alias("b")).distinct()


def neighbours(edges: DataFrame) -> DataFrame:
    """(bus, other), both ways, of the simple graph."""
    e = simple_edges(edges)
    return e.select(F.col("a").alias("bus"), F.col("b").alias("other")).unionByName(e.select(F.col("b").alias("bus"), F.col("a").alias("other")))


def topological_degree(edges: DataFrame, buses: DataFrame | None = None) -> DataFrame:
    """(bus, degree): number of different neighbours; 0 for buses without any, if buses are given."""
    counts = neighbours(edges).groupBy("bus").agg(F.count("*").alias("degree"))
    if buses is None:
        return counts
    return buses.select("bus_id").join(counts, F.col("bus_id") == F.col("bus"), "left").select(F.col("bus_id").alias("bus"), F.coalesce("degree", F.lit(0)).alias("degree"))


def connectivity_degree(*edge_tables: DataFrame) -> DataFrame:
    """(bus, degree): ends of all edges, parallels and both ends of loops counted."""
    ends = None
    for e in edge_tables:
        part = e.select(F.explode(F.array("bus0", "bus1")).alias("bus"))
        ends = part if ends is None else ends.unionByName(part)
    return ends.groupBy("bus").agg(F.count("*").alias("degree"))


def components(buses: DataFrame, *edge_tables: DataFrame) -> DataFrame:
    """(bus, component) of all buses: the least bus of what each is connected with; isolated buses are their own."""
    links = buses.select(F.col("bus_id").alias("a"), F.col("bus_id").alias("b"))
    for e in edge_tables:
        links = links.unionByName(e.select(F.col("bus0").alias("a"), F.col("bus1").alias("b")))
    return connected_components(links).select(F.col("node").alias("bus"), "component")


def reachable_pairs(buses: DataFrame, edges: DataFrame, marked: DataFrame) -> DataFrame:
    """(source, target): which marked buses each marked bus reaches."""
    of = components(buses, edges).join(marked.select(F.col("bus_id").alias("_m")), F.col("bus") == F.col("_m"), "left_semi")
    a, b = of.select(F.col("bus").alias("source"), "component"), of.select(F.col("bus").alias("target"), "component")
    return a.join(b, "component").where("source <> target").select("source", "target")


def main_island(buses: DataFrame, edges: DataFrame) -> DataFrame:
    """Buses of the component with most buses (ties: least id)."""
    of = stored(components(buses, edges))
    best = of.groupBy("component").agg(F.count("*").alias("n")).agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("_best"))
    return of.join(F.broadcast(best), F.col("component") == F.col("_best"), "left_semi").select(F.col("bus").alias("bus_id"))


def eliminable(edges: DataFrame, protected: DataFrame) -> DataFrame:
    """Buses with exactly two different neighbours that nothing protects."""
    two = topological_degree(edges).where("degree = 2").select(F.col("bus").alias("bus_id"))
    return two.join(protected.select("bus_id"), "bus_id", "left_anti")


def chains(edges: DataFrame, removable: DataFrame) -> DataFrame:
    """(chain, bus): the inner buses of each maximal chain; rings of removable buses only have no ends and are left out.

    A chain is a component of the graph among removable buses, named by its least bus.
    """
    inner = removable.select(F.col("bus_id").alias("_r"))
    both = neighbours(edges).join(inner, F.col("bus") == F.col("_r"), "left_semi")
    inside = both.join(inner, F.col("other") == F.col("_r"), "left_semi")
    found = stored(connected_components(inside.select(F.col("bus").alias("a"), F.col("other").alias("b")).unionByName(removable.select(F.col("bus_id").alias("a"), F.col("bus_id").alias("b")))))
    ends = both.join(inner, F.col("other") == F.col("_r"), "left_anti").select("bus").distinct()
    open_ = found.join(ends, F.col("node") == F.col("bus"), "left_semi").select("component").distinct()
    return found.join(open_, "component").select(F.col("component").alias("chain"), F.col("node").alias("bus"))


def merged_chains(lines: DataFrame, removable: DataFrame) -> DataFrame:
    """One equivalent line per chain: parallels of each segment first, then the segments in series.

    Needs no order of the segments: all rules are sums and minima. Returns chain, bus0, bus1
    (ends, least first) and the electrical columns; chains that come back to where they
    began have equal ends.
    """
    of = stored(chains(lines, removable))
    touched = lines.where("bus0 <> bus1").select("line_id", "bus0", "bus1", "r", "x", "b", "g", "s_nom", "length")
    in_chain = edge_endpoints(touched).join(of, "bus").groupBy("edge").agg(F.min("chain").alias("chain"))
    segments = touched.join(in_chain, F.col("line_id") == F.col("edge")).select("chain", F.least("bus0", "bus1").alias("a"), F.greatest("bus0", "bus1").alias("c"), "r", "x", "b", "g", "s_nom", "length")
    whole = series_lines(parallel_lines(segments, ["chain", "a", "c"]), ["chain"])
    outer = segments.select("chain", F.explode(F.array("a", "c")).alias("bus")).distinct().join(of.select("bus", F.lit(1).alias("_in")), "bus", "left").where("_in is null")
    ends = outer.groupBy("chain").agg(F.min("bus").alias("bus0"), F.max("bus").alias("bus1"))
    return whole.join(ends, "chain")


def lines_to_delete(lines: DataFrame, removable: DataFrame) -> DataFrame:
    """Lines with at least one removed end."""
    ends = edge_endpoints(lines).join(removable.select("bus_id"), F.col("bus") == F.col("bus_id"), "left_semi").select("edge").distinct()
    return lines.join(ends, F.col("line_id") == F.col("edge"), "left_semi")


def protected_buses(buses: DataFrame, trafos: DataFrame, attached: list[DataFrame], substations: list[DataFrame], links: DataFrame | None = None, near_km: float = 1.0, keep_voltage: float = 110.0) -> DataFrame:
    """Buses that must stay: of the lowest voltage, at transformers, links, substations, with units, or near another voltage.

    attached: tables with a column ``bus``; substations: tables with a column ``bus_id``.
    """
    from gridweave.operators.spatial import radius_join

    keys = [buses.where(F.col("v_nom") == keep_voltage).select("bus_id")]
    keys += [e.select(F.explode(F.array("bus0", "bus1")).alias("bus_id")) for e in (trafos, *([links] if links is not None else []))]
    keys += [t.select(F.col("bus").alias("bus_id")) for t in attached]
    keys += [t.select("bus_id") for t in substations]
    near = buses.select("bus_id", "v_nom", "x", "y")
    keys.append(radius_join(near, near, near_km).where("v_nom <> b_v_nom").select("bus_id"))
    out = keys[0]
    for k in keys[1:]:
        out = out.unionByName(k)
    return out.where("bus_id is not null").distinct()


def keepers(clusters: DataFrame, substations: DataFrame, trafo_buses: DataFrame, degree: DataFrame, by_degree: bool = True) -> DataFrame:
    """(cluster, keeper): a substation before a transformer bus before the highest degree; ties to the least bus.

    The degree only counts where a cluster has neither; with ``by_degree`` off the
    least bus stays then. clusters: (bus_id, cluster); the others have bus_id / bus.
    """
    flagged = (
        clusters.join(substations.select(F.col("bus_id").alias("_s")).distinct(), F.col("bus_id") == F.col("_s"), "left")
        .join(trafo_buses.select(F.col("bus_id").alias("_t")).distinct(), F.col("bus_id") == F.col("_t"), "left")
        .join(degree.select(F.col("bus").alias("_d"), "degree"), F.col("bus_id") == F.col("_d"), "left")
    )
    sub, trafo = F.col("_s").isNull().cast("int"), F.col("_t").isNull().cast("int")
    plain = F.when((sub == 1) & (trafo == 1), -F.coalesce("degree", F.lit(0))).otherwise(F.lit(0)) if by_degree else F.lit(0)
    return flagged.groupBy("cluster").agg(F.min_by("bus_id", F.struct(sub.alias("s"), trafo.alias("t"), plain.alias("d"), F.col("bus_id"))).alias("keeper"))


def valid_clusters(clusters: DataFrame, substations: DataFrame, trafo_buses: DataFrame) -> DataFrame:
    """Clusters with at most one substation and at most one transformer bus."""
    counts = (
        clusters.join(substations.select(F.col("bus_id").alias("_s")).distinct(), F.col("bus_id") == F.col("_s"), "left")
        .join(trafo_buses.select(F.col("bus_id").alias("_t")).distinct(), F.col("bus_id") == F.col("_t"), "left")
        .groupBy("cluster")
        .agg(F.count("_s").alias("s"), F.count("_t").alias("t"))
        .where("s < 2 and t < 2")
    )
    return clusters.join(counts.select("cluster"), "cluster", "left_semi")


def split_by_connection(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """(bus_id, cluster): parts of spatial clusters that edges connect; single buses are left out."""
    a = clusters.select(F.col("bus_id").alias("bus0"), F.col("cluster").alias("_c0"))
    b = clusters.select(F.col("bus_id").alias("bus1"), F.col("cluster").alias("_c1"))
    inner = edges.where("bus0 <> bus1").join(a, "bus0").join(b, "bus1").where("_c0 = _c1")
    return connected_components(inner.select(F.col("bus0").alias("a"), F.col("bus1").alias("b"))).select(F.col("node").alias("bus_id"), F.col("component").alias("cluster"))


def representatives(clusters: DataFrame, degree: DataFrame) -> DataFrame:
    """(old_bus, new_bus): every bus to the one of highest degree in its cluster (ties: least id)."""
    d = clusters.join(degree.select(F.col("bus").alias("_d"), "degree"), F.col("bus_id") == F.col("_d"), "left")
    best = d.groupBy("cluster").agg(F.min_by("bus_id", F.struct(-F.coalesce("degree", F.lit(0)), F.col("bus_id"))).alias("new_bus"))
    return clusters.join(best, "cluster").select(F.col("bus_id").alias("old_bus"), "new_bus")


def remapped(edges: DataFrame, mapping: DataFrame, keep_loops: bool = False) -> DataFrame:
    """Edges with their ends mapped; loops that this makes go, loops that were there stay."""
    out = edges.withColumn("_loop", F.col("bus0") == F.col("bus1"))
    for end in ("bus0", "bus1"):
        m = mapping.select(F.col("old_bus").alias("_o"), F.col("new_bus").alias("_n"))
        out = out.join(m, F.col(end) == F.col("_o"), "left").withColumn(end, F.coalesce("_n", end)).drop("_o", "_n")
    return (out if keep_loops else out.where((F.col("bus0") != F.col("bus1")) | F.col("_loop"))).drop("_loop")


def composed(first: DataFrame, second: DataFrame) -> DataFrame:
    """(old_bus, new_bus) of one mapping after the other; what only the second maps stays."""
    b = second.select(F.col("old_bus").alias("_o"), F.col("new_bus").alias("_n"))
    through = first.join(b, F.col("new_bus") == F.col("_o"), "left").select("old_bus", F.coalesce("_n", "new_bus").alias("new_bus"))
    extra = second.select("old_bus", "new_bus").join(first.select("old_bus"), "old_bus", "left_anti")
    return through.unionByName(extra)


def without_dead_ends(buses: DataFrame, lines: DataFrame, occupied: DataFrame, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """Buses and lines after up to ``rounds`` rounds of dropping buses with at most one neighbour that carry nothing.

    Each round is written to the shared folder; one flag per round reaches the driver.
    """
    for _ in range(rounds):
        degree = topological_degree(lines).select(F.col("bus").alias("_b"), "degree")
        bare = buses.select("bus_id").join(occupied.select(F.col("bus_id").alias("_o")), F.col("bus_id") == F.col("_o"), "left_anti")
        drop = stored(bare.join(degree, F.col("bus_id") == F.col("_b"), "left").where("coalesce(degree, 0) <= 1").select(F.col("bus_id").alias("_d")))
        if drop.limit(1).count() == 0:
            break
        buses = stored(buses.join(drop, F.col("bus_id") == F.col("_d"), "left_anti"))
        lines = stored(lines.join(drop, F.col("bus0") == F.col("_d"), "left_anti").join(drop, F.col("bus1") == F.col("_d"), "left_anti"))
        discard(drop)
    return buses, lines


def pockets(lines: DataFrame, boundary: DataFrame) -> DataFrame:
    """(pocket, bus, inner): parts of the line graph behind boundary buses, which belong to every pocket they touch."""
    edge = boundary.select(F.col("bus_id").alias("_x")).distinct()
    inner = lines.join(edge, F.col("bus0") == F.col("_x"), "left_anti").join(edge, F.col("bus1") == F.col("_x"), "left_anti")
    lone = edge_endpoints(lines).select("bus").distinct().join(edge, F.col("bus") == F.col("_x"), "left_anti")
    of = stored(connected_components(inner.select(F.col("bus0").alias("a"), F.col("bus1").alias("b")).unionByName(lone.select(F.col("bus").alias("a"), F.col("bus").alias("b")))))
    rim = neighbours(lines).join(edge, F.col("bus") == F.col("_x"), "left_semi").join(of, F.col("other") == F.col("node")).select(F.col("component").alias("pocket"), "bus", F.lit(False).alias("inner")).distinct()
    return of.select(F.col("component").alias("pocket"), F.col("node").alias("bus"), F.lit(True).alias("inner")).unionByName(rim)


def missing_transformers(buses: DataFrame, trafos: DataFrame, km: float = 1.0) -> DataFrame:
    """(cluster, voltages, bus_ids): places with several voltages and no transformer at any of their buses."""
    from gridweave.operators.spatial import radius_join

    near = buses.select("bus_id", "v_nom", "x", "y")
    of = stored(connected_components(radius_join(near, near, km).where("bus_id < b_bus_id").select(F.col("bus_id").alias("a"), F.col("b_bus_id").alias("b"))).withColumnRenamed("component", "cluster"))
    with_v = of.join(near, F.col("node") == F.col("bus_id"))
    served = with_v.join(edge_endpoints(trafos, "trafo_id").select(F.col("bus").alias("_t")), F.col("bus_id") == F.col("_t"), "left_semi").select("cluster").distinct()
    return with_v.join(served, "cluster", "left_anti").groupBy("cluster").agg(F.array_sort(F.collect_set("v_nom")).alias("voltages"), F.array_sort(F.collect_list("bus_id")).alias("bus_ids")).where("size(voltages) > 1")


def inserted_transformers(missing: DataFrame, buses: DataFrame, degree: DataFrame, first_id: int) -> DataFrame:
    """(trafo_id, bus0, bus1, v0, v1): per place and pair of neighbouring voltages one, between the best-connected buses."""
    members = missing.select("cluster", F.explode("bus_ids").alias("bus_id")).join(buses.select("bus_id", "v_nom"), "bus_id").join(degree.select(F.col("bus").alias("_d"), "degree"), F.col("bus_id") == F.col("_d"), "left")
    best = members.groupBy("cluster", "v_nom").agg(F.min_by("bus_id", F.struct(-F.coalesce("degree", F.lit(0)), F.col("bus_id"))).alias("bus"))
    from pyspark.sql.window import Window

    w = Window.partitionBy("cluster").orderBy("v_nom")
    pairs = best.withColumn("bus1", F.lead("bus").over(w)).withColumn("v1", F.lead("v_nom").over(w)).where("bus1 is not null")
    numbered = Window.orderBy("cluster", "v_nom")  # one row per missing transformer: few
    return pairs.select((F.row_number().over(numbered) - 1 + first_id).alias("trafo_id"), F.col("bus").alias("bus0"), "bus1", F.col("v_nom").alias("v0"), "v1")


def isolated(buses: DataFrame, *edge_tables: DataFrame) -> DataFrame:
    """Buses at the end of no edge."""
    ends = None
    for e in edge_tables:
        part = e.select(F.explode(F.array("bus0", "bus1")).alias("_e"))
        ends = part if ends is None else ends.unionByName(part)
    return buses.join(ends, F.col("bus_id") == F.col("_e"), "left_anti")


def split_edges(lines: DataFrame, buses: DataFrame, chosen: DataFrame, bus_base: int, trafo_base: int, angle: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Put a phase shifter into each chosen line (line_id): a new bus beside bus0, a transformer to it, the line behind it.

    Returns the new buses, all lines, and the new transformers.
    """
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.orderBy("line_id"))  # the chosen lines are a short list
    picked = chosen.select("line_id").distinct().withColumn("_n", n)
    at = picked.join(lines.select("line_id", "bus0", "s_nom"), "line_id").join(buses.select(F.col("bus_id").alias("_b"), "x", "y", "v_nom"), F.col("bus0") == F.col("_b"))
    new_buses = at.select((F.col("_n") - 1 + bus_base).alias("bus_id"), "v_nom", "x", "y")
    shifters = at.select((F.col("_n") - 1 + trafo_base).alias("trafo_id"), "bus0", (F.col("_n") - 1 + bus_base).alias("bus1"), "s_nom", F.lit(angle).alias("phase_shift"))
    moved = lines.join(picked.select(F.col("line_id").alias("_l"), "_n"), F.col("line_id") == F.col("_l"), "left").withColumn("bus0", F.coalesce(F.col("_n") - 1 + bus_base, F.col("bus0"))).drop("_l", "_n")
    return new_buses, moved, shifters


def upgraded(lines: DataFrame, moves: DataFrame, kv: float, r_km: float, x_km: float, b_km: float) -> DataFrame:
    """Lines of ``moves`` (line_id, new0, new1) at a new voltage: other ends, r, x and b from their length."""
    m = moves.select(F.col("line_id").alias("_l"), "new0", "new1")
    out = lines.join(m, F.col("line_id") == F.col("_l"), "left").withColumn("_up", F.col("_l").isNotNull())
    for c, value in (("bus0", F.coalesce("new0", "bus0")), ("bus1", F.coalesce("new1", "bus1")), ("v_nom", F.lit(kv)), ("r", F.col("length") * r_km), ("x", F.col("length") * x_km), ("b", F.col("length") * b_km)):
        out = out.withColumn(c, F.when(F.col("_up"), value).otherwise(F.col(c)))
    return out.drop("_l", "new0", "new1", "_up")


def fixed_transformers(trafos: DataFrame, buses: DataFrame, fixes: DataFrame, first_id: int) -> DataFrame:
    """Existing transformers and the fixes (bus0, bus1, s_nom, x, r, distance_km) whose ends both exist; x grows with the distance."""
    from pyspark.sql.window import Window

    from gridweave.operators.relational import edges_inside

    good = edges_inside(fixes, buses).withColumn("trafo_id", F.row_number().over(Window.orderBy("bus0", "bus1")) - 1 + first_id)
    return trafos.select("trafo_id", "bus0", "bus1", "s_nom", "x", "r").unionByName(good.select("trafo_id", "bus0", "bus1", "s_nom", (F.col("x") + F.col("distance_km") * 0.0003).alias("x"), "r"))


def paths_between(lines: DataFrame, wanted: DataFrame, hops: int = 7, least: float = 0.3, most: float = 3.0) -> DataFrame:
    """For wanted (id, from_bus, to_bus, length_km): the path of at most ``hops`` lines whose length fits best.

    Paths grow hop by hop, never twice through a bus, and are dropped as soon as they
    are longer than ``most`` times the wanted length. Returns id, hops, km, ratio, lines.
    """
    step = lines.where("bus0 <> bus1").select("line_id", F.col("bus0").alias("_a"), F.col("bus1").alias("_b"), "length")
    step = step.unionByName(step.select("line_id", F.col("_b").alias("_a"), F.col("_a").alias("_b"), "length"))
    front = wanted.select("id", "to_bus", F.col("length_km").alias("_want"), F.col("from_bus").alias("_at"), F.array("from_bus").alias("_seen"), F.array().cast("array<bigint>").alias("_lines"), F.lit(0.0).alias("_km"))
    done = None
    for hop in range(1, hops + 1):
        front = front.join(step, F.col("_at") == F.col("_a")).where(~F.array_contains("_seen", F.col("_b")) & (F.col("_km") + F.col("length") <= F.col("_want") * most))
        front = stored(front.select("id", "to_bus", "_want", F.col("_b").alias("_at"), F.array_append("_seen", F.col("_b")).alias("_seen"), F.array_append("_lines", F.col("line_id")).alias("_lines"), (F.col("_km") + F.col("length")).alias("_km")))
        hit = front.where((F.col("_at") == F.col("to_bus")) & (F.col("_km") >= F.col("_want") * least)).select("id", F.lit(hop).alias("hops"), F.col("_km").alias("km"), (F.col("_km") / F.col("_want")).alias("ratio"), F.col("_lines").alias("lines"))
        done = hit if done is None else done.unionByName(hit)
        front = front.where(F.col("_at") != F.col("to_bus"))
    return done.groupBy("id").agg(F.min(F.struct(F.abs(F.log("ratio")).alias("_off"), "hops", "km", "ratio", "lines")).alias("_p")).select("id", *(F.col(f"_p.{c}").alias(c) for c in ("hops", "km", "ratio", "lines")))


def stub_relief(generators: DataFrame, capacity: DataFrame) -> DataFrame:
    """generators with ``moved``: the largest leave a node until the rest fit its line capacity (bus, cap)."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("bus").orderBy(F.desc("p_nom"), "generator_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("p_nom").over(w), F.lit(0.0))
    total = F.sum("p_nom").over(Window.partitionBy("bus"))
    return generators.join(capacity.select(F.col("bus").alias("_b"), "cap"), F.col("bus") == F.col("_b"), "left").withColumn("moved", F.coalesce(total - before > F.col("cap"), F.lit(False))).drop("_b", "cap")
