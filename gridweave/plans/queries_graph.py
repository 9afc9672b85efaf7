"""Spatial and graph queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.functions import electrical, scalars
from gridweave.operators import graph, spatial
from gridweave.plans.registry import query


def r6(c):
    return F.round(c, 6)


_KM = "sqrt(pow((p.x - b.x) * 71.5, 2) + pow((p.y - b.y) * 111.0, 2))"
_POINT = "SELECT c_custkey AS id, CAST(6 AS DOUBLE) + CAST((c_custkey * 53) % 1000 AS DOUBLE) * CAST(0.009 AS DOUBLE) AS x, CAST(47.5 AS DOUBLE) + CAST((c_custkey * 29) % 1000 AS DOUBLE) * CAST(0.0075 AS DOUBLE) AS y FROM customer"


def _points(t):
    t.customer.createOrReplaceTempView("customer")
    return t.spark.sql(_POINT)


@query(f"""WITH p AS ({_POINT}), d AS (SELECT p.id, b.bus_id, {_KM} AS km, row_number() OVER (PARTITION BY p.id ORDER BY {_KM}, b.bus_id) AS rn FROM p CROSS JOIN bus b) SELECT id, bus_id, round(km, 6) AS km FROM d WHERE rn = 1""")
def nearest_bus_knn(t):
    return spatial.nearest(_points(t), t.bus, "id", first_km=20).select("id", "bus_id", r6("km").alias("km"))


@query(f"""WITH p AS ({_POINT}), d AS (SELECT p.id, b.bus_id, {_KM} AS km, row_number() OVER (PARTITION BY p.id ORDER BY {_KM}, b.bus_id) AS rn FROM p CROSS JOIN bus b WHERE {_KM} <= 60) SELECT id, CAST(rn AS INTEGER) AS rank, bus_id, round(km, 6) AS km FROM d WHERE rn <= 3""")
def nearest_three_within(t):
    return spatial.nearest_within(_points(t), t.bus, "id", 60, 3).select("id", "rank", F.col("b_bus_id").alias("bus_id"), r6("km").alias("km"))


@query(f"""WITH p AS ({_POINT}), d AS (SELECT p.id, b.bus_id, {_KM} AS km, CASE WHEN b.v_nom = 380 AND {_KM} <= 30 THEN 1 WHEN b.v_nom = 220 AND {_KM} <= 50 THEN 2 ELSE 3 END AS tier FROM p CROSS JOIN bus b WHERE {_KM} <= 80), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, km, bus_id) AS rn FROM d)
    SELECT id, tier, bus_id, round(km, 6) AS km FROM r WHERE rn = 1""")
def tiered_match(t):
    tier = F.when((F.col("b_v_nom") == 380) & (F.col("km") <= 30), 1).when((F.col("b_v_nom") == 220) & (F.col("km") <= 50), 2).otherwise(3)
    return spatial.tiered_within(_points(t), t.bus, "id", 80, tier, ["v_nom"]).withColumn("km", r6("km"))


@query(f"""WITH p AS ({_POINT}), d AS (SELECT p.id, b.bus_id, {_KM} AS km, CASE WHEN b.v_nom = 220 AND {_KM} < 15 THEN 0 ELSE 1 END AS t, CASE b.v_nom WHEN 380 THEN 1 WHEN 220 THEN 2 ELSE 3 END AS o FROM p CROSS JOIN bus b WHERE {_KM} <= 70), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t, km, o, bus_id) AS rn FROM d)
    SELECT id, bus_id, round(km, 6) AS km, t = 0 AS preferred FROM r WHERE rn = 1""")
def preferred_voltage_match(t):
    out = spatial.nearest_preferring(_points(t).withColumn("want", F.lit(220)), t.bus, "id", "want", 70, 15)
    return out.withColumn("km", r6("km"))


@query("""WITH b AS (SELECT bus_id, x, y FROM bus WHERE v_nom = 110) SELECT a.bus_id AS a, c.bus_id AS c, round(2 * 6371 * asin(sqrt(pow(sin(radians(c.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(c.y)) * pow(sin(radians(c.x - a.x) / 2), 2))), 6) AS km FROM b a JOIN b c ON a.bus_id < c.bus_id AND sqrt(pow((a.x - c.x) * 71.5, 2) + pow((a.y - c.y) * 111.0, 2)) <= 40""")
def close_pairs_haversine(t):
    b = t.bus.where("v_nom = 110").select("bus_id", "x", "y")
    near = spatial.radius_join(b, b, 40).where("bus_id < b_bus_id")
    return near.select(F.col("bus_id").alias("a"), F.col("b_bus_id").alias("c"), r6(scalars.haversine_km(F.col("x"), F.col("y"), F.col("b_x"), F.col("b_y"))).alias("km"))


@query("""WITH RECURSIVE b AS (SELECT * FROM bus), e AS (SELECT p.bus_id AS u, b.bus_id AS v FROM b p JOIN b ON p.v_nom = b.v_nom AND p.bus_id <> b.bus_id AND sqrt(pow((p.x - b.x) * 71.5, 2) + pow((p.y - b.y) * 111.0, 2)) <= CASE p.v_nom WHEN 110 THEN 20 ELSE 30 END),
    reach AS (SELECT u AS root, u AS node FROM e UNION SELECT reach.root, e.v FROM reach JOIN e ON reach.node = e.u) SELECT node AS bus_id, min(root) AS cluster FROM reach GROUP BY node""")
def spatial_clusters(t):
    return spatial.spatial_clusters(t.bus, {110: 20, 220: 30, 380: 30})


@query("""WITH RECURSIVE e AS (SELECT bus0 AS u, bus1 AS v FROM stretch UNION SELECT bus1, bus0 FROM stretch), reach AS (SELECT bus_id AS root, bus_id AS node FROM bus UNION SELECT reach.root, e.v FROM reach JOIN e ON reach.node = e.u) SELECT node AS bus, min(root) AS component FROM reach GROUP BY node""")
def connected_components(t):
    return graph.components(t.bus, t.stretch)


@query("""WITH n AS (SELECT DISTINCT bus0 AS a, bus1 AS b FROM stretch UNION SELECT bus1, bus0 FROM stretch) SELECT bus_id AS bus, count(b) AS degree FROM bus LEFT JOIN n ON a = bus_id GROUP BY bus_id""")
def topological_degree(t):
    return graph.topological_degree(t.stretch, t.bus)


@query("SELECT z AS bus, count(*) AS degree FROM (SELECT unnest([bus0, bus1]) AS z FROM line) GROUP BY z")
def connectivity_degree(t):
    return graph.connectivity_degree(t.line)


@query("""WITH n AS (SELECT DISTINCT bus0 AS a, bus1 AS b FROM stretch UNION SELECT bus1, bus0 FROM stretch) SELECT a AS bus_id FROM n WHERE a % 5 <> 0 GROUP BY a HAVING count(*) = 2""")
def degree_two_buses(t):
    return graph.eliminable(t.stretch, t.bus.where("bus_id % 5 = 0"))


@query("""WITH seg AS (SELECT bus0 // 6 AS chain, bus0, 1 / sum(1 / r) AS r, 1 / sum(1 / x) AS x, sum(s_nom) AS s, sum(length * s_nom) / sum(s_nom) AS l FROM stretch GROUP BY bus0)
    SELECT CAST(chain * 6 AS BIGINT) AS bus0, CAST(max(bus0) + 1 AS BIGINT) AS bus1, round(sum(r), 6) AS r, round(sum(x), 6) AS x, min(s) AS s_nom, round(sum(l), 6) AS length FROM seg GROUP BY chain HAVING count(*) > 1""")
def merged_degree_two_chains(t):
    removable = graph.eliminable(t.stretch, t.bus.where("bus_id < 0"))
    out = graph.merged_chains(t.stretch, removable)
    return out.select("bus0", "bus1", r6("r").alias("r"), r6("x").alias("x"), "s_nom", r6("length").alias("length"))


@query("""SELECT line_id FROM stretch WHERE bus0 % 6 <> 0 OR (bus1 % 6 <> 5 AND bus1 <> (SELECT max(bus1) FROM stretch))""")
def lines_of_removed_buses(t):
    return graph.lines_to_delete(t.stretch, graph.eliminable(t.stretch, t.bus.where("bus_id < 0"))).select("line_id")


@query("""WITH c AS (SELECT bus_id, bus_id // 4 AS cluster FROM bus), d AS (SELECT z AS bus, count(*) AS degree FROM (SELECT unnest([bus0, bus1]) AS z FROM line) GROUP BY z)
    SELECT cluster, bus_id AS keeper FROM (SELECT c.*, row_number() OVER (PARTITION BY cluster ORDER BY c.bus_id % 7 <> 0, c.bus_id % 3 <> 0, CASE WHEN c.bus_id % 7 <> 0 AND c.bus_id % 3 <> 0 THEN -degree ELSE 0 END, c.bus_id) AS rn FROM c LEFT JOIN d ON c.bus_id = d.bus) WHERE rn = 1""")
def cluster_keepers(t):
    clusters = t.bus.select("bus_id", F.floor(F.col("bus_id") / 4).alias("cluster"))
    return graph.keepers(clusters, t.bus.where("bus_id % 7 = 0"), t.bus.where("bus_id % 3 = 0"), graph.connectivity_degree(t.line))


@query("""SELECT line_id, bus0, bus1 FROM (SELECT line_id, CASE WHEN bus0 % 2 = 1 THEN bus0 - 1 ELSE bus0 END AS bus0, CASE WHEN bus1 % 2 = 1 THEN bus1 - 1 ELSE bus1 END AS bus1, bus0 = bus1 AS was FROM line) WHERE bus0 <> bus1 OR was""")
def remap_and_drop_loops(t):
    mapping = t.bus.where("bus_id % 2 = 1").select(F.col("bus_id").alias("old_bus"), (F.col("bus_id") - 1).alias("new_bus"))
    return graph.remapped(t.line, mapping).select("line_id", "bus0", "bus1")


@query("""SELECT bus_id AS old_bus, bus_id - bus_id % 4 AS new_bus FROM bus WHERE bus_id % 4 <> 0""".replace("bus_id % 4 <> 0", "bus_id % 2 = 1 OR bus_id % 4 = 2"))
def composed_mapping(t):
    a = t.bus.where("bus_id % 2 = 1").select(F.col("bus_id").alias("old_bus"), (F.col("bus_id") - 1).alias("new_bus"))
    b = t.bus.where("bus_id % 4 = 2").select(F.col("bus_id").alias("old_bus"), (F.col("bus_id") - 2).alias("new_bus"))
    return graph.composed(a, b)


@query("""WITH occupied AS (SELECT bus_id FROM bus WHERE bus_id % 6 = 2) SELECT bus_id FROM bus WHERE bus_id % 6 = 2""")
def dead_ends_pruned(t):
    buses, _ = graph.without_dead_ends(t.bus.select("bus_id"), t.stretch, t.bus.where("bus_id % 6 = 2").select("bus_id"))
    return buses


@query("SELECT bus_id FROM bus WHERE bus_id NOT IN (SELECT bus0 FROM stretch WHERE s_nom > 150) AND bus_id NOT IN (SELECT bus1 FROM stretch WHERE s_nom > 150)")
def isolated_buses(t):
    return graph.isolated(t.bus, t.stretch.where("s_nom > 150")).select("bus_id")


@query("""WITH RECURSIVE e AS (SELECT bus0 AS u, bus1 AS v FROM stretch UNION SELECT bus1, bus0 FROM stretch), reach AS (SELECT bus_id AS root, bus_id AS node FROM bus WHERE bus_id % 4 = 0 UNION SELECT reach.root, e.v FROM reach JOIN e ON reach.node = e.u) SELECT root AS source, node AS target FROM reach WHERE node % 4 = 0 AND root <> node AND node IN (SELECT bus_id FROM bus)""")
def reachable_marked(t):
    return graph.reachable_pairs(t.bus, t.stretch, t.bus.where("bus_id % 4 = 0"))


@query("SELECT country, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM bus GROUP BY country")
def centroids(t):
    return electrical.centroid(t.bus, ["country"]).select("country", r6("x").alias("x"), r6("y").alias("y"))


@query("""WITH c AS (SELECT r_regionkey AS poly_id, 7.0::DOUBLE + r_regionkey AS x0 FROM region), p AS (%s) SELECT p.id, poly_id FROM p JOIN c ON p.y > 48 AND p.y < 52 AND p.x > x0 + (p.y - 48) / 4 AND p.x < x0 + 1 + (p.y - 48) / 4""" % _POINT)
def points_in_polygons(t):
    x0 = F.col("r_regionkey") + F.lit(7.0)
    corner = lambda x, y: F.struct(x.alias("x"), F.lit(y).alias("y"))
    polygons = t.region.select(F.col("r_regionkey").alias("poly_id"), F.array(corner(x0, 48.0), corner(x0 + 1, 48.0), corner(x0 + 2, 52.0), corner(x0 + 1, 52.0)).alias("ring"))
    return spatial.points_in_polygons(_points(t), polygons).select("id", "poly_id")


@query()
def missing_transformers(t):
    none = t.line.where("line_id < 0").select(F.col("line_id").alias("trafo_id"), "bus0", "bus1")
    out = graph.missing_transformers(t.bus, none, km=15)
    return out.select("cluster", F.array_join("bus_ids", ",").alias("buses"))


@query()
def path_matches(t):
    wanted = t.bus.where("bus_id % 6 = 0").select(F.col("bus_id").alias("id"), F.col("bus_id").alias("from_bus"), (F.col("bus_id") + 3).alias("to_bus"), F.lit(12.0).alias("length_km"))
    return graph.paths_between(t.stretch, wanted).select("id", "hops", r6("km").alias("km"))
