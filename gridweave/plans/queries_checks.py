"""Validation, entity matching, streaming and the query interface on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.operators import entities, validate
from gridweave.plans.registry import query


def r6(c):
    return F.round(c, 6)


def _none_trafos(t):
    return t.stretch.where("line_id < 0").select(F.col("line_id").alias("trafo_id"), "bus0", "bus1")


@query("""WITH RECURSIVE e AS (SELECT bus0 AS u, bus1 AS v FROM stretch UNION SELECT bus1, bus0 FROM stretch), reach AS (SELECT bus_id AS root, bus_id AS node FROM bus UNION SELECT reach.root, e.v FROM reach JOIN e ON reach.node = e.u), isl AS (SELECT count(DISTINCT c) AS n FROM (SELECT node, min(root) AS c FROM reach GROUP BY node)),
    f AS (SELECT 'duplicate bus ids' AS "check", 0::BIGINT AS found UNION ALL SELECT 'duplicate line ids', (SELECT count(*) FROM (SELECT line_id FROM stretch GROUP BY line_id HAVING count(*) > 1)) UNION ALL SELECT 'edges without bus', 0 UNION ALL SELECT 'units without bus', (SELECT count(*) FROM gen WHERE gen.bus NOT IN (SELECT bus_id FROM bus)) UNION ALL SELECT 'line loops', 0
    UNION ALL SELECT 'x not positive', 0 UNION ALL SELECT 's_nom not positive', 0 UNION ALL SELECT 'line between voltages', (SELECT count(*) FROM stretch JOIN bus a ON bus0 = a.bus_id JOIN bus b ON bus1 = b.bus_id WHERE a.v_nom <> b.v_nom) UNION ALL SELECT 'islands', n FROM isl)
    SELECT "check", found, CASE WHEN "check" = 'islands' THEN found <= 1 ELSE found = 0 END AS ok FROM f""")
def scenario_checks(t):
    return validate.scenario_checks(t.bus, t.stretch, _none_trafos(t), t.gen)


@query("""WITH d AS (SELECT z, count(*) AS degree FROM (SELECT unnest([bus0, bus1]) AS z FROM line) GROUP BY z), b AS (SELECT v_nom, count(*) AS buses, count(*) FILTER (degree = 1) AS degree1, count(*) FILTER (degree = 2) AS degree2, count(*) FILTER (degree >= 3) AS degree3 FROM bus LEFT JOIN d ON bus_id = z GROUP BY v_nom), l AS (SELECT v_nom, count(*) AS lines, sum(length) AS km FROM line GROUP BY v_nom)
    SELECT b.v_nom, buses, coalesce(lines, 0) AS lines, coalesce(km, 0) AS km, degree1, degree2, degree3 FROM b LEFT JOIN l ON b.v_nom = l.v_nom""")
def metrics_by_voltage(t):
    return validate.by_voltage(t.bus, t.line)


@query("""WITH r AS (SELECT line_id, abs(mw) / nullif(s_nom, 0) AS l FROM (SELECT load_id AS line_id, mw FROM ev) f JOIN line USING (line_id)), p AS (SELECT line_id, max(l) AS peak, count(*) FILTER (l > 1) AS over FROM r GROUP BY line_id)
    SELECT count(*) AS lines, round(avg(CASE WHEN over > 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS share_over, CAST(sum(over) AS BIGINT) AS line_hours, round(max(peak), 6) AS peak FROM p""".replace(" over", " ov").replace("(over", "(ov"))
def flow_kpis(t):
    out = validate.flow_kpis(t.ev.select(F.col("load_id").alias("line_id"), "mw"), t.line)
    return out.select("lines", r6("share_over").alias("share_over"), "line_hours", r6("peak").alias("peak"))


@query()
def topology_defects(t):
    peak = t.stretch.select("line_id", (F.col("s_nom") * (F.col("line_id") % 5) / 3).alias("mw"))
    loads = t.ev.groupBy((F.col("load_id") % 100).alias("bus")).agg(F.avg("mw").alias("p_set"))
    lines = t.stretch.withColumn("v_nom", F.lit(110))
    return validate.defects(t.bus, lines, _none_trafos(t), t.gen, loads, peak, crowded_mw=500).select("class", "key", r6("value").alias("value"))


@query()
def generation_audit(t):
    units = t.gen.join(t.bus.select("bus_id", "v_nom", "x", "y"), F.col("bus") == F.col("bus_id")).withColumn("family", F.substring("carrier", 1, 5)).withColumn("p_nom", F.col("p_nom") * 12)
    plants = t.supplier.select(F.col("s_name").alias("name"), F.lit("PROMO").alias("family"), F.lit(200.0).alias("mw"), (F.col("s_suppkey") % 9 + 6.0).alias("x"), (F.col("s_suppkey") % 7 + 48.0).alias("y"))
    capacity = t.stretch.groupBy(F.col("bus0").alias("bus")).agg(F.sum("s_nom").alias("cap"))
    return validate.generation_audit(units, capacity, plants).select("generator_id", "plant", r6("km").alias("km"), "issues")


@query("""WITH p AS (SELECT s_name AS name, 'T' || CAST(s_nationkey % 4 AS VARCHAR) AS tso, s_suppkey AS k FROM supplier), r AS (SELECT p.name, min(c.c_custkey) AS ref_id FROM p JOIN customer c ON lower(trim(replace(p.name, 'Supplier', 'Customer'))) = lower(trim(c.c_name)) GROUP BY p.name) SELECT p.name, r.ref_id FROM p LEFT JOIN r ON p.name = r.name""")
def exact_entity_match(t):
    places = t.supplier.select(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("name"), F.col("s_name").alias("own"))
    reference = t.customer.select(F.col("c_custkey").alias("ref_id"), F.col("c_name").alias("name"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    return entities.exact_tier(places, reference).select(F.col("own").alias("name"), "ref_id")


@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v <> b.v THEN 'changed' ELSE 'same' END AS status FROM (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 10 <> 1) a FULL JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_partkey % 10 <> 2) b ON a.k = b.k""")
def version_differences(t):
    old = t.part.where("p_partkey % 10 <> 1").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    new = t.part.where("p_partkey % 10 <> 2").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("v"))
    return entities.version_flags(old, new, "k", ["v"])


@query("SELECT carrier, hr, round(avg(mw), 6) AS mean, count(*) AS n FROM ev GROUP BY carrier, hr")
def streaming_hourly_mean(t):
    from gridweave.streaming import hourly

    stream = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    out = hourly.run_to_end(hourly.hourly_means(stream), f"gw_hourly_{abs(hash(t.dir)) % 10**8}", "complete")
    return out.select("carrier", F.col("hr").cast("timestamp_ntz").alias("hr"), r6("mean").alias("mean"), "n")
