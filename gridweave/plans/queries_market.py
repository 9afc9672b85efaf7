"""Allocation, dispatch and network physics on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.functions import scalars
from gridweave.operators import allocation, market, network
from gridweave.operators import relational as rel
from gridweave.plans.registry import query
from gridweave.session import stored


def r6(c):
    return F.round(c, 6)


@query("""WITH n AS (SELECT n_nationkey AS key, c_custkey AS bus, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn, count(*) OVER (PARTITION BY c_nationkey) AS k FROM nation JOIN customer ON c_nationkey = n_nationkey), u AS (SELECT s_nationkey AS key, round(sum(s_acctbal), 6) AS mw, count(*) * 100 + 7 AS units FROM supplier GROUP BY s_nationkey)
    SELECT u.key, bus, round(mw / k, 6) AS mw, units // k + CASE WHEN rn <= units % k THEN 1 ELSE 0 END AS units FROM u JOIN n ON u.key = n.key""")
def equal_split_remainder(t):
    totals = t.supplier.groupBy(F.col("s_nationkey").alias("key")).agg(F.round(F.sum("s_acctbal"), 6).alias("mw"), (F.count("*") * 100 + 7).alias("units"))
    nodes = t.customer.select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("bus"))
    return allocation.equal_split(totals, nodes, "key").withColumn("mw", r6("mw"))


@query("""WITH d AS (SELECT bus0 AS bus, count(*) AS degree FROM line GROUP BY bus0), n AS (SELECT country, bus_id, pow(coalesce(degree, 1)::DOUBLE, 1.5) AS w FROM bus LEFT JOIN d ON d.bus = bus_id) SELECT country, bus_id AS bus, round(1000 * w / sum(w) OVER (PARTITION BY country), 6) AS mw FROM n""")
def proportional_split(t):
    degree = t.line.groupBy("bus0").agg(F.count("*").alias("degree"))
    nodes = t.bus.join(degree, F.col("bus_id") == F.col("bus0"), "left").select("country", F.col("bus_id").alias("bus"), "degree")
    totals = t.bus.select("country").distinct().withColumn("mw", F.lit(1000.0))
    return allocation.proportional_split(totals, nodes, "country", F.lit(1.5)).select("country", "bus", r6("mw").alias("mw"))


@query("SELECT generator_id, round(5000 * greatest(coalesce(p_nom, 1), 1) / (SELECT sum(greatest(coalesce(p_nom, 1), 1)) FROM gen), 6) AS mw FROM gen")
def national_share(t):
    return allocation.national_split(5000, t.gen, "p_nom").select("generator_id", r6("mw").alias("mw"))


@query("""WITH s AS (SELECT country, bus0, sum(s_nom) AS s FROM line JOIN bus ON bus0 = bus_id GROUP BY country, bus0) SELECT country, bus0 AS bus, round(800 * s / sum(s) OVER (PARTITION BY country), 6) AS mw FROM s""")
def border_capacity_share(t):
    at = t.line.join(t.bus.select("bus_id", "country"), F.col("bus0") == F.col("bus_id")).select("country", F.col("bus0").alias("bus"), "s_nom")
    capacity = at.select("country").distinct().withColumn("mw", F.lit(800.0))
    return allocation.border_split(capacity, at, "country").select("country", "bus", r6("mw").alias("mw"))


@query("""WITH u AS (SELECT generator_id % 24 AS hour, carrier AS fuel, generator_id AS unit, p_nom, p_nom * (generator_id % 4) / 4 AS available FROM gen), d AS (SELECT hour, fuel, 100::DOUBLE AS mw FROM u GROUP BY hour, fuel), w AS (SELECT *, sum(available) OVER (PARTITION BY hour, fuel) AS a, sum(p_nom) OVER (PARTITION BY hour, fuel) AS p FROM u)
    SELECT w.hour, w.fuel, unit, round(mw * CASE WHEN a > 0.001 THEN available / a WHEN p > 0 THEN p_nom / p ELSE 0 END, 6) AS mw FROM w JOIN d ON w.hour = d.hour AND w.fuel = d.fuel""")
def availability_disaggregation(t):
    units = t.gen.select((F.col("generator_id") % 24).alias("hour"), F.col("carrier").alias("fuel"), F.col("generator_id").alias("unit"), "p_nom", (F.col("p_nom") * (F.col("generator_id") % 4) / 4).alias("available"))
    dispatch = units.select("hour", "fuel").distinct().withColumn("mw", F.lit(100.0))
    return allocation.disaggregated(dispatch, units).withColumn("mw", r6("mw"))


@query("SELECT bus, carrier, round(sum(p_nom), 6) AS mw, count(*) AS units, bool_or(p_nom < 3) AS estimated FROM gen GROUP BY bus, carrier")
def node_carrier_totals(t):
    return allocation.node_totals(t.gen.select("bus", "carrier", F.col("p_nom").alias("mw"), F.lit(1).alias("units"), (F.col("p_nom") < 3).alias("estimated"))).withColumn("mw", r6("mw"))


@query("SELECT generator_id, CASE WHEN v_nom = 380 OR (v_nom = 220 AND p_nom >= 30) THEN 'gas_ccgt' ELSE 'gas_chp' END AS kind FROM gen JOIN bus ON gen.bus = bus.bus_id".replace("p_nom >= 30", "p_nom >= 50"))
def gas_classification(t):
    return t.gen.join(t.bus, F.col("bus") == F.col("bus_id")).select("generator_id", allocation.gas_class(F.col("v_nom"), F.col("p_nom")).alias("kind"))


_FUEL = "CASE p_partkey % 5 WHEN 0 THEN 'lignite' WHEN 1 THEN 'coal' WHEN 2 THEN 'gas_ccgt' WHEN 3 THEN 'oil' ELSE 'solar' END"


@query(f"""WITH f AS (SELECT p_partkey, {_FUEL} AS fuel FROM part) SELECT p_partkey, fuel, round(CASE fuel WHEN 'lignite' THEN (5.0 + 0.399 * 75) / 0.36 + 4 WHEN 'coal' THEN (13.6 + 0.338 * 75) / 0.40 + 3 WHEN 'gas_ccgt' THEN (40.0 + 0.201 * 75) / 0.58 + 2 WHEN 'oil' THEN (35.0 + 0.267 * 75) / 0.37 + 3 ELSE 0 END, 2)::DOUBLE AS cost FROM f""")
def short_run_cost(t):
    fuel = F.expr(_FUEL)
    return t.part.select("p_partkey", fuel.alias("fuel"), market.srmc(fuel).alias("cost"))


@query("""SELECT carrier, round(mw, 6) AS mw, round(cost, 6) AS cost, round(sum(mw) OVER (ORDER BY cost, carrier ROWS UNBOUNDED PRECEDING), 6) AS cumulative FROM (SELECT carrier, sum(p_nom) AS mw, sum(p_nom * cost) / sum(p_nom) AS cost FROM gen GROUP BY carrier)""")
def merit_order_table(t):
    return market.merit_order(t.gen).select("carrier", *(r6(c).alias(c) for c in ("mw", "cost", "cumulative")))


_CLEAR = "o AS (SELECT generator_id % 24 AS hour, generator_id AS unit, p_nom AS mw, cost AS bid FROM gen), d AS (SELECT *, 1000 - coalesce(sum(mw) OVER (PARTITION BY hour ORDER BY bid, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM o)"


@query(f"WITH {_CLEAR} SELECT hour, unit, round(greatest(0, least(mw, room)), 6) AS dispatched FROM d")
def hourly_clearing(t):
    return _cleared(t).select("hour", "unit", r6("dispatched").alias("dispatched"))


@query(f"WITH {_CLEAR} SELECT hour, round(max(bid) FILTER (greatest(0, least(mw, room)) > 0), 6) AS price, round(sum(greatest(0, least(mw, room))), 6) AS total FROM d GROUP BY hour")
def hourly_price(t):
    return market.clearing_price(_cleared(t)).select("hour", r6("price").alias("price"), r6("total").alias("total"))


def _offers(t):
    return t.gen.select((F.col("generator_id") % 24).alias("hour"), F.col("generator_id").alias("unit"), F.col("p_nom").alias("mw"), F.col("cost").alias("bid"))


def _cleared(t):
    offers = _offers(t)
    return market.cleared(offers, offers.select("hour").distinct().withColumn("mw", F.lit(1000.0)))


_EXPORTS = ((950.0, 40.0), (1000.0, 25.0), (1100.0, 150.0))


@query("""WITH RECURSIVE o AS (SELECT generator_id % 24 AS hour, generator_id AS unit, p_nom AS mw, cost AS bid, generator_id % 10 < 3 AS must,
        row_number() OVER (PARTITION BY generator_id % 24 ORDER BY cost, generator_id) AS k FROM gen),
    d AS (SELECT DISTINCT hour, CAST(hour % 8 * 60 + 5 AS DOUBLE) AS need FROM o),
    x AS (SELECT o.*, (CASE WHEN bid >= 950 THEN 40.0 ELSE 0 END + CASE WHEN bid >= 1000 THEN 25.0 ELSE 0 END + CASE WHEN bid >= 1100 THEN 150.0 ELSE 0 END)::DOUBLE AS called FROM o),
    r AS (SELECT hour, 0::BIGINT AS k, need AS remaining, 0::DOUBLE AS called, 0::DOUBLE AS price, 0::DOUBLE AS ran, false AS done FROM d
        UNION ALL
        SELECT hour, k, room - ran, called, CASE WHEN ran > 0 THEN bid ELSE price END, ran, ran > 0 AND room - ran <= 0 AND NOT must FROM
            (SELECT x.hour, x.k, x.called, x.bid, x.must, r.price, r.remaining + x.called - r.called AS room,
                CASE WHEN r.remaining + x.called - r.called > 0 THEN least(x.mw, r.remaining + x.called - r.called) WHEN x.must THEN x.mw ELSE 0 END AS ran
             FROM r JOIN x ON x.hour = r.hour AND x.k = r.k + 1 WHERE NOT r.done)),
    ends AS (SELECT hour, max_by(price, k) AS price, max(called) AS exported FROM r GROUP BY hour)
    SELECT o.hour, o.unit, round(coalesce(r.ran, 0), 6) AS dispatched, round(ends.price, 6) AS price, round(ends.exported, 6) AS exported FROM o JOIN ends ON ends.hour = o.hour LEFT JOIN r ON r.hour = o.hour AND r.k = o.k""")
def clearing_with_exports(t):
    offers = _offers(t).withColumn("must_run", F.col("unit") % 10 < 3)
    demand = offers.select("hour").distinct().withColumn("mw", (F.col("hour") % 8 * 60 + 5).cast("double"))
    steps = F.array(*(F.struct(F.lit(p).alias("price"), F.lit(m).alias("mw")) for p, m in _EXPORTS))
    exports = demand.select("hour", F.explode(steps).alias("e")).select("hour", "e.*")
    return market.cleared_with_exports(offers, demand, exports).select("hour", "unit", *(r6(c).alias(c) for c in ("dispatched", "price", "exported")))


@query("""WITH q AS (SELECT quantile_cont(mw, 0.6) AS a, quantile_cont(mw, 0.75) AS b, quantile_cont(mw, 0.85) AS c, quantile_cont(mw, 0.93) AS d, quantile_cont(mw, 0.97) AS e, quantile_cont(mw, 0.99) AS f FROM ev)
    SELECT event_id, round(100 * (1 + CASE WHEN mw >= f THEN 0.50 WHEN mw >= e THEN 0.35 WHEN mw >= d THEN 0.25 WHEN mw >= c THEN 0.18 WHEN mw >= b THEN 0.10 WHEN mw >= a THEN 0.05 ELSE 0 END), 6)::DOUBLE AS price FROM ev, q WHERE mw >= 0""")
def scarcity_markup(t):
    return market.markup(t.ev.where("mw >= 0").select("event_id", F.col("mw").alias("residual"), F.lit(100.0).alias("price"))).select("event_id", r6("price").alias("price"))


@query("""WITH c AS (SELECT carrier, generator_id, p_nom, cost, count(*) OVER (PARTITION BY carrier) AS n, row_number() OVER (PARTITION BY carrier ORDER BY cost, generator_id) - 1 AS p FROM gen), k AS (SELECT *, least(15, greatest(1, n // 2)) AS b FROM c),
    x AS (SELECT *, CAST(CASE WHEN p < (n % b) * (n // b + 1) THEN p // (n // b + 1) ELSE n % b + (p - (n % b) * (n // b + 1)) // (n // b) END AS INTEGER) AS bin FROM k) SELECT carrier, bin, sum(p_nom) AS p_nom, round(sum(p_nom * cost) / sum(p_nom), 6) AS cost, count(*) AS units FROM x GROUP BY carrier, bin""")
def commitment_clusters(t):
    return market.commitment_clusters(t.gen).select("carrier", "bin", "p_nom", r6("cost").alias("cost"), F.col("n").alias("units"))


@query()
def unit_commitment_heuristic(t):
    clusters = market.commitment_clusters(t.gen, 3).select(F.lit(1).alias("scenario"), F.concat_ws("-", "carrier", "bin").alias("unit"), "p_nom", "cost", F.lit(0.3).alias("min_share"), F.lit(4.0).alias("min_up"), F.lit(3.0).alias("min_down"), F.lit(0.5).alias("ramp"))
    load = t.spark.range(168).select(F.lit(1).alias("scenario"), F.col("id").cast("int").alias("hour"), (F.lit(20000.0) + 8000 * F.sin(F.col("id") * 0.26)).alias("mw"))
    return market.unit_commitment(clusters, load).select("hour", "unit", r6("mw").alias("mw"), r6("price").alias("price"))


@query("SELECT hour, available, load, available - load AS margin FROM (SELECT generator_id % 24 AS hour, sum(p_nom) AS available FROM gen GROUP BY 1) a JOIN (SELECT generator_id % 24 AS hour, sum(p_nom * 0.5) AS load FROM gen GROUP BY 1) b USING (hour)".replace("0.5)", "0.5::DOUBLE)"))
def capacity_balance(t):
    a = t.gen.select((F.col("generator_id") % 24).alias("hour"), F.col("p_nom").alias("available"))
    return market.balance(a, a.select("hour", (F.col("available") * 0.5).alias("mw")))


@query("SELECT generator_id, CASE WHEN p_nom > 40 THEN 10 WHEN p_nom > 30 THEN 5 ELSE 1 END::DOUBLE AS weight FROM gen")
def redispatch_weights(t):
    carrier = F.when(F.col("p_nom") > 40, "solar").when(F.col("p_nom") > 30, "gas_chp").otherwise("coal")
    return t.gen.select("generator_id", scalars.redispatch_weight(carrier).alias("weight"))


@query("""SELECT hr AS snapshot, load_id % 100 AS bus, round(sum(CASE WHEN event_type IN ('click', 'view') THEN mw ELSE -mw END), 6) AS mw FROM (SELECT hr, load_id, carrier AS event_type, mw FROM ev) GROUP BY 1, 2""")
def net_injection(t):
    e = t.ev.select(F.col("hr").alias("snapshot"), (F.col("load_id") % 100).alias("bus"), "mw", "carrier")
    gives = F.col("carrier").isin("click", "view")
    return network.injections(e.where(gives), e.where(~gives)).withColumn("mw", r6("mw"))


def _network(t):
    """All stretches: lines, (bus_id, island), and the transfer factors of every island."""
    lines = t.stretch.withColumn("v_nom", F.lit(110.0))
    island_of = stored(network.islands(lines))
    return lines, island_of, stored(network.island_factors(lines, island_of))


def _put_in(t, island_of, mw):
    """(snapshot, island, bus, mw): four snapshots of every bus."""
    snapshots = t.spark.range(1, 5).select(F.col("id").alias("snapshot"))
    return island_of.crossJoin(F.broadcast(snapshots)).select("snapshot", "island", F.col("bus_id").alias("bus"), mw.cast("double").alias("mw"))


_ISLANDS = ("snapshot", "island")


@query("""WITH ends AS (SELECT bus0 AS bus FROM stretch UNION SELECT bus1 FROM stretch), inj AS (SELECT CAST(s AS BIGINT) AS snapshot, bus, bus // 6 AS island, (bus * s - 7)::DOUBLE AS mw FROM range(1, 5) t(s), ends), bal AS (SELECT snapshot, bus, island, mw - avg(mw) OVER (PARTITION BY snapshot, island) AS mw FROM inj),
    cum AS (SELECT snapshot, bus, sum(mw) OVER (PARTITION BY snapshot, island ORDER BY bus) AS mw FROM bal), seg AS (SELECT bus0, sum(1 / x) AS y FROM stretch GROUP BY bus0)
    SELECT snapshot, line_id, round(cum.mw * (1 / l.x) / seg.y, 6) AS mw FROM stretch l JOIN cum ON cum.bus = l.bus0 JOIN seg ON seg.bus0 = l.bus0""")
def dc_flows(t):
    _, island_of, factors = _network(t)
    inj = _put_in(t, island_of, F.col("bus_id") * F.col("snapshot") - 7)
    return network.flows(factors, inj, _ISLANDS).withColumn("mw", r6("mw"))


@query("""SELECT a.line_id, b.line_id AS outage, round(1.0::DOUBLE, 6) AS factor FROM stretch a JOIN stretch b ON a.bus0 = b.bus0 AND a.line_id <> b.line_id""")
def outage_distribution(t):
    lines, _, factors = _network(t)
    return network.outage_factors(factors, lines).where(F.abs("factor") > 1e-6).withColumn("factor", r6("factor"))


@query()
def redispatch_lp(t):
    lines, island_of, factors = _network(t)
    inj = _put_in(t, island_of, F.col("bus_id") * F.col("snapshot") * 20 - 50)
    flow = network.flows(factors, inj, _ISLANDS).join(factors.select("line_id", "island").distinct(), "line_id")
    over = network.overloads(flow, lines, within=_ISLANDS)
    binding = over.select(*_ISLANDS, F.col("rank").alias("row"), "line_id", "mw", "s_nom")
    # prices rise from each island's first bus: counted from bus 0 they would soon pass the cost of an overload
    units = inj.select(*_ISLANDS, "bus", F.lit("coal").alias("carrier"), F.lit(300.0).alias("up"), F.lit(300.0).alias("down"), ((F.col("bus") - F.col("island")) * 5 + 40).cast("double").alias("price"), F.lit(1.0).alias("weight"))
    return network.redispatch(units, binding, factors, within=_ISLANDS).select("snapshot", "bus", "carrier", F.round("delta", 3).alias("delta"))


@query("SELECT line_id, round((CASE WHEN v_nom >= 380 THEN 2.0 WHEN v_nom >= 220 THEN 1.5 ELSE 1.0 END) * greatest(length, 0.1) * (0.5 + r), 6)::DOUBLE AS score FROM line")
def critical_line_score(t):
    return network.line_score(t.line.withColumn("loading", F.col("r"))).select("line_id", r6("score").alias("score"))


@query("""SELECT line_id, round(max(abs(mw) / nullif(s_nom, 0) * 100), 6) AS peak_pct, round(avg(abs(mw) / nullif(s_nom, 0) * 100), 6) AS mean_pct, count(*) FILTER (abs(mw) / nullif(s_nom, 0) * 100 > 100) AS hours_over FROM (SELECT load_id AS line_id, mw FROM ev) f JOIN line USING (line_id) GROUP BY line_id""")
def line_loading_map(t):
    flow = t.ev.select(F.col("load_id").alias("line_id"), "mw")
    out = network.line_loading(flow, t.line)
    return out.select("line_id", r6("peak_pct").alias("peak_pct"), r6("mean_pct").alias("mean_pct"), "hours_over")


@query("SELECT carrier, round(sum(p_nom) FILTER (hit), 6) AS hit, count(*) AS n FROM (SELECT carrier, p_nom, p_nom * 1.3 <= 40 AS hit FROM gen) GROUP BY carrier")
def ladder_snap(t):
    step = scalars.snapped_up(F.col("p_nom"), [10, 20, 40, 80])
    return t.gen.withColumn("step", step).groupBy("carrier").agg(r6(F.sum(F.when(F.col("step") <= 40, F.col("p_nom")))).alias("hit"), F.count("*").alias("n"))


@query("""SELECT generator_id, moved FROM (SELECT generator_id, sum(p_nom) OVER (PARTITION BY bus) - coalesce(sum(p_nom) OVER (PARTITION BY bus ORDER BY p_nom DESC, generator_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 300 AS moved FROM gen)""")
def stub_relief(t):
    from gridweave.operators.graph import stub_relief as relieve

    caps = t.bus.select(F.col("bus_id").alias("bus"), F.lit(300.0).alias("cap"))
    return relieve(t.gen, caps).select("generator_id", "moved")


@query()
def year_of_fleet(t):
    fleet = t.part.groupBy(F.col("p_type").alias("carrier"), (F.col("p_partkey") % 30 + 1990).cast("int").alias("year")).agg(F.sum("p_size").alias("mw"))
    return market.year_by_capacity(t.gen, fleet).select("generator_id", "year")


@query()
def top_hours(t):
    hours = t.ev.groupBy("hr").agg(F.max("mw").alias("peak"), F.count("*").alias("n"), F.count_if(F.col("mw") > 90).alias("over"))
    score = F.col("peak") + 0.5 * F.col("n") + 0.2 * F.col("over")
    return rel.top_k_by(hours.withColumn("g", F.lit(1)).withColumn("score", score), ["g"], [F.desc("score"), F.col("hr")], 20).select("hr", r6("score").alias("score"))
