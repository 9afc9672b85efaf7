"""Filters, joins, aggregates, windows and names on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.functions import electrical, scalars, text
from gridweave.operators import relational as rel
from gridweave.plans.registry import query


def r6(c):
    return F.round(c, 6)


@query("""SELECT g.generator_id, g.carrier, g.p_nom, b.v_nom, b.country FROM gen g JOIN bus b ON g.bus = b.bus_id
    WHERE g.p_nom >= 20 AND b.v_nom IN (220, 380) AND b.x BETWEEN 7 AND 14 AND b.y BETWEEN 48 AND 55
    ORDER BY g.p_nom DESC NULLS LAST, g.generator_id LIMIT 200""")
def generators_filter_topk(t):
    buses = rel.conjunction(t.bus, one_of={"v_nom": [220, 380]}, bbox=(7, 48, 14, 55)).select("bus_id", "v_nom", "country")
    gens = rel.conjunction(t.gen, at_least={"p_nom": 20}).select("generator_id", "bus", "carrier", "p_nom")
    return gens.join(buses, F.col("bus") == F.col("bus_id")).orderBy(F.desc_nulls_last("p_nom"), "generator_id").limit(200).select("generator_id", "carrier", "p_nom", "v_nom", "country")


@query("SELECT carrier, count(*) AS n, sum(p_nom) AS total FROM gen GROUP BY carrier")
def carriers_rollup(t):
    return rel.rollup_by(t.gen, "carrier", "p_nom")


@query("SELECT g.generator_id, g.carrier, g.p_nom, round(g.cost, 6) AS cost, b.v_nom, b.country FROM gen g JOIN bus b ON g.bus = b.bus_id WHERE g.generator_id = 42")
def generator_by_id(t):
    return t.gen.where("generator_id = 42").join(t.bus, F.col("bus") == F.col("bus_id")).select("generator_id", "carrier", "p_nom", r6("cost").alias("cost"), "v_nom", "country")


@query("SELECT event_id, carrier, round(mw, 6) AS mw FROM ev WHERE abs(mw) >= 50 ORDER BY abs(mw) DESC, event_id LIMIT 100")
def loads_filter_topk(t):
    return t.ev.where(F.abs("mw") >= 50).orderBy(F.desc(F.abs("mw")), "event_id").limit(100).select("event_id", "carrier", r6("mw").alias("mw"))


@query("""SELECT bus, sum(p_nom) AS total, count(DISTINCT carrier) AS carriers, max(CASE WHEN rn = 1 THEN carrier END) AS largest FROM (
    SELECT bus, carrier, p_nom, row_number() OVER (PARTITION BY bus ORDER BY p_nom DESC, carrier) AS rn FROM (SELECT bus, carrier, sum(p_nom) AS p_nom FROM gen GROUP BY bus, carrier)) GROUP BY bus""")
def bus_enriched_capacity(t):
    parts = rel.map_by(t.gen, "bus", "carrier", "p_nom")
    best = F.element_at(F.array_sort(F.transform(F.map_entries("parts"), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))), 1)["k"]
    return parts.select("bus", "total", F.size("parts").cast("long").alias("carriers"), best.alias("largest"))


@query("SELECT load_id, count(*) AS n, round(max(mw), 6) AS peak, round(sum(mw), 6) AS total FROM ev GROUP BY load_id")
def load_peak_array_max(t):
    arrays = t.ev.where("load_id is not null").groupBy("load_id").agg(F.collect_list("mw").alias("series"))
    return arrays.select("load_id", F.size("series").cast("long").alias("n"), r6(F.array_max("series")).alias("peak"), r6(scalars.array_total(F.col("series"))).alias("total"))


@query("""WITH f AS (SELECT country, carrier, sum(p_nom) AS inner_total, max(p_nom) AS inner_peak, count(*) AS n FROM gen JOIN bus ON bus = bus_id GROUP BY country, carrier)
    SELECT country, carrier, inner_total, inner_peak, n, sum(inner_total) OVER (PARTITION BY country) AS outer_total, CAST(sum(n) OVER (PARTITION BY country) AS BIGINT) AS outer_n FROM f""".replace("JOIN bus ON bus = bus_id", "JOIN bus ON gen.bus = bus.bus_id"))
def county_two_level_rollup(t):
    placed = t.gen.join(t.bus.select("bus_id", "country"), F.col("bus") == F.col("bus_id"))
    return rel.two_level(placed, "country", "carrier", "p_nom")


@query("""SELECT bus_id, count(edge) AS degree FROM bus LEFT JOIN (SELECT DISTINCT line_id AS edge, unnest([bus0, bus1]) AS z FROM line) e ON bus_id = z GROUP BY bus_id""")
def line_endpoints_degree(t):
    ends = rel.edge_endpoints(t.line)
    return t.bus.select("bus_id").join(ends, F.col("bus_id") == F.col("bus"), "left").groupBy("bus_id").agg(F.count("edge").alias("degree"))


@query("""SELECT degree, count(*) AS buses FROM (SELECT z, count(*) AS degree FROM (SELECT DISTINCT line_id, unnest([bus0, bus1]) AS z FROM stretch) GROUP BY z) GROUP BY degree""")
def degree_histogram(t):
    return rel.edge_endpoints(t.stretch).groupBy("bus").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("buses"))


@query("""SELECT greatest(a.v_nom, b.v_nom) || '-' || least(a.v_nom, b.v_nom) AS pair, count(*) AS n FROM line JOIN bus a ON bus0 = a.bus_id JOIN bus b ON bus1 = b.bus_id GROUP BY 1""")
def voltage_pair_counts(t):
    both = rel.with_both_ends(t.line.select("line_id", "bus0", "bus1"), t.bus, ["v_nom"])
    pair = F.concat_ws("-", F.greatest("v_nom0", "v_nom1").cast("string"), F.least("v_nom0", "v_nom1").cast("string"))
    return both.groupBy(pair.alias("pair")).agg(F.count("*").alias("n"))


@query("""SELECT line_id, count(*) OVER (PARTITION BY least(bus0, bus1), greatest(bus0, bus1), v_nom) AS parallel_count,
    CAST(row_number() OVER (PARTITION BY least(bus0, bus1), greatest(bus0, bus1), v_nom ORDER BY line_id) - 1 AS INTEGER) AS parallel_index FROM line""")
def parallel_annotate(t):
    return rel.annotate_parallel(t.line).select("line_id", "parallel_count", "parallel_index")


@query("""SELECT p_type, p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY CASE p_brand WHEN 'Brand#1' THEN 1 WHEN 'Brand#2' THEN 2 ELSE 3 END, p_brand, p_partkey) AS rn FROM part) WHERE rn = 1""")
def source_priority_distinct_on(t):
    rank = F.when(F.col("p_brand") == "Brand#1", 1).when(F.col("p_brand") == "Brand#2", 2).otherwise(3)
    return rel.first_by(t.part, ["p_type"], [rank, F.col("p_brand"), F.col("p_partkey")]).select("p_type", "p_partkey", "p_brand")


@query("""SELECT country, generator_id, p_nom, rank FROM (SELECT country, generator_id, p_nom, CAST(row_number() OVER (PARTITION BY country ORDER BY p_nom DESC, generator_id) AS INTEGER) AS rank
    FROM gen JOIN bus ON gen.bus = bus.bus_id) WHERE rank <= 5 ORDER BY p_nom DESC, generator_id LIMIT 60""")
def topk_per_group(t):
    placed = t.gen.join(t.bus, F.col("bus") == F.col("bus_id")).select("country", "generator_id", "p_nom")
    return rel.top_k_by(placed, ["country"], [F.desc("p_nom"), F.col("generator_id")], 5).orderBy(F.desc("p_nom"), "generator_id").limit(60)


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def orphan_anti_join(t):
    return rel.orphans(t.customer, t.orders, "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("SELECT bus_id FROM bus WHERE EXISTS (SELECT 1 FROM gen WHERE bus = bus_id AND p_nom > 45) OR EXISTS (SELECT 1 FROM stretch WHERE bus0 = bus_id AND s_nom > 180)".replace("WHERE bus = bus_id", "WHERE gen.bus = bus_id"))
def active_semi_join(t):
    return rel.referenced(t.bus, "bus_id", (t.gen.where("p_nom > 45"), "bus"), (t.stretch.where("s_nom > 180"), "bus0")).select("bus_id")


@query("""SELECT l_orderkey, l_linenumber, first_key, r_name FROM (SELECT l_orderkey, l_linenumber, round(l_extendedprice, 6) AS p, split_part(CAST(o_custkey AS VARCHAR) || ', ' || CAST(o_orderkey AS VARCHAR), ', ', 1) AS first_key FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey)
    LEFT JOIN customer ON CAST(first_key AS BIGINT) = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def chain_left_join_split_part(t):
    listed = t.orders.select("o_orderkey", F.concat_ws(", ", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("list"))
    chain = t.lineitem.select("l_orderkey", "l_linenumber").join(listed, F.col("l_orderkey") == F.col("o_orderkey"), "left").withColumn("first_key", rel.first_of_list("list"))
    chain = chain.join(t.customer, F.col("first_key").cast("long") == F.col("c_custkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return chain.select("l_orderkey", "l_linenumber", "first_key", "r_name")


@query("SELECT carrier, round(CASE WHEN sum(p_nom) > 0 THEN sum(p_nom * cost) / sum(p_nom) ELSE avg(cost) END, 6) AS cost, round(avg(cost), 6) AS plain FROM gen GROUP BY carrier")
def weighted_mean_cost(t):
    return t.gen.groupBy("carrier").agg(r6(rel.weighted_mean("cost", "p_nom")).alias("cost"), r6(F.avg("cost")).alias("plain"))


@query("""WITH f AS (SELECT v_nom, cables, length, median(r) AS m, count(r) AS n FROM line GROUP BY v_nom, cables, length), c AS (SELECT v_nom, cables, median(r) AS m FROM line GROUP BY v_nom, cables)
    SELECT f.v_nom, f.cables, f.length, f.n, round(CASE WHEN f.n >= 60 THEN f.m ELSE c.m END, 6) AS median FROM f JOIN c ON f.v_nom = c.v_nom AND f.cables = c.cables""")
def median_with_fallback(t):
    out = rel.median_with_fallback(t.line, ["v_nom", "cables", "length"], ["v_nom", "cables"], "r", 60)
    return out.withColumn("median", r6("median"))


@query("SELECT carrier, round(quantile_cont(mw, 0.5), 6) AS p50, round(quantile_cont(mw, 0.95), 6) AS p95, round(quantile_cont(mw, 0.99), 6) AS p99 FROM ev GROUP BY carrier")
def percentile_vector(t):
    out = rel.percentiles(t.ev, ["carrier"], "mw", [0.5, 0.95, 0.99])
    return out.select("carrier", *(r6(c).alias(c) for c in ("p50", "p95", "p99")))


@query("""SELECT CAST(bin AS INTEGER) AS bin, count(p_retailprice) AS n FROM range(11) b(bin) LEFT JOIN part ON p_size >= bin * 5 AND (p_size < bin * 5 + 5 OR (bin = 10 AND p_size <= 55)) GROUP BY bin""")
def fixed_histogram(t):
    return rel.histogram(t.part, "p_size", [5.0 * k for k in range(12)])


@query("""SELECT CAST(bin AS INTEGER) AS bin, count(p_retailprice) AS n FROM range(10) b(bin) LEFT JOIN part ON p_size > bin * 5 AND p_size <= bin * 5 + 5 GROUP BY bin""")
def right_closed_histogram(t):
    return rel.histogram(t.part, "p_size", [5.0 * k for k in range(11)], right_closed=True)


@query("""SELECT bus0, bus1, v_nom, round(1 / sum(1 / r), 6) AS r, round(1 / sum(1 / x), 6) AS x, round(sum(b), 9) AS b, round(sum(s_nom), 6) AS s_nom, round(sum(length * s_nom) / sum(s_nom), 6) AS length, count(*) AS num_parallel FROM line GROUP BY bus0, bus1, v_nom""")
def parallel_lines_agg(t):
    out = electrical.parallel_lines(t.line, ["bus0", "bus1", "v_nom"])
    return out.select("bus0", "bus1", "v_nom", r6("r").alias("r"), r6("x").alias("x"), F.round("b", 9).alias("b"), r6("s_nom").alias("s_nom"), r6("length").alias("length"), "num_parallel")


@query("""SELECT bus0 // 6 AS chain, round(sum(r), 6) AS r, round(sum(x), 6) AS x, round(CASE WHEN min(abs(b)) > 0 THEN 1 / sum(1 / b) ELSE 0 END, 6) AS b, min(s_nom) AS s_nom, sum(length) AS length, count(*) AS num_segments FROM (SELECT * FROM stretch WHERE b > 0) GROUP BY bus0 // 6""")
def series_lines_agg(t):
    out = electrical.series_lines(t.stretch.where("b > 0").withColumn("chain", F.floor(F.col("bus0") / 6)), ["chain"])
    return out.select("chain", r6("r").alias("r"), r6("x").alias("x"), r6("b").alias("b"), "s_nom", "length", "num_segments")


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN 380 WHEN p_size > 20 THEN 220 ELSE 110 END AS level, round(sqrt(3) * 110 * p_size / 1000, 6) AS mva, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS key8 FROM part""")
def voltage_case_units(t):
    size = F.col("p_size")
    level = F.when(size > 40, 380).when(size > 20, 220).otherwise(110)
    return t.part.select("p_partkey", level.alias("level"), r6(scalars.capacity_mva(size, F.lit(110))).alias("mva"), scalars.zero_padded(F.col("p_partkey").cast("string")).alias("key8"))


@query("SELECT line_id, NOT coalesce(r > 0.02 AND x > 0.3 AND s_nom > 50, false) AS doubtful FROM line")
def implausible_lines(t):
    good = (F.col("r") > 0.02) & (F.col("x") > 0.3) & (F.col("s_nom") > 50)
    return t.line.select("line_id", (~F.coalesce(good, F.lit(False))).alias("doubtful"))


@query("""SELECT line_id, bus0, bus1 FROM line WHERE bus0 IN (SELECT bus_id FROM bus WHERE v_nom = 380) AND bus1 IN (SELECT bus_id FROM bus WHERE v_nom = 380)""")
def edges_inside_level(t):
    return rel.edges_inside(t.line, t.bus.where("v_nom = 380")).select("line_id", "bus0", "bus1")


@query("""SELECT line_id, a.country AS country0, b.country AS country1 FROM line JOIN bus a ON bus0 = a.bus_id JOIN bus b ON bus1 = b.bus_id WHERE (a.country = 'NATION_7') <> (b.country = 'NATION_7')""")
def cross_border_lines(t):
    both = rel.with_both_ends(t.line.select("line_id", "bus0", "bus1"), t.bus, ["country"])
    return rel.cross_border(both, "NATION_7").select("line_id", "country0", "country1")


@query("SELECT p_partkey, CAST(CASE WHEN o_orderkey IS NULL THEN p_size ELSE o_custkey END AS BIGINT) AS v FROM part LEFT JOIN orders ON p_partkey = o_orderkey AND o_orderkey % 2 = 0")
def update_from_join(t):
    updates = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("p_partkey"), F.col("o_custkey").alias("v"))
    return rel.filled_from(t.part.select("p_partkey", F.col("p_size").cast("long").alias("v")), updates, "p_partkey", ["v"]).select("p_partkey", "v")


@query("""WITH k AS (SELECT p_brand, p_type, min(p_partkey) AS v FROM part WHERE p_partkey % 3 = 0 GROUP BY p_brand, p_type), k2 AS (SELECT p_brand, min(p_partkey) AS v FROM part WHERE p_partkey % 3 = 0 GROUP BY p_brand)
    SELECT p.p_partkey, CASE WHEN k.v IS NOT NULL THEN 1 WHEN k2.v IS NOT NULL THEN 2 END AS tier, coalesce(k.v, k2.v) AS found FROM part p LEFT JOIN k ON p.p_brand = k.p_brand AND p.p_type = k.p_type LEFT JOIN k2 ON p.p_brand = k2.p_brand""")
def relaxed_key_lookup(t):
    dims = t.part.where("p_partkey % 3 = 0").select("p_brand", "p_type", F.col("p_partkey").alias("found"))
    out = rel.relaxed_lookup(t.part.select("p_partkey", "p_brand", "p_type"), dims, [["p_brand", "p_type"], ["p_brand"]], "found")
    return out.select("p_partkey", "tier", "found")


@query("""SELECT p_brand, mode FROM (SELECT p_brand, p_type AS mode, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS rn FROM part GROUP BY p_brand, p_type) WHERE rn = 1""")
def mode_per_group(t):
    return rel.mode_by(t.part, ["p_brand"], "p_type")


@query("SELECT bus, sum(p_nom) AS total, count(*) AS n FROM gen GROUP BY bus HAVING sum(p_nom) > 500")
def having_large_buses(t):
    return t.gen.groupBy("bus").agg(F.sum("p_nom").alias("total"), F.count("*").alias("n")).where("total > 500")


@query("""SELECT (SELECT count(*) FROM bus) AS buses, (SELECT count(*) FROM line) AS lines, (SELECT round(sum(length), 6) FROM line) AS km, (SELECT round(min(x), 6) FROM bus) AS west, (SELECT round(max(y), 6) FROM bus) AS north, (SELECT count(DISTINCT v_nom) FROM bus) AS levels""")
def scalar_kpis(t):
    b = t.bus.agg(F.count("*").alias("buses"), r6(F.min("x")).alias("west"), r6(F.max("y")).alias("north"), F.countDistinct("v_nom").alias("levels"))
    return b.crossJoin(F.broadcast(t.line.agg(F.count("*").alias("lines"), r6(F.sum("length")).alias("km")))).select("buses", "lines", "km", "west", "north", "levels")


@query("SELECT country, list_sort(list(bus_id)) AS buses FROM bus GROUP BY country".replace("list_sort(list(bus_id)) AS buses", "string_agg(CAST(bus_id AS VARCHAR), ',' ORDER BY bus_id) AS buses"))
def ordered_array_agg(t):
    return t.bus.groupBy("country").agg(F.array_join(F.array_sort(F.collect_list("bus_id")), ",").alias("buses"))


@query("SELECT n_regionkey, string_agg(DISTINCT n_name, '; ' ORDER BY n_name) AS names, min(n_name) AS first, max(n_name) AS last FROM nation GROUP BY n_regionkey")
def distinct_string_agg(t):
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), "; ").alias("names"), F.min("n_name").alias("first"), F.max("n_name").alias("last"))


@query("""SELECT country, coalesce(sum(p_nom) FILTER (v_nom = 110), 0) AS kv110, coalesce(sum(p_nom) FILTER (v_nom = 220), 0) AS kv220, coalesce(sum(p_nom) FILTER (v_nom = 380), 0) AS kv380 FROM gen JOIN bus ON gen.bus = bus.bus_id GROUP BY country""")
def pivot_state_carrier(t):
    placed = t.gen.join(t.bus, F.col("bus") == F.col("bus_id")).withColumn("level", F.concat(F.lit("kv"), F.col("v_nom").cast("string")))
    return rel.pivot_sum(placed, "country", "level", ["kv110", "kv220", "kv380"], "p_nom")


@query("""WITH d AS (SELECT load_id, carrier, mw - lag(mw) OVER (PARTITION BY load_id ORDER BY ts, event_id) AS delta FROM ev) SELECT carrier, round(sum(greatest(delta, 0)), 6) AS up, round(sum(greatest(-delta, 0)), 6) AS down FROM d WHERE delta IS NOT NULL GROUP BY carrier""")
def ramp_sums(t):
    from pyspark.sql.window import Window

    from gridweave.operators.network import ramps

    step = F.col("mw") - F.lag("mw").over(Window.partitionBy("load_id").orderBy("ts", "event_id"))
    out = ramps(t.ev.withColumn("delta", step).where("delta is not null"))
    return out.select("carrier", r6("up").alias("up"), r6("down").alias("down"))


@query("""WITH m AS (SELECT country, carrier, sum(p_nom) AS modeled FROM gen JOIN bus ON gen.bus = bus.bus_id GROUP BY country, carrier), r AS (SELECT country, carrier, CAST(count(*) * 20 AS DOUBLE) AS reference FROM gen JOIN bus ON gen.bus = bus.bus_id WHERE p_nom > 25 GROUP BY country, carrier)
    SELECT m.country, m.carrier, modeled, coalesce(reference, 0) AS reference, modeled - coalesce(reference, 0) AS diff, round(CASE WHEN coalesce(reference, 0) = 0 THEN 999 ELSE (modeled - reference) / reference * 100 END, 6) AS pct FROM m LEFT JOIN r ON m.country = r.country AND m.carrier = r.carrier""")
def regional_check(t):
    placed = t.gen.join(t.bus, F.col("bus") == F.col("bus_id")).select("country", "carrier", "p_nom")
    model = placed.groupBy("country", "carrier").agg(F.sum("p_nom").alias("modeled"))
    reference = placed.where("p_nom > 25").groupBy("country", "carrier").agg((F.count("*") * 20).cast("double").alias("reference"))
    return rel.against_reference(model, reference, ["country", "carrier"]).withColumn("pct", r6("pct"))


@query("""WITH r AS (SELECT carrier, p_nom, cost FROM gen), a AS (SELECT carrier, rank() OVER (PARTITION BY carrier ORDER BY p_nom) + (count(*) OVER (PARTITION BY carrier, p_nom) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY carrier ORDER BY cost) + (count(*) OVER (PARTITION BY carrier, cost) - 1) / 2.0 AS rb FROM r)
    SELECT carrier, round(corr(ra, rb), 6) AS rho FROM a GROUP BY carrier""")
def spearman_by_carrier(t):
    return rel.spearman(t.gen, "p_nom", "cost", ["carrier"]).withColumn("rho", r6("rho"))


@query("SELECT carrier, round(corr(hour(ts), mw), 6) AS r, round(avg(abs(mw - 50)), 6) AS mae, round(sqrt(avg((mw - 50) * (mw - 50))), 6) AS rmse, round(avg(mw - 50), 6) AS bias, count(*) FILTER (mw < 10) AS low FROM ev GROUP BY carrier")
def error_metrics(t):
    e = F.col("mw") - 50
    return t.ev.groupBy("carrier").agg(r6(F.corr(F.hour("ts"), F.col("mw"))).alias("r"), r6(F.avg(F.abs(e))).alias("mae"), r6(F.sqrt(F.avg(e * e))).alias("rmse"), r6(F.avg(e)).alias("bias"), F.count_if(F.col("mw") < 10).alias("low"))


@query("SELECT load_id, event_id AS peak_event, round(mw, 6) AS peak FROM (SELECT *, row_number() OVER (PARTITION BY load_id ORDER BY mw DESC, event_id) AS rn FROM ev) WHERE rn = 1")
def argmax_event(t):
    return t.ev.groupBy("load_id").agg(F.max_by("event_id", F.struct("mw", -F.col("event_id"))).alias("peak_event"), r6(F.max("mw")).alias("peak"))


@query("SELECT r_name, count(*) AS n, count(c_acctbal) * 1.0::DOUBLE / count(*) AS c_acctbal_rate FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def fill_rate(t):
    placed = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rel.fill_rates(placed, ["c_acctbal"], "r_name")


@query("""SELECT carrier, generator_id, p_nom, sum(p_nom) OVER (PARTITION BY carrier ORDER BY cost, generator_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative FROM gen""")
def merit_order_cumsum(t):
    from pyspark.sql.window import Window

    w = Window.partitionBy("carrier").orderBy("cost", "generator_id").rowsBetween(*rel.ALL_BEFORE)
    return t.gen.select("carrier", "generator_id", "p_nom", F.sum("p_nom").over(w).alias("cumulative"))


@query("""SELECT generator_id, round(CASE WHEN n > 1 THEN (rn - 1) * 1.0::DOUBLE / (n - 1) ELSE 0 END, 6) AS share FROM (SELECT generator_id, row_number() OVER (PARTITION BY carrier ORDER BY p_nom, generator_id) AS rn, count(*) OVER (PARTITION BY carrier) AS n FROM gen)""")
def normalised_rank(t):
    return t.gen.select("generator_id", r6(rel.rank_share(["carrier"], [F.col("p_nom"), F.col("generator_id")])).alias("share"))


@query("""WITH c AS (SELECT bus, generator_id, cost, count(*) OVER (PARTITION BY bus) AS n, row_number() OVER (PARTITION BY bus ORDER BY cost, generator_id) - 1 AS p FROM gen),
    k AS (SELECT *, least(15, greatest(1, n // 2)) AS b FROM c) SELECT generator_id, CAST(CASE WHEN p < (n % b) * (n // b + 1) THEN p // (n // b + 1) ELSE n % b + (p - (n % b) * (n // b + 1)) // (n // b) END AS INTEGER) AS bin FROM k""")
def ntile_cost_bins(t):
    return rel.equal_bins(t.gen, ["bus"], [F.col("cost"), F.col("generator_id")]).select("generator_id", "bin")


@query("""SELECT line_id, bus0, bus1 FROM (SELECT *, row_number() OVER (PARTITION BY least(bus0, bus1), greatest(bus0, bus1) ORDER BY s_nom DESC, line_id) AS rn FROM line) WHERE rn <= 2""")
def strongest_two_parallels(t):
    return rel.strongest_parallel(t.line).select("line_id", "bus0", "bus1")


@query("""SELECT id, src FROM (SELECT id, src, row_number() OVER (PARTITION BY id ORDER BY k) AS rn FROM (SELECT s_suppkey AS id, 'supplier' AS src, 1 AS k FROM supplier UNION ALL SELECT c_custkey, 'customer', 2 FROM customer UNION ALL SELECT p_partkey, 'part', 3 FROM part)) WHERE rn = 1""")
def concat_keep_first(t):
    parts = [df.select(F.col(c).alias("id"), F.lit(n).alias("src")) for df, c, n in ((t.supplier, "s_suppkey", "supplier"), (t.customer, "c_custkey", "customer"), (t.part, "p_partkey", "part"))]
    return rel.union_first("id", *parts).select("id", "src")


@query("SELECT DISTINCT unnest([bus0, bus1]) AS bus FROM stretch")
def union_distinct_ends(t):
    return t.stretch.select(F.col("bus0").alias("bus")).union(t.stretch.select("bus1")).distinct()


@query()
def hash_stratified_sample(t):
    return rel.hash_sample(t.bus, "bus_id", {110: 7, 220: 15, 380: 7}, "v_nom").select("bus_id", "v_nom")


@query("""SELECT n_regionkey, count(*) AS n, round(avg(s_acctbal), 6) AS old, round(avg(c_acctbal), 6) AS new, round(CASE WHEN avg(s_acctbal) = 0 THEN 0 ELSE (avg(c_acctbal) - avg(s_acctbal)) / avg(s_acctbal) * 100 END, 4) AS pct FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN customer ON c_nationkey = n_nationkey GROUP BY n_regionkey""")
def before_after(t):
    both = t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey")).join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"))
    a = both.groupBy("n_regionkey").agg(F.count("*").alias("n"), F.avg("s_acctbal").alias("old"), F.avg("c_acctbal").alias("new"))
    return a.select("n_regionkey", "n", r6("old").alias("old"), r6("new").alias("new"), F.round(rel.percent_change(F.col("old"), F.col("new")), 4).alias("pct"))


@query("""SELECT issue, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM (SELECT split_part(CASE WHEN p_size > 40 THEN 'LARGE; X' WHEN p_size > 20 THEN 'MEDIUM; Y' ELSE 'SMALL' END, ';', 1) AS issue, p_size FROM part) GROUP BY issue""")
def issue_classes(t):
    issues = F.array_join(F.array_compact(F.array(F.when(F.col("p_size") > 40, "LARGE"), F.when(F.col("p_size").between(21, 40), "MEDIUM"), F.when(F.col("p_size") <= 20, "SMALL"), F.when(F.col("p_size") > 20, "X"))), "; ")
    return t.part.groupBy(F.substring_index(issues, ";", 1).alias("issue")).agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


@query("""SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(regexp_replace(p_name, '(?i)(umspannwerk|uw|substation|station)\\s*', '', 'g'), '(?i)\\s*[0-9]+\\s*kv', '', 'g'), '\\s+', ' ', 'g'))) AS name FROM part""")
def name_normalize(t):
    return t.part.select("p_partkey", text.simply_normalised(F.col("p_name")).alias("name"))


@query("""WITH a AS (SELECT p_partkey AS id, p_name AS name, p_type AS b FROM part) SELECT id, CAST(rank AS INTEGER) AS rank, cand_id, round(score, 6) AS score FROM (SELECT a.id, c.id AS cand_id, s.score, row_number() OVER (PARTITION BY a.id ORDER BY s.score DESC, c.id) AS rank
    FROM a JOIN a c ON substr(a.name, 1, 6) = substr(c.name, 1, 6) AND a.id <> c.id, LATERAL (SELECT 1 - levenshtein(list_aggregate(list_sort(string_split(a.name, ' ')), 'string_agg', ' '), list_aggregate(list_sort(string_split(c.name, ' ')), 'string_agg', ' '))::DOUBLE / greatest(length(a.name), length(c.name)) AS score) s WHERE s.score >= 0.8) WHERE rank <= 3""")
def fuzzy_top_matches(t):
    names = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    out = text.fuzzy_top(names, names.select(F.col("id").alias("cand_id"), F.col("name").alias("cand_name")), F.substring("name", 1, 6), 0.8, 4)
    # a name's own row is the best match of itself
    from pyspark.sql.window import Window

    others = out.where("id <> cand_id").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "cand_id"))).where("rank <= 3")
    return others.select("id", "rank", "cand_id", r6("score").alias("score"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page FROM ev".replace("$.page", "$.k"))
def json_property(t):
    return t.ev.select("event_id", F.get_json_object("props", "$.k").alias("page"))


@query("SELECT page_id, regexp_extract(url, 'https?://([^/]+)/', 1) AS host, regexp_matches(html, '(?i)<title>') AS titled FROM pages")
def regex_fields(t):
    return t.pages.select("page_id", F.regexp_extract("url", "https?://([^/]+)/", 1).alias("host"), F.col("html").rlike("(?i)<title>").alias("titled"))


@query("SELECT round(CASE WHEN isnan(v) OR isinf(v) THEN NULL ELSE v END, 6) AS v, count(*) AS n FROM (SELECT CASE WHEN p_size % 5 = 0 THEN 'Infinity'::DOUBLE WHEN p_size % 5 = 1 THEN 'NaN'::DOUBLE ELSE p_size::DOUBLE END AS v FROM part) GROUP BY 1")
def finite_cleaning(t):
    v = F.when(F.col("p_size") % 5 == 0, float("inf")).when(F.col("p_size") % 5 == 1, float("nan")).otherwise(F.col("p_size").cast("double"))
    return t.part.select(r6(scalars.finite_or_null(v)).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
