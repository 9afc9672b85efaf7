"""Hourly series on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridweave.functions import scalars
from gridweave.operators import series
from gridweave.plans.registry import query


def r6(c):
    return F.round(c, 6)


@query("SELECT carrier, hr, round(avg(mw), 6) AS mean FROM ev GROUP BY carrier, hr")
def hourly_resample(t):
    return series.hourly_mean(t.ev, "ts", "mw", ["carrier"]).select("carrier", "hr", r6("mean").alias("mean"))


_HOURLY = "h AS (SELECT CAST(extract(epoch FROM hr - TIMESTAMP '2024-01-01') / 3600 AS BIGINT) AS hour, avg(mw) AS v FROM ev WHERE carrier = 'click' GROUP BY 1), g AS (SELECT CAST(r AS BIGINT) AS hour FROM range(0, 744) t(r)), f AS (SELECT g.hour, v FROM g LEFT JOIN h ON g.hour = h.hour)"


def _hours_of_clicks(t):
    hour = F.floor((F.unix_timestamp("hr") - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))) / 3600).cast("long")
    h = t.ev.where("carrier = 'click'").groupBy(hour.alias("hour")).agg(F.avg("mw").alias("value"))
    return t.spark.range(744).select(F.col("id").alias("hour")).join(h, "hour", "left")


@query(f"""WITH {_HOURLY}, w AS (SELECT hour, v, last_value(CASE WHEN v IS NOT NULL THEN hour END IGNORE NULLS) OVER (ORDER BY hour ROWS UNBOUNDED PRECEDING) AS b, first_value(CASE WHEN v IS NOT NULL THEN hour END IGNORE NULLS) OVER (ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM f)
    SELECT w.hour, round(CASE WHEN w.v IS NOT NULL THEN w.v WHEN w.b IS NULL THEN fa.v WHEN w.a IS NULL THEN fb.v ELSE fb.v + (w.hour - w.b)::DOUBLE / (w.a - w.b) * (fa.v - fb.v) END, 6) AS value FROM w LEFT JOIN f fa ON w.a = fa.hour LEFT JOIN f fb ON w.b = fb.hour""")
def gap_interpolate(t):
    return series.interpolated(_hours_of_clicks(t)).select("hour", r6("value").alias("value"))


@query(f"""WITH {_HOURLY} SELECT hour, round(coalesce(sum(v) OVER (ORDER BY hour ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING), 0) / 24, 9) AS smooth FROM f""")
def moving_average_24(t):
    return _hours_of_clicks(t).select("hour", F.round(series.moving_average("value", 24, []), 9).alias("smooth"))


@query("""SELECT load_id, block, round(avg(mean), 6) AS mean FROM (SELECT load_id, CAST(floor((extract(day FROM ts) - 1) / 7) AS INTEGER) AS block, mw AS mean FROM ev) GROUP BY load_id, block""")
def weekly_means(t):
    hours = t.ev.select("load_id", ((F.dayofmonth("ts") - 1) * 24 + F.hour("ts")).alias("hour"), F.col("mw").alias("value"))
    return series.blocks_of_hours(hours, "load_id", 168, whole=False).select("load_id", "block", r6("mean").alias("mean"))


@query("""WITH g AS (SELECT e.event_id, e.ts, e.load_id FROM ev e WHERE carrier = 'purchase'), s AS (SELECT ts, load_id, mw FROM ev WHERE carrier = 'view'),
    d AS (SELECT g.event_id, g.load_id, s.mw, row_number() OVER (PARTITION BY g.event_id ORDER BY abs(epoch_us(g.ts) - epoch_us(s.ts)), s.ts, s.mw) AS rn FROM g JOIN s ON g.load_id = s.load_id AND abs(epoch_us(g.ts) - epoch_us(s.ts)) <= 7200000000)
    SELECT g.event_id, round(d.mw, 6) AS value FROM g LEFT JOIN d ON g.event_id = d.event_id AND rn = 1""")
def nearest_in_time_join(t):
    grid = t.ev.where("carrier = 'purchase'").select("event_id", "load_id", "ts")
    points = t.ev.where("carrier = 'view'").groupBy("load_id", "ts").agg(F.min("mw").alias("value"))
    found = series.nearest_in_time(grid.select("load_id", "ts").distinct(), points, 7200, ["load_id"])
    return grid.join(found, ["load_id", "ts"]).select("event_id", r6("value").alias("value"))


@query("SELECT load_id, round(sum(mw) FILTER (rn BETWEEN 3 AND 8), 6) AS slice_sum, round(max(mw) FILTER (rn BETWEEN 3 AND 8), 6) AS slice_peak FROM (SELECT load_id, mw, row_number() OVER (PARTITION BY load_id ORDER BY event_id) AS rn FROM ev) GROUP BY load_id")
def array_slice(t):
    arrays = series.to_arrays(t.ev, "load_id", "mw", "event_id").withColumn("s", scalars.sliced(F.col("series"), 2, 8))
    return arrays.select("load_id", r6(scalars.array_total(F.col("s"))).alias("slice_sum"), r6(F.array_max("s")).alias("slice_peak"))


@query("""WITH a AS (SELECT load_id, mw, row_number() OVER (PARTITION BY load_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY load_id) AS n, last_value(mw) OVER (PARTITION BY load_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tail FROM ev)
    SELECT load_id, round(sum(mw) FILTER (rn <= 80), 6) AS zeros, round(sum(mw) FILTER (rn <= 80) + greatest(0, 80 - max(n)) * max(tail), 6) AS held FROM a GROUP BY load_id""")
def array_padding(t):
    a = series.to_arrays(t.ev, "load_id", "mw", "event_id")
    return a.select("load_id", r6(scalars.array_total(scalars.padded(F.col("series"), 80))).alias("zeros"), r6(scalars.array_total(scalars.padded(F.col("series"), 80, True))).alias("held"))


@query("""WITH o AS (SELECT load_id, carrier, mw, row_number() OVER (PARTITION BY load_id ORDER BY event_id) - 1 AS hour FROM ev), w AS (SELECT load_id, load_id % 4 AS grp, (load_id % 3 + 1)::DOUBLE AS wt FROM ev GROUP BY load_id)
    SELECT grp, CAST(hour AS INTEGER) AS hour, round(sum(wt * mw) / sum(wt), 6) AS mean FROM o JOIN w ON o.load_id = w.load_id WHERE hour < 24 GROUP BY grp, hour""")
def weighted_vector_mean(t):
    a = series.to_arrays(t.ev, "load_id", "mw", "event_id").select((F.col("load_id") % 4).alias("grp"), (F.col("load_id") % 3 + 1).cast("double").alias("wt"), scalars.sliced(F.col("series"), 0, 24).alias("series"))
    return series.to_rows(series.mean_profiles(a, ["grp"], "series", "wt"), "grp", "series", "mean").select("grp", "hour", r6("mean").alias("mean"))


@query("""WITH h AS (SELECT CAST(r AS INTEGER) AS hour, TIMESTAMP '2025-01-01' + to_hours(CAST(r AS INTEGER)) AS ts FROM range(0, 8760) t(r)), p AS (SELECT hour, (1 + 0.03 * cos(2 * pi() * (dayofyear(ts) - 15) / 365)) * (0.85 + 0.15 * exp(-0.5 * pow((hour(ts) - 14) / 6.0, 2))) * CASE isodow(ts) WHEN 7 THEN 0.75 WHEN 6 THEN 0.85 ELSE 1.0 END AS v FROM h)
    SELECT hour, round(v / sum(v) OVER (), 9) AS industry FROM p""")
def standard_load_profile(t):
    return series.standard_profiles(t.spark).select("hour", F.round("industry", 9).alias("industry"))


@query("""SELECT ts, event_id FROM ev WHERE CAST(ts AS DATE) >= DATE '2024-01-01' AND CAST(ts AS DATE) < DATE '2024-01-08'""")
def first_monday_week(t):
    return series.first_mondays(t.ev).select("ts", "event_id")


@query("""SELECT event_id, CAST(floor(extract(epoch FROM ts - TIMESTAMP '2024-01-01') / 3600) AS INTEGER) AS hoy, CAST(isodow(ts) - 1 AS INTEGER) AS dow, CAST(dayofyear(ts) AS INTEGER) AS doy FROM ev""")
def calendar_parts(t):
    return t.ev.select("event_id", scalars.hour_of_year(F.col("ts")).alias("hoy"), F.weekday("ts").alias("dow"), F.dayofyear("ts").alias("doy"))


@query("""SELECT load_id, state, first, length FROM (SELECT load_id, run, state, min(rn) AS first, count(*) AS length FROM (SELECT *, sum(c) OVER (PARTITION BY load_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT load_id, rn, state, CASE WHEN state = lag(state) OVER (PARTITION BY load_id ORDER BY rn) THEN 0 ELSE 1 END AS c FROM (SELECT load_id, mw > 50 AS state, row_number() OVER (PARTITION BY load_id ORDER BY event_id) AS rn FROM ev))) GROUP BY load_id, run, state)""".replace("min(rn) AS first", "CAST(min(rn) AS INTEGER) AS first"))
def consecutive_runs(t):
    from gridweave.operators.market import runs

    rows = t.ev.select("load_id", (F.col("mw") > 50).alias("state"), F.row_number().over(Window.partitionBy("load_id").orderBy("event_id")).alias("hour"))
    return runs(rows, ["load_id"], "state")


@query("""SELECT carrier, round(corr(mw, prev), 6) AS rho FROM (SELECT carrier, mw, lag(mw) OVER (PARTITION BY carrier ORDER BY ts, event_id) AS prev FROM ev) WHERE prev IS NOT NULL GROUP BY carrier""")
def lag_one_autocorrelation(t):
    w = Window.partitionBy("carrier").orderBy("ts", "event_id")
    return t.ev.withColumn("prev", F.lag("mw").over(w)).where("prev is not null").groupBy("carrier").agg(r6(F.corr("mw", "prev")).alias("rho"))


@query("""SELECT carrier, CAST(date_trunc('day', ts) AS DATE) AS day, round(avg(mw), 6) AS mean, round(sum(mw), 6) AS total FROM ev GROUP BY ALL""")
def daily_aggregates(t):
    return t.ev.groupBy("carrier", F.to_date("ts").alias("day")).agg(r6(F.avg("mw")).alias("mean"), r6(F.sum("mw")).alias("total"))


@query("""SELECT carrier, round(least(1, greatest(0, sum(mw) / (max(mw) * count(*)))), 6) AS cf, round(sum(greatest(0, 60 - mw)), 6) AS curtailed FROM ev GROUP BY carrier""")
def capacity_factors(t):
    return t.ev.groupBy("carrier").agg(r6(series.capacity_factor(F.sum("mw"), F.max("mw") * F.count("*"))).alias("cf"), r6(F.sum(series.curtailment(F.lit(60), F.col("mw")))).alias("curtailed"))


@query("""WITH ids AS (SELECT DISTINCT load_id FROM ev), s AS (SELECT load_id, hour(ts) AS hour, avg(mw) AS v FROM ev GROUP BY ALL) SELECT i.load_id, CAST(h AS INTEGER) AS hour, round(coalesce(v, 1), 6) AS value FROM ids i CROSS JOIN range(0, 24) r(h) LEFT JOIN s ON s.load_id = i.load_id AND s.hour = h""")
def full_matrix_default(t):
    s = t.ev.groupBy("load_id", F.hour("ts").alias("hour")).agg(F.avg("mw").alias("value"))
    return series.full_matrix(t.ev.select("load_id").distinct(), "load_id", s, 24).select("load_id", "hour", r6("value").alias("value"))


@query()
def ar1_noise(t):
    a = series.to_arrays(t.ev, "load_id", "mw", "event_id")
    return a.select("load_id", F.transform(series.autoregressive("series"), lambda v: F.round(v, 6)).alias("noise"))
