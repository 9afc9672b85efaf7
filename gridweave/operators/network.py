"""Linear network physics: injections, transfer factors, flows, outages, redispatch."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.operators.components import connected_components
from gridweave.operators.relational import top_k_by

#: Networks of more buses than this are not solved densely.
MOST_BUSES = 4_000


def injections(generation: DataFrame, load: DataFrame, storage: DataFrame | None = None) -> DataFrame:
    """(snapshot, bus, mw): generation less load plus storage; each input has (snapshot, bus, mw)."""
    signed = generation.select("snapshot", "bus", "mw").unionByName(load.select("snapshot", "bus", (-F.col("mw")).alias("mw")))
    if storage is not None:
        signed = signed.unionByName(storage.select("snapshot", "bus", "mw"))
    return signed.groupBy("snapshot", "bus").agg(F.sum("mw").alias("mw"))


def transfer_factors(buses: np.ndarray, bus0: np.ndarray, bus1: np.ndarray, x: np.ndarray, kv: np.ndarray, base_mva: float = 1.0) -> tuple[np.ndarray, int]:
    """(factors [line, bus], slack): what a MW put in at a bus and taken out at the slack sends over each line.

    Susceptances from per-unit reactances; the slack is the best-connected bus (first on a tie).
    """
    at = {b: k for k, b in enumerate(buses.tolist())}
    i, j = (np.array([at[b] for b in e.tolist()]) for e in (bus0, bus1))
    n = len(buses)
    if n > MOST_BUSES:
        raise ValueError(f"{n} buses are more than a dense solve takes ({MOST_BUSES})")
    y = 1 / (x / (kv * kv / base_mva))
    slack = int(np.bincount(np.r_[i, j], minlength=n).argmax())
    lap = np.zeros((n, n))
    np.add.at(lap, (i, i), y)
    np.add.at(lap, (j, j), y)
    np.add.at(lap, (i, j), -y)
    np.add.at(lap, (j, i), -y)
    keep = np.arange(n) != slack
    inverse = np.zeros((n, n))
    inverse[np.ix_(keep, keep)] = np.linalg.inv(lap[np.ix_(keep, keep)])
    return y[:, None] * (inverse[i] - inverse[j]), slack


def factor_table(lines: DataFrame, buses: DataFrame, least: float = 1e-6) -> DataFrame:
    """(line_id, bus, factor) of one island's lines (line_id, bus0, bus1, x, v_nom).

    The network comes to the driver: its size is a grid's, not the data's, and is
    checked against MOST_BUSES before anything is collected.
    """
    if buses.limit(MOST_BUSES + 1).count() > MOST_BUSES:
        raise ValueError(f"more than {MOST_BUSES} buses: reduce the network first")
    b = np.array([r[0] for r in buses.select("bus_id").distinct().orderBy("bus_id").collect()])
    l = lines.select("line_id", "bus0", "bus1", "x", "v_nom").orderBy("line_id").toPandas()
    h, _ = transfer_factors(b, *(l[c].to_numpy() for c in ("bus0", "bus1", "x", "v_nom")))
    rows, cols = np.nonzero(np.abs(h) > least)
    table = pa.table({"line_id": l["line_id"].to_numpy()[rows], "bus": b[cols], "factor": h[rows, cols]})
    return lines.sparkSession.createDataFrame(table.to_pandas())


def islands(lines: DataFrame) -> DataFrame:
    """(bus_id, island): every bus at a line, with the least bus of its connected part."""
    return connected_components(lines, "bus0", "bus1").select(F.col("node").alias("bus_id"), F.col("component").alias("island"))


def island_factors(lines: DataFrame, island_of: DataFrame, least: float = 1e-6) -> DataFrame:
    """(island, line_id, bus, factor) of all lines (line_id, bus0, bus1, x, v_nom), each island solved in a task of its own.

    island_of: (bus_id, island), see :func:`islands`. No island may have more than
    MOST_BUSES buses, which is checked before any is solved; their number is free.
    """
    large = island_of.groupBy("island").count().where(F.col("count") > MOST_BUSES).limit(1).collect()
    if large:
        raise ValueError(f"island {large[0]['island']} has more than {MOST_BUSES} buses: reduce the network first")

    def solve(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("line_id")
        b = np.unique(part[["bus0", "bus1"]].to_numpy())
        h, _ = transfer_factors(b, *(part[c].to_numpy() for c in ("bus0", "bus1", "x", "v_nom")))
        rows, cols = np.nonzero(np.abs(h) > least)
        return pd.DataFrame({"island": key[0], "line_id": part["line_id"].to_numpy()[rows], "bus": b[cols], "factor": h[rows, cols]})

    kinds = dict(lines.dtypes) | dict(island_of.dtypes)
    labelled = lines.select("line_id", "bus0", "bus1", "x", "v_nom").join(island_of.select(F.col("bus_id").alias("bus0"), "island"), "bus0")
    return labelled.groupBy("island").applyInPandas(solve, f"island {kinds['island']}, line_id {kinds['line_id']}, bus {kinds['bus0']}, factor double")


def flows(factors: DataFrame, injection: DataFrame, within: Iterable[str] = ("snapshot",)) -> DataFrame:
    """(snapshot, line_id, mw): injections, balanced over all buses of a snapshot, times factors.

    within: the columns of injection inside which it is balanced; ("snapshot", "island") for many islands.
    """
    within = list(within)
    mean = injection.groupBy(*within).agg(F.avg("mw").alias("_mean"))
    even = injection.join(mean, within).select("snapshot", "bus", (F.col("mw") - F.col("_mean")).alias("mw"))
    return even.join(factors, "bus").groupBy("snapshot", "line_id").agg(F.sum(F.col("factor") * F.col("mw")).alias("mw"))


def outage_factors(factors: DataFrame, lines: DataFrame, least: float = 0.03) -> DataFrame:
    """(line_id, outage, factor): the part of a line's flow that moves to another when it fails.

    H(l, c) = factor of l at c's first end less that at its second; the part is H(l, c) /
    (1 - H(c, c)). Lines with |1 - H(c, c)| of at most ``least`` (nearly the only path) are left out.
    """
    a = factors.select("line_id", F.col("bus").alias("bus0"), F.col("factor").alias("f0"))
    b = factors.select("line_id", F.col("bus").alias("bus1"), F.col("factor").alias("f1"))
    c = lines.select(F.col("line_id").alias("outage"), "bus0", "bus1")
    plus = c.join(a, "bus0").select("outage", "line_id", F.col("f0").alias("h"))
    minus = c.join(b, "bus1").select("outage", "line_id", (-F.col("f1")).alias("h"))
    h = plus.unionByName(minus).groupBy("outage", "line_id").agg(F.sum("h").alias("h"))
    own = h.where("outage = line_id").select("outage", F.col("h").alias("own")).where(F.abs(1 - F.col("own")) > least)
    return h.where("outage <> line_id").join(own, "outage").select("line_id", "outage", (F.col("h") / (1 - F.col("own"))).alias("factor"))


def contingencies(flow: DataFrame, outage: DataFrame, lines: DataFrame, k: int = 300, tolerance: float = 1.001) -> DataFrame:
    """The k worst (line, outage) pairs per snapshot: flow after the outage and its share of the line's capacity."""
    m = flow.select("snapshot", "line_id", F.col("mw").alias("_m"))
    c = flow.select("snapshot", F.col("line_id").alias("outage"), F.col("mw").alias("_c"))
    after = outage.join(c, "outage").join(m, ["snapshot", "line_id"]).withColumn("mw", F.col("_m") + F.col("factor") * F.col("_c"))
    rated = after.join(lines.select("line_id", "s_nom"), "line_id").withColumn("loading", F.abs("mw") / F.col("s_nom")).where(F.col("loading") > tolerance)
    return top_k_by(rated, ["snapshot"], [F.desc("loading"), F.col("line_id"), F.col("outage")], k).select("snapshot", "rank", "line_id", "outage", "mw", "loading")


def overloads(flow: DataFrame, lines: DataFrame, tolerance: float = 1.001, k: int = 40, within: Iterable[str] = ("snapshot",)) -> DataFrame:
    """The k most overloaded lines per snapshot, or per group of the columns ``within`` of flow."""
    rated = flow.join(lines.select("line_id", "s_nom"), "line_id").withColumn("loading", F.abs("mw") / F.col("s_nom")).where(F.col("loading") > tolerance)
    return top_k_by(rated, list(within), [F.desc("loading"), F.col("line_id")], k)


def eligible_units(over: DataFrame, factors: DataFrame, units: DataFrame, least: float = 0.02, least_mw: float = 1.0, room: float = 1e-3) -> DataFrame:
    """Units (snapshot, unit, bus, p_nom, up, down) with a factor of at least ``least`` on an overloaded line and some room to move."""
    reach = over.join(factors, "line_id").groupBy("snapshot", "bus").agg(F.max(F.abs("factor")).alias("reach")).where(F.col("reach") >= least)
    return units.where((F.col("p_nom") >= least_mw) & (F.greatest("up", "down") > room)).join(reach, ["snapshot", "bus"])


def grouped_units(units: DataFrame) -> DataFrame:
    """(snapshot, bus, carrier): headroom added, plain mean of cost."""
    return units.groupBy("snapshot", "bus", "carrier").agg(F.sum("up").alias("up"), F.sum("down").alias("down"), F.avg("cost").alias("cost"), F.count("*").alias("n"))


def line_score(lines: DataFrame) -> DataFrame:
    """score = voltage factor (380 kV 2, 220 kV 1.5, else 1) * max(length, 0.1) * (0.5 + loading)."""
    vf = F.when(F.col("v_nom") >= 380, 2.0).when(F.col("v_nom") >= 220, 1.5).otherwise(1.0)
    return lines.withColumn("score", vf * F.greatest("length", F.lit(0.1)) * (0.5 + F.col("loading")))


def line_loading(flow: DataFrame, lines: DataFrame) -> DataFrame:
    """(line_id, peak_pct, mean_pct, hours_over): loading in percent of capacity; null where that is 0."""
    pct = F.abs("mw") / F.expr("nullif(s_nom, 0)") * 100
    return flow.join(lines.select("line_id", "s_nom"), "line_id").groupBy("line_id").agg(F.max(pct).alias("peak_pct"), F.avg(pct).alias("mean_pct"), F.count_if(pct > 100).alias("hours_over"))


# -- linear programs -----------------------------------------------------------


def solve_lp(cost, a_eq, b_eq, a_ub, b_ub, low, high, rounds: int = 80, tolerance: float = 1e-9):
    """Minimise cost . x with a_eq x = b_eq, a_ub x <= b_ub, low <= x <= high (finite low).

    Mehrotra's predictor-corrector interior-point method on the standard form, dense.
    Returns (x, objective, gap, residual); the last two certify the answer.
    """
    low, high, cost = (np.asarray(v, dtype=float) for v in (low, high, cost))
    n, m_ub = len(cost), len(b_ub)
    bounded = np.flatnonzero(np.isfinite(high))
    rows = np.zeros((len(b_eq) + m_ub + len(bounded), n + m_ub + len(bounded)))
    rows[: len(b_eq), :n] = a_eq
    rows[len(b_eq) : len(b_eq) + m_ub, :n] = a_ub
    rows[len(b_eq) : len(b_eq) + m_ub, n : n + m_ub] = np.eye(m_ub)
    rows[len(b_eq) + m_ub + np.arange(len(bounded)), bounded] = 1
    rows[len(b_eq) + m_ub + np.arange(len(bounded)), n + m_ub + np.arange(len(bounded))] = 1
    shift = np.r_[low, np.zeros(m_ub + len(bounded))]
    b = np.r_[np.asarray(b_eq, float), np.asarray(b_ub, float), high[bounded]] - rows @ shift
    # rows of an upper bound only involve x + slack = high - low
    c = np.r_[cost, np.zeros(m_ub + len(bounded))]
    scale = np.maximum(np.abs(rows).max(axis=1), 1e-12)
    a, b = rows / scale[:, None], b / scale
    size = max(1.0, np.abs(b).max(initial=1.0))
    b = b / size
    x, s, y = np.ones(len(c)), np.ones(len(c)) * max(1.0, np.abs(c).max(initial=1.0)), np.zeros(len(b))
    for _ in range(rounds):
        rp, rd, mu = b - a @ x, c - a.T @ y - s, x @ s / len(x)
        if max(np.abs(rp).max(initial=0), np.abs(rd).max(initial=0) / (1 + np.abs(c).max(initial=0)), mu / (1 + abs(c @ x))) < tolerance:
            break
        d = x / s
        normal = (a * d) @ a.T
        normal[np.diag_indices_from(normal)] += 1e-13 * (1 + np.trace(normal) / len(normal))

        def step(rc):
            dy = np.linalg.solve(normal, rp + a @ (d * rd - rc / s))
            ds = rd - a.T @ dy
            return rc / s - d * ds, dy, ds

        def reach(v, dv):
            down = dv < 0
            return min(1.0, (v[down] / -dv[down]).min(initial=np.inf))

        dx, dy, ds = step(-x * s)
        ap, ad = reach(x, dx), reach(s, ds)
        sigma = ((x + ap * dx) @ (s + ad * ds) / len(x) / mu) ** 3
        dx, dy, ds = step(sigma * mu - x * s - dx * ds)
        ap, ad = min(1.0, 0.995 * reach(x, dx)), min(1.0, 0.995 * reach(s, ds))
        x, y, s = x + ap * dx, y + ad * dy, s + ad * ds
    gap = abs(c @ x - b @ y) / (1 + abs(c @ x))
    residual = float(np.abs(b - a @ x).max(initial=0))
    out = np.clip(low + x[:n] * size, low, high)
    return out, float(cost @ out), float(gap), residual


def redispatch_problem(units: pd.DataFrame, rows: np.ndarray, base: np.ndarray, rating: np.ndarray, slack_cost: float = 500.0, link_rows=None, link_room=None, link_cost: float = 0.5):
    """The LP of one snapshot: least weighted cost of moving units (and links) so that monitored flows fit their ratings.

    units: up, down, price, weight. rows: [monitored row, unit] factors (a line's own, or
    with an outage's part added). base, rating: flow before and limit. Variables: up
    and down of each unit, up and down of each link, slack of each row and direction.
    The three redispatch variants differ only in rows, units and slack cost.
    """
    u, r = len(units), len(base)
    links = 0 if link_rows is None else link_rows.shape[1]
    price = (units["weight"] * units["price"]).to_numpy(dtype=float)
    cost = np.r_[price, price, np.full(2 * links, link_cost), np.full(2 * r, slack_cost)]
    moves = np.concatenate([rows, -rows], axis=1)
    if links:
        moves = np.concatenate([moves, link_rows, -link_rows], axis=1)
    eye = np.eye(r)
    a_ub = np.concatenate([np.concatenate([moves, -eye, 0 * eye], axis=1), np.concatenate([-moves, 0 * eye, -eye], axis=1)])
    b_ub = np.r_[rating - base, rating + base]
    a_eq = np.r_[np.ones(u), -np.ones(u), np.zeros(2 * links + 2 * r)][None, :]
    high = np.r_[units["up"].to_numpy(dtype=float), units["down"].to_numpy(dtype=float), np.zeros(0) if not links else np.r_[link_room, link_room], np.full(2 * r, np.inf)]
    return cost, a_eq, np.zeros(1), a_ub, b_ub, np.zeros(len(cost)), high


def redispatch(units: DataFrame, binding: DataFrame, factors: DataFrame, slack_cost: float = 500.0, within: Iterable[str] = ("snapshot",)) -> DataFrame:
    """(snapshot, bus, carrier, delta, cost, gap): the redispatch of every snapshot, one small LP each.

    units: (snapshot, bus, carrier, up, down, price, weight), already grouped; binding:
    (snapshot, row, line_id, mw, s_nom) with at most a few dozen rows a snapshot;
    factors: (line_id, bus, factor). Monitored rows may also be outages: give their
    combined factors under a line_id of their own. within: the columns of units and
    binding that make up one LP, ("snapshot", "island") for many islands; all are returned.
    """
    within = list(within)
    wanted = binding.join(factors.select("line_id", "bus", "factor"), "line_id").groupBy(*within, "bus").agg(F.sort_array(F.collect_list(F.struct("row", "factor"))).alias("_s"))
    with_factors = units.join(wanted, [*within, "bus"], "left").select(*(F.col(c).alias(c) for c in units.columns), F.col("_s.row").alias("_r"), F.col("_s.factor").alias("_f"))
    own = binding.select(*(F.col(c).alias(c) for c in (*within, "row", "mw", "s_nom")))  # both sides may come from one table

    def one(key, u: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if u.empty or b.empty:
            none = pd.Series(dtype="float64")
            keys = {c: (b if u.empty else u)[c].iloc[:0] for c in within}
            return pd.DataFrame({**keys, "bus": pd.Series(dtype="int64"), "carrier": pd.Series(dtype="object"), "delta": none, "cost": none, "gap": none})
        u, b = u.sort_values(["bus", "carrier"]).reset_index(drop=True), b.sort_values("row")
        ids = b["row"].tolist()
        known = [dict(zip(r, f)) if r is not None else {} for r, f in zip(u["_r"], u["_f"])]
        rows = np.array([[k.get(r, 0.0) for k in known] for r in ids], dtype=float)
        x, total, gap, _ = solve_lp(*redispatch_problem(u, rows, b["mw"].to_numpy(dtype=float), b["s_nom"].to_numpy(dtype=float), slack_cost))
        delta = x[: len(u)] - x[len(u) : 2 * len(u)]
        return pd.DataFrame({**dict(zip(within, key)), "bus": u["bus"].to_numpy(), "carrier": u["carrier"].to_numpy(dtype=object), "delta": delta, "cost": total, "gap": gap})

    kinds = dict(units.dtypes)
    return with_factors.groupBy(*within).cogroup(own.groupBy(*within)).applyInPandas(one, ", ".join(f"{c} {kinds[c]}" for c in within) + f", bus {kinds['bus']}, carrier string, delta double, cost double, gap double")


def flows_after(flow: DataFrame, factors: DataFrame, deltas: DataFrame) -> DataFrame:
    """(snapshot, line_id, mw): flows with the deltas (snapshot, bus, delta) added."""
    extra = deltas.groupBy("snapshot", "bus").agg(F.sum("delta").alias("_d")).join(factors, "bus").groupBy("snapshot", "line_id").agg(F.sum(F.col("factor") * F.col("_d")).alias("_x"))
    return flow.join(extra, ["snapshot", "line_id"], "left").select("snapshot", "line_id", (F.col("mw") + F.coalesce("_x", F.lit(0.0))).alias("mw"))


def ramps(dispatch: DataFrame, by: Iterable[str] = ("carrier",)) -> DataFrame:
    """Sums of upward and downward changes."""
    d: Column = F.col("delta")
    return dispatch.groupBy(*by).agg(F.sum(F.greatest(d, F.lit(0.0))).alias("up"), F.sum(F.greatest(-d, F.lit(0.0))).alias("down"))
