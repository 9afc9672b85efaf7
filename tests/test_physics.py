"""Transfer factors, flows, linear programs, dispatch."""

import numpy as np
import pytest

from gridweave.operators import market, network


def ring():
    buses = np.array([1, 2, 3, 4])
    return buses, np.array([1, 2, 3, 4, 1]), np.array([2, 3, 4, 1, 3]), np.array([1.0, 2.0, 1.0, 2.0, 1.5]), np.full(5, 110.0)


def test_transfer_factors_conserve():
    buses, b0, b1, x, kv = ring()
    h, slack = network.transfer_factors(buses, b0, b1, x, kv)
    assert np.allclose(h[:, slack], 0)
    injection = np.array([3.0, -1.0, 2.0, -4.0])
    flow = h @ injection
    out = np.zeros(4)
    np.add.at(out, b0 - 1, flow)
    np.add.at(out, b1 - 1, -flow)
    assert np.allclose(out, injection)
    own = np.array([h[k, a - 1] - h[k, b - 1] for k, (a, b) in enumerate(zip(b0, b1))])
    assert ((own > 0) & (own <= 1 + 1e-9)).all()


def test_outages_equal_a_new_solve(spark):
    buses, b0, b1, x, kv = ring()
    h, _ = network.transfer_factors(buses, b0, b1, x, kv)
    factors = spark.createDataFrame([(k, int(b), float(h[k, j])) for k in range(5) for j, b in enumerate(buses)], "line_id int, bus long, factor double")
    lines = spark.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate(zip(b0, b1))], "line_id int, bus0 long, bus1 long")
    found = {(r["line_id"], r["outage"]): r["factor"] for r in network.outage_factors(factors, lines).collect()}
    injection = np.array([3.0, -1.0, 2.0, -4.0])
    flow, keep = h @ injection, [0, 1, 2, 3]
    h2, _ = network.transfer_factors(buses, b0[keep], b1[keep], x[keep], kv[keep])
    after = h2 @ injection
    assert np.allclose([flow[k] + found[(k, 4)] * flow[4] for k in keep], after)


def test_linear_program_against_corners():
    rng = np.random.RandomState(0)
    for _ in range(15):
        n = 4
        cost, a, b = rng.randn(n), rng.rand(3, n), rng.rand(3) + 0.5
        x, value, gap, residual = network.solve_lp(cost, np.ones((1, n)), np.array([0.8]), a, b + 0.5, np.zeros(n), np.ones(n))
        best = np.inf
        grid = np.linspace(0, 1, 21)
        for p in np.stack(np.meshgrid(*[grid] * (n - 1)), -1).reshape(-1, n - 1):
            last = 0.8 - p.sum()
            if 0 <= last <= 1:
                q = np.r_[p, last]
                if (a @ q <= b + 0.5 + 1e-12).all():
                    best = min(best, cost @ q)
        assert abs(x.sum() - 0.8) < 1e-6 and (a @ x <= b + 0.5 + 1e-6).all()
        assert value <= best + 1e-6 and gap < 1e-6 and residual < 1e-6


def test_redispatch_relieves(spark):
    units = spark.createDataFrame([(1, b, "coal", 100.0, 100.0, 10.0 + b, 1.0) for b in (1, 2)], "snapshot long, bus long, carrier string, up double, down double, price double, weight double")
    binding = spark.createDataFrame([(1, 1, 7, 130.0, 100.0)], "snapshot long, row int, line_id long, mw double, s_nom double")
    factors = spark.createDataFrame([(7, 1, 0.8), (7, 2, 0.2)], "line_id long, bus long, factor double")
    delta = {r["bus"]: r["delta"] for r in network.redispatch(units, binding, factors).collect()}
    assert delta[1] == pytest.approx(-50, abs=1e-3) and delta[2] == pytest.approx(50, abs=1e-3)


def test_clearing_with_exports():
    out, price, exported = market.clear_hour(np.array([-40.0, 10.0, 20.0, 50.0]), np.array([30.0, 50.0, 50.0, 50.0]), np.array([True, False, False, False]), 60.0, np.array([15.0]), np.array([40.0]))
    assert out.tolist() == [30.0, 30.0, 0.0, 0.0] and price == 10.0 and exported == 0.0
    # a must-run offer serves what is left of the demand, and exports can start the hour again
    out, price, exported = market.clear_hour(np.array([-40.0, 10.0, 20.0]), np.array([80.0, 50.0, 50.0]), np.array([True, False, False]), 60.0, np.array([15.0]), np.array([40.0]))
    assert out.tolist() == [60.0, 0.0, 40.0] and price == 20.0 and exported == 40.0
    # with nothing left it runs in full; an offer of 0 MW sets no price; an hour in which nothing runs costs 0
    out, price, _ = market.clear_hour(np.array([-40.0, -30.0, 5.0]), np.array([60.0, 25.0, 0.0]), np.array([True, True, True]), 60.0, np.zeros(0), np.zeros(0))
    assert out.tolist() == [60.0, 25.0, 0.0] and price == -30.0
    assert market.clear_hour(np.array([5.0]), np.array([0.0]), np.array([True]), 60.0, np.zeros(0), np.zeros(0))[1] == 0.0


def test_commitment_keeps_minimum_times():
    import pandas as pd

    units = pd.DataFrame({"p_nom": [100.0, 100.0, 50.0], "cost": [10.0, 30.0, 80.0], "min_share": [0.4, 0.4, 0.0], "min_up": [4.0, 4.0, 1.0], "min_down": [3.0, 3.0, 1.0], "ramp": [1.0, 1.0, 1.0]})
    need = np.array([90, 180, 240, 100, 60, 60, 190, 90, 90, 90], dtype=float)
    out, price = market.commit(units, need, hysteresis=0)
    met = np.minimum(out.sum(axis=1), need)
    # the dear large unit stopped two hours before, so it may not help in hour 6
    assert np.allclose(np.delete(met, 6), np.delete(need, 6)) and met[6] == 150
    assert price[2] == 80 and price[0] == 10


def test_every_island_is_solved(spark):
    buses, b0, b1, x, kv = ring()
    rows = [(100 * k + n, int(i + 10 * k), int(j + 10 * k), float(a), 110.0, 1.0) for k in range(3) for n, (i, j, a) in enumerate(zip(b0, b1, x))]
    lines = spark.createDataFrame(rows, "line_id long, bus0 long, bus1 long, x double, v_nom double, s_nom double")
    island_of = network.islands(lines)
    factors = network.island_factors(lines, island_of)
    inj = island_of.selectExpr("1L AS snapshot", "island", "bus_id AS bus", "CAST(bus_id * bus_id AS DOUBLE) AS mw")
    found = {r["line_id"]: r["mw"] for r in network.flows(factors, inj, ("snapshot", "island")).collect()}
    h, _ = network.transfer_factors(buses, b0, b1, x, kv)
    assert sorted(found) == sorted(r[0] for r in rows)
    for k in range(3):
        mw = (buses + 10.0 * k) ** 2
        assert np.allclose([found[100 * k + n] for n in range(5)], h @ (mw - mw.mean()))


def test_network_queries_reach_every_island(spark):
    from gridweave.plans import catalogue
    from gridweave.plans.roles import Roles

    where = "/root/testdata/sf0.01"
    stretch = Roles(spark, where).stretch.toPandas()
    found = catalogue.queries()["dc_flows"](spark, where).toPandas()
    assert set(found["line_id"]) == set(stretch["line_id"]) and len(found) == 4 * len(stretch)
    moved = catalogue.queries()["redispatch_lp"](spark, where).toPandas()
    assert moved["bus"].max() > 5 and (moved[moved["bus"] > 5]["delta"].abs() > 0).any()
    assert moved.groupby([moved["snapshot"], moved["bus"] // 6])["delta"].sum().abs().max() < 0.01
