"""The seven hand networks, merging, mappings, pruning."""

import pytest

from gridweave.operators import graph

NETWORKS = {
    "simple_chain": ([(1, 2), (2, 3), (3, 4)], [1, 4], [2, 3], [{2, 3}]),
    "parallel_chain": ([(1, 2), (1, 2), (2, 3), (2, 3), (3, 4), (3, 4)], [1, 4], [2, 3], [{2, 3}]),
    "protected_degree2": ([(1, 2), (2, 3)], [1, 2, 3], [], []),
    "branching_node": ([(1, 2), (1, 3), (1, 4)], [2, 3, 4], [], []),
    "dead_end": ([(1, 2), (2, 3), (3, 4)], [1, 2], [3], [{3}]),
    "multi_component": ([(1, 2), (2, 3), (10, 11), (11, 12)], [1, 3, 10, 12], [2, 11], [{2}, {11}]),
    "diamond": ([(1, 2), (2, 4), (1, 3), (3, 4)], [1, 4], [2, 3], [{2}, {3}]),
}


def edges(spark, pairs):
    rows = [(k, a, b, 1.0 + k, 3.0 + k, 0.0, 0.0, 100.0 + k, 10.0) for k, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "line_id int, bus0 long, bus1 long, r double, x double, b double, g double, s_nom double, length double")


def buses(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "bus_id long")


@pytest.mark.parametrize("name", NETWORKS)
def test_degree_two_and_chains(spark, name):
    pairs, protected, removable, chains = NETWORKS[name]
    e = edges(spark, pairs)
    found = graph.eliminable(e, buses(spark, protected))
    assert sorted(r["bus_id"] for r in found.collect()) == removable
    got = {}
    if removable:
        for r in graph.chains(e, found).collect():
            got.setdefault(r["chain"], set()).add(r["bus"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, chains))


def test_rings_have_no_ends(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1)])
    assert graph.chains(e, graph.eliminable(e, buses(spark, []))).count() == 0


def test_merged_chain(spark):
    rows = [(1, 1, 2, 1.0, 3.0, 0.0, 0.0, 150.0, 10.0), (2, 2, 3, 1.5, 4.5, 0.0, 0.0, 200.0, 12.0), (3, 3, 4, 2.0, 6.0, 0.0, 0.0, 180.0, 15.0)]
    e = spark.createDataFrame(rows, edges(spark, []).schema)
    r = graph.merged_chains(e, buses(spark, [2, 3])).first()
    assert (r["bus0"], r["bus1"], r["r"], r["x"], r["s_nom"], r["length"]) == (1, 4, 4.5, 13.5, 150.0, 37.0)
    assert sorted(x["line_id"] for x in graph.lines_to_delete(e, buses(spark, [2, 3])).collect()) == [1, 2, 3]


def test_components_and_reach(spark):
    e, b = edges(spark, [(1, 2), (2, 3), (10, 11), (5, 5)]), buses(spark, [1, 2, 3, 4, 5, 10, 11])
    of = {r["bus"]: r["component"] for r in graph.components(b, e).collect()}
    assert of == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 10: 10, 11: 10}
    pairs = {tuple(r) for r in graph.reachable_pairs(b, e, buses(spark, [1, 3, 11])).collect()}
    assert pairs == {(1, 3), (3, 1)}
    assert sorted(r["bus_id"] for r in graph.main_island(b, e).collect()) == [1, 2, 3]
    assert sorted(r["bus_id"] for r in graph.isolated(b, e).collect()) == [4]


def test_long_chain_of_links(spark):
    from gridweave.operators.components import connected_components

    n = 300
    links = spark.createDataFrame([((k * 7) % n, (k * 7 + 7) % n) for k in range(n - 1)], "a long, b long")
    assert {r["component"] for r in connected_components(links).collect()} == {0}


def test_mapping(spark):
    m = lambda *p: spark.createDataFrame(list(p), "old_bus long, new_bus long")
    assert {tuple(r) for r in graph.composed(m((1, 2), (5, 6)), m((2, 3), (9, 8))).collect()} == {(1, 3), (2, 3), (5, 6), (9, 8)}
    left = graph.remapped(edges(spark, [(1, 2), (2, 3), (4, 4)]), m((2, 1))).select("bus0", "bus1").collect()
    assert sorted(map(tuple, left)) == [(1, 3), (4, 4)]


def test_keepers(spark):
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 3), (7, 3)], "bus_id long, cluster long")
    degree = spark.createDataFrame([(1, 9), (2, 1), (4, 1), (5, 5), (6, 2), (7, 2)], "bus long, degree long")
    kept = {r["cluster"]: r["keeper"] for r in graph.keepers(clusters, buses(spark, [3]), buses(spark, [2]), degree).collect()}
    assert kept == {1: 3, 2: 5, 3: 6}
    shorter = {r["cluster"]: r["keeper"] for r in graph.keepers(clusters, buses(spark, []), buses(spark, []), degree, by_degree=False).collect()}
    assert shorter == {1: 1, 2: 4, 3: 6}
    assert {r["cluster"] for r in graph.valid_clusters(clusters, buses(spark, [1, 2]), buses(spark, [])).collect()} == {2, 3}


def test_pruning_and_pockets(spark):
    e, b = edges(spark, [(1, 2), (2, 3), (3, 4), (4, 5), (4, 5)]), buses(spark, range(1, 6))
    left, lines = graph.without_dead_ends(b, e, buses(spark, [2]))
    assert sorted(r["bus_id"] for r in left.collect()) == [2] and lines.count() == 0
    got = {(r["pocket"], r["bus"], r["inner"]) for r in graph.pockets(e, buses(spark, [3])).collect()}
    assert got == {(1, 1, True), (1, 2, True), (1, 3, False), (4, 4, True), (4, 5, True), (4, 3, False)}


def test_split_clusters(spark):
    clusters = spark.createDataFrame([(k, 1) for k in (1, 2, 3, 4, 5)], "bus_id long, cluster long")
    got = {r["bus_id"]: r["cluster"] for r in graph.split_by_connection(clusters, edges(spark, [(1, 2), (3, 4), (5, 9)])).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}


def test_stub_relief(spark):
    gens = spark.createDataFrame([(1, 1, 100.0), (2, 1, 60.0), (3, 1, 30.0), (4, 2, 500.0)], "generator_id long, bus long, p_nom double")
    caps = spark.createDataFrame([(1, 95.0)], "bus long, cap double")
    assert {r["generator_id"] for r in graph.stub_relief(gens, caps).where("moved").collect()} == {1}
