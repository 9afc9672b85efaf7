"""Components of few links: one task settles them, as rounds would."""

import numpy as np

from gridweave import session
from gridweave.operators.components import connected_components


def test_few_links_are_settled_without_tables(spark):
    order = np.random.RandomState(5).permutation(900).tolist()
    links = [(order[k], order[k + 1]) for k in range(899) if k % 100 != 99] + [(order[3], order[7]), (5, 5), (2000, 2000), (-4, order[0])]
    table = spark.createDataFrame(links + links[:50], "a long, b long").repartition(7)
    want = sorted(map(tuple, connected_components(table).collect()))
    before = list(session._made)
    found = sorted(map(tuple, connected_components(table, at_once=len(links) + 50).collect()))
    assert session._made == before
    assert found == want and len({c for _, c in found}) == 10
    few = connected_components(table, at_once=10)  # more links than that: by rounds
    assert session._made != before and sorted(map(tuple, few.collect())) == want
    assert connected_components(table.where("a > 5000"), at_once=10).collect() == []
