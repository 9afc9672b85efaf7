"""Connected components of a link table that no single task could hold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.session import discard, stored


def roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least member of each member's component, members being 0 to n - 1: labels hook each other's and are followed to their ends."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, label[x], low)
        np.minimum.at(after, label[y], low)
        while not np.array_equal(after, further := after[after]):
            after = further
        if np.array_equal(after, label):
            return label
        label = after


def _in_one_task(batches):
    """Links (v, u) of whole numbers, all of them, to (node, component)."""
    both = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if both:
        v, u = (np.concatenate(side) for side in zip(*both))
        node, at = np.unique(np.r_[v, u], return_inverse=True)
        label = roots(len(node), at[: len(v)], at[len(v) :])
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[label])], names=["node", "component"])


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, at_once: int = 0) -> DataFrame:
    """(node, component): every node of ``links``, with the least node of its component.

    Large-star and small-star rounds in turn: every node hands its larger
    neighbours, then all others, to its least neighbour. The links shrink to one
    star per component in a number of rounds that grows with the logarithm of the
    component's diameter. A round is two aggregations and two joins on the node;
    its links are written to the shared folder, which cuts the lineage. Only one
    flag per round reaches the driver. Raises if ``most_rounds`` rounds are not enough.

    at_once: so many links at most are settled in one task without any round. Only
    for nodes that are longs, never null, and links that are cheap to read twice.
    """
    pairs = links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u"))
    if at_once and pairs.count() <= at_once:
        return pairs.coalesce(1).mapInArrow(_in_one_task, "node long, component long")
    loops = pairs.where("u = v").select("u")
    edges = stored(pairs.where("u < v").distinct())
    for _ in range(most_rounds):
        # large star: to each node's larger neighbours
        both = edges.select(F.col("v").alias("n"), F.col("u").alias("m")).unionByName(edges.select(F.col("u").alias("n"), F.col("v").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("low")).withColumn("low", F.least("low", "n"))
        large = edges.join(least.select(F.col("n").alias("u"), "low"), "u").select("v", F.col("low").alias("u")).distinct()
        # small star: each node and its smaller neighbours, to the least of those
        low = large.groupBy("v").agg(F.min("u").alias("low"))
        small = large.join(low, "v").select(F.when(F.col("u") == F.col("low"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("low").alias("u")).where("u < v").distinct()
        after = stored(small)
        # done when every larger end has one link and no smaller end is itself a larger end
        doubled = after.groupBy("v").count().where("count > 1").limit(1)
        chained = after.select("v").join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1)
        done = doubled.select("v").unionByName(chained.select("v")).limit(1).count() == 0
        discard(edges)
        edges = after
        if done:
            break
    else:
        raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("u").alias("component"))
    found = edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots.distinct())
    alone = loops.distinct().join(found.select(F.col("node").alias("u")), "u", "left_anti").select(F.col("u").alias("node"), F.col("u").alias("component"))
    return found.unionByName(alone)
