"""Exact top-k inner-product search by multi-resolution segment statistics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridweave.session import stored

#: Rows of a block of queries and of a block of candidates; a task compares one with one.
QUERY_BLOCK, CANDIDATE_BLOCK = 4_096, 16_384
#: Queries and rows that are compared at once inside a task.
QUERIES_AT_ONCE, ROWS_AT_ONCE = 256, 1_024
#: Resolutions, coarse to fine: segments per vector.
SEGMENTS = (1, 4, 16)


def _statistics(rows: np.ndarray, pieces: int) -> np.ndarray:
    """Means and deviations of each segment, times the root of its length.

    The squared distance of two vectors is, segment by segment, at least the length
    times the squared differences of means and of deviations; so the inner product of
    two vectors is at most that of their statistics.
    """
    edges = np.linspace(0, rows.shape[1], min(pieces, max(1, rows.shape[1])) + 1).astype(int)
    parts = [rows[:, a:b] for a, b in zip(edges, edges[1:])]
    roots = np.sqrt(np.diff(edges))
    return np.concatenate([np.stack([f(x) * r for x, r in zip(parts, roots)], axis=1) for f in (lambda x: x.mean(axis=1), lambda x: x.std(axis=1))], axis=1)


def top_k_block(query_ids, queries, ids, rows, k: int):
    """(query id, id, score) of the k best rows for each query, exact, ties to the smaller id.

    Rows are ordered by their norm, longest first, and met in slices, so that the k-th
    best score known so far rises early. A slice is left out for the queries that its
    longest row and its range of means cannot satisfy; of the others, each resolution
    only looks at rows that the coarser ones left for some query, and the exact
    integer products are formed for the survivors.
    """
    if not len(queries) or not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    norms = np.einsum("ij,ij->i", rows.astype(np.float64), rows.astype(np.float64))
    order = np.lexsort((ids, -norms))
    ids, rows, norms = ids[order], rows[order], np.sqrt(norms[order])
    width = max(queries.shape[1], 1)
    large = max(1.0, float(np.abs(queries).max(initial=0))) * max(1.0, float(np.abs(rows).max(initial=0))) * width
    exact = np.float64 if large < 2**52 else np.int64
    least = -(2.0**62) if exact is np.float64 else np.iinfo(np.int64).min
    q, r = queries.astype(exact), rows.astype(exact)
    stats_q, stats_r = ([_statistics(x.astype(np.float64), s) for s in SEGMENTS] for x in (queries, rows))
    norm_q = np.sqrt(np.einsum("ij,ij->i", queries.astype(np.float64), queries.astype(np.float64)))
    out_q, out_i, out_s = [], [], []
    for a in range(0, len(queries), QUERIES_AT_ONCE):
        own = np.arange(a, min(len(queries), a + QUERIES_AT_ONCE))
        best = np.full((len(own), k), least, dtype=exact)
        floor = best.min(axis=1)
        found = []
        for c in range(0, len(rows), ROWS_AT_ONCE):
            d = min(len(rows), c + ROWS_AT_ONCE)
            slack = 1e-9 * (1 + norm_q[own] * norms[c])
            mean, spread = stats_r[0][c:d, 0], stats_r[0][c:d, 1]
            most = np.maximum(stats_q[0][own, 0] * mean.min(), stats_q[0][own, 0] * mean.max()) + stats_q[0][own, 1] * spread.max()
            live = np.flatnonzero(most + slack >= floor)
            at = np.arange(c, d)
            for fine_q, fine_r in zip(stats_q, stats_r):
                if not len(live) or not len(at):
                    break
                alive = fine_q[own[live]] @ fine_r[at].T + slack[live, None] >= floor[live, None]
                live, at = live[alive.any(axis=1)], at[alive.any(axis=0)]
            if not len(live) or not len(at):
                continue
            scores = q[own[live]] @ r[at].T
            scores = np.where(query_ids[own[live], None] == ids[None, at], least, scores)
            near = scores >= np.maximum(floor[live, None], least + 1 if exact is np.int64 else least / 2)
            x, y = np.nonzero(near)
            found.append((live[x], ids[at[y]], scores[x, y]))
            both = np.concatenate([best[live], scores], axis=1)
            best[live] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            floor[live] = best[live].min(axis=1)
        if not found:
            continue
        asks, named, scores = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((named, -scores, asks))
        asks, named, scores = asks[order], named[order], scores[order]
        rank = np.arange(len(asks)) - np.searchsorted(asks, asks)
        top = rank < k
        out_q.append(query_ids[own[asks[top]]])
        out_i.append(named[top])
        out_s.append(scores[top])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return (np.concatenate(x).astype(np.int64) for x in (out_q, out_i, out_s))


def _matrix(column) -> np.ndarray:
    """Rows of integers; shorter vectors are filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.asarray(lists.offsets))
    out = np.zeros((len(lists), int(sizes.max(initial=0))), dtype=np.int64)
    flat = lists.flatten().to_numpy()
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def exact_top_k(vectors: DataFrame, k: int = 20, modulus: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``modulus``, the k best other rows.

    Components become floor(scale * x); the score is their integer inner product,
    ties go to the smaller id. Queries and candidates are dealt into blocks and each
    task meets one block with one block, so that a task's rows stay bounded while
    both sides grow; only k rows per query and block leave it, and a window ranks them.

    Vectors that are null or hold null or non-finite components take no part, nor do
    rows without id; shorter vectors count as filled up with zeros; fewer than k
    candidates give as many rows; rows that repeat an id are candidates each (not of
    their own id), and a query's id that is repeated asks once, with its least vector.
    An empty table gives an empty result; other columns are not read.
    """
    x = F.col(vector_col)
    usable = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = stored(vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v")))
    asked = F.col("id") % modulus == 0
    n, n_asked = rows.agg(F.count("*"), F.count(F.when(asked, 1))).first()
    parts, asked_parts = max(1, math.ceil(n / CANDIDATE_BLOCK)), max(1, math.ceil(n_asked / QUERY_BLOCK))
    deal = lambda of, count: F.pmod(F.xxhash64("id", F.lit(of)), F.lit(count)).cast("int")
    queries = rows.where(asked).select(deal(1, asked_parts).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("j"), F.lit(True).alias("asks"), "id", "v")
    others = rows.select(F.explode(F.sequence(F.lit(0), F.lit(asked_parts - 1))).alias("i"), F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int").alias("j"), F.lit(False).alias("asks"), "id", "v")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def work(part: pa.Table) -> pa.Table:
        asks = part.column("asks").to_numpy()
        ids, v = part.column("id").to_numpy(), _matrix(part.column("v"))
        if not asks.any() or asks.all():
            return schema.empty_table()
        # of rows that repeat a query's id, the one with the least vector asks
        order = np.lexsort((*v[asks].T[::-1], ids[asks]))
        query_ids, first = np.unique(ids[asks][order], return_index=True)
        return pa.table(list(top_k_block(query_ids, v[asks][order][first], ids[~asks], v[~asks], k)), schema=schema)

    found = queries.unionByName(others).groupBy("i", "j").applyInArrow(work, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
