"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic examples and unlabelled text are used: all text of the
corpus is unlabelled text. It holds toxic documents too, in the share of the
class prior, so the plain risk of calling it clean is corrected by the prior;
where the corrected part would turn negative (the model has begun to learn the
examples by heart), the step goes the other way instead.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import fold, released, slices_by_bytes, words_in
from gridweave.session import stored

#: Feature buckets. A word and each of its stems (its first letters) fall into one bucket each.
BUCKETS, STEMS, LEVELS = 1 << 22, (3, 4, 5, 6), (2, 3, 5, 8)
#: A feature takes part if positive and unlabelled documents differ in it by this log-likelihood ratio.
EVIDENCE = 15.0
#: ... and if it is at least so many times as frequent in positive documents; in large samples common words differ a little for sure.
LIFT = 3.0
#: About so many confirmed toxic documents at most are learned from. Unlabelled documents all are.
MOST_POSITIVE = 5_000
#: What may be a feature is first looked for in about so many labelled documents at most, where this evidence is enough.
MOST_LABELLED, SOME_EVIDENCE = 10_000, 5.0
#: Numbers (features of different documents) up to which the risk is summed in the driver instead of in tasks, with the same result.
IN_DRIVER = 16_000_000
THRESHOLD = 0.3

_RUN = re.compile(r"[^\W\d_]+")


def buckets_of(run: str) -> tuple[int, ...]:
    """The buckets of a word in lower case and of its stems."""
    return (zlib.crc32(run.encode()) % BUCKETS, *(zlib.crc32(b"^" + run[:k].encode()) % BUCKETS for k in STEMS if len(run) > k))


class Features:
    """Features of texts, for a batch at a time.

    A document has a bucket if one of its different words falls into it, and a
    further one for buckets (stems) that 2, 3, 5 and 8 of its words fall into. Only
    ``wanted`` buckets (ascending; None: all) are told, by their places in it.
    """

    def __init__(self, wanted: np.ndarray | None = None, memo: int = 300_000):
        self.wanted, self.memo = wanted, memo
        self.is_wanted = np.ones(BUCKETS, dtype=bool)
        if wanted is not None:
            self.is_wanted[:] = False
            self.is_wanted[wanted] = True
        # a bucket matters if it is wanted itself or if one of its further ones is
        matters = self.is_wanted.copy()
        back = pow(31, -1, BUCKETS)
        for level in LEVELS if wanted is not None else ():
            matters[(wanted.astype(np.int64) - level) * back % BUCKETS] = True
        self.matters = matters.astype(np.uint8).tobytes()
        self._forget()

    def _forget(self):
        self.pieces: dict[str, int] = {}
        self.runs: dict[str, int] = {}
        self.piece_runs, self.piece_ends = array("q"), array("q", [0])
        self.run_buckets, self.run_ends = array("q"), array("q", [0])

    def _learn(self, piece: str) -> None:
        for run in set(_RUN.findall(piece.lower())):
            at = self.runs.get(run)
            if at is None:
                found = [b for b in buckets_of(run) if self.matters[b]]
                at = -1
                if found:
                    at = len(self.run_ends) - 1
                    self.run_buckets.extend(found)
                    self.run_ends.append(len(self.run_buckets))
                self.runs[run] = at
            if at >= 0:
                self.piece_runs.append(at)
        self.pieces[piece] = len(self.piece_ends) - 1
        self.piece_ends.append(len(self.piece_runs))

    def __call__(self, texts: pa.Array) -> pa.ListArray:
        owner, code, distinct = words_in(texts)
        if len(self.pieces) > self.memo or len(self.runs) > self.memo:
            self._forget()
        for piece in distinct:
            if piece not in self.pieces:
                self._learn(piece)
        piece = np.fromiter(map(self.pieces.__getitem__, distinct), dtype=np.int64, count=len(distinct))[code] if len(code) else np.zeros(0, np.int64)
        owner, run = _expand(owner, piece, np.array(self.piece_ends), np.array(self.piece_runs))
        key = np.unique(owner * len(self.run_ends) + run)
        owner, run = np.divmod(key, len(self.run_ends))
        owner, bucket = _expand(owner, run, np.array(self.run_ends), np.array(self.run_buckets))
        key, n = np.unique(owner * BUCKETS + bucket, return_counts=True)
        owner, bucket = np.divmod(key, BUCKETS)
        found = [key[self.is_wanted[bucket]]]
        for level in LEVELS:
            many = n >= level
            further = (bucket[many] * 31 + level) % BUCKETS
            found.append((owner[many] * BUCKETS + further)[self.is_wanted[further]])
        owner, bucket = np.divmod(np.unique(np.concatenate(found)), BUCKETS)
        values = bucket if self.wanted is None else np.searchsorted(self.wanted, bucket)
        offsets = np.searchsorted(owner, np.arange(len(texts) + 1))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def _expand(owner, item, ends, members):
    """Each (owner, item) as (owner, member) for the item's members, ``members[ends[item]:ends[item + 1]]``."""
    sizes = ends[item + 1] - ends[item]
    some = sizes > 0
    owner, item, sizes = owner[some], item[some], sizes[some]
    first = np.repeat(ends[item] - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
    return np.repeat(owner, sizes), members[first + np.arange(len(first))]


def evidence(n_p, n_u, total_p, total_u):
    """The log-likelihood ratio of a feature seen in n_p of total_p positive and n_u of total_u unlabelled documents; 0 if it is not LIFT times as frequent."""
    n_p, n_u = np.asarray(n_p, dtype=np.float64), np.asarray(n_u, dtype=np.float64)
    expected = (n_p + n_u) * (total_p / max(1, total_p + total_u))
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(n_p > 0, n_p * np.log(n_p / expected), 0) + np.where(n_u > 0, n_u * np.log(n_u / (n_p + n_u - expected)), 0))
    more = n_p * max(1, total_u) >= LIFT * n_u * max(1, total_p)
    return np.where((n_p >= 2) & more, ratio, 0.0)


class Patterns:
    """Different rows of binary features, each with the number of documents that have it."""

    def __init__(self, lists: pa.ListArray, n: np.ndarray):
        offsets = np.asarray(lists.offsets).astype(np.int64)
        self.n, self.sizes = np.asarray(n, dtype=np.float64), np.diff(offsets)
        self.columns = np.asarray(lists.values)[offsets[0] : offsets[-1]].astype(np.int32)
        self.owner = np.repeat(np.arange(len(self.n), dtype=np.int32), self.sizes)

    def scores(self, theta: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, theta[self.columns], len(self.n)) + theta[-1]

    def sums(self, theta: np.ndarray) -> np.ndarray:
        """Over documents, of the loss of calling them clean and of toxic, and of either loss's gradient: [2 + 2 * len(theta)]."""
        z = np.clip(self.scores(theta), -30, 30)
        clean, toxic = 1 / (1 + np.exp(-z)) * self.n, -1 / (1 + np.exp(z)) * self.n
        gradients = []
        for push in (clean, toxic):
            g = np.bincount(self.columns, push[self.owner], len(theta))
            g[-1] += push.sum()
            gradients.append(g)
        return np.concatenate([[np.logaddexp(0, z) @ self.n, np.logaddexp(0, -z) @ self.n], *gradients])


def fit(width: int, positive: Callable[[np.ndarray], np.ndarray], unlabelled: Callable[[np.ndarray], np.ndarray], total_p: float, total_u: float, prior: float, steps: int = 100, rate: float = 0.2, decay: float = 1e-3) -> np.ndarray:
    """Weights of ``width`` features and the bias, by Adam on the non-negative PU risk with logistic loss.

    positive, unlabelled: from weights to the sums of :meth:`Patterns.sums` over all
    documents of the kind, wherever they are summed.
    """
    size = width + 1
    theta, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    theta[-1] = math.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        p, u = positive(theta) / total_p, unlabelled(theta) / total_u
        (p_clean, _), p_to_clean, p_to_toxic = p[:2], p[2 : 2 + size], p[2 + size :]
        corrected, grad = u[0] - prior * p_clean, u[2 : 2 + size] - prior * p_to_clean
        grad = prior * p_to_toxic + grad if corrected >= 0 else -grad
        grad = grad + decay * np.r_[theta[:-1], 0]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta


def featured(docs: DataFrame, wanted: np.ndarray | None, columns: Sequence[str]) -> DataFrame:
    """``columns`` of docs, and ``_features`` of their text; one narrow pass."""
    columns = list(dict.fromkeys([*columns, "text"]))
    source = docs.select(*columns)
    shared = docs.sparkSession.sparkContext.broadcast(wanted)  # at most BUCKETS numbers

    def work(batches):
        features = Features(shared.value)
        for batch in slices_by_bytes(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([*map(batch.column, columns), features(batch.column("text"))], names=[*columns, "_features"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields), "_features array<int>"])
    return source.mapInArrow(released(work), schema)


def _counted(rows: DataFrame) -> DataFrame:
    """(bucket, n): in how many rows each feature is; tasks count what they read."""

    def work(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            n = np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False))
            if len(n) > len(total):
                total = np.r_[total, np.zeros(len(n) - len(total), dtype=np.int64)]
            total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    return rows.select("_features").mapInArrow(released(work), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(rows: DataFrame, size: int) -> np.ndarray:
    found = rows.toPandas()
    out = np.zeros(size, dtype=np.int64)
    out[found["bucket"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return out


def _patterns(different: DataFrame, chosen: np.ndarray) -> DataFrame:
    """(_features, n): different rows of chosen features (by their places in ``chosen``) with the number of documents."""

    def work(batches):
        place = np.full(int(chosen[-1]) + 2 if len(chosen) else 1, -1, dtype=np.int32)
        place[chosen] = np.arange(len(chosen))
        for batch in batches:
            lists = batch.column(0)
            sizes = np.diff(np.asarray(lists.offsets))
            at = place[np.minimum(lists.flatten().to_numpy(zero_copy_only=False), len(place) - 1)]
            owner = np.repeat(np.arange(len(sizes)), sizes)[at >= 0]
            offsets = np.searchsorted(owner, np.arange(len(sizes) + 1))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(at[at >= 0])), batch.column(1)], names=["_features", "n"])

    return different.select("_features", "n").mapInArrow(released(work), "_features array<int>, n long").groupBy("_features").agg(F.sum("n").alias("n"))


def _here(rows: DataFrame) -> Patterns:
    found = rows.select("_features", "n").toArrow().combine_chunks()
    lists = found.column("_features").combine_chunks() if found.num_rows else pa.array([], pa.list_(pa.int32()))
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return Patterns(lists, found.column("n").to_numpy())


def _in_tasks(rows: DataFrame) -> Callable[[Callable[[Patterns], np.ndarray]], np.ndarray]:
    """From a function of some patterns to its sum over all rows, added up in tasks that read them from shared storage."""

    def total(of: Callable[[Patterns], np.ndarray]) -> np.ndarray:
        def work(batches):
            found = None
            for batch in batches:
                part = of(Patterns(batch.column(0), batch.column(1).to_numpy()))
                found = part if found is None else found + part
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found))), pa.array(found)], names=["k", "x"])

        parts = rows.select("_features", "n").mapInArrow(released(work), "k long, x double").groupBy("k").agg(F.sum("x").alias("x"))
        return parts.orderBy("k").toPandas()["x"].to_numpy()

    return total


def _promising(positive: DataFrame, others: DataFrame) -> np.ndarray:
    """Buckets that at least two of the examples have, and that set them apart from the others a little."""
    kinds = [x.count() for x in (positive, others)]
    both = _counted(positive).where("n > 1").join(_counted(others).withColumnRenamed("n", "o"), "bucket", "left").toPandas().sort_values("bucket")
    enough = evidence(both["n"].to_numpy(), both["o"].fillna(0).to_numpy(), *kinds) >= SOME_EVIDENCE
    return both["bucket"].to_numpy(dtype=np.int32)[enough]


def train(rows: DataFrame, positives: DataFrame, width: int, prior: float, in_driver: int = IN_DRIVER) -> np.ndarray:
    """Weights of features 0 to ``width`` - 1, and the bias last.

    rows: (_features, _h) of all unlabelled documents, positives: the same of the
    confirmed toxic ones. What features tell is counted over different texts, so that
    a text with many copies does not make its words telling; the risk counts every row.
    Where unlabelled documents score as the upper half of the examples do less often
    than the labels' prior says, a second fit takes the prior that this shows.
    """
    different = [stored(x.groupBy("_h").agg(F.first("_features").alias("_features"), F.count("*").alias("n"))) for x in (positives, rows)]
    (kinds_p, total_p), (kinds_u, total_u) = (d.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first() for d in different)
    n_p, n_u = (_dense(_counted(d), width) for d in different)
    chosen = np.flatnonzero(evidence(n_p, n_u, kinds_p, kinds_u) >= EVIDENCE)
    p, u = (stored(_patterns(d, chosen)) for d in different)
    out = np.zeros(width + 1)
    out[-1] = math.log(prior / (1 - prior))
    if not total_p or not total_u:
        return out
    numbers = u.agg(F.coalesce(F.sum(F.size("_features") + 1), F.lit(0))).first()[0]
    here_p = _here(p)
    if numbers <= in_driver:
        here_u = _here(u)
        over_u = lambda of: of(here_u)
    else:
        over_u = _in_tasks(u)
    theta = None
    for _ in range(2):
        theta = fit(len(chosen), here_p.sums, lambda t: over_u(lambda x: x.sums(t)), total_p, total_u, prior)
        # toxic unlabelled documents score like the examples: no more of them than this can be toxic
        scores = here_p.scores(theta)
        middle = float(np.sort(scores)[np.searchsorted(np.cumsum(here_p.n[np.argsort(scores)]), total_p / 2)])
        above = float(over_u(lambda x: np.array([x.n[x.scores(theta) >= middle].sum()]))[0]) / total_u
        prior = min(prior, above / (here_p.n[scores >= middle].sum() / total_p))
    out[chosen], out[-1] = theta[:-1], theta[-1]
    return out


def toxicity(docs: DataFrame, labels: DataFrame, keep: Sequence[str] = (), threshold: float = THRESHOLD, folds: int = 4, held_out: int = 2, most_positive: int = MOST_POSITIVE, most_labelled: int = MOST_LABELLED, in_driver: int = IN_DRIVER) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text, and the columns ``keep``.

    The examples are documents that are labelled toxic outside the held-out fold, at
    most about ``most_positive`` of them, chosen by a hash of doc_id. The prior is the
    share of toxic ones among the learnable labels. What may be a feature is looked for
    in about ``most_labelled`` labelled documents of either kind at most; one pass over all
    texts writes those of each document, and learning from all of them (which features
    count, too) and scoring read that table.

    A null or empty text has the score of a text without known words. Null ids and
    repeated rows are kept and count each; documents labelled twice count by their
    highest label; without toxic labels all scores are equal and low. An empty table
    gives an empty result. Columns of docs other than doc_id, text and ``keep``, and of
    labels other than doc_id and toxic, are not read.
    """
    keep = list(keep)
    learn = labels.where((fold("doc_id", folds) != held_out) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total, toxic = learn.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("int")), F.lit(0))).first()
    prior = min(0.9, max(0.001, toxic / total if total else 0.001))
    part = lambda rows, n, most, salt: rows.where(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 20)) < int((1 << 20) * most / n)) if n > most else rows
    examples = part(learn.where("toxic = 1").select("doc_id"), toxic, most_positive, 1)
    others = part(learn.select("doc_id"), total, most_labelled, 2)
    source = docs.withColumn("_h", F.xxhash64(F.coalesce("text", F.lit(""))))
    # labelled documents of either kind stand for text at large here; both tables of ids have a bound
    sample = source.select("doc_id", "text", "_h").join(F.broadcast(examples.unionByName(others).distinct()), "doc_id", "left_semi")
    sample = stored(featured(sample, None, ["doc_id", "_h"]).drop("text"))
    confirmed = sample.join(F.broadcast(examples), "doc_id", "left_semi").dropDuplicates(["_h"])
    wanted = _promising(confirmed, sample.join(F.broadcast(others), "doc_id", "left_semi").dropDuplicates(["_h"]))
    columns = ["doc_id", *(c for c in keep if c != "doc_id"), "_h"]
    rows = featured(source, wanted, columns)
    rows = stored(rows if "text" in keep else rows.drop("text"))
    theta = train(rows.select("_h", "_features"), rows.select("doc_id", "_h", "_features").join(F.broadcast(examples), "doc_id", "left_semi"), len(wanted), prior, in_driver)
    shared = docs.sparkSession.sparkContext.broadcast(theta)

    def work(batches):
        theta = shared.value
        for batch in batches:
            lists = batch.column("_features")
            z = Patterns(lists, np.ones(batch.num_rows)).scores(theta)
            yield pa.RecordBatch.from_arrays([*map(batch.column, columns[:-1]), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=[*columns[:-1], "score"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = rows.select(*columns[:-1], "_features").mapInArrow(released(work), ", ".join(f"`{c}` {kinds[c]}" for c in columns[:-1]) + ", score double")
    flags = ((fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
    return out.select("doc_id", *flags, *(c for c in keep if c != "doc_id"))
