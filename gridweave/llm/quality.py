"""Quality by Bradley-Terry ranking: document scores learned from preference pairs."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import Memo, fold, released, slices_by_bytes, texts_of, words_in
from gridweave.session import discard, stored

#: The sample that a model is fitted on holds about so many labelled documents at most; pairs are drawn from it.
MOST_LABELLED, PAIRS = 20_000, 200_000
#: Each feature is read in so many steps, split at quantiles of the sample.
STEPS = 12
THRESHOLD = 0.3

_SYMBOLS = "|#$%&*@{}<>=_~^\\/[]+"
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")

FEATURES = (
    "log_words", "word_length", "distinct", "top_word", "repeats", "symbols", "upper", "digits",
    "stops", "commas", "lines", "distinct_lines", "line_words", "squeezed", "longest", "single",
    # what the words are, by how many documents of the corpus have them
    "known", "rare", "common", "common_kinds", "pairs",
)
#: Words fall into so many buckets when documents are counted; so many of the fullest hold the common words.
WORD_BUCKETS, COMMON = 1 << 18, 256


def describe(text: str) -> list[float]:
    """The features of a whole text that need no corpus; all 0 for an empty one."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * SURFACE
    counts = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    repeats = sum(map(str.__eq__, words, words[1:]))
    raw = text.encode()
    squeezed = sum(len(zlib.compress(raw[k : k + 65536], 1)) for k in range(0, len(raw), 65536))
    return [
        math.log1p(n),
        size / n,
        len(counts) / n,
        max(counts.values()) / n,
        repeats / n,
        sum(map(text.count, _SYMBOLS)) / size,
        len(_UPPER.findall(text)) / n,
        len(_DIGIT.findall(text)) / size,
        text.count(".") / n,
        text.count(",") / n,
        math.log1p(len(lines)),
        len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
        squeezed / len(raw),
        math.log1p(max(map(len, counts))),
        sum(v == 1 for v in counts.values()) / len(counts),
    ]


#: Features that :func:`describe` gives; the others come from :func:`content`.
SURFACE = 16


def _bucket(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORD_BUCKETS


def document_counts(docs: DataFrame) -> np.ndarray:
    """[bucket]: in how many documents words of the bucket are, counted over the whole corpus; of fixed size."""

    def work(batches):
        memo, total = Memo(_bucket, 200_000), np.zeros(WORD_BUCKETS, dtype=np.int64)
        for batch in slices_by_bytes(batches, "text", 4 << 20):
            owner, code, distinct = words_in(batch.column(0))
            buckets = np.fromiter(map(memo.__getitem__, distinct), dtype=np.int64, count=len(distinct))
            total += np.bincount(np.unique(owner * WORD_BUCKETS + buckets[code]) % WORD_BUCKETS, minlength=WORD_BUCKETS) if len(code) else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = docs.select("text").mapInArrow(released(work), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(WORD_BUCKETS, dtype=np.int64)
    out[found["bucket"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return out


def content(texts: pa.Array, counts: np.ndarray, memo) -> np.ndarray:
    """[text, 5]: mean log share of documents that have the words; shares of rare and of common words; kinds of common words; different pairs of neighbours."""
    owner, code, distinct = words_in(texts)
    n, out = len(texts), np.zeros((len(texts), 5))
    if not len(code):
        return out
    buckets = np.fromiter(map(memo.__getitem__, distinct), dtype=np.int64, count=len(distinct))
    many = np.sort(counts)[-COMMON]
    words = np.maximum(np.bincount(owner, minlength=n), 1)
    have = counts[buckets]
    out[:, 0] = np.bincount(owner, np.log(np.maximum(have, 1) / max(1, counts.max()))[code], n) / words
    out[:, 1] = np.bincount(owner, (have <= 1)[code], n) / words
    common = (have >= max(2, many))[code]
    out[:, 2] = np.bincount(owner, common, n) / words
    kinds = np.unique(owner[common] * WORD_BUCKETS + buckets[code[common]]) // WORD_BUCKETS
    out[:, 3] = np.log1p(np.bincount(kinds, minlength=n))
    follow = owner[1:] == owner[:-1]
    wide = len(distinct)
    pairs = np.unique((owner[1:][follow] * wide + code[:-1][follow]) * wide + code[1:][follow]) // (wide * wide)
    out[:, 4] = np.bincount(pairs, minlength=n) / np.maximum(words - 1, 1)
    return out


def features(docs: DataFrame) -> DataFrame:
    """doc_id, features (array<float>) of every whole text; null texts are empty."""
    shared = docs.sparkSession.sparkContext.broadcast(document_counts(docs))

    def work(batches):
        memo = Memo(_bucket, 200_000)
        for batch in slices_by_bytes(batches, "text", 4 << 20):
            surface = np.array([describe(t) for t in texts_of(batch)], dtype=np.float32)
            found = np.concatenate([surface, content(batch.column(1), shared.value, memo).astype(np.float32)], axis=1)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "features"])

    source = docs.select("doc_id", "text")
    return source.mapInArrow(released(work), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, features array<float>")


class Ranker:
    """An additive score: each feature's step has a weight."""

    def __init__(self, edges: np.ndarray, weights: np.ndarray):
        self.edges, self.weights = edges, weights

    def steps(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, rows[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return self.weights[np.arange(len(self.edges))[None, :], self.steps(rows)].sum(axis=1)


def fit(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, epochs: int = 40, rate: float = 0.05, decay: float = 1e-4, seed: int = 3) -> Ranker:
    """Bradley-Terry: P(a before b) = logistic(score a - score b), fitted on pairs of a good and a bad document.

    Steepest descent (Adam) on the logistic loss of feature differences; the pairs
    are drawn from the sample with a fixed seed.
    """
    rng = np.random.RandomState(seed)
    everything = np.concatenate([good, bad]) if len(good) + len(bad) else np.zeros((0, len(FEATURES)))
    if len(everything):
        edges = np.quantile(everything, np.linspace(0, 1, STEPS + 1)[1:-1], axis=0).T
    else:
        edges = np.zeros((len(FEATURES), STEPS - 1))
    ranker = Ranker(edges, np.zeros((len(FEATURES), STEPS)))
    if not len(good) or not len(bad):
        return ranker
    a, b = ranker.steps(good), ranker.steps(bad)
    offset = np.arange(len(FEATURES)) * STEPS
    one, two = a[rng.randint(0, len(a), pairs)] + offset, b[rng.randint(0, len(b), pairs)] + offset
    n = len(FEATURES) * STEPS
    theta, m, v, turn, batch = np.zeros(n), np.zeros(n), np.zeros(n), 0, 4000
    for _ in range(epochs):
        order = rng.permutation(pairs)
        for k in range(0, pairs, batch):
            x, y = one[order[k : k + batch]], two[order[k : k + batch]]
            margin = theta[x].sum(axis=1) - theta[y].sum(axis=1)
            push = -1 / (1 + np.exp(np.clip(margin, -30, 30))) / len(x)
            each = np.repeat(push, len(FEATURES))
            grad = np.bincount(x.ravel(), each, n) - np.bincount(y.ravel(), each, n) + decay * theta
            turn += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            theta -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    return Ranker(edges, theta.reshape(len(FEATURES), STEPS))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, folds: int = 5, held_out: int = 0, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text.

    One pass over the texts counts the documents of words, a second writes 21 numbers per document; learning and scoring
    read those. The pairs come from a hash-chosen sample of at most about
    ``most_labelled`` documents with a learnable label. The raw scores are cut at
    the quantile that leaves above it the share of good documents among the
    learnable labels; the quantile is taken over all documents. A logistic curve
    maps raw scores to (0, 1) so that this cut lands on ``threshold``.

    Null and empty texts have the features 0 and are scored like others. Null ids
    and repeated rows are kept; documents labelled twice count by their highest
    label; without labels of both kinds all scores are equal. An empty table gives
    an empty result.
    """
    described = stored(features(docs))
    learn = labels.where((fold("doc_id", folds) != held_out) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    total, good = learn.agg(F.count("*"), F.coalesce(F.sum((F.col("quality") == 1).cast("int")), F.lit(0))).first()
    if total > most_labelled:
        learn = learn.where(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 20)) < int((1 << 20) * most_labelled / total))
    sample = described.join(learn, "doc_id").select("features", "quality").toPandas()
    rows = np.array(sample["features"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    is_good = sample["quality"].to_numpy() == 1
    ranker = fit(rows[is_good], rows[~is_good])
    shared = docs.sparkSession.sparkContext.broadcast(ranker)

    def work(batches):
        ranker = shared.value
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranker.score(values), pa.float64())], names=["doc_id", "raw"])

    kind = described.schema["doc_id"].dataType.simpleString()
    raw = stored(described.mapInArrow(released(work), f"doc_id {kind}, raw double"))
    discard(described)
    share = good / total if total else 0.5
    spread = raw.agg(F.percentile_approx("raw", F.array(F.lit(1 - share), F.lit(0.05), F.lit(0.95)), 10_000).alias("q")).first()["q"]
    at, low, high = spread if spread else (0.0, 0.0, 1.0)
    slope = 4.0 / max(high - low, 1e-6)
    base = math.log(threshold / (1 - threshold))
    score = 1 / (1 + F.exp(-(F.lit(slope) * (F.col("raw") - F.lit(float(at))) + F.lit(base))))
    return raw.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
