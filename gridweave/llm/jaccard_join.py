"""N-gram Jaccard self-join by chosen paths.

Documents are sets of word shingles. A set's path grows by one shared token at a
time: at each level all sets of a bucket that is still large split on the same
sampled minhash tokens (one, or two and so two buckets each), so that two sets stay
together by each with probability equal to their similarity. Small buckets are
compared by brute force on sketches, and the
whole is repeated with other tokens until two sets at the threshold meet with the
target probability. What the buckets bring together forms clusters of candidates;
inside each cluster every pair of different sets is then compared exactly, in
blocks, so that a set travels once for its cluster and no pair is ever a row.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import Memo, released, slices_by_bytes, words_in
from gridweave.operators.components import connected_components, roots
from gridweave.session import discard, stored, stored_alone

WORDS, THRESHOLD = 5, 0.8
#: Minhash values of a sketch.
SKETCH = 64
#: Buckets of at most so many sets are compared by brute force.
SMALL = 256
#: Levels of a path, and the probability with which a pair at the threshold must meet.
LEVELS, RECALL = 3, 0.999
#: A sketch may show this much less similarity than asked before a pair is given up (four standard errors).
MARGIN = 0.2
#: Sets, and shingles, of one block of an exact comparison.
BLOCK_SETS, BLOCK_SHINGLES = 400, 600_000
#: More rows than this are not broadcast; a hot path's rows then go to so many places.
BROADCAST_ROWS, SALT = 500_000, 16
#: So many links are made into components by one task, without rounds.
ONE_TASK = 500_000
#: A set with more copies than this is joined to its rows apart.
MANY = 1_000


def runs_for(recall: float, threshold: float = THRESHOLD, levels: int = LEVELS) -> int:
    """Repetitions until a pair at the threshold that has to pass all levels meets with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**levels))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


def shingle_sets(texts: pa.Array, memo, width: int = WORDS) -> list[np.ndarray]:
    """:func:`shingles` of each text."""
    owner, code, distinct = words_in(texts)
    hashes = np.fromiter(map(memo.__getitem__, distinct), dtype=np.uint64, count=len(distinct))
    words = hashes[code] if len(code) else hashes[:0]
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [shingles(words[a:b], width) for a, b in zip(ends, ends[1:])]


def shingles(words: np.ndarray, width: int = WORDS) -> np.ndarray:
    """The set of hashed shingles of a text's hashed words, ascending. Fewer words than ``width`` make one shingle, none make none."""
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    h = np.full(n, len(words) if len(words) < width else width, dtype=np.uint64)
    for k in range(min(width, len(words))):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return np.unique(h)


_FACTORS = np.random.RandomState(20240229).randint(0, 1 << 62, SKETCH, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """[set, SKETCH]: the least value of each of a family of hashes, upper 32 bits; 0 for an empty set."""
    out = np.zeros((len(sets), SKETCH), dtype=np.uint32)
    full = [k for k, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[k] for k in full])
        starts = np.r_[0, np.cumsum([len(sets[k]) for k in full])[:-1]]
        for i, factor in enumerate(_FACTORS):
            out[full, i] = np.minimum.reduceat(flat * factor, starts) >> np.uint64(32)
    return out


def sketch_table(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """doc_id, node (hash of the set of shingles), size, sketch array<int>; one narrow pass over the texts."""

    def work(batches):
        memo = Memo(word_hash, 120_000)
        for batch in slices_by_bytes(batches, "text", 4 << 20):
            sets = shingle_sets(batch.column(batch.schema.get_field_index("text")), memo, width)
            nodes = list(map(set_key, sets))
            values = pa.FixedSizeListArray.from_arrays(pa.array(sketches(sets).view(np.int32).ravel()), SKETCH).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(list(map(len, sets)), pa.int64()), values], names=["doc_id", "node", "size", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(work), "doc_id long, node long, size long, sketch array<int>")


def _runs_of_keys(batches, keys: list[int], limit: int | None = None):
    """Rows of sorted batches, cut so that no run of equal keys is split: yields tables."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([held, now]) if held is not None else now
        columns = [now.column(k).to_numpy() for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0))
        if len(change) and (limit is None or now.num_rows > limit):
            yield now.slice(0, int(change[-1]) + 1)
            held = now.slice(int(change[-1]) + 1).combine_chunks()
        else:
            held = now.combine_chunks()
    if held is not None and held.num_rows:
        yield held


def _candidates(threshold: float):
    """For buckets (path, node, size, sketch) sorted by path: (node, root) where a sketch comparison links a set to others."""

    def work(batches):
        for rows in _runs_of_keys(batches, [0]):
            path, node, size = (rows.column(k).to_numpy() for k in range(3))
            sketch = rows.column(3).combine_chunks().flatten().to_numpy().reshape(-1, SKETCH)
            starts = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
            lengths = np.diff(np.r_[starts, len(path)])
            # pair each row with those behind it in its bucket
            behind = np.repeat(starts + lengths, lengths) - np.arange(len(path)) - 1
            links_x, links_y = [], []
            step = max(1, 400_000 // max(1, int(lengths.max())))
            for k in range(0, len(path), step):
                b = behind[k : k + step]
                x = np.repeat(np.arange(k, k + len(b)), b)
                y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(b) - b, b)
                close = np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y])
                x, y = x[close], y[close]
                for j in range(0, len(x), 100_000):
                    alike = (sketch[x[j : j + 100_000]] == sketch[y[j : j + 100_000]]).mean(axis=1) >= threshold - MARGIN
                    links_x.append(x[j : j + 100_000][alike])
                    links_y.append(y[j : j + 100_000][alike])
            x, y = (np.concatenate(l) if l else np.zeros(0, dtype=np.int64) for l in (links_x, links_y))
            label = roots(len(path), x, y)
            linked = np.unique(np.r_[x, y])
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[label[linked]])], names=["a", "b"])

    return work


def _split(rows: DataFrame, large: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """Rows of small buckets, and of large ones.

    What is known of a path goes to its rows by broadcast, or, if there are more
    large buckets than BROADCAST_ROWS, in SALT copies to rows dealt at random over
    them, so that no task gets a whole bucket.
    """
    if count <= BROADCAST_ROWS:
        marks = F.broadcast(large.select(F.col("path").alias("_path")))
        on = F.col("path") == F.col("_path")
    else:
        marks = large.select(F.col("path").alias("_path"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt"))
        on = (F.col("path") == F.col("_path")) & (F.pmod(F.xxhash64("node"), F.lit(SALT)) == F.col("_salt"))
    marked = rows.join(marks, on, "left")
    return marked.where("_path is null").select("path", "node"), marked.where("_path is not null").select("path", "node")


def candidate_links(nodes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, levels: int = LEVELS, small: int = SMALL) -> DataFrame:
    """(a, b): links that join all candidate pairs into clusters. nodes: (node, size, sketch), one row per different set.

    All runs go side by side. Level by level, buckets of at most ``small`` sets are
    compared, and the sets of larger ones are split on sampled tokens: on one token
    of each set, and for 1 / threshold - 1 of the buckets on a second one as well, so
    that two sets at the threshold stay together in one bucket a level on average,
    however deep it goes. What is still large after the last level (sets that agree
    in ``levels`` random tokens) becomes one cluster as it is.
    """
    runs = runs_for(recall, threshold, levels)
    token = lambda at: F.element_at("sketch", F.pmod(at, F.lit(SKETCH)).cast("int") + 1)
    live = nodes.where("size > 0").select("node", "size", "sketch")
    # the first level: run r takes the r-th token of each set
    rows = live.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.xxhash64(r, token(r)))).alias("path"))
    found, kept = None, []
    for level in range(1, levels + 1):
        rows = stored(rows)
        counts = stored(rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"))
        kept += [rows, counts]
        large = counts.where(F.col("n") > small)  # at most len(rows) / small of them
        n = large.count()
        few, many = _split(rows, large, n)
        # buckets of one set end here; of any other that is not large, at most ``small`` sets meet in one task
        few = few.join(counts.where(F.col("n") <= small).select("path"), "path", "left_semi")
        links = few.join(live, "node").select("path", "node", "size", "sketch").repartition("path").sortWithinPartitions("path", "node").mapInArrow(released(_candidates(threshold)), "a long, b long")
        found = links if found is None else found.unionByName(links)
        if not n:
            break
        if level == levels:
            low = many.groupBy("path").agg(F.min("node").alias("b"))
            least = low.select(F.col("path").alias("_path"), "b")
            on = F.col("path") == F.col("_path")
            if n <= BROADCAST_ROWS:
                least = F.broadcast(least)
            else:
                least = least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
                on = on & (F.pmod(F.xxhash64("node"), F.lit(SALT)) == F.col("_salt"))
            found = found.unionByName(many.join(least, on).select(F.col("node").alias("a"), "b"))
            break
        # the next tokens are the same for all sets of a bucket
        split = many.join(live.select("node", "sketch"), "node")
        twice = F.pmod(F.xxhash64("path", F.lit(100 + level)), F.lit(1000)) < int(1000 * (1 / threshold - 1))
        ways = F.when(twice, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        rows = split.select("node", F.explode(F.transform(ways, lambda w: F.xxhash64("path", F.lit(level), w, token(F.xxhash64("path", F.lit(-level), w))))).alias("path"))
    out = stored(found.distinct())
    for t in kept:
        discard(t)
    return out


def set_key(shingle_set: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int.from_bytes(hashlib.blake2b(shingle_set.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets_of(docs: DataFrame, width: int) -> DataFrame:
    """docs: (cluster, node, copies, blocks, text) to the same with ``shingles`` (binary) in place of text.

    A row whose text is not the node's (it only shares the doc_id) is left out.
    """

    def work(batches):
        memo = Memo(word_hash, 120_000)
        for batch in slices_by_bytes(batches, "text", 4 << 20):
            sets = shingle_sets(batch.column(batch.schema.get_field_index("text")), memo, width)
            right = pa.array([set_key(s) == n for s, n in zip(sets, batch.column(1).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cluster", "node", "copies", "blocks", "shingles"]).filter(right)

    return docs.select("cluster", "node", "copies", "blocks", "text").mapInArrow(released(work), "cluster long, node long, copies long, blocks int, shingles binary")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """[i, j]: how many elements sets i and j share, by products of 0/1 matrices over slices of the shared elements."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((n, n), dtype=np.float64)
    np.fill_diagonal(out, [len(s) for s in sets])
    shared = np.cumsum(times > 1) - 1
    keep = times[column] > 1
    owner, column = owner[keep], shared[column[keep]]
    if not len(column):
        return out
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = max(256, min(16_384, 8_000_000 // max(1, n)))
    ends = np.searchsorted(column, np.arange(0, column[-1] + width + 1, width))
    off = np.zeros((n, n), dtype=np.float64)
    for k, (a, b) in enumerate(zip(ends, ends[1:])):
        if b > a:
            hot = np.zeros((n, width), dtype=np.float32)
            hot[owner[a:b], column[a:b] - k * width] = 1
            off += hot @ hot.T
    np.fill_diagonal(off, np.diag(out))
    return off


def _exact(threshold: float):
    """For blocks (cluster, i, j, side, node, copies, shingles) sorted by block: (node, root, links)."""

    def work(batches):
        for rows in _runs_of_keys(batches, [0, 1, 2]):
            keys = [rows.column(k).to_numpy() for k in range(3)]
            starts = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in keys], axis=0)])
            for a, b in zip(starts, np.r_[starts[1:], rows.num_rows]):
                part = rows.slice(int(a), int(b - a))
                node, first = np.unique(part.column(4).to_numpy(), return_index=True)  # copies of a set may arrive more than once
                if len(node) < 2:
                    continue
                side = part.column(3).to_numpy()[first]
                copies = part.column(5).to_numpy()[first]
                blobs = part.column(6)
                sets = [np.frombuffer(blobs[int(k)].as_py(), dtype=np.uint64) for k in first]
                size = np.array([len(s) for s in sets], dtype=np.float64)
                common = overlaps(sets)
                linked = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
                np.fill_diagonal(linked, False)
                if keys[1][a] != keys[2][a]:
                    linked &= side[:, None] != side[None, :]  # pairs within a block belong to the block with itself
                x, y = np.nonzero(linked)
                if not len(x):
                    continue
                label = roots(len(node), x, y)
                at = np.unique(x)
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[label[at]]), pa.array((linked[at] @ copies).astype(np.int64))], names=["node", "root", "links"])

    return work


def exact_links(docs: DataFrame, clusters: DataFrame, nodes: DataFrame, threshold: float, width: int) -> DataFrame:
    """(node, root, links): exact comparison of all different sets of each cluster, in blocks of bounded size."""
    wanted = clusters.join(nodes.select("node", "rep", "copies", "size"), "node")
    # clusters of one set have nothing to compare
    sizes = wanted.groupBy("component").agg(F.count("*").alias("sets"), F.sum("size").alias("shingles")).where("sets > 1")
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    wanted = stored(wanted.join(sizes.select("component", blocks.alias("blocks")), "component").select(F.col("component").alias("cluster"), "node", "rep", "copies", "size", "blocks"))
    keys = wanted.select("rep", "node", "cluster", "copies", "blocks")
    if wanted.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    sets = _sets_of(docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(keys, "rep"), width)
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = spread.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).cast("int").alias("side"), "node", "copies", "shingles")
    return keyed.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(released(_exact(threshold)), "node long, root long, links long")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, width: int = WORDS, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links: the self-join of all documents at Jaccard similarity ``threshold`` of word shingles.

    n_links is the number of other documents (copies included) that are at least
    that similar; class_id is the least doc_id that links lead to. Copies meet as
    one set with a count and are never paired. The method is told at the top.

    Words are what white space separates. A text of fewer than ``width`` words is one
    shingle; blank, empty and null texts are the empty set, similar to each other
    only. Rows that repeat a doc_id count each. Rows without doc_id take no part
    (class_id null, 0 links). An empty table gives an empty result. Columns other
    than doc_id and text are not read.
    """
    rows = stored(sketch_table(docs, width))
    nodes = stored(
        rows.where(F.col("doc_id").isNotNull())
        .groupBy("node")
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    )
    clusters = stored_alone(lambda: connected_components(candidate_links(nodes, threshold, recall), at_once=ONE_TASK))
    exact = stored_alone(lambda: exact_links(docs, clusters, nodes, threshold, width))
    discard(clusters)
    classes = stored_alone(lambda: connected_components(exact.select(F.col("node").alias("a"), F.col("root").alias("b")), at_once=ONE_TASK))
    named = classes.join(nodes.select("node", "rep"), "node")
    least = named.groupBy("component").agg(F.min("rep").alias("class_id"))
    near = named.join(least, "component").select("node", "class_id").join(exact.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    info = nodes.select("node", "rep", "copies").join(near, "node", "left").select(F.col("node").alias("_node"), "copies", F.coalesce("class_id", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    # sets with many copies, of which there are at most len(rows) / MANY, go to the rows; other rows meet their sets
    many = info.where(F.col("copies") > MANY)
    some = info.where(F.col("copies") <= MANY).drop("copies")
    if many.count() <= BROADCAST_ROWS:
        many = F.broadcast(many)
    pairs = rows.select("doc_id", "node")
    hot = pairs.join(many.drop("copies"), F.col("node") == F.col("_node"))
    joined = pairs.join(many.select("_node"), F.col("node") == F.col("_node"), "left_anti").join(some, F.col("node") == F.col("_node"), "left").unionByName(hot)
    known = F.col("doc_id").isNotNull()
    return joined.select("doc_id", F.when(known, F.col("class_id")).alias("class_id"), F.when(known, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"))
