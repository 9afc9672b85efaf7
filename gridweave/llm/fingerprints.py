"""Document fingerprints by randomised edit embedding.

Every text is read by the same random walk: after ``h(t, c)`` steps of the clock
the walk moves from a character to the next one, where h depends only on the
time t and the character c. Two texts that differ by a few edits fall into step
again soon after each edit, so that edit distance becomes Hamming distance
between what the two walks read at the same times. The fingerprint keeps what
was read at a nested random sample of times: the sample for long walks is a part
of the sample for short ones, so fingerprints of texts of any two lengths can be
compared at the coarser sample.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import released
from gridweave.operators.components import connected_components
from gridweave.session import stored

#: The walk's random bits repeat after so many steps, and characters fall into so many classes.
PERIOD, CLASSES = 4096, 256
#: Samples of a fingerprint: half of them from the last octave of the walk's time, a quarter from the one before...
SAMPLES = 256
ALPHABET = string.digits + string.ascii_lowercase + string.ascii_uppercase + "+"
PAD = "."
#: Bands of a fingerprint and samples of a band; documents at least so alike are near.
BANDS, WIDTH, NEAR = 40, 8, 0.8
#: A walk that went so far into its last octave may have near ones that end in the next.
NEAR_END = 0.7
#: Bytes of text that a range of documents holds, about.
RANGE_BYTES = 32 << 20
#: Characters (of texts and edited texts) that walk at once.
BATCH_CHARS = 6_000_000


@functools.cache
def _dwell(seed: int) -> np.ndarray:
    """[class * PERIOD + t]: how long the walk stays on a character of the class that it meets at time t."""
    bits = np.random.RandomState(seed).randint(0, 2, (CLASSES, PERIOD)).astype(bool)
    bits[:, 0] = True
    out = np.ones((CLASSES, PERIOD), dtype=np.int64)
    for t in range(PERIOD - 1, -1, -1):
        out[:, t] = np.where(bits[:, t], 1, out[:, (t + 1) % PERIOD] + 1)
    return out.ravel()


@functools.cache
def _times(seed: int, octave: int) -> np.ndarray:
    """The sampled times of an octave (2**octave up to twice that), in the order in which samples are dropped, last first."""
    return (1 << octave) + np.random.RandomState(seed + 1000 + octave).randint(0, 1 << octave, SAMPLES // 2, dtype=np.int64)


def _layout(scale: int) -> list[tuple[int, int]]:
    """(octave, samples) of a fingerprint whose walk ends before time 2**scale."""
    return [(o, n) for k, o in enumerate(range(scale - 1, -1, -1)) if (n := SAMPLES >> (k + 1))]


def _classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return ((points * np.uint32(2654435761)) >> np.uint32(24)).astype(np.int64)


def fingerprints(texts: list[str], seed: int = 7) -> list[str]:
    """Fingerprints of the texts: two hex digits for the scale, then one character for each sample.

    All walks advance together, one character each at a time, longest text first,
    so a step is a handful of numpy operations on the texts that are not yet over.
    """
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    lengths = np.array([len(texts[k]) for k in order], dtype=np.int64)
    longest = int(lengths[0]) if len(order) else 0
    if not longest:
        return ["00"] * len(texts)
    active = len(order) - np.cumsum(np.bincount(lengths, minlength=longest + 1))[:longest]
    starts = np.r_[0, np.cumsum(active)]
    codes = np.empty(starts[-1], dtype=np.int32)
    for rank, k in enumerate(order):
        if not lengths[rank]:
            break
        codes[starts[: lengths[rank]] + rank] = _classes(texts[k])
    arrived = np.empty(starts[-1], dtype=np.int32 if longest < 1 << 27 else np.int64)
    dwell, time, edges = _dwell(seed), np.zeros(len(order), dtype=np.int64), starts.tolist()
    scaled = codes.astype(np.int32) * PERIOD
    for k in range(longest):
        a, b = edges[k], edges[k + 1]
        now = time[: b - a]
        arrived[a:b] = now
        now += dwell.take(scaled[a:b] + (now & (PERIOD - 1)))
    out = [""] * len(texts)
    symbols = np.frombuffer((ALPHABET + PAD).encode(), dtype=np.uint8)
    for rank, k in enumerate(order):
        n = int(lengths[rank])
        if not n:
            out[k] = "00"
            continue
        at, end = starts[:n] + rank, int(time[rank])
        scale = max(1, (end - 1).bit_length())
        asked = np.concatenate([_times(seed, o)[:m] for o, m in _layout(scale)])
        own = arrived[at]
        read = codes[at[np.searchsorted(own, asked, side="right") - 1]] % (len(symbols) - 1)
        read[asked >= end] = len(symbols) - 1
        out[k] = f"{scale:02x}" + symbols[read].tobytes().decode()
    return out


def _at_scale(fingerprint: str, scale: int) -> str:
    """The samples of a fingerprint that the sample for a longer walk keeps."""
    own = int(fingerprint[:2], 16)
    kept, at = {}, 2
    for octave, n in _layout(own):
        kept[octave] = fingerprint[at : at + n]
        at += n
    return "".join(kept.get(octave, PAD * n)[:n] for octave, n in _layout(scale))


def likeness(a: str, b: str) -> float:
    """The part of the samples, of those not past the end of both walks, in which two fingerprints agree; 0 to 1."""
    if a == b:
        return 1.0
    scale = max(int(a[:2], 16), int(b[:2], 16))
    x, y = (np.frombuffer(_at_scale(f, scale).encode(), dtype=np.uint8) for f in (a, b))
    live = (x != ord(PAD)) | (y != ord(PAD))
    return float((x == y)[live].mean()) if live.any() else 0.0


def band_keys(fingerprint: str, bands: int = BANDS, width: int = WIDTH, seed: int = 7) -> list[int]:
    """:func:`all_band_keys` of one fingerprint."""
    return all_band_keys([fingerprint], bands, width, seed)[0].tolist()


def all_band_keys(fingerprints: list[str], bands: int = BANDS, width: int = WIDTH, seed: int = 7) -> list[np.ndarray]:
    """Of each fingerprint 64-bit keys of bit-sampled bands at its own scale and, where its walk ends near the next power of two, at the next one.

    A band lists the samples in an order of its own, and a key takes the first ``width`` of
    them that are not past the walk's end: what is past both ends says nothing, and a key of
    it would join unrelated texts. Two fingerprints with likeness p share a band with
    probability 1 - (1 - p ** width) ** bands, whether their walks end together or not.
    """
    at_scales = {}
    for k, fingerprint in enumerate(fingerprints):
        own = int(fingerprint[:2], 16)
        last = _layout(own)[0][1] if own else 0
        full = 1 - fingerprint[2 : 2 + last].count(PAD) / last if last else 0.0  # how far into its last octave the walk went
        for scale in (own, own + 1) if full >= NEAR_END else (own,):
            at_scales.setdefault(scale, []).append(k)
    found = [[] for _ in fingerprints]
    for scale, members in at_scales.items():
        salts = _mixed(np.arange(bands, dtype=np.uint64) + np.uint64(scale << 32))
        order = _bands(scale, sum(n for _, n in _layout(scale)), bands, seed)
        for start in range(0, len(members), 256):
            some = members[start : start + 256]
            samples = np.frombuffer("".join(_at_scale(fingerprints[k], scale) for k in some).encode(), dtype=np.uint8).reshape(len(some), -1)[:, order]
            live = samples != ord(PAD)
            place = np.cumsum(live, axis=2, dtype=np.int16)
            taken = np.zeros((len(some), bands, width), dtype=np.uint8)
            doc, band, at = np.nonzero(live & (place <= width))
            taken[doc, band, place[doc, band, at] - 1] = samples[doc, band, at]
            words = np.zeros((len(some), bands, -(-width // 8) * 8), dtype=np.uint8)
            words[:, :, :width] = taken
            keys = np.broadcast_to(salts, (len(some), bands))
            for word in np.moveaxis(words.view(np.uint64), 2, 0):
                keys = _mixed(keys ^ word)
            for k, own_keys in zip(some, keys.view(np.int64)):
                found[k].append(own_keys)
    return [np.concatenate(keys) for keys in found]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them (the finish of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _bands(scale: int, samples: int, bands: int, seed: int) -> np.ndarray:
    """[band, place]: the samples in the order of each band."""
    rng = np.random.RandomState(seed + 31 * scale)
    return np.array([rng.permutation(samples) for _ in range(bands)], dtype=np.int64).reshape(bands, samples)


def likenesses(a: list[str], b: list[str]) -> np.ndarray:
    """[i, j]: :func:`likeness` of a[i] and b[j], all at once for each two scales."""
    out = np.zeros((len(a), len(b)))
    by_scale = [[(s, [k for k, f in enumerate(x) if int(f[:2], 16) == s]) for s in sorted({int(f[:2], 16) for f in x})] for x in (a, b)]
    for (s, i), (t, j) in itertools.product(*by_scale):
        scale = max(s, t)
        if not scale:
            out[np.ix_(i, j)] = 1.0
            continue
        x, y = (np.frombuffer("".join(_at_scale(f[k], scale) for k in at).encode(), dtype=np.uint8).reshape(len(at), -1) for f, at in ((a, i), (b, j)))
        for k in range(0, len(i), 64):
            part = x[k : k + 64, None, :]
            live = (part != ord(PAD)) | (y[None] != ord(PAD))
            n = live.sum(axis=2)
            out[np.ix_(i[k : k + 64], j)] = np.where(n > 0, ((part == y[None]) & live).sum(axis=2) / np.maximum(n, 1), float(s == t))
    return out


def near_classes(fingers: DataFrame, threshold: float = NEAR, block: int = 400, small: int = 256) -> DataFrame:
    """doc_id, class_id, n_near: classes of documents whose fingerprints are at least ``threshold`` alike.

    fingers: (doc_id, fingerprint). Equal fingerprints are one node with a count. Nodes
    that share a band meet in one task, where those that are alike are linked; a band
    that more than ``small`` nodes share links them all unseen. What the links join is a
    cluster of candidates; inside each cluster every pair of nodes is verified on the
    whole fingerprints, in blocks of bounded size. n_near counts the other documents
    that are alike (copies included); class_id is the least doc_id that verified links
    lead to. Rows without doc_id are classes of their own (class_id null, 0).
    """
    known = fingers.where(F.col("doc_id").isNotNull() & F.col("fingerprint").isNotNull())
    nodes = stored(known.groupBy(F.xxhash64("fingerprint").alias("node")).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("fingerprint").alias("fingerprint")))

    def keys(batches):
        for batch in batches:
            found = all_band_keys(batch.column(1).to_pylist())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), list(map(len, found)))), pa.array(np.concatenate(found))], names=["node", "key"])

    rows = stored(nodes.select("node", "fingerprint").mapInArrow(released(keys), "node long, key long").distinct())
    shared = stored(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1"))
    # what a hot band's nodes need is one number, which goes to them by a join that AQE splits
    stars = rows.join(shared.where(F.col("n") > small).select("key", "least"), "key").select(F.col("node").alias("a"), F.col("least").alias("b"))
    few = rows.join(shared.where(F.col("n") <= small).select("key"), "key").join(nodes.select("node", "fingerprint"), "node")

    def linked(part: pa.Table) -> pa.Table:
        node, names = part.column("node").to_numpy(), part.column("fingerprint").to_pylist()
        x, y = np.nonzero(np.triu(likenesses(names, names) >= threshold, 1))
        return pa.table({"a": node[y], "b": node[x]})

    links = few.select("key", "node", "fingerprint").groupBy("key").applyInArrow(linked, "a long, b long").unionByName(stars).distinct()
    clusters = stored(connected_components(links).withColumnRenamed("component", "cluster"))
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    wanted = clusters.join(sizes, "cluster").join(nodes, "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = wanted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = spread.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "copies", "fingerprint")

    def verified(part: pa.Table) -> pa.Table:
        node, copies, own = (part.column(c).to_numpy() for c in ("node", "copies", "own"))
        names, i, j = part.column("fingerprint").to_pylist(), part.column("i")[0].as_py(), part.column("j")[0].as_py()
        alike = likenesses(names, names) >= threshold
        np.fill_diagonal(alike, False)
        if i != j:
            alike &= own[:, None] != own[None, :]  # pairs inside a block belong to the block with itself
        some = np.flatnonzero(alike.any(axis=1))
        first = alike[some].argmax(axis=1)
        label = np.arange(len(node))
        while len(some):
            after = np.minimum(label, np.where(alike.any(axis=1), np.where(alike, label[None, :], len(node)).min(axis=1, initial=len(node)), label))
            if np.array_equal(after, label):
                break
            label = after
        return pa.table({"node": node[some], "root": node[label[some]], "near": alike[some] @ copies}) if len(first) else empty

    empty = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("near", pa.int64())]).empty_table()
    exact = stored(keyed.groupBy("cluster", "i", "j").applyInArrow(verified, "node long, root long, near long"))
    classes = stored(connected_components(exact.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    least = classes.join(nodes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("class_id"))
    near = classes.join(least, "component").select("node", "class_id").join(exact.groupBy("node").agg(F.sum("near").alias("near")), "node", "left")
    info = nodes.join(near, "node", "left").select(F.col("node").alias("_node"), F.coalesce("class_id", "rep").alias("_class"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("_near"))
    out = fingers.select("doc_id", F.xxhash64("fingerprint").alias("node")).join(info, F.col("node") == F.col("_node"), "left")
    known = F.col("doc_id").isNotNull()
    return out.select("doc_id", F.when(known, F.col("_class")).alias("class_id"), F.when(known, F.col("_near")).otherwise(F.lit(0)).cast("long").alias("n_near"))


def fingerprint_table(docs: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, fingerprint) of every whole text; one narrow pass. Null texts count as empty; null ids and repeated rows are kept."""

    def fingers(batches):
        for batch in batches:
            for part in _by_chars(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array(fingerprints([t or "" for _, t in part], seed))], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(fingers), "doc_id long, fingerprint string")


def near_documents(docs: DataFrame, threshold: float = NEAR, seed: int = 7) -> DataFrame:
    """doc_id, class_id, n_near of every document, by :func:`fingerprint_table` and :func:`near_classes`.

    Empty texts are alike; an empty table gives an empty result; columns other than
    doc_id and text are not read.
    """
    return near_classes(stored(fingerprint_table(docs, seed)), threshold)


def _by_chars(rows):
    part, chars = [], 0
    for row in rows:
        part.append(row)
        chars += len(row[1] or "")
        if chars >= BATCH_CHARS // 2:
            yield part
            part, chars = [], 0
    if part:
        yield part


def _in_order(docs: DataFrame, spread: int) -> DataFrame:
    """The documents in ranges of ascending (doc_id, hash of the text), each range with the first document of the next at its end.

    There are ``spread`` ranges an input partition, and more where those would hold more
    than RANGE_BYTES of text. Their bounds are approximate quantiles of the ids; an id
    with so many rows that it is a bound more than once, and the rows without id, are
    dealt by the hash, in as many ranges. Only bounds and one row per range reach the
    driver. Rows without id come last. Returns (part, last boolean, doc_id, text),
    sorted within partitions.
    """
    spark = docs.sparkSession
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    size, n, without = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    files = max(1, len(docs.inputFiles()))
    wanted = max(1, min(20_000, n, max(spread * files, spread * spark.sparkContext.defaultParallelism, size // RANGE_BYTES)))
    quantiles = docs.select("doc_id").approxQuantile("doc_id", [k / wanted for k in range(1, wanted)], 0.25 / wanted) if wanted > 1 else []
    times = sorted(Counter(map(int, quantiles)).items())
    bounds, copies = [b for b, _ in times], [m if m > 1 else 0 for _, m in times]
    starts = list(itertools.accumulate((m + 1 for m in copies), initial=1))  # range 0: before the first bound
    nulls = max(1, without * wanted // max(1, n))
    array = lambda x, kind: (F.array(*map(F.lit, x)) if x else F.array()).cast(f"array<{kind}>")
    step = max(1, int(len(bounds) ** 0.5))
    up_to = lambda edges: F.size(F.filter(edges, lambda b: b <= F.col("doc_id")))
    # the number of bounds up to the id, by a coarse and then a fine count
    at = up_to(array(bounds[step - 1 :: step], "bigint")) * step
    at = at + up_to(F.slice(array(bounds, "bigint"), at + 1, F.lit(step)))
    place = (F.shiftright("h", 33) + (1 << 30)) / F.lit(float(1 << 31))  # of the hash, from 0 to 1
    of = lambda values: F.element_at(array(values, "int"), F.greatest(at, F.lit(1)))
    with_id = F.when(at == 0, 0).otherwise(of(starts) + F.when(of(copies) > 0, F.when(F.element_at(array(bounds, "bigint"), F.greatest(at, F.lit(1))) == F.col("doc_id"), F.floor(place * of(copies))).otherwise(of(copies))).otherwise(0)) if bounds else F.lit(0)
    part = F.when(F.col("doc_id").isNull(), starts[-1] + F.floor(place * nulls)).otherwise(with_id).cast("int")
    rows = hashed.withColumn("part", part)
    firsts = sorted((r["part"], r["f"]["doc_id"], r["f"]["h"]) for r in rows.select("part", "doc_id", "h").groupBy("part").agg(F.min(F.struct("doc_id", "h")).alias("f")).collect())
    lead = [(i, h, p, firsts[k - 1][0]) for k, (p, i, h) in enumerate(firsts)]
    leads = spark.createDataFrame(lead, "lead_id long, lead_h long, own int, earlier int")  # one row per range
    copied = rows.join(F.broadcast(leads), (rows.part == leads.own) & rows.doc_id.eqNullSafe(leads.lead_id) & (rows.h == leads.lead_h))
    copied = copied.select(F.col("earlier").alias("part"), F.lit(True).alias("last"), "doc_id", "h", "text")
    both = rows.select("part", F.lit(False).alias("last"), "doc_id", "h", "text").unionByName(copied)
    ordered = both.repartition(max(1, len(firsts)), "part").sortWithinPartitions("part", "last", F.col("doc_id").asc_nulls_last(), "h", "text")
    return ordered.select("part", "last", "doc_id", "text")


def edited_neighbours(docs: DataFrame, seed: int = 7, spread: int = 2) -> DataFrame:
    """Fingerprint every whole text and its edited text, and compare.

    The edited text is the text with its last ``floor(n / 4)`` code points replaced
    by as many (or all) first ones of the next document in ascending doc_id; after
    the last document comes the first. The rows move once, into ranges of doc_id.

    Null texts are empty. Rows that share a doc_id follow one another in the order
    of a hash of their texts; rows without doc_id come after all others, likewise. The only document of
    a table is its own next one. An empty table gives an empty result; columns
    other than doc_id and text are not read. Two empty texts are alike (1), an
    empty and another text are not (0).
    found_edited, found_next: whether the pair shares a band and is then verified to be
    at least NEAR alike, as :func:`near_classes` does for all documents.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, found_edited, found_next.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def compare(batches):
        def ready(part):
            """part: rows of a range that follow one another; the last one only serves as next."""
            texts = [t for _, t in part]
            edited = [t[: n - n // 4] + after[: n // 4] for t, after in zip(texts, texts[1:]) for n in [len(t)]]
            found = fingerprints(texts + edited, seed)
            own, new = found[: len(texts)], found[len(texts) :]
            near = [np.array(list(map(likeness, own, other)), dtype=np.float64) for other in (new, own[1:])]
            # of pairs that are not alike it does not matter whether they share a band
            met = [[n >= NEAR and len(np.intersect1d(*all_band_keys([a, b]))) > 0 for n, a, b in zip(ns, own, other)] for ns, other in zip(near, (new, own[1:]))]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in part[:-1]], pa.int64()),
                    pa.array(list(map(len, texts[:-1])), pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                    pa.array(own[:-1]),
                    pa.array(new),
                    *map(pa.array, near),
                    *(pa.array(m, pa.bool_()) for m in met),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "found_edited", "found_next"],
            )

        held, chars, range_, over = [], 0, None, False
        for batch in batches:
            for at, last, doc, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if at != range_:
                    held, chars, range_, over = [], 0, at, False
                if over:
                    continue
                held.append((doc, text))
                chars += len(text)
                over = last
                if len(held) > 1 and (last or chars >= BATCH_CHARS // 2):
                    yield ready(held)
                    held, chars = held[-1:], len(text)

    return _in_order(source, spread).mapInArrow(released(compare), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, found_edited boolean, found_next boolean")
