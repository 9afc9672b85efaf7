"""Best-fit packing of token sequences by hierarchical residual rounds."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import released, slices_by_bytes, texts_of
from gridweave.llm.tokenizer import byte_level
from gridweave.session import stored

#: Tokens of a sequence.
CAPACITY = 2048
#: A bin with no more room than this is nearly full and leaves at once.
SLACK = 8
#: Bins that one merge task takes.
GROUP = 50_000
#: Pieces that a worker packs at once.
BUFFER = 200_000


def best_fit(sizes, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin of each item, offset in it), for sizes from 1 to capacity.

    Open bins are kept by the room they have left; a bit mask of the rooms in use
    finds the tightest bin that fits in a few machine operations.
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    bins, offsets = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = made = 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            into = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            room, into = capacity, made
            made += 1
        bins[k], offsets[k] = into, capacity - room
        left = room - size
        if left:
            rooms[left].append(into)
            mask |= 1 << left
    return bins, offsets


def cut(ids: bytes, capacity: int = CAPACITY):
    """(piece, start, length, crc32) of a document's ids: whole up to the capacity, else full pieces after a shorter first one."""
    total = len(ids) // 4
    start, piece = 0, 0
    while start < total:
        length = total if total <= capacity else (total % capacity or capacity) if not piece else capacity
        yield piece, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
        start, piece = start + length, piece + 1


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Tokenise, cut and pack locally: one row per piece, with its bin, its place there, and the bin's fill."""

    def work(batches):
        encoder = byte_level(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        held, made = [], TaskContext.get().partitionId() << 33

        def packed():
            nonlocal made
            lengths = np.array([h[3] for h in held], dtype=np.int64)
            bins, offsets = best_fit(lengths, capacity)
            fill = np.bincount(bins, lengths).astype(np.int64)
            columns = [pa.array(c, kind) for c, kind in zip(zip(*held), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            out = pa.RecordBatch.from_arrays([*columns, pa.array(bins + made), pa.array(offsets), pa.array(fill[bins])], names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"])
            made += len(fill)
            held.clear()
            return out

        for batch in slices_by_bytes(batches, "text", 4 << 20):
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                held.extend((doc, *p) for p in cut(encoder.ids(text) + end, capacity))
            if len(held) >= BUFFER:
                yield packed()
        if held:
            yield packed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(work), _PIECE)


def _merge(bins: DataFrame, capacity: int) -> DataFrame:
    """One round: (bin, fill, part) to (bin, fill, into, shift, total), each part of about GROUP bins packed by best fit."""

    def work(part: pa.Table) -> pa.Table:
        ids, fills = (part.column(c).to_numpy() for c in ("bin", "fill"))
        order = np.argsort(ids)
        ids, fills = ids[order], fills[order]
        into, shift = best_fit(fills, capacity)
        first = np.zeros(into.max() + 1, dtype=np.int64)
        first[into[shift == 0]] = ids[shift == 0]
        total = np.bincount(into, fills).astype(np.int64)
        return pa.table([pa.array(x) for x in (ids, fills, first[into], shift, total[into])], names=["bin", "fill", "into", "shift", "total"])

    return bins.select("bin", "fill", "part").groupBy("part").applyInArrow(work, "bin long, fill long, into long, shift long, total long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, gain: float = 0.001) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    A document is its ids and one end id 0. Workers cut the longer ones, pack what
    they read by best-fit decreasing, and write one small row per piece (the shared
    folder keeps it: bins do not change when a task is run again). Bins with at most
    SLACK tokens of room are done; the others are items of the next round, dealt out
    anew into groups of about GROUP bins, until all open bins were one group or a
    round spared less than the share ``gain`` of them. A merged bin takes the
    id of its first part and places the others behind it, so offsets stay gapless.
    The rounds move bins, not pieces; the pieces meet the final places in one join.

    Null texts are empty (one id, the end id). A null doc_id is kept, repeated rows
    are packed each, an empty table gives an empty result, and other columns are not
    read. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    local = stored(pieces(docs, tokenizer_path, capacity))
    open_bins = local.where((F.col("offset") == 0) & (F.col("fill") < capacity - SLACK)).select("bin", "fill")
    n = open_bins.count()
    placed = None  # bin of the first round -> its bin now, and where it starts there
    for turn in itertools.count():
        if n < 2:
            break
        parts = -(-n // GROUP)
        merged = stored(_merge(open_bins.withColumn("part", F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(parts))), capacity))
        step = merged.select(F.col("bin").alias("_bin"), "into", "shift")
        if placed is None:
            placed = step.select(F.col("_bin").alias("bin"), "into", "shift")
        else:
            old = placed.select("bin", F.col("into").alias("_via"), F.col("shift").alias("_shift"))
            placed = old.join(step, old["_via"] == step["_bin"], "left").select(
                "bin", F.coalesce("into", "_via").alias("into"), (F.col("_shift") + F.coalesce("shift", F.lit(0))).alias("shift")
            )
        left = merged.where(F.col("shift") == 0)
        open_bins = left.where(F.col("total") < capacity - SLACK).select("bin", F.col("total").alias("fill"))
        kept = left.count()
        if parts == 1 or n - kept < gain * n:
            break
        n = open_bins.count()
    if placed is None:
        final = local.withColumn("sequence_id", F.col("bin"))
    else:
        final = local.join(placed.withColumnRenamed("bin", "_bin"), local["bin"] == F.col("_bin"), "left")
        final = final.withColumn("sequence_id", F.coalesce("into", "bin")).withColumn("offset", F.col("offset") + F.coalesce("shift", F.lit(0)))
    return final.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
