"""What several of the text operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.session import ship


#: Rows and bytes that cross between the JVM and a Python worker at once: texts are large, and both sides hold the batch.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory; sets the session's Arrow batches to BATCHES."""
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def slices_by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that no slice holds more than ``limit`` bytes of ``column``, or only one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
        part = np.cumsum(sizes) // limit
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for start, end in zip(starts, np.r_[starts[1:], batch.num_rows]):
            yield batch.slice(int(start), int(end - start))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [t if t is not None else "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def words_in(texts: pa.Array, split=pc.utf8_split_whitespace) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(owner, code, distinct): of each word the text that it is in and its place among the ``distinct`` words.

    Words are what white space separates, by the same rule as ``str.split`` unless
    another ``split`` is given; null is the empty text. Splitting and telling words apart happen in Arrow, so only
    distinct words become Python strings.
    """
    lists = split(pc.fill_null(texts, ""))
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    encoded = lists.flatten().dictionary_encode()
    code, distinct = encoded.indices.to_numpy(), encoded.dictionary.to_pylist()
    if "" in distinct:  # white space at either end of a text
        blank = distinct.index("")
        keep = code != blank
        owner, code = owner[keep], code[keep]
        code = code - (code > blank)
        del distinct[blank]
    return owner, code, distinct


def sums_by_owner(owner: np.ndarray, at: np.ndarray, values: np.ndarray, n: int, chunk: int = 400_000) -> np.ndarray:
    """[n, columns]: sums of the rows ``values[at]`` by owner, in chunks of bounded size."""
    out = np.zeros((n, values.shape[1]))
    for k in range(0, len(at), chunk):
        rows = values[at[k : k + chunk]]
        for c in range(values.shape[1]):
            out[:, c] += np.bincount(owner[k : k + chunk], rows[:, c], n)
    return out


def released(work):
    """Give a worker's memory back to the system when a task's generator ends.

    Workers live on between tasks and stages; without this, what one stage needed
    still counts while the next one runs.
    """

    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library

    return run


class Memo(dict):
    """A dictionary that computes what it lacks.

    It holds two generations of at most ``limit`` entries each; when the younger
    one is full, the older goes, so that memory is bounded and what is used often stays.
    """

    def __init__(self, make, limit: int = 200_000):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value
