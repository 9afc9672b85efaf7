"""A corpus pipeline in five stages over ``documents``.

Each stage is a function (spark, docs, sf_dir) -> DataFrame on all that the stage
before it kept. Stages are written as Parquet and read again by :func:`run`; all
but the last return the columns of ``documents``.

Every stage judges rows, each on its own text: rows that share a doc_id, or have
none, are kept or go one by one. Null texts count as empty, a null source is a
source, an empty table gives an empty result, and columns besides those of
``documents`` are not read. What else is special to a stage is told there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import jaccard_join, language_id, packing, source_mix, toxicity
from gridweave.llm.common import table
from gridweave.session import discard, stored, stored_alone

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Some stages learn from data and one encodes tokens: SQL cannot express the result.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: rows with a predicted 1 go. An empty text has the score of a text without known words and stays; ties at the threshold go."""
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels"), keep=COLUMNS[1:]).where("predicted = 0").select(*COLUMNS)


def drop_foreign(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: rows without a language (null, blank, no letter), or unlike any learned one, go; of languages that tie the first by name is taken."""
    return language_id.language_id(docs, keep=COLUMNS[1:]).where("not rejected").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each class of near copies the row with the least doc_id stays (one without only if none has one).

    Of rows that tie, repeated ones, one stays. All blank texts are one class.
    Classes are made of rows, not of ids: a number of the row takes the place of
    doc_id in the join. It is written with the rows, as it depends on how they are dealt.
    """
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()))
    classes = jaccard_join.jaccard_join(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "class_id")
    ids = rows.select("_row", F.col("doc_id").isNull().alias("_none"), "doc_id")
    first = stored(classes.join(ids, "_row").groupBy("class_id").agg(F.min(F.struct("_none", "doc_id", "_row")).alias("_f")).select("_f._row"))
    # the rows that go are fewer than those that stay: where they may be broadcast, no text is shuffled
    gone = stored(rows.select("_row").join(first, "_row", "left_anti"))
    if gone.count() <= jaccard_join.BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return rows.join(gone, "_row", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: each document as often as its source's rate says; rows that repeat a doc_id draw alike, blank texts as others."""
    return source_mix.emit(source_mix.mix(docs)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: one row per piece with its sequence and place; an empty text is one token, a repeated row is packed each time."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_foreign),
    ("ngram_jaccard_join", keep_one_of_each),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, stored_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        discard(before)
    return docs
