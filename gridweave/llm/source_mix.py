"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridweave.session import stored

#: Weights of the sources in code-point order (null last), repeating.
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: str = "text") -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: source, source_size, weight, target, rate.

    The sources split ``share`` times all sizes by weight; no target exceeds
    ``most`` times its source's size, and what a full source leaves is split again
    among the others until none is above. The end of that process is a water
    level: with the sources in order of size per weight, the first k are full, k
    being the least number for which the level, (budget - what they hold) over the
    other weights, reaches the next one's limit no more. Two running sums find it
    without a loop. The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    named = per.withColumn("weight", F.element_at(pattern, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int") + 1))
    full = F.col("source_size") * F.lit(float(most))
    order = (full / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        named.withColumn("limit", full)
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("held", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("held")) / F.sum("weight").over(ahead))
    )
    # levels rise up to the first source that they leave short of its limit and fall after it: that one is the water level
    short = F.max(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))).over(everything)
    return levels.withColumn("water", short).select(
        "source",
        "source_size",
        "weight",
        F.least("limit", F.coalesce(F.col("water") * F.col("weight"), F.col("limit"))).alias("target"),
    ).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def chance(seed: int, id_col: str = "doc_id") -> Column:
    """A number in [0, 1) that depends on the id and the seed only: 52 bits of an MD5."""
    digest = F.md5(F.concat_ws("#", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, seed: int = 11, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The columns of ``docs`` and size, source_size, target, copies.

    ``copies`` is floor(rate) and one more with probability equal to the rate's
    fraction, drawn by a hash of doc_id and the seed: reruns and rows that repeat
    a doc_id agree. Sizes are summed per source before they move (one row per
    source and task) and written: the size of the written table tells Spark, before
    any text moves, whether it may be broadcast, and AQE splits a hot source otherwise. A null text has size 0;
    a null source is a source, the last one; a source of size 0 has target 0; an
    empty table gives an empty result. Columns of docs named like the new ones are replaced.
    """
    new = ("size", "source_size", "target", "copies")
    base = docs.drop(*new)
    sized = base.withColumn("size", word_count())
    targets = stored(source_targets(sized.select("source", "size"), weights, share, most).select(F.col("source").alias("_source"), "source_size", "target", F.col("rate").alias("_rate")))
    whole = F.floor("_rate")
    return (
        sized.join(targets, sized["source"].eqNullSafe(targets["_source"]), "left")
        .withColumn("copies", (whole + (chance(seed) < F.col("_rate") - whole).cast("long")).cast("long"))
        .drop("_source", "_rate")
    )


def emit(mixed: DataFrame) -> DataFrame:
    """Each document as often as ``copies`` says, without the columns that :func:`mix` added."""
    columns = [c for c in mixed.columns if c not in ("size", "source_size", "target", "copies")]
    return mixed.where(F.col("copies") > 0).select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")
