"""Relational building blocks of the grid queries: filters, joins, aggregates, windows, top-k."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ALL_BEFORE = (Window.unboundedPreceding, Window.currentRow)


# -- filters -------------------------------------------------------------------


def conjunction(df: DataFrame, one_of: dict[str, Sequence] | None = None, at_least: dict[str, float] | None = None, at_most: dict[str, float] | None = None, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Keep rows that meet every condition that is given; an empty list of values keeps none.

    All conditions are plain predicates, so they reach the Parquet scan.
    bbox: (west, south, east, north) on columns x and y.
    """
    for column, values in (one_of or {}).items():
        df = df.where(F.col(column).isin(list(values)))
    for column, value in (at_least or {}).items():
        df = df.where(F.col(column) >= value)
    for column, value in (at_most or {}).items():
        df = df.where(F.col(column) <= value)
    if bbox:
        west, south, east, north = bbox
        df = df.where(F.col("x").between(west, east) & F.col("y").between(south, north))
    return df


def plausible_position(df: DataFrame, lon: str = "x", lat: str = "y") -> DataFrame:
    """Rows with a position inside the usual frame (5 to 16 degrees east, 47 to 56 north)."""
    return df.where(F.col(lon).between(5, 16) & F.col(lat).between(47, 56))


def implausible_line() -> Column:
    """True unless resistance, reactance, capacity and length are all present and plausible."""
    good = (F.col("r") > 0) & (F.col("x") > 0) & (F.col("s_nom") > 0) & (F.col("length") > 0.1)
    return ~F.coalesce(good, F.lit(False))


# -- edges ---------------------------------------------------------------------


def edge_endpoints(edges: DataFrame, id_col: str = "line_id", kind: str | None = None) -> DataFrame:
    """(edge, bus) once per different end: a self-loop meets its bus once.

    This union replaces joins on ``bus0 = id OR bus1 = id``, which Spark could only
    run as a nested loop.
    """
    ends = edges.select(F.col(id_col).alias("edge"), F.explode(F.array_distinct(F.array("bus0", "bus1"))).alias("bus"))
    return ends.withColumn("kind", F.lit(kind)) if kind else ends


def with_both_ends(edges: DataFrame, buses: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Join the named columns of both end buses, as ``<column>0`` and ``<column>1``."""
    for end in ("0", "1"):
        side = buses.select(F.col("bus_id").alias(f"_bus{end}"), *(F.col(c).alias(f"{c}{end}") for c in columns))
        edges = edges.join(side, F.col(f"bus{end}") == F.col(f"_bus{end}")).drop(f"_bus{end}")
    return edges


def edges_inside(edges: DataFrame, buses: DataFrame) -> DataFrame:
    """Edges whose both ends are among ``buses``."""
    keys = buses.select(F.col("bus_id").alias("_key")).distinct()
    return edges.join(keys, F.col("bus0") == F.col("_key"), "left_semi").join(keys, F.col("bus1") == F.col("_key"), "left_semi")


def cross_border(edges_with_countries: DataFrame, home: str) -> DataFrame:
    """Edges with exactly one end in ``home`` (columns country0 and country1)."""
    return edges_with_countries.where((F.col("country0") == home) != (F.col("country1") == home))


# -- joins ---------------------------------------------------------------------


def orphans(facts: DataFrame, dims: DataFrame, key: str, dim_key: str) -> DataFrame:
    """Facts whose key is not in the dimension."""
    return facts.join(dims.select(F.col(dim_key).alias("_key")), F.col(key) == F.col("_key"), "left_anti")


def referenced(dims: DataFrame, dim_key: str, *facts: tuple[DataFrame, str]) -> DataFrame:
    """Dimension rows that at least one of the fact tables mentions."""
    keys = None
    for df, key in facts:
        part = df.select(F.col(key).alias("_key"))
        keys = part if keys is None else keys.unionByName(part)
    return dims.join(keys, F.col(dim_key) == F.col("_key"), "left_semi")


def first_of_list(text: str, separator: str = ", ") -> Column:
    """The first element of a delimited list."""
    return F.split_part(F.col(text), F.lit(separator), F.lit(1))


def filled_from(df: DataFrame, updates: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """UPDATE ... FROM: take the named columns from ``updates`` where it has the key and a value."""
    new = updates.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns))
    out = df.join(new, F.col(key) == F.col("_key"), "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c)))
    return out.drop("_key", *(f"_{c}" for c in columns))


def relaxed_lookup(df: DataFrame, dims: DataFrame, tiers: Sequence[Sequence[str]], value: str) -> DataFrame:
    """Look ``value`` up by the first tier of key columns that has an entry; ties go to the least value."""
    out, found = df, []
    for k, keys in enumerate(tiers):
        part = dims.where(F.col(value).isNotNull()).groupBy(*[F.col(c).alias(f"_{k}_{c}") for c in keys]).agg(F.min(value).alias(f"_{k}_value"))
        on = None
        for c in keys:
            same = F.col(c) == F.col(f"_{k}_{c}")
            on = same if on is None else on & same
        out = out.join(part, on, "left").drop(*(f"_{k}_{c}" for c in keys))
        found.append(f"_{k}_value")
    tier = F.coalesce(*(F.when(F.col(c).isNotNull(), k + 1) for k, c in enumerate(found)))
    return out.withColumn("tier", tier).withColumn(value, F.coalesce(*found)).drop(*found)


# -- aggregates ----------------------------------------------------------------


def weighted_mean(value: str, weight: str) -> Column:
    """Mean weighted by ``weight``; the plain mean where the weights add up to nothing."""
    total = F.sum(weight)
    return F.when(total > 0, F.sum(F.col(weight) * F.col(value)) / total).otherwise(F.avg(value))


def rollup_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total), largest total first, nulls last, then by key."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).orderBy(F.desc_nulls_last("total"), key)


def mode_by(df: DataFrame, keys: Sequence[str], value: str, alias: str = "mode") -> DataFrame:
    """Most frequent non-null value per group, the least of those on a tie; two partial aggregations, no window."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(alias))


def map_by(df: DataFrame, key: str, label: str, value: str) -> DataFrame:
    """(key, total, parts): the sum per key, and a map from label to its share of it."""
    inner = df.groupBy(key, label).agg(F.sum(value).alias("_v"))
    return inner.groupBy(key).agg(F.sum("_v").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "_v")))).alias("parts"))


def two_level(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Per outer and inner key: sum and peak; with the outer total beside them."""
    fine = df.groupBy(outer, inner).agg(F.sum(value).alias("inner_total"), F.max(value).alias("inner_peak"), F.count("*").alias("n"))
    coarse = fine.groupBy(outer).agg(F.sum("inner_total").alias("outer_total"), F.sum("n").alias("outer_n"))
    return fine.join(coarse, outer)


def median_with_fallback(df: DataFrame, fine: Sequence[str], coarse: Sequence[str], value: str, least: int = 5) -> DataFrame:
    """Median per fine group; that of the coarse group where the fine one has fewer than ``least`` values."""
    small = df.groupBy(*fine).agg(F.median(value).alias("_m"), F.count(value).alias("n"))
    large = df.groupBy(*coarse).agg(F.median(value).alias("_c"))
    return small.join(large, list(coarse)).select(*fine, "n", F.when(F.col("n") >= least, F.col("_m")).otherwise(F.col("_c")).alias("median"))


def histogram(df: DataFrame, value: str, edges: Sequence[float], right_closed: bool = False) -> DataFrame:
    """(bin, n) for all bins of ``edges``, empty ones with 0.

    Left-closed with the last bin closed, as in numpy; or right-closed. Values outside
    the edges are not counted.
    """
    x, last = F.col(value), len(edges) - 2
    at = None
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        inside = (x > a) & (x <= b) if right_closed else (x >= a) & ((x <= b) if k == last else (x < b))
        at = F.when(inside, k) if at is None else at.when(inside, k)
    counts = df.select(at.alias("_bin")).where("_bin is not null").groupBy("_bin").agg(F.count("*").alias("_n"))
    bins = df.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(F.broadcast(counts), F.col("bin") == F.col("_bin"), "left").select("bin", F.coalesce("_n", F.lit(0)).alias("n"))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, at: Sequence[float]) -> DataFrame:
    """Exact, linearly interpolated percentiles as one column each: p50, p95..."""
    out = df.groupBy(*keys).agg(F.percentile(value, F.array(*map(F.lit, at))).alias("_p"))
    return out.select(*keys, *(F.col("_p")[k].alias(f"p{round(100 * p):02d}") for k, p in enumerate(at)))


def pivot_sum(df: DataFrame, row: str, column: str, values: Sequence[str], value: str) -> DataFrame:
    """One column per given label, 0 where a row has none."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.sum(value)).na.fill(0)


def percent_change(old: Column, new: Column) -> Column:
    """(new - old) / old in percent; 0 where old is 0."""
    return F.when(old == 0, 0.0).otherwise((new - old) / old * 100)


def against_reference(model: DataFrame, reference: DataFrame, keys: Sequence[str], least: float = 0.1) -> DataFrame:
    """modeled, reference, diff, pct per key; left out where both are below ``least``; pct 999 without reference."""
    both = model.join(reference, list(keys), "left").withColumn("reference", F.coalesce("reference", F.lit(0.0)))
    diff = F.col("modeled") - F.col("reference")
    return both.where((F.abs("modeled") >= least) | (F.abs("reference") >= least)).withColumn("diff", diff).withColumn("pct", F.when(F.col("reference") == 0, 999.0).otherwise(diff / F.col("reference") * 100))


def fill_rates(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Share of non-null values of each column, per key."""
    return df.groupBy(key).agg(F.count("*").alias("n"), *((F.count(c) / F.count("*")).alias(f"{c}_rate") for c in columns))


def spearman(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Correlation of average ranks. Ranks come from counts of values (aggregated first), so a value's rows never meet in one task."""
    ranked = df
    for c in (a, b):
        counts = df.groupBy(*keys, c).agg(F.count("*").alias("_n"))
        before = F.sum("_n").over(Window.partitionBy(*keys).orderBy(c).rowsBetween(*ALL_BEFORE))
        ranks = counts.withColumn(f"_r_{c}", before - (F.col("_n") - 1) / 2).drop("_n")
        ranked = ranked.join(ranks, [*keys, c])
    return ranked.groupBy(*keys).agg(F.corr(f"_r_{a}", f"_r_{b}").alias("rho"))


# -- windows, order, top-k -----------------------------------------------------


def first_by(df: DataFrame, keys: Sequence[str], order: Iterable[Column]) -> DataFrame:
    """One row per key: the first in ``order`` (DISTINCT ON); Spark limits groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_k_by(df: DataFrame, keys: Sequence[str], order: Iterable[Column], k: int) -> DataFrame:
    """The first k rows per key, with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def annotate_parallel(lines: DataFrame) -> DataFrame:
    """parallel_count and parallel_index (from 0, by line_id) among lines of equal ends and voltage."""
    keys = (F.least("bus0", "bus1"), F.greatest("bus0", "bus1"), F.col("v_nom"))
    return lines.withColumn("parallel_count", F.count("*").over(Window.partitionBy(*keys))).withColumn("parallel_index", F.row_number().over(Window.partitionBy(*keys).orderBy("line_id")) - 1)


def strongest_parallel(lines: DataFrame, k: int = 2) -> DataFrame:
    """At most the k strongest lines of each unordered pair of buses."""
    keys = (F.least("bus0", "bus1"), F.greatest("bus0", "bus1"))
    w = Window.partitionBy(*keys).orderBy(F.desc("s_nom"), "line_id")
    return lines.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def equal_bins(df: DataFrame, keys: Sequence[str], order: Iterable[Column], most: int = 15) -> DataFrame:
    """bin (from 0) of min(most, max(1, n / 2)) bins of equal count; the first bins take the remainder."""
    w = Window.partitionBy(*keys)
    n = F.count("*").over(w)
    bins = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(n / 2)))
    position = F.row_number().over(w.orderBy(*order)) - 1
    out = df.withColumn("_n", n).withColumn("_b", bins).withColumn("_p", position)
    size, extra = F.floor(F.col("_n") / F.col("_b")), F.col("_n") % F.col("_b")
    head = extra * (size + 1)
    at = F.when(F.col("_p") < head, F.floor(F.col("_p") / (size + 1))).otherwise(extra + F.floor((F.col("_p") - head) / F.greatest(size, F.lit(1))))
    return out.withColumn("bin", at.cast("int")).drop("_n", "_b", "_p")


def rank_share(keys: Sequence[str], order: Iterable[Column]) -> Column:
    """(rank - 1) / (n - 1) in a group; 0 for a group of one."""
    w = Window.partitionBy(*keys)
    return F.when(F.count("*").over(w) > 1, (F.row_number().over(w.orderBy(*order)) - 1) / (F.count("*").over(w) - 1)).otherwise(0.0)


def hash_sample(df: DataFrame, key: str, strata: dict, by: str, seed: int = 42) -> DataFrame:
    """A reproducible sample of fixed size per stratum: the rows with the least hash of key and seed."""
    sizes = F.create_map(*[F.lit(x) for pair in strata.items() for x in pair])
    w = Window.partitionBy(by).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return df.where(F.col(by).isin(list(strata))).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= sizes[F.col(by)]).drop("_rn")


def union_first(key: str, *sources: DataFrame) -> DataFrame:
    """Rows of all sources; of rows that share a key the one of the earliest source stays."""
    both = None
    for k, df in enumerate(sources):
        part = df.withColumn("_source", F.lit(k))
        both = part if both is None else both.unionByName(part)
    return first_by(both, [key], [F.col("_source")]).drop("_source")
