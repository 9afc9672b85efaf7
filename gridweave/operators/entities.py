"""Matching named places to reference tables in tiers, ids, and building a backbone from parsed lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridweave.functions.scalars import mapped
from gridweave.functions.text import fuzzy_top, normalised, path_name
from gridweave.operators.relational import first_by, relaxed_lookup
from gridweave.operators.spatial import radius_join

# Voltages that stand for a standard level, and where new ids begin.
LEVELS = {400: 380, 410: 380, 231: 220, 240: 220}
UNMATCHED_IDS, OFFSET_220 = 300_001, 500_000


def level(kv: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])[kv.cast("int")], kv.cast("int"))


def collected(*sources: DataFrame) -> DataFrame:
    """(name, tso, voltages) of all (name, tso, kv) rows, voltages ascending."""
    both = sources[0].select("name", "tso", "kv")
    for s in sources[1:]:
        both = both.unionByName(s.select("name", "tso", "kv"))
    return both.where("name is not null").groupBy("name", "tso").agg(F.array_sort(F.collect_set(level(F.col("kv")))).alias("voltages"))


def exact_tier(places: DataFrame, reference: DataFrame) -> DataFrame:
    """places (name, ...) with ref_id, x, y where the cleaned name equals a reference's, else where the raw name does; confidence 0.95.

    reference: (ref_id, name, x, y); of several with one name the least ref_id counts.
    """
    clean = normalised(path_name(F.col("name")))
    by_clean = first_by(reference.select(clean.alias("_k"), "ref_id", "x", "y"), ["_k"], [F.col("ref_id")])
    by_raw = first_by(reference.select(F.lower(F.trim("name")).alias("_k"), "ref_id", "x", "y"), ["_k"], [F.col("ref_id")])
    out = places.withColumn("_c", clean).withColumn("_r", F.lower(F.trim("name")))
    for k, (table, key) in enumerate(((by_clean, "_c"), (by_raw, "_r"))):
        t = table.select(F.col("_k").alias(f"_k{k}"), *(F.col(c).alias(f"_{c}{k}") for c in ("ref_id", "x", "y")))
        out = out.join(t, F.col(key) == F.col(f"_k{k}"), "left")
    for c in ("ref_id", "x", "y"):
        out = out.withColumn(c, F.when(F.col("_ref_id0").isNotNull(), F.col(f"_{c}0")).otherwise(F.col(f"_{c}1")))
    return out.withColumn("confidence", F.when(F.col("ref_id").isNotNull(), 0.95)).select(*places.columns, "ref_id", "x", "y", "confidence")


def fuzzy_tier(left: DataFrame, candidates: Sequence[tuple[DataFrame, float]], threshold: float = 0.80) -> DataFrame:
    """For unmatched (id, name) the best candidate of several tables, each with its base confidence.

    Confidence = base + 0.15 * (score - 0.8) / 0.2; the higher score wins, the earlier table on a tie.
    """
    best = None
    for k, (table, base) in enumerate(candidates):
        names = left.select("id", normalised(F.col("name")).alias("name"))
        refs = table.select(F.col("ref_id").alias("cand_id"), normalised(F.col("name")).alias("cand_name"))
        part = fuzzy_top(names, refs, F.substring("name", 1, 2), threshold, 1).select("id", F.col("cand_id").alias("ref_id"), "score", F.lit(-k).alias("_k"), (F.lit(base) + 0.15 * (F.col("score") - 0.8) / 0.2).alias("confidence"))
        best = part if best is None else best.unionByName(part)
    return best.groupBy("id").agg(F.max_by(F.struct("ref_id", "score", "confidence"), F.struct("score", "_k")).alias("_b")).select("id", "_b.ref_id", "_b.score", "_b.confidence")


def unmatched_tier(left: DataFrame) -> DataFrame:
    none = F.lit(None).cast("double")
    return left.withColumn("ref_id", F.lit(None).cast("long")).withColumn("x", none).withColumn("y", none).withColumn("confidence", F.lit(0.30))


def numbered(places: DataFrame) -> DataFrame:
    """bus_id: the reference id for its first place (by source row), else a new id; column row orders the places."""
    turn = F.row_number().over(Window.partitionBy("ref_id").orderBy("row"))
    fresh = F.col("ref_id").isNull() | (F.col("_turn") > 1)
    marked = places.withColumn("_turn", turn).withColumn("_new", fresh)
    count = F.sum(F.col("_new").cast("int")).over(Window.orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # a list of named places: thousands at most
    return marked.withColumn("bus_id", F.when(F.col("_new"), UNMATCHED_IDS - 1 + count).otherwise(F.col("ref_id"))).drop("_turn", "_new")


def buses_of(places: DataFrame) -> DataFrame:
    """One bus per place and voltage; those of 220 kV have an offset; places without position are left out."""
    each = places.where("x is not null and y is not null").select("bus_id", "name", "tso", "x", "y", F.explode("voltages").alias("v_nom"))
    return each.withColumn("bus_id", F.when(F.col("v_nom") == 220, F.col("bus_id") + OFFSET_220).otherwise(F.col("bus_id")))


def resolved_lines(lines: DataFrame, buses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (name0, name1, tso, kv, ...) with bus0 and bus1, and the reasons why others were left out with their numbers."""
    out = lines.withColumn("v_nom", level(F.col("kv")))
    for end in ("0", "1"):
        dims = buses.select(F.col("name").alias(f"name{end}"), "tso", "v_nom", F.col("bus_id").alias(f"bus{end}"))
        out = relaxed_lookup(out, dims, [[f"name{end}", "tso", "v_nom"], [f"name{end}", "v_nom"], [f"name{end}"]], f"bus{end}").drop("tier")
    reason = F.when(F.col("bus0").isNull() & F.col("bus1").isNull(), "both ends unknown").when(F.col("bus0").isNull(), "first end unknown").when(F.col("bus1").isNull(), "second end unknown").when(F.col("bus0") == F.col("bus1"), "same bus")
    judged = out.withColumn("_why", reason)
    return judged.where("_why is null").drop("_why"), judged.where("_why is not null").groupBy(F.col("_why").alias("reason")).agg(F.count("*").alias("n"))


def country_in(comment: Column, codes: Sequence[tuple[str, str]]) -> Column:
    """The country of the first code, in the order given, that the comment contains."""
    out = F.lit(None).cast("string")
    for code, country in reversed(codes):
        out = F.when(comment.contains(code), country).otherwise(out)
    return out


def foreign_buses(ties: DataFrame, first_id: int) -> DataFrame:
    """(name, kv, bus_id): one new bus per different foreign end."""
    ends = ties.select("foreign_name", "kv").distinct()
    return ends.select(F.col("foreign_name").alias("name"), "kv", (F.row_number().over(Window.orderBy("foreign_name", "kv")) - 1 + first_id).alias("bus_id"))


def transformer_parameters(trafos: DataFrame, default_r: float = 0.0005, default_x: float = 0.04) -> DataFrame:
    """Ohms to per unit on kv^2 / s_nom; defaults where they are missing or not positive."""
    base = F.col("kv") * F.col("kv") / F.expr("nullif(s_nom, 0)")
    unit = lambda c, default: F.when((F.col(c) > 0) & base.isNotNull(), F.col(c) / base).otherwise(default)
    return trafos.withColumn("r", unit("r_ohm", default_r)).withColumn("x", unit("x_ohm", default_x))


def rehomed(trafos: DataFrame, backbone: DataFrame, near_km: float = 5.0, far_km: float = 50.0) -> DataFrame:
    """trafos (trafo_id, osm_id, kv, x, y) with new_bus, tier and km.

    1: a backbone bus with its OSM id and voltage; 2: with its OSM id; 3: nearest of its voltage
    within ``near_km``; 4: nearest of any; 5: within ``far_km``, to be joined over a virtual
    bus; 6: none, kept and flagged.
    """
    b = backbone.select("bus_id", "v_nom", "x", "y", "osm_id")
    by_id = trafos.join(b.select(F.col("bus_id").alias("b_bus_id"), F.col("v_nom").alias("b_v_nom"), F.col("osm_id").alias("_o")), F.col("osm_id") == F.col("_o")).select("trafo_id", "b_bus_id", F.lit(0.0).alias("km"), F.when(F.col("b_v_nom") == F.col("kv"), 1).otherwise(2).alias("tier"))
    near = radius_join(trafos, b, far_km).select("trafo_id", "b_bus_id", "km", F.when((F.col("km") <= near_km) & (F.col("b_v_nom") == F.col("kv")), 3).when(F.col("km") <= near_km, 4).otherwise(5).alias("tier"))
    best = by_id.unionByName(near).groupBy("trafo_id").agg(F.min(F.struct("tier", "km", "b_bus_id")).alias("_b"))
    return trafos.join(best, "trafo_id", "left").select(*trafos.columns, F.col("_b.b_bus_id").alias("new_bus"), F.coalesce("_b.tier", F.lit(6)).alias("tier"), F.col("_b.km").alias("km"))


def direct_links(table: DataFrame, buses: DataFrame, first_id: int) -> DataFrame:
    """HVDC links (name0, name1, p_nom, length) between buses found by name, then by cleaned name."""
    out = table
    for end in ("0", "1"):
        plain = buses.select(F.col("name").alias(f"_n{end}"), F.col("bus_id").alias(f"_p{end}"))
        clean = buses.groupBy(normalised(F.col("name")).alias(f"_c{end}")).agg(F.min("bus_id").alias(f"_q{end}"))
        plain = plain.groupBy(f"_n{end}").agg(F.min(f"_p{end}").alias(f"_p{end}"))
        out = out.join(plain, F.col(f"name{end}") == F.col(f"_n{end}"), "left").join(clean, normalised(F.col(f"name{end}")) == F.col(f"_c{end}"), "left").withColumn(f"bus{end}", F.coalesce(f"_p{end}", f"_q{end}")).drop(f"_n{end}", f"_p{end}", f"_c{end}", f"_q{end}")
    good = out.where("bus0 is not null and bus1 is not null")
    return good.select((F.row_number().over(Window.orderBy("name0", "name1")) - 1 + first_id).alias("link_id"), "bus0", "bus1", F.lit("DC").alias("carrier"), "p_nom", "length", F.lit(0.98).alias("efficiency"), F.lit(-1.0).alias("p_min_pu"), F.lit(1.0).alias("p_max_pu"))


def version_flags(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, status): added, removed, changed or same between two versions of a component table."""
    a = old.select(F.col(key), F.xxhash64(*columns).alias("_a"))
    b = new.select(F.col(key).alias("_k"), F.xxhash64(*columns).alias("_b"))
    both = a.join(b, F.col(key) == F.col("_k"), "full")
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed").otherwise("same")
    return both.select(F.coalesce(key, "_k").alias(key), status.alias("status"))


def tso_name(name: Column, table: dict[str, str]) -> Column:
    return F.coalesce(mapped(name, table), name)
