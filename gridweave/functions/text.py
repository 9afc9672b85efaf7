"""Names: normalising, taking apart, comparing, and how far to trust a match."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name parts that the normaliser drops or spells out, in the order of use.
PREFIXES = (
    "Umspannwerk",
    "UW",
    "Umspannanlage",
    "Station",
    "Schaltanlage",
    "Netzanschluss",
    "Anschluss",
    "Netzverknüpfungspunkt",
    "NVP",
    "Hauptschaltstation",
    "HST",
)
SUFFIXES = (
    r"\s+\d{3}\s*kV.*$",
    r"\s+[A-Z]{2,3}\s*$",
    r"\s+\(.*\)\s*$",
    r"\s+Nord$",
    r"\s+Süd$",
    r"\s+Ost$",
    r"\s+West$",
    r"\s+I+$",
    r"\s+\d+$",
)
ABBREVIATIONS = {
    "uw": "umspannwerk",
    "sa": "schaltanlage",
    "hst": "hauptschaltstation",
    "nap": "netzanschlusspunkt",
    "nvp": "netzverknüpfungspunkt",
    "kw": "kraftwerk",
    "hkw": "heizkraftwerk",
    "gkw": "gaskraftwerk",
    "wkw": "wasserkraftwerk",
    "str": "strasse",
    "str.": "strasse",
}
UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}
NAME_CONFIDENCE = {
    "san_name_exact": 0.95,
    "san_name_exact_voltage": 0.95,
    "sel_name_exact": 0.85,
    "sel_name_exact_voltage": 0.85,
    "san_name_fuzzy": 0.75,
    "san_name_fuzzy_voltage": 0.75,
    "sel_name_fuzzy": 0.70,
    "sel_name_fuzzy_voltage": 0.70,
}
SPATIAL_CONFIDENCE = {
    "spatial_voltage": 0.60,
    "spatial_direct": 0.60,
    "spatial_sel_centroid": 0.55,
    "spatial_plz_centroid": 0.35,
    "spatial_municipality": 0.30,
    "spatial_any_voltage": 0.50,
}
DIRECTIONS = ("Nord", "Süd", "Ost", "West")


def _table(key: Column, values: dict, default) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key], default)


def normalised(name: Column, keep_direction: bool = False) -> Column:
    """Lower case without prefixes, suffixes, umlauts and marks; abbreviations spelled out word by word. Null is the empty name.

    Every suffix pattern is tried once, in order; letter case does not matter to any,
    so the one for short codes also takes a last lower-case word of two or three letters.
    """
    out = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    for p in PREFIXES:
        out = F.regexp_replace(out, rf"(?iu)^{p}\s+", "")
    for s in SUFFIXES:
        if not (keep_direction and any(d in s for d in DIRECTIONS)):
            out = F.regexp_replace(out, f"(?iu){s}", "")
    for umlaut, plain in UMLAUTS.items():
        out = F.replace(out, F.lit(umlaut), F.lit(plain))
    words = F.transform(F.split(F.trim(F.regexp_replace(out, r"\s+", " ")), " "), lambda w: _table(w, ABBREVIATIONS, w))
    out = F.regexp_replace(F.array_join(words, " "), r"(?U)[^\w\s]", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def simply_normalised(name: Column) -> Column:
    """The short form: plant words and voltages go, lower case, one space between words."""
    out = F.regexp_replace(name, r"(?i)(umspannwerk|uw|substation|station)\s*", "")
    out = F.regexp_replace(out, r"(?i)\s*[0-9]+\s*kv", "")
    return F.lower(F.trim(F.regexp_replace(out, r"\s+", " ")))


def path_name(name: Column) -> Column:
    """The first part of a slash-separated name that is neither empty, a voltage nor a device."""
    parts = F.filter(F.transform(F.split(name, "/"), lambda p: F.trim(p)), lambda p: (p != "") & ~p.rlike(r"(?i)^\d+\s*kV$") & ~p.rlike(r"(?i)^(trafo|transformer|tr\d+)"))
    return F.coalesce(F.try_element_at(parts, F.lit(1)), F.trim(name))


def voltage_in(name: Column) -> Column:
    return F.regexp_extract(name, r"(?i)(\d{3})\s*kV", 1).try_cast("int")


def direction_in(name: Column) -> Column:
    """Nord, Süd, Ost, West (or their English names), first letter large; null if the name has none."""
    found = F.regexp_extract(name, r"(?iu)\b(Nord|Süd|Ost|West|North|South|East)\b", 1)
    return F.when(found == "", None).otherwise(F.concat(F.upper(F.substring(found, 1, 1)), F.lower(F.substring(found, 2, 9))))


def number_in(name: Column) -> Column:
    """A number at the end of the name."""
    return F.regexp_extract(name, r"\s+(\d+)\s*$", 1).try_cast("int")


def osm_number(text: Column) -> Column:
    """w123, n123 or r123 to 123; null if there is no number."""
    return F.regexp_replace(F.trim(text), "^[wnrWNR]+", "").try_cast("long")


def sorted_words(name: Column) -> Column:
    return F.array_join(F.array_sort(F.split(F.trim(name), r"\s+")), " ")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length, on sorted words; 0 if either is empty."""
    return words_similarity(sorted_words(a), sorted_words(b))


def words_similarity(x: Column, y: Column) -> Column:
    """The similarity of names whose words are sorted already."""
    longest = F.greatest(F.length(x), F.length(y))
    return F.when((F.length(x) == 0) | (F.length(y) == 0), 0.0).otherwise(1 - F.levenshtein(x, y) / longest)


def name_confidence(kind: Column, score: Column) -> Column:
    """Trust by the kind of match; fuzzy ones gain up to 0.1 from a score above 0.85 and lose below 0.80."""
    base = _table(kind, NAME_CONFIDENCE, F.lit(0.50))
    better = F.least(F.lit(0.95), base + (score - 0.85) / 0.15 * 0.10)
    worse = F.greatest(F.lit(0.50), base - (0.80 - score) * 0.20)
    return F.when(~kind.contains("fuzzy") | score.isNull(), base).when(score >= 0.85, better).when(score < 0.80, worse).otherwise(base)


def spatial_confidence(km: Column, limit: Column, method: Column) -> Column:
    """Trust by method and distance: a bonus within half the limit, a penalty beyond it, a large one beyond twice."""
    base = _table(method, SPATIAL_CONFIDENCE, F.lit(0.40))
    close = F.least(F.lit(0.90), base + F.least(F.lit(0.15), (1 - km / limit) * 0.15))
    far = F.greatest(F.lit(0.25), base - (km - limit) / limit * 0.15)
    return F.when(km <= limit * 0.5, close).when(km <= limit, base).when(km <= limit * 2, far).otherwise(F.greatest(F.lit(0.15), base - 0.25))


def fuzzy_top(left: DataFrame, right: DataFrame, block: Column, threshold: float = 0.85, k: int = 3) -> DataFrame:
    """For every left (id, name) the k most similar right (cand_id, cand_name) of the same block, from ``threshold`` up.

    ``block`` is an expression over column ``name``, taken on both sides: only names
    of a block are compared. Different names are compared once, however many rows bear
    them: of the rows with one candidate name only the k least ids can be among the k best.
    """
    from gridweave.operators.relational import top_k_by

    words = sorted_words(F.col("name"))
    # few names may make many pairs, so they are dealt by number: by their size Spark puts them into one task
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = left.select("name").distinct().repartition(tasks, F.xxhash64("name")).select("name", block.alias("_b"), words.alias("_x"))
    b = right.select(F.col("cand_name").alias("name")).distinct().select(F.col("name").alias("cand_name"), block.alias("_b2"), words.alias("_y"))
    # an edit changes the length by one at most, so lengths that differ more cannot reach the threshold
    longest = F.greatest(F.length("_x"), F.length("_y"))
    close = F.abs(F.length("_x") - F.length("_y")) <= (1 - threshold) * longest + 1e-6
    scored = a.join(b, (F.col("_b") == F.col("_b2")) & close).withColumn("score", words_similarity(F.col("_x"), F.col("_y"))).where(F.col("score") >= threshold)
    least = top_k_by(right.select("cand_id", "cand_name"), ["cand_name"], [F.col("cand_id")], k).drop("rank")
    order = [F.desc("score"), F.col("cand_id")]
    by_name = top_k_by(scored.select("name", "cand_name", "score").join(least, "cand_name"), ["name"], order, k).drop("rank")
    return top_k_by(left.select("id", "name").join(by_name, "name"), ["id"], order, k).select("id", "rank", "cand_id", "cand_name", "score")


def _ratio(a: str, b: str) -> float:
    """2 * longest common subsequence over both lengths (the ratio of insertions and deletions)."""
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))


def weighted_ratio(a: str, b: str) -> float:
    """The best of the plain ratio, the ratio of sorted words and of word sets (both times 0.95), and, where one
    name is much longer, of its windows as long as the other (times 0.9, or 0.6 beyond eight times the length)."""
    a, b = a.strip().lower(), b.strip().lower()
    if not a or not b:
        return 0.0
    best = _ratio(a, b)
    x, y = sorted(a.split()), sorted(b.split())
    both = sorted({*x} & {*y})
    rest_x, rest_y = sorted({*x} - {*y}), sorted({*y} - {*x})
    common, one, two = " ".join(both), " ".join(both + rest_x), " ".join(both + rest_y)
    by_sets = max(_ratio(one, two), *([_ratio(common, one), _ratio(common, two)] if common else [0.0]))
    short, long = sorted((a, b), key=len)
    if len(long) < 1.5 * len(short):
        return max(best, 0.95 * _ratio(" ".join(x), " ".join(y)), 0.95 * by_sets)
    part = max(_ratio(short, long[k : k + len(short)]) for k in range(len(long) - len(short) + 1))
    scale = 0.9 if len(long) <= 8 * len(short) else 0.6
    return max(best, scale * part, scale * 0.95 * by_sets)


def weighted_ratio_column(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([weighted_ratio(p or "", q or "") for p, q in zip(x, y)])

    return ratio(a, b)
