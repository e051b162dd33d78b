"""Entity resolution: aliases, then Jaro-Winkler within a type."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def jaro_winkler(a: str, b: str) -> float:
    """Prefix of four at most, weight 0.1."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    m = len(left)
    swapped = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def similarity(a: Column, b: Column) -> Column:
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if p is None or q is None else jaro_winkler(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())

    return F.arrow_udf(run, "double")(F.lower(a), F.lower(b))


def by_alias(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """names (name, ..) with ``canonical_id`` where an alias equals the name, ASCII case aside; of several owners the least."""
    known = aliases.groupBy(F.lower("alias_name").alias("_a")).agg(F.min("canonical_id").alias("canonical_id"))
    return names.join(known, F.lower("name") == F.col("_a"), "left").drop("_a")


def _letters(name: Column) -> Column:
    """Each character of the lower-cased name with the number of its occurrence, rarest characters first.

    Two names share m characters exactly if their sets of these have m elements in common.
    """
    chars = F.filter(F.split(F.lower(name), ""), lambda c: c != "")
    tagged = F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, 1, i), lambda x: x == c)).cast("string")))
    # a fixed order, from characters that few names hold to those that most do; it only has to be the same everywhere
    order = F.lit("etaoinsrhldcumfpgwybvkxjqz 0123456789")
    place = lambda t: F.instr(order, F.substring(t, 1, 1))
    keyed = F.array_sort(F.transform(tagged, lambda t: F.struct((-F.when(place(t) == 0, 99).otherwise(place(t))).alias("p"), t.alias("t"))))
    return F.transform(keyed, lambda x: x["t"])


def least_shared(a: Column, b: Column, least: float) -> Column:
    """Characters that names of lengths a and b must share to reach ``least``.

    A prefix of four adds four tenths of what is missing, so the plain similarity must reach (least - 0.4) / 0.6; its
    third part, for order, is one at most.
    """
    plain = max(0.0, (least - 0.4) / 0.6)
    return F.ceil((3 * plain - 1) * a * b / (a + b) - 1e-9)


def similar_pairs(left: DataFrame, right: DataFrame, least: float = 0.85) -> DataFrame:
    """(name, entity_type, match, similarity) of all pairs of names of one type that reach ``least``, each once.

    No pair is lost: a pair that reaches it shares so many characters that it shares one of the first few of each name
    in the order of _letters. Names meet on those, are checked for the number that they share, and only then compared.
    """
    shortest = max(0.0, 3 * max(0.0, (least - 0.4) / 0.6) - 2)  # shorter to longer: below it no pair reaches least

    def keyed(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.col(name).alias("_n"), "entity_type").distinct().withColumn("_c", _letters(F.col("_n")))
        n = F.size("_c")
        # the fewest characters that it must share with any other name
        fewest = F.greatest(least_shared(n, F.greatest(F.ceil(n * shortest), F.lit(1)), least), F.lit(1))
        return rows.withColumn("_k", F.explode(F.slice("_c", F.lit(1), F.greatest(n - fewest + 1, F.lit(0)).cast("int"))))

    a, b = keyed(left, "name"), keyed(right, "name")
    a = a.select("entity_type", "_k", F.col("_n").alias("name"), F.col("_c").alias("_a"))
    b = b.select("entity_type", "_k", F.col("_n").alias("match"), F.col("_c").alias("_b"))
    x, y = F.size("_a"), F.size("_b")
    met = a.join(b, ["entity_type", "_k"]).where(F.least(x, y) >= shortest * F.greatest(x, y))
    shared = F.array_intersect("_a", "_b")
    # a pair that meets on several characters is taken on the first that it shares
    met = met.where((F.get(shared, F.lit(0)) == F.col("_k")) & (F.size(shared) >= least_shared(x, y, least)))
    scored = met.select("name", "entity_type", "match", F.round(similarity(F.col("name"), F.col("match")), 9).alias("similarity"))
    return scored.where(F.col("similarity") >= least)


def fuzzy(new: DataFrame, known: DataFrame, least: float = 0.85) -> DataFrame:
    """(name, entity_type, match, similarity) of the best known name of the same type, if it reaches ``least``; ties by name."""
    best = Window.partitionBy("name", "entity_type").orderBy(F.desc("similarity"), "match")
    scored = similar_pairs(new.select("name", "entity_type"), known.select("name", "entity_type"), least)
    return scored.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("name", "entity_type", "match", "similarity")
