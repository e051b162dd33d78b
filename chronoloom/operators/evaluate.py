"""Extraction quality, schema-suggestion review, and training-set generation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, spans_of


def f1_exact(gold: DataFrame, predicted: DataFrame, group: str, item: str, groups: DataFrame | None = None) -> DataFrame:
    """Precision, recall and F1 of sets by group; a side that is empty gives 0.

    Of ``groups`` (group), if given, each has a row: nothing expected and nothing found is right, with 1 for all three.
    """
    g = gold.select(group, item).distinct().withColumn("g", F.lit(1))
    p = predicted.select(group, item).distinct().withColumn("p", F.lit(1))
    both = g.join(p, [group, item], "full").groupBy(group).agg(F.count("g").alias("gold"), F.count("p").alias("predicted"), F.sum(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1).otherwise(0)).alias("hits"))
    if groups is not None:
        both = groups.select(group).distinct().join(both, group, "left").fillna(0, ["gold", "predicted", "hits"])
    nothing = F.col("gold") + F.col("predicted") == 0
    ratio = lambda a, b: F.round(F.when(nothing, 1.0).when(b > 0, a / b).otherwise(0.0), 6)
    return both.select(group, "gold", "predicted", "hits", ratio(F.col("hits"), F.col("predicted")).alias("precision"), ratio(F.col("hits"), F.col("gold")).alias("recall"), ratio(2 * F.col("hits"), F.col("gold") + F.col("predicted")).alias("f1"))


def f1_greedy(gold: DataFrame, predicted: DataFrame, group: str, item: str, order: str) -> DataFrame:
    """F1 by group where each prediction, in order, takes the first free gold item that equals or contains it, either way."""

    def score(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        free = [x.strip().lower() for x in left.sort_values(order)[item]]
        n_gold, hits = len(free), 0
        for x in (y.strip().lower() for y in right.sort_values(order)[item]):
            at = next((i for i, g in enumerate(free) if x and g and (x in g or g in x)), None)
            if at is not None:
                free.pop(at)
                hits += 1
        total = n_gold + len(right)
        return pd.DataFrame({group: [key[0]], "hits": [hits], "f1": [1.0 if not total else round(2 * hits / total, 6)]})

    kind = gold.schema[group].dataType.simpleString()
    return gold.groupBy(group).cogroup(predicted.groupBy(group)).applyInPandas(score, f"{group} {kind}, hits long, f1 double")


#: Fixed value: similarity to a known name from which a suggestion is taken for it.
SAME_NAME = 0.85


def review(suggestions: DataFrame, known: DataFrame, least_rows: int = 5, least_domains: int = 3, least_confidence: float = 0.7, similarity: Column | None = None) -> DataFrame:
    """Suggested types and relations worth adding: seen often, in several domains, with confidence, and not yet known.

    A group whose domains are all null is not held to the number of domains. ``n_episodes`` counts distinct episodes
    beside the rows. Where suggestions have a ``rationale``, the first three that are not blank are kept, by episode.
    ``similarity``, an aggregate over a group, is its likeness to the nearest known name: from SAME_NAME it is left out.
    """
    reasons = []
    if "rationale" in suggestions.columns:
        said = F.when(F.trim("rationale") != "", F.struct("episode_idx", "rationale"))
        reasons = [F.transform(F.slice(F.array_sort(F.collect_list(said)), 1, 3), lambda x: x["rationale"]).alias("rationales")]
    grouped = suggestions.groupBy("kind", F.lower("name").alias("folded")).agg(
        F.count("*").alias("n_rows"), F.countDistinct("episode_idx").alias("n_episodes"), F.countDistinct(F.lower("domain")).alias("n_domains"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(1.0)), 6).alias("confidence"), F.min_by("name", F.struct("episode_idx", "name")).alias("name"), F.bool_and(F.col("domain").isNull()).alias("undated"),
        (F.lit(0.0) if similarity is None else similarity).alias("_near"), *reasons,
    )
    enough = (F.col("n_rows") >= least_rows) & (F.col("undated") | (F.col("n_domains") >= least_domains)) & (F.col("confidence") >= least_confidence)
    have = known.select("kind", F.lower("name").alias("folded"))
    fresh = grouped.where(enough & (F.coalesce("_near", F.lit(0.0)) < SAME_NAME))
    return fresh.join(have, ["kind", "folded"], "left_anti").drop("undated", "_near").orderBy(F.desc("n_rows"), "kind", "folded")


def unordered(a: str, b: str) -> Column:
    return F.array_sort(F.array(a, b))


def negative_pairs(mentions: DataFrame, gold: DataFrame, episode: str) -> DataFrame:
    """Pairs of entities of one episode (entity, position) that no gold pair (head, tail) joins in either order."""
    left = mentions.select(episode, F.col("entity").alias("head"), F.col("position").alias("_i"))
    right = mentions.select(episode, F.col("entity").alias("tail"), F.col("position").alias("_j"))
    pairs = left.join(right, episode).where("_i < _j and head <> tail").withColumn("_p", unordered("head", "tail"))
    told = gold.select(episode, unordered("head", "tail").alias("_p")).distinct()
    return pairs.join(told, [episode, "_p"], "left_anti").select(episode, "head", "tail")


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Count, share and inverse-frequency weight of each label."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return counts.join(F.broadcast(total), F.lit(True)).select(label, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), F.round(F.col("total") / (F.col("k") * F.col("n")), 6).alias("weight"))


#: Rows aimed at in one bucket of a rank over hashes.
BUCKET_ROWS = 20_000


def _hash_rank(rows: DataFrame, group: list[str], key: str, seed: str) -> DataFrame:
    """``rows`` with ``_rank``, from 1, in their group by hash of the key, and ``_size``, the rows of the group.

    Hashes are cut into buckets by their first digits; a row's rank is that in its bucket plus the sizes of the buckets
    before, so a group with most of all rows is ranked by as many tasks as its rows need.
    """
    n = rows.count()
    digits = 0
    while n > BUCKET_ROWS * 16**digits and digits < 6:
        digits += 1
    hashed = rows.withColumn("_h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))).withColumn("_b", F.substring("_h", 1, digits))
    sizes = hashed.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    starts = sizes.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_b").alias("_gb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(whole).alias("_size"))
    inside = hashed.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_h", key)))
    met = F.col("_b") == F.col("_gb")
    for i, g in enumerate(group):
        met = met & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = inside.join(starts, met).withColumn("_rank", F.col("_start") + F.col("_r"))
    return joined.drop("_h", "_b", "_gb", "_start", "_r", *[f"_g{i}" for i in range(len(group))])


def stratified_split(rows: DataFrame, label: str, key: str, share: float = 0.2, seed: str = "7") -> DataFrame:
    """``split``: of each label, in hash order, the first ``share`` (one at least) is val, the rest train."""
    ranked = _hash_rank(rows, [label], key, seed)
    first = F.col("_rank") <= F.greatest(F.floor(F.col("_size") * share), F.lit(1))
    return ranked.withColumn("split", F.when(first, "val").otherwise("train")).drop("_rank", "_size")


def marked(text: Column, head: Column, tail: Column) -> Column:
    """The text with [E1] around head and [E2] around tail, at the first places of both that do not overlap.

    Null where there are none: a name is missing, or stands only inside the other. Of head's places the first that
    leaves room for tail is taken, then the first of tail's. Places of tail are tried for that place of head alone.
    """
    room = lambda h, t: (t["end"] <= h["start"]) | (t["start"] >= h["end"])
    part = lambda a, b: F.substring(text, a + 1, b - a)
    mark = lambda x, e: F.concat(F.lit(f"[{e}]"), part(x["start"], x["end"]), F.lit(f"[/{e}]"))

    def between(x: Column, y: Column, e: str, f: str) -> Column:
        """The text with ``x`` marked as ``e`` and, behind it, ``y`` as ``f``."""
        return F.concat(part(F.lit(0), x["start"]), mark(x, e), part(x["end"], y["start"]), mark(y, f), part(y["end"], F.length(text)))

    def chosen(s: Column) -> Column:
        pairs = F.transform(F.filter(s["h"], lambda h: F.exists(s["t"], lambda t: room(h, t))), lambda h: F.struct(h.alias("h"), F.get(F.filter(s["t"], lambda t: room(h, t)), F.lit(0)).alias("t")))
        return let(F.get(pairs, F.lit(0)), lambda p: F.when(p["h"]["start"] < p["t"]["start"], between(p["h"], p["t"], "E1", "E2")).otherwise(between(p["t"], p["h"], "E2", "E1")))

    return let(F.struct(spans_of(text, head).alias("h"), spans_of(text, tail).alias("t")), chosen)


def reversed_negatives(positives: DataFrame) -> DataFrame:
    """positives (.., head, tail, relation) turned around and labelled ``none``, unless the turned pair is positive too."""
    swap = {"head": "tail", "tail": "head"}
    turned = positives.select(*[F.col(swap.get(c, c)).alias(c) for c in positives.columns])
    told = positives.select(F.col("head").alias("_h"), F.col("tail").alias("_t")).distinct()
    fresh = turned.join(told, (F.col("head") == F.col("_h")) & (F.col("tail") == F.col("_t")), "left_anti")
    return fresh.withColumn("relation", F.lit("none"))


def near_misses(positives: DataFrame, labels: tuple[str, ...], seed: str = "7") -> DataFrame:
    """Each positive with another label, the choice by hash of seed and pair, so a run can be repeated."""
    others = F.filter(F.array(*map(F.lit, sorted(labels))), lambda x: x != F.col("relation"))
    turn = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "head", "tail")), 1, 8), 16, 10).cast("bigint"), F.size(others).cast("bigint"))
    return positives.withColumn("relation", F.get(others, turn.cast("int")))


def augmented(rows: DataFrame, label: str, least: int = 100) -> DataFrame:
    """All rows, those of a label with fewer than ``least`` repeated in full until it is reached; ``copy`` numbers them."""
    counts = rows.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"))
    times = F.greatest(F.ceil(F.lit(least) / F.col("_n")), F.lit(1)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), times - 1))
    return rows.join(counts, F.col(label).eqNullSafe(F.col("_label"))).withColumn("copy", copies).drop("_n", "_label")


def capped(rows: DataFrame, label: str, key: str, none: str = "none", times: float = 2.5, seed: str = "7") -> DataFrame:
    """``none`` held to ``times`` the mean size of the other labels, by rising ``priority``, then in hash order; the rest whole.

    The cap is the feature: a training set whose classes are in proportion. Without another label nothing is dropped.
    """
    counts = rows.where(F.col(label) != none).groupBy(label).agg(F.count("*").alias("n")).agg(F.avg("n").alias("mean")).first()
    if counts["mean"] is None:
        return rows
    most = int(times * counts["mean"])
    ranked = _hash_rank(rows.where(F.col(label) == none), ["priority"], key, seed)
    sizes = rows.where(F.col(label) == none).groupBy("priority").agg(F.count("*").alias("_n"))
    before = Window.orderBy("priority").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select(F.col("priority").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    spare = ranked.join(ahead, F.col("priority").eqNullSafe(F.col("_p"))).where(F.col("_ahead") + F.col("_rank") <= most).select(*rows.columns)
    return rows.where(F.col(label) != none).unionByName(spare)
