"""Training examples for a relation classifier from labelled episodes: positives, negatives of many kinds, one set.

An example is (text, head, tail, label, kind); text has [E1] and [E2] around head and tail. Episodes are (episode, text),
entities (episode, name, entity_type, position, start, end), relations (episode, head, relation, tail). Choices are by
hash of a seed and the example, so a run can be repeated whatever the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filled, one_marker, sentences
from .evaluate import capped, marked, negative_pairs, stratified_split

NONE = "none"
#: The kinds of negatives, most realistic first.
PRIORITY = ("unrelated", "hard", "reversed", "near_miss", "pair")
KEY = ("head", "tail", "label", "text")


def _hash(seed: str, *columns: str | Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *columns))


def _chosen(seed: str, n: int, *columns: str | Column) -> Column:
    """A number below ``n`` by hash."""
    return F.pmod(F.conv(F.substring(_hash(seed, *columns), 1, 8), 16, 10).cast("bigint"), F.lit(n).cast("bigint")).cast("int")


def _example(df: DataFrame, text: Column, label: Column | str, kind: str) -> DataFrame:
    rows = df.select(text.alias("text"), "head", "tail", (F.lit(label) if isinstance(label, str) else label).alias("label"), F.lit(kind).alias("kind"))
    return rows.where("text is not null")


def wrapped(name: Column, marker: str) -> Column:
    return F.concat(F.lit(f"[{marker}]"), name, F.lit(f"[/{marker}]"))


def from_template(templates: Sequence[str], seed: str, *by: str | Column) -> Column:
    """One of ``templates`` by hash, its ``{head}`` and ``{tail}`` filled with the marked names."""
    texts = [filled(t, {"head": wrapped(F.col("head"), "E1"), "tail": wrapped(F.col("tail"), "E2")}) for t in templates]
    return F.get(F.array(*texts), _chosen(seed, len(texts), *by))


def positives(episodes: DataFrame, relations: DataFrame) -> DataFrame:
    """One example a gold relation whose head and tail stand apart in the text."""
    rows = relations.join(episodes.select("episode", "text"), "episode")
    return _example(rows, marked(F.col("text"), F.col("head"), F.col("tail")), F.col("relation"), "gold")


def unlabelled_pairs(episodes: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Negatives from pairs of entities of one episode that no relation joins."""
    said = entities.select("episode", F.col("name").alias("entity"), "position")
    pairs = negative_pairs(said, relations.select("episode", "head", "tail"), "episode").join(episodes.select("episode", "text"), "episode")
    return _example(pairs, marked(F.col("text"), F.col("head"), F.col("tail")), NONE, "pair")


def unrelated_in_episode(episodes: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Of those the pairs that share no sentence, though each stands in some."""
    said = entities.select("episode", F.col("name").alias("entity"), "position")
    pairs = negative_pairs(said, relations.select("episode", "head", "tail"), "episode").join(episodes.select("episode", "text"), "episode")
    parts = sentences(F.regexp_replace("text", "\n", "\n\n"))
    places = lambda c: F.transform(F.filter(F.transform(parts, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: F.contains(x["s"], F.col(c))), lambda x: x["i"])
    rows = pairs.withColumn("_h", places("head")).withColumn("_t", places("tail")).where("size(_h) > 0 and size(_t) > 0 and not arrays_overlap(_h, _t)")
    return _example(rows, marked(F.col("text"), F.col("head"), F.col("tail")), NONE, "unrelated")


def template_pairs(entities: DataFrame, templates: Sequence[str], count: int, kind: str = "hard", seed: str = "7") -> DataFrame:
    """``count`` negatives from templates, each of two different names drawn by hash from all distinct ones.

    Names are numbered by hash in buckets; the count is that of a training set, so the draw is small and names meet it.
    """
    names = entities.select("name").distinct().withColumn("_n", F.row_number().over(Window.orderBy(F.md5(F.concat(F.lit(seed), "name")), "name")) - 1)
    n = names.count()
    if n < 2 or count <= 0:
        return entities.sparkSession.createDataFrame([], "text string, head string, tail string, label string, kind string")
    draw = entities.sparkSession.range(count).select(F.col("id"), _chosen(seed + "h", n, F.col("id").cast("string")).alias("_a"), _chosen(seed + "t", n - 1, F.col("id").cast("string")).alias("_o"))
    draw = draw.withColumn("_b", (F.col("_a") + 1 + F.col("_o")) % n)
    side = lambda c, k: names.select(F.col("name").alias(c), F.col("_n").alias(k))
    rows = draw.join(side("head", "_a"), "_a").join(side("tail", "_b"), "_b")
    return _example(rows, from_template(templates, seed, F.col("id").cast("string")), NONE, kind)


def reversed_pairs(relations: DataFrame, templates: dict[str, Sequence[str]], directed: Sequence[str], seed: str = "7") -> DataFrame:
    """Negatives that state a directed relation the wrong way round."""
    rows = relations.where(F.col("relation").isin(*directed)).select(F.col("tail").alias("head"), F.col("head").alias("tail"), "relation").distinct()
    return _example(rows, _by_label(templates, F.col("relation"), seed), NONE, "reversed")


def near_miss_pairs(relations: DataFrame, templates: dict[str, Sequence[str]], seed: str = "7") -> DataFrame:
    """Negatives that state another relation of a related pair, chosen by hash."""
    labels = sorted(templates)
    others = F.filter(F.array(*map(F.lit, labels)), lambda x: x != F.col("relation"))
    turn = F.pmod(F.conv(F.substring(_hash(seed, "head", "tail", "relation"), 1, 8), 16, 10).cast("bigint"), F.size(others).cast("bigint")).cast("int")
    rows = relations.select("head", "tail", "relation").distinct().withColumn("_other", F.get(others, turn)).where("_other is not null")
    return _example(rows, _by_label(templates, F.col("_other"), seed), NONE, "near_miss")


def _by_label(templates: dict[str, Sequence[str]], label: Column, seed: str) -> Column:
    return F.coalesce(*[F.when(label == name, from_template(texts, seed, "head", "tail", label)) for name, texts in sorted(templates.items()) if texts])


def paraphrases(examples: DataFrame, templates: dict[str, Sequence[str]], least: int = 100, seed: str = "7") -> DataFrame:
    """Examples of labels with fewer than ``least``, said anew by templates until there are as many; a template once an example."""
    counts = examples.groupBy("label").agg(F.count("*").alias("_n"))
    needed = F.greatest(F.lit(least) - F.col("_n"), F.lit(0))
    each = F.floor(needed / F.col("_n")) + 1
    rows = examples.join(counts.where(F.col("_n") < least), "label").withColumn("_need", needed).withColumn("_each", each)
    made = []
    for label, texts in sorted(templates.items()):
        variants = F.array(*[F.struct(_hash(seed, "head", "tail", F.lit(str(i))).alias("o"), filled(t, {"head": wrapped(F.col("head"), "E1"), "tail": wrapped(F.col("tail"), "E2")}).alias("t")) for i, t in enumerate(texts)])
        made.append(F.when(F.col("label") == label, F.slice(F.array_sort(variants), F.lit(1), F.least(F.col("_each"), F.lit(len(texts))).cast("int"))))
    some = rows.select("head", "tail", "label", "_need", F.explode(F.coalesce(*made)).alias("v"))
    # the count asked for is at most ``least``, so a label's window is small
    ranked = some.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy("v.o", "head", "tail"))).where("_r <= _need")
    return ranked.select(F.col("v.t").alias("text"), "head", "tail", "label", F.lit("paraphrase").alias("kind"))


def mixed_across(entities: DataFrame, relations: DataFrame, templates: dict[str, Sequence[str]], each: int = 3, seed: str = "7") -> DataFrame:
    """Positives from names of other episodes: for every relation and pair of types that it joins, ``each`` drawn pairs.

    A pool is the distinct names of a type, numbered by hash; a draw meets its two names by number.
    """
    kinds = entities.groupBy("name").agg(F.min("entity_type").alias("entity_type"))
    kind = lambda c: kinds.select(F.col("name").alias(c), F.col("entity_type").alias(f"{c}_type"))
    typed = relations.join(kind("head"), "head").join(kind("tail"), "tail").select("relation", "head_type", "tail_type").distinct()
    pools = kinds.withColumn("_n", F.row_number().over(Window.partitionBy("entity_type").orderBy(F.md5(F.concat(F.lit(seed), "name")), "name")) - 1)
    sizes = kinds.groupBy("entity_type").agg(F.count("*").alias("size"))
    size = lambda c: sizes.select(F.col("entity_type").alias(f"{c}_type"), F.col("size").alias(f"_{c}_size"))
    draws = typed.join(size("head"), "head_type").join(size("tail"), "tail_type").withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(each))))
    number = lambda c: F.pmod(F.conv(F.substring(_hash(seed + c, "relation", "head_type", "tail_type", F.col("_k").cast("string")), 1, 8), 16, 10).cast("bigint"), F.col(f"_{c}_size")).cast("int")
    draws = draws.withColumn("_a", number("head")).withColumn("_b", number("tail"))
    pool = lambda c, n: pools.select(F.col("entity_type").alias(f"{c}_type"), F.col("_n").alias(n), F.col("name").alias(c))
    rows = draws.join(pool("head", "_a"), ["head_type", "_a"]).join(pool("tail", "_b"), ["tail_type", "_b"]).where("head <> tail").select("relation", "head", "tail").distinct()
    return _example(rows, _by_label(templates, F.col("relation"), seed), F.col("relation"), "mixed")


def without_repeats(examples: DataFrame, chars: int = 100) -> DataFrame:
    """One example of each head, tail, label and beginning of the text: that of the most realistic kind, then the least text."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[x for i, k in enumerate(PRIORITY) for x in (F.lit(k), F.lit(i))]), F.col("kind")), F.lit(-1))
    best = F.min(F.struct(rank.alias("r"), "text", "kind")).alias("b")
    return examples.groupBy("head", "tail", "label", F.substring("text", 1, chars).alias("_s")).agg(best).select(F.col("b.text").alias("text"), "head", "tail", "label", F.col("b.kind").alias("kind"))


def training_set(examples: DataFrame, times: float = 2.5, share: float = 0.2, seed: str = "7") -> DataFrame:
    """Distinct examples, negatives held to ``times`` the mean positive class by realism, split by label; with ``split``."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[x for i, k in enumerate(PRIORITY) for x in (F.lit(k), F.lit(i))]), F.col("kind")), F.lit(0))
    rows = without_repeats(examples).withColumn("priority", rank).withColumn("_key", F.concat_ws("|", *KEY))
    held = capped(rows, "label", "_key", NONE, times, seed)
    return stratified_split(held, "label", "_key", share, seed).drop("priority", "_key")


def triple_texts(examples: DataFrame) -> DataFrame:
    """examples with head_text and tail_text, each with the markers of one entity, and pair_text, the two names."""
    text = F.col("text")
    return examples.select("*", one_marker(text, "E1").alias("head_text"), one_marker(text, "E2").alias("tail_text"), F.concat_ws(" ", "head", "tail").alias("pair_text"))


