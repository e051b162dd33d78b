"""From the scores of a model to mentions and relations. The model is the caller's; its scores come as columns.

Scores by entity pair and by span are arrays in a text's row. They are exploded, cut at the threshold where they lie,
and joined to the text's few entities, so what is shuffled is what passes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filled, pair_context, sigmoid, softmax
from .direction import turned_by_phrase
from .evaluate import marked
from .relations import allowed

#: Words of a text that make a relation likelier, and by how much.
SPOKEN = {
    "chose": ("chose", "choose", "selected", "picked", "adopted", "decided to use", "went with"),
    "rejected": ("rejected", "decided against", "ruled out", "passed on"),
    "replaced": ("replaced", "migrated from", "switched from", "moved from", "transitioned"),
    "depends_on": ("depends on", "relies on", "built on", "running on", "uses"),
    "introduced": ("introduced", "added", "implemented", "rolled out", "adopted"),
    "deprecated": ("deprecated", "removed", "phased out", "sunset", "dropped"),
    "caused": ("caused", "resulted in", "led to", "triggered"),
    "fixed": ("fixed", "resolved", "patched", "addressed"),
    "constrained_by": ("constrained by", "limited by", "requirement", "compliance", "must"),
}
BOOST = 1.3
#: Two ways to state each relation as a hypothesis.
HYPOTHESES = {
    "chose": ("{head} chose {tail}", "{head} selected {tail}"), "rejected": ("{head} rejected {tail}", "{head} decided against {tail}"),
    "replaced": ("{head} replaced {tail}", "{tail} was replaced by {head}"), "depends_on": ("{head} depends on {tail}", "{head} uses {tail}"), "fixed": ("{head} fixed {tail}", "{head} resolved {tail}"),
    "introduced": ("{head} introduced {tail}", "{head} added {tail}"), "deprecated": ("{head} deprecated {tail}", "{head} removed {tail}"), "caused": ("{head} caused {tail}", "{head} led to {tail}"),
    "constrained_by": ("{head} is constrained by {tail}", "{head} must comply with {tail}"),
}
#: Probability from which a class counts, and that from which another class overrules a rule's relation.
CLASS_LEAST, OTHER_LEAST, NONE_MOST = 0.55, 0.60, 0.20


def ordered_pairs(entities: DataFrame, key: str = "id") -> DataFrame:
    """(key, pair, i, j, head.., tail..) of entities (key, position, name, entity_type): all pairs of different ones, by position.

    ``pair`` numbers a text's pairs from 0, the first entity's before the second's.
    """
    side = lambda p, i: entities.select(key, F.col("position").alias(i), F.col("name").alias(p), F.col("entity_type").alias(f"{p}_type"))
    pairs = side("head", "i").join(side("tail", "j"), key).where("i <> j")
    return pairs.withColumn("pair", F.row_number().over(Window.partitionBy(key).orderBy("i", "j")) - 1)


def spoken_of(text: Column, relation: Column) -> Column:
    """Whether the text has a word that speaks of the relation."""
    out = F.lit(False)
    for name, words in SPOKEN.items():
        out = out | ((relation == name) & F.lower(text).rlike("|".join(words)))
    return out


def pair_relations(texts: DataFrame, entities: DataFrame, labels: tuple[str, ...], least: float = 0.5, key: str = "id") -> DataFrame:
    """(key, head, relation, tail, confidence) of texts (key, text, logits): a logit for each ordered pair and label.

    Of the two directions of a pair and label the likelier stays; words of the text raise a relation; then each
    directed pair keeps its best label. Ties: the pair that comes first, then the label that does.
    """
    scores = texts.select(key, "text", F.posexplode("logits").alias("_n", "_x")).withColumn("_p", sigmoid(F.col("_x").cast("double"))).where(F.col("_p") >= least)
    names = F.array(*map(F.lit, labels))
    scores = scores.select(key, "text", F.floor(F.col("_n") / len(labels)).cast("int").alias("pair"), F.col("_n"), F.get(names, F.col("_n") % len(labels)).alias("relation"), "_p")
    rows = scores.join(ordered_pairs(entities, key), [key, "pair"])
    one_way = Window.partitionBy(key, F.least("i", "j"), F.greatest("i", "j"), "relation").orderBy(F.desc("_p"), "_n")
    rows = rows.withColumn("_r", F.row_number().over(one_way)).where("_r = 1")
    rows = rows.withColumn("_p", F.col("_p") * F.when(spoken_of(F.col("text"), F.col("relation")), BOOST).otherwise(1.0))
    best = Window.partitionBy(key, "i", "j").orderBy(F.desc("_p"), "_n")
    return rows.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(key, "head", "relation", "tail", F.round("_p", 6).alias("confidence"))


def schema_direction(relations: DataFrame, head_type: str = "head_type", tail_type: str = "tail_type", first: Column | None = None) -> DataFrame:
    """relations with head and tail (and their types) turned where only that fits the schema; where both do, by ``first``."""
    forward = allowed(F.col("relation"), F.col(head_type), F.col(tail_type))
    back = allowed(F.col("relation"), F.col(tail_type), F.col(head_type))
    stays = F.when(forward & back, F.lit(True) if first is None else first).otherwise(forward | ~back)
    swap = {"head": "tail", "tail": "head", head_type: tail_type, tail_type: head_type}
    rows = relations.withColumn("_stays", stays)
    return rows.select(*[F.when(F.col("_stays"), F.col(c)).otherwise(F.col(swap[c])).alias(c) if c in swap else F.col(c) for c in relations.columns])


def span_entities(texts: DataFrame, labels: tuple[str, ...], width: int, least: float = 0.5, key: str = "id") -> DataFrame:
    """(key, text, entity_type, start, end, confidence) of texts (key, content, words, logits): spans of up to ``width`` words.

    ``words`` as of words_with_offsets, a logit for each first word, width and label. Of spans that overlap the likelier
    stays, greedily; ties by start, end and label.
    """
    n = F.col("_n")
    rows = texts.select(key, "content", "words", F.posexplode("logits").alias("_n", "_x")).withColumn("_p", sigmoid(F.col("_x").cast("double"))).where(F.col("_p") >= least)
    first, wide = F.floor(n / (width * len(labels))).cast("int"), (F.floor(n / len(labels)) % width).cast("int")
    rows = rows.withColumn("_a", F.get("words", first)).withColumn("_b", F.get("words", first + wide)).where("_a is not null and _b is not null")
    rows = rows.select(key, F.col("_a.start").alias("start"), F.col("_b.end").alias("end"), F.get(F.array(*map(F.lit, labels)), n % len(labels)).alias("entity_type"), F.round("_p", 6).alias("confidence"), "content")
    spans = rows.select(key, F.substring(F.col("content"), F.col("start") + 1, F.col("end") - F.col("start")).alias("text"), "entity_type", "start", "end", "confidence")
    return without_weaker(spans, key)


def without_weaker(spans: DataFrame, key: str = "id") -> DataFrame:
    """Spans of which no two overlap: the most confident first, then what is still free; a text's spans are one array."""
    order = F.struct((-F.col("confidence")).alias("c"), "start", "end", "entity_type", "text")
    listed = spans.groupBy(key).agg(F.sort_array(F.collect_list(order)).alias("s"))
    free = lambda kept, x: ~F.exists(kept, lambda k: (x["start"] < k["end"]) & (x["end"] > k["start"]))
    kept = F.aggregate("s", F.slice("s", 1, 0), lambda a, x: F.when(free(a, x), F.concat(a, F.array(x))).otherwise(a))
    return listed.select(key, F.explode(kept).alias("e")).select(key, "e.text", "e.entity_type", "e.start", "e.end", (-F.col("e.c")).alias("confidence"))


def masked_relations(texts: DataFrame, entities: DataFrame, labels: tuple[str, ...], least: float = 0.5, key: str = "id") -> DataFrame:
    """(key, head, relation, tail, confidence) of texts (key, pairs): pairs of struct(i, j, mask, logits).

    Only pairs with a mask of one half or more, whose entities exist and differ, and labels that the schema admits one
    way or the other; the way that it admits is the result. A triple that comes twice keeps its first confidence.
    """
    rows = texts.select(key, F.posexplode("pairs").alias("_k", "p")).where("p.mask >= 0.5")
    rows = rows.select(key, "_k", F.col("p.i").alias("i"), F.col("p.j").alias("j"), F.posexplode("p.logits").alias("_n", "_x")).withColumn("_p", sigmoid(F.col("_x").cast("double")))
    rows = rows.where((F.col("_p") >= least) & (F.col("_n") < len(labels))).withColumn("relation", F.get(F.array(*map(F.lit, labels)), F.col("_n")))
    side = lambda p, i: entities.select(key, F.col("position").alias(i), F.col("name").alias(p), F.col("entity_type").alias(f"{p}_type"))
    rows = rows.join(side("head", "i"), [key, "i"]).join(side("tail", "j"), [key, "j"]).where("head <> tail")
    types = F.col("head_type"), F.col("tail_type")
    rows = rows.where(allowed(F.col("relation"), *types) | allowed(F.col("relation"), *types[::-1]))
    turned = schema_direction(rows)
    return turned.groupBy(key, "head", "relation", "tail").agg(F.round(F.min_by("_p", F.struct("_k", "_n")), 6).alias("confidence"))


def hypotheses(entities: DataFrame, key: str = "id") -> DataFrame:
    """(key, head, relation, tail, hypothesis): both templates of every relation, for both directions of pairs that the schema admits."""
    rows = ordered_pairs(entities, key).where("head <> tail")
    types = F.col("head_type"), F.col("tail_type")
    made = [F.struct(F.lit(r).alias("relation"), filled(t, {"head": F.col("head"), "tail": F.col("tail")}).alias("hypothesis")) for r, ts in HYPOTHESES.items() for t in ts]
    rows = rows.select(key, "head", "tail", "head_type", "tail_type", F.explode(F.array(*made)).alias("h")).select(key, "head", "tail", "head_type", "tail_type", "h.*")
    return rows.where(allowed(F.col("relation"), *types)).select(key, "head", "relation", "tail", "hypothesis")


def entailed(scored: DataFrame, least: float = 0.5, key: str = "id") -> DataFrame:
    """(key, head, relation, tail, confidence) of scored hypotheses (.., entailment): the best template, then the best of a pair.

    Pairs are unordered: of both directions and all relations one stays. Ties by relation, head and tail.
    """
    best = scored.groupBy(key, "head", "relation", "tail").agg(F.max("entailment").alias("confidence")).where(F.col("confidence") >= least)
    return top_of_pair(best, key)


def top_of_pair(relations: DataFrame, key: str = "id") -> DataFrame:
    pair = [key, F.least("head", "tail"), F.greatest("head", "tail")]
    ranked = relations.withColumn("_r", F.row_number().over(Window.partitionBy(*pair).orderBy(F.desc("confidence"), "relation", "head", "tail")))
    return ranked.where("_r = 1").drop("_r")


def classified(scores: Column, labels: tuple[str, ...], none: int = 0, least: float = CLASS_LEAST) -> Column:
    """struct(relation, confidence) of the likeliest class; null for the none class, and below ``least``."""
    shares = F.transform(softmax(F.slice(scores, 1, len(labels))), lambda x, i: F.struct(x.alias("p"), (-i).alias("i")))
    best = F.array_max(shares)
    made = F.struct(F.get(F.array(*map(F.lit, labels)), -best["i"]).alias("relation"), F.round(best["p"], 6).alias("confidence"))
    return F.when((F.size(scores) > 0) & (-best["i"] != none) & (best["p"] >= least), made)


def pairs_to_classify(texts: DataFrame, entities: DataFrame, key: str = "id") -> DataFrame:
    """(key, text, head, tail, marked, turned): every unordered pair of different names once, marked in both directions."""
    side = lambda p, i: entities.select(key, F.col("position").alias(i), F.col("name").alias(p))
    pairs = side("head", "i").join(side("tail", "j"), key).where("i < j and head <> tail")
    firsts = pairs.groupBy(key, F.least("head", "tail").alias("_a"), F.greatest("head", "tail").alias("_b")).agg(F.min(F.struct("i", "j", "head", "tail")).alias("p"))
    rows = texts.select(key, "text").join(firsts, key).select(key, "text", "p.head", "p.tail")
    return rows.withColumn("marked", marked(F.col("text"), F.col("head"), F.col("tail"))).withColumn("turned", marked(F.col("text"), F.col("tail"), F.col("head")))


def classified_relations(pairs: DataFrame, labels: tuple[str, ...], none: int = 0, least: float = CLASS_LEAST, key: str = "id") -> DataFrame:
    """(key, head, relation, tail, confidence) of pairs (.., forward, backward: class scores): head to tail first, else back.

    Phrases of the text then turn a relation that stands the wrong way round.
    """
    rows = pairs.withColumn("_f", classified(F.col("forward"), labels, none, least)).withColumn("_b", classified(F.col("backward"), labels, none, least))
    rows = rows.where("_f is not null or _b is not null").withColumn("_c", F.coalesce("_f", "_b"))
    first, second = F.when(F.col("_f").isNotNull(), F.col("head")).otherwise(F.col("tail")), F.when(F.col("_f").isNotNull(), F.col("tail")).otherwise(F.col("head"))
    rows = rows.select(key, "text", first.alias("head"), F.col("_c.relation").alias("relation"), second.alias("tail"), F.col("_c.confidence").alias("confidence"))
    turn = turned_by_phrase(F.col("text"), F.col("relation"), F.col("head"), F.col("tail"))
    rows = rows.withColumn("_t", turn)
    end = lambda a, b: F.when(F.col("_t"), F.col(b)).otherwise(F.col(a))
    return rows.select(key, end("head", "tail").alias("head"), "relation", end("tail", "head").alias("tail"), "confidence")


def confirmed(relations: DataFrame, labels: tuple[str, ...], none: int = 0, most_none: float = 0.5) -> DataFrame:
    """relations (.., relation, scores) that a second classifier does not deny: neither likely none nor surely another one."""
    shares = softmax(F.col("scores"))
    nothing = F.get(shares, F.lit(none))
    best = F.array_max(F.transform(shares, lambda x, i: F.struct(x.alias("p"), (-i).alias("i"))))
    named = F.get(F.array(*map(F.lit, labels)), -best["i"])
    other = (-best["i"] != none) & (named != F.col("relation")) & (best["p"] > OTHER_LEAST) & (nothing < NONE_MOST)
    return relations.where(~((nothing > most_none) | other))


def context_of_pair(text: Column, head: Column, tail: Column) -> Column:
    return pair_context(text, head, tail)


def spans_to_entities(spans: DataFrame, entities: DataFrame, key: str = "id", least: float = 0.3) -> DataFrame:
    """spans (key, span) with ``entity``: the name that equals the span, else the one closest in length that holds it or is held."""
    low, name = F.lower("span"), F.lower("name")
    near = F.least(F.length(low), F.length(name)) / F.greatest(F.length(low), F.length(name))
    rows = spans.select(key, "span").distinct().join(entities.select(key, "name", "position"), key).where(F.contains(name, low) | F.contains(low, name))
    rows = rows.withColumn("_s", near).where((F.col("_s") >= least) | (low == name))
    best = rows.groupBy(key, "span").agg(F.max_by("name", F.struct((low == name).alias("e"), "_s", (-F.col("position")).alias("p"))).alias("entity"))
    return spans.join(best, [key, "span"], "left")


def entity_words(entities: DataFrame, texts: DataFrame, key: str = "id") -> DataFrame:
    """(key, position, first, last): the words of texts (key, words) that an entity (key, position, start, end) overlaps."""
    words = texts.select(key, F.posexplode("words").alias("_n", "_w"))
    rows = entities.select(key, "position", "start", "end").join(words, key).where((F.col("_w.start") < F.col("end")) & (F.col("_w.end") > F.col("start")))
    return rows.groupBy(key, "position").agg(F.min("_n").alias("first"), F.max("_n").alias("last"))


def best_engine(engines: list[tuple[str, Callable[..., DataFrame] | None]]) -> tuple[str, Callable[..., DataFrame]]:
    """The first engine that is there; the heuristic one, which always is, stands last."""
    for name, engine in engines:
        if engine is not None:
            return name, engine
    raise ValueError("no engine")
