"""Relations that a phrase gives away, relations that follow from others, and what is filtered out at the end.

All work on texts (key, text) and mentions (key, name, entity_type, start, end), joined on the key alone: a text's
mentions are few, and phrases come from the text's own array of places, so nothing meets across texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_reference
from .relations import allowed

#: Confidence of each pattern, and the windows in characters that it looks through.
FROM_TO, FROM_TO_NEEDS, SUPPORT, OVER, PERSON_REPLACED, SERVICE_NEEDS = 0.75, 0.60, 0.70, 0.60, 0.55, 0.55
WINDOW, SUPPORT_WINDOW, OVER_WINDOW, VERB_WINDOW, OBJECT_WINDOW, SERVICE_WINDOW = 40, 60, 15, 15, 50, 80
#: Words that a recogniser takes for names, and relations that exclude each other between two entities.
COMMON = ("fix", "bug", "test", "run", "set", "use", "get", "put", "log", "retry", "reads", "writes", "release", "deploy", "update", "apis")
CONFLICTS = (
    ("chose", "rejected"), ("introduced", "deprecated"), ("replaced", "depends_on"), ("introduced", "depends_on"), ("introduced", "replaced"), ("chose", "depends_on"), ("caused", "fixed"),
    ("introduced", "caused"), ("replaced", "rejected"),
)


def _places(text: Column, words: str) -> Column:
    """Offsets, from 0, of every place of the words in the lower-cased text."""
    parts = F.split(F.lower(text), words)
    ends = F.aggregate(
        parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, x: F.struct((a["at"] + F.length(x) + len(words)).alias("at"), F.concat(a["out"], F.array((a["at"] + F.length(x)).cast("int"))).alias("out")),
    )["out"]
    return F.slice(ends, 1, F.size(ends) - 1)


def _named(mentions: DataFrame, key: str, prefix: str) -> DataFrame:
    rows = mentions.where(~is_reference(F.col("name")))
    return rows.select(key, *[F.col(c).alias(f"{prefix}_{c}") for c in ("name", "entity_type", "start", "end")])


def _rows(df: DataFrame, key: str, head: str, relation: str, tail: str, confidence: float, at: Column) -> DataFrame:
    return df.select(key, F.col(head).alias("head"), F.lit(relation).alias("relation"), F.col(tail).alias("tail"), F.lit(confidence).alias("confidence"), at.cast("int").alias("at"))


def _sentence_start(text: Column, at: Column) -> Column:
    """Behind the last full stop and blank before ``at``."""
    before = F.substring(text, F.lit(1), at)
    return F.when(F.contains(before, F.lit(". ")), F.length(before) - F.instr(F.reverse(before), F.lit(" .")) + 1).otherwise(F.lit(0))


def from_to(texts: DataFrame, mentions: DataFrame, key: str = "id") -> DataFrame:
    """``from OLD to NEW``: NEW replaced OLD, and what stands before it in the sentence depends on NEW.

    OLD begins 4 to 40 characters behind the phrase, NEW 3 to 40 behind the first ``to`` after OLD, in the same sentence. A name
    that repeats behind ``to`` is a new version, not a replacement.
    """
    at = texts.select(key, "text", F.explode(_places(F.col("text"), "from ")).alias("_from"))
    old = at.join(_named(mentions, key, "old"), key).where(F.col("old_start").between(F.col("_from") + 4, F.col("_from") + WINDOW))
    rest = F.lower(F.substring(F.col("text"), F.col("old_end") + 1, F.length("text")))
    old = old.withColumn("_gap", F.instr(rest, F.lit(" to ")) - 1).where("_gap >= 0").withColumn("_to", F.col("old_end") + F.col("_gap"))
    between = F.substring(rest, F.lit(1), F.col("_gap"))
    behind = F.lower(F.substring(F.col("text"), F.col("_to") + 5, F.length("text")))
    old = old.where(~between.rlike(r"\.[ \n]") & ~F.startswith(behind, F.lower("old_name")))
    both = old.join(_named(mentions, key, "new"), key).where(F.col("new_start").between(F.col("_to") + 3, F.col("_to") + WINDOW) & (F.col("new_name") != F.col("old_name")))
    types = F.col("new_entity_type"), F.col("old_entity_type")
    both = both.where(allowed(F.lit("replaced"), *types) | allowed(F.lit("replaced"), *types[::-1]))
    swapped = _rows(both, key, "new_name", "replaced", "old_name", FROM_TO, F.col("_from"))
    both = both.withColumn("_begin", _sentence_start(F.col("text"), F.col("_from")))
    parents = both.join(_named(mentions, key, "own"), key)
    parents = parents.where("own_start >= _begin and own_end <= _from and own_name <> new_name and own_name <> old_name and own_entity_type <> 'Person'")
    parents = parents.where(allowed(F.lit("depends_on"), F.col("own_entity_type"), F.col("new_entity_type")))
    return _first_of(swapped.unionByName(_rows(parents, key, "own_name", "depends_on", "new_name", FROM_TO_NEEDS, F.col("_from"))), key)


def for_support(texts: DataFrame, mentions: DataFrame, key: str = "id") -> DataFrame:
    """``for X support``: the last service or component before it in the sentence introduced X."""
    at = texts.select(key, "text", F.explode(_places(F.col("text"), "for ")).alias("_for"))
    rest = F.lower(F.substring(F.col("text"), F.col("_for") + 1, F.lit(SUPPORT_WINDOW)))
    at = at.withColumn("_end", F.col("_for") + F.instr(rest, F.lit("support")) - 1).where("_end >= _for")
    last = lambda c: F.max_by(F.struct(f"{c}_name", f"{c}_entity_type"), F.struct(f"{c}_start", f"{c}_name"))
    tails = at.join(_named(mentions, key, "tail"), key).where("tail_start >= _for + 4 and tail_end <= _end")
    tails = tails.groupBy(key, "text", "_for").agg(last("tail").alias("t")).select(key, "text", "_for", "t.*")
    tails = tails.withColumn("_begin", _sentence_start(F.col("text"), F.col("_for")))
    heads = tails.join(_named(mentions, key, "head"), key).where("head_start >= _begin and head_start < _for and head_name <> tail_name and head_entity_type in ('Service', 'Component')")
    heads = heads.groupBy(key, "_for", "tail_name", "tail_entity_type").agg(last("head").alias("h")).select(key, "_for", "tail_name", "tail_entity_type", "h.*")
    types = F.col("head_entity_type"), F.col("tail_entity_type")
    return _first_of(_rows(heads.where(allowed(F.lit("introduced"), *types) | allowed(F.lit("introduced"), *types[::-1])), key, "head_name", "introduced", "tail_name", SUPPORT, F.col("_for")), key)


def chosen_over(texts: DataFrame, mentions: DataFrame, key: str = "id") -> DataFrame:
    """``over X``: the last person of the sentence rejected the last entity that begins within 15 characters of it."""
    parts = texts.select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?]\s)|(?<=\n\n)")).alias("_n", "sentence"))
    before = Window.partitionBy(key).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_at", F.coalesce(F.sum(F.length("sentence")).over(before), F.lit(0))).withColumn("_end", F.col("_at") + F.length("sentence"))
    parts = parts.withColumn("_over", F.instr(F.lower("sentence"), F.lit(" over ")) - 1).where("_over >= 0").withColumn("_over", F.col("_at") + F.col("_over"))
    inside = parts.join(_named(mentions, key, "own"), key).where("own_start >= _at and own_start < _end")
    near = F.col("own_start").between(F.col("_over") + 1, F.col("_over") + OVER_WINDOW)
    last = lambda which: F.max_by(F.when(which, F.struct("own_name", "own_entity_type")), F.when(which, F.struct("own_start", "own_name")))
    found = inside.groupBy(key, "_n", "_over").agg(last(near).alias("x"), last(F.col("own_entity_type") == "Person").alias("p"))
    found = found.where("x is not null and p is not null and x.own_name <> p.own_name").where(allowed(F.lit("rejected"), F.col("p.own_entity_type"), F.col("x.own_entity_type")))
    return _first_of(_rows(found.select(key, "_over", F.col("p.own_name").alias("h"), F.col("x.own_name").alias("t")), key, "h", "rejected", "t", OVER, F.col("_over")), key)


def person_replaced(texts: DataFrame, mentions: DataFrame, key: str = "id") -> DataFrame:
    """A person within 15 characters before ``replac``: deprecated the first entity that begins within 50 behind it.

    The verb is the first one behind the person's first place. A mention behind the verb counts as at no distance.
    """
    low = F.lower(F.col("text"))
    people = texts.where(low.contains("replac")).select(key, "text").join(_named(mentions.where("entity_type = 'Person'"), key, "p"), key)
    first = F.instr(F.lower("text"), F.lower("p_name"))
    rest = F.substring(F.lower("text"), first, F.length("text"))
    verb = first + F.instr(rest, F.lit("replac")) - 2
    people = people.where((first > 0) & (F.instr(rest, F.lit("replac")) > 0)).withColumn("_verb", verb)
    people = people.where(F.greatest(F.col("_verb") - F.col("p_end"), F.lit(0)) < VERB_WINDOW)
    objects = people.join(_named(mentions, key, "o"), key).where((F.col("o_start") > F.col("_verb")) & (F.col("o_start") < F.col("_verb") + OBJECT_WINDOW) & (F.col("o_name") != F.col("p_name")))
    objects = objects.groupBy(key, "p_name", "p_start", "_verb").agg(F.min_by("o_name", F.struct("o_start", "o_name")).alias("o"))
    return _first_of(_rows(objects, key, "p_name", "deprecated", "o", PERSON_REPLACED, F.col("_verb")), key)


def services_need_the_new(relations: DataFrame, mentions: DataFrame, key: str = "id") -> DataFrame:
    """Where NEW replaced OLD, a service within 80 characters of NEW's first mention depends on NEW."""
    rows = relations.where("relation = 'replaced'").select(key, "head", "tail").distinct()
    firsts = mentions.groupBy(key, "name").agg(F.min(F.struct("start", "end")).alias("n"))
    rows = rows.join(firsts.withColumnRenamed("name", "head"), [key, "head"])
    near = rows.join(_named(mentions.where("entity_type = 'Service'"), key, "s"), key).where("s_name <> head and s_name <> tail")
    gap = F.when(F.col("s_start") > F.col("n.end"), F.col("s_start") - F.col("n.end")).otherwise(F.greatest(F.col("n.start") - F.col("s_end"), F.lit(0)))
    return _first_of(_rows(near.where(gap <= SERVICE_WINDOW), key, "s_name", "depends_on", "head", SERVICE_NEEDS, F.col("s_start")), key)


def _first_of(rows: DataFrame, key: str) -> DataFrame:
    """A triple that several places give once, from the first."""
    return rows.groupBy(key, "head", "relation", "tail").agg(F.max("confidence").alias("confidence"), F.min("at").alias("at"))


def without_upgrades(relations: DataFrame) -> DataFrame:
    """No replacement of a name by itself in another version, and no relation of a common word."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"[0-9. ]+$", "")
    upgrade = (F.col("relation") == "replaced") & (bare("head") != "") & (bare("head") == bare("tail"))
    return relations.where(~upgrade & ~F.lower("head").isin(*COMMON) & ~F.lower("tail").isin(*COMMON))


def one_introducer(relations: DataFrame, key: str = "id") -> DataFrame:
    """Of several heads that introduced one tail the best stays; equal ones by name."""
    best = Window.partitionBy(key, "relation", "tail").orderBy(F.desc("confidence"), "head")
    ranked = relations.withColumn("_r", F.row_number().over(best))
    return ranked.where("relation <> 'introduced' or _r = 1").drop("_r")


def without_conflicts(relations: DataFrame, key: str = "id") -> DataFrame:
    """Of two relations that exclude each other between the same two entities, either way, the weaker goes.

    Equal ones: that whose triple comes later. A relation goes by any stronger rival, even by one that goes itself.
    """
    rival = F.create_map(*[x for r in sorted({r for c in CONFLICTS for r in c}) for x in (F.lit(r), F.array(*[F.lit(b if a == r else a) for a, b in CONFLICTS if r in (a, b)]))])
    pair = Window.partitionBy(key, F.least("head", "tail"), F.greatest("head", "tail"))
    own = F.struct((-F.col("confidence")).alias("c"), "relation", "head", "tail")
    held = relations.withColumn("_own", own).withColumn("_all", F.collect_list(own).over(pair))
    rivals = F.coalesce(F.try_element_at(rival, F.col("relation")), F.array())
    beaten = F.exists("_all", lambda x: F.array_contains(rivals, x["relation"]) & (x < F.col("_own")))
    return held.where(~beaten).drop("_own", "_all")


def without_old_causes(relations: DataFrame, key: str = "id") -> DataFrame:
    """What was rejected or replaced in a text causes nothing there."""
    old = relations.where("relation in ('rejected', 'replaced')").select(F.col(key).alias("_k"), F.col("tail").alias("_old")).distinct()
    causes = relations.where("relation = 'caused'").join(old, (F.col(key) == F.col("_k")) & (F.col("head") == F.col("_old")), "left_anti")
    return relations.where("relation <> 'caused'").unionByName(causes)


def filtered(relations: DataFrame, key: str = "id") -> DataFrame:
    """All filters, in the order in which they build on each other."""
    return without_old_causes(without_conflicts(one_introducer(without_upgrades(relations), key), key), key)


def pattern_relations(texts: DataFrame, mentions: DataFrame, scored: DataFrame | None = None, key: str = "id", least: float = 0.5) -> DataFrame:
    """(key, head, relation, tail, confidence): phrases, ``scored`` relations of sentences, what follows, less what is filtered.

    A triple found twice keeps the confidence of the earlier source, phrases before scores before what follows.
    """
    rows = [from_to(texts, mentions, key), for_support(texts, mentions, key)]
    rows += [scored.select(key, "head", "relation", "tail", "confidence", F.lit(0).alias("at"))] if scored is not None else []
    rows += [chosen_over(texts, mentions, key), person_replaced(texts, mentions, key)]
    found = reduce(DataFrame.unionByName, [r.withColumn("_source", F.lit(i)) for i, r in enumerate(rows)])
    found = found.unionByName(services_need_the_new(found, mentions, key).withColumn("_source", F.lit(len(rows))))
    once = found.groupBy(key, "head", "relation", "tail").agg(F.min_by("confidence", "_source").alias("confidence"))
    return filtered(once, key).where(F.col("confidence") >= least)
