"""Episodes into the graph: extract, resolve against what is known, link, add edges, end what no longer holds.

A batch of episodes is one plan. Names resolve by alias, then by similarity to entities of their type, then among
themselves: of the batch's new names the first, by episode and place, stands for those that resemble it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import metadata
from ..plans.stored import discard, write_out
from ..sources.store import GraphStore, new_ids
from . import envelope, graph, resolve

MENTIONS = "episode string, name string, entity_type string, start int, end int, position int"
RELATIONS = "episode string, head string, relation string, tail string, confidence double, fact string"
#: Gives mentions and relations, in the shapes above, of episodes (id, content, ..).
Extract = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


@dataclass(frozen=True)
class Counts:
    """What a batch added. A mention that resolves to a known entity is linked but not counted as new."""

    episodes: int
    entities: int
    edges: int
    unresolved: int
    invalidated: int = 0
    suggestions: int = 0


def with_answers(mentions: DataFrame, relations: DataFrame, more_mentions: DataFrame, more_relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Local results and what a model adds: names that are new by episode, and pairs that no relation joins either way."""
    told = mentions.select("episode", F.lower("name").alias("_n")).distinct()
    extra = more_mentions.join(told, (more_mentions["episode"] == told["episode"]) & (F.lower(more_mentions["name"]) == told["_n"]), "left_anti")
    pair = F.array_sort(F.array(F.lower("head"), F.lower("tail")))
    have = relations.select("episode", pair.alias("_p")).distinct()
    fresh = more_relations.withColumn("_p", pair).join(have, ["episode", "_p"], "left_anti").drop("_p")
    return mentions.unionByName(extra, allowMissingColumns=True), relations.unionByName(fresh, allowMissingColumns=True)


def resolved(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, least: float = 0.85) -> DataFrame:
    """(name, entity_type, entity_id, match, similarity, is_new) of the distinct names of ``mentions``.

    An alias decides for any type, by case-folded name, to the least canonical id; then the best entity of the type; then
    the best earlier new name of the type. What remains is new and its own: ``entity_id`` is null, ``match`` the name
    that it stands under.
    """
    names = mentions.groupBy("name", "entity_type").agg(F.min(F.struct("episode", "position", "name")).alias("first"))
    by_alias = resolve.by_alias(names, aliases).withColumnRenamed("canonical_id", "entity_id")
    left = write_out(by_alias.where("entity_id is null").drop("entity_id"))
    found = by_alias.where("entity_id is not null").select("name", "entity_type", "entity_id", F.col("name").alias("match"), F.lit(None).cast("double").alias("similarity"), F.lit(False).alias("is_new"))
    best = resolve.fuzzy(left, entities.select("name", "entity_type"), least)
    ids = entities.groupBy("name", "entity_type").agg(F.min_by("id", F.struct("created_at", "id")).alias("entity_id")).withColumnRenamed("name", "match")
    known = write_out(best.join(ids, ["match", "entity_type"]).select("name", "entity_type", "entity_id", "match", "similarity", F.lit(False).alias("is_new")))
    fresh = write_out(left.join(known.select("name", "entity_type"), ["name", "entity_type"], "left_anti"))
    pairs = resolve.similar_pairs(fresh.select("name", "entity_type"), fresh.select("name", "entity_type"), least).where("name <> match")
    order = fresh.select("name", "entity_type", "first")
    rival = order.select(F.col("name").alias("match"), "entity_type", F.col("first").alias("_first"))
    earlier = write_out(pairs.join(order, ["name", "entity_type"]).join(rival, ["match", "entity_type"]).where("_first < first"))
    heads = _heads(fresh, earlier)
    own = heads.select("name", "entity_type", F.lit(None).cast("string").alias("entity_id"), "match", "similarity", (F.col("name") == F.col("match")).alias("is_new"))
    return found.unionByName(known).unionByName(own)


def _heads(fresh: DataFrame, earlier: DataFrame) -> DataFrame:
    """(name, entity_type, match, similarity): the name each new one stands under, as if they came one after the other.

    A name with no earlier rival is a head. Every name with a head among its rivals takes the best and is none; one whose
    rivals are all settled and none a head becomes one. Each round settles at least the first open name of a chain.
    """
    key = ["name", "entity_type"]
    heads = write_out(fresh.join(earlier.select(*key).distinct(), key, "left_anti").select(*key))
    taken = write_out(fresh.select(*key, F.lit("").alias("match"), F.lit(0.0).alias("similarity")).limit(0))
    while True:
        open_ = earlier.join(heads, key, "left_anti").join(taken.select(*key), key, "left_anti")
        if not open_.limit(1).count():
            return heads.select(*key, F.col("name").alias("match"), F.lit(1.0).alias("similarity")).unionByName(taken)
        head = heads.select(F.col("name").alias("match"), "entity_type", F.lit(1).alias("_h"))
        gone = taken.select(F.col("name").alias("match"), "entity_type", F.lit(0).alias("_h"))
        state = open_.join(head.unionByName(gone), ["match", "entity_type"], "left")
        told = state.groupBy(*key).agg(F.bool_and(F.col("_h").isNotNull()).alias("done"), F.max(F.when(F.col("_h") == 1, F.struct("similarity", "match"))).alias("best"))
        told = write_out(told.where("done"))
        taken = write_out(taken.unionByName(told.where("best is not null").select(*key, F.col("best.match").alias("match"), F.col("best.similarity").alias("similarity"))))
        heads = write_out(heads.unionByName(told.where("best is null").select(*key)))


def ingest(store: GraphStore, episodes: DataFrame, extract: Extract | None = None, least: float = 0.85, hints: DataFrame | None = None, vectors: DataFrame | None = None) -> Counts:
    """Add episodes (id, content, source, recorded_at, metadata) and what ``extract`` finds in them.

    Mentions resolve to entities; new ones are added, names that resemble one become aliases; each episode is linked to
    its entities; relations between resolved names become edges, others are counted as unresolved. ``hints`` (episode,
    hint) end the current edges that they describe, before this batch's edges are added. ``vectors`` (id, embedding) are
    stored for the episodes. An episode whose id is known is not added again.
    """
    fresh = write_out(episodes.dropDuplicates(["id"]).join(store.table("episodes").select("id"), "id", "left_anti"))
    store.append("episodes", fresh)
    n = fresh.count()
    if vectors is not None:
        store.store_embeddings(vectors.join(fresh.select("id"), "id", "left_semi"))
    if extract is None or not n:
        return Counts(n, 0, 0, 0)
    mentions, relations = (write_out(x) for x in extract(fresh))
    answer = write_out(resolved(mentions, store.table("entities"), store.table("aliases"), least))
    made = write_out(answer.where("is_new").select(new_ids().alias("id"), "name", "entity_type").withColumn("created_at", F.current_timestamp()))
    ids = made.select(F.col("name").alias("match"), "entity_type", F.col("id").alias("_new"))
    named = write_out(answer.join(ids, ["match", "entity_type"], "left").select("name", "entity_type", "match", "similarity", "is_new", F.coalesce("entity_id", "_new").alias("entity_id")))
    store.append("entities", made)
    store.add_aliases(named.where("not is_new and similarity is not null").select(F.col("entity_id").alias("canonical_id"), F.col("name").alias("alias_name"), "similarity"))
    linked = write_out(mentions.join(named.select("name", "entity_type", "entity_id"), ["name", "entity_type"]))
    store.link(linked.select(F.col("episode").alias("episode_id"), "entity_id", F.col("start").alias("span_start"), F.col("end").alias("span_end")))
    ended = 0
    if hints is not None:
        now = fresh.sparkSession.range(1).select(F.current_timestamp()).first()[0]
        edges, chosen = graph.invalidate_by_hints(store.table("edges"), store.table("entities"), linked.select("episode", "entity_id"), hints, now)
        ended = chosen.count()
        if ended:
            store.replace("edges", edges)
    built = write_out(edges_of(relations, linked))
    store.append("edges", built.where("source_id is not null and target_id is not null").withColumn("id", new_ids()).withColumn("recorded_at", F.current_timestamp()))
    total, whole = built.agg(F.count("*"), F.sum((F.col("source_id").isNotNull() & F.col("target_id").isNotNull()).cast("long"))).first()
    counts = Counts(n, made.count(), whole or 0, total - (whole or 0), ended)
    for used in (fresh, mentions, relations, answer, made, named, linked, built):
        discard(used)
    return counts


def edges_of(relations: DataFrame, linked: DataFrame) -> DataFrame:
    """(episode_id, source_id, target_id, relation, fact, confidence): names of relations as the ids of their episode's entities.

    A name that is not among the episode's mentions gives a null id; one with several types is that of its first place.
    """
    ids = linked.groupBy("episode", "name").agg(F.min_by("entity_id", F.struct("position", "entity_id")).alias("entity_id"))
    side = lambda p: ids.select("episode", F.col("name").alias(p), F.col("entity_id").alias({"head": "source_id", "tail": "target_id"}[p]))
    rows = relations.join(side("head"), ["episode", "head"], "left").join(side("tail"), ["episode", "tail"], "left")
    fact = F.coalesce("fact", F.concat_ws(" ", "head", "relation", "tail"))
    return rows.select(F.col("episode").alias("episode_id"), "source_id", "target_id", "relation", fact.alias("fact"), "confidence")


def ingest_answers(store: GraphStore, episodes: DataFrame, complete: Callable[[DataFrame], DataFrame], log: str | None = None, least: float = 0.85) -> Counts:
    """Add episodes with what a language model says about them: entities, relations, facts that ended, suggestions.

    ``complete`` adds a column ``raw`` to episodes (id, content): the model's answer in the envelope. Relations name
    entities by the envelope's ids; one that names no entity is counted as unresolved. Suggestions go to ``log``.
    """
    answers = write_out(complete(episodes).select("id", envelope.parse(F.col("raw")).alias("e")))
    entities = answers.select(F.col("id").alias("episode"), F.posexplode("e.entities").alias("position", "x"))
    mentions = entities.where("x.name is not null").select("episode", F.col("x.name").alias("name"), F.coalesce("x.type", F.lit("Unknown")).alias("entity_type"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), "position")
    relations = envelope.named_relations(answers, "id", "e").select(F.col("id").alias("episode"), "head", "relation", "tail", "confidence", F.lit(None).cast("string").alias("fact"))
    hints = answers.select(F.col("id").alias("episode"), F.explode("e.invalidates").alias("hint"))
    counts = ingest(store, episodes, lambda _: (mentions, relations), least, hints)
    n = answers.select(F.sum(F.size("e.suggestions"))).first()[0] or 0
    if log and n:
        envelope.log_suggestions(answers, "id", "e", log)
    return Counts(counts.episodes, counts.entities, counts.edges, counts.unresolved, counts.invalidated, n)


def episode(spark, content: str, source: str | None = None, tags: list[str] | None = None, meta: dict[str, str] | None = None) -> DataFrame:
    """One episode with an id that sorts by time, recorded now."""
    rows = spark.createDataFrame([(content, source, list(tags or []), dict(meta or {}), uuid.uuid4().hex)], "content string, source string, tags array<string>, meta map<string,string>, salt string")
    row = rows.select(new_ids().alias("id"), "content", "source", F.current_timestamp().alias("recorded_at"), metadata(F.col("meta"), F.col("tags")).alias("metadata"))
    return spark.createDataFrame(row.collect(), row.schema)


def numbered(rows: DataFrame, episode_column: str, by: list[str]) -> DataFrame:
    """``rows`` with ``position``: the place of each among its episode's."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(episode_column).orderBy(*by)) - 1)
