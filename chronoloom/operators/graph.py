"""Bi-temporal edges, traversal, induced subgraphs and context."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import NotFound
from ..plans.stored import write_out

MOST_HOPS = 5


def is_current() -> Column:
    return F.col("valid_until").isNull()


def valid_at(moment: Column) -> Column:
    """Half open: from ``valid_from``, before ``valid_until``; a null bound is open."""
    return F.coalesce(F.col("valid_from") <= moment, F.lit(True)) & F.coalesce(F.col("valid_until") > moment, F.lit(True))


def current(edges: DataFrame) -> DataFrame:
    return edges.where(is_current())


def as_of(edges: DataFrame, moment: datetime | str) -> DataFrame:
    return edges.where(valid_at(F.lit(moment).cast("timestamp")))


def as_of_join(events: DataFrame, edges: DataFrame, key: str, moment: str, edge_key: str = "source_id") -> DataFrame:
    """Each event with the edges of its key that are valid at its moment: an equi-join, then the interval."""
    return events.join(edges, F.col(key) == F.col(edge_key)).where(valid_at(F.col(moment)))


def of_entity(edges: DataFrame, entity: str, only_current: bool = False) -> DataFrame:
    out = edges.where((F.col("source_id") == entity) | (F.col("target_id") == entity))
    return current(out) if only_current else out


def invalidate(edges: DataFrame, ids: DataFrame, moment: datetime | str) -> DataFrame:
    """All edges, those named in ``ids`` (id) that are current now ending at ``moment``; repeated ids count once."""
    named = ids.select(F.col("id").alias("_id")).distinct().withColumn("_hit", F.lit(True))
    joined = edges.join(named, edges["id"] == named["_id"], "left")
    ends = F.when(F.col("_hit") & is_current(), F.lit(moment).cast("timestamp")).otherwise(F.col("valid_until"))
    return joined.withColumn("valid_until", ends).drop("_id", "_hit")


def hint_matches(hints: DataFrame, candidates: DataFrame, least: float = 0.5) -> DataFrame:
    """For each hint (episode, hint) the edge (episode, id, fact) of that episode that shares most of its words."""
    words = F.filter(F.split(F.lower("hint"), r"\W+"), lambda w: F.length(w) > 2)
    share = F.size(F.filter(words, lambda w: F.contains(F.lower("fact"), w))) / F.greatest(F.size(words), F.lit(1))
    scored = hints.join(candidates, "episode").withColumn("overlap", F.round(share, 6)).where(F.col("overlap") >= least)
    best = Window.partitionBy("episode", "hint").orderBy(F.desc("overlap"), "id")
    return scored.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def _step(edges: DataFrame, level: DataFrame) -> DataFrame:
    """(id): the neighbours of ``level`` (id) in either direction. The level meets the edges before anything is made distinct."""
    known = level.select(F.col("id").alias("_at"))
    out = edges.join(known, F.col("source_id") == F.col("_at"), "left_semi").select(F.col("target_id").alias("id"))
    back = edges.join(known, F.col("target_id") == F.col("_at"), "left_semi").select(F.col("source_id").alias("id"))
    return out.union(back).distinct()


def walk_levels(edges: DataFrame, seeds: DataFrame, depth: int = 2, only_current: bool = True) -> DataFrame:
    """(id, depth): every node at every depth at which a walk reaches it. Seeds (id) are at depth 0.

    A level is written out, so a hop reads the edges once and never repeats the hops before it.
    """
    near = (current(edges) if only_current else edges).select("source_id", "target_id")
    level = write_out(seeds.select("id").distinct())
    out = level.withColumn("depth", F.lit(0))
    for hop in range(1, min(depth, MOST_HOPS) + 1):
        level = write_out(_step(near, level))
        out = out.unionByName(level.withColumn("depth", F.lit(hop)))
    return out


def reach(edges: DataFrame, seeds: DataFrame, depth: int = 2, only_current: bool = True) -> DataFrame:
    """(id, depth): the least depth of every node within ``depth`` hops. Only new nodes go on."""
    near = (current(edges) if only_current else edges).select("source_id", "target_id")
    seen = write_out(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for hop in range(1, min(depth, MOST_HOPS) + 1):
        frontier = write_out(_step(near, frontier).join(seen, "id", "left_anti").withColumn("depth", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen


def traverse(edges: DataFrame, entities: DataFrame, names: list[str], depth: int = 2, skip_unknown: bool = False) -> tuple[DataFrame, DataFrame]:
    """Entities (with ``depth``, nearest first) within ``depth`` current hops of the named ones, and the edges among them.

    A name that several entities bear is that of the oldest. A name that nobody bears raises NotFound, or is skipped in
    a batch. An empty list of names gives nothing.
    """
    wanted = entities.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
    oldest = entities.join(F.broadcast(wanted), "name", "left_semi").groupBy("name").agg(F.min_by("id", F.struct("created_at", "id")).alias("id"))
    found = write_out(oldest)
    if not skip_unknown and found.count() < len(set(names)):
        raise NotFound(", ".join(sorted(set(names) - {r["name"] for r in found.collect()})))
    near = current(edges)
    nodes = reach(near, found, depth)
    return entities.join(nodes, "id").orderBy("depth", "id"), induced(near, nodes)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes`` (id)."""
    ids = nodes.select(F.col("id").alias("_n")).distinct()
    half = edges.join(ids, F.col("source_id") == F.col("_n"), "left_semi")
    return half.join(ids.select(F.col("_n").alias("_m")), F.col("target_id") == F.col("_m"), "left_semi")


def context(edges: DataFrame, entities: DataFrame, entity: str) -> DataFrame:
    """The current edges of an entity with the name at the other end, one row an edge."""
    other = F.when(F.col("source_id") == entity, F.col("target_id")).otherwise(F.col("source_id"))
    mine = of_entity(edges, entity, True).withColumn("neighbor_id", other)
    return mine.join(entities.select(F.col("id").alias("neighbor_id"), F.col("name").alias("neighbor")), "neighbor_id")


def invalidate_one(edges: DataFrame, edge: str, moment: datetime | str) -> DataFrame:
    """All edges, that one ending at ``moment``; NotFound if there is no such edge, or it has ended already."""
    if not current(edges).where(F.col("id") == edge).limit(1).count():
        raise NotFound(edge)
    return invalidate(edges, edges.sparkSession.createDataFrame([(edge,)], "id string"), moment)


def candidate_edges(edges: DataFrame, entities: DataFrame, touched: DataFrame) -> DataFrame:
    """(episode, id, fact): current edges that touch an entity of an episode (episode, entity_id), each once an episode.

    ``fact`` is what a hint is compared with: both names, the relation and the edge's own fact.
    """
    near = current(edges).select("id", "source_id", "target_id", "relation", "fact")
    of = touched.select("episode", "entity_id").distinct()
    met = near.join(of, F.col("source_id") == F.col("entity_id")).unionByName(near.join(of, F.col("target_id") == F.col("entity_id"))).drop("entity_id").dropDuplicates(["episode", "id"])
    name = lambda p: entities.select(F.col("id").alias(f"{p}_id"), F.col("name").alias(f"{p}_name"))
    named = met.join(name("source"), "source_id", "left").join(name("target"), "target_id", "left")
    return named.select("episode", "id", F.concat_ws(" ", "source_name", "relation", "target_name", "fact").alias("fact"))


def invalidate_by_hints(edges: DataFrame, entities: DataFrame, touched: DataFrame, hints: DataFrame, moment: datetime | str) -> tuple[DataFrame, DataFrame]:
    """All edges with those that hints (episode, hint) point to ended, and the distinct ids that were ended."""
    chosen = hint_matches(hints, candidate_edges(edges, entities, touched)).select("id").distinct()
    return invalidate(edges, chosen, moment), chosen


def export(edges: DataFrame, entities: DataFrame, limit: int, entity_type: str | None = None, order: list | None = None) -> DataFrame:
    """Edges that touch the first ``limit`` entities, by id or as ``order`` says, each once."""
    rows = entities if entity_type is None else entities.where(F.col("entity_type") == entity_type)
    some = rows.orderBy(*(order or ["id"])).limit(limit).select(F.col("id").alias("_n"))
    touching = edges.join(some, (F.col("source_id") == F.col("_n")), "left_semi").unionByName(edges.join(some, F.col("target_id") == F.col("_n"), "left_semi"))
    return touching.dropDuplicates(["id"])
