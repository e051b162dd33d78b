"""The graph as an object: a store, its index, what reads and what changes them."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import InvalidInput, NotFound
from .operators import graph, index, ingest, resolve, search
from .sources.config import Schema, cached_schema, to_toml
from .sources.store import GraphStore, new_ids

#: Names of environment variables that a process may set: folder of the graph, and whether to do without vectors.
FOLDER_VARIABLE, NO_VECTORS_VARIABLE = "CHRONOLOOM_FOLDER", "CHRONOLOOM_NO_EMBED"
MOST_DEPTH = 5


@dataclass
class Graph:
    """``embed`` gives the vector of a text; ``extract`` mentions and relations of episodes; ``complete`` a model's answers."""

    store: GraphStore
    embed: Callable[[str], list[float]] | None = None
    extract: ingest.Extract | None = None
    complete: Callable[[DataFrame], DataFrame] | None = None
    _index: dict = field(default_factory=dict)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, **hooks) -> Graph:
        return cls(GraphStore.open(spark, folder), **hooks)

    @classmethod
    def init(cls, spark: SparkSession, folder: str, **hooks) -> Graph:
        return cls(GraphStore.init(spark, folder), **hooks)

    @classmethod
    def open_or_create(cls, spark: SparkSession, folder: str, **hooks) -> Graph:
        return cls(GraphStore.open_or_create(spark, folder), **hooks)

    @classmethod
    def in_memory(cls, spark: SparkSession, **hooks) -> Graph:
        return cls(GraphStore.in_memory(spark), **hooks)

    @classmethod
    def from_environment(cls, spark: SparkSession, **hooks) -> Graph:
        if os.environ.get(NO_VECTORS_VARIABLE):
            hooks["embed"] = None
        return cls.open_or_create(spark, os.environ.get(FOLDER_VARIABLE, ".chronoloom"), **hooks)

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    def schema(self) -> Schema:
        return cached_schema(self.store.folder)

    def infer_schema(self, infer: Callable[[list[str]], Schema], least: int = 3, of: int = 5) -> Schema | None:
        """A schema that ``infer`` makes of the last episodes, kept beside the store; none from fewer than ``least``."""
        texts = [r["content"] for r in self.store.episodes(of).select("content").collect()]
        if len(texts) < least:
            return None
        made = infer(texts)
        self.store.write_text("schema.toml", to_toml(made))
        return made

    # writing

    def add_episode(self, content: str, source: str | None = None, tags: list[str] | None = None, meta: dict[str, str] | None = None) -> tuple[str, ingest.Counts]:
        row = ingest.episode(self.spark, content, source, tags, meta)
        key = row.first()["id"]
        vectors = self.spark.createDataFrame([(key, [float(x) for x in self.embed(content)])], "id string, embedding array<float>") if self.embed else None
        return key, self.add_episodes(row, vectors)

    def add_episodes(self, episodes: DataFrame, vectors: DataFrame | None = None) -> ingest.Counts:
        counts = ingest.ingest(self.store, episodes, self.extract, vectors=vectors)
        self._changed(episodes)
        return counts

    def add_answered_episode(self, content: str, source: str | None = None, tags: list[str] | None = None) -> tuple[str, ingest.Counts]:
        """An episode with what ``complete`` says about it; suggestions are logged beside the store."""
        if self.complete is None:
            raise InvalidInput("no model to ask")
        row = ingest.episode(self.spark, content, source, tags)
        counts = ingest.ingest_answers(self.store, row, self.complete, f"{self.store.folder}/schema_suggestions")
        self._changed(row)
        return row.first()["id"], counts

    def add_entity(self, name: str, entity_type: str, summary: str | None = None) -> str:
        row = self.spark.createDataFrame([(name, entity_type, summary)], "name string, entity_type string, summary string").select(new_ids().alias("id"), "*", F.current_timestamp().alias("created_at"))
        row = self.spark.createDataFrame(row.collect(), row.schema)
        self.store.append("entities", row)
        self._index.pop("entities", None)
        return row.first()["id"]

    def add_entity_deduped(self, name: str, entity_type: str, least: float = 0.85) -> tuple[str, bool]:
        """The id that the name resolves to, and whether it was known; a similar name becomes an alias."""
        mention = self.spark.createDataFrame([("", name, entity_type, 0)], "episode string, name string, entity_type string, position int")
        row = ingest.resolved(mention, self.store.table("entities"), self.store.table("aliases"), least).first()
        if row["is_new"]:
            return self.add_entity(name, entity_type), False
        if row["similarity"] is not None:
            self.store.add_aliases(self.spark.createDataFrame([(row["entity_id"], name, row["similarity"])], "canonical_id string, alias_name string, similarity double"))
        return row["entity_id"], True

    def add_edge(self, source_id: str, target_id: str, relation: str, fact: str | None = None, confidence: float = 1.0, valid_from: str | None = None) -> str:
        rows = self.spark.createDataFrame([(source_id, target_id, relation, fact, float(confidence), valid_from)], "source_id string, target_id string, relation string, fact string, confidence double, since string")
        rows = rows.select(new_ids().alias("id"), "source_id", "target_id", "relation", "fact", F.col("since").cast("timestamp").alias("valid_from"), F.current_timestamp().alias("recorded_at"), "confidence")
        rows = self.spark.createDataFrame(rows.collect(), rows.schema)
        self.store.append("edges", rows)
        return rows.first()["id"]

    def invalidate_edge(self, edge: str) -> None:
        now = self.spark.range(1).select(F.current_timestamp()).first()[0]
        self.store.replace("edges", graph.invalidate_one(self.store.table("edges"), edge, now))

    def link(self, episode: str, entity: str, start: int | None = None, end: int | None = None) -> None:
        self.store.link(self.spark.createDataFrame([(episode, entity, start, end)], "episode_id string, entity_id string, span_start int, span_end int"))

    def store_embedding(self, key: str, vector: list[float], of: str = "episodes") -> None:
        self.store.store_embeddings(self.spark.createDataFrame([(key, [float(x) for x in vector])], "id string, embedding array<float>"), of)

    # reading

    def episode(self, key: str) -> DataFrame:
        return self._found("episodes", key)

    def entity(self, key: str) -> DataFrame:
        return self._found("entities", key)

    def _found(self, table: str, key: str) -> DataFrame:
        rows = self.store.get(table, key)
        if not rows.count():
            raise NotFound(f"{table}: {key}")
        return rows

    def index(self, table: str = "episodes") -> index.SearchIndex:
        """The full-text index of a table, built when it is first asked for."""
        columns = {"episodes": ["content", "source", "metadata"], "entities": ["name", "entity_type", "summary"], "edges": ["fact", "relation"]}[table]
        if table not in self._index:
            folder = f"{self.store.folder}/index-{table}-{self.store.table(table).count()}-{os.urandom(4).hex()}"
            self._index[table] = index.SearchIndex.build(self.store.table(table), "id", columns, folder, 16)
        return self._index[table]

    def _changed(self, episodes: DataFrame) -> None:
        """New episodes join the index where it is built; entities and edges are indexed anew when asked for."""
        if "episodes" in self._index:
            self._index["episodes"].add(episodes.select("id", "content", "source", "metadata"), "id", ["content", "source", "metadata"])
        self._index.pop("entities", None)
        self._index.pop("edges", None)

    def search(self, query: str, k: int = 10, source: str | None = None, after: str | None = None) -> DataFrame:
        """Episodes by full text, fused with likeness of vectors where there is ``embed``."""
        asked = [float(x) for x in self.embed(query)] if self.embed else None
        return index.fused(self.index(), query, self.store.embeddings(), asked, self.store.table("episodes"), k, source, after)

    def search_entities(self, query: str, k: int = 10) -> DataFrame:
        return self.index("entities").bm25(query, k).join(self.store.table("entities"), "id").orderBy(F.desc("score"), "id")

    def precedents(self, context: str, k: int = 5) -> DataFrame:
        if self.embed is None:
            raise InvalidInput("no vectors without embed")
        near = search.similar(self.store.embeddings(), "id", "embedding", [float(x) for x in self.embed(context)], k)
        return near.withColumnRenamed("score", "similarity").join(self.store.table("episodes").select("id", "content", "source", "recorded_at"), "id").orderBy(F.desc("similarity"), "id")

    def context(self, entity: str) -> tuple[DataFrame, DataFrame]:
        """The entity, and its current edges with the entity at the other end."""
        return self.entity(entity), graph.context(self.store.table("edges"), self.store.table("entities"), entity)

    def traverse(self, names: list[str], depth: int = 2, skip_unknown: bool = False) -> tuple[DataFrame, DataFrame]:
        return graph.traverse(self.store.table("edges"), self.store.table("entities"), names, min(depth, MOST_DEPTH), skip_unknown)

    def export(self, limit: int = 10_000, entity_type: str | None = None, episodes: bool = False) -> dict[str, DataFrame]:
        """The newest entities, the edges that touch them, each once, and the newest episodes if asked for."""
        order = [F.desc("created_at"), "id"]
        out = {"entities": self.store.entities(limit, entity_type), "edges": graph.export(self.store.table("edges"), self.store.table("entities"), limit, entity_type, order)}
        return out | ({"episodes": self.store.episodes(limit)} if episodes else {})

    def similar_names(self, name: str, entity_type: str, least: float = 0.85) -> DataFrame:
        one = self.spark.createDataFrame([(name, entity_type)], "name string, entity_type string")
        return resolve.similar_pairs(one, self.store.table("entities").select("name", "entity_type"), least)
