"""A graph as a folder of Parquet tables.

One writer at a time: tables are appended to, or written anew beside the old files and swapped in; readers see files
that are whole. There are no locks, and no transactions over several tables.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import human_bytes
from ..model import TABLES, AlreadyExists, NotFound
from ..plans.stored import delete, shared_folder

__all__ = ["AlreadyExists", "GraphStore", "NotFound", "new_ids"]

#: Versions of the tables' shapes: what each added. A store of an older one is read with nulls and written in the newest.
VERSIONS = {1: "episodes, entities, edges, mentions and aliases", 2: "embeddings of episodes and entities"}


def new_ids(salt: str = "") -> Column:
    """Ids that sort by time: milliseconds in 12 hexadecimal digits, then randomness."""
    now = F.lower(F.lpad(F.hex(F.unix_millis(F.current_timestamp())), 12, "0"))
    tail = F.regexp_replace(F.uuid(), "-", "")
    return F.concat(F.substring(now, 1, 8), F.lit("-"), F.substring(now, 9, 4), F.lit("-7"), F.substring(tail, 1, 3), F.lit("-8"), F.substring(tail, 4, 3), F.lit("-"), F.substring(tail, 7, 12))


@dataclass(frozen=True)
class GraphStore:
    spark: SparkSession
    folder: str

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _there(self, name: str) -> bool:
        path, system = self._path(name)
        return system.exists(path)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> GraphStore:
        store = cls(spark, folder)
        if not store._there("episodes"):
            raise NotFound(folder)
        store.migrate()
        return store

    @classmethod
    def init(cls, spark: SparkSession, folder: str) -> GraphStore:
        store = cls(spark, folder)
        if store._there("episodes"):
            raise AlreadyExists(folder)
        store.migrate()
        return store

    @classmethod
    def open_or_create(cls, spark: SparkSession, folder: str) -> GraphStore:
        try:
            return cls.open(spark, folder)
        except NotFound:
            return cls.init(spark, folder)

    @classmethod
    def in_memory(cls, spark: SparkSession) -> GraphStore:
        """A store of its own in the application's shared folder; ``drop`` deletes it."""
        return cls.init(spark, f"{shared_folder(spark)}/chronoloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}")

    def drop(self) -> None:
        delete(self.spark, self.folder)

    def version(self) -> int:
        """The newest version that was applied, 0 for none."""
        if not self._there("version"):
            return 0
        return self.spark.read.schema("version int, applied_at timestamp").json(f"{self.folder}/version").agg(F.max("version")).first()[0] or 0

    def migrate(self) -> int:
        """Make what tables are missing and note the versions that are new; applying it again changes nothing."""
        for name, schema in TABLES.items():
            if not self._there(name):
                self.spark.createDataFrame([], schema).write.parquet(f"{self.folder}/{name}")
        have = self.version()
        fresh = [(v,) for v in sorted(VERSIONS) if v > have]
        if fresh:
            self.spark.createDataFrame(fresh, "version int").coalesce(1).withColumn("applied_at", F.current_timestamp()).write.mode("append").json(f"{self.folder}/version")
        return max(VERSIONS)

    def table(self, name: str) -> DataFrame:
        """Rows of a table; a column that an older file lacks is null."""
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        empty = self.spark.createDataFrame([], TABLES[name])
        empty.unionByName(rows, allowMissingColumns=True).select(*empty.columns).write.mode("append").parquet(f"{self.folder}/{name}")

    def replace(self, name: str, rows: DataFrame) -> None:
        """``rows`` in place of the table, which they may be made from: written beside it, then swapped in."""
        fresh = f"{name}.{uuid.uuid4().hex}"
        rows.select(*[F.col(c) for c in self.spark.createDataFrame([], TABLES[name]).columns]).write.parquet(f"{self.folder}/{fresh}")
        (old, system), (new, _) = self._path(name), self._path(fresh)
        system.delete(old, True)
        system.rename(new, old)

    def append_new(self, name: str, rows: DataFrame, keys: list[str], order: list[str]) -> None:
        """Rows whose keys are neither stored nor earlier in ``rows``."""
        first = Window.partitionBy(*keys).orderBy(*order)
        fresh = rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
        self.append(name, fresh.join(self.table(name).select(*keys), keys, "left_anti"))

    def link(self, mentions: DataFrame) -> None:
        """The first span of an entity in an episode wins."""
        self.append_new("mentions", mentions, ["episode_id", "entity_id"], ["span_start", "span_end"])

    def add_aliases(self, aliases: DataFrame) -> None:
        self.append_new("aliases", aliases, ["canonical_id", "alias_name"], ["similarity"])

    def store_embeddings(self, vectors: DataFrame, of: str = "episodes") -> None:
        """Vectors (id, embedding) of known episodes or entities, in place of older ones; unknown ids are passed over."""
        known = vectors.join(self.table(of).select("id"), "id", "left_semi").groupBy("id").agg(F.first("embedding").alias("embedding"))
        kept = self.table("embeddings").join(vectors.select("id"), "id", "left_anti")
        self.replace("embeddings", kept.unionByName(known.select("id", F.col("embedding").cast("array<float>").alias("embedding"))))

    def embeddings(self, of: str = "episodes") -> DataFrame:
        """(id, embedding) of the episodes or entities that have one."""
        return self.table("embeddings").where("embedding is not null").join(self.table(of).select("id"), "id", "left_semi")

    def get(self, name: str, key: str) -> DataFrame:
        return self.table(name).where(F.col("id") == key).limit(1)

    def entity_named(self, name: str, entity_type: str | None = None) -> DataFrame:
        """The oldest entity of that exact name."""
        rows = self.table("entities").where(F.col("name") == name)
        return (rows.where(F.col("entity_type") == entity_type) if entity_type else rows).orderBy("created_at", "id").limit(1)

    def names_of_type(self, entity_type: str) -> DataFrame:
        return self.table("entities").where(F.col("entity_type") == entity_type).select("id", "name")

    def episodes(self, limit: int, offset: int = 0, source: str | None = None, after: str | None = None) -> DataFrame:
        rows = self.table("episodes")
        rows = rows if source is None else rows.where(F.col("source") == source)
        rows = rows if after is None else rows.where(F.col("recorded_at") > F.lit(after).cast("timestamp"))
        return rows.orderBy(F.desc("recorded_at"), "id").offset(offset).limit(limit)

    def entities(self, limit: int, entity_type: str | None = None, offset: int = 0) -> DataFrame:
        rows = self.table("entities")
        rows = rows.where(F.col("entity_type") == entity_type) if entity_type else rows
        return rows.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)

    def stats(self) -> dict[str, int]:
        return {name: self.table(name).count() for name in ("episodes", "entities", "edges")}

    def size(self) -> int:
        """Bytes of all files."""
        path, system = self._path("")
        return system.getContentSummary(path).getLength()

    def readable_size(self) -> str:
        return self.spark.range(1).select(human_bytes(F.lit(self.size()))).first()[0]

    def sources(self) -> DataFrame:
        """Counts by raw source; null and the word unknown stay two rows under one label."""
        return self.table("episodes").groupBy("source").count().select(F.coalesce("source", F.lit("unknown")).alias("source"), "count").orderBy(F.desc("count"), "source")

    def orphans(self) -> DataFrame:
        """(id, end): edges whose source or target is no entity."""
        known = self.table("entities").select(F.col("id").alias("_e"))
        edges = self.table("edges")
        missing = lambda c: edges.join(known, F.col(c) == F.col("_e"), "left_anti").select("id", F.lit(c).alias("end"))
        return missing("source_id").unionByName(missing("target_id"))

    def write_text(self, name: str, text: str) -> None:
        """A small text beside the tables, such as a schema."""
        path, system = self._path(name)
        out = system.create(path, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def as_json(self, df: DataFrame) -> list[dict]:
        """Rows of a result that is bounded by its limit."""
        return [json.loads(r) for r in df.toJSON().collect()]
