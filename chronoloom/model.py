"""The graph's tables, and adapters that read a star schema as a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.stored import kept

EPISODES = "id string, content string, source string, recorded_at timestamp, metadata string"
ENTITIES = "id string, name string, entity_type string, summary string, created_at timestamp, metadata string"
EDGES = "id string, source_id string, target_id string, relation string, fact string, valid_from timestamp, valid_until timestamp, recorded_at timestamp, confidence double, episode_id string, metadata string"
MENTIONS = "episode_id string, entity_id string, span_start int, span_end int"
ALIASES = "canonical_id string, alias_name string, similarity double"
EMBEDDINGS = "id string, embedding array<float>"
TABLES = {"episodes": EPISODES, "entities": ENTITIES, "edges": EDGES, "mentions": MENTIONS, "aliases": ALIASES, "embeddings": EMBEDDINGS}


class GraphError(Exception):
    """What goes wrong with a graph."""


class NotFound(GraphError, LookupError):
    """No store, or no such row."""


class AlreadyExists(GraphError, FileExistsError):
    """A store is there already."""


class InvalidInput(GraphError, ValueError):
    """An argument that says nothing that can be done."""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("doc_id") * 60)
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), "source", at.alias("recorded_at"), F.to_json(F.struct("lang", "n_chars")).alias("metadata"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("region", "r", "Region"), ("nation", "n", "Nation"), ("customer", "c", "Customer"), ("supplier", "s", "Supplier"), ("part", "p", "Part")]
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey"}
    frames = [read(spark, sf_dir, t).select(_key(f"{p}:", keys[t]).alias("id"), F.col(f"{p}_name").alias("name"), F.lit(kind).alias("entity_type")) for t, p, kind in parts]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part_of, located_at, supplies and ordered, with validity in event time."""
    nation, customer, supplier = (read(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    line, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    none = F.lit(None).cast("timestamp")

    def made(df: DataFrame, source: Column, relation: str, target: Column, start: Column = none, end: Column = none) -> DataFrame:
        return df.select(source.alias("source_id"), F.lit(relation).alias("relation"), target.alias("target_id"), start.cast("timestamp").alias("valid_from"), end.cast("timestamp").alias("valid_until"))

    supplied = line.groupBy("l_suppkey", "l_partkey").agg(F.min("l_shipdate").alias("t"))
    bought = line.select("l_orderkey", "l_partkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    bought = bought.groupBy("o_custkey", "l_partkey").agg(F.min("o_orderdate").alias("t"), F.max("o_orderdate").alias("u"), F.bool_and(F.col("o_orderstatus") == "F").alias("closed"))
    out = made(nation, _key("n:", "n_nationkey"), "part_of", _key("r:", "n_regionkey"))
    out = out.unionByName(made(customer, _key("c:", "c_custkey"), "located_at", _key("n:", "c_nationkey")))
    out = out.unionByName(made(supplier, _key("s:", "s_suppkey"), "located_at", _key("n:", "s_nationkey")))
    out = out.unionByName(made(supplied, _key("s:", "l_suppkey"), "supplies", _key("p:", "l_partkey"), F.col("t")))
    out = out.unionByName(made(bought, _key("c:", "o_custkey"), "ordered", _key("p:", "l_partkey"), F.col("t"), F.when(F.col("closed"), F.col("u"))))
    return out.select(F.concat_ws("|", "relation", "source_id", "target_id").alias("id"), "source_id", "target_id", "relation", "valid_from", "valid_until")


def stored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``edges``, derived once an application and kept as a table sorted by source, as a store would hold them."""

    def make(folder: str) -> DataFrame:
        made = edges(spark, sf_dir)
        made.repartitionByRange("source_id").sortWithinPartitions("source_id").write.parquet(folder)
        return spark.read.schema(made.schema).parquet(folder)

    return kept(spark, ("edges", sf_dir), make)


#: The same tables as DuckDB common table expressions.
EPISODES_SQL = "episodes AS (SELECT CAST(doc_id AS VARCHAR) AS id, text AS content, source, TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS INTEGER)) AS recorded_at FROM documents)"
ENTITIES_SQL = """entities AS (SELECT 'r:' || r_regionkey AS id, r_name AS name, 'Region' AS entity_type FROM region UNION ALL SELECT 'n:' || n_nationkey, n_name, 'Nation' FROM nation
 UNION ALL SELECT 'c:' || c_custkey, c_name, 'Customer' FROM customer UNION ALL SELECT 's:' || s_suppkey, s_name, 'Supplier' FROM supplier UNION ALL SELECT 'p:' || p_partkey, p_name, 'Part' FROM part)"""
EDGES_SQL = """raw AS (SELECT 'n:' || n_nationkey AS source_id, 'part_of' AS relation, 'r:' || n_regionkey AS target_id, CAST(NULL AS TIMESTAMP) AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_until FROM nation
 UNION ALL SELECT 'c:' || c_custkey, 'located_at', 'n:' || c_nationkey, NULL, NULL FROM customer UNION ALL SELECT 's:' || s_suppkey, 'located_at', 'n:' || s_nationkey, NULL, NULL FROM supplier
 UNION ALL SELECT 's:' || l_suppkey, 'supplies', 'p:' || l_partkey, min(l_shipdate), NULL FROM lineitem GROUP BY l_suppkey, l_partkey
 UNION ALL SELECT 'c:' || o_custkey, 'ordered', 'p:' || l_partkey, min(o_orderdate), CASE WHEN bool_and(o_orderstatus = 'F') THEN max(o_orderdate) END FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey),
edges AS (SELECT relation || '|' || source_id || '|' || target_id AS id, source_id, target_id, relation, valid_from, valid_until FROM raw)"""
