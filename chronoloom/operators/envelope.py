"""Answers of a language model in one JSON envelope: read with defaults, ids resolved to names, suggestions logged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import json_object

ENVELOPE = """entities array<struct<id:string,name:string,type:string>>,
 relations array<struct<head:string,relation:string,tail:string,confidence:double>>,
 invalidates array<string>, suggestions array<struct<kind:string,name:string,ids:array<string>,rationale:string>>, confidence double"""
SUGGESTION_LOG = """suggestion struct<kind:string,name:string,ids:array<string>,rationale:string>, episode_idx bigint, domain string, backend string,
 model string, confidence double, logged_at timestamp"""


def parse(raw: Column) -> Column:
    """struct of ENVELOPE; lists default to empty, confidence to 1. An answer without an object is empty too."""
    got = F.from_json(json_object(raw), ENVELOPE)
    filled = [F.coalesce(got[x], F.array()).alias(x) for x in ("entities", "relations", "invalidates", "suggestions")]
    return F.struct(*filled, F.coalesce(got["confidence"], F.lit(1.0)).alias("confidence"))


def named_relations(answers: DataFrame, key: str, envelope: str) -> DataFrame:
    """(key, head, relation, tail, confidence, resolved): ids of the envelope replaced by its names, others kept.

    ``resolved`` is false where an end is still a bare id such as ``e12``. The lookup stays within the row.
    """
    from ..functions.text import garbage_id

    ids = F.map_from_entries(F.transform(F.array_distinct(F.transform(F.filter(F.col(f"{envelope}.entities"), lambda e: e["id"].isNotNull()), lambda e: e["id"])), lambda i: F.struct(i, F.element_at(F.filter(F.col(f"{envelope}.entities"), lambda e: e["id"] == i), 1)["name"])))
    rows = answers.select(key, ids.alias("_ids"), F.col(f"{envelope}.confidence").alias("_c"), F.explode(f"{envelope}.relations").alias("r"))
    end = lambda c: F.coalesce(F.try_element_at("_ids", F.coalesce(c, F.lit(""))), c)
    rows = rows.select(key, end(F.col("r.head")).alias("head"), F.col("r.relation").alias("relation"), end(F.col("r.tail")).alias("tail"), F.coalesce("r.confidence", "_c").alias("confidence"))
    return rows.withColumn("resolved", F.coalesce(~garbage_id(F.col("head")) & ~garbage_id(F.col("tail")), F.lit(False)))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A suggestion log: a JSON array or one object a line, in a file or a folder; all fields may be absent."""
    return spark.read.schema(SUGGESTION_LOG).option("multiLine", True).json(path)


def log_suggestions(answers: DataFrame, key: str, envelope: str, path: str) -> None:
    """Append each suggestion of each answer as a line of JSON; nothing already written is read or rewritten."""
    rows = answers.select(F.col(key).alias("episode_idx"), F.col(f"{envelope}.confidence").alias("confidence"), F.explode(f"{envelope}.suggestions").alias("suggestion"))
    rows.select("suggestion", "episode_idx", "confidence", F.current_timestamp().alias("logged_at")).write.mode("append").json(path)
