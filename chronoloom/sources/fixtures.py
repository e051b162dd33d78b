"""Labelled episodes, token records and logs of other systems as rows; results as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABELLED = """text string, source string, domain string, kind string,
 expected_entities array<struct<name:string,entity_type:string,type:string,span_start:int,span_end:int>>,
 expected_relations array<struct<head:string,relation:string,tail:string>>"""
TOKENS = "tokens array<string>, entities array<struct<type:string,start:int,end:int>>, relations array<struct<type:string,head:int,tail:int>>"
#: What the short types of the token records stand for.
TOKEN_TYPES = {"Peop": "Person", "Org": "Organization", "Loc": "Location", "Other": "Other"}


def labelled_episodes(spark: SparkSession, path: str) -> DataFrame:
    """(text, domain, entities, relations) of JSON arrays or lines, each with a number by file and place in it.

    A type may stand under ``type`` or ``entity_type``; a missing domain is the source, then ``tech``; missing lists are empty.
    """
    raw = spark.read.schema(LABELLED).option("multiLine", True).json(path)
    entities = F.transform(F.coalesce("expected_entities", F.array()), lambda e: F.struct(e["name"].alias("name"), F.coalesce(e["entity_type"], e["type"]).alias("entity_type"), e["span_start"].alias("start"), e["span_end"].alias("end")))
    return raw.select("text", F.coalesce("domain", "source", F.lit("tech")).alias("domain"), entities.alias("entities"), F.coalesce("expected_relations", F.array()).alias("relations"))


def span_errors(episodes: DataFrame) -> DataFrame:
    """(text, name) of entities whose span does not hold their name."""
    rows = episodes.select("text", F.explode("entities").alias("e")).where("e.start is not null")
    return rows.where(F.substring(F.col("text"), F.col("e.start") + 1, F.col("e.end") - F.col("e.start")) != F.col("e.name")).select("text", F.col("e.name").alias("name"))


def token_episodes(records: DataFrame, domain: str = "conll04") -> DataFrame:
    """Episodes of token records (tokens, entities, relations): text is the tokens joined by blanks; records without a relation go."""
    said = lambda e: F.array_join(F.slice("tokens", e["start"] + 1, e["end"] - e["start"]), " ")
    kind = lambda t: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in TOKEN_TYPES.items() for x in (k, v)]), t), t)
    named = F.transform("entities", lambda e: F.struct(said(e).alias("name"), kind(e["type"]).alias("entity_type")))
    rows = records.where(F.size(F.coalesce("relations", F.array())) > 0).select("tokens", named.alias("_e"), F.col("relations").alias("_r"))
    relations = F.transform("_r", lambda r: F.struct(F.get("_e", r["head"])["name"].alias("head"), r["type"].alias("relation"), F.get("_e", r["tail"])["name"].alias("tail")))
    return rows.select(F.lit(domain).alias("domain"), F.array_join("tokens", " ").alias("text"), F.col("_e").alias("entities"), relations.alias("relations"))


def read_token_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOKENS).option("multiLine", True).json(path)


def log_episodes(log: DataFrame, text: str = "value") -> DataFrame:
    """(episode, entities, relations) of whole run logs: sections ``── Episode n/m ──`` with lists of names and of triples."""
    parts = F.transform(F.filter(F.split(F.col(text), "── Episode "), lambda x: x.rlike(r"^\d+/\d+ ──")), lambda x: F.struct(F.regexp_extract(x, r"^(\d+)/", 1).cast("int").alias("episode"), x.alias("body")))
    rows = log.select(F.explode(parts).alias("p")).select("p.*")
    listed = lambda what: F.regexp_extract("body", rf"{what} extracted: \[(.*?)\]", 1)
    names = F.transform(F.split(listed("Entities"), "', '"), lambda x: F.regexp_replace(F.trim(x), "^['\"]+|['\"]+$", ""))
    triples = F.regexp_extract_all(listed("Relations"), F.lit(r"\('[^']+', '[^']+', '[^']+'\)"), F.lit(0))

    def triple(t: Column) -> Column:
        part = lambda k: F.regexp_extract(t, r"\('([^']+)', '([^']+)', '([^']+)'\)", k)
        return F.struct(part(1).alias("head"), part(2).alias("relation"), part(3).alias("tail"))

    said = F.when(listed("Entities") != "", names).otherwise(F.array().cast("array<string>"))
    return rows.select("episode", said.alias("entities"), F.transform(triples, triple).alias("relations"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Whole run logs, one row a file."""
    return spark.read.text(path, wholetext=True)


def write_json(df: DataFrame, path: str, files: int = 1) -> None:
    """Results as JSON lines in ``files`` files, replacing what is there: summaries and training sets, whose size is known."""
    df.coalesce(files).write.mode("overwrite").json(path)
