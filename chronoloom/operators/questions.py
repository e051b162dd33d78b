"""Questions in plain words: link an entity, match a relation, answer from its edges, or fall back to search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngrams, sanitize, strip_interrogatives
from . import graph, search

#: Words that name nothing.
STOP_WORDS = (
    "what", "who", "where", "when", "why", "how", "the", "a", "an", "is", "are", "was", "were", "be", "do", "does", "did",
    "of", "to", "in", "on", "at", "by", "for", "with", "and", "or", "i", "you", "he", "she", "we", "they", "it",
)
#: Parts of a question that one hop cannot answer.
COMPLEX_MARKERS = (
    "this week", "last week", "this month", "last month", "today", "yesterday", "before", "after", "since", "until", "and ",
    " or ", "compared to", "vs ", "between", "first", "earliest", "latest", "most", "all the", "every",
)
LONGEST_SPAN = 5


def is_complex(question: Column) -> Column:
    """A marker occurs, or two commas."""
    lower = F.lower(question)
    marked = F.lit(False)
    for marker in COMPLEX_MARKERS:
        marked = marked | F.contains(lower, F.lit(marker))
    return marked | (F.length(F.regexp_replace(lower, "[^,]", "")) >= 2)


def only_stop_words(span: Column) -> Column:
    return F.forall(F.split(F.lower(F.trim(span)), r"\s+"), lambda w: w.isin(*STOP_WORDS) | (w == ""))


def _words(text: Column) -> Column:
    """Non-blank words of a text that has lost the marks at its end."""
    return F.filter(F.split(F.regexp_replace(F.trim(text), r"\?*\.*$", ""), r"\s+"), lambda w: w != "")


def _best_by_run(entities: DataFrame) -> DataFrame:
    """One entity for every run of words of any name: the exact name first, then the shortest, then the least id.

    The choice is an aggregate with partial sums, so a word that every name holds reaches the join as one row.
    """
    words = F.filter(F.split(F.lower(sanitize(F.col("name"))), " "), lambda w: w != "")
    runs = entities.select("id", "name", F.size(words).alias("_n"), F.explode(F.array_distinct(ngrams(words, LONGEST_SPAN))).alias("run"))
    rank = F.struct((F.size(F.split("run", " ")) != F.col("_n")).alias("partial"), F.col("_n").alias("n"), "id", "name")
    return runs.groupBy("run").agg(F.min(rank).alias("best")).select("run", F.col("best.id").alias("entity_id"), F.col("best.name").alias("entity"))


def link(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """questions (qid, question) with ``entity_id``, ``entity`` and ``verb``.

    The longest run of up to five words that is a run of words of an entity's name wins, then the leftmost. The verb is
    what remains, leading question words dropped. A question that links to nothing keeps nulls and its whole text.
    """
    words = questions.select("qid", _words(F.col("question")).alias("_w"))
    starts = lambda n: F.when(F.size("_w") >= n, F.transform(F.sequence(F.lit(1), F.size("_w") - (n - 1)), lambda i: F.struct(F.lit(n).alias("n"), i.alias("at")))).otherwise(F.array().cast("array<struct<n:int,at:int>>"))
    spans = words.select("qid", "_w", F.explode(F.flatten(F.array(*[starts(n) for n in range(1, LONGEST_SPAN + 1)]))).alias("s"))
    spans = spans.withColumn("span", F.array_join(F.slice("_w", F.col("s.at"), F.col("s.n")), " ")).where(~only_stop_words(F.col("span")))
    spans = spans.select("qid", "s", F.lower(sanitize(F.col("span"))).alias("run")).where("run <> ''")
    found = spans.join(_best_by_run(entities), "run")
    chosen = found.groupBy("qid").agg(F.min(F.struct((-F.col("s.n")).alias("n"), F.col("s.at").alias("at"), "entity_id", "entity")).alias("_b"))
    joined = questions.join(chosen, "qid", "left").withColumn("_w", _words(F.col("question")))
    rest = F.filter(F.col("_w"), lambda w, i: F.col("_b").isNull() | (i + 1 < F.col("_b.at")) | (i + 1 >= F.col("_b.at") - F.col("_b.n")))
    verb = strip_interrogatives(F.array_join(rest, " "))
    return joined.select(*questions.columns, F.col("_b.entity_id").alias("entity_id"), F.col("_b.entity").alias("entity"), verb.alias("verb"))


def match_relation(vector: Column, relations: dict[str, list[float]]) -> Column:
    """struct(relation, score, runner_up, runner_up_score): the relations nearest to a vector by cosine.

    ``relations`` is a vocabulary, tens of names with their vectors, and stands in the plan as a literal.
    """
    scored = F.array(*[F.struct((-F.round(search.cosine(vector, F.array(*[F.lit(float(x)) for x in v])), 6)).alias("s"), F.lit(name).alias("r")) for name, v in sorted(relations.items())])
    first = F.transform(F.array(F.array_sort(scored)), lambda a: F.struct(F.get(a, F.lit(0))["r"].alias("relation"), (-F.get(a, F.lit(0))["s"]).alias("score"), F.get(a, F.lit(1))["r"].alias("runner_up"), (-F.get(a, F.lit(1))["s"]).alias("runner_up_score")))
    return F.element_at(first, 1)


def answers(linked: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(qid, relation, direction, neighbor_id, neighbor) over the current edges of each linked entity.

    linked (qid, entity_id, relation): a null relation takes every edge. A self-loop answers once.
    """
    now = graph.current(edges).select("source_id", "target_id", "relation")
    ends = now.select(F.col("source_id").alias("entity_id"), F.col("relation").alias("_r"), F.lit("out").alias("direction"), F.col("target_id").alias("neighbor_id"))
    ends = ends.unionByName(now.where("source_id <> target_id").select(F.col("target_id").alias("entity_id"), F.col("relation").alias("_r"), F.lit("in").alias("direction"), F.col("source_id").alias("neighbor_id")))
    hops = linked.select("qid", "entity_id", "relation").join(ends, "entity_id").where(F.col("relation").isNull() | (F.col("relation") == F.col("_r")))
    names = entities.select(F.col("id").alias("neighbor_id"), F.col("name").alias("neighbor"), F.col("entity_type").alias("neighbor_type"))
    return hops.join(names, "neighbor_id").select("qid", F.col("_r").alias("relation"), "direction", "neighbor_id", "neighbor", "neighbor_type")


def dispatch(op: dict, edges: DataFrame, entities: DataFrame, limit: int = 20) -> DataFrame:
    """(label, id, name, entity_type) of a parsed operation: lookup or traverse from ``head``, else a list by type.

    ``op``: op, head, relation, filters.entity_type. filter and compare list by type. An unknown op raises ValueError.
    """
    spark, kind = entities.sparkSession, (op.get("filters") or {}).get("entity_type")
    if op["op"] in ("lookup", "traverse"):
        question = spark.createDataFrame([(0, op.get("head") or "")], "qid int, question string")
        linked = link(question, entities).where("entity_id is not null").withColumn("relation", F.lit(op.get("relation")).cast("string"))
        rows = answers(linked, edges, entities)
        rows = rows.where(F.col("neighbor_type") == kind) if kind else rows
        return rows.select(F.concat(F.lit("-["), "relation", F.lit("]->")).alias("label"), F.col("neighbor_id").alias("id"), F.col("neighbor").alias("name"), F.col("neighbor_type").alias("entity_type"))
    if op["op"] not in ("list", "filter", "compare"):
        raise ValueError(f"unknown operation {op['op']!r}")
    rows = entities.where(F.col("entity_type") == kind) if kind else entities
    return rows.orderBy(F.desc("created_at"), "id").limit(limit).select(F.concat(F.lit("["), "entity_type", F.lit("]")).alias("label"), "id", "name", "entity_type")


def fallback(question: str, entities: DataFrame, episodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ten entities and five episodes that match the words of a question; a question without words finds nothing."""
    query = entities.sparkSession.range(1).select(sanitize(F.lit(question))).first()[0]
    quoted = " ".join(f'"{w}"' for w in query.split())
    if not quoted:
        none = entities.select("id", F.lit(0.0).alias("score")).limit(0)
        return none, none
    return search.bm25(entities, "id", ["name", "entity_type", "summary"], quoted, 10), search.bm25(episodes, "id", ["content", "source", "metadata"], quoted, 5)
