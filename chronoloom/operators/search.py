"""Full-text search by BM25, vector search by cosine, and reciprocal-rank fusion."""

from __future__ import annotations

import functools
import itertools
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..plans.stored import write_out

K1, B = 1.2, 0.75


class QueryError(ValueError):
    """A search string that does not parse."""


@dataclass(frozen=True)
class Node:
    kind: str  # term, prefix, phrase, and, or, not
    words: tuple[str, ...] = ()
    parts: tuple[Node, ...] = ()

    def leaves(self) -> list[Node]:
        if self.kind == "not":
            return self.parts[0].leaves()
        return [self] if not self.parts else [x for p in self.parts for x in p.leaves()]


def parse(query: str) -> Node:
    """``a b`` and, ``a OR b``, ``a NOT b``, ``"a b"``, ``a*``, parentheses. NOT binds before AND, AND before OR."""
    items = re.findall(r'"[^"]*"|[()]|[^\s()"]+', query)
    if query.count('"') % 2 or not items:
        raise QueryError("empty or unclosed query")
    at = 0

    def leaf() -> Node:
        nonlocal at
        if at >= len(items):
            raise QueryError("a term is missing")
        item = items[at]
        at += 1
        if item == "(":
            inner = either()
            if at >= len(items) or items[at] != ")":
                raise QueryError("a parenthesis is open")
            at += 1
            return inner
        if item.startswith('"'):
            words = tuple(re.findall(r"[^\W_]+", item.lower()))
            return Node("phrase" if len(words) > 1 else "term", words)
        if item in ("AND", "OR", "NOT", ")"):
            raise QueryError(f"{item} is out of place")
        if not re.fullmatch(r"\w+\*?", item):
            raise QueryError(f"{item} has characters that are not allowed outside quotes")
        return Node("prefix" if item.endswith("*") else "term", (item.rstrip("*").lower(),))

    def negated() -> Node:
        nonlocal at
        left = leaf()
        while at < len(items) and items[at] == "NOT":
            at += 1
            left = Node("not", parts=(left, leaf()))
        return left

    def both() -> Node:
        nonlocal at
        parts = [negated()]
        while at < len(items) and items[at] not in ("OR", ")"):
            at += items[at] == "AND"
            parts.append(negated())
        return parts[0] if len(parts) == 1 else Node("and", parts=tuple(parts))

    def either() -> Node:
        nonlocal at
        parts = [both()]
        while at < len(items) and items[at] == "OR":
            at += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else Node("or", parts=tuple(parts))

    tree = either()
    if at < len(items):
        raise QueryError("a parenthesis is closed twice")
    return tree


def _frequency(words: Column, leaf: Node) -> Column:
    if leaf.kind == "phrase":
        n = len(leaf.words)
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.size(F.filter(starts, lambda i: F.slice(words, i, n) == F.array(*map(F.lit, leaf.words))))
    if leaf.kind == "prefix":
        return F.size(F.filter(words, lambda w: w.startswith(leaf.words[0])))
    return F.size(F.filter(words, lambda w: w == leaf.words[0]))


def matches(tree: Node, frequency: dict[Node, Column]) -> Column:
    if tree.kind == "not":
        return matches(tree.parts[0], frequency) & ~matches(tree.parts[1], frequency)
    if tree.parts:
        found = [matches(p, frequency) for p in tree.parts]
        out = found[0]
        for x in found[1:]:
            out = out & x if tree.kind == "and" else out | x
        return out
    return frequency[tree] > 0


def bm25(df: DataFrame, key: str, columns: list[str], query: str, limit: int | None = 10) -> DataFrame:
    """``key`` and ``score`` of the rows that match, best first; equal scores by key.

    Two passes over the text columns and no shuffle but for the statistics and the top rows: each row's token
    frequencies are counted where it lies, so nothing is stored that grows with the vocabulary.
    """
    tree = parse(query)
    every = [*dict.fromkeys(tree.leaves())]
    negative = [x for x in all_leaves(tree) if x not in every]
    words = tokens(F.concat_ws(" ", *columns))
    named = [*every, *negative]
    # one lambda binds the tokens, so that they are made once a row
    row = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("_dl"), *[_frequency(w, x).alias(f"_f{i}") for i, x in enumerate(named)]))
    counted = df.select(key, F.element_at(row, 1).alias("_s")).select(key, "_s.*")
    stats = counted.agg(F.count("*").alias("n"), F.avg("_dl").alias("avg"), *[F.sum((F.col(f"_f{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(every))]).first()
    n, average = stats["n"], stats["avg"] or 1.0
    score = F.lit(0.0)
    for i in range(len(every)):
        df_i = stats[f"d{i}"] or 0
        ratio = (n - df_i + 0.5) / (df_i + 0.5)
        idf = max(math.log(ratio), 1e-6) if ratio > 0 else 1e-6
        score = score + term_score(F.lit(idf), F.col(f"_f{i}"), F.col("_dl"), average)
    hit = counted.where(matches(tree, {x: F.col(f"_f{i}") for i, x in enumerate(named)}))
    out = hit.select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key)
    return out.limit(limit) if limit else out


def all_leaves(tree: Node) -> list[Node]:
    """Leaves behind NOT too."""
    return [x for p in tree.parts for x in all_leaves(p)] if tree.parts else [tree]


def term_score(idf: Column, tf: Column, dl: Column, average: float) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ, or a vector is empty or has no length."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    d = lambda x: F.transform(x, lambda y: y.cast("double"))
    dot = total(F.zip_with(d(a), d(b), lambda x, y: x * y))
    norm = F.sqrt(total(F.transform(d(a), lambda x: x * x))) * F.sqrt(total(F.transform(d(b), lambda x: x * x)))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot / norm).otherwise(0.0)


def similar(df: DataFrame, key: str, vector: str, query: list[float], k: int = 5) -> DataFrame:
    """The ``k`` rows nearest to ``query`` by cosine: each task keeps its own best ``k``."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    return df.where(F.col(vector).isNotNull()).select(key, F.round(cosine(F.col(vector), asked), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def similar_batch(df: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, block: int = 4096) -> DataFrame:
    """``query``, ``key``, ``score`` and ``rank`` of each query's ``k`` nearest other rows.

    The stated queries pass through the driver in blocks, one block at a time. Each task scores its rows against the
    block as one matrix product and sends on its own best ``k`` a query; what is shuffled does not grow with the rows
    of a task. Vectors of another length, without length or null score 0 or nothing, as cosine has it.
    """
    spark, kind = df.sparkSession, queries.schema[key].dataType.simpleString()
    outs, asked = [], queries.where(F.col(vector).isNotNull()).select(key, vector).toLocalIterator()
    while some := list(itertools.islice(asked, block)):
        held = spark.sparkContext.broadcast([(r[0], [float(x) for x in r[1]]) for r in some])
        near = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("string").alias("id"), vector).mapInArrow(_nearest(held, k), "query string, id string, score double")
        best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        ranks = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        outs.append(write_out(ranks.select(F.col("query").cast(kind).alias("query"), F.col("id").cast(kind).alias(key), "score", "rank")))
        held.unpersist()
    if not outs:
        return queries.limit(0).select(F.col(key).alias("query"), key, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    return functools.reduce(DataFrame.unionByName, outs)


def _nearest(held, k: int):
    def run(batches):
        names = [str(n) for n, _ in held.value]
        sizes = np.array([len(v) for _, v in held.value])
        groups = {}
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            rows = np.array([held.value[i][1] for i in at]).reshape(len(at), size)
            groups[size] = at, rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300) if size else rows
        best: list[list[tuple[float, str]]] = [[] for _ in names]
        for batch in batches:
            ids, column = batch.column(0).to_pylist(), batch.column(1)
            lengths = np.diff(column.offsets.to_numpy())
            values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(lengths)
            for size, (at, asked) in groups.items():
                own = np.flatnonzero(lengths == size)
                if not len(own):
                    continue
                rows = np.stack([values[ends[i] - size : ends[i]] for i in own]) if size else np.zeros((len(own), 0))
                norm = np.linalg.norm(rows, axis=1, keepdims=True)
                score = np.round((rows / np.where(norm > 0, norm, 1.0)) @ asked.T, 6) + 0.0
                for column_of, q in enumerate(at.tolist()):
                    scores = score[:, column_of]
                    # all that may be among the best: ties at the edge are settled by id
                    edge = np.partition(scores, -min(k + 1, len(scores)))[-min(k + 1, len(scores))]
                    found = [(-scores[i], ids[own[i]]) for i in np.flatnonzero(scores >= edge).tolist() if ids[own[i]] != names[q]]
                    best[q] = sorted(best[q] + found)[:k]
        rows = [(names[q], i, -s) for q, those in enumerate(best) for s, i in those]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64()), strict=True)], ["query", "id", "score"])

    return run


def ranked(df: DataFrame, key: str) -> DataFrame:
    """1-based ranks of a result list, which a search has already cut to its pool."""
    return df.select(key, F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("rank"))


def fuse(lists: list[DataFrame], key: str, k: int = 60, limit: int = 10) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists: sum of 1 / (k + rank)."""
    rows = lists[0]
    for more in lists[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy(key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score")).orderBy(F.desc("score"), key).limit(limit)
