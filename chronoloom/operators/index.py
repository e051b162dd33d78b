"""A stored full-text index: postings by term, so that a query reads the files of its own terms and no text.

A posting is (term, id, tf, dl, positions, version), in partitions by a hash of the term and sorted by term inside a
file, so a scan prunes partitions by the query's terms and row groups by their bounds. A changed or deleted row gets a
tombstone; postings of older versions are dead. ``compact`` writes the living ones anew.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from . import search

_POSTING = "term string, id string, tf int, dl int, positions array<int>, version long, part int"
_DOC = "id string, dl int, version long"


@dataclass(frozen=True)
class SearchIndex:
    spark: SparkSession
    folder: str
    parts: int

    @classmethod
    def build(cls, rows: DataFrame, key: str, columns: list[str], folder: str, parts: int = 64) -> SearchIndex:
        """Index of ``rows``; texts of several ``columns`` count as one, parted by a blank."""
        index = cls(rows.sparkSession, folder, parts)
        index._write(rows, key, columns, 0)
        return index

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def _part(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.parts)).cast("int")

    def _write(self, rows: DataFrame, key: str, columns: list[str], version: int) -> None:
        texts = rows.select(F.col(key).cast("string").alias("id"), tokens(F.concat_ws(" ", *columns)).alias("_w"))
        docs = texts.select("id", F.size("_w").alias("dl"), F.lit(version).cast("long").alias("version"))
        docs.write.mode("append").parquet(f"{self.folder}/docs")
        # a row's words are counted where the row lies: one array sort a row, no aggregate over all postings
        placed = F.array_sort(F.transform("_w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["w"] != F.get(s, F.greatest(i - 1, F.lit(0)))["w"]))
        made = texts.where(F.size("_w") > 0).select("id", F.size("_w").alias("dl"), placed.alias("_s")).withColumn("_b", starts(F.col("_s")))
        ends = lambda i: F.coalesce(F.get("_b", i + 1), F.size("_s"))
        runs = F.transform("_b", lambda b, i: F.struct(F.get("_s", b)["w"].alias("term"), (ends(i) - b).alias("tf"), F.transform(F.slice("_s", b + 1, ends(i) - b), lambda x: x["i"]).alias("positions")))
        postings = made.select("id", "dl", F.explode(runs).alias("r")).select("r.term", "id", "r.tf", "dl", "r.positions", F.lit(version).cast("long").alias("version"))
        postings = postings.withColumn("part", self._part(F.col("term")))
        dealt = postings.repartition(self.parts, "part").sortWithinPartitions("part", "term")
        dealt.write.mode("append").partitionBy("part").parquet(f"{self.folder}/postings")

    def _exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _dead(self) -> DataFrame | None:
        return self._read("dead", "id string, below long").groupBy("id").agg(F.max("below").alias("below")) if self._exists("dead") else None

    def _living(self, rows: DataFrame) -> DataFrame:
        dead = self._dead()
        if dead is None:
            return rows
        gone = dead.withColumnRenamed("id", "_id")
        return rows.join(gone, (F.col("id") == F.col("_id")) & (F.col("version") < F.col("below")), "left_anti")

    def _next(self) -> int:
        return (self._read("docs", _DOC).agg(F.max("version")).first()[0] or 0) + 1

    def remove(self, ids: DataFrame) -> None:
        """Rows of ``ids`` (id) are found no more."""
        ids.select(F.col("id").cast("string").alias("id")).distinct().withColumn("below", F.lit(self._next()).cast("long")).write.mode("append").parquet(f"{self.folder}/dead")

    def add(self, rows: DataFrame, key: str, columns: list[str]) -> None:
        """New and changed rows: what was known of their keys is dead, what they say now is indexed."""
        version = self._next()
        rows.select(F.col(key).cast("string").alias("id")).distinct().withColumn("below", F.lit(version).cast("long")).write.mode("append").parquet(f"{self.folder}/dead")
        self._write(rows, key, columns, version)

    def compact(self, folder: str) -> SearchIndex:
        """The living postings in a new folder."""
        out = SearchIndex(self.spark, folder, self.parts)
        self._living(self._read("docs", _DOC)).write.parquet(f"{folder}/docs")
        living = self._living(self._read("postings", _POSTING)).repartition(self.parts, "part").sortWithinPartitions("part", "term")
        living.write.partitionBy("part").parquet(f"{folder}/postings")
        return out

    def postings(self, leaf: search.Node) -> DataFrame:
        """(id, tf, dl) of a term, prefix or phrase."""
        rows = self._read("postings", _POSTING)
        if leaf.kind == "prefix":
            found = self._living(rows.where(F.col("term").startswith(leaf.words[0])))
            return found.groupBy("id").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
        if leaf.kind == "term":
            return self._living(self._of(rows, leaf.words[0])).select("id", "tf", "dl")
        found = None
        for k, word in enumerate(leaf.words):
            starts = self._living(self._of(rows, word)).select("id", "dl", F.transform("positions", lambda p: p - F.lit(k)).alias(f"p{k}"))
            found = starts if found is None else found.join(starts.drop("dl"), "id")
        common = F.col("p0")
        for k in range(1, len(leaf.words)):
            common = F.array_intersect(common, F.col(f"p{k}"))
        return found.select("id", F.size(common).alias("tf"), "dl").where("tf > 0")

    def _of(self, rows: DataFrame, term: str) -> DataFrame:
        part = self.spark.range(1).select(self._part(F.lit(term))).first()[0]
        return rows.where((F.col("part") == part) & (F.col("term") == term))

    def statistics(self) -> tuple[int, float]:
        """Rows, and mean words of a row."""
        row = self._living(self._read("docs", _DOC)).agg(F.count("*"), F.avg("dl")).first()
        return row[0], row[1] or 1.0

    def bm25(self, query: str, limit: int | None = 10) -> DataFrame:
        """``id`` and ``score`` of the rows that match, best first; equal scores by id. As search.bm25, from postings."""
        tree = search.parse(query)
        scored = [*dict.fromkeys(tree.leaves())]
        named = [*scored, *[x for x in search.all_leaves(tree) if x not in scored]]
        rows = None
        for i, leaf in enumerate(named):
            hit = self.postings(leaf).select("id", "dl", F.lit(i).alias("leaf"), "tf")
            rows = hit if rows is None else rows.unionByName(hit)
        frequency = [F.coalesce(F.max(F.when(F.col("leaf") == i, F.col("tf"))), F.lit(0)).alias(f"_f{i}") for i in range(len(named))]
        counted = rows.groupBy("id").agg(F.first("dl").alias("_dl"), *frequency)
        n, average = self.statistics()
        found = counted.agg(*[F.sum((F.col(f"_f{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(scored))]).first()
        score = F.lit(0.0)
        for i in range(len(scored)):
            d = found[f"d{i}"] or 0
            ratio = (n - d + 0.5) / (d + 0.5)
            idf = max(math.log(ratio), 1e-6) if ratio > 0 else 1e-6
            score = score + search.term_score(F.lit(idf), F.col(f"_f{i}"), F.col("_dl"), average)
        hit = counted.where(search.matches(tree, {x: F.col(f"_f{i}") for i, x in enumerate(named)}))
        out = hit.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id")
        return out.limit(limit) if limit else out


def fused(index: SearchIndex, query: str, vectors: DataFrame, asked: list[float] | None, episodes: DataFrame, k: int = 10, source: str | None = None, after: str | None = None) -> DataFrame:
    """(id, score, content, source, recorded_at): full-text and, with a query vector, semantic lists fused by rank.

    A query that does not parse counts as an empty list where there is a vector, and raises where there is none. Rows
    are fetched for the best alone, so an id without an episode costs its place. ``source`` and ``after`` filter before.
    """
    pool = max(k * 10, 200)
    wanted = episodes
    if source is not None:
        wanted = wanted.where(F.col("source") == source)
    if after is not None:
        wanted = wanted.where(F.col("recorded_at") > F.lit(after).cast("timestamp"))
    narrowed = source is not None or after is not None
    keep = lambda rows: rows.join(wanted.select("id"), "id", "left_semi") if narrowed else rows
    lists = []
    try:
        found = index.bm25(query, None if narrowed else (pool if asked else k))
        lists.append(keep(found).orderBy(F.desc("score"), "id").limit(pool if asked else k))
    except search.QueryError:
        if asked is None:
            raise
    if asked is not None:
        lists.append(search.similar(keep(vectors), "id", "embedding", asked, pool))
        best = search.fuse([search.ranked(x, "id") for x in lists], "id", limit=k)
    else:
        best = lists[0]
    return best.join(wanted.select("id", "content", "source", "recorded_at"), "id").orderBy(F.desc("score"), "id")
