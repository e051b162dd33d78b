"""Mixing sources to target weights by Pfair scheduling.

Time is cut into slots of one block each. Block j of a source with weight w may run from slot floor((j - 1) / w) and
must end by slot ceil(j / w); in every slot, of the released blocks the one with the earliest deadline runs. While all
sources last, each source's share then stays within less than one block of w times the slots so far.

Weights are exact rationals, whatever their size, so no weight is rounded and nothing adds up over a long run. Weights
and counts are a table; one task reads it, works out the slots of all blocks in turn, in memory for the sources alone,
and writes them; documents meet their block in a join. When a source has run out its slots stay empty. No document is
dropped or repeated.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction
from math import isqrt, lcm

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, materialize, quoted

#: Documents in a block.
BLOCK_DOCS = 16
#: Documents aimed at in one bucket of the ranking inside a source, or the root of all documents where that is more:
#: then neither a bucket nor the list of a source's buckets is long.
BUCKET_DOCS = 400
_LAST = 2**63 - 1


def exact_parts(weights: Sequence[float]) -> tuple[list[int], int]:
    """Whole numbers in exactly the ratios of ``weights``, and their sum."""
    if any(not w > 0 for w in weights):
        raise ValueError("weights must be above 0")
    exact = [Fraction(w) for w in weights]
    scale = lcm(*(w.denominator for w in exact))
    parts = [w.numerator * (scale // w.denominator) for w in exact]
    return parts, sum(parts)


def schedule(parts: Sequence[int], total: int, blocks: Sequence[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(source's place, block, release, deadline, slot) of the blocks that exist, in order of slots.

    Earliest deadline first. Weight parts[k] / total; a slot for which no block is released stays empty.
    """
    release = lambda k, j: (j * total) // parts[k]
    due = lambda k, j: -(-((j + 1) * total) // parts[k])
    waiting = [(0, k, 0) for k in range(len(parts)) if blocks[k]]
    ready: list[tuple[int, int, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due(k, j), k, j))
        deadline, k, j = heapq.heappop(ready)
        assert slot < deadline, "earliest deadline first missed a deadline"
        yield k, j, release(k, j), deadline, slot
        if j + 1 < blocks[k]:
            heapq.heappush(waiting, (release(k, j + 1), k, j + 1))
        slot += 1


def _plan_rows(block_docs: int):
    def run(batches):
        rows = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        rows.sort(key=lambda r: (r[0] is None, str(r[0])))
        names = [r[0] for r in rows]
        parts, total = exact_parts([r[1] for r in rows]) if rows else ([], 0)
        plan = schedule(parts, total, [-(-r[2] // block_docs) for r in rows])
        while some := list(itertools.islice(plan, 50_000)):
            k, block, release, deadline, slot = zip(*some, strict=True)
            whole = [pa.array([min(x, _LAST) for x in c], pa.int64()) for c in (block, release, deadline, slot)]
            yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in k], pa.string()), *whole], ["p_s", "p_block", "p_release", "p_deadline", "p_slot"])

    return run


def tempered_weights(docs: DataFrame, source: str = "source", power: float = 0.7) -> DataFrame:
    """(source, weight): a source's count of documents to ``power``, which lifts small sources. A null source is one too."""
    counts = docs.groupBy(F.col(source).cast("string").alias("source")).agg(F.count("*").cast("double").alias("n"))
    return counts.select("source", F.pow("n", F.lit(power)).alias("weight"))


def mix(docs: DataFrame, weights: DataFrame | Mapping[str | None, float], key: str = "doc_id", source: str = "source", block_docs: int = BLOCK_DOCS, seed: int = 7, out: str = "mix") -> DataFrame:
    """``docs`` with a struct ``out`` of block, release, deadline, slot and position; sorting by position is the mix.

    ``weights`` is a table (source, weight) or a mapping, in any unit, above 0. Inside a source documents are shuffled
    by a hash of the key. A null source is a source of its own; a source without a weight raises ValueError; one with
    a weight and no document leaves its slots empty. Rows that repeat a key each get a place of their own. A column of
    ``docs`` with the name ``out`` is replaced; an empty table gives an empty one. Deadlines and slots count from 0.

    The rank inside a source is the rank inside a hash bucket plus the size of the buckets before it, so a source with
    a third of all rows is ranked by as many tasks as its rows need.
    """
    spark = docs.sparkSession
    if not isinstance(weights, DataFrame):
        weights = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "source string, weight double")
    columns = [c for c in docs.columns if c != out]
    hashed = F.xxhash64(F.lit(seed), quoted(key))
    keyed = docs.select(F.struct(*map(quoted, columns)).alias("row"), quoted(source).cast("string").alias("s"), hashed.alias("h"), quoted(key).alias("k"))
    counts = keyed.groupBy("s").agg(F.count("*").alias("n"))
    given = weights.select(F.col("source").alias("w_s"), "weight")
    asked = given.join(counts, F.col("w_s").eqNullSafe(F.col("s")), "full")
    asked = materialize(asked.select(F.coalesce("w_s", "s").alias("s"), "weight", F.coalesce("n", F.lit(0)).alias("n")))
    if asked.where("weight is null or isnan(weight) or not weight > 0").limit(1).count():
        raise ValueError("every source needs a weight above 0")
    plan = materialize(asked.repartition(1).mapInArrow(_plan_rows(block_docs), "p_s string, p_block long, p_release long, p_deadline long, p_slot long"))
    total = asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    discard(asked)
    n_buckets = max(1, -(-total // max(BUCKET_DOCS, isqrt(total))))
    # high bits choose the bucket, so buckets are ranges of the hash
    keyed = keyed.withColumn("bucket", F.floor(F.shiftrightunsigned("h", 32) * F.lit(n_buckets) / F.lit(2.0**32)).cast("long"))
    sizes = keyed.groupBy("s", "bucket").agg(F.count("*").alias("size"))
    ahead = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("s").alias("s2"), F.col("bucket").alias("bucket2"), F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("start"))
    inside = Window.partitionBy("s", "bucket").orderBy(F.shiftrightunsigned("h", 1), F.col("h") >= 0, "k", *_ties(docs, columns))
    ranked = keyed.withColumn("r", F.row_number().over(inside) - 1)
    ranked = ranked.join(starts, ranked["s"].eqNullSafe(starts["s2"]) & (ranked["bucket"] == starts["bucket2"]))
    rank = F.col("start") + F.col("r")
    placed = ranked.select("row", "s", F.floor(rank / block_docs).alias("block"), (rank % block_docs).alias("offset"))
    placed = placed.join(plan.hint("merge"), placed["s"].eqNullSafe(plan["p_s"]) & (placed["block"] == plan["p_block"]))
    slot = F.col("p_slot")
    made = F.struct(F.col("block"), F.col("p_release").alias("release"), F.col("p_deadline").alias("deadline"), slot.alias("slot"), (slot * block_docs + F.col("offset")).alias("position"))
    return placed.select("row.*", made.alias(out))


def _ties(docs: DataFrame, columns: Sequence[str]) -> list[Column]:
    """A hash of what a row holds besides its key, so that a task that runs again ranks rows as before."""
    plain = [c for c in columns if not any(t in docs.schema[c].dataType.simpleString() for t in ("map<", "variant"))]
    return [F.xxhash64(*[F.col(f"row.`{c}`") for c in plain])] if plain else []


def mixing_report(docs: DataFrame) -> DataFrame:
    """doc_id, source, block, release, deadline, slot and position of every row; other columns are not read."""
    slim = docs.select("doc_id", "source")
    return mix(slim, tempered_weights(slim)).select("doc_id", "source", "mix.*")


def _in_files(docs: DataFrame) -> DataFrame:
    """``docs`` if its rows have a place in a file, else ``docs`` written."""
    try:
        docs.metadataColumn("_metadata")
        docs.select(docs.metadataColumn("_metadata").getField("row_index")).schema  # noqa: B018
        return docs
    except AnalysisException:
        return materialize(docs)


def in_mixed_order(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, to be written in the order of the mix: by file, and inside a file by row.

    Rows are told apart by their place in the files they come from, so equal rows, repeated and null doc_ids and null
    texts are rows like any other. Texts are shuffled twice: to their position, then by range of it. Other columns,
    whatever their names, pass unchanged; an empty table gives an empty one. ``file_positions`` reads the order back.
    """
    columns = docs.columns
    filed = _in_files(docs)
    place = filed.metadataColumn("_metadata")
    at = [F.xxhash64(place.getField("file_path")).alias("_f"), place.getField("row_index").alias("_i")]
    slim = filed.select(*at, quoted("doc_id").alias("doc_id"), quoted("source").alias("source"))
    places = materialize(mix(slim, tempered_weights(slim)).select(F.col("_f").alias("m_f"), F.col("_i").alias("m_i"), F.col("mix.position").alias("m_position")))
    rows = filed.select(F.struct(*map(quoted, columns)).alias("row"), *at)
    # a merge at any size: places are as many as rows, though fewer bytes
    both = rows.join(places.hint("merge"), (F.col("_f") == F.col("m_f")) & (F.col("_i") == F.col("m_i")))
    return both.repartitionByRange("m_position").sortWithinPartitions("m_position").select("row.*")


def file_positions(docs: DataFrame, columns: Sequence[Column], out: str = "position") -> DataFrame:
    """``columns`` made from ``docs``, just read from files, with the place of each row in the order of the files, from 0.

    Files are taken in the order of their names, which is that of the tasks that wrote them, rows in that of the file.
    Rows per file come from the files' footers; there is one row a file.
    """
    place = docs.metadataColumn("_metadata")
    files = docs.select(place.getField("file_name").alias("f")).groupBy("f").agg(F.count("*").alias("n"))
    ahead = Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select(F.col("f").alias("_f"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_start"))
    rows = docs.select(F.struct(*columns).alias("_made"), place.getField("file_name").alias("_name"), place.getField("row_index").alias("_row"))
    return rows.join(starts, F.col("_name") == F.col("_f")).select("_made.*", (F.col("_start") + F.col("_row")).alias(out))
