"""Document fingerprints by consistent weighted sampling, in DataFrame expressions only.

A text is its lower-cased words, weighted by their counts. For sample k and term x with weight w, draw from hashes of
(k, x): r and c from Gamma(2, 1) and b uniform; t = floor(ln w / r + b), ln y = r (t - b), a = c / (y exp(r)). The
term with the least a is the sample, known by (x, t). Two texts agree in a sample with probability equal to the
generalised Jaccard similarity of their weights: sum of minima over sum of maxima.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import whole, words
from .shared import materialize

#: Samples of a fingerprint; 8 hexadecimal digits each.
SAMPLES = 32
_STEP = 0x9E3779B97F4A7C15
#: Stands for a null doc_id among keys; the hash beside it tells the two apart.
_NO_ID = -(2**63)


def _sample(term: str, log_weight: str, k: int) -> Column:
    """The sample's key, largest where a is least: -ln a in 40 bits, then 23 bits that name (x, t).

    It depends on x, t and k alone, so equal keys are equal samples. Draws are never 0: half a step is added.
    """
    h = f"xxhash64({term} ^ {((k + 1) * _STEP) % 2**63}L)"
    g = f"xxhash64({term} ^ {((k + 1_000_003) * _STEP) % 2**63}L)"
    r = f"(-ln((shiftrightunsigned({h}, 32) + 0.5D) * (({h} & 4294967295L) + 0.5D) * {2.0**-64!r}D))"
    c = f"(-ln((shiftrightunsigned({g}, 43) + 0.5D) * ((shiftrightunsigned({g}, 22) & 2097151L) + 0.5D) * {2.0**-42!r}D))"
    b = f"(({g} & 4194303L) * {2.0**-22!r}D)"
    t = f"floor({log_weight} / {r} + {b})"
    score = f"({r} * ({t} - {b} + 1D) - ln({c}))"
    return F.expr(f"shiftleft(cast(({score} + 8D) * {2.0**33!r}D as bigint), 23) | (xxhash64({g} ^ {t}) & 8388607L)")


def _sampled(terms: DataFrame, keys: list[str], samples: int) -> DataFrame:
    """``keys``, ``samples`` and the largest ``x`` of terms (``keys``, ``x``)."""
    weighted = terms.groupBy(*keys, "x").agg(F.count("*").cast("double").alias("n")).select(*keys, "x", F.log("n").alias("lw"))
    best = weighted.groupBy(*keys).agg(F.max("x").alias("x"), *[F.max(_sample("x", "lw", k)).alias(f"s{k}") for k in range(samples)])
    return best.select(*keys, "x", F.array(*[f"s{k}" for k in range(samples)]).alias("samples"))


def fingerprints(texts: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``samples``, an array of ``samples`` longs, of every text with a word; texts without one give no row.

    Where ``texts`` is already partitioned by the first of ``keys``, nothing is shuffled: the words of a text are
    counted and sampled in the task that holds it. Rows that share all keys count as one text.
    """
    terms = texts.select(*keys, F.explode(words(F.lower(F.col(text)))).alias("w")).select(*keys, F.xxhash64("w").alias("x"))
    return _sampled(terms, keys, samples).drop("x")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of samples that agree. Without words both are alike (1), one of them not (0)."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / F.lit(float(samples)))


def as_string(samples: Column) -> Column:
    """Eight digits a sample, from a hash of its key; empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(F.xxhash64(x).bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), ""), F.lit(""))


def _in_turn(rows: DataFrame) -> DataFrame:
    """``rows`` (a, b, n, m, lost) with next_a and next_b: the row behind in descending (a, b); after the last, the first.

    Ranges of ``a`` are ordered one by one; only each range's first row meets the other ranges'.
    """
    ranged = materialize(rows.repartitionByRange("a").withColumn("p", F.spark_partition_id()))
    firsts = ranged.groupBy("p").agg(F.max(F.struct("a", "b")).alias("first"))
    across = Window.orderBy(F.desc("p"))
    top = F.first("first").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    behind = firsts.select(F.col("p").alias("fp"), F.coalesce(F.lead("first").over(across), top).alias("after"))
    # one row a range of the shuffle, however many rows there are
    joined = ranged.join(F.broadcast(behind), F.col("p") == F.col("fp"))
    inside = Window.partitionBy("p").orderBy(F.desc("a"), F.desc("b"))
    succeeding = F.coalesce(F.lead(F.struct("a", "b")).over(inside), F.col("after"))
    return joined.select("a", "b", "n", "m", "lost", succeeding.alias("s")).select("a", "b", "n", "m", "lost", F.col("s.a").alias("next_a"), F.col("s.b").alias("next_b"))


def fingerprint_report(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited and near_next of every row.

    The edited text ends in the beginning of the next document, by descending doc_id, in place of its last third. A
    null text is empty, a null doc_id comes last. Rows that repeat a doc_id follow each other by a hash of the text;
    equal rows share one place in the order and have equal results: their text is worked on once. Texts of any length
    are read whole. Other columns are not read; an empty table gives an empty one.

    Whole texts are shuffled once: both uses of them read the same exchange. Only the borrowed beginnings, a third of
    the texts, are shuffled besides. Length and digest of the edited text ride along as terms of sides of their own,
    so that one pass over the texts yields all there is to know of a row.
    """
    text = whole(F.col("text"))
    # a and b name a document: no nulls, so that joins on them keep their partitioning
    base = documents.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("a"), F.xxhash64(text, F.col("doc_id").isNull()).alias("b"), text.alias("text"), F.col("doc_id").isNull().alias("lost"))
    places = base.select("a", "b", F.length("text").cast("long").alias("n"), "lost").groupBy("a", "b", "n", "lost").agg(F.count("*").alias("m"))
    turn = materialize(_in_turn(places))
    held = base.select("a", "b", "text")
    twice = materialize(turn.where("m > 1").select("a", "b"))
    if twice.limit(1).count():
        # one text for each place: copies are reduced where they lie, before they meet
        one = held.join(twice, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.first("text").alias("text"))
        held = held.join(twice, ["a", "b"], "left_anti").unionByName(one)
    asked = turn.select(F.col("next_a").alias("da"), F.col("next_b").alias("db"), F.floor(F.col("n") / 3).cast("int").alias("take"), F.col("a").alias("ra"), F.col("b").alias("rb"), "n", "m")
    given = held.join(asked, (held["a"] == asked["da"]) & (held["b"] == asked["db"])).select("ra", "rb", "n", "m", "take", F.substring("text", F.lit(1), F.col("take")).alias("given"))
    given = given.groupBy("ra", "rb", "n", "m", "take").agg(F.first("given").alias("given"))
    edited = held.join(given, (held["a"] == given["ra"]) & (held["b"] == given["rb"])).select("a", "b", "m", "text", F.concat(F.substring("text", F.lit(1), (F.col("n") - F.col("take")).cast("int")), F.col("given")).alias("edited"))
    edited = edited.withColumn("digest", F.sha2(F.encode("edited", "utf-8"), 256))
    quarters = [F.substring("digest", 16 * i + 1, 16) for i in range(4)]
    sides = [F.struct(F.lit(i).alias("side"), t.alias("t")) for i, t in enumerate([F.col("text"), F.col("edited"), *quarters])]
    w = edited.select("a", "b", "m", F.explode(F.array(*sides)).alias("e")).select("a", "b", "m", "e.side", F.explode(words(F.lower("e.t"))).alias("w"))
    terms = w.select("a", "b", "m", "side", F.when(F.col("side") < 2, F.xxhash64("w")).otherwise(F.conv("w", 16, -10).cast("long")).alias("x"))
    known = _sampled(terms, ["a", "b", "side"], SAMPLES)
    of = lambda side, column: F.first(F.when(F.col("side") == side, F.col(column)), ignorenulls=True)
    marked = materialize(known.groupBy("a", "b").agg(of(0, "samples").alias("own"), of(1, "samples").alias("alt"), *[of(i + 2, "x").alias(f"q{i}") for i in range(4)]))
    later = marked.select(F.col("a").alias("na"), F.col("b").alias("nb"), F.col("own").alias("later"))
    turned = turn.select(F.col("a").alias("ta"), F.col("b").alias("tb"), "next_a", "next_b", "n", "m", "lost").join(later, (F.col("next_a") == F.col("na")) & (F.col("next_b") == F.col("nb")))
    out = marked.join(turned, (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb"))).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    sha = F.lower(F.concat(*[F.lpad(F.hex(f"q{i}"), 16, "0") for i in range(4)]))
    return out.select(F.when(~F.col("lost"), F.col("a")).alias("doc_id"), F.col("n").alias("n_chars"), sha.alias("edited_sha256"), as_string(F.col("own")).alias("fingerprint"), as_string(F.col("alt")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("alt")).alias("near_edited"), likeness(F.col("own"), F.col("later")).alias("near_next"))
