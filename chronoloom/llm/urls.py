"""URL filter by the ratio of two character language models, in DataFrame expressions only.

Rules (host and path prefix) judge what they fit; what they judged teaches one model of accepted and one of rejected
URLs. Each is a smoothed variable-order Markov model: a context is kept where the corpus shows it often enough, and a
character is predicted from the longest kept context. The verdict on any other URL is its log-likelihood difference a
character, against a threshold calibrated on judged URLs that the models have not seen.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize

#: Characters of a context and the character it predicts, together at most.
ORDER = 4
#: A string of up to ORDER characters is kept from this share of all strings of its length in accepted or in rejected
#: URLs: at most 2 / SHARE of each length exist, so the model that is broadcast has at most 2 * ORDER / SHARE rows,
#: whatever the input, and a rare class keeps its contexts.
SHARE = 2e-5
#: Weight of the shorter context in a smoothed distribution, in observations.
SMOOTHING = 4.0
#: One judged URL in so many is not learnt from: it calibrates the threshold.
HELD_OUT = 5
#: Marks the beginning and the end of a URL; no URL has it.
EDGE = "\x02"


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the production query.
RULES = (
    UrlRule("org", "/", True),
    UrlRule("example.org", "/es/", False),
    UrlRule("example.org", "/en/1", False),
    UrlRule("com", "/fr/", True),
    UrlRule("com", "/de/", False),
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path up to ``?`` or ``#``. Null, or without ``://``: both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> tuple[Column, Column]:
    """Name of the longest rule that fits (equal lengths: the first given), and whether it allows; else nulls."""
    name, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    # a later `when` wins, so the rules go from the weakest to the strongest
    for _, rule in sorted(enumerate(rules), key=lambda r: (len(r[1].name), -r[0])):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        allow = F.when(fits, F.lit(rule.allow)).otherwise(allow)
    return name, allow


def _spread(urls: DataFrame) -> DataFrame:
    """``urls`` over as many tasks as the session shuffles to: a row grows to hundreds of rows in the next step."""
    return urls.repartition(int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _characters(urls: DataFrame, url: str) -> DataFrame:
    """One row a character: ``c0`` the character, ``g1`` .. the strings of 1 .. ORDER characters that end in it."""
    line = F.concat(F.lit(EDGE * (ORDER - 1)), F.lower(F.coalesce(F.col(url), F.lit(""))), F.lit(EDGE))
    at = urls.withColumn("_line", line).withColumn("_at", F.explode(F.sequence(F.lit(ORDER), F.length("_line"))))
    grams = [F.substring(F.col("_line"), F.col("_at") - (n - 1), F.lit(n)).alias(f"g{n}") for n in range(1, ORDER + 1)]
    return at.select(*urls.columns, *grams)


def learn(judged: DataFrame, url: str, allow: str) -> DataFrame:
    """The model: ``gram``, log probability of its last character (pa, pb) and backoff weight as a context (wa, wb).

    a: accepted, b: rejected. Distinct URLs are counted with their numbers of copies first, so a URL or host that
    repeats costs one row; the counts of a string are then summed before any shuffle. What a context has lost with
    strings that are not kept goes to its backoff weight, so the probabilities behind a context sum to those of the
    shorter one. The empty gram stands for a character that is not kept. Without URLs there is no row.
    """
    distinct = _spread(judged.groupBy(F.col(url).alias("u"), F.col(allow).alias("ok")).agg(F.count("*").cast("double").alias("n")))
    rows = _characters(distinct, "u")
    a, b = F.when(F.col("ok"), F.col("n")).otherwise(0.0), F.when(~F.col("ok"), F.col("n")).otherwise(0.0)
    grams = rows.select(F.explode(F.array(*[F.col(f"g{n}") for n in range(1, ORDER + 1)])).alias("gram"), a.alias("a"), b.alias("b"))
    # no character precedes the first: strings of edges alone are contexts all the same
    edges = distinct.limit(1).select(F.explode(F.array(*[F.lit(EDGE * n) for n in range(2, ORDER)])).alias("gram"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    counts = materialize(grams.unionByName(edges).groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).withColumn("len", F.length("gram")))
    total = counts.where("len = 1").agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0.0)).alias("b"), F.count("*").alias("n")).first()
    ta, tb, alphabet = total["a"], total["b"], total["n"] + 1
    often = ((F.col("a") > 0) & (F.col("a") >= SHARE * ta)) | ((F.col("b") > 0) & (F.col("b") >= SHARE * tb)) | F.col("gram").isin(*[EDGE * n for n in range(2, ORDER)])
    # occurrences of a string as a context, and what of them its kept continuations have
    held = lambda c: F.sum(F.when(often, F.col(c)).otherwise(0.0))
    behind = counts.where("len > 1").groupBy(F.expr("substring(gram, 1, len - 1)").alias("ctx"))
    contexts = behind.agg(F.sum("a").alias("ca"), F.sum("b").alias("cb"), held("a").alias("ha"), held("b").alias("hb"))
    kept = counts.where(often).join(contexts.withColumnRenamed("ctx", "gram"), "gram", "left").fillna(0.0, ["ca", "cb", "ha", "hb"])
    back = lambda c, h: (F.col(c) - F.col(h) + SMOOTHING) / (F.col(c) + SMOOTHING)
    kept = materialize(kept.select("gram", "len", "a", "b", "ca", "cb", back("ca", "ha").alias("wa"), back("cb", "hb").alias("wb")))
    # smoothed probabilities, from short strings to long ones; each length is bounded by 2 / SHARE rows
    done = kept.where("len = 1").select("gram", *[((F.col(c) + 1.0) / (t + alphabet)).alias(p) for c, t, p in (("a", ta, "pa"), ("b", tb, "pb"))])
    levels = [done]
    for n in range(2, ORDER + 1):
        own = kept.where(F.col("len") == n).select("gram", "a", "b", F.expr("substring(gram, 1, len - 1)").alias("ctx"), F.expr("substring(gram, 2, len - 1)").alias("short"))
        ctx = kept.where(F.col("len") == n - 1).select(F.col("gram").alias("ctx"), "ca", "cb", "wa", "wb")
        low = levels[-1].select(F.col("gram").alias("short"), F.col("pa").alias("la"), F.col("pb").alias("lb"))
        # a string that is kept has kept contexts and endings: they are at least as frequent
        joined = own.join(F.broadcast(ctx), "ctx").join(F.broadcast(low), "short")
        p = lambda c, t, w, low: F.col(c) / (F.col(t) + SMOOTHING) + F.col(w) * F.col(low)
        levels.append(materialize(joined.select("gram", p("a", "ca", "wa", "la").alias("pa"), p("b", "cb", "wb", "lb").alias("pb"))))
    smoothed = functools.reduce(DataFrame.unionByName, levels).join(kept.select("gram", "wa", "wb"), "gram")
    logs = smoothed.select("gram", *[F.log(c).alias(c) for c in ("pa", "pb", "wa", "wb")])
    unseen = [F.lit(-math.log(t + alphabet)).alias(p) for t, p in ((ta, "pa"), (tb, "pb"))]
    model = materialize(logs.unionByName(counts.limit(1).select(F.lit("").alias("gram"), *unseen, F.lit(0.0).alias("wa"), F.lit(0.0).alias("wb"))))
    for used in (counts, kept, *levels[1:]):
        discard(used)
    return model


def score(urls: DataFrame, model: DataFrame, url: str, key: str) -> DataFrame:
    """``key`` and ``llr``: log-likelihood difference a character, accepted minus rejected.

    The model is broadcast (see SHARE). A URL's characters stay in one task, where they are summed before the shuffle.
    """
    first = model.where("gram = ''").first()
    unseen = first["pa"] - first["pb"] if first else 0.0
    rows = _characters(_spread(urls.select(key, url) if key != url else urls.select(url)), url)
    side = model.select("gram", "pa", "pb", "wa", "wb")
    for n in range(1, ORDER + 1):
        small = F.broadcast(side.select(F.col("gram").alias(f"g{n}"), (F.col("pa") - F.col("pb")).alias(f"d{n}")))
        rows = rows.join(small, f"g{n}", "left")
        if n < ORDER:
            ctx = F.broadcast(side.select(F.col("gram").alias(f"x{n}"), (F.col("wa") - F.col("wb")).alias(f"w{n}")))
            rows = rows.withColumn(f"x{n}", F.expr(f"substring(g{n + 1}, 1, {n})")).join(ctx, f"x{n}", "left")
    # longest context that is kept: its own estimate, or its weight and the estimate of the next shorter one
    value = F.coalesce(F.col("d1"), F.lit(unseen))
    for n in range(2, ORDER + 1):
        value = F.when(F.col(f"d{n}").isNotNull(), F.col(f"d{n}")).otherwise(F.coalesce(F.col(f"w{n - 1}"), F.lit(0.0)) + value)
    return rows.select(key, value.alias("v")).groupBy(key).agg(F.avg("v").alias("llr"))


def threshold(scored: DataFrame, allow: str) -> float | None:
    """Where a normal fit of accepted and of rejected scores has the same share of errors; none if either is missing."""
    rows = {r[0]: r for r in scored.where(F.col(allow).isNotNull()).groupBy(allow).agg(F.avg("llr").alias("m"), F.stddev_pop("llr").alias("s")).collect()}
    if True not in rows or False not in rows:
        return None
    (ma, sa), (mb, sb) = [(rows[k]["m"], max(rows[k]["s"] or 0.0, 1e-9)) for k in (True, False)]
    return (ma * sb + mb * sa) / (sa + sb)


def held_out(url: Column) -> Column:
    """Judged URLs that the models do not learn from and the threshold is calibrated on."""
    return F.crc32(F.coalesce(url, F.lit(""))) % HELD_OUT == 0


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """``key``, host, path, rule, verdict and llr of every row; other columns of ``pages`` are dropped.

    Rows are scored by distinct URL, so copies cost nothing and a repeated or null key is harmless. A null URL is
    scored as the empty one; a URL of any length is scored whole. One judged URL in HELD_OUT calibrates the threshold;
    where those are not of both kinds, all judged URLs do. Without accepted or rejected URLs to learn from, what no
    rule fits is allowed. An empty table gives an empty one.
    """
    host, path = parts(F.col(url))
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), host.alias("host"), path.alias("path"))
    name, allow = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("_allow", allow)
    judged = rows.where(F.col("_allow").isNotNull())
    model = learn(judged.where(~held_out(F.col("_url"))), "_url", "_allow")
    distinct = rows.groupBy(F.coalesce("_url", F.lit("")).alias("_u")).agg(F.first("_allow").alias("_a"))
    scored = materialize(score(distinct, model, "_u", "_u").withColumnRenamed("_u", "_s"))
    known = distinct.join(scored, distinct["_u"] == scored["_s"]).select("_u", "_a", "llr")
    cut = threshold(known.where(held_out(F.col("_u"))), "_a")
    if cut is None:
        cut = threshold(known, "_a")
    out = rows.join(scored, F.coalesce(rows["_url"], F.lit("")) == scored["_s"], "left")
    fine = F.lit(True) if cut is None else F.coalesce(F.col("llr"), F.lit(0.0)) >= cut
    verdict = F.coalesce(F.col("_allow"), fine)
    discard(model)
    return out.select(F.col("_key").alias(key), "host", "path", "rule", F.when(verdict, "allow").otherwise("block").alias("verdict"), "llr")
