"""Relations between the entities of a sentence, scored by keywords, distance, schema and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_reference, name_quality
from .direction import Pair, first_is_head

#: Parts of a sentence that speak of a relation.
KEYWORDS = {
    "chose": ("chose", "choose", "select", "picked", "went with", "adopt", "decided to use", "decided to add", "opted for", "settled on", "standardiz", "switched to", "decided that"),
    "rejected": ("reject", "ruled out", "decided against", "dropped", "abandon", "discard", "veto"),
    "replaced": ("replac", "swapped", "in favor of", "instead of", "in place of", "over the legacy", "over the old", "fallback"),
    "depends_on": (
        "depend", "relies on", "rely on", "built on", " uses ", " use ", "using ", "connect", "backed by", "powered by", "running on", "runs on", "deployed on", "hosted on", "integrat",
        "communicat", "proxied by", "proxies", "in front of", "managed by", "orchestrat", "reads from", "writes to", "persist", "publish", "subscrib", "consum", "sends to",
        "receives from", "queries", "fetches from", "leverag", "switched to", "scraped", "scrapes", "flow through", "flows through", "target", "written in", "implemented in",
        "-based", "caching layer", "counter in", "stored in", "cache to", "stitched", "local cache", "sync when", "used by", "via ", "package manager", "is down", "goroutine",
        " runtime", "scraped by", "dashboards",
    ),
    "fixed": ("fixed", "fixing", "resolv", "patched", "repaired", "debugged", "addressed", "correct ", "eliminat", "mitigat", "diagnos", "root-caus", "identified", "found ", "traced", "investigated", "patch ", "fix:", "fix("),
    "introduced": (
        "introduc", " add ", "added", "adding", "implement", "created", "built", "set up", "enabl", "integrat", "install", "configur", "establish", "rolled out", "launched", "onboard",
        "provision", "stood up", "spun up", "extract", "chosen to enforc", "chosen to implement", "metrics to", "support to", "added to", " wired ", "bootstrap",
    ),
    "deprecated": ("deprecat", "removed", "removing", "phased out", "phase out", "sunset", "decommission", "retired", "killed", "shut down", "tore down", "ripped out", "turned off"),
    "caused": ("caused", "causing", "resulted in", "led to", "trigger", "contributed to", "dropped to", "reduced to", "improved to", "decreased to", "reduced by", "improved by", "increased by", "decreased by", "spiked", "spike"),
    "constrained_by": (
        "constrain", "blocked by", "due to", "required to", "has to", "have to", "cannot exceed", "comply", "enforc", "subject to", "bound by", "governed by", "mandated", "driven by",
        "must comply", "guarantee", "accepted", "rate limit", "forbidden", "must not", "exceed", "scoped", "capped at", "cap at", "broke", "break ", "breaking", "zero-trust",
        "least privilege", "cannot handle", "exactly-once", " sla ", "memory safety",
    ),
}
#: Words of a dependency that are weak by themselves.
WEAK = ("using ", " uses ", " use ")
#: Types that may stand at the head and at the tail of a relation.
SCHEMA = {
    "chose": (("Person", "Service", "Component"), ("Component", "Database", "Language", "Infrastructure", "Pattern")),
    "rejected": (("Person", "Service", "Component"), ("Component", "Database", "Language", "Infrastructure")),
    "replaced": (("Component", "Database", "Infrastructure", "Service", "Pattern", "Language"), ("Component", "Database", "Infrastructure", "Pattern", "Language")),
    "depends_on": (("Service", "Component", "Infrastructure", "Language", "Pattern", "Decision"), ("Service", "Component", "Database", "Infrastructure", "Pattern", "Language")),
    "fixed": (("Person", "Component", "Service", "Language", "Infrastructure"), ("Component", "Service", "Database", "Pattern", "Metric", "Constraint")),
    "introduced": (("Person", "Service", "Infrastructure", "Component", "Language"), ("Component", "Pattern", "Infrastructure", "Database", "Language", "Metric")),
    "deprecated": (("Person", "Decision", "Service", "Component", "Infrastructure", "Pattern"), ("Component", "Pattern", "Infrastructure", "Database", "Language")),
    "caused": (("Component", "Decision", "Service", "Infrastructure", "Language", "Pattern", "Database"), ("Metric", "Constraint", "Pattern")),
    "constrained_by": (("Decision", "Component", "Service", "Infrastructure", "Database", "Pattern"), ("Constraint", "Pattern", "Infrastructure", "Metric")),
}


def _keyword_position(sentence: Column, words: tuple[str, ...]) -> Column:
    """Middle of the leftmost keyword in the sentence, from 0; null without one."""
    padded = F.concat(F.lit(" "), F.lower(sentence), F.lit(" "))
    at = [F.instr(padded, F.lit(w)) for w in words]
    return F.least(*[F.when(p > 0, F.greatest(p - 2, F.lit(0)) + len(w) // 2) for p, w in zip(at, words, strict=True)])


def allowed(relation: Column, head: Column, tail: Column) -> Column:
    out = F.lit(False)
    for name, (heads, tails) in SCHEMA.items():
        out = out | ((relation == name) & head.isin(*heads) & tail.isin(*tails))
    return out


def _boost(relation: Column, head: Column, tail: Column) -> Column:
    one = F.lit(1.0)
    when = lambda c, x: F.when(c, x).otherwise(one)
    chooser = when(relation.isin("chose", "rejected") & (head == "Person"), 1.4)
    mended = when((relation == "fixed") & tail.isin("Metric", "Database", "Constraint"), 1.3)
    bound = when((relation == "constrained_by") & head.isin("Service", "Component", "Decision"), 1.2) * when((relation == "constrained_by") & tail.isin("Constraint", "Metric", "Pattern"), 1.2)
    source = F.when(head == "Infrastructure", 1.35).when(head.isin("Component", "Pattern", "Service"), 1.1).otherwise(one)
    cause = when(relation == "caused", source) * when((relation == "caused") & tail.isin("Metric", "Constraint"), 1.2)
    return chooser * mended * bound * cause


def _placed(texts: DataFrame, mentions: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Sentences (key, number, from, sentence) and mentions with the number of their sentence.

    Sentences break behind ``. ! ?`` and a blank, or behind an empty line, and keep every character, so their lengths
    sum to offsets. A mention takes the last sentence that begins at or before it: one window, no range join.
    """
    parts = texts.select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?]\s)|(?<=\n\n)")).alias("number", "sentence"))
    before = Window.partitionBy(key).orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    sentences = parts.withColumn("from", F.coalesce(F.sum(F.length("sentence")).over(before), F.lit(0)))
    rows = sentences.select(key, F.col("from").alias("_at"), F.lit(0).alias("_k"), "number", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("entity_type"))
    rows = rows.unionByName(mentions.select(key, F.col("start").cast("long").alias("_at"), F.lit(1).alias("_k"), F.lit(None).cast("int").alias("number"), "name", "entity_type"))
    seen = Window.partitionBy(key).orderBy("_at", "_k", "name").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("number", F.last("number", ignorenulls=True).over(seen)).where("_k = 1 and number is not null")
    return sentences, placed.select(key, "number", F.col("_at").alias("start"), "name", "entity_type")


def relations(texts: DataFrame, mentions: DataFrame, key: str = "id", least: float = 0.5) -> DataFrame:
    """(key, head, relation, tail, confidence) of texts (key, text) and mentions (key, name, entity_type, start).

    A sentence that holds a keyword joins an entity of its own with one of its own or of a neighbouring sentence; the
    pair that scores best is kept (of ``introduced``, two in a sentence of four entities, the second at 80 % or more).
    Cues of the sentence, the schema and the order of the text say which of the two is the head. Null texts and texts without mentions give no row.
    """
    sentences, placed = _placed(texts, mentions, key)
    hits = F.array(*[F.struct(F.lit(r).alias("relation"), _keyword_position(F.col("sentence"), w).alias("at")) for r, w in KEYWORDS.items()])
    spoken = sentences.select(key, "number", "from", F.lower("sentence").alias("_low"), F.explode(F.filter(hits, lambda h: h["at"].isNotNull())).alias("h"))
    # a sentence that tells of a repair names a cause or a limit that is none
    spoken = spoken.where(~((F.col("h.relation") == "caused") & F.startswith("_low", F.lit("fix:"))))
    spoken = spoken.where(~((F.col("h.relation") == "constrained_by") & F.col("_low").rlike(r"fixed|fix:|fix\(|resolv|patched|debugged")))
    # weak words say nothing beside an implementation or in a sentence with one entity; a metric alone limits nothing
    strong = tuple(w for w in KEYWORDS["depends_on"] if w not in WEAK)
    said = placed.groupBy(key, "number").agg(F.count("*").alias("_n"), F.max("entity_type").alias("_t"))
    spoken = spoken.join(said, [key, "number"])
    weak = (F.col("h.relation") == "depends_on") & _keyword_position(F.col("_low"), strong).isNull() & (F.contains("_low", F.lit("implement")) | (F.col("_n") <= 1))
    spoken = spoken.where(~weak & ~((F.col("h.relation") == "constrained_by") & (F.col("_n") == 1) & (F.col("_t") == "Metric"))).drop("_n", "_t")
    named = placed.where(~is_reference(F.col("name")))
    heads = named.select(key, "number", F.col("name").alias("head"), F.col("entity_type").alias("head_type"), F.col("start").alias("head_at"), F.count("*").over(Window.partitionBy(key, "number")).alias("n_entities"))
    tails = named.select(key, F.explode(F.array(F.col("number") - 1, F.col("number"), F.col("number") + 1)).alias("number"), F.col("number").alias("own"), F.col("name").alias("tail"), F.col("entity_type").alias("tail_type"), F.col("start").alias("tail_at"))
    pairs = spoken.join(heads, [key, "number"]).join(tails, [key, "number"]).where("head <> tail").withColumn("relation", F.col("h.relation"))
    pairs = pairs.where(~((F.col("head_type") == "Person") & (F.col("tail_type") == "Person")) | F.col("relation").isin("chose", "rejected"))
    forward, back = allowed(F.col("relation"), F.col("head_type"), F.col("tail_type")), allowed(F.col("relation"), F.col("tail_type"), F.col("head_type"))
    middle = F.col("from") + F.col("h.at")
    distance = (F.abs(F.col("head_at") - middle) + F.abs(F.col("tail_at") - middle)) / 2
    score = F.when(F.col("own") == F.col("number"), 0.65).otherwise(0.45) / (1 + distance / 50) * F.when(forward | back, 1.0).otherwise(0.55)
    score = score * (name_quality(F.col("head")) + name_quality(F.col("tail"))) / 2 * _boost(F.col("relation"), F.col("head_type"), F.col("tail_type"))
    pairs = pairs.withColumn("confidence", F.round(score, 6)).withColumn("forward", forward).withColumn("backward", back)
    order = Window.partitionBy(key, "number", "relation").orderBy(F.desc("confidence"), F.desc("forward"), "head_at", "tail_at", "head", "tail")
    placed_pairs = pairs.withColumn("_r", F.row_number().over(order)).withColumn("_best", F.max("confidence").over(Window.partitionBy(key, "number", "relation")))
    second = (F.col("_r") == 2) & (F.col("relation") == "introduced") & (F.col("n_entities") >= 4) & (F.col("confidence") >= 0.8 * F.col("_best"))
    kept = placed_pairs.where(((F.col("_r") == 1) | second) & (F.col("confidence") >= least))
    ordered = F.col("head_at") <= F.col("tail_at")
    first = lambda a, b: F.when(ordered, F.col(a)).otherwise(F.col(b))
    pair = Pair(F.col("_low"), first("head", "tail"), first("tail", "head"), first("head_type", "tail_type"), first("tail_type", "head_type"))
    leads = first_is_head(F.col("relation"), pair, first("forward", "backward"), first("backward", "forward"))
    turned = kept.withColumn("_leads", leads).withColumn("_head", F.when(F.col("_leads"), pair.names[0]).otherwise(pair.names[1])).withColumn("_tail", F.when(F.col("_leads"), pair.names[1]).otherwise(pair.names[0]))
    turned = turned.select(key, F.col("_head").alias("head"), "relation", F.col("_tail").alias("tail"), "confidence")
    return turned.groupBy(key, "head", "relation", "tail").agg(F.max("confidence").alias("confidence"))
