"""Mentions in text: a dictionary of names, names formed by suffix, pronouns, and the removal of overlaps.

Each text is worked on where it lies; Arrow carries batches of texts to Python, nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import canonical, retyped
from ..functions.text import NEUTER, PERSON, PLURAL, strip_article

#: Endings that make a name a service or a component.
SERVICE_ENDINGS = ("Service", "Provider")
COMPONENT_ENDINGS = (
    "Pool", "Bus", "Store", "Pipeline", "Engine", "Builder", "Controller", "Processor", "Manager", "Limiter", "Dispatcher", "Aggregator", "Sync",
    "Checker", "Router", "Handler", "Gateway", "Monitor", "Scheduler", "Dashboard",
)
#: Confidence of a name of the dictionary, of a name by suffix, of a pronoun.
KNOWN, SUFFIX, PRONOUN = 0.85, 0.80, 0.45
#: Names up to this many travel with the task; more are a table that meets the texts in a join.
LARGEST_DICTIONARY = 200_000

MENTIONS = "array<struct<text:string,entity_type:string,start:int,end:int,confidence:double>>"
_ARROW = pa.list_(pa.struct([("text", pa.string()), ("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())]))
_CAMEL = re.compile(r"[A-Za-z0-9]+")
_PRONOUNS = re.compile(r"[A-Za-z]+")
_CHUNK = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]")


def _mention(text: str, kind: str, start: int, end: int, confidence: float) -> dict:
    return {"text": text, "entity_type": kind, "start": start, "end": end, "confidence": confidence}


class Dictionary:
    """Names with types; finds the first whole-word place of each name in a text in one walk over its pieces."""

    def __init__(self, names: dict[str, str]):
        if len(names) > LARGEST_DICTIONARY:
            raise ValueError(f"{len(names)} names: use mentions_by_join")
        self.names: dict[str, list[tuple[str, str]]] = {}
        for name, kind in names.items():
            piece = _CHUNK.match(name)
            if piece:
                self.names.setdefault(piece.group(), []).append((name, kind))

    def scan(self, text: str) -> list[dict]:
        """First places, in order of the text, longer names first."""
        taken: set[str] = set()
        out = []
        for piece in _CHUNK.finditer(text):
            for name, kind in self.names.get(piece.group(), ()):
                end = piece.start() + len(name)
                closed = end >= len(text) or not (text[end].isascii() and text[end].isalnum())
                begun = piece.start() == 0 or not (text[piece.start() - 1].isascii() and text[piece.start() - 1].isalnum())
                if name not in taken and begun and closed and text.startswith(name, piece.start()):
                    taken.add(name)
                    out.append(_mention(name, kind, piece.start(), end, KNOWN))
        return sorted(out, key=lambda m: (m["start"], -m["end"], m["text"]))


def scan_endings(text: str, have: set[str]) -> list[dict]:
    """Words of more than four characters with a capital inside that end as a service or a component; each once."""
    out, seen = [], {x.lower() for x in have}
    for word in _CAMEL.finditer(text):
        name = word.group()
        if len(name) <= 4 or not name[0].isupper() or not any(c.isupper() for c in name[1:]) or name.lower() in seen:
            continue
        kind = "Service" if name.endswith(SERVICE_ENDINGS) else "Component" if name.endswith(COMPONENT_ENDINGS) else None
        if kind:
            seen.add(name.lower())
            out.append(_mention(name, kind, word.start(), word.end(), SUFFIX))
    return out


def without_overlaps(mentions: list[dict], known: frozenset[str] = frozenset()) -> list[dict]:
    """No two of the result overlap. Each mention, by start and length, meets those kept before it that it overlaps.

    It takes the place of such a one if it alone is a known name, is surer by over 0.01, or is as sure and shorter;
    else it goes, at the first that holds its place.
    """
    kept: list[dict] = []
    for m in sorted(mentions, key=lambda m: (m["start"], m["end"] - m["start"])):
        stays = True
        while stays and kept and m["start"] < kept[-1]["end"] and m["end"] > kept[-1]["start"]:
            if _beats(m, kept[-1], known):
                kept.pop()
            else:
                stays = False
        if stays:
            kept.append(m)
    return kept


def _beats(m: dict, other: dict, known: frozenset[str]) -> bool:
    if (m["text"] in known) != (other["text"] in known):
        return m["text"] in known
    if abs(m["confidence"] - other["confidence"]) > 0.01:
        return m["confidence"] > other["confidence"]
    return m["end"] - m["start"] < other["end"] - other["start"]


def resolve_pronouns(text: str, mentions: list[dict]) -> list[dict]:
    """Each pronoun as a mention of the nearest entity that begins before it and fits: persons, things, or any."""
    marks = [(m["start"], 0, m) for m in mentions]
    for word in _PRONOUNS.finditer(text):
        low = word.group().lower()
        if low in _CLASS:
            marks.append((word.start(), -1, (word.end(), _CLASS[low])))
    last: dict[str, dict] = {}
    out = []
    for start, kind, what in sorted(marks, key=lambda x: (x[0], x[1])):
        if kind == 0:
            last["person" if what["entity_type"].lower() == "person" else "neuter"] = last["plural"] = what
        elif what[1] in last:
            out.append(_mention(last[what[1]]["text"], last[what[1]]["entity_type"], start, what[0], PRONOUN))
    return out


_CLASS = {**dict.fromkeys(PERSON, "person"), **dict.fromkeys(NEUTER, "neuter"), **dict.fromkeys(PLURAL, "plural")}


def _per_text(work: Callable[[str], list[dict]], text: Column) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([work(t or "") for t in texts.to_pylist()], _ARROW)

    return F.arrow_udf(run, MENTIONS)(text)


def dictionary_mentions(text: Column, names: dict[str, str]) -> Column:
    """First whole-word place of every name; null and empty texts give an empty list."""
    return _per_text(Dictionary(names).scan, text)


def mentions_by_join(texts: DataFrame, names: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, text, entity_type, start, end, confidence): the first whole-word place of every name in every text.

    For any number of names (name, entity_type): a name's first run of letters and digits meets the texts' runs, and
    the whole name is compared where they meet. A run that many texts hold, such as an article, is no row unless a name
    begins with it: runs are first joined to the distinct first runs. Of a name with several types the least is taken.
    """
    piece = F.regexp_extract("name", "^[A-Za-z0-9]+", 0)
    known = names.where(piece != "").groupBy("name").agg(F.min("entity_type").alias("entity_type")).withColumn("_k", piece)
    parts = F.split(F.coalesce(F.col(text), F.lit("")), "(?<=[A-Za-z0-9])(?=[^A-Za-z0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])")
    split = texts.select(key, text, F.posexplode(parts).alias("_n", "_k")).withColumn("_e", F.sum(F.length("_k")).over(Window.partitionBy(key).orderBy("_n")))
    runs = split.where(F.col("_k").rlike("^[A-Za-z0-9]")).select(key, text, "_k", (F.col("_e") - F.length("_k")).cast("int").alias("start"))
    met = runs.join(known, "_k").withColumn("end", (F.col("start") + F.length("name")).cast("int"))
    behind = F.substring(F.col(text), F.col("end") + 1, F.lit(1))
    met = met.where((F.substring(F.col(text), F.col("start") + 1, F.length("name")) == F.col("name")) & ~behind.rlike("^[A-Za-z0-9]"))
    first = met.groupBy(key, "name", "entity_type").agg(F.min("start").alias("start"))
    return first.select(key, F.col("name").alias("text"), "entity_type", "start", (F.col("start") + F.length("name")).cast("int").alias("end"), F.lit(KNOWN).alias("confidence"))


def mentions(text: Column, names: dict[str, str], pronouns: bool = True, least: float = 0.5) -> Column:
    """The chain: names, names by suffix, overlaps removed, those below ``least`` dropped, then pronouns."""
    dictionary, known = Dictionary(names), frozenset(names)

    def work(t: str) -> list[dict]:
        found = dictionary.scan(t)
        found += scan_endings(t, {m["text"] for m in found})
        kept = [m for m in without_overlaps(found, known) if m["confidence"] >= least]
        return sorted(kept + (resolve_pronouns(t, kept) if pronouns else []), key=lambda m: (m["start"], m["end"]))

    return _per_text(work, text)


def local_mentions(text: Column, names: dict[str, str], recognised: Column | None = None, vocabulary: dict[str, str] | None = None, least: float = 0.5) -> Column:
    """The whole chain of a text's mentions, each step on what the last one left.

    What a model recognised from ``least`` (an array like the result's, none by default), pronouns, names of the
    dictionary that are not there yet, names by ending, types by vocabulary, canonical names, overlaps removed, leading
    articles dropped with the start moved along.
    """
    dictionary, known = Dictionary(names), frozenset(names)

    def found(texts: pa.Array, given: pa.Array) -> pa.Array:
        out = []
        for t, g in zip(texts.to_pylist(), given.to_pylist(), strict=True):
            t = t or ""
            sure = [m for m in g or [] if m["confidence"] >= least]
            own = dictionary.scan(t)
            named = sure + [m for m in own if m["text"].lower() not in {x["text"].lower() for x in sure}]
            named += scan_endings(t, {m["text"] for m in named})
            out.append(named + resolve_pronouns(t, named))
        return pa.array(out, _ARROW)

    def parted(given: pa.Array) -> pa.Array:
        return pa.array([without_overlaps(g or [], known) for g in given.to_pylist()], _ARROW)

    none = F.array().cast(MENTIONS)
    first = F.arrow_udf(found, MENTIONS)(text, none if recognised is None else recognised)
    typed = F.transform(first, lambda m: m.withField("entity_type", retyped(m["text"], m["entity_type"], vocabulary)))
    single = F.arrow_udf(parted, MENTIONS)(canonical(typed, tuple(names)[:500]))

    def bare(m: Column) -> Column:
        name = strip_article(m["text"])
        return m.withField("start", (m["start"] + F.length(m["text"]) - F.length(name)).cast("int")).withField("text", name)

    return F.transform(single, bare)


#: Parts of a text that speak of versions, code or trouble.
MESSY = ("@", "v2", "v3", "#", "::", "->", "stack", "error:", "broke", "outage", "incident")


def escalates(text: Column, found: Column, types: tuple[str, ...]) -> Column:
    """Whether a text deserves a stronger extractor: thin, doubtful or badly typed mentions, few names in many words, or a messy text."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    n = F.size(found)
    mean = F.aggregate(found, F.lit(0.0), lambda s, m: s + m["confidence"]) / F.greatest(n, F.lit(1))
    typed = F.size(F.filter(found, lambda m: m["entity_type"].isin(*types))) / F.greatest(n, F.lit(1))
    unique = F.size(F.array_distinct(F.transform(found, lambda m: F.lower(m["text"]))))
    return (n * 10.0 / F.greatest(words, F.lit(1)) < 1.5) | (mean < 0.4) | (typed < 0.6) | ((words > 25) & (unique < 5)) | F.coalesce(F.lower(text).rlike("|".join(MESSY)), F.lit(False))
