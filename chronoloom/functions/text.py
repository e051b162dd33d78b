"""Text functions as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading words that a question loses before it is searched.
INTERROGATIVES = ("what", "who", "where", "when", "why", "how", "tell", "me", "show", "list", "find", "does", "do", "did", "is", "are", "was", "were", "the", "a", "an")
#: Pronouns by class.
PERSON, NEUTER, PLURAL = ("he", "she", "him", "her", "his", "hers"), ("it", "its", "this", "that", "these", "those"), ("they", "them", "their", "theirs", "we", "us", "our")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def sanitize(query: Column) -> Column:
    """Letters, digits, blanks and underscores; the rest becomes a blank, and blanks are joined."""
    return F.trim(F.regexp_replace(F.regexp_replace(query, r"[^\p{L}\p{N}_ ]", " "), " +", " "))


def strip_interrogatives(question: Column) -> Column:
    any_of = "|".join(INTERROGATIVES)
    return F.trim(F.regexp_replace(F.lower(F.trim(question)), rf"^(({any_of})(\s+|$))+", ""))


def ngrams(words: Column, most: int = 5) -> Column:
    """All runs of 1 to ``most`` words, joined by blanks, shortest first."""

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
        return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[runs(n) for n in range(1, most + 1)]))


def sentences(text: Column) -> Column:
    """Parts behind ``. ! ?`` and a blank, or at an empty line; trimmed, empty ones dropped."""
    marked = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])\s+", "$1\x01"), r"\n\s*\n", "\x01")
    return F.filter(F.transform(F.split(marked, "\x01"), lambda x: F.trim(x)), lambda x: x != "")


def pronouns(text: Column) -> Column:
    """Pronouns in order, lower-cased."""
    every = [*PERSON, *NEUTER, *PLURAL]
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda x: x.isin(*every))


def strip_article(name: Column) -> Column:
    """One leading article goes if two characters or more remain."""
    bare = F.regexp_replace(name, "^([Tt]he|[Aa]n?) ", "")
    return F.when(F.length(bare) >= 2, bare).otherwise(name)


def name_quality(name: Column) -> Column:
    return F.when(name.rlike(r"^\p{Lu}"), 1.0).when(name.rlike(r"\p{N}"), 0.95).otherwise(0.75)


def metadata(pairs: Column, tags: Column) -> Column:
    """JSON object of a map with a list of tags under ``tags``; nothing to say gives null.

    The list is spliced in as JSON, so it stays a list beside values that are strings. A pair named ``tags`` gives way.
    """
    plain = F.map_filter(F.coalesce(pairs, F.create_map().cast("map<string,string>")), lambda k, _: (F.size(F.coalesce(tags, F.array())) == 0) | (k != "tags"))
    listed = F.concat(F.lit('"tags":'), F.to_json(tags))
    fields = F.when(F.size(plain) > 0, F.regexp_replace(F.to_json(plain), r"(?s)^\{(.*)\}$", "$1"))
    body = F.concat_ws(",", fields, F.when(F.size(F.coalesce(tags, F.array())) > 0, listed))
    return F.when(body != "", F.concat(F.lit("{"), body, F.lit("}")))


def tag_list(text: Column) -> Column:
    """Tags parted by commas, each without blanks around it; an empty text is one empty tag, null has none."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x))


def parsed_time(text: Column, fallback: Column | None = None) -> Column:
    """A moment in RFC 3339; what cannot be read becomes ``fallback``, now if there is none."""
    return F.coalesce(F.try_to_timestamp(text), F.current_timestamp() if fallback is None else fallback)


_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")
_WORDS = pa.list_(pa.struct([("word", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def words_with_offsets(text: Column) -> Column:
    """Words between blanks as (word, start, end), in one walk over the text: running sums of arrays would copy them at every word."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[{"word": m[0], "start": m.start(), "end": m.end()} for m in _WORD.finditer(t or "")] for t in texts.to_pylist()], _WORDS)

    return F.arrow_udf(run, "array<struct<word:string,start:int,end:int>>")(text)


def spans_of(text: Column, name: Column) -> Column:
    """(start, end) of every place of a name, overlapping ones too; an empty name has none.

    The text is cut before every place, so the places are running lengths: one pass over a text of any length.
    """
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    pieces = F.split(text, quoted)
    ends = F.aggregate(
        pieces, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, x: F.struct((a["at"] + F.length(x)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
    )["out"]
    starts = F.when(F.startswith(text, name), ends).otherwise(F.slice(ends, F.lit(2), F.size(ends)))
    none = F.array().cast("array<struct<start:int,end:int>>")
    found = F.transform(starts, lambda i: F.struct(i.alias("start"), (i + F.length(name)).alias("end")))
    return F.when((F.length(name) > 0) & (F.length(text) >= F.length(name)), found).otherwise(none)


def pair_context(text: Column, head: Column, tail: Column) -> Column:
    """The sentences, parted by a full stop and a blank, from the first of the two names to the last; else the text."""

    def cut(p: Column) -> Column:
        before, after = F.substring(text, F.lit(1), p["first"] - 1), F.substring(text, p["last"], F.length(text))
        begin = F.when(F.contains(before, F.lit(". ")), F.length(before) - F.instr(F.reverse(before), F.lit(" .")) + 2).otherwise(F.lit(1))
        ends = [F.instr(after, F.lit(stop)) for stop in (". ", ".\n")]
        stop = F.when(ends[0] > 0, ends[0]).when(ends[1] > 0, ends[1]).otherwise(F.length(after))
        return F.trim(F.substring(text, begin, p["last"] - begin + stop))

    low = F.lower(text)
    h, t = F.instr(low, F.lower(head)), F.instr(low, F.lower(tail))
    places = F.struct(F.least(h, t).alias("first"), F.greatest(h + F.length(head), t + F.length(tail)).alias("last"))
    return F.when((h > 0) & (t > 0), let(places, cut)).otherwise(text)


def one_marker(text: Column, keep: str) -> Column:
    """A marked text with the markers of one entity only."""
    other = {"E1": "E2", "E2": "E1"}[keep]
    return F.trim(F.regexp_replace(text, rf"\[/?{other}\]", ""))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(scores: Column) -> Column:
    """Shares of an array of scores, from differences to the highest."""
    top = F.array_max(scores)
    raised = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def filled(template: str, fields: dict[str, Column]) -> Column:
    """``template`` with each ``{name}`` replaced, in the order of ``fields``; a null field is empty."""
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


#: What is hidden from a model: addresses, account and card numbers, keys. The place of a match names its stand-in.
_PRIVATE = r"[\w.+-]+@[\w-]+\.[\w.-]+|\b(?:\d[ -]?){13,19}\b|\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b|\b(?:sk|pk|ghp|xox[a-z])[_-][A-Za-z0-9_-]{12,}\b|\bAKIA[A-Z0-9]{14,}\b"


def pseudonymized(text: Column) -> Column:
    """struct(text, hidden): private values replaced by ``<PRIVATE_n>``, and the map from stand-in to value."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PRIVATE), F.lit(0)))
    pairs = F.transform(found, lambda x, i: F.struct(F.concat(F.lit("<PRIVATE_"), i.cast("string"), F.lit(">")).alias("k"), x.alias("v")))
    # longer values first: one may be part of another
    order = F.array_sort(pairs, lambda a, b: F.length(b["v"]) - F.length(a["v"]))
    out = F.aggregate(order, F.coalesce(text, F.lit("")), lambda t, p: F.replace(t, p["v"], p["k"]))
    return F.struct(out.alias("text"), F.map_from_entries(pairs).alias("hidden"))


def rehydrated(name: Column, hidden: Column) -> Column:
    """The value that a name stands for; any other name as it is."""
    return F.coalesce(F.try_element_at(hidden, name), name)


def is_reference(name: Column) -> Column:
    return name.startswith("ADR-") | name.startswith("PR #") | name.startswith("PR-") | name.startswith("Issue ")


def garbage_id(name: Column) -> Column:
    return name.rlike("^e[0-9]{0,3}$") | (F.trim(name) == "")


def fuzzy_equal(a: Column, b: Column) -> Column:
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return (x == y) | ((x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x)))


def json_object(text: Column) -> Column:
    """First ``{`` to last ``}`` of a model's answer, thinking and fences aside; null without one."""
    found = F.regexp_extract(F.regexp_replace(text, r"(?s)^.*</think>", ""), r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def human_bytes(n: Column) -> Column:
    step = lambda p, unit: F.concat(F.format_number(n / 1024.0**p, 1), F.lit(unit))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, step(1, " KB")).when(n < 1024**3, step(2, " MB")).otherwise(step(3, " GB"))


def shortened(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last three dots where something was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def verified(content: Column, expected: Column) -> Column:
    """Whether content has the SHA-256 that is expected; a digest that is still pending is not checked."""
    return F.lower(expected).isin("", "pending") | (F.sha2(content, 256) == F.lower(expected))
