"""Which of two entities is the head of a relation: cues in the sentence, then the schema, then the order in the text.

A cue is a pair of columns: whether it speaks, and whether it makes the entity that comes first in the text the head.
The first cue of a relation that speaks decides, so the rules of a relation are a list, and a plan of expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Cue = tuple[Column, Column]

#: Passive verbs whose agent uses the thing, and whose agent provides for it.
USED_BY = ("used by", "scraped by", "consumed by")
PROVIDED_BY = ("managed by", "orchestrated by", "handled by", "powered by", "backed by")
#: Words behind the name of what something runs in.
RUNTIMES = (" runtime", " goroutine", " coroutine")
CONSUMERS, PROVIDERS = ("Service", "Component"), ("Database", "Infrastructure", "Language")


class Pair:
    """A lower-cased sentence and the two entities in the order of the text; positions count from 1, 0 is absent."""

    def __init__(self, sentence: Column, first: Column, second: Column, first_type: Column, second_type: Column):
        self.sentence, self.names = sentence, (first, second)
        self.low = (F.lower(first), F.lower(second))
        self.types = (first_type, second_type)
        self.at = tuple(F.instr(sentence, n) for n in self.low)

    def says(self, *parts: Column | str) -> Column:
        return F.contains(self.sentence, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))

    def place(self, words: str) -> Column:
        return F.instr(self.sentence, F.lit(words))

    def around(self, words: str, before_is_head: bool) -> list[Cue]:
        """One entity before the words and the other behind them."""
        p, (f, s) = self.place(words), self.at
        there = (p > 0) & (f > 0) & (s > 0)
        return [(there & (f < p) & (s > p), F.lit(before_is_head)), (there & (s < p) & (f > p), F.lit(not before_is_head))]

    def behind(self, words: str) -> tuple[Column, Column, Column]:
        """What follows the words, and where the two entities stand in it."""
        rest = F.substring(self.sentence, self.place(words), F.length(self.sentence))
        return rest, F.instr(rest, self.low[0]), F.instr(rest, self.low[1])


def _both(cue: Callable[[int, int], Column]) -> list[Cue]:
    """A cue about one entity (and the other), tried for the first and the second: the one it holds for is the head."""
    return [(cue(0, 1), F.lit(True)), (cue(1, 0), F.lit(False))]


def _replaced(p: Pair) -> list[Cue]:
    """The new thing is the head."""
    moved = lambda new, old: p.says("from ", p.low[old]) & (p.says("to ", p.low[new]) | p.says("to the ", p.low[new]))
    _, ff, fs = p.behind("fallback")
    rest, rf, rs = p.behind("replac")
    falls, swaps = p.place("fallback") > 0, p.place("replac") > 0
    with_it = swaps & F.contains(rest, F.lit(" it ")) & F.contains(rest, F.lit(" with "))
    favour, vf, vs = p.behind("in favor of")
    favours = p.place("in favor of") > 0
    return [
        (moved(1, 0), F.lit(False)),
        (moved(0, 1), F.lit(True)),
        (falls & ((ff > 0) | (fs > 0)), (fs == 0) | ((ff > 0) & (ff < fs))),
        (with_it & ((rf > 0) != (rs > 0)), rf > 0),
        (swaps & (rf > 0) & (rs > 0), rf >= rs),
        (favours & (vs > 0), F.lit(False)),
        (favours & (vf > 0), F.lit(True)),
        *p.around("replac", True),
    ]


def _deprecated(p: Pair) -> list[Cue]:
    """What is said to be deprecated is the tail."""
    passive = [p.says(n, " is deprecated") | p.says(n, " are deprecated") | (p.says(n, "-based") & p.says("deprecated")) for n in p.low]
    return [(passive[0] & ~passive[1], F.lit(False)), (passive[1] & ~passive[0], F.lit(True))]


def _depends_on(p: Pair) -> list[Cue]:
    """What needs the other is the head."""
    size = [F.length(n) for n in p.names]
    languages = (p.types[0] == "Language") & (p.types[1] == "Language")
    cues = [(languages & (size[0] > size[1] + 3), F.lit(True)), (languages & (size[1] > size[0] + 3), F.lit(False))]
    for words in USED_BY:
        by = p.place(words) + words.index("by")
        cues += p.around(words, False)
        # the other entity stands in a sentence beside this one
        cues += [((p.place(words) > 0) & (p.at[k] > by) & (p.at[1 - k] == 0), F.lit(k == 0)) for k in (0, 1)]
    for words in PROVIDED_BY:
        cues += p.around(words, True)
    cues += p.around(" via ", True)
    for words, slack in (("-based", 1), *((w, 4) for w in RUNTIMES)):
        at = p.place(words)
        here = (at > 0) & (p.at[0] > 0) & (p.at[1] > 0)
        for k in (0, 1):  # the name right before the words provides
            cues.append((here & (p.at[k] < at) & (at <= p.at[k] + F.length(p.low[k]) + slack), F.lit(k == 1)))
    cues += _both(lambda a, b: p.types[a].isin(*CONSUMERS) & p.types[b].isin(*PROVIDERS))
    serves = [(t == "Service") | F.endswith(n, F.lit("Service")) for t, n in zip(p.types, p.names, strict=True)]
    return [*cues, *_both(lambda a, b: serves[a] & ~serves[b])]


_CUES: dict[str, Callable[[Pair], list[Cue]]] = {"replaced": _replaced, "deprecated": _deprecated, "depends_on": _depends_on}


def first_is_head(relation: Column, pair: Pair, forward: Column, backward: Column) -> Column:
    """Whether the entity that comes first is the head.

    ``forward`` and ``backward``: whether the schema admits the first, or the second, as head. Where neither a cue nor
    the schema decides, the order of the text does.
    """
    cues = [F.when((relation == name) & F.coalesce(speaks, F.lit(False)), verdict) for name, made in _CUES.items() for speaks, verdict in made(pair)]
    return F.coalesce(*cues, F.when(forward & ~backward, F.lit(True)).when(backward & ~forward, F.lit(False)), F.lit(True))


#: Verbs whose subject is the head, and signs of a limit.
ACTIVE = {"depends_on": ("uses", "relies on", "depends on", "requires", "connects to", "calls"), "introduced": ("introduced", "added", "brought in", "set up")}
LIMITS = ("sla", "qps", "compliance", "policy", "latency", "budget", "limit", "quota", "regulation")


def turned_by_phrase(text: Column, relation: Column, head: Column, tail: Column) -> Column:
    """Whether a phrase of the text says that ``tail`` is the head: for classified pairs, on the whole text."""
    low, h, t = F.lower(text), F.lower(head), F.lower(tail)
    says = lambda *parts: F.contains(low, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]))
    out = F.lit(False)
    for name, verbs in ACTIVE.items():
        for verb in verbs:
            out = out | ((relation == name) & says(t, f" {verb} ", h))
    out = out | ((relation == "replaced") & (says("from ", h, " to ", t) | says(h, " was replaced by ", t)))
    limit = lambda x: x.rlike("|".join(LIMITS))
    return out | ((relation == "constrained_by") & limit(h) & ~limit(t))
