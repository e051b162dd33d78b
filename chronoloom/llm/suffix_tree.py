"""Language-model scores by a probabilistic suffix tree over words.

Counts come from every training text. The tree's root is the add-one unigram distribution. It grows round by round:
strings of L words (a text begins with a mark and finishes with its end) are counted behind every context of L - 1 words
that is live, and kept from LEAST occurrences, at any size of input. A context whose next-word distribution diverges
from that of its suffix by at least DIVERGENCE nats becomes a state; every word is live, and a kept string whose suffix
is a state. The tree is done when a round adds no state, or at DEPTH words of context. A state's distribution keeps the counts of its
kept strings and smooths the rest, plus PRIOR observations, with its suffix's. Each token is scored in the longest
state that its predecessors end in.

A text's score is a sum over its strings: every word, kept string and state has one weight (``weights``), so the tree,
which grows with the corpus, stays a table that meets the texts in one join. Strings of at least HOT_SHARE of all
tokens, at most DEPTH + 1 times 1 / HOT_SHARE of them, are looked up beforehand and so are no frequent keys of the join.
Strings that no sieve of fixed size has seen are not sent; what it lets through in error finds nothing in the join.

Texts are cut into words once: a row of that table holds a run of texts, as codes into the run's distinct word hashes.
Every later pass reads it; what a task has counted it deals out by hash as arrays, one row a partition, so that a
shuffle moves few rows, whatever their content. Words and strings are compared by 64-bit hash: with ten billion
distinct ones under three pairs are expected to share one. Every step is written out and its shuffle files go when it
ends; texts are scored in GROUPS groups, one after the other, so that the words of one group are on their way at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, materialize
from .wordhash import hashed_words

LEAST = 5
#: Words of the longest context.
DEPTH = 4
DIVERGENCE = 0.02
PRIOR = 20.0
#: Strings of this share of all tokens are looked up in the tasks that read the texts, not in the join.
HOT_SHARE = 2e-6
#: Bits of a sieve, and where in a key the places of its bits begin. More strings only let more rows through in error.
SIEVE_BITS, PROBES = 1 << 27, (0, 18, 36)
#: Strings that a task counts before it deals them out.
FLUSH_GRAMS = 800_000
#: Strings, about, that one task of a shuffle gets.
PER_TASK = 1_500_000
#: Groups of texts that are scored one after the other. More take less disk, and deal the table more often.
GROUPS = 4

#: Stand for the end of a text, counted as a token, and for its beginning, which is none.
END_HASH, START_HASH = -0x5EED_0E0D, -0x5EED_57A7


def joined_hash(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64(x, y)`` of two int64 arrays."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda a, n: (a << np.uint64(n)) | (a >> np.uint64(64 - n))
    h = np.full(len(x), 42, np.uint64)
    for value in (x, y):
        h = h + p5 + np.uint64(8)
        h ^= turned(value.view(np.uint64) * p2, 31) * p1
        h = turned(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _runs(batches):
    """Runs of texts of one kind, each text as the hashes of its words between a start and an end."""

    def run(batch, at: int, words: np.ndarray, counts: np.ndarray, train: np.ndarray, kind: bool):
        mine = np.flatnonzero(train == kind)
        if not len(mine):
            return None
        sizes = counts[mine] + 2
        row = np.repeat(np.arange(len(counts)), counts)
        own = words[train[row] == kind]
        out = np.empty(sizes.sum(), np.int64)
        ends = np.cumsum(sizes)
        inner = np.ones(len(out), bool)
        inner[ends - 1] = inner[ends - sizes] = False
        out[ends - sizes], out[ends - 1], out[inner] = START_HASH, END_HASH, own
        coded = pc.dictionary_encode(pa.array(out))
        code, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        code = code.astype(np.uint16 if len(distinct) < 1 << 16 else np.uint32)
        held = [batch.column(c).take(pa.array(mine + at)) for c in ("rid", "doc_id")]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), x) for x in (*held, pa.array(sizes))]
        return pa.RecordBatch.from_arrays([pa.array([kind]), *lists, pa.array([code.tobytes()], pa.binary()), pa.array([distinct.tobytes()], pa.binary())], ["train", "rids", "doc_ids", "lengths", "codes", "words"])

    for batch in batches:
        train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
        for at, words, counts in hashed_words(batch.column("text")):
            for kind in (True, False):
                made = run(batch, at, words.view(np.int64), counts, train[at : at + len(counts)], kind)
                if made is not None:
                    yield made


def _read(batch):
    """(row, words of a run of texts as hashes, places in the text, texts' lengths)."""
    for i in range(batch.num_rows):
        lengths = batch.column("lengths")[i].values.to_numpy()
        distinct = np.frombuffer(batch.column("words")[i].as_buffer(), np.int64)
        codes = np.frombuffer(batch.column("codes")[i].as_buffer(), np.uint16 if len(distinct) < 1 << 16 else np.uint32)
        yield i, distinct[codes], np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths), lengths


_DEALT = "p int, kind int, data binary"
#: Kinds of dealt rows, in the order in which a task wants them. What was counted once is dealt without its count.
_TABLE, _FAR, _FAR_ONCE, _OWN, _SUMS, _ONCE = 0, 1, 2, 3, 4, 5


def _deal(columns: list[np.ndarray], parts: int, kind: int, key: np.ndarray | None = None) -> pa.RecordBatch:
    """Arrays of 8-byte values, dealt by the upper bits of the key (the first of them): one row for each part that gets any."""
    pa.default_memory_pool().release_unused()
    rows = np.stack([c.view(np.int64) for c in columns])
    key = (rows[0] if key is None else key).view(np.uint64)
    if len(key) > 1 and not (key[1:] >= key[:-1]).all():
        order = np.argsort(key)
        rows, key = rows[:, order], key[order]
    part = ((key >> np.uint64(34)) * np.uint64(parts) >> np.uint64(30)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else np.zeros(1, np.int64)
    data = [np.ascontiguousarray(rows[:, lo:hi]).tobytes() for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    held = pa.array(part[cuts[:-1]] if len(part) else [], pa.int32())
    return pa.RecordBatch.from_arrays([held, pa.array([kind] * len(data), pa.int32()), pa.array(data, pa.binary())], ["p", "kind", "data"])


def _deal_counts(columns: list[np.ndarray], n: np.ndarray, parts: int, kinds: tuple[int, int], key: np.ndarray | None = None):
    """Columns with their counts, in two batches: those counted more than once, and without the counts those that were not."""
    for kind, mine in zip(kinds, (n > 1, n == 1), strict=True):
        if mine.any():
            held = [c[mine] for c in columns]
            yield _deal(held + ([n[mine]] if kind == kinds[0] else []), parts, kind, None if key is None else key[mine])


def _dealt(batch, width: dict[int, int]):
    """(kind, arrays) of each row; ``width``: columns of each kind."""
    for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data"), strict=True):
        yield kind, np.frombuffer(data.as_buffer(), np.int64).reshape(width[kind], -1)


def _parts(spark, strings: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-strings // PER_TASK))


def _summed(names: tuple[str, ...], least: int):
    """Counts by key over all that a task gets, from ``least``: of words (h, c), or of strings (key, x, y, n), whose key is a hash."""
    width = 1 if len(names) == 2 else 2

    def run(batches):
        kept = []
        for batch in batches:
            for kind, data in _dealt(batch, {_TABLE: width + 1, _ONCE: width}):
                kept.append(data if kind == _TABLE else np.concatenate([data, np.ones((1, data.shape[1]), np.int64)]))
        if not kept:
            return
        rows = np.concatenate(kept, 1)
        if width == 2:
            rows = np.concatenate([joined_hash(rows[0], rows[1])[None], rows])
        order = np.argsort(rows[0])
        ordered = rows[0][order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        total = np.add.reduceat(rows[-1][order], first)
        stay = np.flatnonzero(total >= least)
        columns = [*(c[order[first[stay]]] for c in rows[:-1]), total[stay]]
        for at in range(0, len(stay), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in columns], list(names))

    return run


def _longer(keys: np.ndarray) -> np.ndarray:
    """From the hashes of the strings that end at each place, those of the strings one word longer."""
    return np.concatenate([keys[:1], joined_hash(keys[:-1], keys[1:])])


def _sieve(table: DataFrame, key: str) -> np.ndarray:
    """A bit array of fixed size in which every key of ``table`` has its bits."""
    places = table.select(F.explode(F.array(*[F.shiftrightunsigned(key, shift).bitwiseAND(SIEVE_BITS - 1) for shift in PROBES])).alias("b"))
    found = places.select(F.shiftright("b", 6).cast("int").alias("at"), F.expr("shiftleft(1L, cast(b & 63L as int))").alias("bit"))
    rows = found.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(SIEVE_BITS // 64, np.int64)
    bits[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return bits.view(np.uint8)


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys), bool)
    left = np.arange(len(keys))
    for shift in PROBES:
        at = (keys[left].view(np.uint64) >> np.uint64(shift)).astype(np.int64) & (SIEVE_BITS - 1)
        left = left[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
    out[left] = True
    return out


@contextmanager
def _shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files are deleted when it ends, not when the driver's garbage is collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in unsigned order, where one of each stands, and how often."""
    order = np.argsort(keys.view(np.uint64))
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.empty(0, np.int64)
    return ordered[first], order[first], np.diff(np.append(first, len(keys)))


def _count_words(parts: int):
    def run(batches):
        kept, held = [], 0
        for batch in batches:
            for _, words, places, _ in _read(batch):
                h, _, n = _tally(words[places > 0])
                kept.append(np.stack([h, n]))
                held += len(h)
                if held > FLUSH_GRAMS:
                    yield from _deal_counts(*_merged(kept), parts, (_TABLE, _ONCE))
                    kept, held = [], 0
        if kept:
            yield from _deal_counts(*_merged(kept), parts, (_TABLE, _ONCE))

    return run


def _merged(tallies: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    both = np.concatenate(tallies, 1)
    both = both[:, np.argsort(both[0].view(np.uint64))]
    first = np.flatnonzero(np.concatenate([[True], both[0][1:] != both[0][:-1]]))
    return [both[0][first]], np.add.reduceat(both[1], first)


def _count_grams(length: int, shipped, parts: int):
    """Counts of strings of ``length`` words by key, with the hashes of all but the last (x) and all but the first word (y)."""

    def run(batches):
        live, often = shipped.value
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def flush():
            x, y = (np.concatenate([k[i] for k in kept]) for i in (0, 1))
            key, first, n = _tally(joined_hash(x, y))
            return _deal_counts([x[first], y[first]], n, parts, (_TABLE, _ONCE), key)

        for batch in batches:
            for _, keys, places, _ in _read(batch):
                for _ in range(length - 2):
                    keys = _longer(keys)
                spots = np.flatnonzero(places[1:] >= length - 1)
                spots = spots[_passes(live, keys[spots])] + 1
                spots = spots[_passes(often, keys[spots])]
                kept.append((keys[spots - 1], keys[spots]))
                held += len(spots)
                if held > FLUSH_GRAMS:
                    yield from flush()
                    kept, held = [], 0
        if held:
            yield from flush()

    return run


def cut_texts(documents: DataFrame) -> DataFrame:
    """Runs of texts, written out: whether to train on them, numbers of their own, doc_ids, lengths, and words as codes."""
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    rows = documents.select(F.monotonically_increasing_id().alias("rid"), doc_id, (~held_out(F.col("doc_id"))).alias("train"), F.col("text").cast("string").alias("text"))
    kind = "train boolean, rids array<long>, doc_ids array<long>, lengths array<long>, codes binary, words binary"
    return materialize(rows.mapInArrow(_runs, kind), {"compression": "zstd"})


def _groups(cut: DataFrame) -> list[DataFrame]:
    """The rows of ``cut`` by its files, in GROUPS parts at most."""
    files = sorted(unquote(f) for f in cut.inputFiles())
    return [cut.sparkSession.read.schema(cut.schema).parquet(*files[k::GROUPS]) for k in range(min(GROUPS, len(files)))] or [cut]


def weights(cut: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, int, int, int]:
    """Table (h, n, c, w) of the training texts of ``cut``, their tokens and distinct words, and words of the longest string.

    A row is a word (c its count, else 0) or a longer string, or the start. w is what it adds to the base-10 log
    probability of a text beside the words' own: as a kept string, what its count changes in the probability of its
    last word; as a state, the weight left to its suffix at the next word. n: occurrences.
    """
    spark = cut.sparkSession
    texts = cut.where("train").select("lengths", "codes", "words")
    tokens = texts.select(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts_n = _parts(spark, tokens)
    dealt = texts.mapInArrow(_count_words(parts_n), _DEALT).repartitionById(parts_n, F.col("p"))
    counts = materialize(dealt.mapInArrow(_summed(("h", "c"), 1), "h long, c long"))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    start = counts.where(F.col("h") == END_HASH).select(F.lit(START_HASH).alias("key"), F.col("c").alias("n"), F.lit(0.0).alias("lp"))
    below = counts.select(F.col("h").alias("key"), F.col("c").alias("n"), F.log10((F.col("c") + 1) / F.lit(float(n + v + 1))).alias("lp")).unionByName(start)
    parts = [counts.select("h", F.col("c").alias("n"), "c", F.lit(0.0).alias("w"))]
    parts.append(start.select(F.col("key").alias("h"), "n", F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("w")))
    used = [counts]
    live = below.select("key", "n")  # the suffix of one word is the root
    for length in range(2, depth + 2):
        sieves = (_sieve(live.where(F.col("n") >= LEAST), "key"), _sieve(below.where(F.col("n") >= LEAST), "key"))
        if not sieves[0].any():
            length -= 1
            break
        shipped = spark.sparkContext.broadcast(sieves)
        dealt = texts.mapInArrow(_count_grams(length, shipped, parts_n), _DEALT).repartitionById(parts_n, F.col("p"))
        grams = materialize(dealt.mapInArrow(_summed(("key", "x", "y", "n"), LEAST), "key long, x long, y long, n long"))
        shipped.unpersist()
        # inner joins: what the sieves let through in error goes. Frequent contexts are split by the engine's skew join
        rows = grams.join(live.select(F.col("key").alias("x"), F.col("n").alias("total")), "x").join(below.select(F.col("key").alias("y"), F.col("lp").alias("low")), "y")
        rows = materialize(rows)
        discard(grams)
        own, low = F.col("n") / F.col("total"), F.pow(F.lit(10.0), "low")
        sums = rows.groupBy("x").agg(F.max("total").alias("total"), F.sum("n").alias("kept"), F.sum(own * F.log(own / low)).alias("gap"), F.sum(low).alias("known"))
        left = F.col("total") - F.col("kept")
        other = F.greatest(1.0 - F.col("known"), F.lit(1e-12))
        gap = F.col("gap") + F.when(left > 0, left / F.col("total") * F.log(left / F.col("total") / other)).otherwise(0.0)
        states = materialize(sums.where(gap >= DIVERGENCE).select("x", ((left + PRIOR) / (F.col("total") + PRIOR)).alias("back")))
        # strings behind contexts that are no states weigh nothing
        lp = F.log10(F.col("n") / (F.col("total") + PRIOR) + F.col("back") * low)
        below = materialize(rows.join(states, "x").select("key", "n", lp.alias("lp"), (lp - F.col("low") - F.log10("back")).alias("w")))
        parts.append(below.select(F.col("key").alias("h"), "n", F.lit(0).cast("long").alias("c"), "w"))
        parts.append(states.select(F.col("x").alias("h"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("c"), F.log10("back").alias("w")))
        used += [rows, states, below]
        live = rows.join(states.select(F.col("x").alias("sx")), F.col("y") == F.col("sx"), "left_semi").select("key", "n")
        if length <= depth:
            live = materialize(live)
            used.append(live)
    table = materialize(reduce(DataFrame.unionByName, parts).groupBy("h").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum("w").alias("w")))
    for frame in used:
        discard(frame)
    return table, int(n), int(v), length


class _Lookup:
    """Places of keys in an array by open addressing: a vectorised hash table, since the keys are hashes themselves."""

    def __init__(self, keys: np.ndarray):
        self.mask = (1 << max(4, int(2 * len(keys)).bit_length())) - 1
        self.place = np.full(self.mask + 1, -1, np.int32)
        self.keys = np.append(keys, 0)
        left, slot = np.arange(len(keys)), keys & self.mask
        while len(left):
            free = self.place[slot] < 0
            self.place[slot[free]] = left[free]  # of several for one slot the last stays
            lost = self.place[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 if it has none."""
        slot = keys & self.mask
        out = self.place[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & self.mask
            at = self.place[slot]
            out[open_] = at
            more = (at >= 0) & (self.keys[at] != keys[open_])
            open_, slot = open_[more], slot[more]
        return out


def _score_rows(shipped, longest: int, parts: int):
    """Each text's sums over hot strings, dealt by text, and its other words and strings, dealt by string."""

    def run(batches):
        hot, hot_c, hot_w, bits = shipped.value
        table, hot_log = _Lookup(hot), np.log10(hot_c + 1.0)
        for batch in batches:
            for i, keys, places, lengths in _read(batch):
                k = len(lengths)
                rid, ids = batch.column("rids")[i].values.to_numpy(), batch.column("doc_ids")[i].values
                text = np.repeat(np.arange(k), lengths)
                plain, model, others = np.zeros(k), np.zeros(k), np.zeros(k, np.int64)
                far_keys, far_texts = [], []
                for length in range(1, longest + 1):
                    if length == 1:
                        spots = np.arange(len(keys))
                    else:
                        keys = _longer(keys)
                        # what follows the first word of a kept string or state is one too
                        spots = spots[places[spots] >= length - 1] if length > 2 else np.flatnonzero(places > 0)
                        spots = spots[_passes(bits, keys[spots])]
                    found = table.find(keys[spots])
                    hit = found >= 0
                    near, found = spots[hit], found[hit]
                    model += np.bincount(text[near], hot_w[found], k)
                    far = spots[~hit]
                    if length == 1:
                        plain += np.bincount(text[near], hot_log[found], k)
                        far = far[places[far] > 0]
                        others += np.bincount(text[far], minlength=k)
                    far_keys.append(keys[far])
                    far_texts.append(text[far])
                h, owner = np.concatenate(far_keys), np.concatenate(far_texts)
                _, first, tf = _tally(joined_hash(owner.astype(np.int64), h))
                yield from _deal_counts([h[first], rid[owner[first]]], tf, parts, (_FAR, _FAR_ONCE))
                lost = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                yield _deal([rid, ids.fill_null(0).to_numpy(), lost, lengths - 1, others, plain, model], parts, _OWN, _spread(rid))

    return run


def _spread(rid: np.ndarray) -> np.ndarray:
    return joined_hash(rid, np.full(len(rid), END_HASH))


def _table_rows(parts: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield _deal([batch.column(c).to_numpy() for c in ("ch", "c", "w")], parts, _TABLE)

    return run


_WIDTH = {_TABLE: 3, _FAR: 3, _FAR_ONCE: 2, _OWN: 7, _SUMS: 4}


def _weighed(parts: int):
    """Sums by text over the strings of one part. The part's table comes first; rows of texts pass on."""

    def run(batches):
        table, lookup = [], None
        kept: list[np.ndarray] = []
        held = 0

        def flush():
            rid, known, rare, far = (np.concatenate([k[i] for k in kept]) for i in range(4))
            code = pc.dictionary_encode(pa.array(rid))
            at, own = code.indices.to_numpy(), code.dictionary.to_numpy()
            known, rare, far = (np.bincount(at, x, len(own)) for x in (known, rare, far))
            return _deal([own, known.astype(np.int64), rare, far], parts, _SUMS, _spread(own))

        for batch in batches:
            for kind, data in _dealt(batch, _WIDTH):
                if kind == _TABLE:
                    table.append(data)
                    continue
                if kind == _OWN:
                    yield _deal(list(data), parts, _OWN, _spread(data[0]))
                    continue
                if lookup is None:
                    entries = np.concatenate(table, 1) if table else np.empty((3, 0), np.int64)
                    lookup, c, w = _Lookup(entries[0]), np.append(entries[1], 0), np.append(entries[2].view(np.float64), 0.0)
                h, rid, *tf = data
                tf = tf[0] if tf else np.ones(len(h), np.int64)
                at = lookup.find(h)  # what has no entry takes the last place: neither count nor weight
                some = np.flatnonzero(at >= 0)
                at, rid, tf = at[some], rid[some], tf[some]
                kept.append((rid, tf * (c[at] > 0), tf * np.log10(c[at] + 1.0), tf * w[at]))
                held += len(rid)
                if held > FLUSH_GRAMS:
                    yield flush()
                    kept, held = [], 0
        if held:
            yield flush()

    return run


def _texts_of_part(batches):
    """One row a text: what it brought along and the sums of all parts."""
    own, sums = [], []
    for batch in batches:
        for kind, data in _dealt(batch, _WIDTH):
            (own if kind == _OWN else sums).append(data)
    if not own:
        return
    own = np.concatenate(own, 1)
    k = own.shape[1]
    spread = _spread(own[0])
    lookup = _Lookup(spread)
    known, rare, far = np.zeros(k, np.int64), np.zeros(k), np.zeros(k)
    if sums:
        rows = np.concatenate(sums, 1)
        at = lookup.find(_spread(rows[0]))
        known = np.bincount(at, rows[1], k).astype(np.int64)
        rare, far = (np.bincount(at, rows[i].view(np.float64), k) for i in (2, 3))
    plain, model = own[5].view(np.float64), own[6].view(np.float64)
    doc_id = pa.array(own[1], mask=own[2] == 1)
    names = ["doc_id", "n", "known", "plain", "model"]
    columns = [doc_id, pa.array(own[3]), pa.array(own[3] - own[4] + known), pa.array(plain + rare), pa.array(model + far)]
    for at in range(0, k, 50_000):
        yield pa.RecordBatch.from_arrays([c.slice(at, 50_000) for c in columns], names)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def _scored(cut: DataFrame, table: DataFrame, n: int, longest: int) -> DataFrame:
    """Sums over the words and strings of each text, written out group by group."""
    spark = cut.sparkSession
    often = (F.col("n") >= HOT_SHARE * n) | F.col("h").isin(START_HASH, END_HASH)
    weighty = (F.col("c") > 0) | (F.col("w") != 0)
    top = table.where(often & weighty).toArrow()
    bits = _sieve(table.where((F.col("c") == 0) & weighty), "h")
    shipped = spark.sparkContext.broadcast((*(top[x].to_numpy() for x in ("h", "c", "w")), bits))
    groups = _groups(cut)
    parts = _parts(spark, 2 * n // len(groups))
    rarer = table.where(~often & weighty).select(F.col("h").alias("ch"), "c", "w").mapInArrow(_table_rows(parts), _DEALT)
    done = []
    for group in groups:
        texts = group.mapInArrow(_score_rows(shipped, longest, parts), _DEALT)
        # a task's share of the table comes before the strings that are looked up in it
        met = texts.unionByName(rarer).repartitionById(parts, F.col("p")).sortWithinPartitions("kind").mapInArrow(_weighed(parts), _DEALT)
        done.append(materialize(met.repartitionById(parts, F.col("p")).mapInArrow(_texts_of_part, "doc_id long, n long, known long, plain double, model double")))
    shipped.unpersist()
    return reduce(DataFrame.unionByName, done)


def score_corpus(documents: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``documents``.

    Learns from the rows that are not held out. A null text is empty and has one token, its end; a null doc_id is not
    held out; repeated rows count as often as they occur and are scored one by one. A doc_id is read as a long; other
    columns are not read. Without training rows every text has the probability of unknown words; an empty table gives
    an empty one. Texts of any length are read whole.
    """
    with _shuffles_let_go(documents.sparkSession):
        cut = cut_texts(documents)
        table, n, v, longest = weights(cut, depth)
        sums = _scored(cut, table, n, longest)
    discard(cut)
    discard(table)
    base = F.col("plain") - F.col("n") * math.log10(n + v + 1)
    return sums.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (base + F.col("model")).alias("score"),
    )


#: DuckDB SQL of all columns but ``score``, over the table ``documents``; ``held`` lists held-out ids, since DuckDB has no crc32.
BASE_SQL = r"""
WITH w AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM held) AS held_out, unnest(list_append(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), '')) AS t FROM documents),
c AS (SELECT t, count(*) AS c FROM w WHERE NOT held_out GROUP BY 1), s AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(n) AS train_tokens, sum(log10((coalesce(c.c, 0) + 1) / (n + v + 1))) AS base_score
FROM w LEFT JOIN c USING (t), s GROUP BY 1, 2
"""
