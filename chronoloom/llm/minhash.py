"""Near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has T coordinates. In round i < T every shingle is hashed to a bin and a value; a bin that is still empty
takes the least value that fell into it. Round T + b fills bin b from all shingles, so after 2T rounds none is empty;
sets of a few hundred shingles fill all bins in one or two rounds. A coordinate of two sets agrees with probability
equal to their Jaccard similarity, and the sum of agreements concentrates like independent draws.

Candidates come from bands of coordinates: 32 bands of 4 miss a link at similarity 0.8 with probability 5e-8. Texts
with equal sets are one node from the start. In each bucket every node is first checked against one leader, which
joins most groups in a number of pairs linear in their size. Whatever buckets still hold nodes of several components
is then compared whole, in blocks bounded by nodes and by shingles: sketches go first, and the full sets of nodes with
a partner of another component whose sketch may reach the threshold follow. Such pairs are verified in the task, each
in the first bucket that both share, and only links that join two components come out, so the rows stay linear. No
bucket is capped and no link between components is given up. Tables that grow with the input meet by sorted merge at
every size, so a plan that works on a part of the data is the plan for all of it.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize, quoted

T, BANDS = 128, 32
#: Coordinates that agree, of T, below which a pair is not verified: 4.9 standard deviations under 0.8 * T.
LEAST_AGREEMENTS = 80
#: Nodes, and shingles of all their sets, of one block when a bucket is compared whole.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
#: Nodes whose keys (32 bytes each) may be broadcast to fetch their texts; beyond it the texts are joined by shuffle.
BROADCAST_NODES = 500_000
_SEEDS = np.random.default_rng(20240).integers(1, 2**63, 2 * T, dtype=np.uint64)
_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


def shingles(text: bytes, known: _WordHash, width: int = 2) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; fewer words: one shingle; none: empty."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    span = min(width, n)
    out = np.full(n - span + 1, span, np.uint64)
    for k in range(span):
        out = _mix(out * _M3 + hashes[k : n - span + 1 + k])
    return np.unique(out)


def sketch(items: np.ndarray, t: int = T) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of hashes; ``t`` is a power of two."""
    shift = np.uint64(64 - t.bit_length() + 1)
    out = np.zeros(t, np.uint64)
    empty = np.ones(t, bool)
    for i in range(t):
        hashed = np.sort(_mix(items ^ _SEEDS[i]))
        bins = hashed >> shift
        first = np.concatenate([[True], bins[1:] != bins[:-1]])
        at, values = bins[first].astype(np.int64), hashed[first]
        new = empty[at]
        out[at[new]] = values[new]
        empty[at] = False
        if not empty.any():
            return out
    for b in np.flatnonzero(empty).tolist():
        out[b] = _mix(items ^ _SEEDS[t + b]).min()
    return out


def bands_of(coordinates: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = coordinates.reshape(bands, -1)
    out = np.arange(bands, dtype=np.uint64)
    for k in range(rows.shape[1]):
        out = _mix(out * _M3 + rows[:, k])
    return out.view(np.int64)


def _set_key(items: np.ndarray) -> bytes | None:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None


def _signatures(width: int):
    def run(batches):
        known = _WordHash()
        for batch in batches:
            keys, sizes, bands, sketches = [], [], [], []
            for text in batch.column("text").cast(pa.binary()):
                items = shingles(text.as_py() or b"", known, width)
                key = _set_key(items)
                keys.append(key)
                sizes.append(len(items))
                made = sketch(items) if key else None
                bands.append(bands_of(made) if key else None)
                sketches.append((made & np.uint64(255)).astype(np.uint8).tobytes() if key else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["doc_id", "h", "n_shingles", "node", "bands", "sketch"],
            )

    return run


def _sets(width: int):
    def run(batches):
        known = _WordHash()
        for batch in batches:
            sets, keys = [], []
            for text in batch.column("text").cast(pa.binary()):
                items = shingles(text.as_py() or b"", known, width)
                sets.append(items.view(np.int64))
                keys.append(_set_key(items))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["node", "items"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the least node that it reaches.

    Each round takes the least root of the neighbours, then the root's root, so chains halve. Rows stay distributed;
    the tables that each round reads are files, so a hub's rows can be split between tasks.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")))
    roots = materialize(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        near = edges.join(roots.hint("merge"), edges["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("m"))
        step = materialize(roots.join(near.hint("merge"), roots["node"] == near["a"], "left").select("node", F.least("root", "m").alias("root"), F.col("root").alias("was")))
        up = step.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        jumped = materialize(step.join(up.hint("merge"), step["root"] == up["n2"], "left").select("node", F.least("root", "r2").alias("root"), "was"))
        changed = jumped.where("root <> was").limit(1).count()
        discard(step)
        discard(roots)
        roots = jumped.select("node", "root")
        if not changed:
            discard(edges)
            return roots


class _Bucket:
    """Rows of one block pair of a bucket. Pairs worth verifying lie in different components."""

    def __init__(self, key: tuple[int, int, int, int]):
        self.key = key
        self.blocks, self.nodes, self.roots, self.sizes, self.marks, self.bands, self.items = ([] for _ in range(7))

    def _ready(self) -> bool:
        names = sorted(set(self.roots))
        if len(names) < 2:
            return False
        _, self.number, i, j = self.key
        place = {name: k for k, name in enumerate(names)}
        self.root = np.array([place[r] for r in self.roots])
        self.size = np.array(self.sizes, np.float64)
        self.mark = np.frombuffer(b"".join(self.marks), np.uint8).reshape(-1, T)
        self.band = np.stack(self.bands)
        block, everyone = np.array(self.blocks), np.arange(len(self.root))
        self.same = i == j
        self.left, self.right = (everyone, everyone) if self.same else (everyone[block == i], everyone[block == j])
        return True

    def _partners(self, x: int) -> np.ndarray:
        """Rows of other components whose sketch may reach the threshold and that meet ``x`` first in this bucket."""
        y = self.right[self.right > x] if self.same else self.right
        y = y[(self.root[y] != self.root[x]) & (100 * np.minimum(self.size[x], self.size[y]) >= 80 * np.maximum(self.size[x], self.size[y]))]
        y = y[(self.mark[y] == self.mark[x]).sum(1) >= LEAST_AGREEMENTS]
        return y[(self.band[y] == self.band[x]).argmax(1) == self.number]

    def suspects(self) -> list[tuple]:
        """Nodes with a partner, and the key of the block pair."""
        if not self._ready():
            return []
        found: set[int] = set()
        for x in self.left.tolist():
            y = self._partners(x).tolist()
            found.update([x, *y] if y else ())
        return [(*self.key, self.nodes[x]) for x in sorted(found)]

    def links(self) -> list[tuple]:
        """Verified pairs that join two components, one a join."""
        if not self._ready():
            return []
        out = []
        for x in self.left.tolist():
            for k in self._partners(x).tolist():
                if self.root[k] == self.root[x]:
                    continue
                a, b = self.items[x], self.items[k]
                shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                if 100 * shared >= 80 * (len(a) + len(b) - shared):
                    out.append((self.nodes[x], self.nodes[k]))
                    self.root[self.root == self.root[k]] = self.root[x]
        return out


def _per_bucket(find, schema: pa.Schema):
    """``find`` over each group of rows with equal (band, number, i, j), which arrive sorted by it."""

    def batch_of(rows):
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches):
        bucket = None
        for batch in batches:
            out = []
            keys = zip(*(batch.column(c).to_pylist() for c in ("band", "number", "i", "j")), strict=True)
            rest = zip(*(batch.column(c).to_pylist() for c in ("block", "node", "root", "n", "sketch")), strict=True)
            items = batch.column("items") if "items" in batch.schema.names else itertools.repeat(None, batch.num_rows)
            for key, (block, node, root, n, mark), bands, own in zip(keys, rest, batch.column("bands"), items, strict=True):
                if bucket is None or key != bucket.key:
                    out += find(bucket) if bucket else []
                    bucket = _Bucket(key)
                bucket.blocks.append(block)
                bucket.nodes.append(node)
                bucket.roots.append(root)
                bucket.sizes.append(n)
                bucket.marks.append(mark)
                # copies, so that a batch is not kept for one of its rows
                bucket.bands.append(bands.values.to_numpy().copy())
                if own is not None:
                    bucket.items.append(own.values.to_numpy().view(np.uint64).copy())
            yield batch_of(out)
        if bucket:
            yield batch_of(find(bucket))

    return run


_PAIR_KEY = ["band", "number", "i", "j"]
_SUSPECT = pa.schema([("band", pa.int64()), ("number", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("node", pa.binary())])
_LINK = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _texts(documents: DataFrame) -> DataFrame:
    """(doc_id, h, text): h, a hash of the text, names a text where doc_id is null or repeats."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()).alias("h"), F.col("text").cast("string").alias("text"))


def _node_sets(wanted: DataFrame, documents: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """(node, items): the sets of the nodes ``wanted`` (w, distinct), each from its least row, written out."""
    ids = reps.join(wanted, reps["node"] == wanted["w"], "left_semi").select(F.col("rep.doc_id").alias("id"), F.col("rep.h").alias("ih"))
    side = F.broadcast(ids) if wanted.count() <= BROADCAST_NODES else ids
    found = _texts(documents).join(side, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("ih")), "left_semi").select("text")
    # rows with equal doc_id and text give the same set more than once
    return materialize(found.mapInArrow(_sets(width), "node binary, items array<long>").groupBy("node").agg(F.first("items").alias("items")))


def _verified(pairs: DataFrame, documents: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have 100 * intersection >= 80 * union, written out."""
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("w")).distinct())
    sets = _node_sets(wanted, documents, reps, width)
    left = pairs.join(sets.select(F.col("node").alias("nb"), F.col("items").alias("ib")).hint("merge"), F.col("b") == F.col("nb")).select("a", "b", "ib")
    both = left.join(sets.select(F.col("node").alias("na"), F.col("items").alias("ia")).hint("merge"), F.col("a") == F.col("na"))
    shared = F.size(F.array_intersect("ia", "ib"))
    links = materialize(both.select("a", "b", shared.alias("s"), (F.size("ia") + F.size("ib")).alias("t")).where("100 * s >= 80 * (t - s)").select("a", "b"))
    for used in (wanted, sets):
        discard(used)
    return links


def _open_links(members: DataFrame, roots: DataFrame, documents: DataFrame, reps: DataFrame, width: int) -> DataFrame | None:
    """Links (a, b) between the components that still meet in a bucket, written out; none if no bucket holds two."""
    rooted = members.join(roots.withColumnRenamed("node", "rn").hint("merge"), members["node"] == F.col("rn"), "left").select("band", "number", "node", "c", "shingles", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted)
    split = materialize(rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(F.col("band").alias("sb")))
    n_blocks = F.ceil(F.greatest(F.col("c") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    open_ = rooted.join(split.hint("merge"), rooted["band"] == split["sb"], "left_semi").withColumn("block", F.pmod(F.xxhash64("node"), n_blocks).cast("int"))
    others = F.explode(F.sequence(F.lit(0), n_blocks - 1))
    spread = open_.select("band", "number", "node", "root", "block", others.alias("other"))
    spread = materialize(spread.select("band", "number", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root"))
    used = [rooted, split, spread]
    marks = reps.select(F.col("node").alias("mn"), F.col("n").cast("int").alias("n"), "sketch", "bands")
    dealt = lambda rows: rows.repartition(*_PAIR_KEY).sortWithinPartitions(*_PAIR_KEY)
    sketched = spread.join(marks.hint("merge"), F.col("node") == F.col("mn")).drop("mn")
    suspects = materialize(dealt(sketched).mapInArrow(_per_bucket(_Bucket.suspects, _SUSPECT), "band long, number int, i int, j int, node binary"))
    used.append(suspects)
    added = None
    if suspects.limit(1).count():
        wanted = materialize(suspects.select(F.col("node").alias("w")).distinct())
        sets = _node_sets(wanted, documents, reps, width)
        marked = marks.join(sets.withColumnRenamed("node", "sn").hint("merge"), F.col("mn") == F.col("sn")).drop("sn")
        sent = spread.join(suspects.hint("merge"), [*_PAIR_KEY, "node"]).join(marked.hint("merge"), F.col("node") == F.col("mn")).drop("mn")
        added = materialize(dealt(sent).mapInArrow(_per_bucket(_Bucket.links, _LINK), "a binary, b binary"))
        used += [wanted, sets]
    for frame in used:
        discard(frame)
    return added


def classes(documents: DataFrame, width: int = 2) -> DataFrame:
    """(doc_id, h, n_shingles, root, component_id) of every row: ``root`` names its class, null without words."""
    signed = materialize(_texts(documents).mapInArrow(_signatures(width), "doc_id long, h long, n_shingles long, node binary, bands array<long>, sketch binary"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "h"))
    reps = materialize(signed.where("node is not null").groupBy("node").agg(least.alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    rows = reps.select(F.posexplode("bands").alias("number", "band"), "node", F.col("n").cast("int").alias("n"))
    leaders = rows.groupBy("band").agg(F.min(F.struct("node", "n")).alias("leader"), F.count("*").alias("c"), F.sum("n").alias("shingles"))
    leaders = materialize(leaders.where("c > 1").select(F.col("band").alias("lb"), "leader", "c", "shingles"))
    members = materialize(rows.join(leaders.hint("merge"), rows["band"] == leaders["lb"]).select("band", "number", "node", "n", "leader", "c", "shingles"))
    pairs = materialize(
        members.where("node <> leader.node and 100 * least(n, leader.n) >= 80 * greatest(n, leader.n)").select(F.col("leader.node").alias("a"), F.col("node").alias("b")).distinct()
    )
    links = _verified(pairs, documents, reps, width)
    roots = components(links)
    added = _open_links(members, roots, documents, reps, width)
    used = [leaders, members, pairs]
    if added is not None:
        if added.limit(1).count():
            every = links.union(added)
            discard(roots)
            roots = components(every)
        used.append(added)
    used.append(links)
    named = materialize(reps.select("node", "rep").join(roots.withColumnRenamed("node", "rn").hint("merge"), F.col("node") == F.col("rn")).select("node", "rep", "root"))
    lowest = materialize(named.groupBy("root").agg(F.min("rep").alias("low")).select(F.col("root").alias("lr"), F.col("low.doc_id").alias("component")))
    placed = materialize(named.join(lowest.hint("merge"), named["root"] == lowest["lr"]).select(F.col("node").alias("pn"), "component", F.col("root").alias("pr")))
    alone = materialize(reps.select(F.col("node").alias("an"), F.col("rep.doc_id").alias("label")))
    slim = materialize(signed.select("doc_id", "h", "n_shingles", "node"))
    out = slim.join(alone.hint("merge"), F.col("node") == F.col("an"), "left").join(placed.hint("merge"), F.col("node") == F.col("pn"), "left")
    component = F.when(F.col("pn").isNotNull(), F.col("component")).when(F.col("an").isNotNull(), F.col("label")).otherwise(F.col("doc_id"))
    for frame in (*used, named, lowest, roots, signed, reps):
        discard(frame)
    return out.select("doc_id", "h", "n_shingles", F.coalesce("pr", "node").alias("root"), component.alias("component_id"))


def near_duplicates(documents: DataFrame, width: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``documents`` (doc_id, text; the rest is not read).

    A text without words, or null, has no shingles and is linked with nothing: its component_id is its doc_id, as it
    is for any text without links. Every row is a document: rows that share a doc_id but no link are in two classes.
    A null doc_id links like any other, and names a component only where no row of it has a doc_id; kept compares
    null-safely. Texts of any length are read whole. An empty table gives an empty one.
    """
    out = classes(documents, width).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(documents: DataFrame, width: int = 5) -> DataFrame:
    """All columns of the rows that stay when each class of near-duplicates keeps one row: that of its least doc_id.

    A null doc_id comes behind all others; of rows with equal doc_id the one with the least hash of its text stays, of
    rows with equal text too any one. Rows without words are in no class and stay. Columns pass under any name.
    """
    columns = documents.columns
    least = F.min(F.struct("lost", "id", "h"))
    rows = classes(documents, width).where("root is not null").select("root", F.col("doc_id").isNull().alias("lost"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h")
    keys = materialize(rows.groupBy("root", "lost", "id", "h").agg(F.count("*").alias("c")))
    best = keys.groupBy("root").agg(least.alias("best"))
    told = keys.join(best.withColumnRenamed("root", "br").hint("merge"), F.col("root") == F.col("br")).withColumn("stays", F.col("best") == F.struct("lost", "id", "h"))
    gone = materialize(told.where("not stays or c > 1").select("lost", "id", "h", "stays"))
    discard(keys)
    text = F.col("text").cast("string")
    key = [F.col("doc_id").isNull().alias("lost"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()).alias("h")]
    whole = documents.select(F.struct(*map(quoted, columns)).alias("row"), *key)
    out = whole.join(gone, ["lost", "id", "h"], "left_anti").select("row")
    repeated = gone.where("stays")
    if repeated.limit(1).count():
        again = whole.join(repeated, ["lost", "id", "h"], "left_semi").groupBy("lost", "id", "h").agg(F.first("row").alias("row"))
        out = out.unionByName(again.select("row"))
    return out.select("row.*")


#: DuckDB SQL with the same rows for two-word shingles, over the table ``documents``.
NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS sh FROM w),
g AS (SELECT list_sort(sh) AS sh, min(doc_id) AS node FROM s WHERE len(sh) > 0 GROUP BY 1),
x AS (SELECT node, len(sh) AS n, unnest(sh) AS sh FROM g),
o AS (SELECT a.node AS a, b.node AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM x a JOIN x b ON a.sh = b.sh AND a.node < b.node AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY 1, 2),
l AS (SELECT a, b FROM o WHERE 100 * i >= 80 * (na + nb - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT node AS a, node AS root FROM g UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.a WHERE r.root < e.b),
c AS (SELECT a AS node, min(root) AS root FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(c.root, s.doc_id) AS component_id, s.doc_id = coalesce(c.root, s.doc_id) AS kept
FROM s LEFT JOIN g ON g.sh = list_sort(s.sh) AND len(s.sh) > 0 LEFT JOIN c ON c.node = g.node
"""
