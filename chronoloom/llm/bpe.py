"""Byte-level BPE with a hierarchical-bitmap rank queue.

Each pre-token is a doubly linked list of byte spans. A merge candidate is a (rank, position) pair: the bucket of
its rank holds the position, and a bitmap with one bit a rank, summarised level by level, finds the lowest rank that
has a bucket by find-first-set. An entry whose position no longer forms a pair of that rank is stale and skipped.
Every merge costs O(levels + log bucket), so a pre-token of a million letters takes no quadratic time.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: A blank run with the solid run behind it, or the blanks that end a text. A rank file's pattern never matches
#: across the place where a solid character meets a blank, so each chunk is split on its own and may be remembered.
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Bits of one bitmap word.
WORD_BITS = 64
#: Characters of text whose unknown pre-tokens are merged together.
TEXT_BLOCK = 6_000_000
#: Characters of the longest chunk and pre-token that outlive their block in memory.
REMEMBER_CHARS = 64


class RankQueue:
    """Buckets by merge rank under a bitmap with one bit a rank, summarised level by level up to one word.

    ``pop`` finds the lowest rank that has a bucket by find-first-set, one word a level.
    """

    def __init__(self, n_ranks: int):
        self.buckets: dict[int, list] = {}
        self.levels: list[list[int]] = []
        size = n_ranks
        while size > 1 or not self.levels:
            size = -(-size // WORD_BITS)
            self.levels.append([0] * size)

    def push(self, rank: int, entry) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(entry)
            return
        self.buckets[rank] = [entry]
        at = rank
        for level in self.levels:
            at, bit = divmod(at, WORD_BITS)
            held = level[at]
            level[at] = held | 1 << bit
            if held:
                return

    def first(self) -> int:
        """The lowest rank with a bucket, or -1."""
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return -1
            at = at * WORD_BITS + (word & -word).bit_length() - 1
        return at

    def take(self, rank: int) -> list:
        """Remove the bucket of ``rank`` and every summary bit that it alone held up."""
        at = rank
        for level in self.levels:
            at, bit = divmod(at, WORD_BITS)
            level[at] &= ~(1 << bit)
            if level[at]:
                break
        return self.buckets.pop(rank)


class Codec:
    """Encoder and decoder of one rank file. Remembered pre-tokens are bounded in number and length."""

    def __init__(self, rank_file: bytes, pattern: str, remember: int = 400_000):
        self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in rank_file.splitlines() if line)}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.n_ranks = max(self.tokens) + 1
        self.digits = {r: str(r) for r in self.tokens}
        self.own = {r: r for r in self.tokens}  # one int object an id
        self.split = regex.compile(pattern).findall
        self.remember = remember
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        # every way to part a token into two tokens, as left * (n + 1) + right; -1 stands for no token
        joins = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    joins[left * (self.n_ranks + 1) + right] = rank
        self.join_keys = np.array(sorted(joins), np.int64)
        self.join_ranks = np.array([joins[k] for k in self.join_keys.tolist()], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of tokens, -1 where they do not merge."""
        keys = left * (self.n_ranks + 1) + right
        at = np.minimum(np.searchsorted(self.join_keys, keys), len(self.join_keys) - 1)
        return np.where((self.join_keys[at] == keys) & (left >= 0) & (right >= 0), self.join_ranks[at], -1)

    def merge(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """Ids of each pre-token.

        All pre-tokens share one queue, as one row of linked lists with a wall after each: the merges of one
        pre-token happen in the order that it alone would give, since no pair reaches over a wall.
        """
        data = [p.encode() for p in pieces]
        out = [(self.ranks[d],) if d in self.ranks else None for d in data]
        todo = [i for i, ids in enumerate(out) if ids is None]
        if not todo:
            return out
        lengths = np.array([len(data[i]) for i in todo], np.int64) + 1
        flat = np.frombuffer(b"\0" + b"\0".join(data[i] for i in todo) + b"\0", np.uint8)
        ends = np.cumsum(lengths)  # places of the walls behind the pre-tokens; place 0 is a wall too
        token = self.of_byte[flat]
        token[ends] = token[0] = -1
        owner = np.repeat(np.arange(len(todo)), lengths)
        owner = np.concatenate([[-1], owner])
        n = len(flat)
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        pair = np.full(n, -1, np.int64)
        pair[:-1] = self._rank(token[:-1], token[1:])
        live = np.ones(n, bool)
        redo = np.zeros(len(todo), bool)
        queue = RankQueue(self.n_ranks)
        self._push(queue, np.flatnonzero(pair >= 0), pair)
        while (rank := queue.first()) >= 0:
            entries = queue.take(rank)
            at = np.unique(np.concatenate(entries)) if len(entries) > 1 else entries[0]
            at = at[pair[at] == rank]  # the rest are stale
            if not len(at):
                continue
            touching = after[at[:-1]] == at[1:]
            if touching.any():  # pairs that overlap: every other one of a run, from the left
                start = np.flatnonzero(np.concatenate([[True], ~touching]))
                nth = np.arange(len(at)) - np.repeat(start, np.diff(np.concatenate([start, [len(at)]])))
                pair[at[nth % 2 == 1]] = -1
                at = at[nth % 2 == 0]
            right = after[at]
            behind = after[right]
            after[at] = behind
            before[behind] = at
            token[at] = rank
            pair[right] = -1
            live[right] = False
            seen = np.unique(np.concatenate([at, before[at]]))
            new = self._rank(token[seen], token[after[seen]])
            pair[seen] = new
            if (low := (new >= 0) & (new < rank)).any():
                # a lower rank came up: right in any order, unless the same pre-token had more entries in this bucket
                many, counts = np.unique(owner[at], return_counts=True)
                redo[np.intersect1d(owner[seen[low]], many[counts > 1])] = True
            self._push(queue, seen[new >= 0], pair)
        live[ends] = live[0] = False
        found = token[live].tolist()
        stops = np.cumsum(np.bincount(owner[live], minlength=len(todo))).tolist()
        own, begin = self.own, 0
        for k, stop in enumerate(stops):
            out[todo[k]] = tuple([own[x] for x in found[begin:stop]])
            begin = stop
        for k in np.flatnonzero(redo).tolist():
            out[todo[k]] = self.merge_one(data[todo[k]])
        return out

    @staticmethod
    def _push(queue: RankQueue, at: np.ndarray, pair: np.ndarray) -> None:
        if len(at) == 1:
            queue.push(int(pair[at[0]]), at)
            return
        ranks = pair[at]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        bounds = [0, *cuts.tolist(), len(at)]
        for rank, lo, hi in zip(ranks[bounds[:-1]].tolist() if len(at) else [], bounds[:-1], bounds[1:], strict=False):
            queue.push(rank, at[lo:hi])

    def merge_one(self, data: bytes) -> tuple[int, ...]:
        """Ids of one pre-token by its own queue, one entry at a time: leftmost first within a rank."""
        n, get = len(data), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [get(data[i : i + 2], -1) for i in range(n - 1)] + [-1]
        queue = RankQueue(self.n_ranks)
        for i, rank in enumerate(pair):
            if rank >= 0:
                queue.push(rank, i)
        while (rank := queue.first()) >= 0:
            bucket = queue.buckets[rank]
            i = heappop(bucket)
            if not bucket:
                queue.take(rank)
            if pair[i] != rank:
                continue  # stale
            j = after[i]
            k = after[i] = after[j]
            pair[i] = pair[j] = -1
            if k < n:
                before[k] = i
            for p in (before[i], i):
                if p >= 0 and after[p] < n:
                    pair[p] = new = get(data[p : after[after[p]]], -1)
                    if new in queue.buckets:
                        heappush(queue.buckets[new], p)
                    elif new >= 0:
                        queue.push(new, p)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : after[i]]])
            i = after[i]
        return tuple(out)

    def _learn(self, texts: list[str]) -> list[str]:
        """Merge what is not remembered of these texts. Returns the long chunks, to be forgotten after this block."""
        unknown: set[str] = set()
        for text in texts:
            unknown.update(CHUNK.findall(text))
        if len(self.chunks) > self.remember or len(self.pieces) > self.remember:
            self.chunks = {c: self.chunks[c] for c in unknown if c in self.chunks}
            self.pieces = {}
        unknown.difference_update(self.chunks)
        parted = {c: self.split(c) for c in unknown}
        pieces = list(set(chain.from_iterable(parted.values())).difference(self.pieces))
        self.pieces.update(zip(pieces, self.merge(pieces), strict=True))
        known = self.pieces
        for chunk, parts in parted.items():
            self.chunks[chunk] = known[parts[0]] if len(parts) == 1 else tuple(chain.from_iterable([known[p] for p in parts]))
        for piece in pieces:
            if len(piece) > REMEMBER_CHARS:
                del known[piece]
        return [c for c in parted if len(c) > REMEMBER_CHARS]

    def encode_all(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """Ids of each text, in order. Texts are taken in blocks, so memory is bounded by a block or one text."""
        block, size = [], 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size >= TEXT_BLOCK:
                yield from self._encode_block(block)
                block, size = [], 0
        yield from self._encode_block(block)

    def _encode_block(self, block: list[str]) -> Iterator[list[int]]:
        long = self._learn(block)
        get = self.chunks.__getitem__
        for text in block:
            yield list(chain.from_iterable(map(get, CHUNK.findall(text))))
        for chunk in long:
            del self.chunks[chunk]

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ``ids``; an id outside the rank file raises KeyError."""
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def _codec(rank_file: bytes, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


class BytePairEncoding:
    """Column functions of one rank file.

    The driver reads the file and ships its bytes (under 1 MB) by broadcast, so executors need no copy of it.
    A null text encodes as the empty text, which has no ids; null ids decode to empty bytes.
    """

    def __init__(self, spark, rank_path: str, pattern: str):
        with open(rank_path, "rb") as f:
            self.shipped = spark.sparkContext.broadcast(f.read())
        self.pattern = pattern

    def encode(self, text: Column) -> Column:
        shipped, pattern = self.shipped, self.pattern

        def run(texts: pa.Array) -> pa.Array:
            codec = _codec(shipped.value, pattern)
            return pa.array(list(codec.encode_all(x or "" for x in texts.to_pylist())), pa.list_(pa.int32()))

        return F.arrow_udf(run, "array<int>")(text)

    def decode(self, ids: Column) -> Column:
        shipped, pattern = self.shipped, self.pattern

        def run(lists: pa.Array) -> pa.Array:
            codec = _codec(shipped.value, pattern)
            return pa.array([codec.decode(x or []) for x in lists.to_pylist()], pa.binary())

        return F.arrow_udf(run, "binary")(ids)

    def digest(self, text: Column) -> Column:
        """Encode and decode text by text; only the count and two digests leave the worker, so ids are never shipped."""
        shipped, pattern = self.shipped, self.pattern
        kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

        def run(texts: pa.Array) -> pa.Array:
            codec = _codec(shipped.value, pattern)
            sha, digits = hashlib.sha256, codec.digits.__getitem__
            out = []
            for ids in codec.encode_all(scalar.as_py() or "" for scalar in texts):  # a batch never exists twice
                out.append((len(ids), sha(",".join(map(digits, ids)).encode()).hexdigest(), sha(codec.decode(ids)).hexdigest()))
            return pa.StructArray.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, kind, strict=True)], fields=list(kind))

        return F.arrow_udf(run, "n_tokens long, ids_sha256 string, decoded_sha256 string")(text)


def token_digests(docs: DataFrame, bpe: BytePairEncoding) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs``; other columns are not read.

    An empty table gives an empty one; repeated rows give repeated rows. A null text is the empty text; a text of any
    length is one unit of work, held in memory once with its ids.
    """
    return docs.select("doc_id", bpe.digest(F.col("text")).alias("d")).select("doc_id", "d.*")
