"""Quality classifier by Bradley-Terry pairwise ranking.

A text's score is a weighted sum of features of its bytes, words and lines. Weights are learnt from preference pairs
(a text labelled 1 is preferred to one labelled 0) by logistic loss on feature differences, so only the order of
scores is learnt; the threshold is then the quantile of training scores that the share of label 0 gives.

Every labelled row counts, and every pair of them. Pairs are never listed: what a row gets from all rows of the other
label depends on its score alone, so it is a curve over scores, worked out from their distribution on a fine grid. All
that is learnt is a sum over rows of arrays of bounded size, which tasks add up.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize

#: Training rows up to which the driver adds up by itself; of more, tasks add up their parts. All rows count either way.
LOCAL_ROWS = 6000
#: Distance of grid points in a score, and grid points of a cell by which the curvature of the loss is estimated.
STEP, CELL = 1 / 256, 128
#: Parts that a range of scores is divided into at a time, and how often, to find a score by its rank.
RANK_BINS, RANK_ROUNDS = 1 << 12, 4
PUNCTUATION = b"#*$%&|<>!?.,:;-_=\"'()/@{}[]"
#: Tokens whose distinct share is measured at a time, so that the share does not fall with length alone.
RICHNESS_WINDOW = 400


def _sum(histogram: np.ndarray, values: bytes | range) -> float:
    return float(histogram[np.frombuffer(bytes(values), np.uint8)].sum())


def features(data: bytes) -> list[float]:
    """Feature vector of one text. It never depends on label, language, source or id."""
    n = len(data)
    histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    rate = lambda x: math.sqrt(x / n) if n else 0.0
    lines = [x for x in data.split(b"\n") if x.strip()]
    n_words = len(words)
    windows = range(0, n_words, RICHNESS_WINDOW)
    rich = sum(len(set(words[k : k + RICHNESS_WINDOW])) for k in windows) / n_words if n_words else 0.0
    out = [rate(float(histogram[b])) for b in PUNCTUATION]
    out += [rate(_sum(histogram, range(65, 91))), rate(_sum(histogram, range(97, 123))), rate(_sum(histogram, range(48, 58))), rate(_sum(histogram, range(128, 256))), rate(float(n - len(b"".join(words)))), rate(float(histogram[10]))]
    out += [math.log1p(n_words), sum(map(len, words)) / n_words if n_words else 0.0, rich, 1 - len(set(lines)) / len(lines) if lines else 0.0, math.log1p(len(lines)), math.log1p(n_words / max(1, len(lines)))]
    return out


@dataclass(frozen=True)
class Ranking:
    """``score`` is a logistic curve of the weighted sum, one half at the threshold."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def raw(self, rows: np.ndarray) -> np.ndarray:
        """Weighted sums of features held to eight deviations, as in training: one wild feature decides nothing alone."""
        return np.clip((rows - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(rows) - self.cut), -40, 40)))


#: Sums, over all training rows, what a function makes of the features and labels of some of them.
Total = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray]


def fit(rows: np.ndarray, labels: np.ndarray, ridge: float = 0.02, steps: int = 12) -> Ranking:
    """Newton steps on the penalised loss of all pairs. Without both labels every score is one half."""
    return _fit(lambda f: f(rows, labels), rows.shape[1] if rows.size else len(features(b"")), ridge, steps)


def _fit(total: Total, n_features: int, ridge: float = 0.02, steps: int = 12) -> Ranking:
    sums = total(lambda x, y: np.concatenate([[(y == 1).sum(), (y == 0).sum()], x.sum(0) if x.size else np.zeros(n_features)]))
    good, bad = int(sums[0]), int(sums[1])
    if not good or not bad:
        return Ranking(np.zeros(n_features), np.ones(n_features), np.zeros(n_features), 0.0, 1.0)
    mean = sums[2:] / (good + bad)
    scale = np.maximum(np.sqrt(total(lambda x, y: ((x - mean) ** 2).sum(0)) / (good + bad)), 1e-3)
    w, before, lowest = np.zeros(n_features), np.zeros(n_features), math.inf
    for _ in range(steps):
        masses = total(_masses(mean, scale, w))
        loss = _pair_loss(masses) / good / bad + ridge / 2 * float(w @ w)
        if loss > lowest + 1e-9:  # too far
            w = (w + before) / 2
            continue
        lowest = loss
        slope, curve = _slope_and_curve(total, mean, scale, w, masses, good * bad)
        values, axes = np.linalg.eigh(curve + ridge * np.eye(n_features))
        move = axes @ ((axes.T @ (slope + ridge * w)) / np.maximum(values, ridge))
        before, w = w, w - move
        if np.abs(move).max() < 1e-7:
            break
    masses = total(_masses(mean, scale, w))
    reach = _reach(w)
    at = np.arange(masses.shape[1]) * STEP - reach
    # as many rows lie below the threshold as have label 0
    cut = sum(_by_rank(total, mean, scale, w, (bad - 1, bad))) / 2
    middle = float(masses.sum(0) @ at) / (good + bad)
    spread = max(math.sqrt(float(masses.sum(0) @ (at - middle) ** 2) / (good + bad)), 1e-6)
    best = min((_loss(at, masses, cut, k / spread), k / spread) for k in (0.5, 1, 2, 4, 8, 16))[1]
    return Ranking(mean, scale, w, cut, best)


def _loss(at: np.ndarray, masses: np.ndarray, cut: float, slope: float) -> float:
    z = np.clip(slope * (at - cut), -30, 30)
    return float(masses[0] @ np.log1p(np.exp(z)) + masses[1] @ np.log1p(np.exp(-z)))


def _reach(w: np.ndarray) -> float:
    """No score is further from nought, since features are held to eight deviations."""
    return 8 * float(np.abs(w).sum())


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


def _on_grid(raw: np.ndarray, reach: float) -> tuple[int, np.ndarray, np.ndarray]:
    """Points of the grid, the point below each score, and the share of the point above."""
    n = int(2 * reach / STEP) + 3
    place = np.clip((raw + reach) / STEP, 0, n - 2)
    at = np.minimum(place.astype(np.int64), n - 2)
    return n, at, place - at


def _masses(mean: np.ndarray, scale: np.ndarray, w: np.ndarray):
    """Rows of label 0 and of label 1 on the grid, each shared by the two points around its score."""

    def run(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n, at, above = _on_grid(_standard(x, mean, scale) @ w, _reach(w))
        return np.stack([np.bincount(at[y == k], 1 - above[y == k], n) + np.bincount(at[y == k] + 1, above[y == k], n) for k in (0, 1)])

    return run


def _curve(mass: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """At every point the sum of ``f(own score - other score)`` over the rows of ``mass``."""
    n = len(mass)
    size = 1 << (3 * n).bit_length()
    kernel = f(np.arange(1 - n, n) * STEP)
    return np.fft.irfft(np.fft.rfft(mass, size) * np.fft.rfft(kernel, size), size)[n - 1 : 2 * n - 1]


def _sigmoid(gap: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(gap, -40, 40)))


def _pair_loss(masses: np.ndarray) -> float:
    """Logistic loss summed over all pairs."""
    return float(masses[1] @ _curve(masses[0], lambda gap: np.logaddexp(0, -gap)))


def _slope_and_curve(total: Total, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, masses: np.ndarray, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the mean loss over all pairs. The second takes the scores of pairs by cells, which
    changes the way to the minimum, not the minimum."""
    bend = lambda gap: _sigmoid(gap) * _sigmoid(-gap)
    # by label: what all rows of the other label say
    pulls = np.stack([_curve(masses[1], _sigmoid), -_curve(masses[0], lambda gap: _sigmoid(-gap))]) / pairs
    bends = np.stack([_curve(masses[1], bend), _curve(masses[0], bend)]) / pairs
    d, reach = len(w), _reach(w)
    cells = masses.shape[1] // CELL + 1

    def run(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = _standard(x, mean, scale)
        _, at, above = _on_grid(z @ w, reach)
        pull, curved = (c[y, at] * (1 - above) + c[y, at + 1] * above for c in (pulls, bends))
        by_cell = np.zeros((2 * cells, d))
        np.add.at(by_cell, y * cells + at // CELL, z)
        return np.concatenate([z.T @ pull, ((z * curved[:, None]).T @ z).ravel(), by_cell.ravel()])

    sums = total(run)
    slope, own, (bad, good) = sums[:d], sums[d : d + d * d].reshape(d, d), sums[d + d * d :].reshape(2, cells, d)
    apart = np.subtract.outer(np.arange(cells), np.arange(cells)) * (CELL * STEP)
    cross = good.T @ (bend(apart) @ bad) / pairs
    return slope, own - cross - cross.T


def _by_rank(total: Total, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, ranks: tuple[int, ...]) -> list[float]:
    """Scores of these ranks (from 0), or less by under 1e-12 of the range of scores."""
    reach = _reach(w) + STEP
    lows, width, below = [-reach] * len(ranks), 2 * reach / RANK_BINS, [0] * len(ranks)
    for _ in range(RANK_ROUNDS):

        def run(x: np.ndarray, y: np.ndarray, lows=tuple(lows), width=width) -> np.ndarray:
            raw = _standard(x, mean, scale) @ w
            # before the range, its parts, and behind it
            return np.stack([np.bincount(np.clip(np.floor((raw - low) / width), -1, RANK_BINS).astype(np.int64) + 1, minlength=RANK_BINS + 2) for low in lows])

        counts = np.cumsum(total(run), 1)
        for i, rank in enumerate(ranks):
            at = max(int(np.searchsorted(counts[i], rank, "right")) - 1, 0)
            lows[i] += at * width
        width /= RANK_BINS
    return lows


def _feature_batches(batches):
    for batch in batches:
        rows = [features(x or b"") for x in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "features"])


def _summed_by_tasks(rows: DataFrame) -> Total:
    """Sums over a table of label and features: a task adds up its rows, the driver the tasks."""

    def total(f):
        def run(batches):
            out = None
            for batch in batches:
                if batch.num_rows:
                    x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    part = f(x, batch.column("label").to_numpy(zero_copy_only=False))
                    out = part if out is None else out + part
            if out is not None:
                out = np.asarray(out, np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([list(out.shape)], pa.list_(pa.int64())), pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())], ["shape", "data"])

        parts = rows.mapInArrow(run, "shape array<long>, data binary").collect()
        return sum(np.frombuffer(zlib.decompress(r["data"])).reshape(r["shape"]) for r in parts)

    return total


def train(documents: DataFrame, labels: DataFrame, label: str = "quality") -> Ranking:
    """Fit on all labelled documents whose crc32(doc_id) modulo 3 is not 1.

    Features meet labels in a merge join and are written out once; every step of the fit adds up arrays over them.
    Rows without a doc_id or a label of 0 or 1 are left out. A label that repeats counts once, a document with both
    labels once for each; of several texts under one doc_id the one with the least feature vector counts.
    """
    learnt = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    marks = labels.where(learnt & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    each = documents.where(learnt).select("doc_id", "text").mapInArrow(_feature_batches, "doc_id long, features array<double>")
    rows = materialize(each.groupBy("doc_id").agg(F.min("features").alias("features")).join(marks.hint("merge"), "doc_id"))
    if rows.count() > LOCAL_ROWS:
        made = _fit(_summed_by_tasks(rows.select("label", "features")), len(features(b"")))
    else:
        got = rows.orderBy("doc_id", "label").select("label", "features").collect()
        made = fit(np.array([r[1] for r in got], np.float64).reshape(len(got), len(features(b""))), np.array([r[0] for r in got], np.int64))
    discard(rows)
    return made


def score_texts(documents: DataFrame, ranking: Ranking) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, in one pass without a shuffle.

    A null text counts as empty; the empty text has a score like any other. A null doc_id is not held out. Repeated
    rows give repeated rows, an empty table an empty one; other columns are not read.
    """

    def run(texts: pa.Array) -> pa.Array:
        rows = [features(x.as_py() or b"") for x in texts.cast(pa.binary())]
        return pa.array(ranking.score(np.array(rows)) if rows else [], pa.float64())

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    scored = documents.select("doc_id", held.alias("held_out"), F.arrow_udf(run, "double")("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
