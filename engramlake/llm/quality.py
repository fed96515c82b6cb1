"""Quality classifier: Bradley-Terry scores learned from preference pairs.

A document's score is linear in features of its whole text; the chance that one document is preferred to
another is the logistic function of the difference of their scores. The weights minimise the
logistic loss over pairs of a document labelled 1 and one labelled 0. The decision is a score quantile: the
one of the labelled sample at which most labels are met stands at ``THRESHOLD``.

The fit uses at most ``LABELLED_ROWS`` labelled documents, chosen by hash of their identifier. Scoring is a map
over all rows. Labels, language, source and identifiers are never features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.llm.shingles import mix, slices, word_hashes
from engramlake.llm.store import releasing

LABELLED_ROWS = 12_000
PAIRS = 120_000
STEPS = 1500
THRESHOLD = 0.7
HELD_OUT = 2

# Byte classes of the text: 0 lower, 1 upper, 2 digit, 3 space, 4 line end, 5 sentence marks, 6.. other marks, 15 not ASCII.
_CLASS = np.full(256, 14, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 15
_CLASS[[9, 32]], _CLASS[[10, 11, 12, 13]], _CLASS[[44, 46, 59, 58]] = 3, 4, 5
for _n, _mark in enumerate(b"!|%#&*$"):
    _CLASS[_mark] = 6 + _n
# Classes of a word's bytes: 0 lower, 1 upper, 2 digit, 3 mark, 4 not ASCII.
_KIND = np.full(256, 3, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 4
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
FEATURES = 16 + 125 + 12


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` numbers per text of a large_binary array without nulls."""
    rows = len(texts)
    out = np.zeros((rows, FEATURES), np.float64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + rows + 1]
    base, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    if not size:
        return out
    data = np.frombuffer(texts.buffers()[2], np.uint8)[base : base + size]
    edges = offsets - base
    lengths = np.diff(edges)
    row_of_byte = np.repeat(np.arange(rows), lengths)
    out[:, :16] = np.bincount(row_of_byte * 16 + _CLASS[data], minlength=rows * 16).reshape(rows, 16) / np.maximum(1, lengths)[:, None]

    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = np.unique(edges[(edges > 0) & (edges < size)])
    first[cuts], last[cuts - 1] = inside[cuts], inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    row_of_word = row_of_byte[starts]
    words = np.bincount(row_of_word, minlength=rows)
    many = np.maximum(1, words)
    middle = (starts + ends) // 2
    shape = _KIND[data[starts]] * 25 + _KIND[data[middle]] * 5 + _KIND[data[ends]]
    out[:, 16:141] = np.bincount(row_of_word * 125 + shape, minlength=rows * 125).reshape(rows, 125) / many[:, None]

    hashes, _ = word_hashes(texts)
    wide = (ends - starts + 1).astype(np.float64)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row_of_word[1:] == row_of_word[:-1])
    tail = out[:, 141:]
    tail[:, 0] = np.log1p(words)
    tail[:, 1] = np.log1p(lengths)
    tail[:, 2] = np.bincount(row_of_word, wide, rows) / many
    tail[:, 3] = np.sqrt(np.maximum(0, np.bincount(row_of_word, wide**2, rows) / many - tail[:, 2] ** 2))
    tail[:, 4] = np.bincount(row_of_word[same], minlength=rows) / many
    tail[:, 5] = np.bincount(row_of_word, wide == 1, rows) / many
    tail[:, 6] = np.bincount(row_of_word, wide > 20, rows) / many
    bounds = np.concatenate([[0], np.cumsum(words)])
    for row in np.flatnonzero(words):
        own = hashes[bounds[row] : bounds[row + 1]]
        _, counts = np.unique(own, return_counts=True)
        n = len(own)
        tail[row, 7], tail[row, 8] = len(counts) / n, counts.max() / n
        pairs = np.unique(mix(own[1:] * np.uint64(3) + own[:-1])) if n > 1 else own
        tail[row, 9] = len(pairs) / max(1, n - 1)
        tail[row, 10] = np.log1p(n) * tail[row, 9]
        tail[row, 11] = tail[row, 4] > 0.3
    return out


@dataclass
class BradleyTerry:
    """Standardisation, weights, and the map of a linear score to 0..1 with the quantile at ``THRESHOLD``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float = 0.0
    slope: float = 1.0

    def linear(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.linear(x) - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5) -> BradleyTerry:
    """Learn from features and labels 0/1. Without both labels there is no preference: all score ``THRESHOLD``."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return BradleyTerry(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES))
    model = BradleyTerry(x.mean(0), x.std(0) + 1e-3, np.zeros(FEATURES))
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    rng = np.random.default_rng(seed)
    winners, losers = rng.choice(good, PAIRS), rng.choice(bad, PAIRS)
    first, second = np.zeros(FEATURES), np.zeros(FEATURES)
    w = model.weights
    for step in range(1, STEPS + 1):
        at = rng.integers(0, PAIRS, 512)
        d = z[winners[at]] - z[losers[at]]
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))  # chance given to the wrong order
        grad = -(d * p[:, None]).mean(0) + 1e-3 * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w -= 0.03 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    scores = model.linear(x)
    cuts = np.quantile(scores, np.linspace(0, 1, 1001)[1:-1])
    ordered = np.sort(scores[good]), np.sort(scores[bad])
    met = len(good) - np.searchsorted(ordered[0], cuts) + np.searchsorted(ordered[1], cuts)
    best = np.flatnonzero(met == met.max())
    model.cut = float(cuts[best].mean())
    grid = np.geomspace(0.05, 5, 60)
    offset = np.log(THRESHOLD / (1 - THRESHOLD))
    losses = [np.logaddexp(0, -(2 * y - 1) * np.clip(a * (scores - model.cut) + offset, -40, 40)).mean() for a in grid]
    model.slope = float(grid[int(np.argmin(losses))])
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, part in slices(batch.column("text")):
            x = features(part)
            yield pa.RecordBatch.from_arrays([batch.column("quality").slice(first, len(part)), pa.array(list(x), pa.list_(pa.float64()))], ["quality", "x"])


def _scores(model: BradleyTerry):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(part)), pa.array(model.score(features(part)))], ["doc_id", "score"])

    return run


def train(documents: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> BradleyTerry:
    """Fit on at most ``rows`` labelled documents that are not held out. Repeated labels of an id count by their mean."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    open_rows = known.filter(~held_out(F.col("doc_id")))
    place = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5
    share = 2.0 * rows / max(1, open_rows.count())  # more than needed, yet few rows reach the sort
    chosen = open_rows.filter(place < share).orderBy(place, "doc_id").limit(rows)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").select("quality", "text").mapInArrow(releasing(_feature_rows), "quality int, x array<double>").toArrow()
    x = np.array(sample.column("x").to_pylist(), np.float64).reshape(-1, FEATURES)
    y = sample.column("quality").to_numpy()
    order = np.lexsort((*x.T[:3], x[:, 141], y))  # the same model whatever order the rows come in
    return fit(x[order], y[order])


def score_documents(documents: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``documents`` (doc_id, text), learning from ``labels`` (doc_id, quality).

    A null text is scored as an empty one. A null doc_id is scored too and is not held out. Repeated rows
    are repeated; labels without a document are passed over; other columns are ignored; no rows: no rows.
    """
    return predict(train(documents, labels, rows), documents)


def predict(model: BradleyTerry, documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``documents`` by a fitted model."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(releasing(_scores(model)), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
