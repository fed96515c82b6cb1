"""LM scoring: a log-bilinear model trained by noise-contrastive estimation, whose size grows with the corpus.

With N training tokens the ``8 N^(1/3)`` most frequent words, the end among them, are classes of their own; all other words share
``N^(1/3)`` classes by their last three bytes, and inside such a class a word has its smoothed relative frequency.
Every class is also a context: r = R[c1] C1 + R[c2] C2 for the two tokens before. Classes in order of frequency are cut into
about square root groups of equal size; p(class) = p(group) p(class in its group), logits r . G[group] + a[group] and
r . Q[class] + b[class]. Both factors are normalised exactly with batched matrix products over the groups and over the
members of the token's own group, so probabilities sum to one and a token costs about twice the square root of the number of classes.
At 10^13 tokens there are some 200,000 classes, 40 MB of parameters.

Counts cover every training token. Every task trains from the same start over all training tokens of its split, and
each row of the parameters is averaged by how often a split met it: only rows met are shuffled. The
most frequent words (at most ``KNOWN_WORDS``) are sent to the tasks with their counts; all other words are
joined with the table of counts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.llm.shingles import slices
from engramlake.llm.store import hold_memory, keep, releasing

OWN_WORDS = 8  # times the cube root of the training tokens
DIM = 24
NOISE = 32
BATCH = 2048
CACHED_ROWS = 1024
HELD_BATCHES = 32  # tokens are kept for so many batches, sorted by group for the inner factor
RATE = 0.25
KNOWN_WORDS = 200_000
HELD_OUT = 1
END = b"\n"  # no word holds white space
COUNT_BYTES = 8 << 20

VALUES = [f"v{k}" for k in range(DIM + 1)]


@dataclass
class Tokens:
    """Tokens of some texts, the words of each text followed by its end."""

    words: pa.Array  # distinct, the end among them
    codes: np.ndarray  # the place in ``words`` of every token
    ends: np.ndarray  # for every text: tokens up to its end

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]])


def tokens(texts: pa.Array) -> Tokens:
    """Of a large_binary array without nulls; no Python object is made."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.large_string())))
    coded = parts.flatten().dictionary_encode()
    found = coded.dictionary.view(pa.large_binary())
    codes, sizes = coded.indices.to_numpy(), pc.list_value_length(parts).to_numpy()
    empty = pc.index(found, pa.scalar(b"", found.type)).as_py()
    if empty >= 0:  # beside white space at either end of a text
        filled = codes != empty
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[filled], minlength=len(sizes))
        codes = codes[filled]
    ends = np.cumsum(sizes + 1, dtype=np.int64)
    placed = np.full(len(codes) + len(sizes), len(found), np.int64)
    inside = np.ones(len(placed), bool)
    inside[ends - 1] = False
    placed[inside] = codes
    return Tokens(pa.concat_arrays([found, pa.array([END], found.type)]), placed, ends)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == HELD_OUT, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in slices(batch.column("text"), COUNT_BYTES):
            found = tokens(texts)
            c = np.bincount(found.codes, minlength=len(found.words))
            yield pa.RecordBatch.from_arrays([found.words.cast(pa.binary()), pa.array(c)], ["word", "c"]).filter(pa.array(c > 0))


def cube_root(n: int) -> int:
    return max(1, round(n ** (1 / 3)))


def suffix_class(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-3:]) % classes


@dataclass
class Vocabulary:
    """The frequent words with their counts, most frequent first, and totals of everything."""

    words: list[bytes]
    counts: np.ndarray
    total: int  # N
    distinct: int  # V
    suffix_total: np.ndarray
    suffix_distinct: np.ndarray

    @property
    def own(self) -> int:
        """Words that are classes of their own."""
        return min(len(self.words), OWN_WORDS * cube_root(self.total))

    def prepare(self) -> None:
        self.place = {w: k for k, w in enumerate(self.words)}
        n, own, self.suffixes = len(self.words), self.own, len(self.suffix_total)
        suffix = np.fromiter((suffix_class(w, self.suffixes) for w in self.words), np.int64, n)
        self.cls = np.where(np.arange(n) < own, np.arange(n), own + suffix)
        logs = np.log10(self.counts + 0.5)
        self.base_denominator = np.log10(self.total + 0.5 * (self.distinct + 1))
        self.suffix_denominator = np.log10(np.maximum(self.suffix_total + 0.5 * (self.suffix_distinct + 1), 0.5))
        self.base = logs - self.base_denominator
        self.inner = np.where(np.arange(n) < own, 0.0, logs - self.suffix_denominator[suffix])
        self.class_counts = np.concatenate([self.counts[:own], self.suffix_total + 0.5 * (self.suffix_distinct + 1)]).astype(np.float64)
        self.start = len(self.class_counts)

    def look_up(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(place in the table or -1, class) of every word."""
        places = np.fromiter(map(self.place.get, found, repeat(-1)), np.int64, len(found))
        classes = self.cls[places] if len(self.cls) else np.zeros(len(found), np.int64)
        for k in np.flatnonzero(places < 0):
            classes[k] = self.own + suffix_class(found[k], self.suffixes)
        return places, classes

    def contexts(self, classes: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Classes of the token before and of the one before that, within one text each; ``starts`` of the texts, else it is one."""
        before = np.concatenate([[self.start, self.start], classes])
        first, second = before[1:-1].copy(), before[:-2].copy()
        if starts is not None:
            first[starts] = second[starts] = self.start
            second[starts[starts + 1 < len(second)] + 1] = self.start
        return first, second

    def columns(self, found: Tokens) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in the table or -1, class) of every distinct word, and (class, both contexts) of every token."""
        places, classes = self.look_up(found.words.to_numpy(zero_copy_only=False).tolist())  # some times faster than to_pylist
        each = classes[found.codes]
        return places, classes, (each, *self.contexts(each, found.starts))


def _order(index: np.ndarray) -> np.ndarray:
    """Stable order of whole numbers from 0; those of 16 bits are sorted by digits, several times faster."""
    small = len(index) and index.max() < 1 << 16
    return np.argsort(index.astype(np.uint16) if small else index, kind="stable")


def _scatter(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = _order(index)
    index = index[order]
    heads = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    return index[heads], np.add.reduceat(values.take(order, axis=0), heads, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), in place of x."""
    np.clip(x, -30, 30, out=x)
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.divide(1, x, out=x)


def _log_probabilities(r: np.ndarray, outer: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Log of the share of each row's ``own`` outer row; few rows at once, so what lies between stays in the cache."""
    out, at_bias, rows = np.empty(len(r), np.float32), outer[:, -1], outer[:, :-1].T
    for at in range(0, len(r), CACHED_ROWS):
        logits = r[at : at + CACHED_ROWS] @ rows
        logits += at_bias
        found = logits[np.arange(len(logits)), own[at : at + CACHED_ROWS]]
        top = logits.max(1)
        logits -= top[:, None]
        out[at : at + CACHED_ROWS] = found - (top + np.log(np.exp(logits, out=logits).sum(1)))
    return out


class LogBilinear:
    """Parameters, one pass of noise-contrastive training, and exact class probabilities.

    All parameters are rows of one table, the last column is the bias: contexts ("r"), the two matrices, groups ("g"), classes ("q").
    """

    def __init__(self, class_counts: np.ndarray, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        classes = len(class_counts)
        self.size = max(1, math.ceil(math.sqrt(classes)))
        mass = class_counts + 1e-3
        self.group_start = np.arange(0, classes, self.size)
        group_mass = np.add.reduceat(mass, self.group_start)
        inner = mass / np.repeat(group_mass, self.size)[:classes]
        self.noise = {"g": np.log(group_mass / group_mass.sum()).astype(np.float32), "q": np.log(inner).astype(np.float32)}
        parts = {
            "r": rng.normal(0, 0.3, (classes + 1, DIM)),
            "c1": np.eye(DIM),
            "c2": 0.5 * np.eye(DIM),
            "g": rng.normal(0, 0.05, (len(group_mass), DIM)),
            "q": rng.normal(0, 0.05, (classes, DIM)),
        }
        bias = [self.noise.get(k, np.zeros(len(v))) for k, v in parts.items()]
        self.table = np.column_stack([np.concatenate(list(parts.values())), np.concatenate(bias)]).astype(np.float32)
        at = np.cumsum([0, *(len(v) for v in parts.values())])
        self.rows = {k: slice(at[i], at[i + 1]) for i, k in enumerate(parts)}

    def part(self, name: str) -> np.ndarray:
        return self.table[self.rows[name]]

    def start_training(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        self.squares = np.full(self.table.shape, 1e-2, np.float32)
        self.met = np.zeros(len(self.table), np.float64)
        self.cumulative = {k: np.cumsum(np.exp(self.noise[k].astype(np.float64))) for k in self.noise}

    def _step(self, name: str, rows: np.ndarray | None, grad: np.ndarray) -> None:
        """Gradients of some rows, else of all of the part; of all columns, or of all but the bias."""
        wide, at = grad.shape[1], self.rows[name] if rows is None else rows + self.rows[name].start
        squares = self.squares[at, :wide]
        squares += grad * grad
        self.squares[at, :wide] = squares
        self.table[at, :wide] -= RATE * grad / np.sqrt(squares)

    def _draw(self, name: str, first: int, end: int) -> np.ndarray:
        steps = self.cumulative[name]
        below = steps[first - 1] if first else 0.0
        drawn = np.searchsorted(steps, below + self.rng.random(NOISE) * (steps[end - 1] - below))
        return np.clip(drawn, first, end - 1)

    def _contrast(self, name: str, true: np.ndarray, noise: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        """One batch: true rows of a part against noise rows drawn for the whole batch."""
        outer, c1, c2 = self.part(name), self.part("c1")[:, :-1], self.part("c2")[:, :-1]
        left, right = (self.part("r").take(k, axis=0)[:, :-1] for k in (first, second))
        r = left @ c1
        r += right @ c2
        q, qn, log_noise = outer.take(true, axis=0), outer.take(noise, axis=0), self.noise[name] + np.float32(np.log(NOISE))
        size, n = np.float32(len(true)), len(true)
        above = (r * q[:, :-1]).sum(1) + q[:, -1] - log_noise[true]
        false = r @ qn[:, :-1].T
        false += qn[:, -1]
        false -= log_noise[noise]
        gt = _sigmoid(-above) / -size
        gf = _sigmoid(false)
        gf /= size
        dr = gf @ qn[:, :-1]
        dr += gt[:, None] * q[:, :-1]
        d1, d2 = left.T @ dr, right.T @ dr
        both = np.empty((2 * n, DIM), np.float32)
        np.matmul(dr, c1.T, out=both[:n])
        np.matmul(dr, c2.T, out=both[n:])
        rows, grads = _scatter(np.concatenate([first, second]), both)
        outers = np.empty((n + len(noise), DIM + 1), np.float32)
        np.multiply(gt[:, None], r, out=outers[:n, :-1])
        outers[:n, -1] = gt
        outers[n:, :-1], outers[n:, -1] = gf.T @ r, gf.sum(0)
        places, dq = _scatter(np.concatenate([true, noise]), outers)
        self._step("r", rows, grads)
        self._step("c1", None, d1)
        self._step("c2", None, d2)
        self._step(name, places, dq)

    def _meet(self, name: str, index: np.ndarray) -> None:
        place = self.rows[name]
        self.met[place] += np.bincount(index, minlength=place.stop - place.start)

    def learn(self, classes: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        """Groups in batches as the tokens come, then members of one group a batch, batches in any order."""
        groups = classes // self.size
        for at in range(0, len(classes), BATCH):
            part = slice(at, at + BATCH)
            self._contrast("g", groups[part], self._draw("g", 0, len(self.group_start)), first[part], second[part])
        order = _order(groups)
        bounds = np.searchsorted(groups[order], np.arange(len(self.group_start) + 1))
        batches = [(g, at, min(at + BATCH, bounds[g + 1])) for g in range(len(self.group_start)) for at in range(bounds[g], bounds[g + 1], BATCH)]
        for k in self.rng.permutation(len(batches)):
            g, at, end = batches[k]
            rows, begin = order[at:end], self.group_start[g]
            members = min(begin + self.size, len(self.noise["q"]))
            self._contrast("q", classes[rows], self._draw("q", begin, members), first[rows], second[rows])
        for name, index in (("r", first), ("r", second), ("g", groups), ("q", classes)):
            self._meet(name, index)
        self.met[self.rows["c1"]] += len(classes)
        self.met[self.rows["c2"]] += len(classes)

    def prepare(self) -> None:
        r = self.part("r")[:, :-1]
        self.near, self.far = r @ self.part("c1")[:, :-1], r @ self.part("c2")[:, :-1]

    def log10(self, classes: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of every token's class."""
        out = np.empty(len(classes))
        g, q = self.part("g"), self.part("q")
        for at in range(0, len(classes), HELD_BATCHES * BATCH):
            part = slice(at, at + HELD_BATCHES * BATCH)
            r, own = self.near.take(first[part], axis=0), classes[part]
            r += self.far.take(second[part], axis=0)
            groups = own // self.size
            logs = _log_probabilities(r, g, groups)
            order = _order(groups)
            bounds = np.searchsorted(groups[order], np.arange(len(self.group_start) + 1))
            for k in np.flatnonzero(np.diff(bounds)):
                rows, begin = order[bounds[k] : bounds[k + 1]], self.group_start[k]
                logs[rows] += _log_probabilities(r.take(rows, axis=0), q[begin : begin + self.size], own[rows] - begin)
            out[part] = logs / np.log(10)
        return out


def vocabulary(counts: DataFrame, known_words: int = KNOWN_WORDS) -> Vocabulary:
    """From the full table (word, c): its most frequent words by whole counts, and totals."""
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    classes = cube_root(n)
    suffix = F.crc32(F.expr("substring(word, -3)")) % classes
    kept, least = 0, 1 << 62
    for row in counts.groupBy(F.least("c", F.lit(100_000)).alias("c")).count().orderBy(F.col("c").desc()).collect():
        kept += row["count"]
        if kept > known_words:
            break
        least = row.c
    known = counts.filter(F.col("c") >= least).toArrow()
    words, values = known.column("word").to_pylist(), known.column("c").to_numpy()
    order = sorted(range(len(words)), key=lambda k: (-values[k], words[k]))
    words, values = [words[k] for k in order], values[order] if len(order) else np.zeros(0, np.int64)
    total, distinct = np.zeros(classes), np.zeros(classes)
    for row in counts.groupBy(suffix.alias("s")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():  # at most ``classes`` rows
        total[row.s], distinct[row.s] = row.c, row.v
    found = Vocabulary(words, np.asarray(values, np.int64), int(n), int(v), total, distinct)
    for word, c in zip(words[: found.own], values[: found.own], strict=True):
        total[suffix_class(word, classes)] -= c
        distinct[suffix_class(word, classes)] -= 1
    return found


def _trained(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_memory()
        words: Vocabulary = shared.value
        words.prepare()
        model = LogBilinear(words.class_counts)
        model.start_training(TaskContext.get().partitionId())
        held: list[tuple] = []
        waiting = 0

        def learn() -> None:
            nonlocal held, waiting
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            for at in range(0, waiting, HELD_BATCHES * BATCH):
                model.learn(*(c[at : at + HELD_BATCHES * BATCH] for c in columns))
            held, waiting = [], 0

        for batch in batches:
            for _, texts in slices(batch.column("text")):
                found = tokens(texts)
                _, _, columns = words.columns(found)
                begin = 0
                while begin < len(found.codes):  # whole texts, until enough tokens wait
                    k = np.searchsorted(found.ends, begin + HELD_BATCHES * BATCH - waiting)
                    end = found.ends[min(k, len(found.ends) - 1)]
                    held.append(tuple(c[begin:end] for c in columns))
                    waiting += end - begin
                    begin = end
                    if waiting >= HELD_BATCHES * BATCH:
                        learn()
        if waiting:
            learn()
        rows = np.flatnonzero(model.met)
        values = model.table[rows].astype(np.float64) * model.met[rows, None]
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(model.met[rows]), *(pa.array(values[:, k]) for k in range(DIM + 1))], ["at", "n", *VALUES])

    return releasing(run)


def _scored(shared, weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_memory()
        words: Vocabulary = shared.value
        words.prepare()
        model = LogBilinear(words.class_counts)
        model.table = weights.value
        model.prepare()
        row = TaskContext.get().partitionId() << 33
        kinds = {"row": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "n_sure": pa.int64(), "base": pa.float64(), "score": pa.float64()}
        for batch in batches:
            for at, texts in slices(batch.column("text")):
                found = tokens(texts)
                places, classes, columns = words.columns(found)
                sure = places >= 0
                base, inner = np.full(len(places), -words.base_denominator), np.empty(len(places))
                base[sure], inner[sure] = words.base[places[sure]], words.inner[places[sure]]
                inner[~sure] = -words.suffix_denominator[classes[~sure] - words.own]
                texts_of = np.repeat(np.arange(len(texts)), np.diff(found.ends, prepend=0))
                sums = [np.add.reduceat(v, found.starts) for v in (sure[found.codes].astype(np.int64), base[found.codes], inner[found.codes] + model.log10(*columns))]
                rare, times = np.unique((texts_of * len(places) + found.codes)[~sure[found.codes]], return_counts=True)
                offsets = pa.array(np.searchsorted(rare // len(places), np.arange(len(texts) + 1)), pa.int32())
                rows = np.arange(row, row + len(texts))
                row += len(texts)
                out = [pa.array(rows), batch.column("doc_id").slice(at, len(texts)), pa.array(np.diff(found.ends, prepend=0)), *map(pa.array, sums)]
                out = [c.cast(kind) for c, kind in zip(out, kinds.values(), strict=True)]
                lists = (found.words.take(pa.array(rare % len(places))).cast(pa.binary()), pa.array(times, pa.int64()))
                yield pa.RecordBatch.from_arrays([*out, *(pa.ListArray.from_arrays(offsets, c) for c in lists)], [*kinds, "rare", "times"])

    return releasing(run)


def score_texts(documents: DataFrame, known_words: int = KNOWN_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``documents``.

    Learns from rows that are not held out. A null text is empty: one end token. A null doc_id is not held
    out. Repeated rows are counted and returned each. Other columns are ignored; no rows: no rows.
    Without training rows all tokens are unknown and the model is its start.
    """
    context = documents.sparkSession.sparkContext
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learned = docs.filter(~held_out(F.col("doc_id"))).select("text")
    counts = keep(learned.mapInArrow(_counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    words = vocabulary(counts, known_words)
    shared = context.broadcast(words)
    schema = "at int, n double, " + ", ".join(f"{v} double" for v in VALUES)
    trained = learned.mapInArrow(_trained(shared), schema).groupBy("at").agg(*((F.sum(v) / F.sum("n")).alias(v) for v in VALUES)).toArrow()  # one row per row of parameters
    words.prepare()
    model = LogBilinear(words.class_counts)
    if trained.num_rows:
        model.table[trained.column("at").to_numpy()] = np.column_stack([trained.column(v).to_numpy() for v in VALUES])
    weights = context.broadcast(model.table)
    schema = "row long, doc_id long, n_tokens long, n_sure long, base double, score double, rare array<binary>, times array<long>"
    scored = keep(docs.mapInArrow(_scored(shared, weights), schema), "scored")

    # words beyond the table: their counts come by join
    spread = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    found = spread.join(counts, "word", "left").select("row", "times", F.coalesce("c", F.lit(0)).alias("c"))
    sums = found.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"))
    more = F.coalesce("logs", F.lit(0.0))
    return scored.drop("rare", "times").join(sums, "row", "left").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_sure") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )
