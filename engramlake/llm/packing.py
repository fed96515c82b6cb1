"""Sum-of-squares online packing of token ids into sequences.

Every task packs the documents of its own input split as they come, so nothing is shuffled and memory
is bounded by the windows still open. A level array counts the partially filled windows of each fill
level. A document goes to the level where the sum of the squared counts grows least, which keeps
levels in a mix that later documents can complete. Documents longer than a window first fill whole windows.

At the end of a split the windows still open are closed by cutting: the emptiest give tokens to the
fullest, and the last one becomes sequences of powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm.tokens import encoded_rows

WINDOW = 2048
END_ID = 1
OUTPUT_ROWS = 4096
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

# a piece is [doc_id, start, ids, tokens of its document]


class SquarePacker:
    """Online packer; ``add`` and ``finish`` return the sequences that became complete."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]

    def add(self, doc_id, ids: np.ndarray) -> list[list]:
        done = []
        total = len(ids)
        whole = total - total % self.window
        for start in range(0, whole, self.window):
            done.append([[doc_id, start, ids[start : start + self.window], total]])
        if whole < total:
            done += self._place([doc_id, whole, ids[whole:], total])
        return done

    def _place(self, piece: list) -> list[list]:
        size, window, counts = len(piece[2]), self.window, self.counts
        lower = counts[1 : window - size + 1]
        growth = np.where(lower > 0, 2 * (counts[1 + size : window + 1] - lower) + 2, np.iinfo(np.int64).max)
        level = 0
        if len(growth):
            if lower[-1] > 0:
                growth[-1] = 1 - 2 * lower[-1]  # a full window leaves the sum
            best = len(growth) - 1 - int(np.argmin(growth[::-1]))  # ties: the fullest level
            if growth[best] <= 2 * counts[size] + 1:
                level = best + 1
        held = self.open[level].pop() if level else []
        counts[level] -= level > 0
        held.append(piece)
        if level + size == window:
            return [held]
        self.open[level + size].append(held)
        counts[level + size] += 1
        return []

    def finish(self) -> list[list]:
        left = [(level, held) for level in range(self.window - 1, 0, -1) for held in self.open[level]]
        self.__init__(self.window)
        done, i, j = [], 0, len(left) - 1
        while i < j:
            level, held = left[i]
            while level < self.window and i < j:
                rest, giver = left[j]
                moved, giver = _cut(giver, min(rest, self.window - level))
                held += moved
                level += sum(len(p[2]) for p in moved)
                left[j] = (rest - sum(len(p[2]) for p in moved), giver)
                j -= not giver
            left[i] = (level, held)
            if level == self.window:
                done.append(held)
                i += 1
        for level, held in left[i : j + 1]:
            while level:
                size = 1 << (level.bit_length() - 1)
                part, held = _cut(held, size)
                done.append(part)
                level -= size
        return done


def _cut(pieces: list[list], size: int) -> tuple[list[list], list[list]]:
    """The first ``size`` tokens of ``pieces``, and the rest."""
    taken = []
    for at, piece in enumerate(pieces):
        doc_id, start, ids, total = piece
        if len(ids) >= size:
            rest = [[doc_id, start + size, ids[size:], total]] if len(ids) > size else []
            return [*taken, [doc_id, start, ids[:size], total]], rest + pieces[at + 1 :]
        taken.append(piece)
        size -= len(ids)
    return taken, []


def piece_batch(rows: list[tuple], sequences: int) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 7
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])


def _pack(path: str | None, window: int, lasting: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = SquarePacker(window)
        number = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def emit(done):
            nonlocal number
            for held in done:
                offset = 0
                for doc_id, start, ids, total in held:
                    rows.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), total, number, offset))
                    offset += len(ids)
                number += 1

        for doc_id, ids in encoded_rows(batches, path, lasting):
            emit(packer.add(doc_id, np.append(ids, np.uint32(END_ID))))
            if len(rows) >= OUTPUT_ROWS:
                yield piece_batch(rows, number)
                rows.clear()
        emit(packer.finish())
        yield piece_batch(rows, number)

    return run


def pack_sequences(documents: DataFrame, tokenizer: str | None = None, window: int = WINDOW, lasting: bool = False) -> DataFrame:
    """One row per piece of every row of ``documents`` (doc_id long, text string).

    doc_id, start (ids of the document before the piece), length, ids (little-endian unsigned 32-bit),
    doc_tokens (with the end id), sequence_id (unique over all splits), offset (gapless from 0). Every
    id lies in exactly one piece and no sequence is longer than ``window``. A null text is empty and
    gives one end id; repeated rows are packed each; a null doc_id is kept as null; other columns are
    ignored; an empty table gives no rows. With ``lasting`` later tasks of a worker find the chunks of
    earlier ones, for jobs that do nothing else with their workers.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_pack(tokenizer, window, lasting), SCHEMA)
