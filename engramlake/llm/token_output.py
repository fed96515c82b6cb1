"""Token-ID output: best-fit-decreasing packing into id matrices, written as a table.

Every task tokenises its own input split and packs blocks of about ``BLOCK_TOKENS`` tokens, so
nothing is shuffled and memory is one block. In a block, documents longer than a row are
split into whole rows and a rest, without loss. The pieces are placed from the longest
to the shortest, each in the open row with the least room that still holds it. The room of all open rows stands in
a segment tree over capacities, so a search is a few steps at any number of rows.

One output row is one row of the id matrix with what attention over packed documents needs: cumulative segment
lengths and position ids that start again with every piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm.tokens import encoded_rows

ROW_TOKENS = 2048
BLOCK_TOKENS = 4_000_000
PAD_ID = 0
END_ID = 1
WRITE_ROWS = 256
SCHEMA = "sequence_id long, n_tokens long, input_ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, starts array<long>, doc_tokens array<long>"


class CapacityTree:
    """Counts of open rows by room left; finds the least room that is at least a wanted one."""

    def __init__(self, top: int) -> None:
        self.leaves = 1 << top.bit_length()
        self.tree = [0] * (2 * self.leaves)

    def add(self, room: int, change: int) -> None:
        node = self.leaves + room
        while node:
            self.tree[node] += change
            node >>= 1

    def least(self, wanted: int) -> int:
        """Smallest room >= wanted that an open row has, or -1."""
        tree, node = self.tree, self.leaves + wanted
        if tree[node]:
            return wanted
        while node > 1:
            if not node & 1 and tree[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return -1


def best_fit_decreasing(sizes: np.ndarray, row: int) -> list[list[int]]:
    """Rows of piece numbers; every size is from 1 to ``row``. Equal sizes keep their order."""
    tree = CapacityTree(row)
    by_room: list[list[int]] = [[] for _ in range(row + 1)]
    rows: list[list[int]] = []
    for piece in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[piece])
        room = tree.least(size)
        if room < 0:
            rows.append([])
            at, room = len(rows) - 1, row
        else:
            at = by_room[room].pop()
            tree.add(room, -1)
        rows[at].append(piece)
        if room > size:
            by_room[room - size].append(at)
            tree.add(room - size, 1)
    return rows


def _matrix(path: str | None, row: int, block_tokens: int):
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        steps = np.arange(row, dtype="<u4")
        pieces: list[tuple] = []
        held = 0

        def block():
            nonlocal number
            sizes = np.array([len(p[2]) for p in pieces], np.int64)
            out: list[tuple] = []
            for members in best_fit_decreasing(sizes, row):
                lengths = [len(pieces[m][2]) for m in members]
                ids = np.full(row, PAD_ID, "<u4")
                total = sum(lengths)
                ids[:total] = np.concatenate([pieces[m][2] for m in members])
                places = np.concatenate([steps[:n] for n in [*lengths, row - total]])
                ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                out.append((number, total, ids.tobytes(), ends, places.tobytes(), [pieces[m][0] for m in members], [pieces[m][1] for m in members], [pieces[m][3] for m in members]))
                number += 1
                if len(out) == WRITE_ROWS:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for doc_id, ids in encoded_rows(batches, path, lasting=True):
            ids = np.append(ids, np.uint32(END_ID))
            for start in range(0, len(ids), row):
                pieces.append((doc_id, start, ids[start : start + row], len(ids)))
            held += len(ids)
            if held >= block_tokens:
                yield from block()
                pieces, held = [], 0
        if pieces:
            yield from block()

    return run


def write_matrices(documents: DataFrame, folder: str, tokenizer: str | None = None, row: int = ROW_TOKENS, block_tokens: int = BLOCK_TOKENS) -> None:
    """Write the packed rows of ``documents`` (doc_id, text) as Parquet below ``folder``.

    sequence_id, n_tokens, input_ids (little-endian unsigned 32-bit, padded to ``row`` with id 0), cu_seqlens (0 and the end of
    every piece), position_ids (as input_ids; from 0 in every piece and in the padding), and per piece doc_ids, starts and
    doc_tokens. Each document ends with id 1. A null text is empty and gives that id alone; repeated
    rows are packed each; a null doc_id stays null; other columns are ignored; no rows: an empty table.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = docs.mapInArrow(_matrix(tokenizer, row, block_tokens), SCHEMA)
    packed.write.mode("errorifexists").option("compression", "zstd").parquet(folder)


def pieces_of(matrices: DataFrame) -> DataFrame:
    """One row per piece of a written table: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = matrices.select("sequence_id", "input_ids", "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "starts", "doc_tokens")).alias("at", "p"))
    first, end = F.get("cu_seqlens", F.col("at")), F.get("cu_seqlens", F.col("at") + 1)
    ids = F.substr("input_ids", 4 * first + 1, 4 * (end - first))
    return rows.select(
        F.col("p.doc_ids").alias("doc_id"), F.col("p.starts").alias("start"), (end - first).cast("long").alias("length"), F.crc32(ids).alias("ids_crc32"),
        F.col("p.doc_tokens").alias("doc_tokens"), "sequence_id", first.cast("long").alias("offset"),
    )
