"""Inverted-file vector index: spherical k-means cells, probing, exact re-scoring, and an exact finish.

The cells are fitted on a bounded sample and every vector is placed in one. A search scores the vectors of the
cells nearest to a query with the exact cosine; asked to be exact, it then goes through only those further
cells whose widest vector could still enter the query's first ``k``. Vectors that cosine cells cannot hold (null, of another length,
zero) lie in a cell of their own that every query meets, so no vector is out of reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.functions.windows import top_rows
from engramlake.operators.retrieve import cosine
from engramlake.session import scratch_path

ODD_CELL = -1
SAMPLE_ROWS = 65_536
MOST_CELLS = 4_096
PART_VALUES = 1 << 21  # numbers of the vectors that one task holds
BLOCK_QUERIES = 1_024
SCORE_VALUES = 1 << 21  # scores held at once within a task
WANTED_RECALL = 0.95
JUDGE_ROWS, JUDGE_QUERIES, JUDGE_HITS = 8_192, 256, 10
SLACK = 2e-6  # scores are compared after rounding to six places


@dataclass(frozen=True)
class VectorIndex:
    """placed(id, vector, cell, ...scope), stored by cell; unit centroids; widest angle and rows of every cell; cells to probe by default."""

    placed: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    rows: dict[int, int]
    probes: int

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]


def _units(rows: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of vectors with a direction of ``dim`` numbers, their unit vectors)."""
    good = [k for k, v in enumerate(rows) if v is not None and len(v) == dim]
    matrix = np.array([rows[k] for k in good], np.float64).reshape(len(good), dim)
    norms = np.linalg.norm(matrix, axis=1)
    fine = np.isfinite(norms) & (norms > 0)
    return np.array(good, np.int64)[fine], matrix[fine] / norms[fine, None]


def spherical_means(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit rows; a cell that loses all rows takes the row that lies furthest from its own centroid."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        own, near = np.zeros(len(sample), np.int64), np.zeros(len(sample))
        for at in range(0, len(sample), 4096):
            scores = sample[at : at + 4096] @ centroids.T
            own[at : at + 4096], near[at : at + 4096] = scores.argmax(1), scores.max(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        sums[empty] = sample[np.argsort(near)[: len(empty)]]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
    return centroids


def probes_for(sample: np.ndarray, centroids: np.ndarray, recall: float = WANTED_RECALL) -> int:
    """Cells that hold a share of ``recall`` of the nearest rows of queries, both taken from the sample.

    The rows of a sample lie further apart than those of its table, so the number is rather too large.
    """
    base = sample[:JUDGE_ROWS]
    asked = base[:: max(1, len(base) // JUDGE_QUERIES)][:JUDGE_QUERIES]
    cell = (base @ centroids.T).argmax(1)
    near = np.argsort(-(asked @ base.T), axis=1)[:, :JUDGE_HITS]
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)  # place of every cell for every query
    needed = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel())
    return int(needed[math.ceil(recall * len(needed)) - 1]) + 1


def _sample(vectors: DataFrame, dim: int, total: int, rows: int) -> np.ndarray:
    """Unit vectors of the ``rows`` ids with the smallest hashes, whatever the table's size and order."""
    place = F.xxhash64("id") / F.lit(2.0**64) + 0.5
    near = vectors.filter((F.size("vector") == dim) & (place < 4.0 * rows / max(1, total)))
    chosen = near.select("vector", place.alias("place"), "id").orderBy("place", "id").limit(rows).select("vector").toArrow()
    return _units(chosen.column("vector").to_pylist(), dim)[1]


def build_vector_index(
    vectors: DataFrame, dim: int, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, folder: str | None = None, scope_cols: tuple[str, ...] = ("region_id",)
) -> VectorIndex:
    """Place every row of ``vectors`` (id, vector, ...scope) in the cell whose centroid is nearest.

    The centroids come from at most ``sample_rows`` vectors; there are about the square root of the number of rows, at most
    ``MOST_CELLS``. The index is written to ``folder`` (a new one by default) with one directory a cell.
    """
    spark = vectors.sparkSession
    scope = [c for c in scope_cols if c in vectors.columns]
    total = vectors.count()
    sample = _sample(vectors, dim, total, sample_rows)
    wanted = cells or round(math.sqrt(total))
    n_cells = max(1, min(wanted, MOST_CELLS, len(sample)))
    centroids = spherical_means(sample, n_cells) if len(sample) else np.eye(1, dim)
    probes = probes_for(sample, centroids) if len(sample) else 1

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, near = np.full(len(batch), ODD_CELL, np.int32), np.full(len(batch), np.nan)
            good, units = _units(batch["vector"].tolist(), dim)
            for at in range(0, len(good), 4096):
                scores = units[at : at + 4096] @ centroids.T
                cell[good[at : at + 4096]], near[good[at : at + 4096]] = scores.argmax(1), scores.max(1)
            yield batch.assign(cell=cell, near=near)

    rows = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"), *scope)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", cell int, near double"
    folder = folder or scratch_path(spark, "vector-index")
    rows.mapInPandas(place, schema).write.partitionBy("cell").parquet(folder)
    return open_vector_index(spark, folder, schema, centroids, probes)


def open_vector_index(spark: SparkSession, folder: str, schema: str, centroids: np.ndarray, probes: int) -> VectorIndex:
    placed = spark.read.schema(schema).parquet(folder)
    counted = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("near")).collect()  # at most MOST_CELLS + 1 rows
    radius = np.zeros(len(centroids))
    for row in counted:
        if row.cell >= 0:
            radius[row.cell] = math.acos(max(-1.0, min(1.0, row.near)))
    return VectorIndex(placed, centroids, radius, {row.cell: row.n for row in counted}, probes)


def _asked(queries: DataFrame, index: VectorIndex, probes: int, floor: str | None = None) -> DataFrame:
    """(query_id, vector, cell, ...) of the cells to go through: the nearest ``probes``, or the others that may still hold a row above ``floor``."""
    centroids, radius, dim = index.centroids, index.radius, index.dim
    held = np.array([cell in index.rows for cell in range(len(centroids))])

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good, units = _units(batch["vector"].tolist(), dim)
            cells: list[list[int]] = [[*np.flatnonzero(held), ODD_CELL] if floor is None else [] for _ in range(len(batch))]
            for at, unit in zip(good.tolist(), units, strict=True):
                near = np.where(held, unit @ centroids.T, -2.0)
                order = np.argsort(-near, kind="stable")
                if floor is None:
                    cells[at] = [*[c for c in order[:probes] if held[c]], ODD_CELL]
                else:
                    least = batch[floor].iat[at]
                    reach = np.cos(np.maximum(0.0, np.arccos(np.clip(near, -1, 1)) - radius))
                    cells[at] = [c for c in order[probes:] if held[c] and (least is None or np.isnan(least) or reach[c] >= least - SLACK)]
            yield batch.assign(cell=cells)

    kept = [f for f in queries.schema if f.name != floor]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema) + ", cell array<int>"
    return queries.mapInPandas(pick, schema).select(*[f.name for f in kept], F.explode("cell").alias("cell"))


def _best(k: int):
    def run(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        ids = shard["id"].to_numpy(object)
        by_id = np.empty(len(ids), np.int64)
        by_id[np.argsort(ids.astype(str), kind="stable")] = np.arange(len(ids))
        sizes = shard["vector"].map(lambda v: 0 if v is None else len(v)).to_numpy()
        widths = block["vector"].map(lambda v: 0 if v is None else len(v)).to_numpy()
        out: list[tuple[list, np.ndarray, np.ndarray]] = []
        for width in sorted(set(widths.tolist())):
            same = np.flatnonzero(sizes == width) if width else np.zeros(0, np.int64)
            right = np.array(shard["vector"].iloc[same].tolist(), np.float64)
            asked = np.flatnonzero(widths == width)
            step = max(1, SCORE_VALUES // max(1, len(ids)))
            for at in range(0, len(asked), step):
                rows = asked[at : at + step]
                scores = np.full((len(rows), len(ids)), -1.0)
                if len(same):
                    scores[:, same] = cosine(np.array(block["vector"].iloc[rows].tolist(), np.float64), right)
                scores = np.round(scores, 6)
                for row, query_id in zip(scores, block["query_id"].iloc[rows], strict=True):
                    order = np.lexsort((by_id, -row))[:k]
                    out.append(([query_id] * len(order), ids[order], row[order]))
        columns = [np.concatenate([np.array(part[c], object if c < 2 else np.float64) for part in out]) if out else np.zeros(0) for c in range(3)]
        return pd.DataFrame({"query_id": columns[0].astype(object), "id": columns[1].astype(object), "score": columns[2].astype(np.float64)})

    return run


def _through(asked: DataFrame, index: VectorIndex, k: int, place: list[str]) -> DataFrame:
    """The ``k`` best of every (query, cell part) asked; parts and blocks of queries are of bounded size."""
    counts = {row.cell: row.n for row in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most MOST_CELLS + 1 rows
    per_part = max(1, PART_VALUES // max(1, index.dim))
    shape = [(c, math.ceil(index.rows[c] / per_part), math.ceil(n / BLOCK_QUERIES)) for c, n in counts.items() if c in index.rows]
    spark = asked.sparkSession
    sized = F.broadcast(spark.createDataFrame(shape, "cell int, parts long, blocks long"))
    read = index.placed.filter(F.col("cell").isin([c for c, _, _ in shape])).select("id", "vector", "cell", *place)
    left = read.join(sized, "cell").select("id", "vector", *place, "cell", F.pmod(F.xxhash64("id"), "parts").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    right = asked.join(sized, "cell").select("query_id", "vector", *place, "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("query_id"), "blocks").alias("block"))
    keys = [*place, "cell", "part", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_best(k), "query_id string, id string, score double")


def indexed_search(queries: DataFrame, index: VectorIndex, k: int, probes: int | None = None, exact: bool = False, scopes: DataFrame | None = None) -> DataFrame:
    """Cosine top ``k`` for every query (query_id, vector): query_id, id, score, rank.

    The ``probes`` nearest cells are scored (by default as many as hold ``WANTED_RECALL`` of the hits within the sample); with ``exact`` also every other cell that
    could change the answer, which then equals that of ``vector_search``. A query without a direction goes through all
    cells. With ``scopes`` (query_id, region_id) a query only meets the vectors of its regions.
    """
    probes = index.probes if probes is None else probes
    place = [] if scopes is None else ["region_id"]
    queries = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    where = queries if scopes is None else queries.join(scopes.select("query_id", "region_id").distinct(), "query_id")
    order = [F.col("score").desc(), F.col("id")]
    first = _through(_asked(where, index, probes), index, k, place)
    if not exact or probes >= len(index.centroids):
        return top_rows(first, ["query_id"], order, k)
    path = scratch_path(queries.sparkSession, "probed")
    top_rows(first, ["query_id"], order, k).drop("rank").write.parquet(path)
    first = queries.sparkSession.read.schema("query_id string, id string, score double").parquet(path)
    floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    second = _through(_asked(where.join(floors, "query_id", "left"), index, probes, "floor"), index, k, place)
    return top_rows(first.unionByName(second), ["query_id"], order, k)
