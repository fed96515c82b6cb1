"""The inverted-file index beside the exact search."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from engramlake.operators import vector_index
from engramlake.operators.retrieve import vector_search
from engramlake.operators.vector_index import ODD_CELL, build_vector_index, indexed_search, spherical_means

ODD = [("none", None), ("empty", []), ("short", [1.0, 2.0]), ("zero", [0.0] * 16), ("long", [1.0] * 17)]


def rows(seed, n=900, groups=12, dim=16):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dim))
    found = [(f"v{k}", (centers[k % groups] + 0.5 * rng.normal(size=dim)).round(3).tolist()) for k in range(n)]
    return found + [(f"copy{k}", found[k][1]) for k in range(15)]  # ties


@pytest.fixture(scope="module")
def given(spark):
    vectors = spark.createDataFrame(rows(1) + ODD, "id string, vector array<float>").withColumn("region_id", F.concat(F.lit("r"), F.pmod(F.xxhash64("id"), F.lit(3))))
    asked = [(f"q{k}", v) for k, (_, v) in enumerate(rows(1)[:200:5] + rows(2)[:20])] + [(f"odd-{name}", v) for name, v in ODD]
    queries = spark.createDataFrame(asked, "query_id string, vector array<float>")
    return vectors, queries, build_vector_index(vectors, 16)


def found(df):
    return Counter((r.query_id, r.id, round(r.score, 6), r["rank"]) for r in df.collect())


def test_every_vector_lies_in_one_cell(given):
    vectors, _, index = given
    placed = index.placed.collect()
    assert Counter(r.id for r in placed) == Counter(r.id for r in vectors.collect())
    assert {r.id for r in placed if r.cell == ODD_CELL} == {name for name, _ in ODD}
    assert sum(index.rows.values()) == len(placed) and len(index.centroids) == round(len(placed) ** 0.5)
    unit = {r.id: np.array(r.vector) / np.linalg.norm(r.vector) for r in placed if r.cell != ODD_CELL}
    for r in placed:
        if r.cell != ODD_CELL:
            scores = index.centroids @ unit[r.id]
            assert scores[r.cell] >= scores.max() - 1e-9
            assert np.arccos(min(1.0, scores[r.cell])) <= index.radius[r.cell] + 1e-6


def test_all_probes_and_the_exact_finish_equal_the_exact_search(given, monkeypatch):
    vectors, queries, index = given
    want = found(vector_search(queries, vectors, 10))
    assert found(indexed_search(queries, index, 10, probes=len(index.centroids))) == want
    for probes in (1, 4):
        assert found(indexed_search(queries, index, 10, probes=probes, exact=True)) == want
    monkeypatch.setattr(vector_index, "PART_VALUES", 160)
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", 3)
    assert found(indexed_search(queries, index, 10, probes=2, exact=True)) == want


def test_recall_of_probing(given):
    """Queries like the vectors; for others, which the sample does not know, the exact finish is there."""
    vectors, queries, index = given
    queries = queries.filter(F.substring("query_id", 2, 9).try_cast("int") < 40)
    want = {(r.query_id, r.id) for r in vector_search(queries, vectors, 10).collect()}
    got = {(r.query_id, r.id) for r in indexed_search(queries, index, 10).collect()}
    assert len(want) == 400 and len(want & got) / len(want) >= 0.9


def test_recall_on_the_given_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    vectors = table.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    queries = table.filter("vec_id % 5 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"))
    want = {(r.query_id, r.id) for r in vector_search(queries, vectors, 10).collect()}
    got = {(r.query_id, r.id) for r in indexed_search(queries, build_vector_index(vectors, 64), 10).collect()}
    assert len(want & got) / len(want) >= 0.9


def test_scopes_come_first(spark, given):
    vectors, queries, index = given
    scopes = queries.select("query_id", F.explode(F.array(F.lit("r0"), F.lit("r2"))).alias("region_id")).filter("query_id != 'q3'")
    want = found(vector_search(queries, vectors, 10, scopes=scopes))
    assert found(indexed_search(queries, index, 10, probes=3, exact=True, scopes=scopes)) == want
    assert not [r for r in want if r[0] == "q3"]


def test_small_and_empty_tables(spark):
    none = spark.createDataFrame([], "id string, vector array<float>")
    one = spark.createDataFrame([("a", [1.0, 0.0])], "id string, vector array<float>")
    queries = spark.createDataFrame([("q", [1.0, 1.0]), ("z", None)], "query_id string, vector array<float>")
    assert indexed_search(queries, build_vector_index(none, 2), 5, exact=True).count() == 0
    assert found(indexed_search(queries, build_vector_index(one, 2), 5, exact=True)) == Counter([("q", "a", 0.707107, 1), ("z", "a", -1.0, 1)])


def test_means_keep_every_cell_in_use():
    rng = np.random.default_rng(3)
    sample = rng.normal(size=(400, 8))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    centroids = spherical_means(sample, 40)
    assert np.allclose(np.linalg.norm(centroids, axis=1), 1) and len(set((sample @ centroids.T).argmax(1).tolist())) >= 36
