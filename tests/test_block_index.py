"""The blocked full-text index beside the plain search."""

from __future__ import annotations

import os
import random
from collections import Counter
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from engramlake.operators import block_index
from engramlake.operators.block_index import EVERY_UNIT, block_search, build_block_index
from engramlake.operators.retrieve import bm25_search, build_text_index, query_terms

SCHEMA = "id string, content string, region_id string"


def made(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    weight = [1 / (k + 1) for k in range(300)]
    rows = [(f"u{k:04}", " ".join(rng.choices(words, weight, k=rng.randint(1, 60))), rng.choice(["a", "a", "a", "b", "c"])) for k in range(n)]
    rows += [(f"copy{k}", *rows[k][1:]) for k in range(20)]  # ties
    return rows + [("none", None, "a"), ("empty", "", "b"), ("signs", "?! ...", "c"), ("nowhere", "w1 w2 w299", None), ("long", "w7 " * 30_000, "a")]


def found(df):
    return Counter((r.query_id, r.id, r.score, r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def given(spark):
    units = spark.createDataFrame(made(1), SCHEMA)
    rng = random.Random(2)
    asked = [(f"q{k}", " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(1, 6)))) for k in range(25)]
    asked += [("none", None), ("blank", " "), ("unknown", "zzz"), ("repeated", "w3 w3 W3"), ("common", "w0 w1 w2")]
    queries = spark.createDataFrame(asked, "query_id string, query string")
    scopes = spark.createDataFrame([(q, r) for k, (q, _) in enumerate(asked) for r in ["a", "b", "c"][: k % 4]] + [("q1", "a")], "query_id string, region_id string")
    return units, queries, scopes


def test_postings_frequencies_and_statistics_are_those_of_the_plain_index(given):
    units, _, _ = given
    plain, blocks = build_text_index(units), build_block_index(units, block_units=8)
    columns = ["term", "id", "tf", "doc_len", "region_id"]
    assert Counter(map(tuple, plain.postings.select(columns).collect())) == Counter(map(tuple, blocks.text_index.postings.select(columns).collect()))
    assert Counter(map(tuple, plain.terms.collect())) == Counter(map(tuple, blocks.text_index.terms.collect()))
    assert plain.stats.first() == blocks.text_index.stats.first()


def test_bounds_hold_and_blocks_are_bounded(given):
    units, _, _ = given
    rows = build_block_index(units, block_units=8).blocks.filter(F.col("term") != EVERY_UNIT).collect()
    for r in rows:
        assert r.n == len(r.units) <= 40
        assert r.most_tf == max(u.tf for u in r.units)
        assert r.least_spread == min(u.doc_len / u.tf for u in r.units)


@pytest.mark.parametrize("size", [1, 8, 1000])
@pytest.mark.parametrize("k", [1, 10])
def test_block_search_equals_the_plain_search(given, size, k):
    units, queries, scopes = given
    plain, blocks = build_text_index(units), build_block_index(units, block_units=size)
    assert found(block_search(queries, blocks, k)) == found(bm25_search(queries, plain, k))
    assert found(block_search(queries, blocks, k, scopes=scopes)) == found(bm25_search(queries, plain, k, scopes=scopes))


def test_empty_tables_and_units_without_regions(spark, given):
    units, queries, scopes = given
    none = build_block_index(units.limit(0))
    assert none.text_index.stats.first().n_docs == 0
    assert block_search(queries, none, 5).count() == 0
    assert block_search(queries, none, 5, scopes=scopes).count() == 0
    bare = build_block_index(units.drop("region_id"))
    assert block_search(queries.limit(0), bare, 5).count() == 0
    assert found(block_search(queries, bare, 5)) == found(bm25_search(queries, build_text_index(units), 5))


def test_a_search_reads_the_folders_of_its_terms_only(spark, given):
    units, _, _ = given
    blocks = build_block_index(units, folders=64)
    terms = query_terms(spark.createDataFrame([("q", "w5 w250")], "query_id string, query string"))

    def size(df):
        return sum(os.path.getsize(urlparse(r[0]).path) for r in df.select(F.input_file_name()).distinct().collect())

    read = blocks.of(terms)
    assert len(read.select("folder").distinct().collect()) <= 2
    assert 0 < size(read) < size(blocks.blocks) / 8


def test_few_blocks_are_scored_for_few_hits(given, monkeypatch):
    """A rare term leaves out the blocks that only hold a frequent one."""
    units, queries, _ = given
    blocks = build_block_index(units, block_units=4)
    asked = queries.sparkSession.createDataFrame([("q", "w0 w290")], "query_id string, query string")
    seen, plain = [], block_index.top_rows
    monkeypatch.setattr(block_index, "top_rows", lambda df, *rest: seen.append(df) or plain(df, *rest))
    hits = block_search(asked, blocks, 1).collect()
    reach = seen[0]
    floor = hits[0].score
    assert reach.count() > 4 * reach.filter(F.col("reach") >= floor).count()


def test_build_shuffles_texts_once_and_search_no_single_scores(spark, tmp_path):
    from engramlake.operators import retrieve

    rows = [(f"u{n}", f"r{n % 3}", f"common word{n % 5} own{n} common") for n in range(300)]
    units = spark.createDataFrame(rows, "id string, region_id string, content string")
    queries = spark.createDataFrame([(f"q{n}", f"common own{n} word{n % 5}") for n in range(20)], "query_id string, query string")
    index = build_block_index(units, str(tmp_path / "index"), 4, block_units=16).text_index
    assert index.blocks is not None
    hits = retrieve.bm25_search(queries, index, 5)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    grouped = next(line for line in plan.splitlines() if "Aggregate" in line and "query_id" in line)
    assert "Aggregate [block#" in grouped
    plain = retrieve.bm25_search(queries, retrieve.build_text_index(units), 5)
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, plain.select(*hits.columns).collect()))
