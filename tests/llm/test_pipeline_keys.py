"""Rows with a repeated or null doc_id through the stages that drop rows."""

from __future__ import annotations

import corpus_pipeline
from engramlake.session import scratch_path
from pyspark.sql import functions as F

PATH = "/root/testdata/sf0.001"


def text(name, changed=0):
    return " ".join(f"{name}{k}" if k >= changed else f"{name}other{k}" for k in range(300))


def run(spark, name, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    return sorted(((r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)[name](spark, docs, PATH).collect()), key=str)


def test_exact_duplicates(spark):
    a, b, c = text("a"), text("b"), text("c")
    rows = [(5, a), (7, a), (7, b), (9, b), (None, a), (None, c), (None, c), (9, None), (9, "")]
    got = run(spark, "exact_duplicates", rows)
    assert sorted([(d, t or "") for d, t in got], key=str) == sorted([(7, a), (9, b), (None, c), (9, "")], key=str)


def test_near_duplicates(spark):
    rows = [(5, text("a")), (7, text("a", 3)), (7, text("b")), (9, text("b", 3)), (None, text("b", 1)), (None, text("c")), (None, text("c", 2)), (9, text("d"))]
    got = run(spark, "near_duplicates", rows)
    assert len(got) == 4 and {(5, text("a")), (7, text("b")), (9, text("d"))} < set(got)
    assert sum(d is None and t.startswith("c") for d, t in got) == 1


def test_decontaminated(spark):
    item = spark.read.parquet(f"{PATH}/benchmark.parquet").first().text
    rows = [(None, item), (None, text("a")), (5, f"x {item} y"), (5, text("b")), (6, text("c"))]
    assert run(spark, "decontaminated", rows) == sorted([(None, text("a")), (5, text("b")), (6, text("c"))], key=str)


def test_quality(spark):
    """A null doc_id and one with two texts have the verdicts of the same texts under ids of their own."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{PATH}/documents.parquet").collect()]
    kept = set(t for _, t in run(spark, "quality", docs))
    gone = next(t for _, t in docs if t not in kept)
    stays = next(t for _, t in docs if t in kept)
    got = run(spark, "quality", [*docs, (None, gone), (None, stays), (-5, gone), (-5, stays)])
    assert {(None, stays), (-5, stays)} < set(got) and not {(None, gone), (-5, gone)} & set(got)


def test_pipeline_twice_in_a_session_and_on_nothing(spark):
    first = corpus_pipeline.run(spark, PATH).select("doc_id", "start", "length").collect()
    assert first and sorted(first) == sorted(corpus_pipeline.run(spark, PATH).select("doc_id", "start", "length").collect())
    folder = scratch_path(spark, "nothing")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{PATH}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
