"""The corpus pipeline: documents through classifier, deduplication, decontamination and packing.

Each stage takes what its predecessor kept and returns documents, the last one packed pieces.
Rows are told apart by doc_id and text: where a doc_id is null or stands for several texts, each text is judged
and dropped on its own. Rows equal in both are one document to every stage that drops rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.llm.decontaminate import contaminated
from engramlake.llm.exact_dedup import exact_copies, sha256
from engramlake.llm.ngram_join import similar_classes
from engramlake.llm.packing import pack_sequences
from engramlake.llm.quality import predict, train
from engramlake.llm.store import keep

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _key(docs: DataFrame) -> Callable[[Column, Column], Column]:
    """The key of a row, from its doc_id and the digest of its text: no two texts share one, and none is null.

    Where every row has a doc_id, and every doc_id one text, that is the doc_id; else a hash of both.
    """
    texts = docs.select("doc_id", F.xxhash64(_text()).alias("h")).groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    if texts.filter("doc_id is null or low != high").isEmpty():
        return lambda doc_id, digest: doc_id.cast("long")
    return lambda doc_id, digest: F.xxhash64(doc_id.cast("long"), digest)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, _key(docs)(F.col("doc_id"), sha256(_text())).alias("key"))


def _by_key(keyed: DataFrame) -> DataFrame:
    """The texts for an operator, with their keys as doc_id."""
    return keyed.select(F.col("key").alias("doc_id"), "text")


def _without(keyed: DataFrame, dropped: DataFrame, label: str) -> DataFrame:
    """``keyed`` without the keys in ``dropped``, which are written first."""
    return keyed.join(keep(dropped.select("key").distinct(), label), "key", "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    keyed = _keyed(docs)
    rejected = predict(train(docs, _table(spark, sf_dir, "labels")), _by_key(keyed)).filter("predicted = 0")
    return _without(keyed, rejected.withColumnRenamed("doc_id", "key"), "rejected").select(*COLUMNS)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays, one without a doc_id only if no other has the text; of repeated rows one stays."""
    key = _key(docs)
    keyed = docs.select(*COLUMNS, key(F.col("doc_id"), sha256(_text())).alias("key"))
    copies = keep(exact_copies(docs).filter("not kept").withColumn("key", key(F.col("doc_id"), F.col("text_sha256"))), "copies")
    rest = _without(keyed, copies.filter("not (doc_id <=> keep_id)"), "exact-copies")
    repeated = copies.filter("doc_id <=> keep_id").select("key").distinct()
    if repeated.isEmpty():
        return rest.select(*COLUMNS)
    # the same doc_id and text more than once: only such rows are gathered by their keys
    once = rest.join(repeated, "key", "left_semi").dropDuplicates(["key"])
    return rest.join(repeated, "key", "left_anti").unionByName(once).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near copies the document with the smallest doc_id stays, one without a doc_id only among such."""
    keyed = _keyed(docs)
    linked = similar_classes(_by_key(keyed)).filter("doc_id != component_id").select(F.col("doc_id").alias("key"), F.col("component_id").alias("head"))
    linked = keep(linked.distinct(), "near-linked")
    members = linked.union(linked.select("head", "head").distinct())
    # a class is known by its smallest key, which is not the smallest doc_id where keys are hashes
    named = members.join(keyed.select("key", "doc_id").distinct(), "key")
    first = named.groupBy("head").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    return _without(keyed, members.join(first, "head").filter("key != first.key"), "near-copies").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    keyed = _keyed(docs)
    found = contaminated(_by_key(keyed), _table(spark, sf_dir, "benchmark"))
    return _without(keyed, found.withColumnRenamed("doc_id", "key"), "contaminated").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all remaining documents, packed: one row per piece."""
    return pack_sequences(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("packed", packed),
]
# A learned classifier and tokenisation cannot be expressed in SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again for the next."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
