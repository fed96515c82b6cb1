"""Exact deduplication with keyed streaming state.

A streaming query keeps one state row per SHA-256 digest in the RocksDB state store, on the executors'
disks with checkpoints in the shared folder: the stable identifier of the row that stays, its locator
in the feed of digests, and the number of copies. Nothing expires, so a later feed is judged against
all earlier ones. The state is read back as a table, and the whole bytes of every document
whose digest was hit are compared. Only DataFrame functions run, on the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.llm.store import keep
from engramlake.session import scratch_path

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no preallocated files
}
FEED_SCHEMA = "doc_id long, digest string, locator string"
FREQUENT = 4096  # a digest with more than this part of all rows is met by broadcast: there are fewer than FREQUENT of them
SALTS = 16


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def write_feed(documents: DataFrame, feed: str, digest: Callable[[Column], Column] = sha256) -> None:
    """Append (doc_id, digest, locator) of every row to the folder ``feed``.

    The locator is file and row number where the table is read from files, else the row's place in the feed.
    """
    try:
        rows = documents.select("*", F.concat_ws(":", "_metadata.file_path", F.col("_metadata.row_index").cast("string")).alias("__locator"))
    except Exception as error:  # a table that is not read straight from files has no such column
        if getattr(error, "getCondition", lambda: "")() not in ("UNRESOLVED_COLUMN.WITH_SUGGESTION", "UNRESOLVED_COLUMN.WITHOUT_SUGGESTION", "FIELD_NOT_FOUND", "INVALID_EXTRACT_BASE_FIELD_TYPE"):
            raise
        rows = documents.withColumn("__locator", F.monotonically_increasing_id().cast("string"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows.select(F.col("doc_id").cast("long").alias("doc_id"), digest(text).alias("digest"), F.col("__locator").alias("locator")).write.mode("append").parquet(feed)


def update_state(spark: SparkSession, feed: str, state: str) -> DataFrame:
    """Take in what is new in ``feed``; returns (digest, keep_id, keep_locator, group_size) of all state.

    Rows of one digest are pre-aggregated before they are shuffled to its state.
    """
    with _settings(spark, STATE_CONF):
        rows = spark.readStream.schema(FEED_SCHEMA).parquet(feed)
        held = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("top"), F.count("*").alias("n"))
        query = held.writeStream.outputMode("update").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        table = spark.read.format("statestore").load(state)
        top, count = table.schema["value"].dataType.names
        out = table.select("key.digest", F.col(f"value.{top}.doc_id").alias("keep_id"), F.col(f"value.{top}.locator").alias("keep_locator"), F.col(f"value.{count}").alias("group_size"))
        return keep(out, "dedup-state")


def _judged(rows: DataFrame, held: DataFrame) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept) of the rows of a feed; no digest's rows are gathered in one task."""
    total = held.agg(F.sum("group_size")).first()[0] or 0
    often = held.filter(F.col("group_size") * FREQUENT > total)
    frequent = F.broadcast(often.withColumnsRenamed({"keep_id": "often_id", "keep_locator": "often_locator", "group_size": "often_size"}))
    rows = rows.join(frequent, "digest", "left")
    kept = (F.col("locator") == F.col("keep_locator")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    out = ("doc_id", "digest", "keep_id", "group_size", kept.alias("kept"))
    met = rows.filter("often_size is not null").select("doc_id", "digest", "locator", F.col("often_id").alias("keep_id"), F.col("often_locator").alias("keep_locator"), F.col("often_size").alias("group_size"))
    rest = rows.filter("often_size is null").select("doc_id", "digest", "locator").join(held, "digest", "left")
    return met.select(*out).unionByName(rest.select(*out))


def exact_copies(documents: DataFrame, digest: Callable[[Column], Column] = sha256, feed: str | None = None, state: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``documents``.

    Of rows with equal text bytes the one with the largest doc_id stays; of repeated rows exactly one.
    A null text counts as empty; a null doc_id ranks below every other. ``feed`` and ``state`` name
    folders that are kept between calls; rows of earlier calls then count and are returned too, and
    ``documents`` must hold them for the byte check. An empty table gives no rows.
    """
    spark = documents.sparkSession
    feed, state = feed or scratch_path(spark, "dedup-feed"), state or scratch_path(spark, "dedup-state-store")
    write_feed(documents, feed, digest)
    held = update_state(spark, feed, state)
    rows = spark.read.schema(FEED_SCHEMA).parquet(feed)
    judged = keep(_judged(rows, held), "judged")

    # every hit: equal digests must stand for equal bytes
    hits = judged.filter("group_size > 1").select("doc_id", "digest").distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"))
    found = texts.join(hits, F.col("id").eqNullSafe(F.col("doc_id"))).select("id", "text", "digest").filter(digest(F.col("text")) == F.col("digest"))
    spread = found.groupBy("digest", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).agg(F.min("text").alias("low"), F.max("text").alias("high"))
    clash = keep(spread.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low != high").select("digest"), "clashes")
    if not clash.isEmpty():
        judged = _by_bytes(judged, texts, clash, digest)
    if digest is sha256:
        return judged.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
    named = texts.select("id", digest(F.col("text")).alias("digest"), sha256(F.col("text")).alias("text_sha256")).distinct()
    on = named["id"].eqNullSafe(judged["doc_id"]) & (named["digest"] == judged["digest"])
    if "text_sha256" in judged.columns:
        return judged.select("doc_id", "keep_id", "group_size", "kept", F.coalesce("text_sha256", "digest").alias("text_sha256"))
    return judged.join(named, on).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _by_bytes(judged: DataFrame, texts: DataFrame, clash: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Rows of digests that stand for several texts, grouped by the text itself."""
    place = F.monotonically_increasing_id()
    rows = keep(texts.withColumn("digest", digest(F.col("text"))).join(clash, "digest", "left_semi").withColumn("place", place), "clashing-rows")
    groups = rows.groupBy("text").agg(F.max(F.struct("id", "place")).alias("top"), F.count("*").alias("group_size"))
    again = rows.join(groups, "text").select(
        F.col("id").alias("doc_id"), "digest", F.col("top.id").alias("keep_id"), "group_size", (F.col("place") == F.col("top.place")).alias("kept"), sha256(F.col("text")).alias("text_sha256")
    )
    rest = judged.join(clash, "digest", "left_anti")
    return rest.unionByName(again, allowMissingColumns=True)
