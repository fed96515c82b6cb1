"""Streaming capture ingestion and bounded replay of a backlog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from engramlake.sources.captures import CAPTURE_FIELDS, CORRUPT, READ_SCHEMA, split_captures

# Fixed value: backlog records handled per run.
REPLAY_FILES = 8
DEDUP_WATERMARK = "7 days"
ID_BUCKETS = 64


def read_capture_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of parsed capture lines; malformed lines keep their text in the corrupt column."""
    reader = spark.readStream.schema(READ_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def stream_captures(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Valid events without exact repeats: same id and content within the watermark."""
    valid, _ = split_captures(read_capture_stream(spark, path, max_files))
    return (
        valid.withColumn("content_hash", F.sha2("content", 256))
        .withWatermark("instant", DEDUP_WATERMARK)
        .dropDuplicatesWithinWatermark(["event_id", "content_hash"])
    )


def _stored(spark: SparkSession, path: str, batch_id: int, schema) -> DataFrame:
    """Rows of earlier batches; a repeated batch does not see its own first attempt."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path).filter(F.col("batch_id") < batch_id)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def ingest_captures(
    spark: SparkSession, source: str, events_path: str, conflicts_path: str, checkpoint: str, max_files: int | None = None
) -> StreamingQuery:
    """Append first arrivals to ``events_path`` and divert conflicting ids to ``conflicts_path``.

    Events may come in any order and at any age: nothing is late. Stored events lie in buckets by a
    hash of their id, and ids and digests of the buckets that a batch touches are read back to drop
    exact repeats and to find ids that exist with other content. A batch writes its own partition, so repeating
    it after a failure replaces what it wrote.
    """
    keep = [*CAPTURE_FIELDS, "instant", "content_hash"]

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        bucket = F.pmod(F.xxhash64("event_id"), F.lit(ID_BUCKETS)).cast("int")
        rows = batch.select(*keep).dropDuplicates(["event_id", "content_hash"])
        rows = rows.withColumn("bucket", bucket).withColumn("batch_id", F.lit(batch_id).cast("long")).persist()
        try:
            schema = rows.schema
            touched = F.broadcast(rows.select("bucket").distinct())  # at most ID_BUCKETS rows
            history = _stored(session, events_path, batch_id, schema).join(touched, "bucket", "left_semi")
            known = history.groupBy("event_id").agg(F.min_by("content_hash", "batch_id").alias("known_hash"))
            first = rows.groupBy("event_id").agg(
                F.min_by("content_hash", F.struct("instant", "content_hash")).alias("first_hash")
            )
            judged = rows.join(first, "event_id").join(known, "event_id", "left")
            held = F.coalesce("known_hash", "first_hash")
            fresh = judged.filter(F.col("known_hash").isNull() & (F.col("content_hash") == F.col("first_hash")))
            clashing = judged.filter(F.col("content_hash") != held)
            for frame, path in ((fresh, events_path), (clashing, conflicts_path)):
                (
                    frame.select(*schema.names)
                    .write.mode("overwrite")
                    .option("partitionOverwriteMode", "dynamic")
                    .partitionBy("batch_id", "bucket")
                    .parquet(path)
                )
        finally:
            rows.unpersist()

    valid, _ = split_captures(read_capture_stream(spark, source, max_files))
    return (
        valid.withColumn("content_hash", F.sha2("content", 256))
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_replay(
    spark: SparkSession, source: str, accepted_path: str, quarantine_path: str, checkpoint: str
) -> StreamingQuery:
    """Replay a spooled backlog in runs of at most eight records.

    Malformed records go to quarantine and never hold up the rest.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            valid, rejects = split_captures(kept)
            valid.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy("batch_id").parquet(accepted_path)
            rejects.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy("batch_id").parquet(quarantine_path)
        finally:
            kept.unpersist()

    return (
        read_capture_stream(spark, source, REPLAY_FILES)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
