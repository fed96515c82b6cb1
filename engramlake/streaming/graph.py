"""Entity-graph refresh behind the publication of memories."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from engramlake.hooks import Extractor, extract_entities, memory_context, name_extractor
from engramlake.operators.entities import EntityGraph, eligible_memories, project
from engramlake.session import written
from engramlake.sources.extractions import parse_extractions
from engramlake.sources.sinks import replace_regions

Projector = Callable[[DataFrame], tuple[EntityGraph, DataFrame]]


def projector(extractor: Extractor = name_extractor) -> Projector:
    """Project whole regions of published memories with the given entity hook."""

    def run(published: DataFrame) -> tuple[EntityGraph, DataFrame]:
        # Read by every step of the projection, so merged, judged and extracted once.
        eligible = written(eligible_memories(published)[0], "eligible")
        contexts = eligible.select("region_id", "memory_id", memory_context(F.col("memory_id"), F.col("content")).alias("context"))
        parsed, _ = parse_extractions(extract_entities(contexts, extractor), "raw", "graph")
        parsed = written(parsed.select("region_id", "memory_id", "entities", "relations"), "extractions")
        memories = eligible.select(
            "region_id", "memory_id", F.array("content").alias("texts"), F.array("region_name").alias("region_texts"),
            "source_references", "lifecycle", "updated_s",
        )
        known = memories.limit(0).select(
            "region_id", *[F.lit("").alias(c) for c in ("entity_type", "normalized_alias", "entity_id")], F.lit(True).alias("canonical")
        )
        return project(memories, parsed, known)

    return run


def stream_graph(
    published: DataFrame, memories_path: str, graph_path: str, status_path: str, checkpoint: str, project_regions: Projector
) -> StreamingQuery:
    """Publish each batch of memories, then rebuild the graph of the regions it touches.

    Publication comes first and does not depend on the graph: when a refresh fails, the
    memories and the last good graph stay and the regions are marked degraded.
    """

    def refresh(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch_id").parquet(memories_path)
        touched = batch.select("region_id").distinct()
        everything = session.read.parquet(memories_path).drop("batch_id").select(*batch.columns)
        regions = everything.join(touched, "region_id", "left_semi")
        newest = regions.groupBy("region_id", "memory_id").agg(
            F.max_by(F.struct(*[c for c in batch.columns if c not in ("region_id", "memory_id")]), "updated_s").alias("m")
        ).select("region_id", "memory_id", "m.*")
        state, detail = "ready", ""
        try:
            graph, _ = project_regions(newest)
            for field in fields(EntityGraph):
                replace_regions(getattr(graph, field.name), f"{graph_path}/{field.name}", touched)
        except Exception as error:  # the graph follows the memories, never the other way round
            state, detail = "degraded", type(error).__name__
        touched.select("region_id", F.lit(state).alias("status"), F.lit(detail).alias("error"), F.lit(batch_id).alias("batch_id")).write.mode(
            "overwrite"
        ).option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(status_path)

    return (
        published.writeStream.foreachBatch(refresh)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
