"""Recall: scoped search channels, fusion, expansion and packaging as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.operators.filters import VISIBLE_LIFECYCLES, recall_eligible
from engramlake.operators.pack import HARD_TOKEN_LIMIT, pack_context
from engramlake.operators.related import graph_expand
from engramlake.operators.retrieve import bm25_search, build_text_index, fuse, vector_search


def recall_hits(
    queries: DataFrame,
    units: DataFrame,
    limit: int = 10,
    vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
    edges: DataFrame | None = None,
    hops: int = 1,
    include_history: bool = False,
    scopes: DataFrame | None = None,
) -> DataFrame:
    """Fused hits of the available channels; raw and invisible units never enter the ranking.

    ``scopes`` (query_id, region_id) bounds every channel before it ranks anything. Edges then have a scope.
    """
    lifecycles = VISIBLE_LIFECYCLES if include_history else ("active",)
    eligible = recall_eligible(units.filter(F.col("lifecycle").isin(*lifecycles)))
    text_hits = bm25_search(queries, build_text_index(eligible), limit, scopes=scopes)
    channels = text_hits.select("query_id", "id", F.lit("bm25").alias("channel"), "rank")
    if vectors is not None and query_vectors is not None:
        dense = vector_search(
            query_vectors, vectors.join(eligible.select("id", "region_id"), "id"), limit, min_similarity=0.2, scopes=scopes
        )
        channels = channels.unionByName(dense.select("query_id", "id", F.lit("vector").alias("channel"), "rank"))
    if edges is not None:
        seeds = channels.groupBy("query_id", "id").agg(F.min("rank").alias("position"))
        within = None if scopes is None else scopes.withColumnRenamed("region_id", "scope")
        expanded = graph_expand(seeds, edges, hops, nodes=eligible.select("id"), scopes=within)
        channels = channels.unionByName(
            expanded.select("query_id", "id", F.lit("graph").alias("channel"), F.col("position").alias("rank"))
        )
    return fuse(channels, limit)


def recall_packages(
    queries: DataFrame, units: DataFrame, limit: int = 10, token_budget: int = HARD_TOKEN_LIMIT, **channels
) -> DataFrame:
    """One context package per query; ``channels`` are the optional inputs of ``recall_hits``."""
    hits = recall_hits(queries, units, limit, **channels)
    described = hits.join(units.select("id", "region_id", "content", "source", "memory_type"), "id").select(
        "query_id",
        "rank",
        F.col("id").alias("chunk_id"),
        F.col("id").alias("document_id"),
        F.col("region_id").alias("library_id"),
        "region_id",
        F.concat(F.lit("memory://"), "id").alias("path"),
        F.lit("v1").alias("source_version"),
        F.col("memory_type").alias("source_type"),
        "classification",
        "score",
        F.array(F.concat(F.lit("source:"), "source")).alias("source_references"),
        F.create_map(F.lit("channels"), F.col("retrieval_sources")).alias("user_metadata"),
        "content",
    )
    return pack_context(queries.withColumn("token_budget", F.lit(token_budget)), described)
