"""Full-text, vector and keyword recall, fusion, reranking and result hygiene."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions.text import terms_of
from engramlake.functions.windows import top_rows
from engramlake.session import written

BM25_K1 = 1.2
BM25_B = 0.75
RRF_CONSTANT = 60
CANDIDATE_CAP = 500
PAIRS_PER_TASK = 2_000_000  # (query, unit) pairs whose scores one task holds
MIN_SIMILARITY = 0.2


@dataclass(frozen=True)
class TextIndex:
    """postings(term, id, tf, doc_len, ...scope), terms(term, df), stats(n_docs, avg_len).

    ``blocks`` (term, region_id, block, units) holds the same postings packed where all postings of a unit are in one block.
    """

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    blocks: DataFrame | None = None


def terms(df: DataFrame, col: str) -> DataFrame:
    """Add the ``terms`` array of a text column."""
    return df.withColumn("terms", terms_of(F.col(col)))


def build_text_index(units: DataFrame, scope_cols: tuple[str, ...] = ("region_id",)) -> TextIndex:
    """Inverted index; postings carry length and scope so that search needs no second join."""
    keep = [c for c in scope_cols if c in units.columns]
    tokenized = terms(units.select("id", "content", *keep), "content").drop("content")
    tokenized = tokenized.withColumn("doc_len", F.size("terms"))
    postings = (
        tokenized.select("id", "doc_len", *keep, F.explode("terms").alias("term"))
        .groupBy("term", "id", "doc_len", *keep)
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    return TextIndex(
        postings=postings,
        terms=postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")),
        stats=tokenized.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len")),
    )


def query_terms(queries: DataFrame, col: str = "query") -> DataFrame:
    """Distinct terms of each query; a blank query has none."""
    keep = [c for c in queries.columns if c != col]
    return queries.select(*keep, F.explode(F.array_distinct(terms_of(F.col(col)))).alias("term"))


def block_scores(
    blocks: DataFrame, weights: DataFrame, on: list[str], n_docs: int, avg_len: float, asked: DataFrame | None = None
) -> DataFrame:
    """(query_id, id, score) from packed postings: a block's rows go to one task, so single scores are never shuffled.

    ``weights`` (query_id, idf and the columns ``on``) is a small stored table. With ``asked`` (block, asked) a block is scored for the
    queries in its array only. Tasks are as many as the pairs of queries and units ask for.
    """
    n_queries = weights.select("query_id").distinct().count()
    parts = max(1, math.ceil(n_docs * n_queries / PAIRS_PER_TASK))
    dealt = blocks.repartition(parts, "block")
    if asked is None:
        met = dealt.join(weights, on)
    else:
        met = dealt.join(asked, "block").join(weights, on).filter(F.array_contains("asked", F.col("query_id")))
    norm = F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("doc_len") / avg_len)
    return (
        met.select("query_id", "block", "idf", F.inline("units"))
        .groupBy("block", "query_id", "id")
        .agg(F.round(F.sum(F.col("idf") * F.col("tf") * (BM25_K1 + 1) / norm), 6).alias("score"))
        .filter(F.col("score") > 0)
        .select("query_id", "id", "score")
    )


def bm25_search(
    queries: DataFrame, index: TextIndex, k: int, condition: Column | None = None, scopes: DataFrame | None = None
) -> DataFrame:
    """Top ``k`` documents per query with positive score.

    ``condition`` filters postings before ranking; ``scopes`` (query_id, region_id) names the only
    regions in which each query may find anything, and no scope means no hit. Weights are joined to the postings by
    term: Spark broadcasts them when its size estimate allows, and otherwise splits hot terms
    as skewed join partitions. Scores are pre-aggregated before the (query, id) shuffle, or added up in the block of a unit
    where the index has blocks.
    """
    if index.blocks is not None and condition is None:
        n_docs, avg_len = index.stats.select("n_docs", "avg_len").first()
        idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = query_terms(queries).join(index.terms, "term").select("query_id", "term", idf.alias("idf"))
        on = ["term"] if scopes is None else ["term", "region_id"]
        if scopes is not None:
            weights = weights.join(scopes.select("query_id", "region_id").distinct(), "query_id")
        weights = written(weights, "weights")
        wanted = index.blocks.join(weights.select(*on).distinct(), on, "left_semi")
        scored = block_scores(wanted, weights, on, n_docs, avg_len or 1.0)
        return top_rows(scored, ["query_id"], [F.col("score").desc(), F.col("id")], k)
    postings = index.postings if condition is None else index.postings.filter(condition)
    n_docs = index.stats.select("n_docs").scalar()
    avg_len = index.stats.select("avg_len").scalar()
    weights = query_terms(queries).join(index.terms, "term").withColumn(
        "idf", F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    )
    norm = F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("doc_len") / avg_len)
    weights, on = weights.select("query_id", "term", "idf"), ["term"]
    if scopes is not None:
        weights, on = weights.join(scopes.select("query_id", "region_id").distinct(), "query_id"), ["term", "region_id"]
    scored = (
        postings.join(weights, on)
        .groupBy("query_id", "id")
        .agg(F.round(F.sum(F.col("idf") * F.col("tf") * (BM25_K1 + 1) / norm), 6).alias("score"))
        .filter(F.col("score") > 0)
    )
    return top_rows(scored, ["query_id"], [F.col("score").desc(), F.col("id")], k)


def keyword_search(queries: DataFrame, units: DataFrame, k: int, scopes: DataFrame | None = None) -> DataFrame:
    """Fallback without an index: rank by the number of query terms a unit contains, within ``scopes`` where given."""
    place = [] if scopes is None else ["region_id"]
    words = units.select("id", *place, F.explode(F.array_distinct(terms_of(F.col("content")))).alias("term"))
    wanted = query_terms(queries).select("query_id", "term")
    if scopes is not None:
        wanted = wanted.join(scopes.select("query_id", "region_id").distinct(), "query_id")
    matched = (
        words.join(wanted, ["term", *place])
        .groupBy("query_id", "id")
        .agg(F.count(F.lit(1)).alias("matches"))
    )
    return top_rows(matched, ["query_id"], [F.col("matches").desc(), F.col("id")], k)


def cosine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pairwise cosine of two row matrices; a zero vector has similarity 0."""
    norms = np.linalg.norm(left, axis=1)[:, None] * np.linalg.norm(right, axis=1)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norms == 0, 0.0, (left @ right.T) / norms)


def vector_search(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    min_similarity: float | None = None,
    rows_per_shard: int = 65_536,
    queries_per_block: int = 1_024,
    scopes: DataFrame | None = None,
) -> DataFrame:
    """Exact cosine top ``k`` for every query.

    Vectors are hashed into shards and queries into blocks, both of bounded size; one task
    multiplies one shard with one block and returns at most ``k`` rows per query. A pair of
    different or zero length scores -1. With ``scopes`` (query_id, region_id) a query only meets the
    vectors of its regions, and ``vectors`` has region_id.
    """
    shards = max(1, math.ceil(vectors.count() / rows_per_shard))
    blocks = max(1, math.ceil(queries.count() / queries_per_block))

    place = [] if scopes is None else ["region_id"]
    if scopes is not None:
        queries = queries.join(scopes.select("query_id", "region_id").distinct(), "query_id")

    def numbered(df: DataFrame, id_col: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return df.select(
            F.col(id_col),
            F.col("vector"),
            *place,
            F.pmod(F.xxhash64(id_col), F.lit(n_own)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other),
        )

    left = numbered(vectors, "id", "shard", shards, "block", blocks)
    right = numbered(queries, "query_id", "block", blocks, "shard", shards)
    cells = [*place, "shard", "block"]

    def best(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        asked_ids: list[str] = []
        found_ids: list[str] = []
        found_scores: list[float] = []
        sizes = shard["vector"].map(lambda v: 0 if v is None else len(v))
        wanted = block["vector"].map(lambda v: 0 if v is None else len(v))
        for width in sorted(set(wanted)):
            asked = block[wanted == width]
            same = shard[sizes == width] if width else shard.iloc[0:0]
            rest = shard.drop(same.index)
            scores = np.full((len(asked), len(shard)), -1.0)
            if len(same):
                left_rows = np.asarray(asked["vector"].tolist(), dtype=np.float64)
                right_rows = np.asarray(same["vector"].tolist(), dtype=np.float64)
                scores[:, : len(same)] = cosine(left_rows, right_rows)
            ids = np.concatenate([same["id"].to_numpy(), rest["id"].to_numpy()])
            rounded = np.round(scores, 6)
            for row, query_id in enumerate(asked["query_id"]):
                order = np.lexsort((ids.astype(str), -rounded[row]))[:k]
                asked_ids += [query_id] * len(order)
                found_ids += ids[order].tolist()
                found_scores += rounded[row][order].tolist()
        return pd.DataFrame(
            {"query_id": np.array(asked_ids, object), "id": np.array(found_ids, object), "score": np.array(found_scores, np.float64)}
        )

    partial = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInPandas(
        best, "query_id string, id string, score double"
    )
    if min_similarity is not None:
        partial = partial.filter(F.col("score") >= min_similarity)
    return top_rows(partial, ["query_id"], [F.col("score").desc(), F.col("id")], k)


def check_embeddings(df: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Vectors that are non-empty, finite and of the configured dimension; rejects with a reason."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    reason = (
        F.when(F.col("vector").isNull() | (F.size("vector") == 0), "empty vector")
        .when(~finite, "non-finite value")
        .when(F.size("vector") != dim, "inconsistent dimension")
    )
    judged = df.withColumn("reason", reason)
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull())


def candidate_pool(hits: DataFrame, cap: int = CANDIDATE_CAP, excluded: str = "excluded") -> DataFrame:
    """Best ``cap`` eligible hits per query; ``pool_truncated`` tells that more were eligible."""
    ranked = top_rows(
        hits.filter(~F.col(excluded)), ["query_id"], [F.col("score").desc(), F.col("id")], cap + 1, "pool_rank"
    )
    fullness = ranked.groupBy("query_id").agg((F.max("pool_rank") > cap).alias("pool_truncated"))
    return ranked.filter(F.col("pool_rank") <= cap).join(fullness, "query_id")


def fuse(hits: DataFrame, limit: int) -> DataFrame:
    """One ranked row per (query, id) from all channels by reciprocal rank.

    ``hits`` has query_id, id, channel and rank. Rows found only by the ``graph`` channel are
    expansions; one slot is kept for them when direct hits alone would fill the limit.
    """
    merged = hits.groupBy("query_id", "id").agg(
        F.round(F.sum(1.0 / (RRF_CONSTANT + F.col("rank"))), 9).alias("score"),
        F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("retrieval_sources"),
        F.max(F.col("channel") != "graph").alias("direct"),
    )
    ranked = top_rows(
        merged, ["query_id", "direct"], [F.col("score").desc(), F.col("id")], limit, "class_rank"
    )
    counts = ranked.groupBy("query_id").agg(
        F.count(F.when(F.col("direct"), 1)).alias("n_direct"), F.count(F.when(~F.col("direct"), 1)).alias("n_graph")
    )
    graph_slots = F.least("n_graph", F.greatest(F.lit(limit) - F.col("n_direct"), F.lit(1)))
    direct_slots = F.least("n_direct", F.lit(limit) - graph_slots)
    kept = ranked.join(counts, "query_id").filter(
        F.when(F.col("direct"), F.col("class_rank") <= direct_slots).otherwise(F.col("class_rank") <= graph_slots)
    )
    return kept.select(
        "query_id",
        "id",
        "score",
        "retrieval_sources",
        F.when(F.col("direct"), "direct").otherwise("graph_expansion").alias("classification"),
        (F.col("class_rank") + F.when(F.col("direct"), 0).otherwise(direct_slots)).alias("rank"),
    )


def apply_rerank(hits: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reorder each query by model scores when they are a finite permutation of its candidates.

    ``scores`` has query_id, index (zero-based position) and score. Other queries keep their
    order and are returned as rejects.
    """
    sizes = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"))
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf"))
    judged = sizes.join(
        scores.groupBy("query_id").agg(
            F.count(F.lit(1)).alias("n_scores"),
            F.countDistinct("index").alias("n_distinct"),
            F.min("index").alias("lowest"),
            F.max("index").alias("highest"),
            F.min(finite).alias("all_finite"),
        ),
        "query_id",
        "left",
    ).withColumn(
        "usable",
        F.coalesce(
            (F.col("n_scores") == F.col("n_hits"))
            & (F.col("n_distinct") == F.col("n_hits"))
            & (F.col("lowest") == 0)
            & (F.col("highest") == F.col("n_hits") - 1)
            & F.col("all_finite"),
            F.lit(False),
        ),
    )
    usable = judged.filter("usable").select("query_id")
    positioned = scores.join(usable, "query_id", "left_semi").select(
        "query_id", (F.col("index") + 1).alias("rank"), F.col("score").alias("rerank_score")
    )
    joined = hits.join(positioned, ["query_id", "rank"], "left")
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), F.col("rank"))
    reordered = joined.withColumn("final_rank", F.row_number().over(order))
    return reordered, judged.filter(~F.col("usable")).select("query_id", F.lit("unusable rerank scores").alias("reason"))


def degradation(channel_status: DataFrame) -> DataFrame:
    """Roll channel statuses up per query: reasons, degraded flag and regions that still answer.

    ``channel_status`` has query_id, region_id, channel and status.
    """
    bad = ~F.col("status").isin("ready", "not_applicable")
    per_region = channel_status.groupBy("query_id", "region_id").agg(
        F.array_sort(
            F.collect_set(F.when(bad, F.concat("channel", F.lit("_"), "status")))
        ).alias("reasons"),
        F.max(~bad).alias("answers"),
    )
    return per_region.groupBy("query_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons"),
        F.max(F.size("reasons") > 0).alias("degraded"),
        F.count(F.when(F.col("answers"), 1)).alias("answering_regions"),
        F.count(F.lit(1)).alias("regions"),
    )


def sanitize_results(hits: DataFrame, secret: str | None = None) -> DataFrame:
    """Keep rows with safe ids, paths and bounded fields; redact a secret; escape markup characters."""

    def bounded(name: str, maximum: int) -> Column:
        redacted = F.replace(F.col(name), F.lit(secret), F.lit("[REDACTED]")) if secret else F.col(name)
        return F.when(F.length(name) <= maximum, redacted)

    path = bounded("path", 1024)
    relative = (
        ~path.rlike(r"\\")
        & ~path.startswith("/")
        & ~F.exists(F.split(path, "/"), lambda part: part.isin("", ".", ".."))
    )
    safe_path = F.when(path.rlike(r"\Amemory://[A-Za-z0-9_-]{1,256}\z") | relative, path)
    library = bounded("library_id", 128)
    cleaned = hits.withColumns(
        {
            "path": safe_path,
            "library_id": F.when(library.rlike(r"\A[A-Za-z0-9_-]{1,128}\z"), library),
            "content": bounded("content", 200_000),
            "source_version": bounded("source_version", 256),
            "source_type": bounded("source_type", 64),
            "classification": bounded("classification", 64),
            "heading": bounded("heading", 1000),
        }
    )
    required = (
        F.col("path").isNotNull()
        & F.col("library_id").isNotNull()
        & F.col("content").isNotNull()
        & (F.coalesce("source_version", F.lit("")) != "")
        & (F.coalesce("source_type", F.lit("")) != "")
        & (F.coalesce("classification", F.lit("")) != "")
    )
    escaped = F.col("content")
    # Escapes for markup characters.
    for character, escape in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        escaped = F.replace(escaped, F.lit(character), F.lit(escape))
    return cleaned.filter(required).withColumn("content", escaped)
