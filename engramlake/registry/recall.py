"""Queries for retrieval and context packaging."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake.functions.text import truncate_text
from engramlake.operators import block_index, pack, retrieve, vector_index
from engramlake.operators.filters import recall_eligible
from engramlake.registry.core import query
from engramlake.registry.stored import stored_at
from engramlake.session import written

SEGMENTS = r"regexp_extract_all(lower({}), '\p{Han}+|[^\p{Han}\p{P}\p{S}\p{Z}\p{C}]+')".replace("{}", "%s", 1)
PAIRS = (
    "flatten(list_transform(%s, lambda w: CASE WHEN regexp_matches(w, '^\\p{Han}') AND length(w) > 1 "
    "THEN list_transform(range(1, length(w)), lambda i: substr(w, CAST(i AS INT), 2)) ELSE [w] END))"
)


def terms_sql(column: str) -> str:
    return PAIRS % (SEGMENTS % column)


@query(
    "ret1_terms",
    f"SELECT id, len(t) AS n_terms, array_to_string(list_sort(list_distinct(t)), ' ') AS terms FROM (SELECT id, {terms_sql('content')} AS t FROM {{units}}) x",
)
def _terms(t):
    return retrieve.terms(t.units, "content").select(
        "id", F.size("terms").alias("n_terms"), F.array_join(F.array_sort(F.array_distinct("terms")), " ").alias("terms")
    )


ELIGIBLE = "SELECT * FROM {units} WHERE memory_type NOT IN ('capture', 'evolved')"
TOKENIZED = f"SELECT id, region_id, len(t) AS doc_len, t FROM (SELECT id, region_id, {terms_sql('content')} AS t FROM {{eligible}}) x"
POSTINGS = "SELECT term, id, doc_len, region_id, count(*) AS tf FROM (SELECT id, region_id, doc_len, unnest(t) AS term FROM {tokenized}) e GROUP BY 1, 2, 3, 4"
DF = "SELECT term, count(*) AS df FROM {postings} GROUP BY term"
QUERY_TERMS = f"SELECT query_id, unnest(list_distinct({terms_sql('query')})) AS term FROM {{recall_queries}}"
SCORED = """SELECT query_id, id, round(sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.doc_len / s.a))), 6) AS score
 FROM {postings} p JOIN {query_terms} q ON q.term = p.term JOIN {term_df} d ON d.term = p.term, (SELECT count(*) AS n, avg(doc_len) AS a FROM {tokenized}) s GROUP BY 1, 2"""
BM25 = """SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {scored} WHERE score > 0) r WHERE rank <= 10"""
TEXT_CTES = {
    "eligible": ELIGIBLE,
    "tokenized": TOKENIZED,
    "postings": POSTINGS,
    "term_df": DF,
    "query_terms": QUERY_TERMS,
    "scored": SCORED,
    "bm25": BM25,
}


FOLDERS = 16


def blocks_index(t) -> block_index.BlockIndex:
    """The stored index of the eligible units."""
    path = stored_at(t, "block-index", lambda folder: block_index.build_block_index(recall_eligible(t.units), folder, FOLDERS))
    return block_index.open_block_index(t.spark, path, FOLDERS)


def text_index(t) -> retrieve.TextIndex:
    return blocks_index(t).text_index


def bm25_hits(t):
    """The first ten of each query, searched once however often they are read."""
    return written(retrieve.bm25_search(t.recall_queries, text_index(t), 10), "hits")


@query(
    "ret2_build_text_index",
    """SELECT p.term, p.id, p.tf, p.doc_len, d.df FROM {postings} p JOIN {term_df} d ON d.term = p.term""",
    **TEXT_CTES,
)
def _build_text_index(t):
    index = text_index(t)
    return index.postings.join(index.terms, "term").select("term", "id", "tf", "doc_len", "df")


@query("ret3_bm25_search", "SELECT query_id, id, score, rank FROM {bm25}", **TEXT_CTES)
def _bm25_search(t):
    return retrieve.bm25_search(t.recall_queries, text_index(t), 10)


@query("ret3_block_search", "SELECT query_id, id, score, rank FROM {bm25}", **TEXT_CTES)
def _block_search(t):
    return block_index.block_search(t.recall_queries, blocks_index(t), 10)


# One query vector per label: the vector with the lowest id.
LABEL_QUERIES = "SELECT scope_space AS query_id, min_by(vector, CAST(substr(id, 2) AS BIGINT)) AS vector FROM {vectors} GROUP BY scope_space"


@query(
    "ret4_vector_search",
    """SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
 SELECT q.query_id, v.id, round(list_cosine_similarity(CAST(q.vector AS DOUBLE[]), CAST(v.vector AS DOUBLE[])), 6) AS score FROM {label_queries} q CROSS JOIN {vectors} v) s) r WHERE rank <= 10""",
    label_queries=LABEL_QUERIES,
)
def _vector_search(t):
    return retrieve.vector_search(t.sql(LABEL_QUERIES, "vectors"), t.vectors.select("id", "vector"), 10)


@query(
    "ret5_check_embeddings",
    """SELECT id, CASE CAST(k AS INT) WHEN 0 THEN 'empty vector' WHEN 1 THEN 'non-finite value' WHEN 2 THEN 'inconsistent dimension' ELSE 'valid' END AS outcome
 FROM (SELECT id, CAST(substr(id, 2) AS BIGINT) % 9 AS k FROM {vectors}) v""",
)
def _check_embeddings(t):
    k = F.substring("id", 2, 20).cast("long") % 9
    vector = (
        F.when(k == 0, F.slice("vector", 1, 0))
        .when(k == 1, F.concat(F.slice("vector", 1, 63), F.array(F.lit(float("nan")).cast("float"))))
        .when(k == 2, F.slice("vector", 1, 32))
        .otherwise(F.col("vector"))
    )
    valid, rejects = retrieve.check_embeddings(t.vectors.select("id", vector.alias("vector")), 64)
    return valid.select("id", F.lit("valid").alias("outcome")).unionByName(
        rejects.select("id", F.col("reason").alias("outcome"))
    )


@query(
    "ret6_keyword_search",
    """SELECT query_id, id, matches, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, id) AS rank FROM (
 SELECT q.query_id, p.id, count(*) AS matches FROM {query_terms} q JOIN {postings} p ON p.term = q.term GROUP BY 1, 2) m) r WHERE rank <= 10""",
    **TEXT_CTES,
)
def _keyword_search(t):
    return retrieve.keyword_search(t.recall_queries, recall_eligible(t.units), 10)


# Every query may look into the user region and one topic; all other regions are foreign to it.
SCOPES = """SELECT query_id, 'user' AS region_id FROM {recall_queries}
 UNION ALL SELECT query_id, concat('topic-', CAST(CAST(substr(query_id, 2) AS BIGINT) % 10 AS STRING)) FROM {recall_queries}"""
SCOPED = TEXT_CTES | {"scopes": SCOPES}


@query(
    "ret3_scoped_bm25_search",
    """SELECT query_id, id, score, rank FROM (SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, id) AS rank FROM {scored} s
 JOIN (SELECT DISTINCT id, region_id FROM {tokenized}) u USING (id) JOIN {scopes} o ON o.query_id = s.query_id AND o.region_id = u.region_id WHERE score > 0) r WHERE rank <= 10""",
    **SCOPED,
)
def _scoped_bm25_search(t):
    return retrieve.bm25_search(t.recall_queries, text_index(t), 10, scopes=t.sql(SCOPES, "recall_queries"))


@query(
    "ret6_scoped_keyword_search",
    """SELECT query_id, id, matches, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, id) AS rank FROM (
 SELECT q.query_id, p.id, count(*) AS matches FROM {query_terms} q JOIN {postings} p ON p.term = q.term JOIN {scopes} o ON o.query_id = q.query_id AND o.region_id = p.region_id GROUP BY 1, 2) m) r WHERE rank <= 10""",
    **SCOPED,
)
def _scoped_keyword_search(t):
    return retrieve.keyword_search(t.recall_queries, recall_eligible(t.units), 10, scopes=t.sql(SCOPES, "recall_queries"))


# Query vectors of a label, allowed into two of the vectors' regions.
PLACED_VECTORS = "SELECT v.*, u.region_id FROM {vectors} v JOIN {units} u ON u.id = v.id"
LABEL_SCOPES = """SELECT DISTINCT scope_space AS query_id, 'user' AS region_id FROM {vectors} UNION ALL SELECT DISTINCT scope_space, 'project-2' FROM {vectors}"""


@query(
    "ret4_scoped_vector_search",
    """SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
 SELECT q.query_id, v.id, round(list_cosine_similarity(CAST(q.vector AS DOUBLE[]), CAST(v.vector AS DOUBLE[])), 6) AS score FROM {label_queries} q
 JOIN {label_scopes} o ON o.query_id = q.query_id JOIN {placed_vectors} v ON v.region_id = o.region_id) s) r WHERE rank <= 10""",
    label_queries=LABEL_QUERIES,
    placed_vectors=PLACED_VECTORS,
    label_scopes=LABEL_SCOPES,
)
def _scoped_vector_search(t):
    vectors = t.sql(PLACED_VECTORS, "vectors", "units").select("id", "vector", "region_id")
    return retrieve.vector_search(t.sql(LABEL_QUERIES, "vectors"), vectors, 10, scopes=t.sql(LABEL_SCOPES, "vectors"))


@query(
    "ret4_indexed_search",
    """SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
 SELECT q.query_id, v.id, round(list_cosine_similarity(CAST(q.vector AS DOUBLE[]), CAST(v.vector AS DOUBLE[])), 6) AS score FROM {label_queries} q CROSS JOIN {vectors} v) s) r WHERE rank <= 10""",
    label_queries=LABEL_QUERIES,
)
def _indexed_search(t):
    index = vector_index.build_vector_index(t.vectors.select("id", "vector"), 64)
    return vector_index.indexed_search(t.sql(LABEL_QUERIES, "vectors"), index, 10, exact=True)


AUDIT_HITS = """SELECT target_space AS query_id, concat('e', CAST(seq AS STRING)) AS id, value AS score, action = 'error' AS excluded FROM {audit}"""


@query(
    "ret7_candidate_pool",
    """SELECT query_id, id, pool_rank, n > 500 AS pool_truncated FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pool_rank,
 count(*) OVER (PARTITION BY query_id) AS n FROM {audit_hits} WHERE NOT excluded) r WHERE pool_rank <= 500""",
    audit_hits=AUDIT_HITS,
)
def _candidate_pool(t):
    return retrieve.candidate_pool(t.sql(AUDIT_HITS, "audit")).select("query_id", "id", "pool_rank", "pool_truncated")


# Channels per query: BM25 hits, the same hits re-ranked by id as dense hits, and neighbours by number as graph hits.
CHANNEL_HITS = """SELECT query_id, id, 'bm25' AS channel, rank FROM {bm25}
 UNION ALL SELECT query_id, id, 'vector', row_number() OVER (PARTITION BY query_id ORDER BY id) FROM {bm25}
 UNION ALL SELECT query_id, concat('u', CAST(CAST(substr(id, 2) AS BIGINT) + 1 AS STRING)), 'graph', rank FROM {bm25}"""
MERGED = """SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score, string_agg(DISTINCT channel, ',' ORDER BY channel) AS retrieval_sources,
 max(CASE WHEN channel <> 'graph' THEN 1 ELSE 0 END) = 1 AS direct FROM {channel_hits} GROUP BY 1, 2"""
CLASSED = """SELECT *, count(*) FILTER (WHERE direct) OVER (PARTITION BY query_id) AS nd, count(*) FILTER (WHERE NOT direct) OVER (PARTITION BY query_id) AS ng FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id, direct ORDER BY score DESC, id) AS cr FROM {merged}) c WHERE cr <= 10"""
FUSED = """SELECT query_id, id, score, retrieval_sources, CASE WHEN direct THEN 'direct' ELSE 'graph_expansion' END AS classification,
 cr + CASE WHEN direct THEN 0 ELSE dslots END AS rank FROM (SELECT *, least(nd, 10 - least(ng, greatest(10 - nd, 1))) AS dslots, least(ng, greatest(10 - nd, 1)) AS gslots FROM {classed}) s
 WHERE CASE WHEN direct THEN cr <= dslots ELSE cr <= gslots END"""
FUSE_CTES = TEXT_CTES | {"channel_hits": CHANNEL_HITS, "merged": MERGED, "classed": CLASSED, "fused": FUSED}


def channel_hits(t):
    return t.spark.sql(CHANNEL_HITS, bm25=bm25_hits(t))


@query("ret8_fuse", "SELECT * FROM {fused}", **FUSE_CTES)
def _fuse(t):
    return retrieve.fuse(channel_hits(t), 10)


RERANK_SCORES = """SELECT query_id, CAST(rank - 1 AS INT) AS index, CASE WHEN substr(query_id, 2) LIKE '%3' AND rank = 2 THEN CAST('NaN' AS DOUBLE) ELSE score * CASE WHEN rank % 2 = 0 THEN 3 ELSE 1 END END AS score
 FROM {bm25} WHERE NOT (substr(query_id, 2) LIKE '%7' AND rank = 1)"""
RERANK_JOINED = """SELECT b.query_id, b.id, b.rank, CASE WHEN b.query_id LIKE '%3' OR b.query_id LIKE '%7' THEN NULL ELSE s.score END AS rs
 FROM {bm25} b LEFT JOIN {rerank_scores} s ON s.query_id = b.query_id AND s.index = b.rank - 1"""


@query(
    "ret9_apply_rerank",
    """SELECT query_id, id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rs DESC NULLS LAST, rank) AS final_rank FROM {reranked}
 UNION ALL SELECT DISTINCT query_id, 'rejected', 0, 0 FROM {bm25} WHERE query_id LIKE '%3' OR query_id LIKE '%7'""",
    **(TEXT_CTES | {"rerank_scores": RERANK_SCORES, "reranked": RERANK_JOINED}),
)
def _apply_rerank(t):
    hits = bm25_hits(t)
    kept, rejects = retrieve.apply_rerank(hits, t.spark.sql(RERANK_SCORES, bm25=hits))
    return kept.select("query_id", "id", "rank", "final_rank").unionByName(
        rejects.select("query_id", F.lit("rejected").alias("id"), F.lit(0).alias("rank"), F.lit(0).alias("final_rank"))
    )


CHANNELS = """SELECT concat('q', CAST(o_custkey AS STRING)) AS query_id, concat('r', CAST(o_orderkey % 5 AS STRING)) AS region_id,
 CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'vector' WHEN 1 THEN 'fulltext' ELSE 'graph' END AS channel,
 CASE WHEN o_totalprice > 300000 THEN 'unavailable' WHEN o_totalprice > 200000 THEN 'degraded' WHEN o_totalprice > 150000 THEN 'not_applicable' ELSE 'ready' END AS status FROM {orders}"""


@query(
    "ret10_degradation",
    """SELECT query_id, coalesce(string_agg(DISTINCT CASE WHEN bad THEN concat(channel, '_', status) END, ',' ORDER BY CASE WHEN bad THEN concat(channel, '_', status) END), '') AS reasons,
 max(CASE WHEN bad THEN 1 ELSE 0 END) = 1 AS degraded, count(DISTINCT CASE WHEN NOT bad THEN region_id END) AS answering_regions, count(DISTINCT region_id) AS regions
 FROM (SELECT *, status NOT IN ('ready', 'not_applicable') AS bad FROM {channels}) c GROUP BY query_id""",
    channels=CHANNELS,
)
def _degradation(t):
    rolled = retrieve.degradation(t.sql(CHANNELS, "orders"))
    return rolled.withColumn("reasons", F.array_join("reasons", ","))


PAGE_HITS = """SELECT page_id, CASE CAST(page_id % 7 AS INT) WHEN 0 THEN concat('memory://p', CAST(page_id AS STRING)) WHEN 1 THEN '/etc/passwd' WHEN 2 THEN 'a/../b'
 WHEN 3 THEN concat('notes/', CAST(page_id AS STRING), '.md') WHEN 4 THEN concat('a', chr(92), 'b') WHEN 5 THEN concat('memory://bad id ', CAST(page_id AS STRING)) ELSE url END AS path,
 CASE WHEN page_id % 11 = 0 THEN 'bad lib' ELSE concat('lib-', CAST(page_id % 3 AS STRING)) END AS library_id, html AS content,
 CASE WHEN page_id % 13 = 0 THEN '' ELSE 'v1' END AS source_version, 'page' AS source_type, 'direct' AS classification, url AS heading FROM {pages}"""


@query(
    "ret16_sanitize_results",
    """SELECT page_id, path, library_id, heading, sha256(replace(replace(replace(content, '<', chr(92) || 'u003c'), '>', chr(92) || 'u003e'), '&', chr(92) || 'u0026')) AS content_hash FROM (
 SELECT page_id, replace(path, 'html', '[REDACTED]') AS path, library_id, replace(heading, 'html', '[REDACTED]') AS heading, replace(content, 'html', '[REDACTED]') AS content FROM {page_hits}
 WHERE library_id <> 'bad lib' AND source_version <> '' AND length(content) <= 200000) c
 WHERE regexp_full_match(path, 'memory://[A-Za-z0-9_-]{1,256}') OR (NOT contains(path, chr(92)) AND NOT starts_with(path, '/')
 AND len(list_filter(string_split(path, '/'), lambda s: s IN ('', '.', '..'))) = 0)""",
    page_hits=PAGE_HITS,
)
def _sanitize_results(t):
    cleaned = retrieve.sanitize_results(t.sql(PAGE_HITS, "pages"), secret="html")
    return cleaned.select("page_id", "path", "library_id", "heading", F.sha2("content", 256).alias("content_hash"))


LIMITED = "SELECT doc_id, text, CAST(100 + (doc_id * 37) % 900 AS INT) AS n FROM {documents}"
PREFIXED = """SELECT doc_id, text, n, CASE WHEN octet_length(encode(text)) <= n THEN text ELSE decode(encode(text)[1:CASE WHEN NOT regexp_matches(hex(encode(text)[n + 1:n + 1]), '^[89AB]') THEN n
 WHEN NOT regexp_matches(hex(encode(text)[n:n]), '^[89AB]') THEN n - 1 WHEN NOT regexp_matches(hex(encode(text)[n - 1:n - 1]), '^[89AB]') THEN n - 2 ELSE n - 3 END]) END AS prefix FROM {limited}"""


@query(
    "ret13_truncate_to_budget",
    """SELECT doc_id, CASE WHEN octet_length(encode(text)) <= n THEN text ELSE regexp_replace(CASE WHEN length(head) - 1 >= greatest(1, floor(length(prefix) / 2)) THEN head ELSE prefix END, '\\s+$', '') END AS cut
 FROM (SELECT *, regexp_extract(prefix, '(?s)^(.*[\\n 。！？])', 1) AS head FROM {prefixed}) p""",
    limited=LIMITED,
    prefixed=PREFIXED,
)
def _truncate(t):
    rows = t.sql(LIMITED, "documents")
    return rows.select("doc_id", truncate_text(F.col("text"), F.col("n")).alias("cut"))


def packable_hits(t):
    """Fused hits with the metadata a package carries."""
    fused = written(retrieve.fuse(channel_hits(t), 10), "fused")
    units = t.units.select("id", "region_id", "content", "source", "memory_type", "updated_s")
    return fused.join(units, "id").select(
        "query_id", "rank", F.col("id").alias("chunk_id"), F.col("id").alias("document_id"), F.col("region_id").alias("library_id"),
        "region_id", F.concat(F.lit("memory://"), "id").alias("path"), F.lit("v1").alias("source_version"), F.col("memory_type").alias("source_type"),
        "classification", "score", F.array(F.concat(F.lit("event:"), "id"), F.concat(F.lit("source:"), "source"), F.lit("x")).alias("source_references"),
        F.create_map(F.lit("updated"), F.col("updated_s").cast("string")).alias("user_metadata"), "content",
    )


def budgeted_queries(t):
    number = F.substring("query_id", 2, 20).cast("int")
    return t.recall_queries.withColumn("token_budget", (F.lit(1200) + (number * 977) % 12000).cast("int"))


@query("ret14_pack_context")
def _pack_context(t):
    packed = pack.pack_context(budgeted_queries(t).withColumn("diagnostics", F.lit('{"entity_graph_status":"ready"}')), packable_hits(t))
    return packed.select(
        "query_id", "status", "effective_tokens", "direct_limit", "graph_limit", "metadata_limit", "direct_used", "graph_used",
        "metadata_used", "used_tokens", F.array_join("degradation", ",").alias("degradation"),
        F.array_join(F.transform("results", lambda r: r["chunk_id"]), ",").alias("chunk_ids"),
        F.sha2(F.to_json("results"), 256).alias("results_hash"),
    )


@query("ret15_pack_cross_region")
def _pack_cross_region(t):
    regions = t.units.select("region_id").distinct().select(
        "region_id", F.when(F.col("region_id") == "user", "user").otherwise("project").alias("kind")
    )
    queries = budgeted_queries(t).withColumn("region_ids", F.array(*[F.lit(r) for r in ("user", "project-1", "project-3", "topic-1", "topic-5")]))
    hits = packable_hits(t)
    packages, telemetry = pack.pack_cross_region(queries, hits, regions)
    return telemetry.join(packages.select("query_id", "status", "used_tokens", "effective_tokens", "structure_used"), "query_id")
