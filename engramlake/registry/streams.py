"""Queries that run the streaming jobs over the capture tables, and the model hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake import hooks
from engramlake.operators import retrieve
from engramlake.registry.core import query
from engramlake.registry.promotion import WORD
from engramlake.registry.recall import bm25_hits
from engramlake.registry.rounds import fingerprint_sql
from engramlake.registry.screening import CTES as SCREENING
from engramlake.session import scratch_path, written
from engramlake.sources.captures import CAPTURE_FIELDS, split_captures
from engramlake.sources.extractions import parse_extractions
from engramlake.sources.sinks import read_regions
from engramlake.streaming import captures as capture_stream
from engramlake.streaming import graph as graph_stream
from engramlake.streaming import rounds as round_stream

ARRIVALS = """SELECT event_id, session_id, turn_id, event_kind, content, occurred_s, cwd, topic_id FROM {captures}"""
REPEATS = """SELECT event_id, session_id, turn_id, event_kind, CASE WHEN occurred_s % 180 = 0 THEN concat(content, ' changed') ELSE content END AS content, occurred_s + 1 AS occurred_s, cwd, topic_id FROM {captures} WHERE event_kind = 'user'"""


def json_lines(rows):
    instant = F.date_format(F.timestamp_seconds("occurred_s"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.withColumn("occurred_at", instant).select(F.to_json(F.struct(*CAPTURE_FIELDS)).alias("value"))


def write_lines(rows, path, files, mode="append"):
    json_lines(rows).repartition(files).write.mode(mode).text(path)


@query(
    "str1_stream_captures",
    """SELECT 'event' AS kind, event_id, content FROM {captures} UNION ALL SELECT 'conflict', event_id, content FROM {repeats} WHERE occurred_s % 180 = 1""",
    repeats=REPEATS,
)
def _stream_captures(t):
    source, events, conflicts = (scratch_path(t.spark, n) for n in ("in", "events", "conflicts"))
    checkpoint = scratch_path(t.spark, "progress")
    write_lines(t.sql(ARRIVALS, "captures"), source, 4)
    capture_stream.ingest_captures(t.spark, source, events, conflicts, checkpoint).awaitTermination()
    write_lines(t.sql(REPEATS, "captures"), source, 4)
    capture_stream.ingest_captures(t.spark, source, events, conflicts, checkpoint).awaitTermination()
    return (
        t.spark.read.parquet(events).select(F.lit("event").alias("kind"), "event_id", "content")
        .unionByName(t.spark.read.parquet(conflicts).select(F.lit("conflict").alias("kind"), "event_id", "content"))
    )


STREAM_SHA = "sha256(concat(event_id, chr(0), content, chr(0)))"


@query(
    "str2_stream_rounds",
    f"""SELECT session_id, turn_id, arg_min(content, (occurred_s, event_id)) FILTER (WHERE event_kind = 'user') AS user_message, arg_max(content, (occurred_s, event_id)) FILTER (WHERE event_kind = 'assistant') AS assistant_final,
 {fingerprint_sql(STREAM_SHA)} AS fingerprint, CASE WHEN count(*) FILTER (WHERE event_kind = 'user') > 0 AND count(*) FILTER (WHERE event_kind = 'assistant') > 0 THEN 'pending_distillation' ELSE 'pending_completion' END AS status
 FROM {{captures}} GROUP BY session_id, turn_id""",
)
def _stream_rounds(t):
    source, updates = scratch_path(t.spark, "in"), scratch_path(t.spark, "rounds")
    checkpoint = scratch_path(t.spark, "progress")
    arrivals = t.sql(ARRIVALS, "captures")
    for kind in ("user", "assistant"):  # replies arrive late and re-open their rounds
        write_lines(arrivals.filter(F.col("event_kind") == kind), source, 4)
        events, _ = split_captures(capture_stream.read_capture_stream(t.spark, source))
        rounds = round_stream.stream_rounds(events)
        (
            rounds.writeStream.foreachBatch(lambda batch, n: batch.write.mode("append").parquet(updates))
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            # Expiry by processing time keeps asking for empty batches, so a run ends after one batch.
            .trigger(once=True)
            .start()
            .awaitTermination()
        )
    seen = t.spark.read.parquet(updates)
    newest = seen.groupBy("session_id", "turn_id").agg(
        F.max_by(F.struct("user_message", "assistant_final", "fingerprint", "status"), F.col("n_user") + F.col("n_assistant")).alias("r")
    )
    return newest.select("session_id", "turn_id", "r.*")


@query(
    "str3_stream_replay",
    """SELECT CASE WHEN (occurred_s / 60) % 5 = 0 THEN 'quarantine' ELSE 'accepted' END AS kind, sha256(content) AS content_hash, count(*) AS n FROM (
 SELECT occurred_s, CASE WHEN (occurred_s / 60) % 5 = 0 THEN '' ELSE content END AS content FROM {captures}) c GROUP BY 1, 2""",
)
def _stream_replay(t):
    source, accepted, quarantine = (scratch_path(t.spark, n) for n in ("spool", "accepted", "quarantine"))
    rows = t.sql(ARRIVALS, "captures").withColumn("broken", (F.col("occurred_s") / 60).cast("long") % 5 == 0)
    lines = json_lines(rows.filter(~F.col("broken"))).unionByName(
        json_lines(rows.filter("broken")).select(F.expr("left(value, 20)").alias("value"))
    )
    lines.repartition(12).write.text(source)
    capture_stream.stream_replay(t.spark, source, accepted, quarantine, scratch_path(t.spark, "progress")).awaitTermination()
    kept = t.spark.read.parquet(accepted).select(F.lit("accepted").alias("kind"), F.sha2("content", 256).alias("content_hash"))
    bad = t.spark.read.parquet(quarantine).select(F.lit("quarantine").alias("kind"), F.sha2(F.lit(""), 256).alias("content_hash"))
    return kept.unionByName(bad).groupBy("kind", "content_hash").agg(F.count(F.lit(1)).alias("n"))


# Whole texts behind a sentence that names something.
NAMED = f"""SELECT region_id, id AS memory_id, concat('Works with Acme ', upper(substr(w, 1, 1)), substr(w, 2), ' today. ', content) AS content, CASE WHEN lifecycle = 'forgotten' THEN 'archived' ELSE lifecycle END AS lifecycle, updated_s, region_id AS region_name, 'topic' AS region_kind
 FROM (SELECT *, coalesce(nullif({WORD}, ''), 'thing') AS w FROM {{units}}) v"""
NAMES_SQL = r"""SELECT DISTINCT region_id, memory_id, unnest(regexp_extract_all(content, '\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b')) AS canonical_name FROM {named}"""


@query(
    "str4_stream_graph",
    """SELECT region_id, canonical_name, count(*) AS n_memories FROM {names} JOIN {judged} ON doc_id = memory_id WHERE disposition IS NULL GROUP BY 1, 2
 UNION ALL SELECT DISTINCT region_id, 'status:ready', 0 FROM {named}""",
    named=NAMED,
    names=NAMES_SQL,
    **(SCREENING | {"scanned": "SELECT memory_id AS doc_id, content AS text FROM {named}"}),
)
def _stream_graph(t):
    source, memories, graph, status = (scratch_path(t.spark, n) for n in ("published", "memories", "graph", "status"))
    checkpoint = scratch_path(t.spark, "progress")
    rows = t.sql(NAMED, "units").withColumn("source_references", F.array(F.concat(F.lit("event:"), "memory_id")))
    even = F.pmod(F.xxhash64("memory_id"), F.lit(2)) == 0
    for part in (rows.filter(even), rows.filter(~even)):  # two publications, both touching every region
        part.repartition(4).write.mode("append").parquet(source)
        published = t.spark.readStream.schema(rows.schema).parquet(source)
        graph_stream.stream_graph(published, memories, graph, status, checkpoint, graph_stream.projector()).awaitTermination()
    supports = read_regions(t.spark, f"{graph}/memory_entities")
    states = t.spark.read.parquet(status).groupBy("region_id").agg(F.max_by("status", "batch_id").alias("status"))
    return supports.groupBy("region_id", "canonical_name").agg(F.count(F.lit(1)).alias("n_memories")).unionByName(
        states.select("region_id", F.concat(F.lit("status:"), "status").alias("canonical_name"), F.lit(0).cast("long").alias("n_memories"))
    )


PREFERENCES = f"""SELECT event_id, session_id, turn_id, concat('I prefer ', {WORD}, ' mode. ', content) AS content, {WORD} AS w FROM {{captures}} WHERE event_kind = 'user'"""


@query(
    "udf1_extract_memories",
    "SELECT event_id, concat('The user prefers ', w, ' mode.') AS content, concat('I prefer ', w, ' mode') AS evidence_snippet FROM {preferences}",
    preferences=PREFERENCES,
)
def _extract_memories(t):
    message = F.struct(F.lit("user").alias("role"), "event_id", "content")
    requests = t.sql(PREFERENCES, "captures").select("event_id", F.to_json(F.struct(F.array(message).alias("messages"))).alias("context"))
    parsed, _ = parse_extractions(hooks.extract_memories(requests), "raw", "memories")
    return parsed.select("event_id", F.explode("memories").alias("m")).select("event_id", "m.content", "m.evidence_snippet")


@query(
    "udf2_extract_entities",
    "SELECT memory_id, canonical_name FROM {names}",
    named=NAMED,
    names=NAMES_SQL,
)
def _extract_entities(t):
    contexts = t.sql(NAMED, "units").select("memory_id", hooks.memory_context(F.col("memory_id"), F.col("content")).alias("context"))
    parsed, _ = parse_extractions(hooks.extract_entities(contexts), "raw", "graph")
    return parsed.select("memory_id", F.explode("entities").alias("e")).select("memory_id", "e.canonical_name")


# Whole texts, some with a statement behind them.
STATED = """SELECT id, concat(content, CASE CAST(updated_s % 4 AS INT) WHEN 0 THEN ' I prefer short answers. In this project too.' WHEN 1 THEN ' For this project we use tabs.' WHEN 2 THEN ' this projection, I preferred' ELSE '' END) AS content FROM {units}"""


@query(
    "udf3_classify_promotions",
    r"""SELECT id, CASE WHEN regexp_matches(content, '\bI (prefer|always|never)\b') THEN 'user' WHEN regexp_matches(content, '\b([Ii]n|[Ff]or) this project\b') THEN 'project' ELSE 'retain' END AS category FROM {stated}""",
    stated=STATED,
)
def _classify_promotions(t):
    contexts = t.sql(STATED, "units").select("id", hooks.memory_context(F.col("id"), F.col("content")).alias("context"))
    return hooks.classify_promotions(contexts).select("id", F.get_json_object("raw", "$.category").alias("category"))


@query("udf4_embed_text", r"SELECT id, 64 AS n_values, regexp_matches(content, '[\pL\pN_]') AS unit_norm FROM {units}")
def _embed_text(t):
    embedded = hooks.embed_text(t.units.select("id", "content"), "content", 64)
    squares = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return embedded.select("id", F.size("vector").alias("n_values"), (F.abs(squares - 1) < 1e-4).alias("unit_norm"))


@query("udf5_rerank")
def _rerank(t):
    hits = bm25_hits(t).join(t.units.select("id", "content"), "id")
    hits = written(hits, "hits-with-texts")
    kept, _ = retrieve.apply_rerank(hits, hooks.rerank_scores(t.recall_queries, hits))
    return kept.select("query_id", "id", "rank", "final_rank", F.round("rerank_score", 6).alias("rerank_score"))
