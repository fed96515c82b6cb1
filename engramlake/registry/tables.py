"""Queries for sources, sinks and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake.operators import filters
from engramlake.registry.core import query
from engramlake.session import scratch_path
from engramlake.sources import sinks
from engramlake.sources.captures import read_captures
from engramlake.sources.extractions import parse_extractions
from engramlake.sources.units import read_units
from engramlake.sources.writes import WRITE_MODES, apply_writes


@query(
    "src1_read_units",
    "SELECT region_id, id, memory_type, lifecycle, supersedes, sha256(content) AS content_hash, updated_s FROM {units}",
)
def _read_units(t):
    path = scratch_path(t.spark, "units")
    t.units.write.partitionBy("region_id").parquet(path)
    return read_units(t.spark, path).select(
        "region_id", "id", "memory_type", "lifecycle", "supersedes", F.sha2("content", 256).alias("content_hash"),
        "updated_s",
    )


# Every rule of the capture contract is broken by some turn; the rest is valid.
CAPTURE_VARIANTS = """SELECT event_id, session_id, turn_id,
 CASE WHEN k = 1 THEN 'tool' ELSE event_kind END AS event_kind,
 CASE WHEN k = 2 THEN repeat(concat(content, ' '), CAST(floor(65535 / (length(content) + 1)) AS INT) + 1) ELSE content END AS content,
 CASE WHEN k = 3 THEN concat('2026-01-0', CAST(1 + occurred_s % 9 AS STRING), 'T10:00:00')
      WHEN k = 4 THEN '2026-02-31T10:00:00Z'
      ELSE concat('2026-01-0', CAST(1 + occurred_s % 9 AS STRING), 'T10:00:00+02:00') END AS occurred_at,
 CASE WHEN k = 5 THEN 'work/relative' ELSE cwd END AS cwd, topic_id, k,
 1767225600 + (occurred_s % 9) * 86400 + 8 * 3600 AS expected_s
 FROM (SELECT *, CAST((occurred_s / 60) % 11 AS INT) AS k FROM {captures}) v"""


@query(
    "src2_read_captures",
    """SELECT coalesce(event_id, '') AS event_id, reason, instant_s FROM (
 SELECT CASE WHEN k = 6 THEN NULL ELSE event_id END AS event_id,
 CASE WHEN k = 6 THEN 'malformed' WHEN k = 7 THEN 'missing_field' WHEN k = 1 THEN 'bad_kind' WHEN k = 2 THEN 'bad_content_size'
 WHEN k = 5 THEN 'bad_cwd' WHEN k IN (3, 4) THEN 'bad_time' ELSE 'valid' END AS reason,
 CASE WHEN k IN (0, 8, 9, 10) THEN expected_s END AS instant_s FROM {variants}) r""",
    variants=CAPTURE_VARIANTS,
)
def _read_captures(t):
    rows = t.sql(CAPTURE_VARIANTS, "captures")
    fields = ["event_id", "session_id", "turn_id", "event_kind", "content", "occurred_at", "cwd", "topic_id"]
    whole = F.to_json(F.struct(*fields))
    without_session = F.to_json(F.struct(*[f for f in fields if f != "session_id"]))
    line = (
        F.when(F.col("k") == 6, F.substring(whole, F.lit(2), F.length(whole)))
        .when(F.col("k") == 7, without_session)
        .otherwise(whole)
    )
    path = scratch_path(t.spark, "captures")
    rows.select(line.alias("value")).write.text(path)
    valid, rejects = read_captures(t.spark, path)
    return (
        valid.select("event_id", F.lit("valid").alias("reason"), F.unix_seconds("instant").alias("instant_s"))
        .unionByName(
            rejects.select(
                F.coalesce("event_id", F.lit("")).alias("event_id"), "reason", F.lit(None).cast("long").alias("instant_s")
            )
        )
    )


@query(
    "src3_parse_extractions",
    """SELECT unit_id, CASE WHEN k = 0 THEN 'malformed_json' WHEN k = 1 THEN 'malformed_json' WHEN k = 2 THEN 'malformed_memories'
 ELSE 'parsed' END AS outcome, CASE WHEN k > 2 THEN k % 4 ELSE 0 END AS n_memories,
 CASE WHEN k > 2 AND k % 4 > 0 THEN text END AS first_content
 FROM (SELECT concat('u', CAST(doc_id AS STRING)) AS unit_id, text, CAST(doc_id % 13 AS INT) AS k FROM {documents}) d""",
)
def _parse_extractions(t):
    rows = t.sql(
        "SELECT concat('u', CAST(doc_id AS STRING)) AS unit_id, text, CAST(doc_id % 13 AS INT) AS k FROM {documents}",
        "documents",
    )
    item = F.struct(F.col("text").alias("content"), F.lit("domain_fact").alias("memory_type"), F.lit(0.95).alias("confidence"))

    def body(count):
        return F.to_json(F.struct(F.array_repeat(item, count).alias("memories")))

    raw = (
        F.when(F.col("k") == 0, F.concat(F.lit("["), body(F.lit(1)), F.lit("]")))
        .when(F.col("k") == 1, F.concat(F.lit("{"), F.expr("left(text, 2)")))
        .when(F.col("k") == 2, body(F.lit(21)))
        .otherwise(body(F.col("k") % 4))
    )
    parsed, rejects = parse_extractions(rows.withColumn("raw", raw), "raw", "memories")
    return parsed.select(
        "unit_id", F.lit("parsed").alias("outcome"), F.size("memories").alias("n_memories"),
        F.get("memories", F.lit(0))["content"].alias("first_content"),
    ).unionByName(
        rejects.select(
            "unit_id", F.col("reason").alias("outcome"), F.lit(0).alias("n_memories"),
            F.lit(None).cast("string").alias("first_content"),
        )
    )


WRITE_TARGET = "SELECT region_id, id, memory_type FROM {units}"
WRITE_BATCH = """SELECT region_id, CASE WHEN updated_s % 3 = 0 THEN concat('new-', id) ELSE id END AS id,
 'decision' AS memory_type FROM {units} WHERE lifecycle <> 'active'"""


@query(
    "src4_apply_writes",
    """SELECT 'insert' AS mode, region_id, id, memory_type, '' AS error FROM {target}
 UNION ALL SELECT 'insert', region_id, id, memory_type, '' FROM {batch} b WHERE NOT EXISTS (SELECT 1 FROM {target} t WHERE t.id = b.id AND t.region_id = b.region_id)
 UNION ALL SELECT 'insert', region_id, id, NULL, 'conflict' FROM {batch} b WHERE EXISTS (SELECT 1 FROM {target} t WHERE t.id = b.id AND t.region_id = b.region_id)
 UNION ALL SELECT 'update', t.region_id, t.id, coalesce(b.memory_type, t.memory_type), '' FROM {target} t LEFT JOIN {batch} b ON t.id = b.id AND t.region_id = b.region_id
 UNION ALL SELECT 'update', region_id, id, NULL, 'not_found' FROM {batch} b WHERE NOT EXISTS (SELECT 1 FROM {target} t WHERE t.id = b.id AND t.region_id = b.region_id)
 UNION ALL SELECT 'upsert', coalesce(b.region_id, t.region_id), coalesce(b.id, t.id), coalesce(b.memory_type, t.memory_type), '' FROM {target} t FULL JOIN {batch} b ON t.id = b.id AND t.region_id = b.region_id
 UNION ALL SELECT 'delete', region_id, id, memory_type, '' FROM {target} t WHERE NOT EXISTS (SELECT 1 FROM {batch} b WHERE t.id = b.id AND t.region_id = b.region_id)""",
    target=WRITE_TARGET,
    batch=WRITE_BATCH,
)
def _apply_writes(t):
    target, batch = t.sql(WRITE_TARGET, "units"), t.sql(WRITE_BATCH, "units")
    out = None
    for mode in WRITE_MODES:
        table, errors = apply_writes(target, batch, mode)
        part = table.select(F.lit(mode).alias("mode"), "region_id", "id", "memory_type", F.lit("").alias("error"))
        bad = errors.select(
            F.lit(mode).alias("mode"), "region_id", "id", F.lit(None).cast("string").alias("memory_type"), "error"
        )
        out = part.unionByName(bad) if out is None else out.unionByName(part).unionByName(bad)
    return out


@query(
    "snk1_replace_regions",
    """SELECT region_id, id, CASE WHEN region_id LIKE 'topic-%' THEN 'rebuilt' ELSE 'original' END AS origin
 FROM {units} WHERE region_id <> 'user' AND NOT (region_id LIKE 'topic-%' AND lifecycle = 'forgotten')""",
)
def _replace_regions(t):
    """Rebuild the topic regions without forgotten units and empty the user region."""
    path = scratch_path(t.spark, "regions")
    units = t.units.select("region_id", "id", "lifecycle")
    sinks.replace_regions(units.withColumn("origin", F.lit("original")), path, units)
    topics = units.filter(F.col("region_id").startswith("topic-"))
    rebuilt = topics.filter(F.col("lifecycle") != "forgotten").withColumn("origin", F.lit("rebuilt"))
    touched = units.select("region_id").filter(F.col("region_id").startswith("topic-") | (F.col("region_id") == "user"))
    sinks.replace_regions(rebuilt, path, touched)
    return sinks.read_regions(t.spark, path).select("region_id", "id", "origin")


@query(
    "snk2_export_markdown",
    """SELECT region_id, '' AS position_key, concat('# Memory export: ', region_id, chr(10)) AS block FROM (SELECT DISTINCT region_id FROM {units}) r
 UNION ALL SELECT region_id, id, concat('## ', id, chr(10), chr(10), '- Lifecycle: ', lifecycle, chr(10), '- Version: ', CAST(updated_s AS STRING), chr(10),
 '- Source: ', coalesce(source, ''), chr(10), chr(10), coalesce(content, ''), chr(10)) FROM {units} WHERE lifecycle IN ('active', 'archived')""",
)
def _export_markdown(t):
    return sinks.markdown_blocks(t.units.withColumn("version", F.col("updated_s")))


SCOPED = """SELECT id, 'local' AS scope_org, scope_space, CASE WHEN length(id) % 2 = 0 THEN 'ann' ELSE 'bob' END AS scope_user,
 'agent' AS scope_agent, CASE WHEN scope_space = 'topic:3' THEN '' ELSE 's1' END AS scope_session FROM {vectors}"""


@query(
    "flt1_scope_filter",
    """SELECT 'wildcard' AS variant, id, scope_space FROM {scoped} WHERE scope_org = 'local' AND scope_user = 'ann' AND scope_agent = 'agent'
 UNION ALL SELECT 'exact_empty', id, scope_space FROM {scoped} WHERE scope_org = 'local' AND scope_space = 'topic:3' AND scope_user = 'bob' AND scope_agent = 'agent' AND scope_session = ''
 UNION ALL SELECT 'literal_star', id, scope_space FROM {scoped} WHERE scope_space = '*'""",
    scoped=SCOPED,
)
def _scope_filter(t):
    rows = t.sql(SCOPED, "vectors")
    base = {"org": "local", "agent": "agent"}
    variants = {
        "wildcard": filters.scope_filter(rows, base | {"space": "*", "user": "ann", "session": "*"}),
        "exact_empty": filters.scope_filter(rows, base | {"space": "topic:3", "user": "bob", "session": ""}, wildcard=False),
        "literal_star": filters.scope_filter(rows, base | {"space": "*", "user": "ann", "session": "s1"}, wildcard=False),
    }
    out = None
    for name, df in variants.items():
        part = df.select(F.lit(name).alias("variant"), "id", "scope_space")
        out = part if out is None else out.unionByName(part)
    return out


FILTERS = {
    "eq": ("EQ", "lang", "en"),
    "ne": ("NE", "source", "src1"),
    "in": ("IN", "source", ["src0", "src2"]),
    "not_in": ("NOT_IN", "source", ["src0", "src2"]),
    "range": ("AND", [("GTE", "chars", 100), ("LT", "chars", 2000)]),
    "not": ("NOT", [("OR", [("EQ", "lang", "de"), ("EQ", "source", "src1")])]),
}


@query(
    "flt2_metadata_filter",
    """SELECT 'eq' AS variant, doc_id FROM {meta} WHERE lang = 'en'
 UNION ALL SELECT 'ne', doc_id FROM {meta} WHERE src IS NULL OR src <> 'src1'
 UNION ALL SELECT 'in', doc_id FROM {meta} WHERE src IN ('src0', 'src2')
 UNION ALL SELECT 'not_in', doc_id FROM {meta} WHERE src IS NULL OR src NOT IN ('src0', 'src2')
 UNION ALL SELECT 'range', doc_id FROM {meta} WHERE n_chars >= 100 AND n_chars < 2000
 UNION ALL SELECT 'not', doc_id FROM {meta} WHERE lang <> 'de' AND (src IS NULL OR src <> 'src1')
 UNION ALL SELECT 'contains', doc_id FROM {meta} WHERE src = 'src0' OR lang = 'src0'""",
    meta="SELECT doc_id, lang, n_chars, CASE WHEN doc_id % 5 <> 0 THEN source END AS src FROM {documents}",
)
def _metadata_filter(t):
    source = F.when(F.col("doc_id") % 5 != 0, F.col("source"))
    rows = t.documents.select(
        "doc_id",
        F.map_filter(
            F.create_map(F.lit("lang"), "lang", F.lit("source"), source, F.lit("chars"), F.col("n_chars").cast("string")),
            lambda key, value: value.isNotNull(),
        ).alias("metadata"),
        F.array_compact(F.array(source, F.col("lang"))).alias("tags"),
    )
    out = rows.filter(filters.metadata_filter(("CONTAINS", "tags", "src0"), F.col)).select(
        F.lit("contains").alias("variant"), "doc_id"
    )
    for name, tree in FILTERS.items():
        out = out.unionByName(rows.filter(filters.metadata_filter(tree)).select(F.lit(name).alias("variant"), "doc_id"))
    return out


@query(
    "flt3_recall_eligible",
    """SELECT id, memory_type FROM {units} WHERE memory_type NOT IN ('capture', 'evolved')
 AND NOT (source = 'src1' AND lifecycle = 'archived')""",
)
def _recall_eligible(t):
    carried = F.when((F.col("source") == "src1") & (F.col("lifecycle") == "archived"), F.col("id"))
    return filters.recall_eligible(t.units.withColumn("capture_event_id", carried)).select("id", "memory_type")


@query(
    "flt4_formal_visible",
    """SELECT id, memory_type, lifecycle FROM {units} WHERE lifecycle IN ('active', 'superseded', 'archived')
 AND memory_type IN ('decision', 'constraint', 'preference', 'domain_fact', 'reusable_experience', 'external_reference')""",
)
def _formal_visible(t):
    return filters.formal_visible(t.units).select("id", "memory_type", "lifecycle")


NAMED_PARTS = """SELECT p_partkey, p_name, concat(p_type, CASE WHEN p_size % 3 = 0 THEN '%100' WHEN p_size % 3 = 1 THEN '_a' ELSE chr(92) END) AS alias FROM {part}"""


@query(
    "flt5_literal_match",
    """SELECT 'percent' AS variant, p_partkey FROM {named} WHERE contains(lower(p_name), '%1') OR contains(lower(alias), '%1')
 UNION ALL SELECT 'underscore', p_partkey FROM {named} WHERE contains(lower(p_name), '_a') OR contains(lower(alias), '_a')
 UNION ALL SELECT 'backslash', p_partkey FROM {named} WHERE contains(lower(p_name), chr(92)) OR contains(lower(alias), chr(92))""",
    named=NAMED_PARTS,
)
def _literal_match(t):
    rows = t.sql(NAMED_PARTS, "part").withColumn("aliases", F.array("alias"))
    out = None
    for name, text in {"percent": "%1", "underscore": " _A", "backslash": "\\", "blank": "  "}.items():
        part = filters.literal_match(rows, text, "p_name", "aliases").select(F.lit(name).alias("variant"), "p_partkey")
        out = part if out is None else out.unionByName(part)
    return out


REQUESTS = """SELECT concat('q', CAST(o_orderkey AS STRING)) AS query_id,
 CASE WHEN o_orderkey % 4 IN (0, 3) THEN '/work/p1' END AS cwd, CAST(NULL AS STRING) AS library_id,
 CASE WHEN o_orderkey % 4 = 1 THEN 'user' WHEN o_orderkey % 20 = 3 THEN 'user' END AS region_id,
 CASE WHEN o_orderkey % 4 = 2 THEN o_custkey % 25 END AS n_regions, o_orderkey % 6 = 0 AS repeats,
 CASE WHEN o_orderkey % 9 = 0 THEN 3 ELSE CAST(1 + o_orderkey % 2 AS INT) END AS graph_hops,
 CASE WHEN o_orderkey % 17 = 0 THEN '  ' ELSE o_orderpriority END AS query,
 CASE WHEN o_custkey % 10 = 0 THEN 100 ELSE 10000 END AS token_budget FROM {orders}"""


@query(
    "flt6_check_queries",
    """SELECT query_id, concat_ws('; ',
 CASE WHEN (CASE WHEN cwd IS NULL THEN 0 ELSE 1 END) + (CASE WHEN region_id IS NULL THEN 0 ELSE 1 END) + (CASE WHEN n_regions IS NULL THEN 0 ELSE 1 END) <> 1 THEN 'exactly one selector is required' END,
 CASE WHEN n_regions = 0 AND NOT repeats THEN 'at least one memory region is required' END,
 CASE WHEN n_regions + CASE WHEN repeats THEN 2 ELSE 0 END > 20 THEN 'too many memory regions' END,
 CASE WHEN n_regions IS NOT NULL AND repeats THEN 'memory regions must not contain duplicates' END,
 CASE WHEN graph_hops NOT IN (1, 2) THEN 'graph hops must be 1 or 2' END,
 CASE WHEN trim(query) = '' THEN 'search query must not be empty' END,
 CASE WHEN token_budget < 512 THEN 'token budget is too small' END) AS reasons FROM {requests}""",
    requests=REQUESTS,
)
def _check_queries(t):
    names = F.transform(
        F.filter(F.sequence(F.lit(0), F.col("n_regions").cast("int")), lambda i: i < F.col("n_regions")),
        lambda i: F.concat(F.lit("r"), i.cast("string")),
    )
    twice = F.when(F.col("repeats"), F.array(F.lit("x"), F.lit("x"))).otherwise(F.array().cast("array<string>"))
    rows = t.sql(REQUESTS, "orders").withColumn(
        "region_ids", F.when(F.col("n_regions").isNotNull(), F.concat(names, twice))
    )
    valid, rejects = filters.check_queries(rows)
    return rejects.select("query_id", F.array_join("reasons", "; ").alias("reasons")).unionByName(
        valid.select("query_id", F.lit("").alias("reasons"))
    )
