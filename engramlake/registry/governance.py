"""Queries for governance and index repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake.operators import govern, repair, retrieve
from engramlake.registry.core import query
from engramlake.registry.recall import terms_sql

VERSIONED = """SELECT region_id, id, content, memory_type, lifecycle, CAST(1 + updated_s % 3 AS INT) AS version, supersedes, CAST(1.0 AS DOUBLE) AS weight, updated_s FROM {units}"""
OPS = """SELECT CAST(substr(id, 2) AS BIGINT) AS op_seq, region_id, CASE WHEN updated_s % 17 = 0 THEN concat('x', id) ELSE id END AS target_id, id AS real_id, version, content,
 updated_s % 13 = 0 AS stale, CASE CAST(updated_s % 7 AS INT) WHEN 0 THEN 'supersede' WHEN 1 THEN 'overwrite' WHEN 2 THEN 'archive' WHEN 3 THEN 'forget' WHEN 4 THEN 'downweight' WHEN 5 THEN 'purge' ELSE 'rename' END AS action,
 concat('New text of ', id) AS new_content, updated_s + 100 AS at_s FROM {versioned}
 UNION ALL SELECT CAST(substr(id, 2) AS BIGINT) + 100000000, region_id, id, id, version, content, false, 'archive', '', updated_s + 200 FROM {versioned} WHERE updated_s % 19 = 0"""
JUDGED_OPS = """SELECT *, coalesce(own_reason, CASE WHEN row_number() OVER (PARTITION BY region_id, target_id, own_reason IS NULL ORDER BY op_seq) > 1 THEN 'concurrent operation' END) AS reason FROM (
 SELECT o.*, CASE WHEN action = 'rename' THEN 'unknown action' WHEN u.lifecycle IS NULL THEN 'not found' WHEN stale THEN 'stale revision' WHEN u.lifecycle = 'forgotten' AND action <> 'purge' THEN 'forgotten' END AS own_reason
 FROM {ops} o LEFT JOIN {versioned} u ON u.id = o.target_id AND u.region_id = o.region_id) j"""


@query(
    "gov1_apply_mutations",
    """SELECT 'unit' AS kind, u.region_id, u.id AS row_key, CASE WHEN o.action = 'overwrite' THEN o.new_content ELSE sha256(u.content) END AS body,
 CASE o.action WHEN 'supersede' THEN 'superseded' WHEN 'archive' THEN 'archived' WHEN 'forget' THEN 'forgotten' ELSE u.lifecycle END AS state,
 u.version + CASE WHEN o.action = 'overwrite' THEN 1 ELSE 0 END AS version, CASE WHEN o.action = 'downweight' THEN 0.5 ELSE 1.0 END AS weight
 FROM {versioned} u LEFT JOIN (SELECT * FROM {judged_ops} WHERE reason IS NULL) o ON o.target_id = u.id AND o.region_id = u.region_id WHERE coalesce(o.action, '') <> 'purge'
 UNION ALL SELECT 'unit', region_id, concat('unit:', substr(sha256(concat(region_id, chr(0), target_id, chr(0), CAST(op_seq AS STRING))), 1, 32)), new_content, 'active', version + 1, 1.0 FROM {judged_ops} WHERE reason IS NULL AND action = 'supersede'
 UNION ALL SELECT 'audit', region_id, target_id, sha256(content), action, 0, 0.0 FROM {judged_ops} WHERE reason IS NULL
 UNION ALL SELECT 'conflict', region_id, target_id, reason, action, 0, 0.0 FROM {judged_ops} WHERE reason IS NOT NULL""",
    versioned=VERSIONED,
    ops=OPS,
    judged_ops=JUDGED_OPS,
)
def _apply_mutations(t):
    units = t.sql(VERSIONED, "units")
    ops = t.spark.sql(OPS, versioned=units)
    revision = F.when(F.col("stale"), "stale").otherwise(govern.revision_of("real_id"))
    changed, audit, conflicts = govern.apply_mutations(units, ops.withColumn("expected_revision", revision).drop("real_id", "version", "content", "stale"))
    body = F.when(F.col("content").startswith("New text of u"), F.col("content")).otherwise(F.sha2("content", 256))
    return (
        changed.select(F.lit("unit").alias("kind"), "region_id", F.col("id").alias("row_key"), body.alias("body"), F.col("lifecycle").alias("state"), "version", "weight")
        .unionByName(
            audit.select(F.lit("audit").alias("kind"), "region_id", F.col("target_id").alias("row_key"), F.sha2("before", 256).alias("body"), F.col("action").alias("state"), F.lit(0).alias("version"), F.lit(0.0).alias("weight"))
        )
        .unionByName(
            conflicts.select(F.lit("conflict").alias("kind"), "region_id", F.col("target_id").alias("row_key"), F.col("reason").alias("body"), F.col("action").alias("state"), F.lit(0).alias("version"), F.lit(0.0).alias("weight"))
        )
    )


# Each customer's orders form one lineage, so lineages are long; some of its versions are forgotten.
LINEAGES = """SELECT 'user' AS region_id, concat('o', CAST(o_orderkey AS STRING)) AS id, concat('o', CAST(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS STRING)) AS supersedes,
 concat(o_orderpriority, ' ', o_orderstatus) AS content, CASE WHEN lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) IS NOT NULL THEN 'superseded' WHEN o_custkey % 7 = 0 THEN 'forgotten' ELSE 'active' END AS lifecycle,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version, 'decision' AS memory_type, o_orderkey AS updated_s, o_custkey FROM {orders}"""
CHAINS = """SELECT id, first_value(id) OVER w AS lineage_id, version AS position, last_value(id) OVER w AS latest_id, count(*) OVER w AS length, o_custkey, content, lifecycle FROM {lineages}
 WINDOW w AS (PARTITION BY o_custkey ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


def lineages(t):
    """concat() with a null argument is null in Spark and empty in the twin, so the first version is set here."""
    return t.sql(LINEAGES, "orders")


@query("gov2_version_chains", "SELECT id, lineage_id, position, latest_id, length FROM {chains}", lineages=LINEAGES, chains=CHAINS)
def _version_chains(t):
    return govern.version_chains(lineages(t).select("id", "supersedes"))


RESTORES = """SELECT c_custkey AS op_seq, 'user' AS region_id, CASE WHEN c_custkey % 9 = 0 THEN concat('o', CAST(hi2 AS STRING)) ELSE concat('o', CAST(hi AS STRING)) END AS current_id, concat('o', CAST(lo AS STRING)) AS restore_id, c_custkey AS at_s
 FROM (SELECT o_custkey AS c_custkey, min(o_orderkey) AS lo, max(o_orderkey) AS hi, (SELECT max(o_orderkey) FROM {orders}) AS hi2 FROM {orders} GROUP BY o_custkey) x"""


@query(
    "gov3_restore_versions",
    """SELECT op_seq, CASE WHEN oc.o_custkey <> cc.o_custkey THEN 'different lineage' WHEN lc.lifecycle = 'active' AND lc.content = oc.content THEN 'already active' ELSE 'restored' END AS outcome,
 CASE WHEN oc.o_custkey = cc.o_custkey AND NOT (lc.lifecycle = 'active' AND lc.content = oc.content) THEN oc.latest_id END AS supersedes,
 CASE WHEN oc.o_custkey = cc.o_custkey AND NOT (lc.lifecycle = 'active' AND lc.content = oc.content) THEN lc.position + 1 END AS version
 FROM {restores} r JOIN {chains} oc ON oc.id = r.restore_id JOIN {chains} cc ON cc.id = r.current_id JOIN {chains} lc ON lc.id = oc.latest_id""",
    lineages=LINEAGES,
    chains=CHAINS,
    restores=RESTORES,
)
def _restore_versions(t):
    ops = t.sql(RESTORES, "orders")
    created, _, rejects = govern.restore_versions(lineages(t), ops)
    return created.select(
        F.col("updated_s").alias("op_seq"), F.lit("restored").alias("outcome"), "supersedes", F.col("version").cast("long").alias("version")
    ).unionByName(
        rejects.select("op_seq", F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("supersedes"), F.lit(None).cast("long").alias("version"))
    )


@query(
    "gov4_version_diff",
    """SELECT n.id, array_to_string(list_sort(list_distinct(list_filter(string_split(o.content, chr(10)), lambda x: NOT list_contains(string_split(n.content, chr(10)), x)))), '|') AS removed,
 array_to_string(list_sort(list_distinct(list_filter(string_split(n.content, chr(10)), lambda x: NOT list_contains(string_split(o.content, chr(10)), x)))), '|') AS added
 FROM {units} n JOIN {units} o ON o.id = n.supersedes""",
)
def _version_diff(t):
    return govern.version_diff(t.units).select(
        "id", F.array_join(F.array_sort("removed"), "|").alias("removed"), F.array_join(F.array_sort("added"), "|").alias("added")
    )


FORGETS = """SELECT id AS target_id, CASE WHEN updated_s % 3 = 0 THEN 'archive' ELSE 'forget' END AS action, updated_s AS occurred_s, content AS before, concat('after ', id) AS after FROM {units}
 UNION ALL SELECT id, 'forget', updated_s + 50, content, NULL FROM {units} WHERE lifecycle = 'forgotten' AND updated_s % 2 = 0"""


@query(
    "gov5_forgotten_list",
    """SELECT u.region_id, u.id, u.memory_type, max(CASE WHEN f.action = 'forget' THEN f.occurred_s END) AS deleted_s FROM {units} u LEFT JOIN {forgets} f ON f.target_id = u.id
 WHERE u.lifecycle = 'forgotten' GROUP BY 1, 2, 3""",
    forgets=FORGETS,
)
def _forgotten_list(t):
    listed = govern.forgotten_list(t.units, t.sql(FORGETS, "units"))
    return listed.select("region_id", "id", "memory_type", "deleted_s")


ORDER_AUDIT = "SELECT id AS target_id, content AS before, concat(content, '!') AS after, updated_s AS seq FROM {lineages}"


@query(
    "gov6_redact_history",
    """SELECT a.target_id, a.seq, CASE WHEN c.o_custkey % 7 <> 0 THEN a.before END AS before, CASE WHEN c.o_custkey % 7 <> 0 THEN a.after END AS after, c.o_custkey % 7 = 0 AS redacted
 FROM {order_audit} a JOIN {chains} c ON c.id = a.target_id""",
    lineages=LINEAGES,
    chains=CHAINS,
    order_audit=ORDER_AUDIT,
)
def _redact_history(t):
    units = lineages(t)
    audit = t.spark.sql(ORDER_AUDIT, lineages=units)
    return govern.redact_history(audit, units).select("target_id", "seq", "before", "after", "redacted")


TOMBSTONE_KEY = "tombstone-key"


@query(
    "gov7_block_forgotten",
    """SELECT c.id FROM {units} c WHERE NOT EXISTS (SELECT 1 FROM {units} f WHERE f.lifecycle = 'forgotten' AND f.region_id = c.region_id
 AND lower(trim(regexp_replace(f.content, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(c.content, '\\s+', ' ', 'g'))))""",
)
def _block_forgotten(t):
    gone = t.units.filter(F.col("lifecycle") == "forgotten").select(
        govern.content_tombstone(TOMBSTONE_KEY, "content", "region_id").alias("tombstone")
    )
    candidates = t.units.select("id", F.replace("content", F.lit(" "), F.lit("  ")).alias("content"), F.col("region_id").alias("source_range"))
    return govern.block_forgotten(candidates, gone, TOMBSTONE_KEY).select("id")


@query(
    "gov8_audit_latest",
    """SELECT seq, target_id FROM {audit} WHERE action = 'error' AND target_space = 'topic:3' AND target_id IN (SELECT concat('m', CAST(c_custkey AS STRING)) FROM {customer}) ORDER BY seq DESC LIMIT 100""",
)
def _audit_latest(t):
    lineage = t.customer.select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("target_id"))
    return govern.audit_latest(t.audit, {"action": "error", "target_space": "topic:3", "layer": ""}, 100, lineage).select("seq", "target_id")


LISTED = """SELECT *, [concat('c', id), concat('c2', id)] AS provenance FROM {units} UNION ALL SELECT id, region_id, memory_type, lifecycle, supersedes, content, source, updated_s - 500, ['x'] FROM {units} WHERE updated_s % 5 = 0"""


@query(
    "gov9_list_memories",
    """SELECT region_id, rank, id, lifecycle, updated_s, CASE WHEN length(content) > 160 THEN concat(substr(content, 1, 160), '…') ELSE content END AS summary, n > 20 AS has_more,
 CASE WHEN n > 20 THEN last_value(concat(CAST(updated_s AS STRING), ':', id)) OVER (PARTITION BY region_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS next_cursor FROM (
 SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY updated_s DESC, id DESC) AS rank, count(*) OVER (PARTITION BY region_id) AS n FROM {units} u WHERE lifecycle IN ('active', 'superseded', 'archived')
 AND memory_type NOT IN ('capture', 'evolved') AND (updated_s < 1769500000 OR (updated_s = 1769500000 AND id < 'u5'))) p WHERE rank <= 20""",
)
def _list_memories(t):
    provenance = F.array(F.concat(F.lit("c"), "id"), F.concat(F.lit("c2"), "id"))
    older = t.units.filter(F.col("updated_s") % 5 == 0).withColumn("updated_s", F.col("updated_s") - 500)
    units = t.units.unionByName(older).withColumn("provenance", provenance)
    cursors = t.units.select("region_id").distinct().select("region_id", F.lit(1769500000).alias("cursor_s"), F.lit("u5").alias("cursor_id"))
    # A copy of a unit with an older time must not show up as a second row below the cursor.
    page = govern.list_memories(units, limit=20, cursors=cursors)
    return page.select("region_id", "rank", "id", "lifecycle", "updated_s", "summary", "has_more", "next_cursor")


@query(
    "gov10_memory_detail",
    """SELECT u.id, e.region_id AS evidence_region_id, concat('u', CAST(CAST(substr(u.id, 2) AS BIGINT) + s.step AS STRING)) AS evidence_id, e.id IS NOT NULL AS resolved, coalesce(e.lifecycle = 'forgotten', false) AS redacted,
 CASE WHEN coalesce(e.lifecycle, '') <> 'forgotten' THEN sha256(e.content) END AS body FROM {units} u CROSS JOIN (SELECT 1 AS step UNION ALL SELECT 7) s LEFT JOIN {units} e ON e.id = concat('u', CAST(CAST(substr(u.id, 2) AS BIGINT) + s.step AS STRING))""",
)
def _memory_detail(t):
    number = F.substring("id", 2, 20).cast("long")
    provenance = F.array(*[F.concat(F.lit("u"), (number + step).cast("string")) for step in (1, 7)])
    units = t.units.withColumn("provenance", provenance)
    detail = govern.memory_detail(units, t.units, t.units)
    return detail.select("id", "evidence_region_id", "evidence_id", "resolved", "redacted", F.sha2("body", 256).alias("body"))


PROVENANCE = """SELECT concat('u', CAST(doc_id AS STRING)) AS id, concat('u', CAST(CAST(floor(doc_id / 2) AS BIGINT) AS STRING)) AS p1, concat('u', CAST(CAST(floor(doc_id / 3) AS BIGINT) AS STRING)) AS p2 FROM {documents}"""


@query(
    "gov11_provenance_closure",
    """SELECT id, ancestor_id, min(depth) AS depth FROM {closure} WHERE id <> ancestor_id GROUP BY 1, 2""",
    links=PROVENANCE,
    parents="SELECT id, p1 AS ancestor_id FROM {links} WHERE id <> p1 UNION SELECT id, p2 FROM {links} WHERE id <> p2",
    closure="SELECT id, ancestor_id, 1 AS depth FROM {parents} UNION SELECT c.id, p.ancestor_id, c.depth + 1 FROM closure c JOIN {parents} p ON p.id = c.ancestor_id",
)
def _provenance_closure(t):
    units = t.sql(PROVENANCE, "documents").select("id", F.array("p1", "p2").alias("provenance"))
    return govern.provenance_closure(units)


INDEX_IDS = "SELECT id FROM {units} WHERE updated_s % 4 <> 0 UNION ALL SELECT concat('ghost', id) FROM {units} WHERE updated_s % 9 = 0"


@query(
    "idx1_find_drift",
    """SELECT 'missing' AS kind, id FROM {units} WHERE lifecycle = 'active' AND id NOT IN (SELECT id FROM {index_ids})
 UNION ALL SELECT 'orphan', id FROM {index_ids} WHERE id NOT IN (SELECT id FROM {units} WHERE lifecycle = 'active')""",
    index_ids=INDEX_IDS,
)
def _find_drift(t):
    missing, orphans = repair.find_drift(t.units, t.sql(INDEX_IDS, "units"))
    return missing.select(F.lit("missing").alias("kind"), "id").unionByName(orphans.select(F.lit("orphan").alias("kind"), "id"))


@query(
    "idx2_repair_index",
    f"""SELECT term, id, doc_len, region_id, count(*) AS tf FROM (SELECT id, region_id, len(t) AS doc_len, unnest(t) AS term FROM (SELECT id, region_id, {terms_sql('content')} AS t FROM {{units}} WHERE lifecycle = 'active') x) e GROUP BY 1, 2, 3, 4""",
)
def _repair_index(t):
    stale = t.units.filter((F.col("updated_s") % 4 != 0) | (F.col("lifecycle") != "active"))
    old = retrieve.build_text_index(repair.dealt_units(stale, t.units.count())).postings
    return repair.repair_index(t.units, old)
