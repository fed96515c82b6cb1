"""Queries for the entity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake.operators import entities as eg
from engramlake.registry.core import query
from engramlake.registry.screening import CTES as SCREENING
from engramlake.registry.stored import stored

EID = "concat('entity:', sha256(concat('[\"', {r}, '\",\"', {t}, '\",\"', {n}, '\"]')))"


def eid(region: str, kind: str, name: str) -> str:
    return EID.replace("{r}", region).replace("{t}", kind).replace("{n}", name)


RID = "concat('relation:', sha256(concat('[\"', region_id, '\",\"', source_entity_id, '\",\"', target_entity_id, '\",\"', relation_type, '\"]')))"
ME = f"SELECT region_id, memory_id, {eid('region_id', 'entity_type', 'lower(name)')} AS entity_id, entity_type, name AS canonical_name, lower(name) AS normalized_name, lifecycle, updated_s FROM {{entity_support}}"
MR0 = f"""SELECT region_id, memory_id, {eid('region_id', "'component'", 'lower(source_name)')} AS source_entity_id, {eid('region_id', "'organization'", 'lower(target_name)')} AS target_entity_id,
 relation_type, lifecycle, updated_s FROM {{relation_support}}"""
MR = f"SELECT *, {RID} AS relation_id FROM {{mr0}}"
ENTS = "SELECT DISTINCT region_id, entity_id, entity_type, canonical_name, normalized_name FROM {me}"
RELS = "SELECT DISTINCT region_id, relation_id, source_entity_id, target_entity_id, relation_type FROM {mr}"
VIS = """SELECT region_id, relation_id, source_entity_id, target_entity_id, relation_type, max(updated_s) AS newest_s FROM {mr} WHERE lifecycle = 'active' GROUP BY 1, 2, 3, 4, 5"""
ENDS = """SELECT region_id, relation_id, relation_type, newest_s, source_entity_id AS entity_id, target_entity_id AS other_id FROM {vis}
 UNION ALL SELECT region_id, relation_id, relation_type, newest_s, target_entity_id, source_entity_id FROM {vis}"""
STANDING = """SELECT e.*, m.updated_s, coalesce(d.degree, 0) AS degree FROM {ents} e
 JOIN (SELECT region_id, entity_id, max(updated_s) AS updated_s FROM {me} WHERE lifecycle = 'active' GROUP BY 1, 2) m ON m.region_id = e.region_id AND m.entity_id = e.entity_id
 LEFT JOIN (SELECT region_id, entity_id, count(*) AS degree FROM {ends} GROUP BY 1, 2) d ON d.region_id = e.region_id AND d.entity_id = e.entity_id"""
GRAPH = {"me": ME, "mr0": MR0, "mr": MR, "ents": ENTS, "rels": RELS, "vis": VIS, "ends": ENDS, "standing": STANDING}


# Ids inside a plan: the first eight bytes of an id, then the key it is made of, in a third of the room. They are equal exactly where the
# ids are, sort as the ids do (where eight bytes agree, by the key), and ``entity_ids`` and ``relation_ids`` spell them without a join.
def _packed(full, key):
    return F.concat(F.unhex(F.substring(F.substring_index(full, ":", -1), 1, 16)), F.encode(key, "UTF-8"))


def _key_of(packed):
    return F.decode(F.substr(packed, F.lit(9)), "UTF-8")


def _packed_entity(kind, name):
    full = eg.entity_key(F.col("region_id"), kind, name)
    return _packed(full, F.concat(kind, F.coalesce(F.concat(F.lit(":"), name), F.lit(""))))


def _full_relation(kind, source, target):
    ends = [eg.entity_key(F.col("region_id"), F.lit(of), name) for of, name in (("component", source), ("organization", target))]
    return eg.relation_key(F.col("region_id"), *ends, kind)


def _packed_relation(kind, source, target):
    size = F.coalesce(F.length(source), F.lit(-1)).cast("string")
    key = F.concat(kind, F.lit(":"), size, F.lit(":"), F.coalesce(source, F.lit("")), F.coalesce(F.concat(F.lit(":"), target), F.lit("")))
    return _packed(_full_relation(kind, source, target), key)


def entity_ids(packed="entity_id"):
    """The ids of packed entities, in rows with region_id."""
    key = _key_of(F.col(packed))
    at = F.instr(key, ":")
    kind = F.when(at > 0, F.substring_index(key, ":", 1)).otherwise(key)
    return eg.entity_key(F.col("region_id"), kind, F.when(at > 0, F.substr(key, at + 1)))


def relation_ids(packed="relation_id"):
    """The ids of packed relations, in rows with region_id."""
    key = _key_of(F.col(packed))
    kind = F.substring_index(key, ":", 1)
    size = F.substring_index(F.substring_index(key, ":", 2), ":", -1)
    names = F.substr(key, F.length(kind) + F.length(size) + 3)
    n = size.cast("int")
    source = F.when(n >= 0, F.substr(names, F.lit(1), n))
    rest = F.substr(names, F.greatest(n, F.lit(0)) + 1)
    return _full_relation(kind, source, F.when(rest != "", F.substr(rest, F.lit(2))))


def memory_entities_of(t):
    """Entity supports; names are ASCII, so lower() normalizes them. Ids are packed."""
    supports = stored(t, "entity-supports", lambda: t.entity_support)
    return supports.select(
        "region_id", "memory_id", _packed_entity(F.col("entity_type"), F.lower("name")).alias("entity_id"), F.col("name").alias("canonical_name"),
        F.array().cast("array<string>").alias("aliases"), F.array(F.concat("memory_id", F.lit(" names "), "name")).alias("evidence"), "lifecycle", "updated_s",
    )


def graph_of(t) -> eg.EntityGraph:
    """Graph tables of the part/supplier supports, which are stored as they are named; ids are packed."""
    named = stored(t, "entity-supports", lambda: t.entity_support).select("region_id", "entity_type", "name").distinct()
    entities = named.select(
        "region_id", _packed_entity(F.col("entity_type"), F.lower("name")).alias("entity_id"), "entity_type", F.col("name").alias("canonical_name"),
        F.lower("name").alias("normalized_name"),
    )
    supports = stored(t, "relation-supports", lambda: t.relation_support).withColumns({"sn": F.lower("source_name"), "tn": F.lower("target_name")})
    relation_id = _packed_relation(F.col("relation_type"), F.col("sn"), F.col("tn")).alias("relation_id")
    return eg.EntityGraph(
        entities=entities,
        aliases=entities.select("region_id", "entity_type", F.col("normalized_name").alias("normalized_alias"), "entity_id"),
        relations=supports.select("region_id", "sn", "tn", "relation_type").distinct().select(
            "region_id", relation_id, _packed_entity(F.lit("component"), F.col("sn")).alias("source_entity_id"),
            _packed_entity(F.lit("organization"), F.col("tn")).alias("target_entity_id"), "relation_type",
        ),
        memory_entities=memory_entities_of(t),
        memory_relations=supports.select("region_id", "memory_id", relation_id, F.array("memory_id").alias("evidence"), "lifecycle", "updated_s"),
    )


@query(
    "ent1_entity_keys",
    f"""SELECT c_custkey, region_id, name, {eid('region_id', "'organization'", 'name')} AS entity_id
 FROM (SELECT c_custkey, concat('n', CAST(c_nationkey AS STRING)) AS region_id, concat(lower(c_name), ' é ', lower(c_mktsegment)) AS name FROM {{customer}}) c""",
)
def _entity_keys(t):
    rows = t.customer.select(
        "c_custkey",
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("region_id"),
        F.lit("organization").alias("entity_type"),
        F.concat(F.lit("  "), F.upper("c_name"), F.lit(" \t É  "), "c_mktsegment", F.lit(" ")).alias("canonical_name"),
    )
    return eg.entity_keys(rows).select("c_custkey", "region_id", F.col("normalized_name").alias("name"), "entity_id")


CANDIDATE_MEMORIES = """SELECT doc_id, CASE WHEN doc_id % 41 = 0 THEN ' ' WHEN doc_id % 43 = 0 THEN concat('AKIA', upper(substr(md5(text), 1, 16))) ELSE id END AS memory_id,
 CASE WHEN doc_id % 47 = 0 THEN 'Bearer abcdefghijklmnopqrstuvwxyz' WHEN doc_id % 53 = 0 THEN '' ELSE text END AS content,
 CASE WHEN doc_id % 29 = 0 THEN 'draft' WHEN doc_id % 31 = 0 THEN ' ' ELSE lifecycle END AS lifecycle,
 CASE WHEN doc_id % 37 = 0 THEN '' WHEN doc_id % 23 = 0 THEN 'a,,b' ELSE concat('ref:', id, ', ref:x,ref:x') END AS refs, region_id,
 CASE WHEN doc_id % 59 = 0 THEN 'password=hunter2secret' ELSE region_id END AS region_name, 'topic' AS region_kind
 FROM (SELECT d.doc_id, d.text, u.* FROM {documents} d JOIN {units} u ON u.id = concat('u', CAST(d.doc_id AS STRING))) x"""


@query(
    "ent2_eligible_memories",
    """SELECT doc_id, reason, CASE WHEN reason = 'eligible' THEN concat('ref:', memory_id, ',ref:x') END AS source_references FROM (
 SELECT c.doc_id, c.memory_id, CASE WHEN c.doc_id % 41 = 0 THEN 'memory_id is missing' WHEN c.doc_id % 43 = 0 THEN 'sensitive memory identifier' WHEN lifecycle = 'forgotten' THEN 'forgotten memory'
 WHEN lifecycle = 'draft' THEN 'unsupported memory lifecycle' WHEN refs IN ('', 'a,,b') OR trim(coalesce(content, '')) = '' OR disposition IS NOT NULL OR c.doc_id % 59 = 0 THEN 'sensitive or missing graph input' ELSE 'eligible' END AS reason
 FROM {candidates} c JOIN {judged} j ON j.doc_id = c.doc_id) x""",
    **(SCREENING | {"scanned": "SELECT doc_id, content AS text FROM {candidates}", "candidates": CANDIDATE_MEMORIES}),
)
def _eligible_memories(t):
    rows = t.sql(CANDIDATE_MEMORIES, "documents", "units").withColumn("source_references", F.split("refs", ","))
    accepted, skipped = eg.eligible_memories(rows)
    return accepted.select(
        "doc_id", F.lit("eligible").alias("reason"), F.array_join("source_references", ",").alias("source_references")
    ).unionByName(skipped.select("doc_id", "reason", F.lit(None).cast("string").alias("source_references")))


# One extracted entity per document: verbatim, absent, of unknown type, or with good or bad evidence.
EXTRACTED = """SELECT region_id, id AS memory_id, content, lifecycle, updated_s, CAST(updated_s % 6 AS INT) AS k, trim(substr(content, 1, 6)) AS head,
 CASE WHEN updated_s % 6 = 1 THEN 'zzz absent' ELSE trim(substr(content, 1, 6)) END AS canonical_name, CASE WHEN updated_s % 6 = 2 THEN 'gadget' ELSE 'concept' END AS entity_type,
 CASE CAST(updated_s % 6 AS INT) WHEN 3 THEN 'zzz not verbatim' WHEN 4 THEN trim(substr(content, 1, 40)) WHEN 5 THEN trim(substr(content, 300, 20)) ELSE '' END AS snippet FROM {units}"""


def extractions_of(rows, evidence):
    item = F.struct(
        F.col("entity_type").alias("type"), F.col("canonical_name"), F.lit(None).cast("string").alias("id"),
        F.array().cast("array<string>").alias("aliases"), evidence.cast("array<string>").alias("evidence"),
    )
    relation = F.struct(
        *[F.lit("x").alias(n) for n in ("type", "source", "source_type", "target", "target_type")],
        F.array().cast("array<string>").alias("evidence"),
    )
    return rows.select("region_id", "memory_id", F.array(item).alias("entities"), F.filter(F.array(relation), lambda r: F.lit(False)).alias("relations"))


def memories_of(rows):
    return rows.select(
        "region_id", "memory_id", F.array("content").alias("texts"), F.array("region_id").alias("region_texts"),
        F.array(F.lit("ref")).alias("source_references"), "lifecycle", "updated_s",
    )


@query(
    "ent3_explode_extractions",
    """SELECT memory_id, 'entity' AS kind, canonical_name AS name FROM {extracted} WHERE k <> 5 UNION ALL SELECT memory_id, 'rejected', 'evidence exceeds 50 items' FROM {extracted} WHERE k = 5""",
    extracted=EXTRACTED,
)
def _explode_extractions(t):
    rows = t.sql(EXTRACTED, "units")
    evidence = F.array_repeat(F.col("snippet"), F.when(F.col("k") == 5, 51).otherwise(50))
    found, _, failed = eg.explode_extractions(extractions_of(rows, evidence))
    return found.select("memory_id", F.lit("entity").alias("kind"), F.col("canonical_name").alias("name")).unionByName(
        failed.select("memory_id", F.lit("rejected").alias("kind"), F.col("reason").alias("name"))
    )


@query(
    "ent4_accept_entities",
    """SELECT memory_id, CASE WHEN outcome = 'accepted' AND snippet = '' AND disposition IS NOT NULL THEN 'sensitive evidence' ELSE outcome END AS outcome,
 CASE WHEN outcome = 'accepted' AND (snippet <> '' OR disposition IS NULL) THEN sha256(CASE WHEN snippet = '' THEN content ELSE snippet END) END AS evidence_hash FROM (
 SELECT e.*, j.disposition, CASE WHEN k = 2 THEN 'unknown entity type' WHEN canonical_name = '' THEN 'missing name' WHEN NOT contains(content, canonical_name) AND NOT contains(region_id, canonical_name) THEN 'name has no support'
 WHEN snippet <> '' AND NOT (contains(content, snippet) AND contains(snippet, canonical_name)) THEN 'evidence is not verbatim' ELSE 'accepted' END AS outcome
 FROM {extracted} e JOIN {judged} j ON e.memory_id = concat('u', CAST(j.doc_id AS STRING))) x""",
    extracted=EXTRACTED,
    **(SCREENING | {"scanned": "SELECT doc_id, text FROM {documents}"}),
)
def _accept_entities(t):
    rows = t.sql(EXTRACTED, "units")
    evidence = F.filter(F.array("snippet"), lambda s: s != "")
    found, _, _ = eg.explode_extractions(extractions_of(rows, evidence))
    accepted, rejected = eg.accept_entities(found, memories_of(rows))
    return accepted.select(
        "memory_id", F.lit("accepted").alias("outcome"), F.sha2(F.get("evidence", F.lit(0)), 256).alias("evidence_hash")
    ).unionByName(
        rejected.select("memory_id", F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("evidence_hash"))
    )


MENTIONS = """SELECT concat('r', CAST(p_size % 7 AS STRING)) AS region_id, concat('m', CAST(p_partkey AS STRING)) AS memory_id, p_partkey AS updated_s, 0 AS position, 'component' AS entity_type,
 CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE concat('The  ', p_brand) END AS canonical_name, CASE WHEN p_partkey % 3 = 1 THEN p_brand END AS alias FROM {part}"""
MENTION_NODES = """SELECT region_id, lower(replace(canonical_name, '  ', ' ')) AS node, lower(replace(replace(canonical_name, 'The  ', ''), '  ', ' ')) AS brand, min(updated_s) AS first_s, max(CASE WHEN alias IS NOT NULL THEN 1 ELSE 0 END) AS linked FROM {mentions} GROUP BY 1, 2, 3"""


@query(
    "ent5_resolve_identity",
    f"""SELECT m.memory_id, {eid('m.region_id', "'component'", 'coalesce(o.owner, n.node)')} AS entity_id FROM {{mentions}} m
 JOIN {{mention_nodes}} n ON n.region_id = m.region_id AND n.node = lower(replace(m.canonical_name, '  ', ' '))
 LEFT JOIN (SELECT region_id, brand, arg_min(node, first_s) AS owner FROM {{mention_nodes}} WHERE node = brand OR linked = 1 GROUP BY 1, 2) o
 ON o.region_id = n.region_id AND o.brand = n.brand AND (n.node = n.brand OR n.linked = 1)""",
    mentions=MENTIONS,
    mention_nodes=MENTION_NODES,
)
def _resolve_identity(t):
    rows = t.sql(MENTIONS, "part").withColumn("aliases", F.array_compact(F.array("alias"))).drop("alias")
    known = rows.limit(0).select(
        "region_id", "entity_type", F.col("canonical_name").alias("normalized_alias"), F.lit("").alias("entity_id"), F.lit(True).alias("canonical")
    )
    resolved, _ = eg.resolve_identity(rows, known)
    return resolved.select("memory_id", "entity_id")


LINES = """SELECT DISTINCT concat('r', CAST(l_suppkey % 3 AS STRING)) AS region_id, concat('m', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS memory_id,
 concat('Part ', CAST(l_partkey AS STRING)) AS part, concat('Supplier ', CAST(l_suppkey AS STRING)) AS supplier, CAST((l_orderkey + l_linenumber) % 6 AS INT) AS k FROM {lineitem}"""


@query(
    "ent6_accept_relations",
    f"""SELECT memory_id, 'accepted' AS outcome, concat('relation:', sha256(concat('["', region_id, '","', s, '","', t, '","depends_on"]'))) AS relation_id FROM (
 SELECT *, {eid('region_id', "'component'", 'lower(part)')} AS s, {eid('region_id', "'organization'", 'lower(supplier)')} AS t FROM {{lines}}) x WHERE k = 0
 UNION ALL SELECT memory_id, CASE k WHEN 1 THEN 'unknown relation type' WHEN 2 THEN 'unresolved end' WHEN 3 THEN 'self relation' WHEN 4 THEN 'missing evidence' ELSE 'evidence is not verbatim' END, NULL FROM {{lines}} WHERE k > 0""",
    lines=LINES,
)
def _accept_relations(t):
    rows = t.sql(LINES, "lineitem").withColumn("sentence", F.concat("part", F.lit(" is from "), "supplier"))
    memories = rows.select(
        "region_id", "memory_id", F.array("sentence").alias("texts"), F.array(F.lit("ref")).alias("source_references"),
        F.lit("active").alias("lifecycle"), F.lit(1).alias("updated_s"),
    )
    ends = rows.select(
        "region_id", "memory_id",
        F.inline(F.array(
            F.struct(F.lit("component").alias("entity_type"), F.col("part").alias("canonical_name"), F.lit(0).alias("position")),
            F.struct(F.lit("organization").alias("entity_type"), F.col("supplier").alias("canonical_name"), F.lit(1).alias("position")),
        )),
    ).withColumns({"aliases": F.array().cast("array<string>"), "raw_id": F.lit(None).cast("string"), "lowered": F.lower("canonical_name")})
    ends = ends.withColumn("entity_id", eg.entity_key("region_id", "entity_type", "lowered"))
    k = F.col("k")
    relations = rows.select(
        "region_id", "memory_id", F.lit(0).alias("position"),
        F.when(k == 1, "likes").otherwise("depends_on").alias("relation_type"),
        F.concat(F.lit("component: "), "part").alias("source"), F.lit(None).cast("string").alias("source_type"),
        F.when(k == 2, "Nobody").when(k == 3, F.concat(F.lit("component:"), "part")).otherwise(F.col("supplier")).alias("target"),
        F.lit("organization").alias("target_type"),
        F.when(k == 4, F.array().cast("array<string>")).when(k == 5, F.array(F.lit("zzz"))).otherwise(F.array("sentence")).alias("evidence"),
    )
    accepted, rejected = eg.accept_relations(relations, ends, memories)
    return accepted.select("memory_id", F.lit("accepted").alias("outcome"), "relation_id").unionByName(
        rejected.select("memory_id", F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("relation_id"))
    )


@query(
    "ent7_aggregate_supports",
    """SELECT 'entity' AS kind, region_id, entity_id AS row_key, count(*) AS n_memories, string_agg(memory_id, ',' ORDER BY memory_id) AS memory_ids FROM (
 SELECT *, row_number() OVER (PARTITION BY region_id, entity_id ORDER BY memory_id) AS n FROM {me}) x WHERE n <= 50 GROUP BY 2, 3
 UNION ALL SELECT 'relation', region_id, relation_id, count(*), string_agg(memory_id, ',' ORDER BY memory_id) FROM (
 SELECT *, row_number() OVER (PARTITION BY region_id, relation_id ORDER BY memory_id) AS n FROM {mr}) x WHERE n <= 50 GROUP BY 2, 3
 UNION ALL SELECT 'alias', region_id, entity_id, 1, normalized_name FROM {ents}""",
    **GRAPH,
)
def _aggregate_supports(t):
    entities, relations, aliases = eg.aggregate_supports(graph_of(t))

    def shaped(df, kind, key):
        return df.select(
            F.lit(kind).alias("kind"), "region_id", key.alias("row_key"),
            F.size("evidence_memory_ids").alias("n_memories"), F.array_join("evidence_memory_ids", ",").alias("memory_ids"),
        )

    return (
        shaped(entities, "entity", entity_ids())
        .unionByName(shaped(relations, "relation", relation_ids()))
        .unionByName(
            aliases.select(
                F.lit("alias").alias("kind"), "region_id", entity_ids().alias("row_key"), F.lit(1).alias("n_memories"),
                F.col("normalized_alias").alias("memory_ids"),
            )
        )
    )


CHANGES = """SELECT DISTINCT region_id, memory_id, CASE WHEN updated_s % 3600 = 0 THEN 'forgotten' ELSE 'archived' END AS lifecycle, updated_s + 5 AS updated_s FROM {entity_support} WHERE updated_s % 420 = 0 OR updated_s % 3600 = 0"""
PRESENT = "SELECT DISTINCT region_id, memory_id FROM {entity_support} WHERE updated_s % 660 <> 0"
KEPT_ME = """SELECT m.region_id, m.memory_id, m.entity_id, coalesce(c.lifecycle, m.lifecycle) AS lifecycle, coalesce(c.updated_s, m.updated_s) AS updated_s FROM {me} m
 JOIN {present} p ON p.region_id = m.region_id AND p.memory_id = m.memory_id LEFT JOIN {changes} c ON c.region_id = m.region_id AND c.memory_id = m.memory_id WHERE coalesce(c.lifecycle, '') <> 'forgotten'"""
KEPT_RELS = """SELECT r.* FROM {rels} r WHERE EXISTS (SELECT 1 FROM {kept_me} s WHERE s.region_id = r.region_id AND s.entity_id = r.source_entity_id)
 AND EXISTS (SELECT 1 FROM {kept_me} s WHERE s.region_id = r.region_id AND s.entity_id = r.target_entity_id)"""


@query(
    "ent8_maintain",
    """SELECT 'support' AS kind, region_id, memory_id AS row_key, entity_id AS value, lifecycle, updated_s FROM {kept_me}
 UNION ALL SELECT DISTINCT 'entity', region_id, entity_id, '', '', 0 FROM {kept_me}
 UNION ALL SELECT 'relation', region_id, relation_id, '', '', 0 FROM {kept_rels}
 UNION ALL SELECT 'relation_support', m.region_id, m.memory_id, m.relation_id, coalesce(c.lifecycle, m.lifecycle), coalesce(c.updated_s, m.updated_s) FROM {mr} m
 JOIN {present} p ON p.region_id = m.region_id AND p.memory_id = m.memory_id LEFT JOIN {changes} c ON c.region_id = m.region_id AND c.memory_id = m.memory_id
 JOIN {kept_rels} k ON k.region_id = m.region_id AND k.relation_id = m.relation_id WHERE coalesce(c.lifecycle, '') <> 'forgotten'""",
    **(GRAPH | {"changes": CHANGES, "present": PRESENT, "kept_me": KEPT_ME, "kept_rels": KEPT_RELS}),
)
def _maintain(t):
    kept = eg.maintain(graph_of(t), t.sql(CHANGES, "entity_support"), t.sql(PRESENT, "entity_support"))

    def shaped(df, kind, key, value=None):
        timed = value is not None
        return df.select(
            F.lit(kind).alias("kind"), "region_id", key.alias("row_key"),
            (value if timed else F.lit("")).alias("value"),
            (F.col("lifecycle") if timed else F.lit("")).alias("lifecycle"),
            (F.col("updated_s") if timed else F.lit(0).cast("long")).alias("updated_s"),
        )

    return (
        shaped(kept.memory_entities, "support", F.col("memory_id"), entity_ids())
        .unionByName(shaped(kept.entities, "entity", entity_ids()))
        .unionByName(shaped(kept.relations, "relation", relation_ids()))
        .unionByName(shaped(kept.memory_relations, "relation_support", F.col("memory_id"), relation_ids()))
    )


# Every region except "user" is rebuilt; one memory of topic-9 fails, and forgotten units are gone.
REBUILT = """SELECT region_id, id AS memory_id, content, lifecycle, updated_s, 'concept' AS entity_type, concat('Kind ', memory_type) AS canonical_name FROM {units}"""


@query(
    "ent9_rebuild",
    """SELECT 'support' AS kind, region_id, memory_id AS row_key, CASE WHEN region_id IN ('user', 'topic-9') THEN 'old' ELSE 'new' END AS value, CASE WHEN region_id = 'user' THEN 'active' ELSE lifecycle END AS lifecycle FROM {rebuilt}
 WHERE region_id = 'user' OR lifecycle <> 'forgotten'
 UNION ALL SELECT 'status', region_id, CASE WHEN region_id = 'topic-9' THEN 'degraded' ELSE 'ready' END, CAST(count(*) FILTER (WHERE lifecycle <> 'forgotten') - CASE WHEN region_id = 'topic-9' THEN 1 ELSE 0 END AS STRING),
 CAST(CASE WHEN region_id = 'topic-9' THEN 1 ELSE 0 END AS STRING) FROM {rebuilt} WHERE region_id <> 'user' GROUP BY region_id""",
    rebuilt=REBUILT,
)
def _rebuild(t):
    rows = t.sql(REBUILT, "units").withColumn("texts_all", F.concat("canonical_name", F.lit(" is what this memory is.")))
    old = rows.withColumn("old_name", F.lit("old thing")).withColumn("entity_id", eg.entity_key("region_id", "entity_type", "old_name"))
    text_list, no_rows = "array<string>", rows.limit(0)
    current = eg.EntityGraph(
        entities=old.select("region_id", "entity_id", "entity_type", F.lit("Old thing").alias("canonical_name"), F.col("old_name").alias("normalized_name")).distinct(),
        aliases=old.select("region_id", "entity_type", F.col("old_name").alias("normalized_alias"), "entity_id").distinct(),
        relations=no_rows.select("region_id", *[F.lit("").alias(c) for c in ("relation_id", "source_entity_id", "target_entity_id", "relation_type")]),
        memory_entities=old.select(
            "region_id", "memory_id", "entity_id", F.lit("Old thing").alias("canonical_name"), F.array().cast(text_list).alias("aliases"),
            F.array().cast(text_list).alias("evidence"), F.lit("active").alias("lifecycle"), "updated_s",
        ),
        memory_relations=no_rows.select("region_id", "memory_id", F.lit("").alias("relation_id"), F.array().cast(text_list).alias("evidence"), "lifecycle", "updated_s"),
    )
    alive = rows.filter((F.col("region_id") != "user") & (F.col("lifecycle") != "forgotten"))
    skipped = rows.filter((F.col("region_id") != "user") & (F.col("lifecycle") == "forgotten")).select(
        "region_id", "memory_id", F.lit("forgotten memory").alias("reason")
    )
    first_topic = alive.filter(F.col("region_id") == "topic-9").agg(F.min("memory_id").alias("m"))
    failing = F.array_repeat(F.col("canonical_name"), F.when(F.col("memory_id") == F.col("first_id"), 51).otherwise(1))
    extractions = extractions_of(alive.withColumn("first_id", first_topic.scalar()), failing)
    memories = memories_of(alive.withColumn("content", F.col("texts_all")))
    known = current.aliases.limit(0).withColumn("canonical", F.lit(True))
    graph, status = eg.rebuild(current, memories, skipped, extractions, known)
    named = graph.memory_entities.select(
        F.lit("support").alias("kind"), "region_id", F.col("memory_id").alias("row_key"),
        F.when(F.col("canonical_name") == "Old thing", "old").otherwise("new").alias("value"), "lifecycle",
    )
    return named.unionByName(
        status.select(
            F.lit("status").alias("kind"), "region_id", F.col("status").alias("row_key"),
            F.col("projected_memories").cast("string").alias("value"), F.col("rejected_items").cast("string").alias("lifecycle"),
        )
    )


@query(
    "ent10_entity_status",
    """SELECT region_id, sum(e) AS entities, sum(r) AS relations, sum(m) AS projected_memories FROM (
 SELECT region_id, count(DISTINCT entity_id) AS e, 0 AS r, 0 AS m FROM {me} WHERE lifecycle = 'active' GROUP BY 1
 UNION ALL SELECT region_id, 0, count(DISTINCT relation_id), 0 FROM {mr} WHERE lifecycle = 'active' GROUP BY 1
 UNION ALL SELECT region_id, 0, 0, count(DISTINCT memory_id) FROM (SELECT region_id, memory_id FROM {me} WHERE lifecycle = 'active' UNION SELECT region_id, memory_id FROM {mr} WHERE lifecycle = 'active') u GROUP BY 1) x GROUP BY region_id""",
    **GRAPH,
)
def _entity_status(t):
    return eg.entity_status(graph_of(t))


@query(
    "ent11_rank_entities",
    """SELECT region_id, entity_id, degree, updated_s, rank FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY degree DESC, updated_s DESC, entity_type, normalized_name, entity_id) AS rank FROM {standing}) s WHERE rank <= 200""",
    **GRAPH,
)
def _rank_entities(t):
    return eg.rank_entities(graph_of(t)).select("region_id", entity_ids().alias("entity_id"), "degree", "updated_s", "rank")


# One view per supplier, seeded by its entity.
SUPPLIER_SEEDS = f"""SELECT DISTINCT canonical_name AS query_id, region_id, entity_id, 1 AS seed_rank FROM {{ents}} WHERE entity_type = 'organization'"""
FOLLOWED = """SELECT query_id, region_id, other_id AS entity_id FROM (SELECT s.query_id, s.region_id, e.other_id, dense_rank() OVER (PARTITION BY s.query_id, s.region_id ORDER BY e.newest_s DESC, e.relation_type, e.relation_id) AS n
 FROM {seeds} s JOIN {ends} e ON e.region_id = s.region_id AND e.entity_id = s.entity_id) f WHERE n <= 401"""
SELECTED = """SELECT query_id, region_id, entity_id, seed_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, region_id ORDER BY seed_rank NULLS LAST, entity_id) AS n FROM (
 SELECT query_id, region_id, entity_id, seed_rank FROM {seeds} UNION ALL
 SELECT DISTINCT f.query_id, f.region_id, f.entity_id, CAST(NULL AS INT) FROM {followed} f WHERE NOT EXISTS (SELECT 1 FROM {seeds} s WHERE s.query_id = f.query_id AND s.region_id = f.region_id AND s.entity_id = f.entity_id)) g) h WHERE n <= 400"""
ORDERED = """SELECT *, row_number() OVER (PARTITION BY query_id, region_id ORDER BY seed_rank NULLS LAST, degree DESC, updated_s DESC, entity_type, normalized_name, entity_id) AS position FROM (
 SELECT c.query_id, c.seed_rank, s.* FROM {selected} c JOIN {standing} s ON s.region_id = c.region_id AND s.entity_id = c.entity_id) o"""
VIEW_NODES = "SELECT * FROM {ordered} WHERE position <= 200"
VIEW_EDGES = """SELECT *, row_number() OVER (PARTITION BY query_id, region_id ORDER BY newest_s DESC, relation_type, relation_id) AS position FROM (
 SELECT a.query_id, v.* FROM {view_nodes} a JOIN {vis} v ON v.region_id = a.region_id AND v.source_entity_id = a.entity_id
 JOIN {view_nodes} b ON b.query_id = a.query_id AND b.region_id = a.region_id AND b.entity_id = v.target_entity_id) e"""
VIEW = GRAPH | {"followed": FOLLOWED, "selected": SELECTED, "ordered": ORDERED, "view_nodes": VIEW_NODES, "view_edges": VIEW_EDGES}


@query(
    "ent12_neighborhood",
    """SELECT 'node' AS kind, query_id, region_id, entity_id AS row_key, position, CASE WHEN seed_rank IS NULL THEN 'background' ELSE 'direct' END AS state FROM {view_nodes}
 UNION ALL SELECT 'edge', query_id, region_id, relation_id, position, '' FROM {view_edges} WHERE position <= 400
 UNION ALL SELECT 'flags', s.query_id, s.region_id, '', 0, concat(CASE WHEN (SELECT count(*) FROM {ordered} o WHERE o.query_id = s.query_id AND o.region_id = s.region_id) > 200 THEN 'nodes' ELSE '' END,
 CASE WHEN (SELECT count(*) FROM {view_edges} o WHERE o.query_id = s.query_id AND o.region_id = s.region_id) > 400 THEN 'edges' ELSE '' END) FROM {seeds} s""",
    **(VIEW | {"seeds": SUPPLIER_SEEDS}),
)
def _neighborhood(t):
    graph = graph_of(t)
    seeds = graph.entities.filter(F.col("entity_type") == "organization").select(
        F.col("canonical_name").alias("query_id"), "region_id", "entity_id", F.lit(1).alias("seed_rank")
    )
    view = eg.neighborhood(graph, seeds)
    return (
        view.nodes.select(F.lit("node").alias("kind"), "query_id", "region_id", entity_ids().alias("row_key"), "position", F.col("graph_state").alias("state"))
        .unionByName(
            view.edges.select(F.lit("edge").alias("kind"), "query_id", "region_id", relation_ids().alias("row_key"), "position", F.lit("").alias("state"))
        )
        .unionByName(
            view.flags.select(
                F.lit("flags").alias("kind"), "query_id", "region_id", F.lit("").alias("row_key"), F.lit(0).alias("position"),
                F.concat(F.when(F.col("nodes_truncated"), "nodes").otherwise(""), F.when(F.col("edges_truncated"), "edges").otherwise("")).alias("state"),
            )
        )
    )


# One recall per customer group: its orders are the hits, more than a view may be seeded with.
CUSTOMER_HITS = """SELECT DISTINCT concat('c', CAST(o_custkey % 25 AS STRING)) AS query_id, concat('region-', CAST(o_custkey % 3 AS STRING)) AS region_id, concat('m', CAST(o_orderkey AS STRING)) AS memory_id, o_orderkey AS rank FROM {orders}"""
BOUNDED_HITS = """SELECT query_id, region_id, memory_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, region_id ORDER BY rank, memory_id) AS n FROM {hits}) b WHERE n <= 200"""
HIT_SEEDS = """SELECT query_id, region_id, entity_id, seed_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, region_id ORDER BY entity_type, normalized_name, entity_id) AS seed_rank FROM (
 SELECT DISTINCT h.query_id, h.region_id, m.entity_id, m.entity_type, m.normalized_name FROM {bounded_hits} h JOIN {me} m ON m.region_id = h.region_id AND m.memory_id = h.memory_id WHERE m.lifecycle = 'active') d) r WHERE seed_rank <= 200"""
HIT_MAP = """SELECT h.query_id, h.region_id, h.memory_id, CASE WHEN max(b.memory_id) IS NULL THEN 'truncated' WHEN count(n.entity_id) > 0 THEN 'mapped' WHEN count(m.entity_id) > 0 THEN 'truncated' ELSE 'unmapped' END AS mapping
 FROM {hits} h LEFT JOIN {bounded_hits} b ON b.query_id = h.query_id AND b.region_id = h.region_id AND b.memory_id = h.memory_id
 LEFT JOIN {me} m ON m.region_id = b.region_id AND m.memory_id = b.memory_id AND m.lifecycle = 'active'
 LEFT JOIN {view_nodes} n ON n.query_id = h.query_id AND n.region_id = h.region_id AND n.entity_id = m.entity_id GROUP BY 1, 2, 3"""
EDGE_STATE = """SELECT e.query_id, e.region_id, e.relation_id, CASE WHEN EXISTS (SELECT 1 FROM {hits} h JOIN {mr} m ON m.region_id = h.region_id AND m.memory_id = h.memory_id WHERE m.lifecycle = 'active' AND h.query_id = e.query_id AND m.region_id = e.region_id AND m.relation_id = e.relation_id)
 OR (EXISTS (SELECT 1 FROM {view_nodes} n WHERE n.query_id = e.query_id AND n.region_id = e.region_id AND n.entity_id = e.source_entity_id AND n.seed_rank IS NOT NULL)
 AND EXISTS (SELECT 1 FROM {view_nodes} n WHERE n.query_id = e.query_id AND n.region_id = e.region_id AND n.entity_id = e.target_entity_id AND n.seed_rank IS NOT NULL)) THEN 'direct' ELSE 'query_expansion' END AS state FROM {view_edges} e WHERE position <= 400"""


HIT_VIEW = VIEW | {
    "hits": CUSTOMER_HITS, "bounded_hits": BOUNDED_HITS, "seeds": HIT_SEEDS, "hit_map": HIT_MAP, "edge_state": EDGE_STATE
}
HIT_REPORT = """SELECT m.query_id, m.region_id, count(*) FILTER (WHERE mapping = 'mapped') AS mapped_memories, count(*) FILTER (WHERE mapping = 'unmapped') AS unmapped_memories,
 count(*) FILTER (WHERE mapping = 'truncated') AS truncated_memories, count(*) AS n, coalesce(max(o.n), 0) > 200 OR coalesce(max(v.n), 0) > 400 AS cut FROM {hit_map} m
 LEFT JOIN (SELECT query_id, region_id, count(*) AS n FROM {ordered} GROUP BY 1, 2) o ON o.query_id = m.query_id AND o.region_id = m.region_id
 LEFT JOIN (SELECT query_id, region_id, count(*) AS n FROM {view_edges} GROUP BY 1, 2) v ON v.query_id = m.query_id AND v.region_id = m.region_id GROUP BY 1, 2"""


@query(
    "ent13_subgraph_report",
    """SELECT query_id, region_id, mapped_memories, unmapped_memories, truncated_memories, cut OR truncated_memories > 0 AS truncated,
 concat_ws(', ', CASE WHEN n > 200 THEN 'direct_memory_seed_limit' END, CASE WHEN cut THEN 'graph_node_or_edge_limit' END, CASE WHEN truncated_memories > 0 THEN 'node_limit' END) AS truncation_reason,
 mapped_memories = 0 AND truncated_memories = 0 AS no_mapped_entities FROM {hit_report}""",
    **(HIT_VIEW | {"hit_report": HIT_REPORT}),
)
def _subgraph_report(t):
    return eg.subgraph_report(*eg.query_subgraph(graph_of(t), t.sql(CUSTOMER_HITS, "orders")))


@query(
    "ent13_query_subgraph",
    """SELECT 'node' AS kind, query_id, region_id, entity_id AS row_key, CASE WHEN seed_rank IS NULL THEN 'query_expansion' ELSE 'direct' END AS state FROM {view_nodes}
 UNION ALL SELECT 'edge', query_id, region_id, relation_id, state FROM {edge_state}
 UNION ALL SELECT 'hit', query_id, region_id, memory_id, mapping FROM {hit_map}""",
    **HIT_VIEW,
)
def _query_subgraph(t):
    view, mapping = eg.query_subgraph(graph_of(t), t.sql(CUSTOMER_HITS, "orders"))
    return (
        view.nodes.select(F.lit("node").alias("kind"), "query_id", "region_id", entity_ids().alias("row_key"), F.col("graph_state").alias("state"))
        .unionByName(
            view.edges.select(F.lit("edge").alias("kind"), "query_id", "region_id", relation_ids().alias("row_key"), F.col("graph_state").alias("state"))
        )
        .unionByName(
            mapping.select(F.lit("hit").alias("kind"), "query_id", "region_id", F.col("memory_id").alias("row_key"), F.col("mapping").alias("state"))
        )
    )


SUPPORTS = """SELECT region_id, entity_id, memory_id FROM {me} UNION SELECT region_id, source_entity_id, memory_id FROM {mr} UNION SELECT region_id, target_entity_id, memory_id FROM {mr}"""


@query(
    "ent14_entity_detail",
    """SELECT 'memory' AS kind, region_id, entity_id, memory_id AS row_key, position, total FROM (SELECT *, row_number() OVER (PARTITION BY region_id, entity_id ORDER BY memory_id) AS position,
 count(*) OVER (PARTITION BY region_id, entity_id) AS total FROM {supports}) s WHERE position > 10 AND position <= 60
 UNION ALL SELECT 'relation', region_id, entity_id, relation_id, position, 0 FROM (SELECT *, row_number() OVER (PARTITION BY region_id, entity_id ORDER BY relation_type, relation_id) AS position FROM (
 SELECT region_id, relation_id, relation_type, source_entity_id AS entity_id FROM {rels} UNION ALL SELECT region_id, relation_id, relation_type, target_entity_id FROM {rels}) x) r WHERE position <= 200""",
    **(GRAPH | {"supports": SUPPORTS}),
)
def _entity_detail(t):
    graph = graph_of(t)
    page, relations = eg.entity_detail(graph, graph.entities, offset=10)
    return page.select(
        F.lit("memory").alias("kind"), "region_id", entity_ids().alias("entity_id"), F.col("memory_id").alias("row_key"), "position",
        F.col("supporting_memory_count").alias("total"),
    ).unionByName(
        relations.select(
            F.lit("relation").alias("kind"), "region_id", entity_ids().alias("entity_id"), relation_ids().alias("row_key"), "position",
            F.lit(0).cast("long").alias("total"),
        )
    )


@query(
    "ent14_relation_detail",
    """SELECT region_id, relation_id, memory_id, source_entity_id, target_entity_id, position, total AS supporting_memory_count FROM (
 SELECT *, row_number() OVER (PARTITION BY region_id, relation_id ORDER BY memory_id) AS position, count(*) OVER (PARTITION BY region_id, relation_id) AS total FROM {mr}) x WHERE position <= 50""",
    **GRAPH,
)
def _relation_detail(t):
    graph = graph_of(t)
    return eg.relation_detail(graph, graph.relations).select(
        "region_id", relation_ids().alias("relation_id"), "memory_id", entity_ids("source_entity_id").alias("source_entity_id"),
        entity_ids("target_entity_id").alias("target_entity_id"), "position", "supporting_memory_count",
    )


@query(
    "ent15_memory_entities",
    """SELECT 'entity' AS kind, region_id, memory_id, entity_id AS row_key, row_number() OVER (PARTITION BY region_id, memory_id ORDER BY entity_type, normalized_name, entity_id) AS position FROM {me}
 UNION ALL SELECT 'relation', region_id, memory_id, relation_id, row_number() OVER (PARTITION BY region_id, memory_id ORDER BY relation_type, relation_id) FROM {mr}""",
    **GRAPH,
)
def _memory_entities(t):
    graph = graph_of(t)
    entities, relations = eg.memory_entities(graph, graph.memory_entities)
    return entities.select(
        F.lit("entity").alias("kind"), "region_id", "memory_id", entity_ids().alias("row_key"), "position"
    ).unionByName(
        relations.select(F.lit("relation").alias("kind"), "region_id", "memory_id", relation_ids().alias("row_key"), "position")
    )


@query(
    "ent16_display_state",
    """SELECT region_id, entity_id, CASE WHEN act = 1 THEN 'active' ELSE newest END AS lifecycle, CASE WHEN act = 1 OR newest = 'active' THEN 'current' ELSE 'historical' END AS display_state, updated_s, n_supports FROM (
 SELECT region_id, entity_id, max(CASE WHEN lifecycle = 'active' THEN 1 ELSE 0 END) AS act, arg_min(lifecycle, n) AS newest, max(updated_s) AS updated_s, count(*) AS n_supports FROM (
 SELECT *, row_number() OVER (PARTITION BY region_id, entity_id ORDER BY updated_s DESC, memory_id) AS n FROM {me}) x WHERE n <= 50 GROUP BY 1, 2) y""",
    **GRAPH,
)
def _display_state(t):
    return eg.display_state(memory_entities_of(t), "entity_id").withColumn("entity_id", entity_ids())
