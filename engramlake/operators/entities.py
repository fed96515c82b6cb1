"""The evidence-bound entity graph: projection, maintenance and bounded views."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, fields, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramlake.functions.expr import bind
from engramlake.functions.hashing import json_array_digest
from engramlake.functions.sensitive import is_sensitive
from engramlake.functions.windows import top_rows
from engramlake.operators.filters import VISIBLE_LIFECYCLES
from engramlake.session import cut_lineage, in_parts, written

# Vocabularies and caps of the entity graph.
ENTITY_TYPES = (
    "project",
    "technology",
    "component",
    "concept",
    "person",
    "organization",
    "constraint",
    "reference",
)
RELATION_TYPES = (
    "part_of",
    "uses",
    "depends_on",
    "implements",
    "has_constraint",
    "prefers",
    "references",
    "supersedes",
    "related_to",
)
MAX_NODES = 200
MAX_EDGES = 400
MAX_SUPPORTS = 50
MAX_EVIDENCE = 50
MAX_DETAIL_ROWS = 50
MAX_DETAIL_RELATIONS = 200


@dataclass(frozen=True)
class EntityGraph:
    """entities, aliases, relations and the memories that support them, all keyed by region."""

    entities: DataFrame
    aliases: DataFrame
    relations: DataFrame
    memory_entities: DataFrame
    memory_relations: DataFrame


@F.arrow_udf(T.StringType())
def _normalize_unicode(names: pa.Array) -> pa.Array:
    def one(name: str) -> str:
        return " ".join(unicodedata.normalize("NFKC", name).strip().casefold().split())

    if names.null_count == len(names):
        return names
    return pa.array([None if name is None else one(name) for name in names.to_pylist()], pa.string())


def normalized_name(name: Column) -> Column:
    """Compatibility-normalized, case-folded name with single spaces.

    Spark has no built-in compatibility normalization; only names with non-ASCII characters
    reach the Arrow batch function, all others arrive there as nulls.
    """
    text = F.coalesce(name, F.lit(""))
    plain = F.trim(F.regexp_replace(F.lower(text), r"[\s\x1c-\x1f]+", " "))
    other = _normalize_unicode(F.when(text.rlike(r"[^\x00-\x7f]"), text))
    return F.coalesce(other, plain)


def entity_key(region: str, kind: str, name: str) -> Column:
    return F.concat(F.lit("entity:"), json_array_digest(region, kind, name))


def relation_key(region: str, source: str, target: str, kind: str) -> Column:
    return F.concat(F.lit("relation:"), json_array_digest(region, source, target, kind))


def entity_keys(df: DataFrame) -> DataFrame:
    """Add normalized_name and entity_id to (region_id, entity_type, canonical_name) rows."""
    named = df.withColumn("normalized_name", normalized_name(F.col("canonical_name")))
    return named.withColumn("entity_id", entity_key("region_id", "entity_type", "normalized_name"))


def eligible_memories(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memories the projector may read, and skipped ones with a reason.

    Needs memory_id, content, lifecycle, source_references, region_id, region_name and
    region_kind.
    """
    references = F.transform("source_references", lambda r: F.trim(r))
    bad_references = (
        F.col("source_references").isNull()
        | (F.size("source_references") == 0)
        | F.exists(references, lambda r: r.isNull() | (r == "") | is_sensitive(r))
    )
    lifecycle = F.when(F.coalesce(F.trim("lifecycle"), F.lit("")) == "", "active").otherwise(F.trim("lifecycle"))
    sensitive_input = F.exists(F.array("content", "region_name", "region_id", "region_kind"), is_sensitive)
    reason = (
        F.when(F.coalesce(F.trim("memory_id"), F.lit("")) == "", "memory_id is missing")
        .when(is_sensitive(F.col("memory_id")), "sensitive memory identifier")
        .when(F.col("lifecycle") == "forgotten", "forgotten memory")
        .when(~F.col("lifecycle").isin(*VISIBLE_LIFECYCLES), "unsupported memory lifecycle")
        .when(bad_references | (F.coalesce(F.trim("content"), F.lit("")) == ""), "sensitive or missing graph input")
        .when(sensitive_input, "sensitive or missing graph input")
    )
    judged = units.withColumn("lifecycle", lifecycle).withColumn("reason", reason)
    accepted = judged.filter(F.col("reason").isNull()).drop("reason")
    return (
        accepted.withColumn("source_references", F.array_distinct(references)),
        judged.filter(F.col("reason").isNotNull()),
    )


def explode_extractions(extractions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, rejects): one row per item.

    A memory with an item carrying more than 50 evidence pieces fails as a whole.
    """
    def too_much(item: Column) -> Column:
        return F.coalesce(F.size(item["evidence"]), F.lit(0)) > MAX_EVIDENCE

    failed = F.exists("entities", too_much) | F.exists("relations", too_much)
    sound = extractions.filter(~failed)
    keys = ["region_id", "memory_id"]
    entities = sound.select(*keys, F.posexplode("entities").alias("position", "item")).select(
        *keys,
        "position",
        F.trim("item.type").alias("entity_type"),
        F.trim("item.canonical_name").alias("canonical_name"),
        F.trim("item.id").alias("raw_id"),
        F.array_distinct(
            F.filter(F.transform(F.coalesce("item.aliases", F.array()), lambda a: F.trim(a)), lambda a: a != "")
        ).alias("aliases"),
        F.col("item.evidence").alias("evidence"),
    )
    relations = sound.select(*keys, F.posexplode("relations").alias("position", "item")).select(
        *keys,
        "position",
        F.trim("item.type").alias("relation_type"),
        "item.source",
        "item.source_type",
        "item.target",
        "item.target_type",
        "item.evidence",
    )
    return entities, relations, extractions.filter(failed).select(*keys, F.lit("evidence exceeds 50 items").alias("reason"))


def _holds(text: Column, names: Column) -> Column:
    return F.exists(names, lambda name: (F.trim(name) != "") & F.contains(text, F.trim(name)))


def accept_entities(entities: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep entities whose name and evidence occur verbatim in their memory.

    ``memories`` has texts (content and evidence) and region_texts. Entities without evidence
    get the first text that names them.
    """
    keys = ["region_id", "memory_id"]
    joined = entities.join(memories.select(*keys, "texts", "region_texts", "lifecycle", "updated_s"), keys)
    names = F.concat(F.array("canonical_name"), "aliases")
    every_text = F.concat("texts", "region_texts")
    given = F.array_distinct(F.filter(F.coalesce("evidence", F.array()), lambda s: F.trim(s) != ""))
    snippets = F.filter(given, lambda s: ~is_sensitive(s))
    verbatim = F.forall(
        snippets,
        lambda s: F.exists("texts", lambda text: F.contains(text, F.trim(s))) & _holds(s, names),
    )
    fallback = F.get(F.filter(every_text, lambda text: _holds(text, names)), F.lit(0))
    evidence = F.when(F.size(snippets) > 0, snippets).otherwise(F.array(fallback))
    reason = (
        F.when(~F.coalesce(F.col("entity_type").isin(*ENTITY_TYPES), F.lit(False)), "unknown entity type")
        .when(F.coalesce("canonical_name", F.lit("")) == "", "missing name")
        .when(~F.exists(every_text, lambda text: _holds(text, names)), "name has no support")
        .when(
            F.exists(F.concat(names, F.array("raw_id")), is_sensitive),
            "sensitive name",
        )
        .when((F.size(given) > 0) & (F.size(snippets) == 0), "unusable evidence")
        .when((F.size(snippets) > MAX_EVIDENCE) | ~verbatim, "evidence is not verbatim")
        .when(F.exists(evidence, is_sensitive), "sensitive evidence")
    )
    judged = joined.withColumn("reason", reason).withColumn("evidence", evidence)
    accepted = judged.filter(F.col("reason").isNull()).drop("reason", "texts", "region_texts")
    return accepted, judged.filter(F.col("reason").isNotNull()).drop("texts", "region_texts")


def resolve_identity(
    entities: DataFrame, known: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Give every entity mention its entity id, and reject mentions two entities lay claim to.

    ``known`` holds (region_id, entity_type, normalized_alias, entity_id, canonical). A name
    that is a known canonical name keeps its entity. Otherwise the name and its aliases are
    looked up among known aliases, then among the names introduced earlier in the batch,
    ordered by (updated_s, memory_id, position); the earliest introducer of a name owns it.
    Types are never merged. Chains of single owners are halved in every round, so a chain of any
    length takes about log2 of it.
    """
    scope = ["region_id", "entity_type"]
    named = entities.withColumn("normalized_name", normalized_name(F.col("canonical_name"))).filter(
        F.col("normalized_name") != ""
    )
    order = F.struct("updated_s", "memory_id", "position")
    nodes = named.groupBy(*scope, "normalized_name").agg(F.min(order).alias("order"))
    aliases = named.select(*scope, "normalized_name", F.explode("aliases").alias("alias"))
    alias_names = aliases.select(*scope, "normalized_name", normalized_name(F.col("alias")).alias("name")).filter(
        F.col("name") != ""
    )
    claims = nodes.select(*scope, "normalized_name", F.col("normalized_name").alias("name")).unionByName(alias_names).distinct()
    canonical = known.filter("canonical").select(*scope, F.col("normalized_alias").alias("normalized_name"), F.col("entity_id").alias("exact_id"))
    through_alias = (
        claims.join(known.withColumnRenamed("normalized_alias", "name"), [*scope, "name"])
        .groupBy(*scope, "normalized_name")
        .agg(F.countDistinct("entity_id").alias("n_known"), F.min("entity_id").alias("alias_id"))
    )
    owners = (
        claims.join(nodes, [*scope, "normalized_name"])
        .groupBy(*scope, "name")
        .agg(F.min_by("normalized_name", F.struct("order", "normalized_name")).alias("owner"))
    )
    links = (
        claims.join(owners, [*scope, "name"])
        .filter(F.col("owner") != F.col("normalized_name"))
        .groupBy(*scope, "normalized_name")
        .agg(F.collect_set("owner").alias("owners"))
    )
    state = (
        nodes.join(canonical, [*scope, "normalized_name"], "left")
        .join(through_alias, [*scope, "normalized_name"], "left")
        .join(links, [*scope, "normalized_name"], "left")
        .withColumn("own_id", entity_key("region_id", "entity_type", "normalized_name"))
        .withColumn(
            "resolved",
            F.when(F.col("exact_id").isNotNull(), F.col("exact_id"))
            .when(F.col("n_known") > 1, "")
            .when(F.col("n_known") == 1, F.col("alias_id"))
            .when(F.col("owners").isNull(), F.col("own_id")),
        )
        .select(*scope, "normalized_name", "owners", "resolved", F.col("own_id").alias("fallback"))
    )
    state = cut_lineage(state)
    left = state.filter(F.col("resolved").isNull()).count()
    while left:
        pending = state.filter(F.col("resolved").isNull())
        answers = (
            pending.select(*scope, "normalized_name", F.explode("owners").alias("owner"))
            .join(
                state.select(*scope, F.col("normalized_name").alias("owner"), F.col("resolved").alias("owner_id")),
                [*scope, "owner"],
            )
            .groupBy(*scope, "normalized_name")
            .agg(
                F.count(F.when(F.col("owner_id").isNull(), 1)).alias("open"),
                F.countDistinct(F.when(F.col("owner_id") != "", F.col("owner_id"))).alias("n"),
                F.min(F.when(F.col("owner_id") != "", F.col("owner_id"))).alias("only_id"),
            )
            .select(
                *scope,
                "normalized_name",
                F.when(F.col("open") > 0, F.lit(None))
                .when(F.col("n") == 1, F.col("only_id"))
                .when(F.col("n") > 1, F.lit(""))
                .alias("answer"),
                ((F.col("open") == 0) & (F.col("n") == 0)).alias("refused"),
            )
        )
        # An open mention whose only owner is open too goes by that owner's owner; should that one be
        # refused, the skipped owner would have had its own id, which the mention takes.
        single = pending.filter(F.size("owners") == 1).select(
            *scope, F.col("normalized_name").alias("via"), F.col("owners").alias("next"), F.col("fallback").alias("next_fallback")
        )
        only = F.when(F.size("owners") == 1, F.get("owners", F.lit(0)))
        state = cut_lineage(
            state.join(answers, [*scope, "normalized_name"], "left")
            .withColumn("resolved", F.coalesce("resolved", "answer", F.when(F.col("refused"), F.col("fallback"))))
            .withColumn("via", F.when(F.col("resolved").isNull(), only))
            .join(single, [*scope, "via"], "left")
            .select(
                *scope, "normalized_name", F.coalesce("next", "owners").alias("owners"), "resolved",
                F.coalesce("next_fallback", "fallback").alias("fallback"), F.col("next").isNotNull().alias("moved"),
            )
        )
        facts = state.agg(F.count(F.when(F.col("resolved").isNull(), 1)).alias("left"), F.coalesce(F.max("moved"), F.lit(False)).alias("moved")).first()
        if facts.left == left and not facts.moved:
            raise ValueError("identities wait for each other")
        left = facts.left
        state = state.drop("moved")
    resolved = named.join(
        state.select(*scope, "normalized_name", F.nullif("resolved", F.lit("")).alias("entity_id")), [*scope, "normalized_name"]
    )
    return (
        resolved.filter(F.col("entity_id").isNotNull()),
        resolved.filter(F.col("entity_id").isNull()).withColumn("reason", F.lit("ambiguous identity")),
    )


def _reference(value: str, hint: str) -> tuple[Column, Column]:
    text = F.trim(value)
    split = F.contains(text, F.lit(":"))
    return (
        F.when(split, F.trim(F.substring_index(text, ":", 1))).otherwise(F.trim(F.coalesce(hint, F.lit("")))),
        F.when(split, F.trim(F.regexp_replace(text, "^[^:]*:", ""))).otherwise(text),
    )


def accept_relations(
    relations: DataFrame, entities: DataFrame, memories: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Relations whose ends are entities of the same memory and whose evidence is verbatim.

    What a memory's entities are called stands in one row beside its relations, which look both ends up there.
    """
    keys = ["region_id", "memory_id"]
    mentions = entities.select(
        *keys, "entity_type", "position", "entity_id",
        F.explode(F.filter(F.concat(F.array("canonical_name"), "aliases", F.array("raw_id")), lambda name: name != "")).alias("mention"),
    )
    # Null keys and positions are never met, so they are not collected either.
    met = F.col("region_id").isNotNull() & F.col("memory_id").isNotNull() & F.col("position").isNotNull()
    references = (
        mentions.filter(met)
        .select(*keys, "entity_type", "position", "entity_id", normalized_name(F.col("mention")).alias("name"))
        .filter(F.col("name") != "")
        .groupBy(*keys)
        .agg(F.collect_set(F.struct("entity_type", "name", "position", "entity_id")).alias("references"))
    )
    source_type, source_name = _reference("source", "source_type")
    target_type, target_name = _reference("target", "target_type")
    ends = relations.select(
        *relations.columns,
        source_type.alias("s_type"), normalized_name(source_name).alias("s_name"),
        target_type.alias("t_type"), normalized_name(target_name).alias("t_name"),
    )

    def end(prefix: str) -> Column:
        """The entity of that type and name, of several the one with the last position."""
        named = F.filter("references", lambda r: (r["entity_type"] == F.col(f"{prefix}_type")) & (r["name"] == F.col(f"{prefix}_name")))
        return F.array_max(F.transform(named, lambda r: F.struct(r["position"].alias("position"), r["entity_id"].alias("entity_id"))))["entity_id"]

    joined = (
        ends.join(references, keys, "left")
        .withColumns({"source_entity_id": end("s"), "target_entity_id": end("t")})
        .drop("references")
        .join(memories.select(*keys, "texts", "source_references", "lifecycle", "updated_s"), keys)
    )
    snippets = F.array_distinct(
        F.filter(F.coalesce("evidence", F.array()), lambda s: (F.trim(s) != "") & ~is_sensitive(s))
    )
    reason = (
        F.when(~F.coalesce(F.col("relation_type").isin(*RELATION_TYPES), F.lit(False)), "unknown relation type")
        .when(F.col("source_entity_id").isNull() | F.col("target_entity_id").isNull(), "unresolved end")
        .when(F.col("source_entity_id") == F.col("target_entity_id"), "self relation")
        # Bound, as the filters on the reason would scan the snippets anew wherever it names them.
        .otherwise(
            bind(
                snippets,
                lambda found: F.when((F.size(found) == 0) | (F.size(found) > MAX_EVIDENCE), "missing evidence").when(
                    ~F.forall(found, lambda s: F.exists("texts", lambda text: F.contains(text, F.trim(s)))), "evidence is not verbatim"
                ),
            )
        )
    )
    judged = joined.withColumn("reason", reason).withColumn("evidence", snippets).withColumn(
        "relation_id", relation_key("region_id", "source_entity_id", "target_entity_id", "relation_type")
    )
    columns = [
        *keys, "position", "relation_id", "source_entity_id", "target_entity_id", "relation_type", "evidence",
        "source_references", "lifecycle", "updated_s",
    ]
    return (
        judged.filter(F.col("reason").isNull()).select(*columns),
        judged.filter(F.col("reason").isNotNull()).select(*keys, "position", "relation_type", "reason"),
    )


def _first_supports(supports: DataFrame, key: str) -> DataFrame:
    """Arrays over the first 50 supporting memories of each key; bounded by that cap."""
    first = top_rows(supports, ["region_id", key], [F.col("memory_id")], MAX_SUPPORTS, "n")
    # Each result has rows of its own, so that what a caller leaves out is not shuffled.
    lists = {"ids": ["memory_id"], "rows": ["memory_id", "evidence"]} | ({"named": ["aliases"]} if "aliases" in supports.columns else {})
    grouped = first.groupBy("region_id", key).agg(
        *[F.sort_array(F.collect_list(F.struct("n", *columns))).alias(name) for name, columns in lists.items()]
    )
    out = {
        "evidence_memory_ids": F.transform("ids", lambda r: r["memory_id"]),
        "evidence": F.slice(
            F.array_distinct(
                F.flatten(
                    F.transform(
                        "rows",
                        lambda r: F.transform(
                            F.coalesce(r["evidence"], F.array().cast("array<string>")),
                            lambda e: F.struct(r["memory_id"].alias("memory_id"), e.alias("evidence")),
                        ),
                    )
                )
            ),
            1,
            MAX_EVIDENCE,
        ),
    }
    if "aliases" in supports.columns:
        out["aliases"] = F.array_distinct(
            F.flatten(F.transform("named", lambda r: F.coalesce(r["aliases"], F.array().cast("array<string>"))))
        )
    return grouped.withColumns(out).drop(*lists)


def aggregate_supports(graph: EntityGraph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, aliases) with the aggregates of their supports.

    A name belongs to the entity with the lowest id that claims it.
    """
    entities = graph.entities.select("region_id", "entity_id", "entity_type", "canonical_name", "normalized_name").join(
        _first_supports(graph.memory_entities, "entity_id"), ["region_id", "entity_id"]
    )
    relations = graph.relations.join(
        _first_supports(graph.memory_relations.drop("aliases"), "relation_id"), ["region_id", "relation_id"]
    )
    aliases = (
        entities.select(
            "region_id", "entity_type", "entity_id", F.explode(F.concat(F.array("canonical_name"), "aliases")).alias("name")
        )
        .select("region_id", "entity_type", normalized_name(F.col("name")).alias("normalized_alias"), "entity_id")
        .filter(F.col("normalized_alias") != "")
        .groupBy("region_id", "entity_type", "normalized_alias")
        .agg(F.min("entity_id").alias("entity_id"))
    )
    return entities, relations, aliases


def _stays(lifecycle: str) -> Column:
    return F.col(lifecycle).isNull() | F.col(lifecycle).isin(*VISIBLE_LIFECYCLES)


def maintain(graph: EntityGraph, changes: DataFrame | None = None, present: DataFrame | None = None) -> EntityGraph:
    """Apply lifecycle changes, drop absent memories, then delete what lost its support.

    ``changes`` has region_id, memory_id, lifecycle and updated_s; a lifecycle that is not
    visible removes the memory. ``present`` lists the memories (region_id, memory_id) to keep.
    """
    keys = ["region_id", "memory_id"]
    new = None
    if changes is not None:
        new = changes.select(*keys, F.col("lifecycle").alias("__lifecycle"), F.col("updated_s").alias("__updated"))
    if present is not None:
        # What becomes of each memory that stays, in one row: supports meet it once.
        staying = present.select(*keys).distinct()
        verdicts = staying if new is None else staying.join(new, keys, "left")
        verdicts = written(verdicts if new is None else verdicts.filter(_stays("__lifecycle")), "verdicts")

    def updated(supports: DataFrame) -> DataFrame:
        out = supports
        if present is not None:
            out = out.join(verdicts, keys, "left_semi" if new is None else "inner")
        elif new is not None:
            out = out.join(new, keys, "left").filter(_stays("__lifecycle"))
        if new is not None:
            out = (
                out.withColumn("lifecycle", F.coalesce("__lifecycle", "lifecycle"))
                .withColumn("updated_s", F.coalesce("__updated", "updated_s"))
                .drop("__lifecycle", "__updated")
            )
        return out

    memory_entities = updated(graph.memory_entities)
    entity_keys_left = ["region_id", "entity_id"]
    # Written step by step, so that a step's shuffles are gone when the next one begins.
    supported = written(memory_entities.select(*entity_keys_left).distinct(), "supported")
    entities = graph.entities.join(supported, entity_keys_left, "left_semi")
    relations = graph.relations.join(
        supported.withColumnRenamed("entity_id", "source_entity_id"), ["region_id", "source_entity_id"], "left_semi"
    ).join(supported.withColumnRenamed("entity_id", "target_entity_id"), ["region_id", "target_entity_id"], "left_semi")
    relations = written(relations.select(*graph.relations.columns), "kept-relations")
    memory_relations = updated(
        graph.memory_relations.join(relations.select("region_id", "relation_id"), ["region_id", "relation_id"], "left_semi")
    )
    return EntityGraph(
        entities=entities,
        aliases=graph.aliases.join(supported, entity_keys_left, "left_semi"),
        relations=relations,
        memory_entities=memory_entities,
        memory_relations=written(memory_relations.select(*graph.memory_relations.columns), "kept-memory-relations"),
    )


def project(memories: DataFrame, extractions: DataFrame, known: DataFrame) -> tuple[EntityGraph, DataFrame]:
    """Project eligible memories with their extractions into graph tables; also all rejects.

    ``memories`` needs region_id, memory_id, texts, region_texts, source_references,
    lifecycle and updated_s.
    """
    raw_entities, raw_relations, failed = explode_extractions(extractions)
    # Judged rows are read by several later steps, so each step is computed once.
    accepted, bad_entities = (cut_lineage(rows) for rows in accept_entities(raw_entities, memories))
    identified, ambiguous = resolve_identity(accepted, known)
    identified = cut_lineage(identified)
    relations, bad_relations = (cut_lineage(rows) for rows in accept_relations(raw_relations, identified, memories))
    first = identified.groupBy("region_id", "entity_id").agg(
        F.min_by(
            F.struct("entity_type", "canonical_name", "normalized_name"), F.struct("updated_s", "memory_id", "position")
        ).alias("e")
    )
    graph = EntityGraph(
        entities=first.select("region_id", "entity_id", "e.*"),
        aliases=known.drop("canonical").limit(0),
        relations=relations.select(
            "region_id", "relation_id", "source_entity_id", "target_entity_id", "relation_type"
        ).distinct(),
        memory_entities=identified.groupBy("region_id", "memory_id", "entity_id").agg(
            F.max_by(F.struct("canonical_name", "aliases", "evidence", "lifecycle", "updated_s"), "position").alias("s")
        ).select("region_id", "memory_id", "entity_id", "s.*"),
        memory_relations=relations.groupBy("region_id", "memory_id", "relation_id").agg(
            F.max_by(F.struct("evidence", "lifecycle", "updated_s"), "position").alias("s")
        ).select("region_id", "memory_id", "relation_id", "s.*"),
    )
    graph = replace(graph, aliases=aggregate_supports(graph)[2])
    rejects = (
        bad_entities.select("region_id", "memory_id", F.lit("entity").alias("kind"), "reason")
        .unionByName(ambiguous.select("region_id", "memory_id", F.lit("entity").alias("kind"), "reason"))
        .unionByName(bad_relations.select("region_id", "memory_id", F.lit("relation").alias("kind"), "reason"))
        .unionByName(failed.select("region_id", "memory_id", F.lit("memory").alias("kind"), "reason"))
    )
    return graph, rejects


def rebuild(
    current: EntityGraph, memories: DataFrame, skipped: DataFrame, extractions: DataFrame, known: DataFrame
) -> tuple[EntityGraph, DataFrame]:
    """Re-project the regions of ``memories`` and report (region_id, status, projected, rejected).

    When a memory of a region fails extraction, the region keeps its last good rows for the
    memories that are still present and is marked degraded. ``known`` is usually empty: a
    rebuild derives identities afresh.
    """
    fresh, rejects = project(memories, extractions, known)
    touched = memories.select("region_id").unionByName(skipped.select("region_id")).distinct()
    failing = rejects.filter(F.col("kind") == "memory").select("region_id").distinct()
    present = memories.select("region_id", "memory_id")
    changes = memories.select("region_id", "memory_id", "lifecycle", "updated_s")
    kept = maintain(current, changes=changes, present=present)
    tables = {}
    for field in fields(EntityGraph):
        name = field.name
        untouched = getattr(current, name).join(touched, "region_id", "left_anti")
        rebuilt = getattr(fresh, name).join(failing, "region_id", "left_anti")
        held = getattr(kept, name).join(failing, "region_id", "left_semi")
        tables[name] = untouched.unionByName(rebuilt).unionByName(held)
    graph = EntityGraph(**tables)
    projected = (
        memories.join(rejects.filter(F.col("kind") == "memory"), ["region_id", "memory_id"], "left_anti")
        .groupBy("region_id")
        .agg(F.count(F.lit(1)).alias("projected_memories"))
    )
    refused = (
        rejects.select("region_id")
        .unionByName(skipped.filter(F.col("reason") != "forgotten memory").select("region_id"))
        .groupBy("region_id")
        .agg(F.count(F.lit(1)).alias("rejected_items"))
    )
    status = (
        touched.join(projected, "region_id", "left")
        .join(refused, "region_id", "left")
        .join(failing.withColumn("failed", F.lit(True)), "region_id", "left")
        .select(
            "region_id",
            F.when(F.col("failed"), "degraded").otherwise("ready").alias("status"),
            F.coalesce("projected_memories", F.lit(0)).alias("projected_memories"),
            F.coalesce("rejected_items", F.lit(0)).alias("rejected_items"),
        )
    )
    return graph, status


def _lifecycles(history: bool) -> tuple[str, ...]:
    return VISIBLE_LIFECYCLES if history else ("active",)


def _visible(supports: DataFrame, history: bool) -> DataFrame:
    return supports.filter(F.col("lifecycle").isin(*_lifecycles(history)))


def entity_status(graph: EntityGraph, history: bool = False) -> DataFrame:
    """Distinct visible entities, relations and memories of each region."""
    shown_entities, shown_relations = _visible(graph.memory_entities, history), _visible(graph.memory_relations, history)

    def distinct_count(rows: DataFrame, col: str, out: str) -> DataFrame:
        return rows.select("region_id", col).distinct().groupBy("region_id").agg(F.count(F.lit(1)).alias(out))

    memories = shown_entities.select("region_id", "memory_id").unionByName(shown_relations.select("region_id", "memory_id"))
    return (
        distinct_count(shown_entities, "entity_id", "entities")
        .join(distinct_count(shown_relations, "relation_id", "relations"), "region_id", "full")
        .join(distinct_count(memories, "memory_id", "projected_memories"), "region_id", "full")
        .fillna(0)
    )


def _visible_relations(graph: EntityGraph, history: bool) -> DataFrame:
    newest = _visible(graph.memory_relations, history).groupBy("region_id", "relation_id").agg(
        F.max("updated_s").alias("newest_s")
    )
    return graph.relations.select(
        "region_id", "relation_id", "source_entity_id", "target_entity_id", "relation_type"
    ).join(newest, ["region_id", "relation_id"])


def _ends(relations: DataFrame) -> DataFrame:
    """Every relation once per distinct end, with the other end."""
    return relations.withColumn(
        "end",
        F.explode(
            F.array_distinct(
                F.array(
                    F.struct(F.col("source_entity_id").alias("entity_id"), F.col("target_entity_id").alias("other_id")),
                    F.struct(F.col("target_entity_id").alias("entity_id"), F.col("source_entity_id").alias("other_id")),
                )
            )
        ),
    ).select("region_id", "relation_id", "relation_type", "newest_s", "end.entity_id", "end.other_id")


def entity_standing(graph: EntityGraph, history: bool = False, relations: DataFrame | None = None) -> DataFrame:
    """Visible entities with degree (distinct visible relations) and latest support time."""
    recent = _visible(graph.memory_entities, history).groupBy("region_id", "entity_id").agg(
        F.max("updated_s").alias("updated_s")
    )
    degree = _ends(_visible_relations(graph, history) if relations is None else relations).groupBy("region_id", "entity_id").agg(
        F.count(F.lit(1)).alias("degree")
    )
    return (
        graph.entities.select("region_id", "entity_id", "entity_type", "canonical_name", "normalized_name")
        .join(recent, ["region_id", "entity_id"])
        .join(degree, ["region_id", "entity_id"], "left")
        .withColumn("degree", F.coalesce("degree", F.lit(0)))
    )


def standing_order() -> list[Column]:
    return [F.col("degree").desc(), F.col("updated_s").desc(), F.col("entity_type"), F.col("normalized_name"), F.col("entity_id")]


def rank_entities(graph: EntityGraph, history: bool = False, n: int = MAX_NODES) -> DataFrame:
    """Best ``n`` entities of each region by degree, recency, type, name and id."""
    return top_rows(entity_standing(graph, history), ["region_id"], standing_order(), n)


def seeds_by_memory(
    graph: EntityGraph, hits: DataFrame, history: bool = False, limit: int = MAX_NODES, entity_type: str | None = None
) -> DataFrame:
    """Seed entities of each query's memories (query_id, region_id, memory_id)."""
    entities = graph.entities if entity_type is None else graph.entities.filter(F.col("entity_type") == entity_type)
    found = (
        hits.select("query_id", "region_id", "memory_id")
        .join(_visible(graph.memory_entities, history).select("region_id", "memory_id", "entity_id"), ["region_id", "memory_id"])
        .select("query_id", "region_id", "entity_id")
        .distinct()
        .join(entities.select("region_id", "entity_id", "entity_type", "normalized_name"), ["region_id", "entity_id"])
    )
    return top_rows(
        found, ["query_id", "region_id"], [F.col("entity_type"), F.col("normalized_name"), F.col("entity_id")], limit, "seed_rank"
    ).select("query_id", "region_id", "entity_id", "seed_rank")


@dataclass(frozen=True)
class Neighborhood:
    """nodes, edges and per-query truncation flags of a bounded view."""

    nodes: DataFrame
    edges: DataFrame
    flags: DataFrame


def _inside(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations between two nodes of a query, once per row of the source.

    Each relation meets the queries of that end which fewer of them show, and the other end is looked up after that.
    """
    per_query = ["query_id", "region_id"]
    held = nodes.groupBy(*per_query, "entity_id").agg(F.count(F.lit(1)).alias("copies"))
    shown = held.groupBy("region_id", "entity_id").agg(F.count(F.lit(1)).alias("views"))

    def seen(end: str) -> DataFrame:
        return shown.select("region_id", F.col("entity_id").alias(f"{end}_entity_id"), F.col("views").alias(f"{end}_views"))

    by_source = F.col("source_views") <= F.col("target_views")
    ends = ["source_entity_id", "target_entity_id"]
    near = (
        relations.join(seen("source"), ["region_id", "source_entity_id"])
        .join(seen("target"), ["region_id", "target_entity_id"])
        .select(
            *relations.columns, by_source.alias("by_source"),
            F.when(by_source, F.col(ends[0])).otherwise(F.col(ends[1])).alias("entity_id"),
            F.when(by_source, F.col(ends[1])).otherwise(F.col(ends[0])).alias("other_id"),
        )
        .drop(*ends)
    )
    others = held.select(*per_query, F.col("entity_id").alias("other_id"), F.col("copies").alias("other_copies"))
    met = held.join(near, ["region_id", "entity_id"]).join(others, [*per_query, "other_id"])
    copies = F.when(F.col("by_source"), F.col("copies")).otherwise(F.col("other_copies"))
    return met.select(
        *per_query, F.when(F.col("by_source"), F.col("entity_id")).otherwise(F.col("other_id")).alias(ends[0]),
        F.when(F.col("by_source"), F.col("other_id")).otherwise(F.col("entity_id")).alias(ends[1]),
        "relation_id", "relation_type", "newest_s", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("copy"),
    ).drop("copy")


def neighborhood(
    graph: EntityGraph, seeds: DataFrame, hops: int = 1, limit: int = MAX_NODES, history: bool = False
) -> Neighborhood:
    """Bounded view around each query's seeds (query_id, region_id, entity_id, seed_rank).

    Each hop follows the newest relations of the frontier up to the edge budget plus one.
    Seeds come first, then the others by standing; edges are those between kept nodes. Visible relations,
    the seeds, the selection and the kept nodes and edges are each computed once and written as tables.
    """
    if hops not in (1, 2):
        raise ValueError("hops must be 1 or 2")
    limit = max(1, min(limit, MAX_NODES))
    edge_budget = min(MAX_EDGES, max(1, limit * 4))
    per_query = ["query_id", "region_id"]
    newest_first = [F.col("newest_s").desc(), F.col("relation_type"), F.col("relation_id")]
    relations = written(_visible_relations(graph, history), "visible-relations")
    ends = _ends(relations)
    seeds = written(seeds.filter(F.col("seed_rank") <= limit).select(*per_query, "entity_id", "seed_rank"), "seeds")
    selected = seeds.select(*per_query, "entity_id", F.col("seed_rank").cast("long").alias("seed_rank"))
    frontier = selected.select(*per_query, "entity_id")
    for _ in range(hops):
        touching = frontier.join(ends, ["region_id", "entity_id"])
        # A relation inside the frontier is met from both ends, which the dense rank counts as one.
        recency = F.dense_rank().over(Window.partitionBy(*per_query).orderBy(*newest_first))
        followed = touching.withColumn("n", recency).filter(F.col("n") <= edge_budget + 1)
        found = followed.select(*per_query, F.col("other_id").alias("entity_id")).distinct()
        frontier = found.join(selected, [*per_query, "entity_id"], "left_anti")
        grown = selected.unionByName(frontier.withColumn("seed_rank", F.lit(None).cast("long")))
        selected = top_rows(
            grown, per_query, [F.col("seed_rank").asc_nulls_last(), F.col("entity_id")], MAX_NODES * 2, "n"
        ).drop("n")
    selected = written(selected, "selected")
    standing = entity_standing(graph, history, relations)
    ordered = top_rows(
        selected.join(standing, ["region_id", "entity_id"]),
        per_query,
        [F.col("seed_rank").asc_nulls_last(), *standing_order()],
        limit + 1,
        "position",
    )
    ordered = written(ordered, "ordered")
    nodes = ordered.filter(F.col("position") <= limit).withColumn(
        "graph_state", F.when(F.col("seed_rank").isNotNull(), "direct").otherwise("background")
    )
    ranked = written(top_rows(_inside(nodes, relations), per_query, newest_first, edge_budget + 1, "position"), "ranked")
    flags = (
        seeds.select(*per_query).distinct()
        .join(ordered.groupBy(*per_query).agg(F.max("position").alias("n_nodes")), per_query, "left")
        .join(ranked.groupBy(*per_query).agg(F.max("position").alias("n_edges")), per_query, "left")
        .select(
            *per_query,
            (F.coalesce("n_nodes", F.lit(0)) > limit).alias("nodes_truncated"),
            (F.coalesce("n_edges", F.lit(0)) > edge_budget).alias("edges_truncated"),
        )
    )
    return Neighborhood(nodes, ranked.filter(F.col("position") <= edge_budget), flags)


def query_subgraph(
    graph: EntityGraph, hits: DataFrame, hops: int = 1, limit: int = MAX_NODES, history: bool = False
) -> tuple[Neighborhood, DataFrame]:
    """View around recall hits (query_id, region_id, memory_id, rank), and each hit's mapping.

    Nodes and edges are ``direct`` or ``query_expansion``; a hit is mapped, unmapped or
    truncated.
    """
    per_query = ["query_id", "region_id"]
    bounded = top_rows(hits, per_query, [F.col("rank"), F.col("memory_id")], MAX_NODES, "seed_no")
    view = neighborhood(graph, seeds_by_memory(graph, bounded, history, limit), hops, limit, history)
    nodes = view.nodes.withColumn(
        "graph_state", F.when(F.col("graph_state") == "direct", "direct").otherwise("query_expansion")
    )
    direct = nodes.filter(F.col("graph_state") == "direct").select(*per_query, "entity_id", F.lit(True).alias("is_direct"))
    supporting = (
        view.edges.select(*per_query, "relation_id")
        .join(_visible(graph.memory_relations, history).select("region_id", "relation_id", "memory_id", "updated_s"), ["region_id", "relation_id"])
    )
    newest = top_rows(
        supporting, [*per_query, "relation_id"], [F.col("updated_s").desc(), F.col("memory_id")], MAX_SUPPORTS, "n"
    )
    by_memory = (
        newest.join(hits.select(*per_query, "memory_id").distinct(), [*per_query, "memory_id"], "left_semi")
        .select(*per_query, "relation_id")
        .distinct()
        .withColumn("hit_edge", F.lit(True))
    )
    edges = (
        view.edges.join(by_memory, [*per_query, "relation_id"], "left")
        .join(direct.select(*per_query, F.col("entity_id").alias("source_entity_id"), F.col("is_direct").alias("s")), [*per_query, "source_entity_id"], "left")
        .join(direct.select(*per_query, F.col("entity_id").alias("target_entity_id"), F.col("is_direct").alias("t")), [*per_query, "target_entity_id"], "left")
        .withColumn(
            "graph_state",
            F.when(F.col("hit_edge") | (F.col("s") & F.col("t")), "direct").otherwise("query_expansion"),
        )
        .drop("hit_edge", "s", "t")
    )
    shown = _visible(graph.memory_entities, history).select("region_id", "memory_id", "entity_id")
    mapped = (
        bounded.select(*per_query, "memory_id")
        .join(shown, ["region_id", "memory_id"])
        .join(nodes.select(*per_query, "entity_id", F.lit(1).alias("kept")), [*per_query, "entity_id"], "left")
        .groupBy(*per_query, "memory_id")
        .agg(F.count("kept").alias("n_kept"))
    )
    mapping = (
        hits.select(*per_query, "memory_id").distinct()
        .join(bounded.select(*per_query, "memory_id", F.lit(True).alias("in_bounds")).distinct(), [*per_query, "memory_id"], "left")
        .join(mapped, [*per_query, "memory_id"], "left")
        .withColumn(
            "mapping",
            F.when(F.col("in_bounds").isNull(), "truncated")
            .when(F.col("n_kept") > 0, "mapped")
            .when(F.col("n_kept") == 0, "truncated")
            .otherwise("unmapped"),
        )
        .select(*per_query, "memory_id", "mapping")
    )
    return Neighborhood(nodes, edges, view.flags), mapping


def subgraph_report(view: Neighborhood, mapping: DataFrame) -> DataFrame:
    """Per query and region: mapping counts, truncation and its reasons."""
    counts = mapping.groupBy("query_id", "region_id").agg(
        *[F.count(F.when(F.col("mapping") == s, 1)).alias(f"{s}_memories") for s in ("mapped", "unmapped", "truncated")],
        F.count(F.lit(1)).alias("n_memories"),
    )
    joined = counts.join(view.flags, ["query_id", "region_id"], "left").fillna(False)
    cut = F.col("nodes_truncated") | F.col("edges_truncated")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("n_memories") > MAX_NODES, "direct_memory_seed_limit"),
            F.when(cut, "graph_node_or_edge_limit"),
            F.when(F.col("truncated_memories") > 0, "node_limit"),
        )
    )
    return joined.select(
        "query_id", "region_id", "mapped_memories", "unmapped_memories", "truncated_memories",
        (cut | (F.col("truncated_memories") > 0)).alias("truncated"),
        F.array_join(reasons, ", ").alias("truncation_reason"),
        ((F.col("mapped_memories") == 0) & (F.col("truncated_memories") == 0)).alias("no_mapped_entities"),
    )


def _page(rows: DataFrame, keys: list[str], limit: int, offset: int) -> DataFrame:
    """Memories ``offset`` to ``offset + limit`` of each key by id, with the total and more-flag."""
    limit = min(max(limit, 1), MAX_DETAIL_ROWS)
    # Rows are counted by their memories, so that both readers of the rows share one shuffle.
    total = F.count("memory_id") + F.count_if(F.col("memory_id").isNull())
    totals = rows.groupBy(*keys).agg(total.alias("supporting_memory_count"))
    ranked = top_rows(rows, keys, [F.col("memory_id")], offset + limit, "position").filter(F.col("position") > offset)
    return ranked.join(totals, keys).withColumn(
        "has_more", F.col("supporting_memory_count") > offset + limit
    )


def entity_detail(graph: EntityGraph, ids: DataFrame, limit: int = MAX_DETAIL_ROWS, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page of supporting memories, touching relations) of each (region_id, entity_id).

    Supports are the memories of the entity and of any relation that touches it.
    """
    keys = ["region_id", "entity_id"]
    # Written step by step, so that a step's shuffles are gone when the next one begins.
    wanted = written(ids.select(*keys).distinct().join(graph.entities.select(*keys), keys, "left_semi"), "wanted-entities")
    # A relation's memories are found before it is doubled for its two ends.
    held = graph.relations.select("region_id", "relation_id", "source_entity_id", "target_entity_id").join(
        graph.memory_relations.select("region_id", "relation_id", "memory_id"), ["region_id", "relation_id"]
    )
    ends = F.explode(F.array_distinct(F.array("source_entity_id", "target_entity_id"))).alias("entity_id")
    through = written(held.select("region_id", ends, "memory_id"), "supports-through-relations")
    supports = graph.memory_entities.select(*keys, "memory_id").unionByName(through).join(wanted, keys, "left_semi").distinct()
    page = written(_page(written(supports, "supports-of-entities"), keys, limit, offset), "page")
    touching = wanted.join(_ends(graph.relations.withColumn("newest_s", F.lit(0))), keys)
    relations = top_rows(
        touching, keys, [F.col("relation_type"), F.col("relation_id")], MAX_DETAIL_RELATIONS, "position"
    ).select(*keys, "relation_id", "relation_type", "other_id", "position")
    return page, relations


def relation_detail(graph: EntityGraph, ids: DataFrame, limit: int = MAX_DETAIL_ROWS, offset: int = 0) -> DataFrame:
    """Page of supporting memories of each (region_id, relation_id), with its two ends."""
    keys = ["region_id", "relation_id"]
    wanted = written(
        ids.select(*keys).distinct().join(graph.relations.select(*keys, "source_entity_id", "target_entity_id", "relation_type"), keys), "wanted-relations"
    )
    page = _page(graph.memory_relations.select(*keys, "memory_id").join(wanted.select(*keys), keys, "left_semi"), keys, limit, offset)
    return page.join(wanted, keys)


def memory_entities(graph: EntityGraph, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations each memory (region_id, memory_id) supports, ordered and capped."""
    keys = ["region_id", "memory_id"]
    wanted = written(ids.select(*keys).distinct(), "wanted-memories")

    def ordered(supports: DataFrame, described: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
        """Supports of the wanted memories by their descriptions. Memories meet last, where they are ordered too."""

        def of(part: Callable[[DataFrame], DataFrame]) -> DataFrame:
            named = part(supports.select(*keys, key)).join(described.select("region_id", key, *order), ["region_id", key])
            return top_rows(named.join(part(wanted), keys, "left_semi"), keys, [F.col(c) for c in [*order, key]], most, "position")

        return in_parts(of, supports.count(), keys, f"ordered-{key}")

    return (
        ordered(graph.memory_entities, graph.entities, "entity_id", ["entity_type", "normalized_name"], MAX_NODES),
        ordered(graph.memory_relations, graph.relations, "relation_id", ["relation_type"], MAX_EDGES),
    )


def display_state(supports: DataFrame, key: str, history: bool = True) -> DataFrame:
    """Lifecycle, display state and latest time from the newest 50 visible supports of each key."""
    newest = top_rows(
        _visible(supports, history), ["region_id", key], [F.col("updated_s").desc(), F.col("memory_id")], MAX_SUPPORTS, "n"
    )
    rolled = newest.groupBy("region_id", key).agg(
        F.bool_or(F.col("lifecycle") == "active").alias("any_active"),
        F.min_by("lifecycle", "n").alias("newest_lifecycle"),
        F.max("updated_s").alias("updated_s"),
        F.count(F.lit(1)).alias("n_supports"),
    )
    lifecycle = F.when(F.col("any_active"), "active").otherwise(F.col("newest_lifecycle"))
    return rolled.select(
        "region_id",
        key,
        lifecycle.alias("lifecycle"),
        F.when(lifecycle == "active", "current").otherwise("historical").alias("display_state"),
        "updated_s",
        "n_supports",
    )
