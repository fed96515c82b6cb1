"""Mutations, version lineages, forgetting, audit and listing."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.functions.hashing import joined_digest, keyed_digest
from engramlake.functions.windows import mark_first, top_rows
from engramlake.operators.filters import formal_visible
from engramlake.session import cut_lineage, scratch_path

MUTATIONS = ("supersede", "overwrite", "archive", "forget", "downweight", "purge")
SUMMARY_CHARS = 160
FEWEST_BUCKETS = 8
BUCKET_UNITS = 10_000  # units whose ancestors share a bucket's size


def revision_of(id_col: str = "id", version_col: str = "version", content_col: str = "content") -> Column:
    """Revision token that a mutation must name."""
    return joined_digest(id_col, F.col(version_col).cast("string"), content_col)


def apply_mutations(units: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units, audit, conflicts) after compare-and-set operations.

    units: region_id, id, content, lifecycle, version, supersedes, weight, updated_s.
    ops: op_seq, region_id, target_id, expected_revision, action, new_content, at_s. Of the valid
    operations on a target the earliest wins and later ones are conflicts; one that is refused for
    its own sake stands in nobody's way.
    """
    keys = ["region_id", "id"]
    current = units.select(
        *keys, F.lit(True).alias("found"), F.col("content").alias("before"), F.col("lifecycle").alias("was"),
        revision_of().alias("revision"), F.col("version").alias("old_version"),
    )
    judged = ops.withColumnRenamed("target_id", "id").join(current, keys, "left").withColumn(
        "reason",
        F.when(~F.col("action").isin(*MUTATIONS), "unknown action")
        .when(F.col("found").isNull(), "not found")
        .when(F.col("revision") != F.col("expected_revision"), "stale revision")
        .when((F.col("was") == "forgotten") & (F.col("action") != "purge"), "forgotten"),
    )
    judged = _earliest_of_valid(judged, keys, "concurrent operation")
    accepted = judged.filter(F.col("reason").isNull())
    new_id = F.concat(F.lit("unit:"), F.substring(joined_digest("region_id", "id", F.col("op_seq").cast("string")), 1, 32))
    applied = units.join(accepted.select(*keys, "action", "new_content", "at_s"), keys, "left")
    action = F.col("action")
    changed = (
        applied.filter(action.isNull() | (action != "purge"))
        .withColumns(
            {
                "content": F.when(action == "overwrite", F.col("new_content")).otherwise(F.col("content")),
                "version": F.col("version") + F.when(action == "overwrite", 1).otherwise(0),
                "lifecycle": F.when(action == "supersede", "superseded")
                .when(action == "archive", "archived")
                .when(action == "forget", "forgotten")
                .otherwise(F.col("lifecycle")),
                "weight": F.when(action == "downweight", F.col("weight") / 2).otherwise(F.col("weight")),
                "updated_s": F.coalesce("at_s", "updated_s"),
            }
        )
        .select(*units.columns)
    )
    created = accepted.filter(F.col("action") == "supersede").withColumns(
        {
            "supersedes": F.col("id"),
            "content": F.col("new_content"),
            "lifecycle": F.lit("active"),
            "version": F.col("old_version") + 1,
            "weight": F.lit(1.0),
            "updated_s": F.col("at_s"),
        }
    ).withColumn("id", new_id)
    carried = [c for c in units.columns if c not in created.columns]
    if carried:
        created = created.join(
            units.select("region_id", F.col("id").alias("supersedes"), *carried), ["region_id", "supersedes"], "left"
        )
    audit = accepted.select(
        "op_seq", "action", "region_id", F.col("id").alias("target_id"),
        F.when(F.col("action") == "supersede", new_id).alias("new_id"),
        "before",
        F.when(F.col("action").isin("supersede", "overwrite"), F.col("new_content")).alias("after"),
        F.col("at_s").alias("occurred_s"),
    )
    conflicts = judged.filter(F.col("reason").isNotNull()).select("op_seq", "region_id", F.col("id").alias("target_id"), "action", "reason")
    return changed.unionByName(created.select(*units.columns)), audit, conflicts


def _earliest_of_valid(judged: DataFrame, keys: list[str], reason: str) -> DataFrame:
    """``judged`` with ``reason`` for every row without one that is not the earliest such row of its key."""
    valid = mark_first(judged.filter(F.col("reason").isNull()), keys, "op_seq", "earliest")
    late = valid.withColumn("reason", F.when(~F.col("earliest"), reason)).drop("earliest")
    return late.unionByName(judged.filter(F.col("reason").isNotNull()))


def version_chains(units: DataFrame) -> DataFrame:
    """Lineage of every unit along ``supersedes``: lineage_id, position, latest_id and length.

    Units that lead into a cycle have no first version and are left out; ``version_cycles`` has them.
    """
    state, first = _roots(units)
    sound = state.join(first, F.col("root") == F.col("first_id"), "left_semi")
    lineages = sound.groupBy("root").agg(
        F.max_by("id", F.struct("steps", "id")).alias("latest_id"), F.count(F.lit(1)).alias("length")
    )
    return sound.join(lineages, "root").select(
        "id", F.col("root").alias("lineage_id"), (F.col("steps") + 1).alias("position"), "latest_id", "length"
    )


def version_cycles(units: DataFrame) -> DataFrame:
    """(id, reason) of units whose predecessors never reach a first version."""
    state, first = _roots(units)
    lost = state.join(first, F.col("root") == F.col("first_id"), "left_anti")
    return lost.select("id", F.lit("versions supersede each other in a cycle").alias("reason"))


def _roots(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, root, steps) along ``supersedes``, and the ids of first versions.

    Pointers to the predecessor are doubled until all reach the first version, so a lineage of
    n versions takes about log2(n) equi-joins on unique ids. Each round is checkpointed.
    """
    ids = units.select("id", F.col("supersedes").alias("previous"))
    known = ids.select(F.col("id").alias("previous"), F.lit(True).alias("known"))
    state = cut_lineage(
        ids.join(known, "previous", "left").select(
            "id",
            F.when(F.col("known"), F.col("previous")).otherwise(F.col("id")).alias("root"),
            F.when(F.col("known"), 1).otherwise(0).cast("long").alias("steps"),
        )
    )
    first = state.filter(F.col("id") == F.col("root")).filter("steps = 0").select(F.col("id").alias("first_id"))
    # n versions need at most log2(n) doublings; what still moves then runs round a cycle.
    for _ in range(state.count().bit_length() + 2):
        ahead = state.select(F.col("id").alias("root"), F.col("root").alias("next_root"), F.col("steps").alias("next_steps"))
        state = cut_lineage(
            state.join(ahead, "root").select(
                "id",
                F.col("next_root").alias("root"),
                (F.col("steps") + F.col("next_steps")).alias("steps"),
                (F.col("next_root") != F.col("root")).alias("moved"),
            )
        )
        if state.filter("moved").isEmpty():
            break
        state = state.drop("moved")
    return state.select("id", "root", "steps"), first


def restore_versions(units: DataFrame, ops: DataFrame, chains: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new versions, superseded ids, rejects): old content returns as a new linked version.

    ops: op_seq, region_id, current_id, restore_id, at_s. Both must belong to one lineage and
    the content must not be what is already active.
    """
    chain = version_chains(units) if chains is None else chains
    body = units.join(chain.select("id", "lineage_id", "latest_id"), "id").select(
        "id", "region_id", "content", "lifecycle", "version", "lineage_id", "latest_id"
    )
    old = body.select(
        "region_id", F.col("id").alias("restore_id"), F.col("content").alias("old_content"),
        F.col("lineage_id").alias("old_lineage"), "latest_id",
    )
    current = body.select("region_id", F.col("id").alias("current_id"), F.col("lineage_id").alias("current_lineage"))
    latest = body.select(
        F.col("id").alias("latest_id"), F.col("content").alias("latest_content"), F.col("lifecycle").alias("latest_lifecycle"),
        F.col("version").alias("latest_version"),
    )
    judged = (
        ops.join(old, ["region_id", "restore_id"], "left")
        .join(current, ["region_id", "current_id"], "left")
        .join(latest, "latest_id", "left")
    )
    judged = judged.withColumn(
        "reason",
        F.when(F.col("old_lineage").isNull() | F.col("current_lineage").isNull(), "not found")
        .when(F.col("old_lineage") != F.col("current_lineage"), "different lineage")
        .when((F.col("latest_lifecycle") == "active") & (F.col("latest_content") == F.col("old_content")), "already active"),
    )
    judged = _earliest_of_valid(judged, ["old_lineage"], "concurrent restore")
    accepted = judged.filter(F.col("reason").isNull())
    created = accepted.select(
        "region_id",
        F.concat(F.lit("unit:"), F.substring(joined_digest("region_id", "restore_id", F.col("op_seq").cast("string")), 1, 32)).alias("id"),
        F.col("old_content").alias("content"),
        F.lit("active").alias("lifecycle"),
        (F.col("latest_version") + 1).alias("version"),
        F.col("latest_id").alias("supersedes"),
        F.col("at_s").alias("updated_s"),
    )
    replaced = accepted.filter(F.col("latest_lifecycle") == "active").select("region_id", F.col("latest_id").alias("id"))
    return created, replaced, judged.filter(F.col("reason").isNotNull()).select("op_seq", "region_id", "restore_id", "reason")


def version_diff(units: DataFrame) -> DataFrame:
    """Removed and added lines between each version and its predecessor."""
    old = units.select(F.col("id").alias("supersedes"), F.split("content", "\n").alias("old_lines"))
    return (
        units.filter(F.col("supersedes").isNotNull())
        .join(old, "supersedes")
        .withColumn("new_lines", F.split("content", "\n"))
        .select(
            "id",
            "supersedes",
            F.array_except("old_lines", "new_lines").alias("removed"),
            F.array_except("new_lines", "old_lines").alias("added"),
        )
    )


def forgotten_list(units: DataFrame, audit: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """Forgotten units with the time of their latest forget and their lineage."""
    latest = audit.filter(F.col("action") == "forget").groupBy(F.col("target_id").alias("id")).agg(
        F.max("occurred_s").alias("deleted_s")
    )
    chain = version_chains(units) if chains is None else chains
    return (
        units.filter(F.col("lifecycle") == "forgotten")
        .select("region_id", "id", "memory_type")
        .join(latest, "id", "left")
        .join(chain.select("id", "lineage_id", "position", "length"), "id")
    )


def redact_history(audit: DataFrame, units: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """Blank the bodies of every event of a lineage that was forgotten; keep the rest of the row."""
    chain = (version_chains(units) if chains is None else chains).select("id", "lineage_id")
    gone = (
        units.filter(F.col("lifecycle") == "forgotten").select("id").join(chain, "id").select("lineage_id").distinct()
    )
    targets = chain.join(gone, "lineage_id", "left_semi").select(F.col("id").alias("target_id"), F.lit(True).alias("redacted"))
    joined = audit.join(targets, "target_id", "left").withColumn("redacted", F.coalesce("redacted", F.lit(False)))
    return joined.withColumns(
        {name: F.when(~F.col("redacted"), F.col(name)) for name in ("before", "after")}
    )


def content_tombstone(key: str, content: str | Column, source_range: str | Column) -> Column:
    """Keyed fingerprint of content within the range it came from."""
    text = F.col(content) if isinstance(content, str) else content
    scope = F.col(source_range) if isinstance(source_range, str) else source_range
    plain = F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))
    return keyed_digest(key, F.concat(scope, F.lit("\x00"), plain))


def block_forgotten(candidates: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """Candidates (source_range, content) whose content was not forgotten within that range."""
    marked = candidates.withColumn("tombstone", content_tombstone(key, "content", "source_range"))
    return marked.join(tombstones.select("tombstone").distinct(), "tombstone", "left_anti").drop("tombstone")


def audit_latest(
    audit: DataFrame, filters: Mapping[str, str], n: int = 100, lineage: DataFrame | None = None
) -> DataFrame:
    """Newest ``n`` events that match all filters; ``lineage`` (target_id) restricts the targets."""
    rows = audit
    for name, value in filters.items():
        if value:
            rows = rows.filter(F.col(name) == value)
    if lineage is not None:
        rows = rows.join(lineage.select("target_id"), "target_id", "left_semi")
    return rows.orderBy(F.col("seq").desc()).limit(max(1, n))


def list_memories(
    units: DataFrame,
    q: str | None = None,
    memory_type: str | None = None,
    lifecycle: str | None = None,
    limit: int = 50,
    cursors: DataFrame | None = None,
) -> DataFrame:
    """One page per region, newest first, with summary, source count and next cursor.

    ``cursors`` has region_id, cursor_s and cursor_id of the last row already shown.
    """
    limit = max(1, min(limit, 100))
    columns = [c for c in units.columns if c not in ("region_id", "id")]
    rows = formal_visible(units, lifecycle)
    if memory_type:
        rows = rows.filter(F.col("memory_type") == memory_type)
    if q and q.strip():
        rows = rows.filter(F.contains(F.lower("content"), F.lower(F.lit(q.strip()))))
    unique = rows.groupBy("region_id", "id").agg(F.max_by(F.struct(*columns), "updated_s").alias("row")).select(
        "region_id", "id", "row.*"
    )
    if cursors is not None:
        unique = unique.join(cursors, "region_id", "left").filter(
            F.col("cursor_s").isNull()
            | (F.col("updated_s") < F.col("cursor_s"))
            | ((F.col("updated_s") == F.col("cursor_s")) & (F.col("id") < F.col("cursor_id")))
        )
    page = top_rows(unique, ["region_id"], [F.col("updated_s").desc(), F.col("id").desc()], limit + 1)
    ends = page.groupBy("region_id").agg(
        (F.max("rank") > limit).alias("has_more"),
        F.max_by(F.concat_ws(":", F.col("updated_s").cast("string"), "id"), F.when(F.col("rank") <= limit, F.col("rank"))).alias("last"),
    )
    summary = F.when(F.length("content") > SUMMARY_CHARS, F.concat(F.substring("content", 1, SUMMARY_CHARS), F.lit("…"))).otherwise(
        F.col("content")
    )
    return page.filter(F.col("rank") <= limit).join(ends, "region_id").select(
        "region_id", "rank", "id", "memory_type", "lifecycle", "updated_s", summary.alias("summary"),
        F.size(F.coalesce("provenance", F.array())).alias("source_count"), "has_more",
        F.when(F.col("has_more"), F.col("last")).alias("next_cursor"),
    )


def memory_detail(units: DataFrame, captures: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per (memory, provenance entry) with its evidence body where it may be shown.

    captures: id, region_id, content, lifecycle of any unit that can be evidence.
    """
    wanted = units.join(ids.select("id").distinct(), "id", "left_semi").select(
        "id", "region_id", F.explode_outer("provenance").alias("evidence_id")
    )
    evidence = captures.select(
        F.col("id").alias("evidence_id"), F.col("region_id").alias("evidence_region_id"),
        F.col("content").alias("body"), F.col("lifecycle").alias("evidence_lifecycle"),
    )
    joined = wanted.join(evidence, "evidence_id", "left")
    redacted = F.coalesce(F.col("evidence_lifecycle") == "forgotten", F.lit(False))
    return joined.select(
        "id", "region_id", "evidence_id", "evidence_region_id",
        F.col("evidence_lifecycle").isNotNull().alias("resolved"),
        redacted.alias("redacted"),
        F.when(~redacted, F.col("body")).alias("body"),
    )


def _dealt(df: DataFrame, buckets: int, keys: list[str], path: str, name: str, by: str | None = None) -> DataFrame:
    """``df`` added to the table ``name`` in ``path``: one file a bucket of ``keys``, so joins on them do not shuffle it."""
    writer = df.write.mode("append").format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, *keys)
    (writer.partitionBy(by) if by else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def provenance_closure(units: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Every ancestor of each unit through provenance, with its smallest depth.

    All pairs found lie in one table by bucket of (id, ancestor_id): a round shuffles the pairs of the round before, to their
    ancestor's parents, and what they lead to, to its bucket, but never the pairs of all rounds.
    """
    spark, pair = units.sparkSession, ["id", "ancestor_id"]
    buckets = FEWEST_BUCKETS + units.count() // BUCKET_UNITS
    paths = {k: scratch_path(spark, k) for k in ("parents", "closure")}
    tables = {k: f"engramlake_{k}_{uuid.uuid4().hex}" for k in paths}
    linked = units.select("id", F.explode("provenance").alias("ancestor_id")).filter(F.col("id") != F.col("ancestor_id")).repartition(buckets, "id").distinct()
    try:
        parents = _dealt(linked, buckets, ["id"], paths["parents"], tables["parents"])
        step = parents.select(F.col("id").alias("ancestor_id"), F.col("ancestor_id").alias("next_id"))
        start = parents if ids is None else parents.join(ids.select("id"), "id", "left_semi")
        found, depth = start.repartition(buckets, *pair), 1
        while True:
            closure = _dealt(found.withColumn("depth", F.lit(depth)), buckets, pair, paths["closure"], tables["closure"], by="depth")
            frontier = closure.filter(F.col("depth") == depth).select(*pair)
            if frontier.isEmpty():
                break
            ahead = frontier.join(step, "ancestor_id").select("id", F.col("next_id").alias("ancestor_id")).filter(F.col("id") != F.col("ancestor_id"))
            found = ahead.repartition(buckets, *pair).distinct().join(closure.select(*pair), pair, "left_anti")
            depth += 1
        kind = closure.select(*pair, "depth").schema
    finally:
        for name in tables.values():
            spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files stay, as those of other intermediate tables
    return spark.read.schema(kind).parquet(paths["closure"])
