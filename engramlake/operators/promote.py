"""Promotion of corroborated memories across regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.functions.claims import canonical_value, exclusive_dimension, plain_claim
from engramlake.functions.hashing import joined_digest
from engramlake.functions.sensitive import is_sensitive
from engramlake.operators.filters import FORMAL_TYPES

# Promotion categories and thresholds.
CATEGORIES = ("user", "topic", "project", "conflict", "sensitive", "retain")
EXPLICIT_CONFIDENCE = 0.90
MIN_SOURCE_REGIONS = 2
GROUP_KEYS = ("target_region_id", "claim_subject", "claim_value")


def promotion_candidates(
    units: DataFrame, regions: DataFrame, sources: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Active formal units of the chosen source regions (all by default), and refused sources."""
    formal = units.filter(F.col("memory_type").isin(*FORMAL_TYPES) & (F.col("lifecycle") == "active"))
    known = regions.select("region_id").distinct()
    if sources is None:
        chosen = known
        rejects = known.limit(0).withColumn("reason", F.lit(""))
    else:
        counted = sources.groupBy("region_id").agg(F.count(F.lit(1)).alias("n"))
        judged = counted.join(known.withColumn("known", F.lit(True)), "region_id", "left").withColumn(
            "reason", F.when(F.col("known").isNull(), "unknown region").when(F.col("n") > 1, "duplicate region")
        )
        chosen = judged.filter(F.col("reason").isNull()).select("region_id")
        rejects = judged.filter(F.col("reason").isNotNull()).select("region_id", "reason")
    return formal.join(chosen, "region_id", "left_semi"), rejects


def promotion_decisions(candidates: DataFrame, labels: DataFrame, regions: DataFrame) -> DataFrame:
    """Outcome of each candidate: promote, needs_evidence or skip with a reason, and its target.

    labels: unit_id, category, topic_id, confidence, explicit, project_statement,
    claim_subject, claim_value.
    """
    topics = regions.filter(F.col("kind") == "topic").select(
        F.col("region_id").alias("topic_id"), F.lit(True).alias("known_topic")
    )
    joined = candidates.join(labels.withColumnRenamed("unit_id", "id"), "id", "left").join(topics, "topic_id", "left")
    category = F.col("category")
    sensitive = (category == "sensitive") | is_sensitive(F.col("content"))
    reason = (
        F.when(category.isNull(), "not classified")
        .when(~category.isin(*CATEGORIES), "unknown category")
        .when(sensitive, "sensitive")
        .when(category == "conflict", "classified as conflict")
        .when(category == "retain", "retained")
        .when((category == "topic") & F.col("known_topic").isNull(), "unknown topic")
        .when((category == "project") & ~F.coalesce("project_statement", F.lit(False)), "no explicit project statement")
    )
    direct = F.col("explicit") & (F.col("confidence") >= EXPLICIT_CONFIDENCE)
    return (
        joined.withColumn("reason", reason)
        .withColumn(
            "outcome", F.when(F.col("reason").isNotNull(), "skip").when(direct, "promote").otherwise("needs_evidence")
        )
        .withColumn(
            "target_region_id",
            F.when(F.col("reason").isNull(), F.when(category == "user", "user").when(category == "topic", F.col("topic_id")).otherwise(F.col("region_id"))),
        )
        .withColumn("claim_subject", F.coalesce(F.nullif(plain_claim(F.col("claim_subject")), F.lit("")), plain_claim(F.col("content"))))
        .withColumn("claim_value", F.coalesce(canonical_value(F.col("claim_value")), F.lit("")))
        .drop("known_topic")
    )


def evidence_groups(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, sources): candidates of one claim and target, with their independent evidence.

    Independent means distinct source regions; the regions are counted from rows already
    reduced to one per region, so a very frequent claim is aggregated map-side first.
    """
    open_rows = decisions.filter(F.col("outcome") != "skip")
    per_region = open_rows.groupBy(*GROUP_KEYS, "region_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.col("outcome") == "promote").alias("explicit"),
        F.min("id").alias("first_id"),
        F.min_by("content", "id").alias("content"),
    )
    groups = per_region.groupBy(*GROUP_KEYS).agg(
        F.sum("n").alias("n_sources"),
        F.count(F.lit(1)).alias("n_regions"),
        F.max("explicit").alias("explicit"),
        F.min_by("content", "first_id").alias("content"),
    )
    kind = F.when(F.col("explicit"), "explicit").when(F.col("n_regions") >= MIN_SOURCE_REGIONS, "multi_source")
    sources = open_rows.select(*GROUP_KEYS, F.col("region_id").alias("source_region_id"), F.col("id").alias("source_unit_id"))
    return groups.withColumn("evidence_kind", kind).withColumn("supported", F.col("evidence_kind").isNotNull()), sources


def claim_conflicts(groups: DataFrame, existing: DataFrame) -> DataFrame:
    """Mark supported groups whose value excludes another one in the batch or in the target.

    existing: target_region_id, claim_subject, claim_value of active target units. Values of
    one exclusive dimension conflict when they differ; all others complement each other.
    """
    keys = ["target_region_id", "claim_subject", "dimension"]
    offered = groups.filter("supported").withColumn("dimension", exclusive_dimension(F.col("claim_value")))
    present = existing.select(
        "target_region_id", plain_claim(F.col("claim_subject")).alias("claim_subject"), canonical_value(F.col("claim_value")).alias("claim_value")
    ).withColumn("dimension", exclusive_dimension(F.col("claim_value")))
    values = (
        offered.select(*keys, "claim_value")
        .unionByName(present.select(*keys, "claim_value"))
        .filter(F.col("dimension").isNotNull())
        .groupBy(*keys)
        .agg((F.min("claim_value") != F.max("claim_value")).alias("conflict"))
    )
    return offered.join(values, keys, "left").withColumn("conflict", F.coalesce("conflict", F.lit(False))).drop("dimension")


def promotion_key(prefix: str = "") -> Column:
    return joined_digest(*[f"{prefix}{name}" for name in GROUP_KEYS])


def apply_promotions(
    judged: DataFrame, sources: DataFrame, records: DataFrame, units: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(actions, provenance) of the conflict-free groups.

    records: promotion_key and target_id of earlier promotions. A known key merges later
    sources into its target; a forgotten or missing target blocks the promotion; all else is
    created. Provenance has one row per target and source, only new pairs.
    """
    keyed = judged.filter(~F.col("conflict")).withColumn("promotion_key", promotion_key())
    targets = units.select(F.col("id").alias("target_id"), F.col("lifecycle").alias("target_lifecycle"))
    joined = keyed.join(records.select("promotion_key", "target_id"), "promotion_key", "left").join(targets, "target_id", "left")
    action = (
        F.when(F.col("target_id").isNull(), "create")
        .when(F.coalesce("target_lifecycle", F.lit("forgotten")) == "forgotten", "blocked")
        .otherwise("merge")
    )
    actions = joined.withColumn("action", action).withColumn(
        "target_id", F.coalesce("target_id", F.concat(F.lit("promoted:"), F.substring("promotion_key", 1, 32)))
    )
    known = units.select(F.col("id").alias("target_id"), F.explode("provenance").alias("source_unit_id"))
    provenance = (
        actions.filter(F.col("action") != "blocked")
        .select(*GROUP_KEYS, "target_id")
        .join(sources, list(GROUP_KEYS))
        .select("target_id", "source_region_id", "source_unit_id")
        .distinct()
        .join(known, ["target_id", "source_unit_id"], "left_anti")
    )
    return actions.select(*GROUP_KEYS, "promotion_key", "target_id", "action", "evidence_kind", "n_sources", "content"), provenance


def promotion_report(
    decisions: DataFrame, judged: DataFrame, groups: DataFrame, actions: DataFrame, audit: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(summary row, audit rows not written by an earlier run)."""
    counted = decisions.agg(
        F.count(F.lit(1)).alias("candidates"), F.count(F.when(F.col("outcome") == "skip", 1)).alias("skipped")
    )
    promoted = actions.agg(
        F.count(F.when(F.col("action").isin("create", "merge"), 1)).alias("promoted"),
        F.count(F.when(F.col("action") == "blocked", 1)).alias("failed"),
    )
    conflicts = judged.filter("conflict").select("target_region_id", "claim_subject").distinct().agg(
        F.count(F.lit(1)).alias("conflict_groups")
    )
    evidence = groups.agg(F.count(F.when(F.col("supported"), 1)).alias("evidence_groups"))
    parts = [
        df.withColumn("__row", F.lit(1)) for df in (counted, promoted, conflicts, evidence)
    ]
    summary = parts[0]
    for part in parts[1:]:
        summary = summary.join(part, "__row")
    events = (
        actions.filter(F.col("action").isin("create", "merge")).select(F.lit("promote").alias("action"), F.col("promotion_key").alias("target_id"))
        .unionByName(judged.filter("conflict").select(F.lit("conflict").alias("action"), promotion_key().alias("target_id")))
        .unionByName(
            decisions.filter(F.col("outcome") == "skip").select(
                F.when(F.col("reason") == "sensitive", "sensitive").otherwise("skip").alias("action"), F.col("id").alias("target_id")
            )
        )
        .distinct()
    )
    return summary.drop("__row"), events.join(audit.select("action", "target_id"), ["action", "target_id"], "left_anti")


def archive_promoted_sessions(units: DataFrame, promoted: DataFrame, regions: DataFrame) -> DataFrame:
    """Archive units of session regions that were promoted (source_unit_id)."""
    sessions = regions.filter(F.col("kind") == "session").select("region_id", F.lit(True).alias("in_session"))
    done = promoted.select(F.col("source_unit_id").alias("id")).distinct().withColumn("was_promoted", F.lit(True))
    return (
        units.join(sessions, "region_id", "left")
        .join(done, "id", "left")
        .withColumn(
            "lifecycle",
            F.when(F.col("in_session") & F.col("was_promoted") & (F.col("lifecycle") == "active"), "archived").otherwise(F.col("lifecycle")),
        )
        .drop("in_session", "was_promoted")
    )
