"""Distillation around the extraction model: requests, checks, gates, routing, reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.functions.claims import CLAIM_PATTERN, canonical_value, exclusive_dimension, plain_claim
from engramlake.functions.expr import bind
from engramlake.functions.gates import ONE_OFF_MARKERS, REQUEST, RULES, STANDING_MARKERS, GateRule
from engramlake.functions.hashing import joined_digest
from engramlake.functions.sensitive import is_sensitive
from engramlake.operators.capture import ROUND_KEYS
from engramlake.operators.filters import FORMAL_TYPES

MIN_CONFIDENCE = 0.90
# Fixed value: wording that ties a statement to one project.
PROJECT_SCOPE_PATTERN = r"(?i)^\s*(this |the |our )?(project|repository|workspace|codebase)\b"


def distill_requests(rounds: DataFrame, regions: DataFrame) -> DataFrame:
    """JSON context of each complete round: ordered messages and the topics it may be routed to."""
    hints = regions.filter(F.col("kind") == "topic").agg(F.array_sort(F.collect_set("region_id")).alias("hints"))
    complete = rounds.filter((F.col("n_user") > 0) & (F.col("n_assistant") > 0))

    def message(role: str, col: str) -> Column:
        return F.struct(F.lit(role).alias("role"), F.col(col).alias("content"))

    return complete.withColumn("region_hints", hints.scalar()).select(
        *ROUND_KEYS,
        "fingerprint",
        F.to_json(
            F.struct(
                F.lit("semantic-distillation-v1").alias("schema"),
                F.array(message("user", "user_message"), message("assistant", "assistant_final")).alias("messages"),
                "region_hints",
            )
        ).alias("context"),
    )


def check_candidates(candidates: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, diagnostics): every candidate must be typed, confident, durable and evidenced.

    The cited event has to be a user event of the candidate's own round and contain the
    snippet word for word.
    """
    cited = events.select(
        *ROUND_KEYS, F.col("event_id").alias("user_event_id"), F.col("event_kind").alias("cited_kind"),
        F.col("content").alias("cited_text"),
    )
    joined = candidates.join(cited, [*ROUND_KEYS, "user_event_id"], "left")
    snippet = F.coalesce("evidence_snippet", F.lit(""))
    checks = [
        (~F.coalesce(F.col("memory_type").isin(*FORMAL_TYPES), F.lit(False)), "unknown memory type"),
        (~F.coalesce(F.col("confidence") >= MIN_CONFIDENCE, F.lit(False)), "confidence below 0.90"),
        (F.col("durability").isNull(), "explicit durable classification is required"),
        (F.col("durability") != "durable_statement", "not marked durable"),
        (F.coalesce("cited_kind", F.lit("")) != "user", "evidence is not a user event of this round"),
        ((F.col("cited_kind") == "user") & ((snippet == "") | ~F.contains("cited_text", snippet)), "evidence is not verbatim"),
        (is_sensitive(F.col("content")) | is_sensitive(F.col("evidence_snippet")), "sensitive"),
    ]
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(reason)) for bad, reason in checks]))
    judged = joined.withColumn("reasons", reasons).drop("cited_kind")
    return judged.filter(F.size("reasons") == 0).drop("reasons"), judged.filter(F.size("reasons") > 0)


def language_gates(candidates: DataFrame, rules: Sequence[GateRule] = RULES) -> tuple[DataFrame, DataFrame]:
    """(accepted, diagnostics) by the wording rules.

    A request is refused unless it states a standing rule; a one-off marker cancels that
    exception. Needs content, evidence_snippet, memory_type and cited_text.
    """
    hits = []
    for rule in rules:
        matched = F.coalesce(F.col(rule.column).rlike(rule.pattern), F.lit(False))
        if rule.only_type:
            matched = matched & (F.col("memory_type") == rule.only_type)
        hits.append(F.when(matched, F.lit(rule.reason)))
    one_off = F.coalesce(F.col("cited_text").rlike(ONE_OFF_MARKERS), F.lit(False))
    standing = F.coalesce(F.col("evidence_snippet").rlike(STANDING_MARKERS), F.lit(False))
    request = F.coalesce(F.col("evidence_snippet").rlike(REQUEST), F.lit(False))
    hits.append(F.when((request & ~standing) | (standing & one_off), F.lit("one-off request")))
    judged = candidates.withColumn("reasons", F.array_distinct(F.array_compact(F.array(*hits))))
    return judged.filter(F.size("reasons") == 0).drop("reasons"), judged.filter(F.size("reasons") > 0)


def claims(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normalized claim subject and value, derived from the sentence where absent.

    Preferences are told apart by the last word of their value, so that "dark mode" and
    "light mode" concern the same subject. Rows without any claim are rejected.
    """
    parts = bind(
        plain_claim(F.col("content")),
        lambda plain: F.struct(
            *[F.regexp_extract(plain, CLAIM_PATTERN, i).alias(n) for i, n in ((1, "subject"), (2, "verb"), (3, "value"))]
        ),
    )
    prepared = candidates.withColumns(
        {
            "__parts": parts,
            "__subject": plain_claim(F.coalesce("claim_subject", F.lit(""))),
            "__value": canonical_value(F.coalesce("claim_value", F.lit(""))),
        }
    )
    given = (F.col("__subject") != "") & (F.col("__value") != "")
    subject, verb, value = (F.col(f"__parts.{name}") for name in ("subject", "verb", "value"))
    aspect = F.when(
        (verb == "prefers") & F.contains(value, F.lit(" ")), F.concat(F.lit(":"), F.substring_index(value, " ", -1))
    ).otherwise("")
    judged = prepared.withColumns(
        {
            "claim_subject": F.when(given, F.col("__subject")).when(
                subject != "", F.concat(subject, F.lit(":"), verb, aspect)
            ),
            "claim_value": F.when(given, F.col("__value")).when(subject != "", canonical_value(value)),
        }
    ).drop("__parts", "__subject", "__value")
    return (
        judged.filter(F.col("claim_subject").isNotNull()),
        judged.filter(F.col("claim_subject").isNull()).withColumn("reason", F.lit("claim identity is missing")),
    )


def route_candidates(candidates: DataFrame, regions: DataFrame) -> DataFrame:
    """Add target_region_id and fallback_reason.

    Needs region_id, region_kind, durable_region_id, region_hint, memory_type and content.
    """
    topics = regions.filter(F.col("kind") == "topic").select(
        F.col("region_id").alias("region_hint"), F.lit(True).alias("known_topic")
    )
    hint = F.coalesce("region_hint", F.lit("source"))
    ephemeral = F.col("region_kind") == "session"
    base = F.when(ephemeral, F.coalesce("durable_region_id", F.lit("user"))).otherwise(F.col("region_id"))
    base_reason = F.when(ephemeral, "ephemeral session was replaced by a durable region")
    scoped = F.col("content").rlike(PROJECT_SCOPE_PATTERN)
    known = F.coalesce("known_topic", F.lit(False))
    fact_to_user = (hint == "user") & (F.col("memory_type") == "domain_fact")
    preference_to_topic = known & (F.col("memory_type") == "preference")
    target = (
        F.when(hint == "source", base)
        .when(scoped, base)
        .when(fact_to_user, base)
        .when(hint == "user", "user")
        .when(~known, base)
        .when(preference_to_topic, "user")
        .otherwise(hint)
    )
    reason = (
        F.when(hint == "source", base_reason)
        .when(scoped, "project-scoped content was retained in the source region")
        .when(fact_to_user, "a domain fact does not belong to the user region")
        .when(hint == "user", F.lit(None))
        .when(~known, F.concat(F.lit("unknown topic "), hint, F.lit("; retained in the source region")))
        .when(preference_to_topic, "a preference belongs to the user region, not to a topic")
    )
    return (
        candidates.join(topics, "region_hint", "left")
        .withColumns({"target_region_id": target, "fallback_reason": reason})
        .drop("known_topic")
    )


def reconcile(candidates: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions, provenance) of candidates against stored units and each other.

    candidates: candidate_id, seq, region_id, content, claim_subject, claim_value, provenance.
    units: region_id, id, content, claim_subject, claim_value (active ones). A decision is
    ``reuse`` (same body or equivalent claim), ``conflict`` (another exclusive value of the
    claim is held) or ``new``. Provenance has one row per unit and source. Both sides are
    reduced to one row per claim before they meet, so a frequent subject never fans out.
    """
    body = F.sha2(plain_claim(F.col("content")), 256)
    value = canonical_value(F.col("claim_value"))
    stored = units.select("region_id", "id", "claim_subject", value.alias("value"), body.alias("body"))
    rows = candidates.withColumns({"body": body, "value": value}).withColumn("dimension", exclusive_dimension(F.col("value")))
    same_body = stored.groupBy("region_id", "body").agg(F.min("id").alias("body_unit"))
    same_claim = stored.groupBy("region_id", "claim_subject", "value").agg(F.min("id").alias("claim_unit"))
    held = (
        stored.withColumn("dimension", exclusive_dimension(F.col("value")))
        .filter(F.col("dimension").isNotNull())
        .groupBy("region_id", "claim_subject", "dimension")
        .agg(F.min("value").alias("low"), F.max("value").alias("high"))
    )
    matched = (
        rows.join(same_body, ["region_id", "body"], "left")
        .join(same_claim, ["region_id", "claim_subject", "value"], "left")
        .join(held, ["region_id", "claim_subject", "dimension"], "left")
        .withColumn("unit_id", F.coalesce("body_unit", "claim_unit"))
        .withColumn(
            "outcome",
            F.when(F.col("unit_id").isNotNull(), "reuse")
            .when((F.col("low") != F.col("value")) | (F.col("high") != F.col("value")), "conflict")
            .otherwise("new"),
        )
    )
    fresh = matched.filter(F.col("outcome") == "new")
    first_value = fresh.filter(F.col("dimension").isNotNull()).groupBy("region_id", "claim_subject", "dimension").agg(
        F.min_by("value", "seq").alias("first_value")
    )
    fresh = fresh.join(first_value, ["region_id", "claim_subject", "dimension"], "left").withColumn(
        "outcome", F.when(F.col("first_value") != F.col("value"), "conflict").otherwise("new")
    )
    new_id = F.concat(
        F.lit("unit:"), F.substring(joined_digest("region_id", F.coalesce("claim_subject", F.lit("")), F.coalesce("value", "body")), 1, 32)
    )
    columns = ["candidate_id", "seq", "region_id", "outcome", "unit_id"]
    decisions = matched.filter(F.col("outcome") != "new").select(*columns).unionByName(
        fresh.withColumn("unit_id", F.when(F.col("outcome") == "new", new_id)).select(*columns)
    )
    provenance = (
        decisions.filter(F.col("unit_id").isNotNull())
        .join(candidates.select("candidate_id", F.explode("provenance").alias("source")), "candidate_id")
        .select("region_id", "unit_id", "source")
        .distinct()
    )
    return decisions, provenance


def retire_stale(units: DataFrame, rounds: DataFrame) -> DataFrame:
    """Supersede derived memories of an outdated round fingerprint; manual ones are untouched.

    units carry the round keys, ``source_fingerprint`` and ``origin``; rounds may hold several
    fingerprints per round with their received_s.
    """
    newest = rounds.groupBy(*ROUND_KEYS).agg(F.max_by("fingerprint", F.struct("received_s", "fingerprint")).alias("newest"))
    stale = (F.col("origin") == "semantic") & F.col("newest").isNotNull() & (F.col("source_fingerprint") != F.col("newest"))
    return (
        units.join(newest, list(ROUND_KEYS), "left")
        .withColumn("lifecycle", F.when(stale & (F.col("lifecycle") == "active"), "superseded").otherwise(F.col("lifecycle")))
        .drop("newest")
    )
