"""From captured rounds to published memories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.hooks import Extractor, extract_memories, preference_extractor
from engramlake.operators import capture, distill
from engramlake.session import cut_lineage
from engramlake.sources.extractions import parse_extractions


def distill_rounds(
    events: DataFrame,
    done: DataFrame,
    regions: DataFrame,
    units: DataFrame,
    extractor: Extractor = preference_extractor,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decisions, provenance, diagnostics) of all pending complete rounds.

    events: routed captures with region_id and region_kind. done: recorded evolutions. units:
    active memories with their claims.
    """
    rounds = capture.build_rounds(events)
    pending = rounds.join(
        done.select(*capture.ROUND_KEYS, "fingerprint"), [*capture.ROUND_KEYS, "fingerprint"], "left_anti"
    )
    first_user = events.filter(F.col("event_kind") == "user").groupBy(*capture.ROUND_KEYS).agg(
        F.min_by("event_id", F.struct("occurred_s", "event_id")).alias("user_event"), F.first("region_kind").alias("region_kind")
    )
    requests = distill.distill_requests(pending, regions)
    parsed, broken = parse_extractions(extract_memories(requests, extractor), "raw", "memories")
    # The hook ran once; its answers are fixed before several checks read them.
    answers = cut_lineage(parsed.select(*capture.ROUND_KEYS, "fingerprint", F.posexplode("memories").alias("position", "m")))
    candidates = (
        answers.select(*capture.ROUND_KEYS, "fingerprint", "position", "m.*")
        .join(first_user, list(capture.ROUND_KEYS))
        .withColumn("user_event_id", F.coalesce(F.nullif("user_event_id", F.lit("")), "user_event"))
        .withColumn("durable_region_id", F.lit(None).cast("string"))
    )
    checked, unsound = distill.check_candidates(candidates, events)
    worded, gated = distill.language_gates(checked)
    claimed, unclaimed = distill.claims(worded)
    routed = distill.route_candidates(claimed, regions)
    offered = routed.select(
        F.sha2(F.concat_ws("\x00", *capture.ROUND_KEYS, F.col("position").cast("string")), 256).alias("candidate_id"),
        F.concat_ws(":", *capture.ROUND_KEYS, F.lpad(F.col("position").cast("string"), 3, "0")).alias("seq"),
        F.col("target_region_id").alias("region_id"),
        "content",
        "claim_subject",
        "claim_value",
        F.array("user_event_id").alias("provenance"),
    )
    decisions, provenance = distill.reconcile(cut_lineage(offered), units)
    keys = list(capture.ROUND_KEYS)
    diagnostics = (
        unsound.select(*keys, "content", F.array_join("reasons", "; ").alias("reason"))
        .unionByName(gated.select(*keys, "content", F.array_join("reasons", "; ").alias("reason")))
        .unionByName(unclaimed.select(*keys, "content", "reason"))
        .unionByName(broken.select(*keys, F.lit(None).cast("string").alias("content"), "reason"))
    )
    return decisions, provenance, diagnostics
