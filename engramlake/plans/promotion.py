"""One promotion run over the selected source regions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from engramlake.operators import promote
from engramlake.session import cut_lineage


@dataclass(frozen=True)
class PromotionRun:
    actions: DataFrame
    provenance: DataFrame
    summary: DataFrame
    audit: DataFrame
    units: DataFrame


def run_promotion(
    units: DataFrame,
    regions: DataFrame,
    labels: DataFrame,
    existing_claims: DataFrame,
    records: DataFrame,
    audit: DataFrame,
    sources: DataFrame | None = None,
) -> PromotionRun:
    """Decide, group evidence, find conflicts, apply, report, and archive promoted sessions."""
    candidates, _ = promote.promotion_candidates(units, regions, sources)
    decisions = cut_lineage(promote.promotion_decisions(candidates, labels, regions))
    groups, evidence = promote.evidence_groups(decisions)
    groups = cut_lineage(groups)
    judged = promote.claim_conflicts(groups, existing_claims)
    actions, provenance = promote.apply_promotions(judged, evidence, records, units)
    actions = cut_lineage(actions)
    summary, events = promote.promotion_report(decisions, judged, groups, actions, audit)
    promoted = actions.filter("action <> 'blocked'").select(*promote.GROUP_KEYS).join(evidence, list(promote.GROUP_KEYS))
    return PromotionRun(actions, provenance, summary, events, promote.archive_promoted_sessions(units, promoted, regions))
