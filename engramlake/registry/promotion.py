"""Queries for distillation and promotion."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake.functions.claims import CLAIM_PATTERN, EQUIVALENT_VALUES, EXCLUSIVE_DIMENSIONS
from engramlake.functions.gates import ONE_OFF_MARKERS, REQUEST, RULES, STANDING_MARKERS
from engramlake.operators import capture, distill, promote
from engramlake.operators.distill import PROJECT_SCOPE_PATTERN
from engramlake.registry.core import query
from engramlake.registry.rounds import ROUNDS, routed_captures
from engramlake.registry.routing import ROUTED
from engramlake.registry.screening import CTES as SCREENING


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def plain_sql(column: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({column}), '[.,;!?。，；！？]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def mapped_sql(table: dict[str, str], value: str, default: str) -> str:
    cases = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in table.items())
    return f"(CASE {value} {cases} ELSE {default} END)"


def canonical_sql(column: str) -> str:
    return mapped_sql(EQUIVALENT_VALUES, plain_sql(column), plain_sql(column))


def dimension_sql(value: str) -> str:
    return mapped_sql(EXCLUSIVE_DIMENSIONS, value, "NULL")


@query(
    "dst1_distill_requests",
    """SELECT region_id, session_id, turn_id, user_message, assistant_final, (SELECT string_agg(region_id, ',' ORDER BY region_id) FROM {regions} WHERE kind = 'topic') AS region_hints
 FROM {rounds} WHERE n_user > 0 AND n_assistant > 0""",
    routed=ROUTED,
    rounds=ROUNDS,
)
def _distill_requests(t):
    requests = distill.distill_requests(capture.build_rounds(routed_captures(t)), t.regions)
    parsed = F.from_json("context", "messages array<struct<role:string,content:string>>, region_hints array<string>")
    return requests.withColumn("c", parsed).select(
        *capture.ROUND_KEYS, F.col("c.messages")[0]["content"].alias("user_message"), F.col("c.messages")[1]["content"].alias("assistant_final"),
        F.array_join("c.region_hints", ",").alias("region_hints"),
    )


# One candidate per event: it cites its own event, with a sound or a broken field.
CANDIDATES = """SELECT region_id, session_id, turn_id, CASE WHEN k = 1 THEN concat(event_id, 'x') ELSE event_id END AS user_event_id, event_id AS candidate_id, content,
 CASE WHEN k = 2 THEN 'opinion' ELSE 'domain_fact' END AS memory_type, CASE WHEN k = 3 THEN 0.89 ELSE 0.9 END AS confidence,
 CASE WHEN k = 4 THEN 'temporary_plan' WHEN k <> 5 THEN 'durable_statement' END AS durability,
 CASE WHEN k = 6 THEN concat(substr(content, 1, 10), '~') WHEN k = 7 THEN '' ELSE substr(content, 3, 30) END AS evidence_snippet
 FROM (SELECT *, CAST((occurred_s / 60) % 9 AS INT) AS k FROM {routed}) v"""


@query(
    "dst2_check_candidates",
    """SELECT candidate_id, concat_ws('; ', CASE WHEN memory_type = 'opinion' THEN 'unknown memory type' END, CASE WHEN confidence < 0.9 THEN 'confidence below 0.90' END,
 CASE WHEN durability IS NULL THEN 'explicit durable classification is required' END, CASE WHEN durability = 'temporary_plan' THEN 'not marked durable' END,
 CASE WHEN e.event_kind IS NULL OR e.event_kind <> 'user' THEN 'evidence is not a user event of this round' END,
 CASE WHEN e.event_kind = 'user' AND (evidence_snippet = '' OR NOT contains(e.content, evidence_snippet)) THEN 'evidence is not verbatim' END,
 CASE WHEN j.disposition IS NOT NULL THEN 'sensitive' END) AS reasons
 FROM {cands} c LEFT JOIN {routed} e ON e.region_id = c.region_id AND e.session_id = c.session_id AND e.turn_id = c.turn_id AND e.event_id = c.user_event_id
 JOIN {judged} j ON j.doc_id = c.candidate_id""",
    routed=ROUTED,
    cands=CANDIDATES,
    **(SCREENING | {"scanned": "SELECT event_id AS doc_id, content AS text FROM {captures}"}),
)
def _check_candidates(t):
    routed = routed_captures(t)
    accepted, refused = distill.check_candidates(t.spark.sql(CANDIDATES, routed=routed), routed)
    return refused.select("candidate_id", F.array_join("reasons", "; ").alias("reasons")).unionByName(
        accepted.select("candidate_id", F.lit("").alias("reasons"))
    )


# Whole texts of all events behind a sentence, one for each rule and for each exception.
WORD = "regexp_extract(lower(content), '([a-z][a-z]+)', 1)"
SENTENCES = f"""SELECT candidate_id, w, k, CASE WHEN k IN (1, 2, 10) THEN 'preference' ELSE 'domain_fact' END AS memory_type,
 concat(CASE k WHEN 0 THEN concat('The ', w, ' service retries when it fails.') WHEN 1 THEN concat('The user prefers ', w, ' and concise answers.') WHEN 2 THEN concat('用户偏好', w, '和简洁回答。')
 WHEN 3 THEN concat('It requires ', w, ' audits.') WHEN 4 THEN concat('The user says it requires ', w, '.') WHEN 5 THEN concat('This project uses ', w, '.') WHEN 6 THEN concat('We will deploy ', w, ' tomorrow.')
 WHEN 7 THEN concat('Is ', w, ' supported?') WHEN 8 THEN concat('The ', w, ' mentioned above is required.') WHEN 9 THEN concat('The project supports ', w, ', Linux, and macOS.')
 WHEN 10 THEN concat('The user prefers ', w, ' mode.') WHEN 11 THEN '外部网络访问不使用代理' WHEN 12 THEN concat('The ', w, ' policy requires approval because this reduces risk.') ELSE concat('The API uses ', w, ' and requires caching.') END, ' ', whole) AS content,
 CASE WHEN k = 11 THEN '不用走代理' WHEN k = 12 THEN concat('please use ', whole) ELSE whole END AS evidence_snippet,
 concat(CASE WHEN k = 11 AND w < 'm' THEN '这次不用走代理 ' WHEN k = 11 THEN '不用走代理 ' WHEN k = 12 THEN 'please use ' ELSE '' END, whole) AS cited_text
 FROM (SELECT event_id AS candidate_id, coalesce(nullif({WORD}, ''), 'thing') AS w, coalesce(content, '') AS whole, CAST((occurred_s / 60) % 14 AS INT) AS k FROM {{captures}}) v"""


def gates_sql() -> str:
    reasons: dict[str, list[str]] = {}
    for rule in RULES:
        test = f"regexp_matches({rule.column}, {quoted(rule.pattern)})"
        if rule.only_type:
            test = f"({test} AND memory_type = {quoted(rule.only_type)})"
        reasons.setdefault(rule.reason, []).append(test)
    standing, one_off = f"regexp_matches(evidence_snippet, {quoted(STANDING_MARKERS)})", f"regexp_matches(cited_text, {quoted(ONE_OFF_MARKERS)})"
    reasons["one-off request"] = [f"(regexp_matches(evidence_snippet, {quoted(REQUEST)}) AND NOT {standing})", f"({standing} AND {one_off})"]
    cases = [f"CASE WHEN {' OR '.join(tests)} THEN {quoted(reason)} END" for reason, tests in sorted(reasons.items())]
    return f"SELECT candidate_id, concat_ws('; ', {', '.join(cases)}) AS reasons FROM {{sentences}}"


@query("dst3_language_gates", gates_sql(), sentences=SENTENCES)
def _language_gates(t):
    accepted, refused = distill.language_gates(t.sql(SENTENCES, "captures"))
    return refused.select("candidate_id", F.array_join(F.array_sort("reasons"), "; ").alias("reasons")).unionByName(
        accepted.select("candidate_id", F.lit("").alias("reasons"))
    )


CLAIM_ROWS = """SELECT candidate_id, content, memory_type, CASE WHEN k = 9 THEN concat('Platforms, ', w) END AS claim_subject, CASE WHEN k = 9 THEN 'Dark Mode.' END AS claim_value FROM {sentences}"""


@query(
    "dst4_claims",
    f"""SELECT candidate_id, CASE WHEN claim_subject IS NOT NULL THEN {plain_sql('claim_subject')} WHEN s <> '' THEN concat(s, ':', v, CASE WHEN v = 'prefers' AND contains(o, ' ') THEN concat(':', regexp_extract(o, '([^ ]*)$', 1)) ELSE '' END) END AS claim_subject,
 CASE WHEN claim_subject IS NOT NULL THEN {canonical_sql('claim_value')} WHEN s <> '' THEN {canonical_sql('o')} END AS claim_value FROM (
 SELECT *, regexp_extract(p, {quoted(CLAIM_PATTERN)}, 1) AS s, regexp_extract(p, {quoted(CLAIM_PATTERN)}, 2) AS v, regexp_extract(p, {quoted(CLAIM_PATTERN)}, 3) AS o FROM (SELECT *, {plain_sql('content')} AS p FROM {{claim_rows}}) a) b""",
    sentences=SENTENCES,
    claim_rows=CLAIM_ROWS,
)
def _claims(t):
    rows = t.spark.sql(CLAIM_ROWS, sentences=t.sql(SENTENCES, "captures"))
    found, missing = distill.claims(rows)
    return found.select("candidate_id", "claim_subject", "claim_value").unionByName(
        missing.select("candidate_id", "claim_subject", "claim_value")
    )


HINTED = """SELECT event_id AS candidate_id, region_id, region_kind, CASE WHEN occurred_s % 180 = 0 THEN 'project-1' END AS durable_region_id,
 CASE CAST((occurred_s / 60) % 5 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'source' WHEN 2 THEN 'user' WHEN 3 THEN 'topic-1' ELSE 'missing-topic' END AS region_hint,
 CASE WHEN occurred_s % 120 = 0 THEN 'preference' ELSE 'domain_fact' END AS memory_type, CASE WHEN occurred_s % 420 = 0 THEN concat('Project uses ', content) ELSE content END AS content FROM {routed}"""


@query(
    "dst5_route_candidates",
    f"""SELECT candidate_id, CASE WHEN hint = 'source' OR scoped THEN base WHEN hint = 'user' THEN CASE WHEN memory_type = 'domain_fact' THEN base ELSE 'user' END WHEN hint = 'missing-topic' THEN base
 WHEN memory_type = 'preference' THEN 'user' ELSE hint END AS target_region_id,
 CASE WHEN hint = 'source' THEN CASE WHEN region_kind = 'session' THEN 'ephemeral session was replaced by a durable region' END WHEN scoped THEN 'project-scoped content was retained in the source region'
 WHEN hint = 'user' THEN CASE WHEN memory_type = 'domain_fact' THEN 'a domain fact does not belong to the user region' END WHEN hint = 'missing-topic' THEN 'unknown topic missing-topic; retained in the source region'
 WHEN memory_type = 'preference' THEN 'a preference belongs to the user region, not to a topic' END AS fallback_reason FROM (
 SELECT *, coalesce(region_hint, 'source') AS hint, CASE WHEN region_kind = 'session' THEN coalesce(durable_region_id, 'user') ELSE region_id END AS base, regexp_matches(content, {quoted(PROJECT_SCOPE_PATTERN)}) AS scoped FROM {{hinted}}) h""",
    routed=ROUTED,
    hinted=HINTED,
)
def _route_candidates(t):
    rows = t.spark.sql(HINTED, routed=routed_captures(t))
    return distill.route_candidates(rows, t.regions).select("candidate_id", "target_region_id", "fallback_reason")


# Stored units and candidates with a claim each; the subject is the source, so some subjects are frequent.
CLAIM_VALUE = """CASE CAST(n % 8 AS INT) WHEN 0 THEN 'dark' WHEN 1 THEN 'Dark mode.' WHEN 2 THEN 'light' WHEN 3 THEN 'fast' WHEN 4 THEN 'memory-safe' WHEN 5 THEN 'pnpm' WHEN 6 THEN 'npm' ELSE 'enabled' END"""
STORED = f"""SELECT region_id, id, content, source AS claim_subject, {CLAIM_VALUE} AS claim_value FROM (SELECT *, updated_s AS n FROM {{units}} WHERE lifecycle = 'archived') u"""
OFFERED = f"""SELECT id AS candidate_id, CAST(substr(id, 2) AS BIGINT) AS seq, region_id, content, concat(source, CASE WHEN n % 3 = 0 THEN '' ELSE substr(id, 1, 3) END) AS claim_subject, {CLAIM_VALUE} AS claim_value, concat('src-', id) AS source_ref
 FROM (SELECT *, updated_s + 1 AS n FROM {{units}} WHERE lifecycle = 'active') u"""
KEYED = f"SELECT *, {plain_sql('content')} AS body, {canonical_sql('claim_value')} AS val, {dimension_sql(canonical_sql('claim_value'))} AS dim FROM "
MATCHED = """SELECT o.*, coalesce((SELECT min(id) FROM {stored_keyed} s WHERE s.region_id = o.region_id AND s.body = o.body), (SELECT min(id) FROM {stored_keyed} s WHERE s.region_id = o.region_id AND s.claim_subject = o.claim_subject AND s.val = o.val)) AS unit_id,
 EXISTS (SELECT 1 FROM {stored_keyed} s WHERE s.region_id = o.region_id AND s.claim_subject = o.claim_subject AND s.dim = o.dim AND s.val <> o.val) AS clash FROM {offered_keyed} o"""


@query(
    "dst6_reconcile",
    """SELECT candidate_id, CASE WHEN unit_id IS NOT NULL THEN 'reuse' WHEN clash OR (dim IS NOT NULL AND val <> first_value(val) OVER (PARTITION BY region_id, claim_subject, dim, unit_id IS NULL AND NOT clash ORDER BY seq)) THEN 'conflict' ELSE 'new' END AS outcome,
 unit_id FROM {matched}""",
    stored=STORED,
    offered=OFFERED,
    stored_keyed=KEYED + "{stored}",
    offered_keyed=KEYED + "{offered}",
    matched=MATCHED,
)
def _reconcile(t):
    offered = t.sql(OFFERED, "units").withColumn("provenance", F.array("source_ref"))
    decisions, _ = distill.reconcile(offered, t.sql(STORED, "units"))
    return decisions.select("candidate_id", "outcome", F.when(F.col("outcome") == "reuse", F.col("unit_id")).alias("unit_id"))


PUBLISHED = """SELECT region_id, session_id, turn_id, concat('m-', session_id, '-', turn_id, '-', CAST(g AS STRING)) AS id, CASE WHEN g = 1 THEN fingerprint ELSE 'older' END AS source_fingerprint,
 CASE WHEN started_s % 420 = 0 THEN 'manual' ELSE 'semantic' END AS origin, 'active' AS lifecycle FROM {rounds}, (SELECT 0 AS g UNION ALL SELECT 1) v"""


@query(
    "dst7_retire_stale",
    "SELECT id, CASE WHEN origin = 'semantic' AND source_fingerprint = 'older' THEN 'superseded' ELSE 'active' END AS lifecycle FROM {published}",
    routed=ROUTED,
    rounds=ROUNDS,
    published=PUBLISHED,
)
def _retire_stale(t):
    rounds = capture.build_rounds(routed_captures(t))
    published = rounds.withColumn("g", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        *capture.ROUND_KEYS,
        F.concat(F.lit("m-"), "session_id", F.lit("-"), "turn_id", F.lit("-"), F.col("g").cast("string")).alias("id"),
        F.when(F.col("g") == 1, F.col("fingerprint")).otherwise("older").alias("source_fingerprint"),
        F.when(F.col("started_s") % 420 == 0, "manual").otherwise("semantic").alias("origin"),
        F.lit("active").alias("lifecycle"),
    )
    history = rounds.select(*capture.ROUND_KEYS, "fingerprint", "received_s").unionByName(
        rounds.select(*capture.ROUND_KEYS, F.lit("older").alias("fingerprint"), (F.col("received_s") - 10).alias("received_s"))
    )
    return distill.retire_stale(published, history).select("id", "lifecycle")


SOURCES = "SELECT region_id FROM {regions} WHERE kind <> 'project' UNION ALL SELECT 'topic-1' UNION ALL SELECT 'nowhere'"


@query(
    "pro1_promotion_candidates",
    """SELECT 'candidate' AS kind, id AS row_key, region_id AS detail FROM {units} WHERE lifecycle = 'active' AND memory_type NOT IN ('capture', 'evolved') AND region_id IN (SELECT region_id FROM {regions} WHERE kind <> 'project' AND region_id <> 'topic-1')
 UNION ALL SELECT 'refused', 'topic-1', 'duplicate region' UNION ALL SELECT 'refused', 'nowhere', 'unknown region'""",
)
def _promotion_candidates(t):
    chosen, refused = promote.promotion_candidates(t.units, t.regions, t.sql(SOURCES, "regions"))
    return chosen.select(F.lit("candidate").alias("kind"), F.col("id").alias("row_key"), F.col("region_id").alias("detail")).unionByName(
        refused.select(F.lit("refused").alias("kind"), F.col("region_id").alias("row_key"), F.col("reason").alias("detail"))
    )


LABELS = f"""SELECT l.unit_id, CASE WHEN l.blocked THEN 'sensitive' ELSE CASE CAST(n % 9 AS INT) WHEN 0 THEN 'retain' WHEN 1 THEN 'conflict' WHEN 2 THEN 'project' WHEN 3 THEN 'project' WHEN 4 THEN 'topic' WHEN 5 THEN 'gossip' ELSE 'user' END END AS category,
 CASE WHEN n % 9 = 4 THEN concat('topic-', CAST(n % 12 AS STRING)) END AS topic_id, l.confidence, l.explicit, n % 9 = 3 AS project_statement, u.source AS claim_subject, {CLAIM_VALUE} AS claim_value
 FROM {{labels_dec}} l JOIN (SELECT *, CAST(substr(id, 2) AS BIGINT) AS n FROM {{units}}) u ON u.id = l.unit_id"""
DECISIONS = f"""SELECT u.id, u.region_id, u.content, l.explicit, l.confidence, {plain_sql('l.claim_subject')} AS claim_subject, {canonical_sql('l.claim_value')} AS claim_value,
 CASE WHEN l.category IS NULL THEN 'not classified' WHEN l.category = 'gossip' THEN 'unknown category' WHEN l.category = 'sensitive' OR j.disposition IS NOT NULL THEN 'sensitive' WHEN l.category = 'conflict' THEN 'classified as conflict'
 WHEN l.category = 'retain' THEN 'retained' WHEN l.category = 'topic' AND r.region_id IS NULL THEN 'unknown topic' WHEN l.category = 'project' AND NOT l.project_statement THEN 'no explicit project statement' END AS reason,
 CASE l.category WHEN 'user' THEN 'user' WHEN 'topic' THEN l.topic_id ELSE u.region_id END AS target FROM {{units}} u LEFT JOIN {{labels_tab}} l ON l.unit_id = u.id LEFT JOIN {{regions}} r ON r.region_id = l.topic_id AND r.kind = 'topic'
 JOIN {{judged}} j ON u.id = concat('u', CAST(j.doc_id AS STRING)) WHERE u.lifecycle = 'active' AND u.memory_type NOT IN ('capture', 'evolved')"""
OUTCOMES = """SELECT *, CASE WHEN reason IS NOT NULL THEN 'skip' WHEN explicit AND confidence >= 0.9 THEN 'promote' ELSE 'needs_evidence' END AS outcome, CASE WHEN reason IS NULL THEN target END AS target_region_id FROM {decided}"""
GROUPS = f"""SELECT target_region_id, claim_subject, claim_value, {dimension_sql('claim_value')} AS dim, count(*) AS n_sources, count(DISTINCT region_id) AS n_regions,
 CASE WHEN max(CASE WHEN outcome = 'promote' THEN 1 ELSE 0 END) = 1 THEN 'explicit' WHEN count(DISTINCT region_id) >= 2 THEN 'multi_source' END AS evidence_kind FROM {{outcomes}} WHERE outcome <> 'skip' GROUP BY 1, 2, 3, 4"""
EXISTING = f"""SELECT region_id AS target_region_id, source AS claim_subject, {CLAIM_VALUE} AS claim_value FROM (SELECT *, updated_s AS n FROM {{units}} WHERE lifecycle = 'archived' AND memory_type = 'preference') u"""
EXISTING_KEYED = f"SELECT target_region_id, {plain_sql('claim_subject')} AS claim_subject, {canonical_sql('claim_value')} AS val, {dimension_sql(canonical_sql('claim_value'))} AS dim FROM {{existing}}"
CONFLICTED = """SELECT g.*, dim IS NOT NULL AND (EXISTS (SELECT 1 FROM {claim_groups} o WHERE o.evidence_kind IS NOT NULL AND o.target_region_id = g.target_region_id AND o.claim_subject = g.claim_subject AND o.dim = g.dim AND o.claim_value <> g.claim_value)
 OR EXISTS (SELECT 1 FROM {existing_keyed} e WHERE e.target_region_id = g.target_region_id AND e.claim_subject = g.claim_subject AND e.dim = g.dim AND e.val <> g.claim_value)
 OR (SELECT count(DISTINCT e.val) FROM {existing_keyed} e WHERE e.target_region_id = g.target_region_id AND e.claim_subject = g.claim_subject AND e.dim = g.dim) > 1) AS conflict FROM {claim_groups} g WHERE evidence_kind IS NOT NULL"""
PKEY = "sha256(concat(target_region_id, chr(0), claim_subject, chr(0), claim_value))"
RECORDS = f"""SELECT {PKEY} AS promotion_key, concat('u', CAST(n_sources AS STRING)) AS target_id FROM {{conflicted}} WHERE NOT conflict AND n_sources % 2 = 0"""
ACTIONS = f"""SELECT k.*, CASE WHEN r.target_id IS NULL THEN 'create' WHEN coalesce(u.lifecycle, 'forgotten') = 'forgotten' THEN 'blocked' ELSE 'merge' END AS action, coalesce(r.target_id, concat('promoted:', substr(k.promotion_key, 1, 32))) AS target_id
 FROM (SELECT *, {PKEY} AS promotion_key FROM {{conflicted}} WHERE NOT conflict) k LEFT JOIN {{records}} r ON r.promotion_key = k.promotion_key LEFT JOIN {{units}} u ON u.id = r.target_id"""
PROMOTION = SCREENING | {
    "scanned": "SELECT doc_id, text FROM {documents}", "labels_tab": LABELS, "decided": DECISIONS, "outcomes": OUTCOMES, "claim_groups": GROUPS,
    "existing": EXISTING, "existing_keyed": EXISTING_KEYED, "conflicted": CONFLICTED, "records": RECORDS, "actions": ACTIONS,
}


def decisions_of(t):
    """Candidates of every region that holds units; the region table of the fixtures is smaller."""
    holding = t.units.select("region_id").distinct()
    candidates, _ = promote.promotion_candidates(t.units, holding)
    return promote.promotion_decisions(candidates, t.sql(LABELS, "labels_dec", "units"), t.regions)


def judged_of(t):
    groups, sources = promote.evidence_groups(decisions_of(t))
    return promote.claim_conflicts(groups, t.sql(EXISTING, "units")), groups, sources


def actions_of(t):
    judged, groups, sources = judged_of(t)
    records = judged.filter(~F.col("conflict") & (F.col("n_sources") % 2 == 0)).select(
        promote.promotion_key().alias("promotion_key"), F.concat(F.lit("u"), F.col("n_sources").cast("string")).alias("target_id")
    )
    units = t.units.withColumn("provenance", F.array(F.concat(F.lit("u"), F.lit("1"))))
    actions, provenance = promote.apply_promotions(judged, sources, records, units)
    return actions, provenance, judged, groups


@query(
    "pro2_promotion_decisions",
    "SELECT id, outcome, reason, target_region_id FROM {outcomes}",
    **PROMOTION,
)
def _promotion_decisions(t):
    return decisions_of(t).select("id", "outcome", "reason", "target_region_id")


@query(
    "pro3_evidence_groups",
    "SELECT target_region_id, claim_subject, claim_value, n_sources, n_regions, evidence_kind FROM {claim_groups}",
    **PROMOTION,
)
def _evidence_groups(t):
    groups, _ = promote.evidence_groups(decisions_of(t))
    return groups.select(*promote.GROUP_KEYS, "n_sources", "n_regions", "evidence_kind")


@query(
    "pro4_claim_conflicts",
    "SELECT target_region_id, claim_subject, claim_value, conflict FROM {conflicted}",
    **PROMOTION,
)
def _claim_conflicts(t):
    return judged_of(t)[0].select(*promote.GROUP_KEYS, "conflict")


@query(
    "pro5_apply_promotions",
    """SELECT 'action' AS kind, target_id, action AS detail, claim_subject AS subject FROM {actions}
 UNION ALL SELECT DISTINCT 'source', a.target_id, o.id, '' FROM {actions} a JOIN {outcomes} o ON o.outcome <> 'skip' AND o.target_region_id = a.target_region_id AND o.claim_subject = a.claim_subject AND o.claim_value = a.claim_value
 WHERE a.action <> 'blocked' AND NOT (o.id = 'u1' AND a.target_id IN (SELECT id FROM {units}))""",
    **PROMOTION,
)
def _apply_promotions(t):
    actions, provenance, _, _ = actions_of(t)
    return actions.select(F.lit("action").alias("kind"), "target_id", F.col("action").alias("detail"), F.col("claim_subject").alias("subject")).unionByName(
        provenance.select(F.lit("source").alias("kind"), "target_id", F.col("source_unit_id").alias("detail"), F.lit("").alias("subject"))
    )


@query(
    "pro6_promotion_report",
    """SELECT (SELECT count(*) FROM {outcomes}) AS candidates, (SELECT count(*) FROM {outcomes} WHERE outcome = 'skip') AS skipped, (SELECT count(*) FROM {actions} WHERE action <> 'blocked') AS promoted,
 (SELECT count(*) FROM {actions} WHERE action = 'blocked') AS failed, (SELECT count(*) FROM (SELECT DISTINCT target_region_id, claim_subject FROM {conflicted} WHERE conflict) c) AS conflict_groups,
 (SELECT count(*) FROM {claim_groups} WHERE evidence_kind IS NOT NULL) AS evidence_groups""",
    **PROMOTION,
)
def _promotion_report(t):
    actions, _, judged, groups = actions_of(t)
    decisions = decisions_of(t)
    audit = decisions.limit(0).select(F.lit("").alias("action"), F.lit("").alias("target_id"))
    return promote.promotion_report(decisions, judged, groups, actions, audit)[0]


@query(
    "pro6_promotion_audit",
    """SELECT 'promote' AS action, promotion_key AS target_id FROM {actions} WHERE action <> 'blocked' UNION SELECT 'conflict', """
    + PKEY
    + """ FROM {conflicted} WHERE conflict
 UNION SELECT CASE WHEN reason = 'sensitive' THEN 'sensitive' ELSE 'skip' END, id FROM {outcomes} WHERE outcome = 'skip' AND reason <> 'retained'""",
    **PROMOTION,
)
def _promotion_audit(t):
    """The retained rows were written by an earlier run."""
    actions, _, judged, groups = actions_of(t)
    decisions = decisions_of(t)
    audit = decisions.filter(F.col("reason") == "retained").select(F.lit("skip").alias("action"), F.col("id").alias("target_id"))
    return promote.promotion_report(decisions, judged, groups, actions, audit)[1]


@query(
    "pro7_archive_promoted_sessions",
    """SELECT u.id, CASE WHEN u.region_id LIKE 'topic-%' AND u.lifecycle = 'active' AND u.id IN (SELECT id FROM {outcomes} WHERE outcome = 'promote') THEN 'archived' ELSE u.lifecycle END AS lifecycle FROM {units} u""",
    **PROMOTION,
)
def _archive_promoted_sessions(t):
    """Topic regions stand in for session regions, which hold no documents."""
    sessions = t.units.select("region_id").distinct().withColumn(
        "kind", F.when(F.col("region_id").startswith("topic-"), "session").otherwise("project")
    )
    promoted = decisions_of(t).filter(F.col("outcome") == "promote").select(F.col("id").alias("source_unit_id"))
    return promote.archive_promoted_sessions(t.units, promoted, sessions).select("id", "lifecycle")
