"""Queries for captures, turns, rounds and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake.functions.hashing import set_fingerprint
from engramlake.operators import capture, regions
from engramlake.registry.core import query
from engramlake.registry.routing import ROUTED

NOW_S = 1767225600 + 40 * 86400


def sha_lane(expr: str, lane: int) -> str:
    return f"sum(CAST(concat('0x', substr({expr}, {1 + 15 * lane}, 15)) AS UBIGINT))"


def fingerprint_sql(expr: str) -> str:
    """The same set fingerprint in SQL."""
    return f"concat_ws(':', CAST(count(*) AS STRING), CAST({sha_lane(expr, 0)} AS STRING), CAST({sha_lane(expr, 1)} AS STRING))"


EVENT_SHA = "sha256(concat(event_id, chr(0), content, chr(0)))"
ROUNDS = f"""SELECT region_id, session_id, turn_id,
 arg_min(content, (occurred_s, event_id)) FILTER (WHERE event_kind = 'user') AS user_message,
 arg_max(content, (occurred_s, event_id)) FILTER (WHERE event_kind = 'assistant') AS assistant_final,
 count(*) AS n_events, count(*) FILTER (WHERE event_kind = 'user') AS n_user, count(*) FILTER (WHERE event_kind = 'assistant') AS n_assistant,
 min(occurred_s) AS started_s, max(occurred_s) AS received_s, {fingerprint_sql(EVENT_SHA)} AS fingerprint
 FROM {{routed}} GROUP BY region_id, session_id, turn_id"""


def routed_captures(t):
    routed, _ = regions.route_captures(t.captures, t.bindings, t.regions)
    return routed


@query(
    "cap1_event_identity",
    """SELECT event_id, sha256(concat(session_id, chr(0), event_kind, chr(0), turn_id, chr(0), content, chr(0))) AS event_key,
 sha256(concat(region_id, chr(0), session_id, chr(0), turn_id)) AS evolve_key FROM {routed}""",
    routed=ROUTED,
)
def _event_identity(t):
    return capture.event_identity(routed_captures(t)).select("event_id", "event_key", "evolve_key")


# Turn ids are removed from two thirds of the conversations; each reply is also repeated 30 minutes and 30 hours later.
OPEN_EVENTS = """SELECT event_id, session_id, CASE WHEN cwd LIKE '/work%' THEN turn_id END AS turn_id, event_kind, content, occurred_s, cwd FROM {captures}
 UNION ALL SELECT concat(event_id, '-again'), session_id, NULL, event_kind, content, occurred_s + 1800, cwd FROM {captures} WHERE event_kind = 'assistant'
 UNION ALL SELECT concat(event_id, '-late'), session_id, NULL, event_kind, content, occurred_s + 108000, cwd FROM {captures} WHERE event_kind = 'assistant'"""
TURN_STEPS = """SELECT *, concat('turn-', substr(sha256(concat(session_id, chr(0), cwd, chr(0), event_id, chr(0))), 1, 32)) AS fresh,
 sha256(content) AS body FROM {open_events} WHERE turn_id IS NULL"""
TURN_ACTIVE = """SELECT *, max(CASE WHEN event_kind = 'user' THEN (occurred_s, event_id, fresh) END) OVER (PARTITION BY session_id, cwd ORDER BY occurred_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS active FROM {steps}"""
TURN_DATED = """SELECT *, CASE WHEN event_kind = 'user' THEN fresh WHEN active IS NOT NULL AND occurred_s - active[1] <= 86400 THEN active[3] ELSE fresh END AS turn,
 lag(occurred_s) OVER (PARTITION BY session_id, cwd, event_kind, body ORDER BY occurred_s, event_id) AS prev_s FROM {active}"""
TURN_RUNS = """SELECT *, sum(CASE WHEN prev_s IS NULL OR occurred_s - prev_s > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, cwd, event_kind, body ORDER BY occurred_s, event_id) AS run FROM {dated}"""


@query(
    "cap2_assign_turns",
    """SELECT event_id, CASE WHEN event_kind = 'user' THEN turn ELSE first_value(turn) OVER (PARTITION BY session_id, cwd, event_kind, body, run ORDER BY occurred_s, event_id) END AS turn_id FROM {runs}
 UNION ALL SELECT event_id, turn_id FROM {open_events} WHERE turn_id IS NOT NULL""",
    open_events=OPEN_EVENTS,
    steps=TURN_STEPS,
    active=TURN_ACTIVE,
    dated=TURN_DATED,
    runs=TURN_RUNS,
)
def _assign_turns(t):
    return capture.assign_turns(t.sql(OPEN_EVENTS, "captures")).select("event_id", "turn_id")


DELIVERED = """SELECT seq, concat('e', CAST(seq % 7000 AS STRING), '-', target_id) AS event_id, concat(action, CAST(CASE WHEN seq % 50 = 0 THEN seq ELSE 0 END AS STRING)) AS content FROM {audit}
 UNION ALL SELECT seq + 1000000000, concat('e', CAST(seq % 7000 AS STRING), '-', target_id), concat(action, CAST(CASE WHEN seq % 50 = 0 THEN seq WHEN seq % 9 = 0 THEN 7 ELSE 0 END AS STRING)) FROM {audit}"""


@query(
    "cap3_dedup_events",
    """SELECT seq, event_id, CASE WHEN rn = 1 THEN 'event' WHEN content = first_content THEN 'duplicate' ELSE 'conflict' END AS outcome FROM (
 SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY seq) AS rn, first_value(content) OVER (PARTITION BY event_id ORDER BY seq) AS first_content FROM {delivered}) d""",
    delivered=DELIVERED,
)
def _dedup_events(t):
    parts = capture.dedup_events(t.sql(DELIVERED, "audit"))
    named = [p.select("seq", "event_id", F.lit(n).alias("outcome")) for p, n in zip(parts, ("event", "duplicate", "conflict"))]
    return named[0].unionByName(named[1]).unionByName(named[2])


WRITE_BATCH = """SELECT seq, target_space AS region_id, concat(target_id, '-', action) AS idempotency_key,
 CASE WHEN value > 40 THEN 'changed' ELSE action END AS payload_hash FROM {audit}"""
WRITE_LEDGER = """SELECT DISTINCT target_space AS region_id, concat(target_id, '-', action) AS idempotency_key, action AS payload_hash
 FROM {audit} WHERE action IN ('click', 'view')"""


@query(
    "cap4_idempotent_writes",
    """SELECT seq, CASE WHEN known IS NOT NULL THEN CASE WHEN known = payload_hash THEN 'replay' ELSE 'conflict' END
 WHEN rn = 1 THEN 'new' WHEN payload_hash = first_hash THEN 'replay' ELSE 'conflict' END AS outcome FROM (
 SELECT b.*, l.payload_hash AS known, row_number() OVER (PARTITION BY b.region_id, b.idempotency_key ORDER BY seq) AS rn,
 first_value(b.payload_hash) OVER (PARTITION BY b.region_id, b.idempotency_key ORDER BY seq) AS first_hash
 FROM {write_batch} b LEFT JOIN {ledger} l ON l.region_id = b.region_id AND l.idempotency_key = b.idempotency_key) x""",
    write_batch=WRITE_BATCH,
    ledger=WRITE_LEDGER,
)
def _idempotent_writes(t):
    return capture.idempotent_writes(t.sql(WRITE_BATCH, "audit"), t.sql(WRITE_LEDGER, "audit")).select("seq", "outcome")


@query("cap5_build_rounds", "SELECT * FROM {rounds}", routed=ROUTED, rounds=ROUNDS)
def _build_rounds(t):
    return capture.build_rounds(routed_captures(t))


# Recorded outcomes: every third complete session is recorded against an outdated fingerprint.
EVOLUTIONS = """SELECT region_id, session_id, turn_id,
 CASE WHEN started_s % 180 = 0 THEN 'outdated' ELSE fingerprint END AS fingerprint,
 CASE CAST((started_s / 60) % 4 AS INT) WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'skipped' ELSE 'completed' END AS outcome
 FROM {rounds} WHERE started_s % 240 <> 0"""


def evolutions(t, rounds):
    return rounds.filter(F.col("started_s") % 240 != 0).select(
        *capture.ROUND_KEYS,
        F.when(F.col("started_s") % 180 == 0, "outdated").otherwise(F.col("fingerprint")).alias("fingerprint"),
        F.element_at(
            F.array(*[F.lit(x) for x in ("completed", "failed", "skipped", "completed")]),
            ((F.col("started_s") / 60).cast("long") % 4 + 1).cast("int"),
        ).alias("outcome"),
    )


@query(
    "cap6_round_status",
    """SELECT r.region_id, r.session_id, r.turn_id, CASE WHEN n_user = 0 OR n_assistant = 0 THEN 'pending_completion'
 WHEN e.fingerprint IS NULL OR e.fingerprint <> r.fingerprint THEN 'pending_distillation' ELSE e.outcome END AS status
 FROM {rounds} r LEFT JOIN {evolutions} e ON e.region_id = r.region_id AND e.session_id = r.session_id AND e.turn_id = r.turn_id""",
    routed=ROUTED,
    rounds=ROUNDS,
    evolutions=EVOLUTIONS,
)
def _round_status(t):
    rounds = capture.build_rounds(routed_captures(t))
    return capture.round_status(rounds, evolutions(t, rounds)).select(*capture.ROUND_KEYS, "status")


@query(
    "cap7_consolidate",
    """SELECT region_id, session_id, turn_id, concat('User: ', user_message, chr(10), 'Assistant: ', assistant_final) AS content,
 sha256(concat(region_id, chr(0), session_id, chr(0), turn_id)) AS evolve_key FROM {rounds} r
 WHERE n_user > 0 AND n_assistant > 0 AND NOT EXISTS (SELECT 1 FROM {evolutions} e WHERE e.region_id = r.region_id AND e.session_id = r.session_id AND e.turn_id = r.turn_id AND e.fingerprint = r.fingerprint)""",
    routed=ROUTED,
    rounds=ROUNDS,
    evolutions=EVOLUTIONS,
)
def _consolidate(t):
    rounds = capture.build_rounds(routed_captures(t))
    return capture.consolidate(rounds, evolutions(t, rounds)).select(*capture.ROUND_KEYS, "content", "evolve_key")


POLICIES = """SELECT region_id, CASE WHEN kind = 'topic' THEN 0 ELSE 20 END AS inbox_days FROM {regions} WHERE kind <> 'user'"""
EXPIRED = f"""SELECT u.*, coalesce(p.inbox_days, 30) AS inbox_days, u.memory_type = 'capture' AND u.lifecycle = 'active'
 AND (coalesce(p.inbox_days, 30) = 0 OR u.updated_s < {NOW_S} - coalesce(p.inbox_days, 30) * 86400) AS expired
 FROM {{units}} u LEFT JOIN {{policies}} p ON p.region_id = u.region_id"""


@query(
    "cap8_retention_plan",
    """SELECT region_id, min(inbox_days) AS inbox_days, count(*) FILTER (WHERE expired) AS to_archive,
 count(*) FILTER (WHERE memory_type = 'capture' AND lifecycle = 'active' AND NOT expired) AS retained_captures,
 count(*) FILTER (WHERE memory_type = 'evolved' AND lifecycle = 'active') AS protected_evolved,
 count(*) FILTER (WHERE memory_type NOT IN ('capture', 'evolved') AND lifecycle = 'active') AS protected_formal FROM {expired} GROUP BY region_id""",
    policies=POLICIES,
    expired=EXPIRED,
)
def _retention_plan(t):
    return capture.retention_plan(t.units, t.sql(POLICIES, "regions"), NOW_S)


@query(
    "cap8_apply_retention",
    "SELECT id, CASE WHEN expired THEN 'archived' ELSE lifecycle END AS lifecycle FROM {expired}",
    policies=POLICIES,
    expired=EXPIRED,
)
def _apply_retention(t):
    return capture.apply_retention(t.units, t.sql(POLICIES, "regions"), NOW_S).select("id", "lifecycle")


SPOOL = """SELECT concat('f', CAST(seq AS STRING)) AS name, target_space, 1767225600 + seq * 60 AS modified_s,
 CAST(100 + floor(value * 100) AS BIGINT) AS size_bytes, seq % 997 = 0 AS pinned FROM {audit}"""


@query(
    "cap9_bounded_retention",
    """SELECT name, target_space FROM {spool} WHERE pinned UNION ALL SELECT s.name, s.target_space FROM (
 SELECT *, count(*) OVER w AS n, sum(size_bytes) OVER w AS b FROM {spool} WHERE NOT pinned AND (SELECT max(modified_s) FROM {spool}) - modified_s <= 604800
 WINDOW w AS (PARTITION BY target_space ORDER BY modified_s DESC, name DESC ROWS UNBOUNDED PRECEDING)) s
 LEFT JOIN (SELECT target_space, count(*) AS n, sum(size_bytes) AS b FROM {spool} WHERE pinned GROUP BY target_space) p ON p.target_space = s.target_space
 WHERE s.n + coalesce(p.n, 0) <= 256 AND s.b + coalesce(p.b, 0) <= 200000""",
    spool=SPOOL,
)
def _bounded_retention(t):
    spool = t.sql(SPOOL, "audit")
    now_s = spool.agg(F.max("modified_s").alias("m"))
    kept = capture.bounded_retention(spool, now_s.scalar(), max_bytes=200_000, keys=("target_space",))
    return kept.select("name", "target_space")
