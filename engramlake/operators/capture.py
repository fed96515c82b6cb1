"""Capture identity, turns, rounds, consolidation and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.functions.hashing import joined_digest, set_fingerprint, terminated_digest
from engramlake.functions.windows import carry_last, running_totals

# State lifetimes in seconds and default limits.
TURN_TTL_S = 24 * 3600
IDENTITY_TTL_S = 3600
SPOOL_TTL_S = 7 * 24 * 3600
MAX_SPOOL_ROWS = 256
MAX_SPOOL_BYTES = 4 * 1024 * 1024
DEFAULT_INBOX_DAYS = 30
DAY_S = 24 * 3600
ROUND_KEYS = ("region_id", "session_id", "turn_id")


def event_identity(df: DataFrame) -> DataFrame:
    """Add the stable event id and the key of the round the event belongs to."""
    return df.withColumn("event_key", terminated_digest("session_id", "event_kind", "turn_id", "content")).withColumn(
        "evolve_key", joined_digest("region_id", "session_id", "turn_id")
    )


def assign_turns(df: DataFrame) -> DataFrame:
    """Fill missing turn ids.

    A user event opens a turn. An assistant event joins the latest turn of its (session, cwd)
    within 24 hours. An assistant text repeated within an hour keeps the turn of the first of
    the run of repeats. Anything else opens its own turn.
    """
    given = df.filter(F.coalesce(F.trim("turn_id"), F.lit("")) != "")
    open_rows = df.filter(F.coalesce(F.trim("turn_id"), F.lit("")) == "")
    fresh = F.concat(F.lit("turn-"), F.substring(terminated_digest("session_id", "cwd", "event_id"), 1, 32))
    rows = open_rows.withColumn("__fresh", fresh).withColumn("__text", F.sha2("content", 256))
    is_user = F.col("event_kind") == "user"
    rows = carry_last(
        rows, ["session_id", "cwd"], "occurred_s", "event_id",
        F.when(is_user, F.struct(F.col("__fresh").alias("turn"), F.col("occurred_s").alias("at"))), "__active",
    )
    active = F.when(F.col("occurred_s") - F.col("__active.at") <= TURN_TTL_S, F.col("__active.turn"))
    rows = rows.withColumn("__asof", F.when(is_user, F.col("__fresh")).otherwise(F.coalesce(active, F.col("__fresh"))))
    users = rows.filter(is_user).withColumn("turn_id", F.col("__asof"))
    replies = carry_last(
        rows.filter(~is_user), ["session_id", "cwd", "__text"], "occurred_s", "event_id", F.col("occurred_s"),
        "__previous", inclusive=False,
    )
    starts = F.col("__previous").isNull() | (F.col("occurred_s") - F.col("__previous") > IDENTITY_TTL_S)
    replies = carry_last(
        replies, ["session_id", "cwd", "__text"], "occurred_s", "event_id", F.when(starts, F.col("__asof")), "__first"
    ).withColumn("turn_id", F.col("__first"))
    columns = df.columns
    return given.select(*columns).unionByName(users.select(*columns)).unionByName(replies.select(*columns))


def _classify(df: DataFrame, keys: list[str], content: str, order: str) -> DataFrame:
    firsts = df.groupBy(*keys).agg(
        F.min_by(F.struct(F.col(content).alias("content"), F.col(order).alias("order")), order).alias("__first")
    )
    joined = df.join(firsts, keys)
    same = F.col(content) == F.col("__first.content")
    return joined.withColumn(
        "outcome",
        F.when(F.col(order) == F.col("__first.order"), "first").when(same, "repeat").otherwise("conflict"),
    ).drop("__first")


def dedup_events(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, duplicates, conflicts): the earliest arrival of an event id decides.

    ``seq`` is the unique arrival number. The first arrival per id is pre-aggregated; the
    join back to the rows lets adaptive execution split an id with very many copies.
    """
    hashed = df.withColumn("__hash", F.sha2("content", 256))
    rows = _classify(hashed, ["event_id"], "__hash", "seq").drop("__hash")
    parts = [rows.filter(F.col("outcome") == name).drop("outcome") for name in ("first", "repeat", "conflict")]
    return parts[0], parts[1], parts[2]


def idempotent_writes(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """Label each write ``new``, ``replay`` or ``conflict`` by its (region, idempotency key).

    Both inputs have region_id, idempotency_key and payload_hash; the batch also has ``seq``.
    """
    keys = ["region_id", "idempotency_key"]
    known = ledger.select(*keys, F.col("payload_hash").alias("__known")).dropDuplicates(keys)
    rows = _classify(batch, keys, "payload_hash", "seq").join(known, keys, "left")
    against_ledger = F.when(F.col("payload_hash") == F.col("__known"), "replay").otherwise("conflict")
    in_batch = F.when(F.col("outcome") == "first", "new").when(F.col("outcome") == "repeat", "replay").otherwise("conflict")
    return rows.withColumn("outcome", F.when(F.col("__known").isNotNull(), against_ledger).otherwise(in_batch)).drop("__known")


def round_events(events: DataFrame) -> DataFrame:
    """Events of every round, one row each; sort by instant (unparsable last), turn and id to read them."""
    return events.select(*ROUND_KEYS, "event_id", "event_kind", "content", "occurred_s")


def build_rounds(events: DataFrame) -> DataFrame:
    """One row per (region, session, turn) with its messages, bounds and fingerprint.

    All aggregates merge map-side and keep a constant-size state, so a turn of any length is
    never gathered in one task; its events stay in ``round_events``.
    """
    user, assistant = F.col("event_kind") == "user", F.col("event_kind") == "assistant"
    position = F.struct(F.coalesce("occurred_s", F.lit(2**62)), "event_id")
    last_position = F.struct(F.coalesce("occurred_s", F.lit(-(2**62))), "event_id")
    return events.groupBy(*ROUND_KEYS).agg(
        F.min_by("content", F.when(user, position)).alias("user_message"),
        F.max_by("content", F.when(assistant, last_position)).alias("assistant_final"),
        F.count(F.lit(1)).alias("n_events"),
        F.count(F.when(user, 1)).alias("n_user"),
        F.count(F.when(assistant, 1)).alias("n_assistant"),
        F.min("occurred_s").alias("started_s"),
        F.max("occurred_s").alias("received_s"),
        set_fingerprint(terminated_digest("event_id", "content")).alias("fingerprint"),
    )


def round_status(rounds: DataFrame, evolutions: DataFrame) -> DataFrame:
    """Status of every round given the recorded (round, fingerprint, outcome) evolutions."""
    done = evolutions.select(*ROUND_KEYS, F.col("fingerprint").alias("__done"), "outcome")
    status = (
        F.when((F.col("n_user") == 0) | (F.col("n_assistant") == 0), "pending_completion")
        .when(F.col("__done").isNull() | (F.col("__done") != F.col("fingerprint")), "pending_distillation")
        .otherwise(F.col("outcome"))
    )
    return rounds.join(done, list(ROUND_KEYS), "left").withColumn("status", status).drop("__done", "outcome")


def consolidate(rounds: DataFrame, done: DataFrame) -> DataFrame:
    """Evolved text of every complete round that is new or has changed since ``done``."""
    complete = rounds.filter((F.col("n_user") > 0) & (F.col("n_assistant") > 0))
    pending = complete.join(done.select(*ROUND_KEYS, "fingerprint"), [*ROUND_KEYS, "fingerprint"], "left_anti")
    return pending.select(
        *ROUND_KEYS,
        "fingerprint",
        joined_digest(*ROUND_KEYS).alias("evolve_key"),
        F.concat(F.lit("User: "), "user_message", F.lit("\nAssistant: "), "assistant_final").alias("content"),
        F.lit("evolved").alias("memory_type"),
        "received_s",
    )


def _expired(now_s: int):
    days = F.coalesce("inbox_days", F.lit(DEFAULT_INBOX_DAYS))
    return (
        (F.col("memory_type") == "capture")
        & (F.col("lifecycle") == "active")
        & ((days == 0) | (F.col("updated_s") < now_s - days * DAY_S))
    )


def retention_plan(units: DataFrame, policies: DataFrame, now_s: int) -> DataFrame:
    """Per region: captures to archive, and what is protected."""
    joined = units.join(policies.select("region_id", "inbox_days"), "region_id", "left")
    protected = F.col("lifecycle") == "active"
    return joined.groupBy("region_id").agg(
        F.first(F.coalesce("inbox_days", F.lit(DEFAULT_INBOX_DAYS)), ignorenulls=True).alias("inbox_days"),
        F.count(F.when(_expired(now_s), 1)).alias("to_archive"),
        F.count(F.when((F.col("memory_type") == "capture") & protected & ~_expired(now_s), 1)).alias("retained_captures"),
        F.count(F.when((F.col("memory_type") == "evolved") & protected, 1)).alias("protected_evolved"),
        F.count(F.when(~F.col("memory_type").isin("capture", "evolved") & protected, 1)).alias("protected_formal"),
    )


def apply_retention(units: DataFrame, policies: DataFrame, now_s: int) -> DataFrame:
    """Archive expired captures; running it again changes nothing."""
    joined = units.join(policies.select("region_id", "inbox_days"), "region_id", "left")
    return joined.withColumn(
        "lifecycle", F.when(_expired(now_s), "archived").otherwise(F.col("lifecycle"))
    ).drop("inbox_days")


def bounded_retention(
    df: DataFrame,
    now_s: int,
    ttl_s: int = SPOOL_TTL_S,
    max_rows: int = MAX_SPOOL_ROWS,
    max_bytes: int = MAX_SPOOL_BYTES,
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """Rows that survive: unexpired, then the newest while both caps hold; pinned rows always.

    Needs modified_s, name, size_bytes and pinned. Pinned rows use up capacity first, which
    is what removing the oldest unpinned rows amounts to.
    """
    alive = df.filter(F.col("pinned") | (now_s - F.col("modified_s") <= ttl_s)).withColumn("__all", F.lit(0))
    group = [*keys, "__all"]
    pinned = alive.filter("pinned").groupBy(*group).agg(
        F.count(F.lit(1)).alias("__pinned_rows"), F.sum("size_bytes").alias("__pinned_bytes")
    )
    ranked = running_totals(
        alive.filter(~F.col("pinned")), group, "modified_s", "name",
        {"__rows": F.lit(1), "__bytes": F.col("size_bytes")}, descending=True,
    ).join(pinned, group, "left")
    fits = (F.col("__rows") + F.coalesce("__pinned_rows", F.lit(0)) <= max_rows) & (
        F.col("__bytes") + F.coalesce("__pinned_bytes", F.lit(0)) <= max_bytes
    )
    return ranked.filter(fits).select(*df.columns).unionByName(alive.filter("pinned").select(*df.columns))
