"""Keyed turn assembly over a stream of capture events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from engramlake.functions.hashing import LANE_HEX_DIGITS, terminated_digest

ROUND_TTL_MS = 24 * 3600 * 1000
KEYS = ("session_id", "turn_id")

ROUND_SCHEMA = T.StructType(
    [
        *[T.StructField(name, T.StringType()) for name in KEYS],
        T.StructField("user_message", T.StringType()),
        T.StructField("assistant_final", T.StringType()),
        T.StructField("n_user", T.LongType()),
        T.StructField("n_assistant", T.LongType()),
        T.StructField("started_s", T.LongType()),
        T.StructField("received_s", T.LongType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)
# Message texts with their positions, the two fingerprint sums, counts and bounds.
STATE_SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("user_message", "user_at", "assistant_final", "assistant_at", "lane0", "lane1")
    ]
    + [T.StructField(name, T.LongType()) for name in ("n_user", "n_assistant", "started_s", "received_s")]
)
_EMPTY = (None, None, None, None, "0", "0", 0, 0, None, None)


def assemble_round(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Fold new events into one constant-size summary per round and emit it.

    Events are never kept, so a turn of any length has the same state. A round that stays
    quiet for a day expires.
    """
    if state.hasTimedOut:
        state.remove()
        return
    user, user_at, reply, reply_at, lane0, lane1, n_user, n_reply, started, received = state.get if state.exists else _EMPTY
    lane0, lane1 = int(lane0), int(lane1)
    for batch in batches:
        position = batch["occurred_s"].map("{:020d}".format) + " " + batch["event_id"]
        users, replies = batch["event_kind"] == "user", batch["event_kind"] == "assistant"
        if users.any():
            first = position[users].idxmin()
            if user_at is None or position[first] < user_at:
                user, user_at = batch.at[first, "content"], position[first]
        if replies.any():
            last = position[replies].idxmax()
            if reply_at is None or position[last] > reply_at:
                reply, reply_at = batch.at[last, "content"], position[last]
        n_user, n_reply = n_user + int(users.sum()), n_reply + int(replies.sum())
        low, high = int(batch["occurred_s"].min()), int(batch["occurred_s"].max())
        started, received = low if started is None else min(started, low), high if received is None else max(received, high)
        for digest in batch["digest"]:
            lane0 += int(digest[:LANE_HEX_DIGITS], 16)
            lane1 += int(digest[LANE_HEX_DIGITS : 2 * LANE_HEX_DIGITS], 16)
    state.update((user, user_at, reply, reply_at, str(lane0), str(lane1), n_user, n_reply, started, received))
    state.setTimeoutDuration(ROUND_TTL_MS)
    yield pd.DataFrame(
        {
            "session_id": [key[0]],
            "turn_id": [key[1]],
            "user_message": [user],
            "assistant_final": [reply],
            "n_user": [n_user],
            "n_assistant": [n_reply],
            "started_s": [started],
            "received_s": [received],
            "fingerprint": [f"{n_user + n_reply}:{lane0}:{lane1}"],
            "status": ["pending_distillation" if n_user and n_reply else "pending_completion"],
        }
    )


def stream_rounds(events: DataFrame) -> DataFrame:
    """Updates of every round touched by a batch; a late event re-opens a completed round.

    Reads the stream of ingested events (already free of repeats): session_id, turn_id,
    event_id, event_kind, content and instant.
    """
    prepared = events.select(
        *KEYS, "event_id", "event_kind", "content", F.unix_seconds("instant").alias("occurred_s"),
        terminated_digest("event_id", "content").alias("digest"),
    )
    return prepared.groupBy(*KEYS).applyInPandasWithState(
        assemble_round, ROUND_SCHEMA, STATE_SCHEMA, "update", GroupStateTimeout.ProcessingTimeTimeout
    )
