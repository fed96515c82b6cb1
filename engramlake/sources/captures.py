"""Parsing capture events and diverting malformed ones with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CONTENT_CHARS = 65_535
MAX_CONTENT_BYTES = 64 * 1024
MAX_ID_CHARS = 200
MAX_SESSION_CHARS = 256
MAX_CWD_CHARS = 4096
MAX_TOPIC_CHARS = 120

CAPTURE_FIELDS = ("event_id", "session_id", "turn_id", "event_kind", "content", "occurred_at", "cwd", "topic_id")
CAPTURE_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in CAPTURE_FIELDS])
CORRUPT = "_corrupt_record"
READ_SCHEMA = T.StructType([*CAPTURE_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])

# Fixed value: ISO-8601 date-time with a mandatory offset.
OFFSET_TIME_PATTERN = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})$"


def parse_instant(text: Column) -> Column:
    """Timestamp of an ISO text with offset; null when it has no offset or is not a real time."""
    return F.when(text.rlike(OFFSET_TIME_PATTERN), F.try_to_timestamp(text))


def _between(name: str, maximum: int) -> Column:
    return F.length(F.col(name)).between(1, maximum)


def reject_reason() -> Column:
    """First rule an event breaks, or null."""
    missing = F.lit(False)
    for name in CAPTURE_FIELDS[:-1]:
        missing = missing | F.col(name).isNull()
    ids_ok = _between("event_id", MAX_ID_CHARS) & _between("turn_id", MAX_ID_CHARS)
    return (
        F.when(F.col(CORRUPT).isNotNull(), "malformed")
        .when(missing, "missing_field")
        .when(~ids_ok | ~_between("session_id", MAX_SESSION_CHARS), "bad_identifier")
        .when(~F.col("event_kind").isin("user", "assistant"), "bad_kind")
        .when(
            ~_between("content", MAX_CONTENT_CHARS) | (F.octet_length("content") > MAX_CONTENT_BYTES), "bad_content_size"
        )
        .when(~_between("cwd", MAX_CWD_CHARS) | ~F.col("cwd").startswith("/"), "bad_cwd")
        .when(F.length("topic_id") > MAX_TOPIC_CHARS, "bad_topic")
        .when(parse_instant(F.col("occurred_at")).isNull(), "bad_time")
    )


def split_captures(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid events with a parsed instant, and rejects with their reason."""
    judged = parsed.withColumn("reason", reject_reason())
    valid = judged.filter(F.col("reason").isNull()).select(
        *CAPTURE_FIELDS, parse_instant(F.col("occurred_at")).alias("instant")
    )
    return valid, judged.filter(F.col("reason").isNotNull())


def read_captures(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Read JSON lines of capture events as (valid, rejects)."""
    parsed = (
        spark.read.schema(READ_SCHEMA)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )
    return split_captures(parsed)
