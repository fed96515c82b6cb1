"""Screening text: scan, withhold, and clean nested values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramlake.functions.hashing import keyed_digest
from engramlake.functions.sensitive import has_hedged_language, is_sensitive, sensitive_categories


def scan_sensitive(df: DataFrame, col: str) -> DataFrame:
    """Add ``disposition`` (discard, quarantine or null) and ``categories``."""
    confirmed = df.withColumn("__confirmed", F.coalesce(sensitive_categories(F.col(col)), F.array().cast("array<string>")))
    disposition = F.when(F.size("__confirmed") > 0, "discard").when(has_hedged_language(F.col(col)), "quarantine")
    return (
        confirmed.withColumn("disposition", disposition)
        .withColumn(
            "categories",
            F.when(F.col("disposition") == "quarantine", F.array(F.lit("sensitive-language"))).otherwise(
                F.col("__confirmed")
            ),
        )
        .drop("__confirmed")
    )


def withhold(df: DataFrame, col: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Replace sensitive text by a summary; one quarantine row per keyed content hash."""
    scanned = scan_sensitive(df, col)
    found = F.col("disposition").isNotNull()
    identity = F.when(found, keyed_digest(key, col))
    marked = scanned.withColumn("content_key", identity).withColumn(
        "__summary",
        F.concat(
            F.lit("Sensitive content withheld ("),
            F.array_join("categories", ", "),
            F.lit("); "),
            F.octet_length(col).cast("string"),
            F.lit(" bytes; fingerprint opaque:"),
            F.substring("content_key", 1, 16),
            F.lit("."),
        ),
    )
    clean = marked.withColumn(col, F.when(found, F.col("__summary")).otherwise(F.col(col))).drop("__summary")
    quarantine = (
        marked.filter(found)
        .select("content_key", "disposition", F.array_join("categories", ", ").alias("categories"),
                F.col("__summary").alias("summary"))
        .dropDuplicates(["content_key"])
    )
    return clean, quarantine


def sanitize_nested(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Remove sensitive strings from arrays and maps (keys too) and flag rows that lost any."""
    removed = F.lit(False)
    cleaned = {}
    for name in cols:
        kind = df.schema[name].dataType
        if isinstance(kind, T.ArrayType):
            kept = F.filter(name, lambda item: ~is_sensitive(item))
        elif isinstance(kind, T.MapType):
            kept = F.map_filter(name, lambda key, value: ~is_sensitive(key) & ~is_sensitive(value))
        else:
            kept = F.when(~is_sensitive(F.col(name)), F.col(name))
            removed = removed | (F.col(name).isNotNull() & kept.isNull())
            cleaned[name] = kept
            continue
        removed = removed | F.coalesce(F.size(kept) < F.size(name), F.lit(False))
        cleaned[name] = kept
    return df.withColumn("removed_sensitive", removed).withColumns(cleaned)
