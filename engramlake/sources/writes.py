"""Keyed batch writes against a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WRITE_MODES = ("insert", "update", "upsert", "delete")


def apply_writes(
    target: DataFrame, batch: DataFrame, mode: str, keys: Sequence[str] = ("region_id", "id")
) -> tuple[DataFrame, DataFrame]:
    """New table contents and the batch rows that were refused.

    insert refuses existing keys, update refuses missing keys, delete is idempotent and upsert
    replaces. The batch has one row per key.
    """
    if mode not in WRITE_MODES:
        raise ValueError(f"unknown write mode: {mode}")
    on = list(keys)
    columns = target.columns
    present = batch.join(target.select(*on), on, "left_semi")
    absent = batch.join(target.select(*on), on, "left_anti")
    no_errors = batch.select(*on).limit(0).withColumn("error", F.lit(""))
    if mode == "insert":
        table = target.unionByName(absent.select(*columns))
        return table, present.select(*on).withColumn("error", F.lit("conflict"))
    kept = target.join(batch.select(*on), on, "left_anti")
    if mode == "update":
        return kept.unionByName(present.select(*columns)), absent.select(*on).withColumn("error", F.lit("not_found"))
    if mode == "upsert":
        return kept.unionByName(batch.select(*columns)), no_errors
    return kept, no_errors
