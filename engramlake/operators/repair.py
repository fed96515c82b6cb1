"""Index drift and repair."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.operators.retrieve import build_text_index

TASK_UNITS = 2_000  # whose postings one task counts


def find_drift(units: DataFrame, index_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids of active units without index rows, index ids without an active unit)."""
    active = units.filter(F.col("lifecycle") == "active").select("id")
    indexed = index_ids.select("id").distinct()
    return active.join(indexed, "id", "left_anti"), indexed.join(active, "id", "left_anti")


def dealt_units(units: DataFrame, n_units: int) -> DataFrame:
    """Units dealt out by id, some ``TASK_UNITS`` a task: their postings are counted where the text lies and met by id there."""
    return units.repartition(max(1, math.ceil(n_units / TASK_UNITS)), "id")


def repair_index(units: DataFrame, postings: DataFrame) -> DataFrame:
    """Postings with orphans removed and drifted units, and only those, indexed again."""
    missing, orphans = find_drift(units, postings.select("id"))
    rebuilt = build_text_index(dealt_units(units.join(missing, "id", "left_semi"), units.count())).postings
    return postings.join(orphans, "id", "left_anti").unionByName(rebuilt)
