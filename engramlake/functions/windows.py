"""Ordered carry-forward and running totals that stay safe when one key is very large.

Each helper splits a key's timeline into fixed time buckets. Rows are ordered only inside a
bucket; what earlier buckets contribute comes from one small summary row per (key, bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = "__bucket"


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    seconds: str,
    tie: str,
    value: Column,
    out: str,
    *,
    inclusive: bool = True,
    bucket_seconds: int = 3600,
) -> DataFrame:
    """Latest non-null ``value`` at or before each row of its key, ordered by (seconds, tie)."""
    bucketed = df.withColumn("__value", value).withColumn(_BUCKET, F.floor(F.col(seconds) / bucket_seconds))
    order = F.struct(F.col(seconds), F.col(tie))
    summary = bucketed.groupBy(*keys, _BUCKET).agg(
        F.max_by("__value", F.when(F.col("__value").isNotNull(), order)).alias("__summary")
    )
    earlier = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(*keys, _BUCKET, F.last("__summary", ignorenulls=True).over(earlier).alias("__carried"))
    local = (
        Window.partitionBy(*keys, _BUCKET)
        .orderBy(seconds, tie)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    return (
        bucketed.join(carried, [*keys, _BUCKET], "left")
        .withColumn(out, F.coalesce(F.last("__value", ignorenulls=True).over(local), F.col("__carried")))
        .drop("__value", "__carried", _BUCKET)
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order_seconds: str,
    tie: str,
    totals: dict[str, Column],
    *,
    descending: bool = False,
    bucket_seconds: int = 3600,
) -> DataFrame:
    """Inclusive running sums per key, newest first when ``descending``."""
    bucketed = df.withColumn(_BUCKET, F.floor(F.col(order_seconds) / bucket_seconds))
    for name, expression in totals.items():
        bucketed = bucketed.withColumn(f"__v_{name}", expression)
    summary = bucketed.groupBy(*keys, _BUCKET).agg(
        *[F.sum(f"__v_{name}").alias(f"__s_{name}") for name in totals]
    )
    bucket_order = F.col(_BUCKET).desc() if descending else F.col(_BUCKET).asc()
    earlier = Window.partitionBy(*keys).orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = summary.select(
        *keys,
        _BUCKET,
        *[F.coalesce(F.sum(f"__s_{name}").over(earlier), F.lit(0)).alias(f"__o_{name}") for name in totals],
    )
    row_order = (
        [F.col(order_seconds).desc(), F.col(tie).desc()] if descending else [F.col(order_seconds), F.col(tie)]
    )
    local = Window.partitionBy(*keys, _BUCKET).orderBy(*row_order).rowsBetween(Window.unboundedPreceding, 0)
    joined = bucketed.join(offsets, [*keys, _BUCKET], "left")
    for name in totals:
        joined = joined.withColumn(name, F.sum(f"__v_{name}").over(local) + F.col(f"__o_{name}"))
    return joined.drop(_BUCKET, *[f"__v_{n}" for n in totals], *[f"__o_{n}" for n in totals])


def mark_first(df: DataFrame, keys: Sequence[str], order: str, flag: str) -> DataFrame:
    """Flag the row with the smallest ``order`` of each key.

    The minimum is pre-aggregated map-side and joined back on (keys, order), so a key with
    many copies is spread over tasks instead of being ranked in one.
    """
    firsts = df.groupBy(*keys).agg(F.min(order).alias(order)).withColumn(flag, F.lit(True))
    return df.join(firsts, [*keys, order], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """Top ``n`` rows per key; Spark cuts each key to ``n`` rows before and after the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
