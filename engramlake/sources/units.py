"""Reading the unit table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("memory_type", T.StringType()),
        T.StructField("lifecycle", T.StringType()),
        T.StructField("supersedes", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("updated_s", T.LongType()),
        T.StructField("region_id", T.StringType()),
    ]
)


def read_units(spark: SparkSession, path: str, region_ids: list[str] | None = None) -> DataFrame:
    """Typed scan of the unit table; a region list prunes the partitions that are read."""
    units = spark.read.schema(UNIT_SCHEMA).parquet(path)
    return units if region_ids is None else units.filter(F.col("region_id").isin(region_ids))
