"""Region snapshots and Markdown export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGION_MARKER = "__emptied"


def replace_regions(df: DataFrame, path: str, rebuilt: DataFrame, region_col: str = "region_id") -> None:
    """Swap all rows of the rebuilt regions below ``path`` and leave other regions alone.

    Only partitions that get rows are replaced, so a region rebuilt to nothing receives one
    marker row. ``df`` must not read from ``path``. The swap is per partition.
    """
    emptied = rebuilt.select(region_col).distinct().join(df.select(region_col), region_col, "left_anti")
    marked = df.withColumn(REGION_MARKER, F.lit(False)).unionByName(
        emptied.withColumn(REGION_MARKER, F.lit(True)), allowMissingColumns=True
    )
    (
        marked.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(region_col)
        .parquet(path)
    )


def read_regions(spark, path: str) -> DataFrame:
    """Rows written by ``replace_regions`` without the markers."""
    return spark.read.parquet(path).filter(~F.col(REGION_MARKER)).drop(REGION_MARKER)


def markdown_blocks(units: DataFrame) -> DataFrame:
    """Header and unit blocks of each region's export, ordered by (region_id, position_key).

    A region may be arbitrarily large, so its document is a run of rows and never one value.
    """
    shown = units.filter(F.col("lifecycle").isin("active", "archived"))
    headers = units.select("region_id").distinct().select(
        "region_id",
        F.lit("").alias("position_key"),
        F.concat(F.lit("# Memory export: "), "region_id", F.lit("\n")).alias("block"),
    )
    bodies = shown.select(
        "region_id",
        F.col("id").alias("position_key"),
        F.concat(
            F.lit("## "), "id", F.lit("\n\n- Lifecycle: "), "lifecycle", F.lit("\n- Version: "),
            F.coalesce(F.col("version").cast("string"), F.lit("")), F.lit("\n- Source: "),
            F.coalesce("source", F.lit("")), F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n"),
        ).alias("block"),
    )
    return headers.unionByName(bodies)


def export_markdown(units: DataFrame, path: str) -> None:
    """Write each region's Markdown as ordered text files in its own folder."""
    (
        markdown_blocks(units)
        .repartitionByRange("region_id", "position_key")
        .sortWithinPartitions("region_id", "position_key")
        .select("region_id", F.col("block").alias("value"))
        .write.partitionBy("region_id")
        .text(path)
    )
