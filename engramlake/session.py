"""Session construction, shared scratch paths and lineage cuts."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


PART_ROWS = 10_000_000  # of a step that is done part by part
MOST_PARTS = 32


def build_session(app_name: str = "engramlake", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution, skew handling and UTC time."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only on a single machine that names none."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="engramlake-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, readable by every executor."""
    return f"{shared_dir(spark)}/engramlake/{label}-{uuid.uuid4().hex}"


@contextmanager
def releasing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a table written inside go when it is written, not with some later garbage collection of the driver."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table below the shared folder: packed tighter than a checkpoint, and of a size that Spark knows when it plans joins."""
    path = scratch_path(df.sparkSession, label)
    with releasing_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_parts(of: Callable[[Callable[[DataFrame], DataFrame]], DataFrame], n_rows: int, keys: list[str], label: str) -> DataFrame:
    """``of`` all rows, as a table: the rows of ``keys`` are taken by their hash, in parts of some ``PART_ROWS`` one after the other.

    ``of`` gets a function that takes its part of a table with these keys, and no key may need another one. Each part's shuffles are gone
    when the next one begins, so the disk that they take does not grow with the rows.
    """
    n = min(MOST_PARTS, max(1, math.ceil(n_rows / PART_ROWS)))
    if n == 1:
        return written(of(lambda rows: rows), label)
    parts = [of(lambda rows, i=i: rows.filter(F.pmod(F.xxhash64(*keys), F.lit(n)) == i)) for i in range(n)]
    spark, path = parts[0].sparkSession, scratch_path(parts[0].sparkSession, label)
    for part in parts:
        with releasing_shuffles(spark):
            part.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(parts[0].schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and fixes one version of the rows."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
