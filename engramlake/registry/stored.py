"""Projections that many queries read: derived once per application and stored as tables.

The graph and the text index are stored tables in any deployment; queries read them back with
column pruning instead of deriving them again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.session import releasing_shuffles, scratch_path
from engramlake.sources.domain import Tables

_PATHS: dict[tuple[str, str, str], str] = {}
FILE_ROWS = 200_000


def data_version(t: Tables) -> str:
    """Names, sizes and times of the files below the data folder, as one number; no file is read."""
    files = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(t.path)
    return str(files.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)"))).first()[0])


def stored_at(t: Tables, name: str, write: Callable[[str], object]) -> str:
    """The folder ``name`` derived from this version of the data folder, filled by ``write`` on first use."""
    key = (t.spark.sparkContext.applicationId, f"{t.path}@{data_version(t)}", name)
    if key in _PATHS:
        try:
            t.spark.read.parquet(_PATHS[key])
            return _PATHS[key]
        except AnalysisException:  # the shared folder was cleaned
            del _PATHS[key]
    path = scratch_path(t.spark, name)
    with releasing_shuffles(t.spark):
        write(path)
    _PATHS[key] = path
    return path


def stored(t: Tables, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` derived from this version of the data folder, written on first use.

    Files are small in rows too: packed tightly, one split of a large file would give its task tens of millions of them.
    """
    def write(path: str) -> None:
        build().write.options(compression="zstd", maxRecordsPerFile=FILE_ROWS).parquet(path)

    return t.spark.read.parquet(stored_at(t, name, write))
