"""Full-text index in blocks: postings packed by term and block of units, bounds of their scores, and block skipping.

A block is a bounded number of units of one region, the same for all terms. One stored row holds the postings of a term in
a block beside the largest term frequency and the least length per occurrence there, from which no score can be above
``(k1 + 1) / (1 + k1 (1 - b) / most_tf + k1 b least_spread / avg_len)``. Rows are stored by folder of the term, so a search reads
the folders of its own terms. It first adds up the bounds, from the narrow columns alone, then scores each query's
``k`` most promising blocks, and last all blocks whose bound reaches the ``k``-th score found. What it leaves out can
not enter the first ``k``: the answer is that of ``bm25_search``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.functions.text import terms_of
from engramlake.functions.windows import top_rows
from engramlake.operators.retrieve import BM25_B, BM25_K1, TextIndex, block_scores, query_terms
from engramlake.session import scratch_path, written

BLOCK_UNITS = 64
FOLDER_UNITS = 20_000  # units whose postings share a folder's size
TASK_UNITS = 2_048  # units that one task counts and packs
FEWEST_FOLDERS, MOST_FOLDERS = 16, 4_096
EVERY_UNIT = ""  # the entry that lists all units of a block with their lengths; no term is empty
SLACK = 2e-6  # scores are compared after rounding to six places
SCHEMA = (
    "term string, region_id string, block string, n long, most_tf long, least_spread double, "
    "units array<struct<id: string, tf: long, doc_len: int>>, folder int"
)


def _folder(folders: int, term: Column | str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int").alias("folder")


@dataclass(frozen=True)
class BlockIndex:
    """blocks(term, region_id, block, n, most_tf, least_spread, units, folder) with ``folders`` folders."""

    blocks: DataFrame
    folders: int

    @property
    def text_index(self) -> TextIndex:
        """The same postings one by one, with document frequencies and statistics."""
        words = self.blocks.filter(F.col("term") != EVERY_UNIT)
        every = self.blocks.filter((F.col("folder") == _folder(self.folders, F.lit(EVERY_UNIT))) & (F.col("term") == EVERY_UNIT))
        return TextIndex(
            postings=words.select("term", "region_id", F.inline("units")),
            terms=words.groupBy("term").agg(F.sum("n").alias("df")),
            blocks=words.select("term", "region_id", "block", "units"),
            stats=every.select(F.explode("units.doc_len").alias("doc_len")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len")),
        )

    def of(self, terms: DataFrame) -> DataFrame:
        """The folders that hold ``terms``; at most ``folders`` numbers come to the driver."""
        wanted = [row.folder for row in terms.select(_folder(self.folders)).distinct().collect()]
        return self.blocks.filter(F.col("folder").isin(wanted))


def build_block_index(units: DataFrame, folder: str | None = None, folders: int | None = None, block_units: int = BLOCK_UNITS) -> BlockIndex:
    """Index ``units`` (id, content, and region_id where there are regions) below ``folder``; ids are unique.

    Texts are shuffled once by block, where their terms are counted, packed and written to the folder of their term without a further
    shuffle. A task takes some ``TASK_UNITS`` units, whatever their number. A unit without a text counts as a unit
    and not for the mean length, one without words counts for both; neither is found.
    """
    spark = units.sparkSession
    region = F.col("region_id") if "region_id" in units.columns else F.lit(None).cast("string")
    rows = units.select("id", "content", region.alias("region_id"))
    # Stored first, so that Spark sees how small it is and leaves the texts where they are.
    sizes = written(rows.groupBy("region_id").agg(F.ceil(F.count(F.lit(1)) / block_units).alias("parts")), "sizes")
    n_units = rows.count()
    if folders is None:
        folders = min(MOST_FOLDERS, max(FEWEST_FOLDERS, math.ceil(n_units / FOLDER_UNITS)))
    placed = rows.join(sizes.withColumnRenamed("region_id", "of_region"), F.col("region_id").eqNullSafe(F.col("of_region"))).select(
        "id", "content", "region_id", F.concat_ws("/", "region_id", F.pmod(F.xxhash64("id"), "parts")).alias("block")
    )
    tokenized = placed.repartition(max(1, math.ceil(n_units / TASK_UNITS)), "region_id", "block").select("id", "region_id", "block", terms_of(F.col("content")).alias("terms"))
    entries = F.concat(F.array(F.lit(EVERY_UNIT)), F.coalesce("terms", F.array().cast("array<string>")))
    counted = (
        tokenized.select("id", "region_id", "block", F.size("terms").alias("doc_len"), F.explode(entries).alias("term"))
        .groupBy("region_id", "block", "term", "id", "doc_len")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    packed = counted.groupBy("region_id", "block", "term").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("tf").alias("most_tf"),
        F.min(F.col("doc_len") / F.col("tf")).alias("least_spread"),
        F.collect_list(F.struct("id", "tf", "doc_len")).alias("units"),
    )
    folder = folder or scratch_path(spark, "block-index")
    columns = ["term", "region_id", "block", "n", "most_tf", "least_spread", "units", "folder"]
    laid = packed.withColumn("folder", _folder(folders)).select(*columns)
    laid.sortWithinPartitions("folder", "term", "block").write.option("compression", "zstd").partitionBy("folder").parquet(folder)
    return open_block_index(spark, folder, folders)


def open_block_index(spark: SparkSession, folder: str, folders: int) -> BlockIndex:
    return BlockIndex(spark.read.schema(SCHEMA).parquet(folder), folders)


def block_search(queries: DataFrame, index: BlockIndex, k: int, scopes: DataFrame | None = None) -> DataFrame:
    """Top ``k`` units per query with positive score: query_id, id, score, rank, as ``bm25_search`` gives them.

    With ``scopes`` (query_id, region_id) a query finds units of its regions only.
    """
    total, mean = index.text_index.stats.first()
    asked_terms = query_terms(queries).select("query_id", "term")
    read = index.of(asked_terms)
    frequency = read.select("term", "n").join(asked_terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weights = asked_terms.join(frequency, "term").select(
        "query_id", "term", F.log(1 + (F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
    )
    place = [] if scopes is None else ["region_id"]
    if scopes is not None:
        weights = weights.join(scopes.select("query_id", "region_id").distinct(), "query_id")
    weights = written(weights, "weights")
    mean = mean or 1.0
    most = (BM25_K1 + 1) / (1 + BM25_K1 * (1 - BM25_B) / F.col("most_tf") + BM25_K1 * BM25_B * F.col("least_spread") / mean)
    reach = written(
        read.drop("units").join(weights, ["term", *place]).groupBy("query_id", *place, "block").agg(F.sum(F.col("idf") * most).alias("reach")),
        "reach",
    )

    def best(blocks: DataFrame) -> DataFrame:
        asked = written(blocks.groupBy("block").agg(F.collect_set("query_id").alias("asked")), "asked")
        rows = read.select("term", *place, "block", "units").join(weights.select("term", *place).distinct(), ["term", *place], "left_semi")
        scored = block_scores(rows, weights, ["term", *place], total, mean, asked)
        return top_rows(scored, ["query_id"], [F.col("score").desc(), F.col("id")], k)

    first = best(top_rows(reach, ["query_id"], [F.col("reach").desc(), *place, F.col("block")], k))
    floors = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    left = reach.join(floors, "query_id", "left").filter(F.col("floor").isNull() | (F.col("reach") >= F.col("floor") - SLACK))
    return best(left)
