"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Documents are partitioned by the power of two that holds their number of shingles, and every partition
has its own MinHash: shingle hashes fall into ``BINS_PER_SHINGLE`` bins per shingle of the
partition's upper size, and a bin keeps its smallest hash. The number of bins grows with the size,
so a short test item shows in a long document with the same chance as in a short one: each of
its shared shingles is its bin's minimum with probability (1 - exp(-x)) / x, x = shingles per bin.
A candidate needs fewer matches than an item of the wanted containment misses
once in millions of times. Items too short for that bound are searched in the full set of shingles.
A text of one to four words is one shingle of all its words, on both sides and in the SQL twin: such an item is found
in a document of just these words, and not inside a longer one.
Candidates are verified on their whole sets. Only DataFrame functions run, on the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.functions.expr import bind
from engramlake.llm.store import keep

WIDTH = 5
CONTAINMENT = 80  # hundredths
BINS_PER_SHINGLE = 2
SURE_SHINGLES = 9
BROADCAST_ROWS = 2_000_000

_SPLIT = r"[\x20\x09-\x0D]+"


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text: runs without white space, A-Z lower-cased."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.filter(F.split(low, _SPLIT), lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_hashes(words: Column, width: int = WIDTH) -> Column:
    """Hashes of the shingles of an array of word hashes, with repeats; a short text is one shingle."""

    def of(w: Column) -> Column:
        size = F.size(w)
        long = F.transform(F.sequence(F.lit(0), size - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return F.when(size >= width, long).when(size > 0, F.array(F.xxhash64(w, size))).otherwise(F.array().cast("array<bigint>"))

    return bind(words, of)


def _sets(rows: DataFrame, key: str) -> DataFrame:
    hashes = F.sort_array(shingle_hashes(word_hashes(F.col("text").cast("string"))))
    return rows.select(F.col(key).cast("long").alias(key), hashes.alias("hashes"))


def _log_bins(n: Column) -> Column:
    """Base-2 logarithm of the bins of the size partition that holds ``n`` shingles."""
    return (F.ceil(F.log2(F.greatest(n, F.lit(1)))) + int(math.log2(BINS_PER_SHINGLE))).cast("int")


def sketches(documents: DataFrame, full: bool = False) -> DataFrame:
    """(doc_id, hash): the smallest hash of every bin, or all hashes where items are too short for bins."""

    def firsts(h: Column) -> Column:
        shift = F.lit(64) - _log_bins(F.size(h))
        part = (lambda x: x) if full else (lambda x: F.call_function("shiftrightunsigned", x, shift))
        # hashes are sorted as signed numbers, so equal leading bits stand together
        return F.filter(h, lambda x, i: (i == 0) | (part(x) != part(F.get(h, i - 1))))

    sets = _sets(documents, "doc_id")
    return sets.select("doc_id", F.explode(bind(F.col("hashes"), firsts)).alias("hash"))


def contaminated(documents: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, item_id, shared, item_shingles) for every document that contains 80 % of an item's shingles.

    ``documents`` has doc_id and text, ``items`` item_id and text. Null and wordless texts hold
    nothing and match nothing. Repeated rows and ids count once, with all texts of the id. A null id
    is passed over. Other columns are ignored. Empty tables give no rows.
    """
    docs = documents.select("doc_id", F.col(text).alias("text")).filter("doc_id is not null")
    item_sets = _sets(items.filter("item_id is not null"), "item_id").select("item_id", F.explode("hashes").alias("hash")).distinct()
    item_sets = keep(item_sets, "item-shingles")
    sizes = keep(item_sets.groupBy("item_id").agg(F.count("*").alias("item_shingles")), "item-sizes")
    facts = sizes.agg(F.min("item_shingles").alias("least"), F.sum("item_shingles").alias("rows")).first()
    if not facts.rows:
        return docs.select(F.col("doc_id").cast("long"), F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("shared"), F.lit(0).cast("long").alias("item_shingles")).limit(0)
    small = facts.rows <= BROADCAST_ROWS
    small_side = F.broadcast if small else (lambda df: df)
    full = facts.least < SURE_SHINGLES

    # the smallest share of its wanted shingles that an item shows in the bins
    load = 1 / BINS_PER_SHINGLE
    seen = 1.0 if full else (1 - math.exp(-load)) / load
    mean = F.col("item_shingles") * (CONTAINMENT / 100 * seen)
    needed = F.lit(1) if full else F.greatest(F.lit(1), F.floor(mean - 5 * F.sqrt(mean * (1 - seen)) - 1))
    matches = sketches(docs, full).join(small_side(item_sets), "hash").groupBy("doc_id", "item_id").agg(F.count("*").alias("matches"))
    candidates = matches.join(small_side(sizes), "item_id").filter(F.col("matches") >= needed).select("doc_id", "item_id")
    candidates = keep(candidates, "contamination-candidates")

    ids = candidates.select("doc_id").distinct()
    few = F.broadcast(ids) if candidates.count() <= BROADCAST_ROWS else ids
    whole = _sets(docs.join(few, "doc_id", "left_semi"), "doc_id").select("doc_id", F.explode("hashes").alias("hash"))
    whole = whole.join(small_side(item_sets), "hash").join(candidates, ["doc_id", "item_id"], "left_semi")
    shared = whole.distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("shared")).join(small_side(sizes), "item_id")
    return shared.filter(100 * F.col("shared") >= CONTAINMENT * F.col("item_shingles")).select("doc_id", "item_id", "shared", "item_shingles")
