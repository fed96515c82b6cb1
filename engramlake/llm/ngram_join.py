"""N-gram Jaccard join: grouped prefix join over five-word shingles.

Every text is a set of 64-bit shingle hashes. All sets are ordered by one global order, light shingles
first, and two sets of similarity 0.8 share a shingle within their prefixes under any such order.

1. Texts with the same prefix and size collapse into one group before anything is shuffled.
2. Prefix entries of groups meet by shingle; shingles of one group only are dropped.
3. Group pairs are filtered by size and by position, expanded, and verified on the whole texts.

Links are wanted as classes, so a shingle's groups are first compared with a few leaders; after
that only groups that are still in different classes are compared with each other, and only within
the sizes that the position of their shingle leaves open. A shingle that thousands of near copies share
therefore costs a number of pairs linear in its groups, and so does one that thousands of unlike texts
share behind rarer ones. Unlike texts that begin with one shingle in the order and have about one size
meet each other: their pairs are dealt out over tasks.

The order only steers cost: shingles that repeat inside a batch of some thousand texts count as
heavy and stand last. At most ``HEAVY`` of them are sent to the tasks (8 bytes each); any choice
gives the same links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm.shingles import SLICE_BYTES, mix, shingle_sets, slices
from engramlake.llm.store import components, keep, releasing

SIMILARITY = 80  # hundredths
HEAVY = 1 << 18
HEAVY_IN_BATCH = 2
LEADERS = 4
BATCH_SHINGLES = 1 << 21
BUCKET_ENTRIES = 1 << 20
PART_ROWS = 1 << 14  # documents of one shingle that a task holds against the others
LEVELS = 16  # size levels to a factor of e
_ENTRY = np.dtype([("s", "<u8"), ("g", "<u8"), ("n", "<i4"), ("pos", "<i4")])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for first, part in slices(batch.column("text"), SLICE_BYTES):
            yield batch.slice(first, len(part)), [s for _, s in shingle_sets(part)]


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that occur in several texts of one batch, with their counts there."""
    held: list[np.ndarray] = []

    def counted():
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= HEAVY_IN_BATCH
        return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], ["s", "n"])

    for _, sets in _batches(batches):
        held += sets
        if sum(map(len, held)) >= BATCH_SHINGLES:
            yield counted()
            held = []
    if held:
        yield counted()


class PrefixOrder:
    """The global order: light shingles by hash, then heavy ones by (frequency, hash)."""

    def __init__(self, heavy: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(heavy)
        self.heavy = heavy[order]
        rank = np.empty(len(heavy), np.int64)
        rank[np.lexsort((self.heavy, counts[order]))] = np.arange(len(heavy))
        self.rank = rank
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.heavy & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def prefix(self, shingles: np.ndarray) -> tuple[np.ndarray, int]:
        """(prefix of a sorted set, how many of its shingles are light)."""
        n = len(shingles)
        length = n - -(-SIMILARITY * n // 100) + 1 if n else 0
        places = np.flatnonzero(self.maybe[(shingles & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.searchsorted(self.heavy, shingles[places])
        sure = self.heavy[np.minimum(at, len(self.heavy) - 1)] == shingles[places] if len(self.heavy) else np.zeros(len(places), bool)
        places, at = places[sure], at[sure]
        light = np.delete(shingles, places)[:length]
        if len(light) == length:
            return light, length
        return np.concatenate([light, shingles[places][np.argsort(self.rank[at])][: length - len(light)]]), len(light)


def _group(prefix: np.ndarray, n: int) -> int:
    """64-bit key of (prefix, size)."""
    return int.from_bytes(hashlib.blake2b(prefix.tobytes() + n.to_bytes(8, "little"), digest_size=8).digest(), "little")


def _members(order: PrefixOrder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _batches(batches):
            groups = np.array([_group(order.prefix(s)[0], len(s)) if len(s) else 0 for s in sets], np.uint64)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(groups.view(np.int64)), pa.array(digests, pa.binary())],
                ["doc_id", "n_shingles", "g", "digest"],
            )

    return run


def _entries(order: PrefixOrder, buckets: int):
    """Prefix entries, once per group and task, packed by the bucket of their shingle.

    Heavy shingles are known to be shared: their entries go to buckets by group, below zero, so that
    no task holds all entries of a hot shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _batches(batches):
            parts, light = [], []
            for s in sets:
                if not len(s):
                    continue
                prefix, n_light = order.prefix(s)
                group = _group(prefix, len(s))
                if group in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(group)
                part = np.empty(len(prefix), _ENTRY)
                part["s"], part["g"], part["n"], part["pos"] = prefix, group, len(s), np.arange(len(prefix))
                parts.append(part)
                light.append(np.arange(len(prefix)) < n_light)
            if not parts:
                continue
            entries, is_light = np.concatenate(parts), np.concatenate(light)
            bucket = (mix(np.where(is_light, entries["s"], entries["g"])) % np.uint64(buckets)).astype(np.int64)
            bucket = np.where(is_light, bucket, -1 - bucket)
            by = np.argsort(bucket, kind="stable")
            entries, bucket = entries[by], bucket[by]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            blobs = [x.tobytes() for x in np.split(entries, cuts)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[np.concatenate([[0], cuts])]), pa.array(blobs, pa.binary())], ["bucket", "entries"])

    return run


def _shared(key: tuple, table: pa.Table) -> pa.Table:
    """Entries of one bucket whose shingle stands in at least two groups."""
    entries = np.concatenate([np.frombuffer(x, _ENTRY) for x in table.column("entries").to_pylist()])
    entries = entries[np.lexsort((entries["g"], entries["s"]))]
    same = np.zeros(len(entries), bool)
    same[1:] = (entries["s"][1:] == entries["s"][:-1]) & (entries["g"][1:] == entries["g"][:-1])
    entries = entries[~same]
    if key[0].as_py() >= 0:
        heads = np.flatnonzero(np.concatenate([[True], entries["s"][1:] != entries["s"][:-1]]))
        runs = np.diff(np.concatenate([heads, [len(entries)]]))
        entries = entries[np.repeat(runs > 1, runs)]
    columns = [entries["s"].view(np.int64) if entries["s"].flags.c_contiguous else np.ascontiguousarray(entries["s"]).view(np.int64)]
    columns.append(np.ascontiguousarray(entries["g"]).view(np.int64))
    columns += [np.ascontiguousarray(entries["n"]).astype(np.int64), np.ascontiguousarray(entries["pos"]).astype(np.int64)]
    columns.append(np.full(len(entries), key[0].as_py() < 0))
    return pa.table([pa.array(x) for x in columns], names=["s", "g", "n", "pos", "heavy"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose whole texts reach the similarity."""
    for batch in batches:
        for first, part in slices(batch.column("text_a"), SLICE_BYTES):
            rows = batch.slice(first, len(part))
            right = [s for _, s in shingle_sets(rows.column("text_b"))]
            keep_row = []
            for row, left in shingle_sets(rows.column("text_a")):
                common = len(np.intersect1d(left, right[row], assume_unique=True))
                keep_row.append(common > 0 and 100 * common >= SIMILARITY * (len(left) + len(right[row]) - common))
            mask = pa.array(keep_row, pa.bool_())
            yield pa.RecordBatch.from_arrays([rows.column("a").filter(mask), rows.column("b").filter(mask)], ["a", "b"])


def _fits(left: str, right: str):
    """Size and position bounds. They hold at the first shingle that a similar pair shares: nothing before
    it is shared, so the overlap is at most what either set has from there on."""
    n, m = F.col(f"{left}.n"), F.col(f"{right}.n")
    best = F.least(n - F.col(f"{left}.pos"), m - F.col(f"{right}.pos"))
    return (100 * F.least(n, m) >= SIMILARITY * F.greatest(n, m)) & ((100 + SIMILARITY) * best >= SIMILARITY * (n + m))


def _by_shingle(entries: DataFrame, per_shingle: DataFrame) -> DataFrame:
    """``entries`` joined with a table of one row for each shingle.

    The hot keys are the heavy shingles, and there are at most ``HEAVY`` rows of them: these are broadcast.
    """
    heavy = entries.filter("heavy").join(F.broadcast(per_shingle.filter("heavy").drop("heavy")), "s")
    light = entries.filter("not heavy").join(per_shingle.filter("not heavy").drop("heavy"), "s")
    return heavy.unionByName(light)


def _apart_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): rows (s, pos, rep, n, component, parts) of one s and different components that ``_fits`` lets pass.

    The bound of ``_fits`` reads, for either side, SIMILARITY * m <= 100 * n - (100 + SIMILARITY) * pos. So the
    smaller set of a pair stands far enough in front to have partners of its own size, and the sizes of its partners
    end at its reach: it goes to the levels from one to the other, and the larger set to its own level only.
    """
    n, reach = F.col("n"), (100 * F.col("n") - (100 + SIMILARITY) * F.col("pos")) / SIMILARITY

    def level(size):
        return F.floor(F.log(size.cast("double")) * LEVELS)

    smaller = rows.filter(reach >= n).withColumn("level", F.explode(F.sequence(level(n), level(F.floor(reach)))))
    smaller = smaller.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    larger = rows.withColumn("level", level(n)).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("s", "level", "part")]
    ordered = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.rep") < F.col("y.rep")))
    met = smaller.alias("x").join(larger.alias("y"), same).filter(ordered & (F.col("x.component") != F.col("y.component")) & _fits("x", "y"))
    return met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def _parts(rows: str):
    """Over how many tasks the rows of one shingle are dealt."""
    return F.ceil(F.col(rows) / PART_ROWS).alias("parts")


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    # texts are always shuffled to their pairs: neither side has a bound that a broadcast could rely on
    rows = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(releasing(_verified), "a long, b long").distinct()


def _global_order(docs: DataFrame) -> PrefixOrder:
    """The order, with the most repeated shingles as heavy: as many whole counts as fit in ``HEAVY``."""
    counts = keep(docs.select("text").mapInArrow(releasing(_repeated), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")), "repeated")
    kept, least = 0, 1 << 62
    # counts from 10,000 on are told apart by four digits, so the driver sees at most 9,000 values for each power of ten
    unit = F.pow(F.lit(10.0), F.greatest(F.length(F.col("n").cast("string")) - 4, F.lit(0))).cast("long")
    for row in counts.groupBy((F.col("n") - F.col("n") % unit).alias("n")).count().orderBy(F.col("n").desc()).collect():
        kept += row["count"]
        if kept > HEAVY:
            break
        least = row.n
    heavy = counts.filter(F.col("n") >= least).toArrow()
    return PrefixOrder(heavy.column("s").to_numpy().view(np.uint64), heavy.column("n").to_numpy())


def similar_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``documents`` (doc_id long, text string).

    component_id is the smallest doc_id that links of similarity 0.8 reach. Null and wordless texts
    have no shingles and link with nothing. Repeated rows return repeated rows; a doc_id with several
    texts links through each of them; a null doc_id is never linked and keeps a null component.
    Other columns are ignored. An empty table gives no rows.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = _global_order(docs)
    members = keep(docs.mapInArrow(releasing(_members(order)), "doc_id long, n_shingles long, g long, digest binary"), "members")
    total = members.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = 1 << max(4, math.ceil(math.log2(1 + total * (100 - SIMILARITY) / 100 / BUCKET_ENTRIES)))
    shared = (
        docs.filter("doc_id is not null").select("text").mapInArrow(releasing(_entries(order, buckets)), "bucket long, entries binary")
        .groupBy("bucket").applyInArrow(_shared, "s long, g long, n long, pos long, heavy boolean")
    )
    shared = keep(shared, "shared-entries")

    # one document stands for each distinct set; a group holds the distinct sets of one prefix and size
    sets = members.filter("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("g").alias("g"), F.first("n_shingles").alias("n"))
    sets = keep(sets, "sets")
    groups = sets.groupBy("g").agg(F.min("rep").alias("lead"), F.count("*").alias("size"), F.first("n").alias("n"))
    inner = sets.join(groups.filter("size > 1").select("g", "lead"), "g").filter("rep != lead").select(F.col("lead").alias("a"), F.col("rep").alias("b"))

    # the group with the fewest rarer shingles before this one is the least edited: most others are close to it
    leader = shared.groupBy("s", "heavy").agg(F.min(F.struct("pos", F.xxhash64("g", F.col("s") % LEADERS).alias("h"), "g", "n")).alias("l"))
    led = _by_shingle(shared.select("s", "heavy", F.struct("g", "n", "pos").alias("x")), leader)
    outer = led.filter((F.col("x.g") != F.col("l.g")) & _fits("x", "l")).select(F.col("x.g").alias("g"), F.col("l.g").alias("h"))
    outer = outer.select(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h")).distinct()
    leads = groups.select("g", F.col("lead"))
    outer = outer.join(leads, "g").withColumnRenamed("lead", "a").join(leads.withColumnsRenamed({"g": "h", "lead": "b"}), "h").select("a", "b")
    first = keep(inner.union(outer).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "pairs")

    involved = shared.select("g").union(groups.filter("size > 1").select("g")).distinct()
    wanted = sets.join(involved, "g", "left_semi").select(F.col("rep").alias("doc_id"))
    texts = keep(docs.join(wanted.hint("merge"), "doc_id", "left_semi"), "candidate-texts")
    links = keep(_verify(first, texts), "links")
    classes = components(links)

    # groups that share a shingle and are still apart
    placed = keep(
        sets.join(involved, "g", "left_semi").join(classes, F.col("rep") == F.col("id"), "left")
        .select("g", "rep", "n", F.coalesce("component", "rep").alias("component")), "placed",
    )
    spans = placed.groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
    apart = shared.join(spans, "g").groupBy("s", "heavy").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("size").alias("size")).filter("low < high")
    rows = _by_shingle(shared.select("s", "heavy", "g", "pos"), apart.select("s", "heavy", _parts("size"))).drop("heavy").join(placed, "g")
    inside = placed.join(spans.filter("low < high").select("g", _parts("size")), "g").withColumns({"s": F.col("g"), "pos": F.lit(0).cast("long")})
    rows = keep(rows.unionByName(inside), "apart")
    later = _apart_pairs(rows).join(first, ["a", "b"], "left_anti")
    links = keep(links.union(_verify(keep(later, "later-pairs"), texts)), "all-links")
    classes = components(links)
    named = sets.select("digest", "rep").join(classes, F.col("rep") == F.col("id"), "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    alone = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return members.join(named, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), alone).alias("component_id"))
