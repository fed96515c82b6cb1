"""Divergence of the term distributions of sources: hash-consed segment trees over term ids.

Terms are counted on the map side and shuffled as counts. The kept terms of a language are dealt by hash into
blocks of about ``BLOCK_TERMS``, its sources into blocks of about ``BLOCK_SOURCES``; a task holds the counts of one term
block for two source blocks, whatever the size of a language. There every source is a segment tree over the block's
term ids, most frequent terms first. Equal subtrees of counts are one node, found level by level for all trees
at once. Two trees are priced by going down both together: equal pairs of nodes met on a level are one pair with
a multiplicity, so each is entered once and each pair of counts is priced once. Block sums are added in Spark.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramlake.llm.store import keep, releasing

LEAST_DOCUMENTS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10
BLOCK_TERMS = 4096
BLOCK_SOURCES = 64
SALTS = 64
FLUSH_TERMS = 200_000
PIECE_BYTES = 1 << 20
TREE_CELLS = 1 << 21  # pairs of tree nodes priced at once: bounds the arrays of a traversal

_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))
COUNT_SCHEMA = "lang string, source string, term string, n long, df long"
PART_SCHEMA = "lang string, source string, part string, item string, value long"


def text_terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a UTF-8 text in order, in lists made of about ``PIECE_BYTES``."""
    folded = text.translate(_FOLD)
    if len(folded) <= PIECE_BYTES:
        yield folded.split()
        return
    at = 0
    while at < len(folded):
        to = folded.find(b" ", at + PIECE_BYTES)
        to = len(folded) if to < 0 else to
        yield folded[at:to].split()
        at = to


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) batches to counts of terms; held counts are given out before they grow large."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> pa.RecordBatch:
        rows = [(*group, term, n, df[term]) for group, (count, df) in groups.items() for term, n in count.items()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        arrays = [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.binary()).cast(pa.string()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "df"])

    held = 0
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
            count, df = groups.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(count), set()
            for terms in text_terms(text.as_py()):
                count.update(terms)
                seen.update(terms)
            df.update(seen)
            held += len(count) - before
            if held > FLUSH_TERMS:
                yield out()
                groups, held = {}, 0
    yield out()


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, df) over all documents."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    counted = documents.select(*text).mapInArrow(releasing(_counted), COUNT_SCHEMA)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def kept_terms(counts: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, n, total, lead) of terms in at least ``least`` documents of the language; ``lead`` marks one row a term."""
    term = Window.partitionBy("lang", "term")
    rows = counts.withColumns({"docs": F.sum("df").over(term), "total": F.sum("n").over(term), "lead": F.col("source") == F.min("source").over(term)})
    return rows.filter(F.col("docs") >= least).select("lang", "source", "term", "n", "total", "lead")


def prices(c: np.ndarray, d: np.ndarray, e: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(price, p, q) of counts ``c`` under denominators ``d`` against ``e`` under ``f``; exact, a negative count costs nothing."""
    if max(int(c.max(initial=0)), int(e.max(initial=0))) > (1 << 63) // SCALE - 4:
        c, d, e, f = (x.astype(object) for x in (c, d, e, f))
    p, q = 1 + SCALE * (c + 2) // d, 1 + SCALE * (e + 2) // f
    value = np.where((c < 0) | (e < 0), 0, (p - q) * (p - q) // (p + q))
    return value.astype(np.int64), p.astype(np.int64), q.astype(np.int64)


class Forest:
    """Segment trees over the columns of a matrix of counts, one a row, in which equal subtrees are one node."""

    def __init__(self, counts: np.ndarray) -> None:
        rows, width = counts.shape
        leaves = np.full((rows, 1 << max(width - 1, 0).bit_length()), -1, np.int64)  # places beyond the last term hold -1
        leaves[:, :width] = counts
        self.values, nodes = np.unique(leaves, return_inverse=True)
        nodes = nodes.reshape(leaves.shape)
        self.leaves = nodes[:, :width]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        known = len(self.values)
        while nodes.shape[1] > 1:
            pairs, ids = np.unique(nodes[:, 0::2] * known + nodes[:, 1::2], return_inverse=True)
            nodes = ids.reshape(rows, -1)
            self.levels.append((pairs // known, pairs % known))
            known = len(pairs)
        self.roots = nodes[:, 0]

    def leaf_pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pair, left leaf node, right leaf node, times) met by going down trees ``a[i]`` and ``b[i]`` together."""
        pair, left, right, times = np.arange(len(a)), self.roots[a], self.roots[b], np.ones(len(a), np.int64)
        for down, other in reversed(self.levels):
            pair, times = np.concatenate([pair, pair]), np.concatenate([times, times])
            left, right = np.concatenate([down[left], other[left]]), np.concatenate([down[right], other[right]])
            below = int(max(left.max(), right.max())) + 1
            met, at = np.unique((pair * below + left) * below + right, return_inverse=True)
            sums = np.zeros(len(met), np.int64)
            np.add.at(sums, at, times)
            pair, left, right, times = met // (below * below), met // below % below, met % below, sums
        return pair, left, right, times


def _priced(task: pa.Table) -> pa.Table:
    """One (term block, two source blocks) of a language: partial sums of its pairs, and its best terms of every source."""
    kind = task.column("kind").to_numpy()
    lang = task.column("lang")[0].as_py()
    heads = task.filter(pa.array(kind == 2))
    sources, blocks, d = heads.column("source").to_pylist(), heads.column("block").to_numpy(), heads.column("n").to_numpy()
    lang_d = int(heads.column("total")[0].as_py()) if len(sources) else 0
    dictionary = task.filter(pa.array(kind == 0))
    names, totals = dictionary.column("term").cast(pa.binary()).to_pylist(), dictionary.column("n").to_numpy()
    order = sorted(range(len(names)), key=lambda k: (-totals[k], names[k]))
    column_of = {names[k]: at for at, k in enumerate(order)}
    row_of = {source: at for at, source in enumerate(sources)}
    matrix = np.zeros((len(sources) + 1, len(names)), np.int64)  # the last tree is the language itself
    matrix[-1] = totals[order]
    cells = task.filter(pa.array(kind == 1))
    rows = np.fromiter(map(row_of.__getitem__, cells.column("source").to_pylist()), np.int64, len(cells))
    columns = np.fromiter(map(column_of.__getitem__, cells.column("term").cast(pa.binary()).to_pylist()), np.int64, len(cells))
    matrix[rows, columns] = cells.column("n").to_numpy()

    low, high = int(task.column("i")[0].as_py()), int(task.column("j")[0].as_py())
    if low == high:
        a, b = np.triu_indices(len(sources), 1)
    else:
        a, b = (x.ravel() for x in np.meshgrid(np.flatnonzero(blocks == low), np.flatnonzero(blocks == high), indexing="ij"))
    sums = np.zeros(len(a), np.int64)
    out: list[tuple[list[str], str, list[str], np.ndarray]] = []
    if len(names):
        forest = Forest(matrix)
        step = max(1, TREE_CELLS // len(names))
        for at in range(0, len(a), step):
            left_tree, right_tree = a[at : at + step], b[at : at + step]
            pair, left, right, times = forest.leaf_pairs(left_tree, right_tree)
            value, _, _ = prices(forest.values[left], d[left_tree[pair]], forest.values[right], d[right_tree[pair]])
            np.add.at(sums, at + pair, value * times)
        if low == high:
            out += _best_terms(forest, matrix, d, lang_d, sources, [names[k] for k in order])
    first, second = [sources[k] for k in a], [sources[k] for k in b]
    out += [(first, "pair", second, sums), (second, "pair", first, sums)]
    tables = [
        pa.table({"lang": pa.array([lang] * len(s), pa.string()), "source": pa.array(s, pa.string()), "part": pa.array([part] * len(s), pa.string()), "item": pa.array(items, pa.string()), "value": pa.array(v, pa.int64())})
        for s, part, items, v in out
    ]
    return pa.concat_tables(tables)


def _best_terms(forest: Forest, matrix: np.ndarray, d: np.ndarray, lang_d: int, sources: list[str], names: list[bytes]) -> Iterator[tuple]:
    """For every source the block's terms of highest value, out of one traversal of its tree and that of the language."""
    by_name = np.empty(len(names), np.int64)
    by_name[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    language = len(sources)
    for source in range(len(sources)):
        held = np.flatnonzero(matrix[source])
        if not len(held):
            continue
        _, left, right, _ = forest.leaf_pairs(np.array([source]), np.array([language]))
        value, p, q = prices(forest.values[left], np.full(len(left), d[source]), forest.values[right], np.full(len(left), lang_d))
        keys = left * len(forest.values) + right  # ascending, as leaf_pairs gives them
        at = np.searchsorted(keys, forest.leaves[source, held] * len(forest.values) + forest.leaves[language, held])
        more = p[at] > q[at]
        held, found = held[more], value[at][more]
        top = np.lexsort((by_name[held], -found))[:TOP_TERMS]
        yield [sources[source]] * len(top), "term", [names[k].decode() for k in held[top]], found[top]


def source_divergence(documents: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of every language lie apart, and by which terms.

    ``documents`` needs text, lang and source; further columns are not read. Nulls count as empty strings, repeated rows as
    documents of their own. Part ``pair`` has every other source of the language, part ``term`` the ten terms
    that stand out most against the language. Ties are ranked by the bytes of the item. A language
    with one source and no kept term has no rows; an empty table has none.
    """
    spark = documents.sparkSession
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    kept = keep(kept_terms(term_counts(documents), least), "audit-terms")
    held = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.when(F.col("lead"), 1)).alias("v"))
    groups = documents.select(*text).groupBy("lang", "source").agg(F.lit(0).alias("n"), F.lit(0).alias("v"))
    groups = keep(groups.union(held).groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("v").alias("v")), "audit-groups")
    langs = groups.groupBy("lang").agg(F.sum("n").alias("all"), F.sum("v").alias("v"), F.count("*").alias("s"))
    tasks = langs.select(
        "lang", "all", "v", F.ceil(F.greatest(F.col("v"), F.lit(1)) / BLOCK_TERMS).alias("tb"), F.ceil(F.col("s") / BLOCK_SOURCES).alias("sb")
    )
    # a language may hold most rows: its few figures meet them under one of SALTS keys each
    salted = keep(tasks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "audit-langs")
    salt = F.pmod(F.xxhash64("term", "source"), F.lit(SALTS)).cast("int")
    rows = kept.withColumn("salt", salt).join(salted, ["lang", "salt"])
    rows = rows.withColumn("t", F.pmod(F.xxhash64("term"), "tb")).withColumn("block", F.pmod(F.xxhash64("source"), "sb"))
    heads = groups.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int")).drop("v").join(salted, ["lang", "salt"])
    heads = heads.withColumn("block", F.pmod(F.xxhash64("source"), "sb")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("tb") - 1)))
    each = F.explode(F.sequence(F.lit(0), F.col("sb") - 1)).alias("other")

    def placed(df: DataFrame, kind: int, term, n, total) -> DataFrame:
        """Rows of a source go wherever its block meets another one."""
        spread = df.select("lang", "t", "block", "source", term.alias("term"), n.alias("n"), total.alias("total"), each)
        return spread.select("lang", "t", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.lit(kind).alias("kind"), "block", "source", "term", "n", "total")

    none = F.lit(None)
    cells = placed(rows, 1, F.col("term"), F.col("n"), none.cast("long"))
    smoothed = 2 * F.col("v")
    starts = placed(heads, 2, none.cast("string"), F.greatest(F.col("n") + smoothed, F.lit(1)), F.col("all") + smoothed)
    blocks = rows.filter("lead").select("lang", "t", F.col("sb"), "term", "total", F.explode(F.sequence(F.lit(0), F.col("sb") - 1)).alias("i"))
    blocks = blocks.select("lang", "t", "i", "term", "total", F.explode(F.sequence(F.col("i"), F.col("sb") - 1)).alias("j"))
    terms = blocks.select("lang", "t", "i", "j", F.lit(0).alias("kind"), none.cast("long").alias("block"), none.cast("string").alias("source"), "term", F.col("total").alias("n"), none.cast("long").alias("total"))
    parts = keep(cells.unionByName(starts).unionByName(terms).groupBy("lang", "t", "i", "j").applyInArrow(_priced, PART_SCHEMA), "audit-parts")

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pairs = parts.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    best = parts.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP_TERMS)
    return pairs.unionByName(best)
