"""The operators over documents beside plain versions, with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engramlake.llm import exact_dedup, lm_scoring, packing, quality, token_output, tokens
from engramlake.llm.decontaminate import contaminated
from engramlake.llm.exact_dedup import exact_copies
from engramlake.llm.ngram_join import similar_classes
from engramlake.session import scratch_path

from . import brute
from .conftest import LONG, ODD

SMALL = "/root/testdata/sf0.001"


def corpus(seed=1, size=120):
    """Random texts with exact copies, chains of near copies, a family around one base, and a shared passage."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    fresh = lambda n: [rng.choice(words) for _ in range(n)]
    passage, base = fresh(60), fresh(120)
    texts = [fresh(rng.randint(1, 90)) for _ in range(size // 3)]
    texts += [fresh(rng.randint(20, 200)) + passage + fresh(rng.randint(20, 200)) for _ in range(size // 6)]
    for _ in range(size // 4):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(copy)
    chain = fresh(150)
    for _ in range(size // 6):
        chain = chain[rng.randint(0, 8) :] + fresh(rng.randint(0, 8))
        texts.append(list(chain))
    texts += [list(t) for t in rng.sample(texts, size // 10)]
    rng.shuffle(texts)
    return [(7 * i + 103, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_similar_classes(docs, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_classes(docs(rows)).collect()}
    assert got == brute.similar_classes(rows)


def test_similar_classes_of_odd_rows(odd):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in similar_classes(odd).collect())
    want = brute.similar_classes([r for r in ODD if r[0] is not None])
    assert got == Counter([(d, *want[d]) if d is not None else (None, len(brute.shingles(t)), None) for d, t in ODD])


def test_empty_tables(docs, spark):
    none = docs([])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert similar_classes(none).count() == 0
    assert exact_copies(none).count() == 0
    assert contaminated(none, items).count() == 0
    assert contaminated(docs(ODD), items).count() == 0
    assert packing.pack_sequences(none).count() == 0
    assert quality.score_documents(none, labels).count() == 0
    assert lm_scoring.score_texts(none).count() == 0


def plain_copies(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out = Counter()
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        done = False
        for i in sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True):
            out[i, top, len(ids), i == top and not done, hashlib.sha256(t.encode()).hexdigest()] += 1
            done = True
    return out


@pytest.mark.parametrize("digest", [None, lambda t: F.substring(F.sha2(t, 256), 1, 1)])
def test_exact_copies(docs, digest):
    """Also with a digest that many texts share: the bytes decide."""
    rows = ODD + corpus(4)
    got = exact_copies(docs(rows)) if digest is None else exact_copies(docs(rows), digest)
    assert Counter(tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == plain_copies(rows)


def test_exact_copies_keep_their_state(docs, spark):
    feed, state = scratch_path(spark, "feed"), scratch_path(spark, "state")
    first, second = [(1, "a"), (2, "b")], [(3, "a"), (4, "c")]
    exact_copies(docs(first), feed=feed, state=state).collect()
    feed_2 = docs(second)
    from engramlake.llm.exact_dedup import update_state, write_feed

    write_feed(feed_2, feed)
    held = {r.keep_id: r.group_size for r in update_state(spark, feed, state).collect()}
    assert held == {3: 2, 2: 1, 4: 1}


def test_contaminated(docs, spark):
    rng = random.Random(5)
    rows = [(d, t) for d, t in corpus(6)] + [r for r in ODD if r[0] is not None]
    items = [(i, " ".join(rng.choice([f"w{k}" for k in range(400)]) for _ in range(rng.randint(15, 50)))) for i in range(30)]
    planted = [(1000 + i, f"{rng.choice(rows)[1]} {t} {LONG if i % 7 == 0 else ''}") for i, t in items]
    almost = [(2000 + i, " ".join(w if k % 11 else "zz" for k, w in enumerate(t.split()))) for i, t in items]
    for more in ([], [(90, "tiny item"), (91, None), (92, ""), (None, "x")]):
        table = spark.createDataFrame(items + more, "item_id long, text string")
        got = {(r.doc_id, r.item_id): (r.shared, r.item_shingles) for r in contaminated(docs(rows + planted + almost), table).collect()}
        want = {}
        sets = {}
        for d, t in rows + planted + almost:
            sets[d] = sets.get(d, set()) | brute.shingles(t)
        for i, t in items + more:
            wanted = brute.shingles(t)
            for d, s in sets.items():
                if i is not None and wanted and 100 * len(wanted & s) >= 80 * len(wanted):
                    want[d, i] = (len(wanted & s), len(wanted))
        assert got == want
        assert len(want) >= 30


def library_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(library_ids, "tokenizer"):
        library_ids.tokenizer = Tokenizer.from_file(tokens.default_path())
    return [*library_ids.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


STRANGE = "<|endoftext|> á x́ ́ foo<|startoftext|>Bar \x1c \xa0x y 'S don'T s 1200 ÅΣς ﬁ a0b 0 00 <|ENDOFTEXT|> %,%% ..."


def test_pieces_hold_every_id_once(docs, spark):
    rows = [r for r in ODD if r != (9, "é " * 9)] + [(50, STRANGE), (51, "0 " * 3000)] + corpus(7)
    got = packing.pack_sequences(docs(rows)).collect()
    folder = scratch_path(spark, "matrices")
    token_output.write_matrices(docs(rows), folder, block_tokens=20_000)
    other = token_output.pieces_of(spark.read.parquet(folder)).collect()
    for pieces, crc in ((got, lambda r: zlib.crc32(r.ids)), (other, lambda r: r.ids_crc32)):
        by_doc, by_sequence = {}, {}
        for r in pieces:
            by_doc.setdefault(r.doc_id, []).append(r)
            by_sequence.setdefault(r.sequence_id, []).append(r)
        for doc_id, text in rows:
            if doc_id is None:
                continue
            ids = np.array(library_ids(text), "<u4")
            at = 0
            for r in sorted(by_doc[doc_id], key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
                assert crc(r) == zlib.crc32(ids[at : at + r.length].tobytes())
                at += r.length
            assert at == len(ids)
        for held in by_sequence.values():
            at = 0
            for r in sorted(held, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 2048
            if pieces is got:
                assert at == 2048 or at & (at - 1) == 0


def test_square_packer_minimises_the_sum_of_squares():
    rng = random.Random(2)
    packer = packing.SquarePacker(32)
    counts = [0] * 33
    for i in range(400):
        size = rng.randint(1, 31)
        before = {level: n for level, n in enumerate(packer.counts.tolist()) if n}
        packer.add(i, np.zeros(size, np.uint32))
        after = packer.counts.tolist()

        def cost(level):
            new = dict(before)
            if level:
                new[level] -= 1
            if level + size < 32:
                new[level + size] = new.get(level + size, 0) + 1
            return sum(n * n for n in new.values())

        best = min(cost(level) for level in [0, *before] if level + size <= 32)
        assert sum(n * n for n in after) == best
    assert counts[32] == packer.counts[32] == 0


def test_best_fit_decreasing():
    rng = random.Random(3)
    sizes = np.array([rng.randint(1, 64) for _ in range(500)])
    rows, room = [], []
    for piece in np.argsort(-sizes, kind="stable"):
        fits = [k for k, r in enumerate(room) if r >= sizes[piece]]
        if not fits:
            rows.append([])
            room.append(64)
            fits = [len(rows) - 1]
        at = min(fits, key=lambda k: room[k])
        rows[at].append(piece)
        room[at] -= sizes[piece]
    got = token_output.best_fit_decreasing(sizes, 64)
    assert sorted(p for r in got for p in r) == list(range(500))
    assert len(got) == len(rows)
    assert sorted(sum(sizes[p] for p in r) for r in got) == sorted(sum(sizes[p] for p in r) for r in rows)


def test_matrices_reset_positions(docs, spark):
    folder = scratch_path(spark, "matrices")
    token_output.write_matrices(docs([(1, "a b c"), (2, None), (3, "d " * 5000)]), folder)
    for r in spark.read.parquet(folder).collect():
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        want = [k for a, b in zip([*r.cu_seqlens], [*r.cu_seqlens[1:], 2048], strict=True) for k in range(b - a)]
        assert np.frombuffer(r.position_ids, "<u4").tolist() == want
        ids = np.frombuffer(r.input_ids, "<u4")
        assert len(ids) == 2048 and not ids[r.n_tokens :].any()


def test_quality_on_held_out_rows(spark):
    path = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    got = quality.score_documents(spark.read.parquet(f"{path}/documents.parquet"), labels)
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got.collect())


def test_quality_of_odd_rows(odd, spark):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 0), (6, None), (77, 1), (None, 1)], "doc_id long, quality int")
    assert quality.score_documents(odd, labels).count() == len(ODD)
    none = quality.score_documents(odd, labels.filter("quality = 1")).collect()
    assert {(round(r.score, 6), r.predicted) for r in none} == {(0.7, 1)}


def plain_base(rows):
    counts, found = Counter(), []
    for d, t in rows:
        ws = [*brute.words(t), "\n"]
        found.append((d, ws))
        if d is None or zlib.crc32(str(d).encode()) % 5 != 1:
            counts.update(ws)
    total, distinct = sum(counts.values()), len(counts)
    for d, ws in found:
        yield d, len(ws), sum(counts[w] > 0 for w in ws), total, sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)


def test_lm_base_scores(docs):
    """With a table of few words most counts come by join."""
    rows = ODD + corpus(8) + [(900 + k, f"rare{k} words{k} Only") for k in range(20)]
    got = lm_scoring.score_texts(docs(rows), known_words=150).collect()
    left = Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got)
    assert left == Counter((*r[:4], round(r[4], 5)) for r in plain_base(rows))
    assert all(r.score < 0 for r in got)


def test_lm_probabilities_sum_to_one():
    """Also after training, for every context, and a group factor times an inner factor is what a plain sum over all classes gives."""
    words = [b"the", b"of", b"\n", b"abc", b"abd", *(b"w%d" % k for k in range(60))]
    counts = np.array([50, 40, 30, 9, 8, *([2] * 60)])
    total, distinct = np.full(7, 3.0), np.full(7, 2.0)
    v = lm_scoring.Vocabulary(words, counts, 257, 80, total, distinct)
    v.prepare()
    assert v.own == 8 * 6 and len(v.class_counts) == 8 * 6 + 7
    model = lm_scoring.LogBilinear(v.class_counts, seed=1)
    rng = np.random.default_rng(5)
    classes = np.arange(len(v.class_counts))
    for trained in (False, True):
        if trained:
            model.start_training(1)
            seen = rng.integers(0, len(classes), 5000)
            model.learn(seen, *v.contexts(seen))
        model.prepare()
        for first, second in ((0, 1), (5, 40), (v.start, v.start)):
            logs = model.log10(classes, np.full(len(classes), first), np.full(len(classes), second))
            assert abs((10.0**logs).sum() - 1) < 1e-4
            r = model.near[first].astype(float) + model.far[second]
            outer = model.part("g") @ np.append(r, 1)
            inner = model.part("q") @ np.append(r, 1)
            for c in (0, 13, len(classes) - 1):
                g = c // model.size
                mates = inner[g * model.size : (g + 1) * model.size]
                plain = math.exp(outer[g]) / np.exp(outer).sum() * math.exp(inner[c]) / np.exp(mates).sum()
                assert abs(10.0 ** logs[c] - plain) < 1e-5
    # inside a suffix class: known words, and one share for all unknown ones
    inside = [(c + 0.5) / (7 + 0.5 * (3 + 1)) for c in (4, 2, 1)] + [0.5 / (7 + 0.5 * (3 + 1))]
    assert abs(sum(inside) - 1) < 1e-9


def test_lm_grows_with_its_text(spark):
    """Classes, and with them contexts, follow the number of training tokens; every class has its row of parameters."""
    sizes = []
    for times in (1, 27):
        table = spark.createDataFrame([(f"w{k}".encode(), times * 1000 // (k + 1) + 1) for k in range(1500)], "word binary, c long")
        v = lm_scoring.vocabulary(table)
        v.prepare()
        model = lm_scoring.LogBilinear(v.class_counts)
        assert len(model.part("q")) == len(v.class_counts) == v.own + v.suffixes and len(model.part("r")) == v.own + v.suffixes + 1
        assert abs(v.counts[: v.own].sum() + v.suffix_total.sum() - v.total) < 1e-6
        sizes.append(v.own)
    assert 2.5 < sizes[1] / sizes[0] < 3.5


def test_lm_learns_order(docs):
    """Words that follow each other are predicted better than by their frequency."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    rows = []
    for d in range(1500):
        at, text = rng.randrange(40), []
        for _ in range(150):
            text.append(words[at])
            at = (at * 3 + rng.choice((1, 2))) % 40
        rows.append((d, " ".join(text)))
    got = lm_scoring.score_texts(docs(rows)).filter("held_out").collect()
    n = sum(r.n_tokens for r in got)
    assert sum(r.score for r in got) / n > sum(r.base_score for r in got) / n + 0.15


def test_encoder_equals_library():
    encoder = tokens.Encoder()
    for text in [STRANGE, LONG[:5000], "", "x" * 5000, "İI ẞ ǅ", *[t for _, t in corpus(9)[:20]]]:
        assert [*encoder.encode([text.encode()])[0], 1] == library_ids(text)


def test_features_of_empty_texts():
    x = quality.features(pa.array([b"", b" ", b"a"], pa.large_binary()))
    assert np.isfinite(x).all() and x.shape == (3, quality.FEATURES)


def test_exact_copies_over_partitioned_files(spark):
    """One task gives its file the same name in every partition folder; each text must keep one row all the same."""
    folder = scratch_path(spark, "partitioned")
    rows = [(1, "same", "a"), (2, "same", "b"), (3, "other", "a"), (2, "same", "a"), (None, "same", "b"), (None, None, "b"), (4, None, "a")]
    spark.createDataFrame(rows, "doc_id long, text string, part string").coalesce(1).write.partitionBy("part").parquet(folder)
    got = Counter(map(tuple, exact_copies(spark.read.parquet(folder)).select("doc_id", "keep_id", "group_size", "kept").collect()))
    assert got == Counter([(1, 2, 4, False), (2, 2, 4, True), (2, 2, 4, False), (None, 2, 4, False), (3, 3, 1, True), (None, 4, 2, False), (4, 4, 2, True)])
    several = spark.read.parquet(f"{folder}/part=a", f"{folder}/part=b")
    assert exact_copies(several).filter("kept").count() == 3


def test_exact_copies_of_many_groups_beside_a_hot_one(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FREQUENT", 5)
    rows = [(k, "hot" if k % 3 == 0 else f"text {k // 2}") for k in range(300)]
    got = Counter(map(tuple, exact_copies(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "keep_id", "group_size", "kept").collect()))
    groups = {}
    for k, t in rows:
        groups.setdefault(t, []).append(k)
    assert got == Counter((k, max(groups[t]), len(groups[t]), k == max(groups[t])) for k, t in rows)


def test_lasting_chunks_change_no_piece(docs):
    rows = corpus(11)
    columns = ("doc_id", "start", "length", "ids", "doc_tokens", "offset")
    once, lasting = (
        sorted(tuple(r) for r in packing.pack_sequences(docs(rows).coalesce(1), lasting=kept).select(*columns).collect()) for kept in (False, True)
    )
    assert once == lasting
