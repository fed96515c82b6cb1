"""Pairs of one shingle that are still apart beside all pairs, and texts that share a long passage behind own words."""

from __future__ import annotations

import random

from engramlake.llm import ngram_join
from engramlake.llm.ngram_join import SIMILARITY, similar_classes

from . import brute


def fits(x, y):
    best = min(x[3] - x[1], y[3] - y[1])
    return 100 * min(x[3], y[3]) >= SIMILARITY * max(x[3], y[3]) and (100 + SIMILARITY) * best >= SIMILARITY * (x[3] + y[3])


def test_apart_pairs_are_all_pairs_that_fit(spark):
    rng = random.Random(5)
    rows = []
    for s in range(4):
        for _ in range(150):
            n = rng.choice([1, 2, 5, 9, 10, 40, 45, 50, 1000, 1001, 1250, rng.randint(1, 3000)])
            rows.append((s, rng.randint(0, n - -(-SIMILARITY * n // 100)), 10 * len(rows), n, rng.randrange(40), 1 + s))
    got = ngram_join._apart_pairs(spark.createDataFrame(rows, "s long, pos long, rep long, n long, component long, parts long"))
    want = {(min(x[2], y[2]), max(x[2], y[2])) for i, x in enumerate(rows) for y in rows[:i] if x[0] == y[0] and x[4] != y[4] and fits(x, y)}
    assert {tuple(r) for r in got.collect()} == want and len(got.collect()) == len(want)


def test_unlike_texts_with_a_common_passage(docs, monkeypatch):
    """No links between them but those of real near copies, also where every shingle's rows are dealt out."""
    monkeypatch.setattr(ngram_join, "PART_ROWS", 16)
    rng = random.Random(6)
    common = [f"c{i}" for i in range(40)]
    rows = [(i, " ".join([f"x{rng.randrange(10**6)}" for _ in range(rng.randint(1, 14))] + common)) for i in range(80)]
    rows += [(100 + i, " ".join([*common[i % 5 :], "tail", str(i % 7)])) for i in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_classes(docs(rows)).collect()}
    assert got == brute.similar_classes(rows)
