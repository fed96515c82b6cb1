"""The audits over documents (sources, tokenizers, licences) beside plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from engramlake.llm import license_scan, source_audit, token_align
from engramlake.llm.license_scan import scan_licenses
from engramlake.llm.source_audit import source_divergence
from engramlake.llm.token_align import align_tokens, cut_text, overlaps

from .conftest import LONG, ODD


def plain_divergence(rows, least):
    """The definition, over (lang, source, text) rows."""
    fold = {i: i + 32 for i in range(65, 91)}
    is_term = lambda c: c.isascii() is False or "a" <= c <= "z"
    counts, df, groups = Counter(), Counter(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = "".join(c if is_term(c) else " " for c in (text or "").translate(fold)).split(" ")
        words = [w for w in words if w]
        for w in words:
            counts[lang, source, w] += 1
        for w in set(words):
            df[lang, w] += 1
    out = []
    for lang in {g[0] for g in groups}:
        terms = [w for (g, w), n in df.items() if g == lang and n >= least]
        total = {w: sum(counts[lang, s, w] for g, s in groups if g == lang) for w in terms}
        n = {s: sum(counts[lang, s, w] for w in terms) for g, s in groups if g == lang}

        def p(count, all_):
            return 1 + 10**9 * (count + 2) // (all_ + 2 * len(terms))

        def price(x, y):
            return (x - y) ** 2 // (x + y)

        for s in n:
            pairs = [(-sum(price(p(counts[lang, s, w], n[s]), p(counts[lang, o, w], n[o])) for w in terms), o.encode(), o) for o in n if o != s]
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)]
            best = []
            for w in terms:
                x, y = p(counts[lang, s, w], n[s]), p(total[w], sum(n.values()))
                if counts[lang, s, w] and x > y:
                    best.append((-price(x, y), w.encode(), w))
            out += [(lang, s, "term", w, -v, k) for k, (v, _, w) in enumerate(sorted(best)[:10], 1)]
    return Counter(out)


def audit_rows(seed):
    rng = random.Random(seed)
    words = ["Été", "été", "a", "B", "x1y", "naïve-co", "日本", "ß"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    rows = []
    for _ in range(220):
        source = rng.choice(["s0"] * 5 + ["s1", "S1", "s2", "é", None, ""])
        pool = words[: rng.randint(4, len(words))]
        rows.append((rng.choice(["en", "en", "en", "fr", None]), source, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))))
    return rows + [("xx", "only", "rare words"), ("yy", "s", None), ("yy", "t", ""), ("en", "empty", " 12 "), ("en", "s0", None)] + rows[:3]


@pytest.mark.parametrize("seed,terms,sources", [(1, 4096, 64), (2, 7, 2), (3, 3, 1)])
def test_source_divergence(spark, monkeypatch, seed, terms, sources):
    monkeypatch.setattr(source_audit, "BLOCK_TERMS", terms)
    monkeypatch.setattr(source_audit, "BLOCK_SOURCES", sources)
    rows = audit_rows(seed)
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    df = df.select("*", *[F.lit("clash").alias(c) for c in ("n", "term", "df", "kind", "block", "i", "t", "total", "salt", "v")])
    got = source_divergence(df, 3)
    assert got.schema.simpleString() == "struct<lang:string,source:string,part:string,item:string,value:bigint,rank:int>"
    assert Counter(map(tuple, got.collect())) == plain_divergence(rows, 3)


def test_source_divergence_of_nothing_and_of_a_long_text(spark, monkeypatch):
    schema = "lang string, source string, text string"
    assert source_divergence(spark.createDataFrame([], schema)).count() == 0
    assert source_divergence(spark.createDataFrame([("en", "a", "no kept term")], schema)).count() == 0
    monkeypatch.setattr(source_audit, "PIECE_BYTES", 50)
    rows = [("en", s, LONG[: 40_000 + k]) for k, s in enumerate("abab")]
    assert Counter(map(tuple, source_divergence(spark.createDataFrame(rows, schema), 2).collect())) == plain_divergence(rows, 2)


def test_equal_subtrees_are_one_node():
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 3, (6, 200))
    counts[:, 60:] = 0
    forest = source_audit.Forest(counts)
    assert len(forest.levels[-2][0]) <= 2 * 6 and len(forest.levels[4][0]) < 6 * 8 / 2
    d = np.array([500, 600, 700, 800, 900, 1000])
    a, b = np.triu_indices(6, 1)
    pair, left, right, times = forest.leaf_pairs(a, b)
    value, _, _ = source_audit.prices(forest.values[left], d[a[pair]], forest.values[right], d[b[pair]])
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        whole, _, _ = source_audit.prices(counts[x], np.full(200, d[x]), counts[y], np.full(200, d[y]))
        assert (value * times)[pair == k].sum() == whole.sum()
        assert len(times[pair == k]) <= 10  # nine pairs of counts, and the places beyond the last term


def test_prices_of_large_counts_are_exact():
    c, d, e, f = 10**12, 3 * 10**13, 7 * 10**11 + 5, 2 * 10**13
    value, p, q = source_audit.prices(*(np.array([x]) for x in (c, d, e, f)))
    x, y = 1 + 10**9 * (c + 2) // d, 1 + 10**9 * (e + 2) // f
    assert (value[0], p[0], q[0]) == ((x - y) ** 2 // (x + y), x, y)


class PlainAlignment:
    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in keep]
        self.byte = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(rest)}

    def tokens(self, text):
        if not text:
            return [], []
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == b"".join(x for _, x in b) == whole else ([], [])

    def rows(self, documents):
        docs = []
        for doc_id, text in documents:
            a, b = self.tokens(text)
            spans = []
            for side in (a, b):
                at, out = 0, []
                for i, x in side:
                    out.append((at, at + len(x), i))
                    at += len(x)
                spans.append(out)
            links, j = [], 0
            for start, end, i in spans[0]:
                while j and spans[1][j - 1][1] > start:
                    j -= 1
                while j < len(spans[1]) and spans[1][j][1] <= start:
                    j += 1
                while j < len(spans[1]) and spans[1][j][0] < end:
                    links.append((i, spans[1][j][2]))
                    j += 1
            cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
            groups, at = [], 0
            for cut in cuts:
                groups.append("|".join(",".join(str(i) for s, _, i in side if at <= s < cut) for side in spans) if len(cuts) < 3000 else None)
                at = cut
            docs.append((doc_id, len(a), len(b), groups, links))
        count = Counter(pair for *_, links in docs for pair in links)
        most = Counter()
        for (_, b), n in count.items():
            most[b] = max(most[b], n)
        out = []
        for doc_id, n_a, n_b, groups, links in docs:
            digest = "" if not groups else None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest()
            out.append((doc_id, n_a, n_b, len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), digest))
        return out


STRANGE = [
    " leads", "trails ", "  two  spaces ", "tab\tand\nline\r\n\n  end", "x   y z", "a  b   c", "▁piece ▁▁ mark", "ﬁ ligature ａｂｃ", "日本語のテキスト です 。",
    "<|endoftext|> plain <s> </s> <unk> <0x0A>", "🙂🙂 emoji👩‍👩‍👧 z", "é combined", "it's we'll I'd  don't", "nul\x00byte here", "﻿bom x", "   ", " ", "\n", "naïve café ümlaut ß", "1234567890 12 3",
    "word" * 900, "\x1c x \x1f y", "​ zero ​", "a  b", "ok fine", "᠎ y ᠎",
]


def test_align_tokens(docs):
    rng = random.Random(4)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", "é", "日", "▁", "'s", "1", "🙂", " ", "́", "<s>", "-", "The", "ing"]
    rows = list(enumerate(STRANGE)) + [(100 + i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    rows += [(d, t if t is None or len(t) < 9000 else t[:9000]) for d, t in ODD] + rows[:4]
    got = align_tokens(docs(rows).repartition(3), block_bytes=2000)
    assert got.schema.simpleString() == "struct<doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,n_best:bigint,count_sum:bigint,groups_sha256:string>"
    want = PlainAlignment().rows(rows)
    left, right = Counter(map(tuple, got.collect())), Counter(want)
    hidden = {r[:7] for r in want if r[7] is None}
    assert Counter({r[:7] if r[:7] in hidden else r: n for r, n in left.items()}) == Counter({r[:7] if r[7] is None else r: n for r, n in right.items()})


def test_align_tokens_of_empty_tables_and_texts_without_tokens(docs):
    assert align_tokens(docs([])).count() == 0
    got = align_tokens(docs([(1, None), (2, ""), (None, "")])).collect()
    assert sorted((r.doc_id or 0, r.n_a, r.n_b, r.n_links, r.count_sum, r.groups_sha256) for r in got) == [(0, 0, 0, 0, 0, ""), (1, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 64, 1 << 16])
def test_pieces_of_a_merge_give_the_same_overlaps(piece):
    rng = np.random.default_rng(piece)
    for _ in range(60):
        total = int(rng.integers(1, 80))
        a, b = (np.unique(np.append(rng.integers(1, total + 1, rng.integers(0, total + 1)), total)) for _ in range(2))
        at_a, at_b, closed = overlaps(a, b, piece)
        spans = lambda x: list(zip([0, *x[:-1].tolist()], x.tolist(), strict=True))
        want = [(i, j) for i, (s, e) in enumerate(spans(a)) for j, (t, f) in enumerate(spans(b)) if max(s, t) < min(e, f)]
        assert list(zip(at_a.tolist(), at_b.tolist(), strict=True)) == want
        assert a[at_a[closed]].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
        i, j = token_align.merge_path(a, b, piece)
        work = np.diff(i + j)
        assert (work[:-1] == piece).all() and work[-1] <= piece


def test_chunks_give_the_text_back():
    for text in [*STRANGE, "", "plain words only"]:
        assert " ".join(cut_text(text)) == text


def plain_licenses(rows):
    """The scan by its definition, over (doc_id, text) rows."""
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    docs = [(d, word.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))) for d, t in rows]
    df = Counter(w for _, ws in docs for w in set(ws))
    index = []
    for label, text, phrases in license_scan.TEMPLATES:
        words = text.split()
        rare = sorted(set(words), key=lambda w: (df[w], w))[: license_scan.RARE]
        postings = [(p, w, 1 + round(1000 * math.log((len(docs) + 1) / (df[w] + 1)))) for p, w in enumerate(words) if w in rare]
        index.append((label, postings, [(words_at(words, x.split())[0], x) for x in phrases]))
    out = []
    for doc_id, words in docs:
        base = [(p, label) for phrase, label in license_scan.BASE for p in words_at(words, phrase.split())]
        labels, best = {label for _, label in base}, 0.0
        for label, postings, phrases in index:
            met = {}
            for p, w in enumerate(words):
                for place, rare, x in postings:
                    if rare == w:
                        for band in ((p - place) // 8 - 1, (p - place) // 8):
                            met.setdefault(band, [set(), set()])[0].add((place, x))
            for place, phrase in phrases:
                for p in words_at(words, phrase.split()):
                    for band in ((p - place) // 8 - 1, (p - place) // 8):
                        met.setdefault(band, [set(), set()])[1].add(phrase)
            for found, verified in met.values():
                share = sum(x for _, x in found) / sum(x for _, _, x in postings)
                best = max(best, share * len(verified) / len(phrases))
                if len(verified) == len(phrases) and share >= license_scan.LEAST_SHARE:
                    labels.add(label)
        places = [p for p, _ in base]
        own = ",".join(sorted({label for _, label in base}))
        out.append((doc_id, len(words), len(base), min(places, default=None), max(places, default=None), own, ",".join(sorted(labels)), round(1.0 if base else best, 6)))
    return Counter(out)


def words_at(words, phrase):
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]


def test_scan_licenses(docs):
    rng = random.Random(9)
    noise = ["a", "of", "software", "license", "version", "cc", "by", "Bärin", "日本", "x1", "free", "the", "K", "MİT"]
    rows = list(ODD) + [
        (50, "Licensed under CC BY-NC 4.0. Licensed under CC-BY 4.0; cc by cc by"),
        (51, "ALL RIGHTS RESERVED, all rights  reserved\nGNU General Public License"),
        (52, "all rights reserved"), (53, "cc\x0bby"), (54, "Released under the MİT License. public licenſe mit licenſe"), (55, "released under the mit Kicense"),
        (56, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)"),
        (57, "Permission is hereby granted, free of charge. " + "word " * 60 + "to any person obtaining a copy of this software and associated documentation files"),
        (58, "Redistribution and use in source and binary forms, with or without any modification, are permitted"),
        (59, LONG + " Licensed under the Apache License, Version 2.0. " * 300 + LONG),
    ]
    for k in range(120):
        _, text, _ = rng.choice(license_scan.TEMPLATES)
        words = text.split()
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = [rng.choice(noise)] * rng.randint(0, 2)
        words = [rng.choice(noise) for _ in range(rng.randint(0, 40))] + words + [rng.choice(noise) for _ in range(rng.randint(0, 40))]
        rows.append((100 + k % 90, rng.choice([" ", "\n", ", "]).join(words).title() if k % 3 else " ".join(words)))
    got = scan_licenses(docs(rows).repartition(3))
    assert got.schema.simpleString() == "struct<doc_id:bigint,n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double>"
    want = plain_licenses(rows)
    assert Counter(map(tuple, got.collect())) == want
    by_id = {r[0]: r for r in want}
    assert by_id[56][6] == "mit" and by_id[57][6] == "" and by_id[50][5:7] == ("cc-by", "cc-by,cc-by-nc") and by_id[54][6] == by_id[55][6] == ""


def test_scan_licenses_of_an_empty_table(docs):
    assert scan_licenses(docs([])).count() == 0
