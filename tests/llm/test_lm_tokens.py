"""op8: words of a slice are split and numbered without a Python object each, and give the tokens of every text by itself."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from engramlake.llm import lm_scoring

TEXTS = [b"", b" ", b"\x0b a\tB\x0c\r\n ", b"\xff\xfe Z\xc3\x89 x", "É Ａ b c".encode(), b"\x00a \x1f b\x85c \xa0", b"a", b"a b a c a B"]


def plain(text):
    return [*text.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split(), b"\n"]


def table():
    words = [b"a", b"\n", b"b", b"c"]
    v = lm_scoring.Vocabulary(words, np.array([9, 8, 5, 2]), 30, 9, np.full(3, 2.0), np.full(3, 1.0))
    v.prepare()
    return v


def test_tokens_of_odd_texts():
    for texts in (TEXTS, TEXTS[:1], TEXTS[1:2], []):
        found = lm_scoring.tokens(pa.array([b"before", *texts], pa.large_binary()).slice(1))
        words = found.words.to_pylist()
        assert [[words[k] for k in found.codes[a:b]] for a, b in zip(found.starts, found.ends)] == [plain(t) for t in texts]


def test_contexts_stay_within_a_text():
    v = table()
    places, classes, columns = v.columns(lm_scoring.tokens(pa.array(TEXTS, pa.large_binary())))
    alone = [v.look_up(plain(t))[1] for t in TEXTS]
    want = [np.concatenate(c) for c in zip(*((c, *v.contexts(c)) for c in alone))]
    assert all(np.array_equal(a, b) for a, b in zip(columns, want, strict=True))
    assert len(places) == len(classes) and {-1, 0} < set(places)


def test_counts_have_a_row_for_every_word_of_a_slice():
    batch = pa.RecordBatch.from_arrays([pa.array([*(t.decode("latin-1") for t in TEXTS if t.isascii()), None], pa.string())], ["text"])
    (out,) = lm_scoring._counted(iter([batch]))
    texts = [t for t in TEXTS if t.isascii()] + [b""]
    want = [w for t in texts for w in plain(t)]
    assert dict(zip(out["word"].to_pylist(), out["c"].to_pylist(), strict=True)) == {w: want.count(w) for w in want}
    assert out.schema.types == [pa.binary(), pa.int64()]
