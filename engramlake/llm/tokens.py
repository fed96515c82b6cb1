"""Token ids of whole Arrow text columns with a public tokenizer file.

The vocabulary's own pre-tokenizer never joins pieces across ASCII white space and lower-cases anyway,
so every chunk between white space is encoded once and looked up afterwards. Only chunks not seen
lately reach the library, many of them in one call.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from engramlake.llm.store import release_memory

CACHE_CHUNKS = 250_000
LASTING_CHUNKS = 600_000  # where the worker has nothing else to do than to encode
LONG_CHUNK = 256
TEXT_BYTES = 1 << 20
_MARK = "0"  # stands alone as a pre-token between the chunks of one call


def default_path() -> str:
    """``word_bpe_49k.json`` of the installed vocabulary files."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Encodes texts; remembers two generations of at most ``limit`` chunks each."""

    def __init__(self, path: str | None = None, limit: int | None = None) -> None:
        self.limit = limit or CACHE_CHUNKS
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids[0]
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def forget(self) -> None:
        """Drop the chunks; the vocabulary stays."""
        self.young, self.old = {}, {}

    def _learn(self, chunks: list[bytes]) -> None:
        plain = [c for c in chunks if b"0" not in c and b"<|" not in c]
        other = [c for c in chunks if b"0" in c or b"<|" in c]
        if plain:
            joined = f" {_MARK} ".join(c.decode("utf-8", "replace") for c in plain)
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.kind)
            cuts = np.flatnonzero(ids == self.mark)
            data, size = ids.tobytes(), self.kind.itemsize
            starts = np.concatenate([[0], cuts + 1]) * size
            ends = np.concatenate([cuts, [len(ids)]]) * size
            self.young.update(zip(plain, [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], strict=True))
        if other:
            encoded = self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in other], add_special_tokens=False)
            self.young.update(zip(other, (np.array(e.ids, self.kind).tobytes() for e in encoded), strict=True))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of UTF-8 texts, without special tokens around them."""
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        parts = [list(map(self.young.get, chunks)) for chunks in split]
        holes = [[k for k, part in enumerate(row) if part is None] for row in parts]
        wanted = {chunks[k] for chunks, places in zip(split, holes, strict=True) for k in places}
        new = []
        for chunk in wanted:
            if chunk in self.old:
                self.young[chunk] = self.old[chunk]
            else:
                new.append(chunk)
        self._learn(new)
        for chunks, row, places in zip(split, parts, holes, strict=True):
            for k in places:
                row[k] = self.young[chunks[k]]
        ids = [np.frombuffer(b"".join(row), self.kind).astype(np.uint32) for row in parts]
        for chunk in new:
            if len(chunk) > LONG_CHUNK:
                del self.young[chunk]
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        return ids


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoded_rows(batches: Iterator[pa.RecordBatch], path: str | None, lasting: bool = False) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of every row of (doc_id, text) batches, in order; a null text is empty.

    The vocabulary stays in the worker. The chunks of a task go with it, as other stages use the worker too; with
    ``lasting`` later tasks find more of them. Ids do not depend on either.
    """
    path = path or default_path()
    if (path, lasting) not in _ENCODERS:
        _ENCODERS[path, lasting] = Encoder(path, LASTING_CHUNKS if lasting else None)
    encoder = _ENCODERS[path, lasting]
    try:
        yield from _encoded(encoder, batches)
    finally:
        if not lasting:
            encoder.forget()
        release_memory()


def _encoded(encoder: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
    for batch in batches:
        texts = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
        held, size = [], 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
            held.append((doc_id, text.as_py()))
            size += len(held[-1][1])
            if size >= TEXT_BYTES:
                yield from zip([d for d, _ in held], encoder.encode([t for _, t in held]), strict=True)
                held, size = [], 0
        yield from zip([d for d, _ in held], encoder.encode([t for _, t in held]), strict=True)
