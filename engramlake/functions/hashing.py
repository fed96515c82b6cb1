"""Digests, keyed hashes and order-independent set fingerprints."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\x00"
LANE_HEX_DIGITS = 15


def terminated_digest(*parts: str | Column) -> Column:
    """SHA-256 over parts that each end in a NUL byte (event identities)."""
    pieces: list[Column] = []
    for part in parts:
        pieces += [_text(part), F.lit(NUL)]
    return F.sha2(F.concat(*pieces), 256)


def joined_digest(*parts: str | Column) -> Column:
    """SHA-256 over parts separated by NUL bytes (round keys)."""
    return F.sha2(F.concat_ws(NUL, *[_text(part) for part in parts]), 256)


def json_array_digest(*parts: str | Column) -> Column:
    """SHA-256 of the compact JSON array of the parts."""
    return F.sha2(F.to_json(F.array(*[_text(part) for part in parts])), 256)


def keyed_digest(key: str, value: str | Column) -> Column:
    """HMAC-SHA256 built from two nested SHA-256 calls."""
    raw = key.encode("utf-8")
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in block)), F.encode(_text(value), "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in block)), F.unhex(inner)), 256)


def set_fingerprint(digest: str | Column) -> Column:
    """Aggregate: fingerprint of a set of hex digests, mergeable map-side.

    Summing fixed slices of each digest keeps the aggregation buffer constant in size, so a
    group of any size never has to be gathered or sorted in one task.
    """
    column = _text(digest)
    lanes = [
        F.sum(F.conv(F.substring(column, 1 + lane * LANE_HEX_DIGITS, LANE_HEX_DIGITS), 16, 10).cast("decimal(20,0)"))
        for lane in (0, 1)
    ]
    return F.concat_ws(":", F.count(column).cast("string"), *[lane.cast("string") for lane in lanes])


def _text(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value
