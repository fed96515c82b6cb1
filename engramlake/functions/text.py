"""Word segmentation and token-budget truncation as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engramlake.functions.expr import bind

# A token is a run of Han characters or a run of other letters, digits and marks.
TOKEN_PATTERN = r"\p{IsHan}+|[^\p{IsHan}\p{P}\p{S}\p{Z}\p{C}]+"
# Characters a truncated text may be cut back to.
BOUNDARY_PATTERN = r"(?s)\A(.*[\n 。！？])"


def _split_han(tokens: Column) -> Column:
    return F.flatten(
        F.transform(
            tokens,
            lambda token: F.when(
                token.rlike(r"\A\p{IsHan}") & (F.length(token) > 1),
                F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.substr(token, i, F.lit(2))),
            ).otherwise(F.array(token)),
        )
    )


def terms_of(text: Column) -> Column:
    """Lower-cased words; Han runs become overlapping character pairs."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))
    return F.when(text.rlike(r"\p{IsHan}"), _split_han(tokens)).otherwise(tokens)


def byte_prefix(text: Column, limit: Column) -> Column:
    """Longest prefix of ``text`` of at most ``limit`` UTF-8 bytes, never splitting a character."""
    raw = F.encode(text, "UTF-8")

    def continuation(position: Column) -> Column:
        return F.hex(F.substring(raw, position, F.lit(1))).rlike("^[89AB]")

    cut = (
        F.when(~continuation(limit + 1), limit)
        .when(~continuation(limit), limit - 1)
        .when(~continuation(limit - 1), limit - 2)
        .otherwise(limit - 3)
    )
    return F.when(F.octet_length(text) <= limit, text).otherwise(
        F.decode(F.substring(raw, F.lit(1), F.greatest(cut, F.lit(0))), "UTF-8")
    )


def close_fences(text: Column) -> Column:
    """Drop a trailing code fence that is still open, together with what follows it."""
    lines = F.split(text, "\n", -1)
    state = F.struct(F.lit("").alias("mark"), F.lit(0).alias("at"), F.lit(0).alias("line"))

    def step(acc: Column, line: Column) -> Column:
        mark = F.regexp_extract(line, r"^ {0,3}(`{3,}|~{3,})", 1)
        closing = F.regexp_extract(line, r"^ {0,3}(`{3,}|~{3,})[ \t]*\r?$", 1)
        opens = (acc["mark"] == "") & (mark != "")
        closes = (acc["mark"] != "") & (closing != "") & closing.startswith(acc["mark"])
        return F.struct(
            F.when(opens, mark).when(closes, F.lit("")).otherwise(acc["mark"]).alias("mark"),
            F.when(opens, acc["line"]).otherwise(acc["at"]).alias("at"),
            (acc["line"] + 1).alias("line"),
        )

    final = F.aggregate(lines, state, step)
    kept = F.rtrim(F.array_join(F.slice(lines, F.lit(1), final["at"]), "\n"))
    has_fence = text.rlike(r"(?m)^ {0,3}(?:`{3,}|~{3,})")
    return F.when(~has_fence | (final["mark"] == ""), text).otherwise(F.regexp_replace(kept, r"(?U)\s+\z", ""))


def truncate_text(text: Column, limit: Column) -> Column:
    """Cut ``text`` to ``limit`` bytes at a sentence, line or word boundary where one is late enough."""

    def at_boundary(prefix: Column) -> Column:
        late = lambda head: F.length(head) - 1 >= F.greatest(F.lit(1), F.floor(F.length(prefix) / 2))
        return bind(
            F.regexp_extract(prefix, BOUNDARY_PATTERN, 1), lambda head: F.when(late(head), head).otherwise(prefix)
        )

    cut = bind(byte_prefix(text, limit), at_boundary)
    return (
        F.when(limit <= 0, F.lit(""))
        .when(F.octet_length(text) <= limit, text)
        .otherwise(bind(F.regexp_replace(cut, r"(?U)\s+\z", ""), close_fences))
    )
