"""Claim normalization, equivalence and exclusivity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engramlake.functions.expr import bind

# Wordings of one value, and values that exclude each other within one dimension.
EQUIVALENT_VALUES = {
    "dark mode": "dark",
    "dark theme": "dark",
    "light mode": "light",
    "light theme": "light",
}
EXCLUSIVE_DIMENSIONS = {
    "dark": "theme",
    "light": "theme",
    "npm": "package manager",
    "pnpm": "package manager",
    "yarn": "package manager",
    "spaces": "indentation",
    "tabs": "indentation",
    "enabled": "state",
    "disabled": "state",
}
# Fixed value: subject, verb and value of a plain claim sentence.
CLAIM_PATTERN = r"^(?:the )?(.+?) (prefers|uses|requires|supports|must be|must|is|are) (.+)$"


def plain_claim(text: Column) -> Column:
    """Lower case, without sentence punctuation, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[.,;!?。，；！？]+", " "), r"(?U)\s+", " "))


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def canonical_value(value: Column) -> Column:
    """The value itself or the wording it is equivalent to."""
    return bind(
        plain_claim(value), lambda plain: F.coalesce(F.try_element_at(_lookup(EQUIVALENT_VALUES), plain), plain)
    )


def exclusive_dimension(value: Column) -> Column:
    """Dimension in which only one value can hold, or null where values complement each other."""
    return F.try_element_at(_lookup(EXCLUSIVE_DIMENSIONS), value)
