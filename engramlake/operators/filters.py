"""Scope, metadata and visibility predicates, and recall-request checks."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPE_DIMENSIONS = ("org", "space", "user", "agent", "session")
# Formal memory types and lifecycles.
FORMAL_TYPES = (
    "decision",
    "constraint",
    "preference",
    "domain_fact",
    "reusable_experience",
    "external_reference",
)
VISIBLE_LIFECYCLES = ("active", "superseded", "archived")
RAW_TYPES = ("capture", "evolved")
MAX_QUERY_REGIONS = 20
MIN_TOKEN_BUDGET = 512


def scope_filter(df: DataFrame, scope: Mapping[str, str], wildcard: bool = True) -> DataFrame:
    """Rows of one scope. ``*`` drops its dimension; without wildcards every value is literal."""
    condition = F.lit(True)
    for dimension in SCOPE_DIMENSIONS:
        value = scope.get(dimension, "")
        if not (wildcard and value == "*"):
            condition = condition & (F.col(f"scope_{dimension}") == value)
    return df.filter(condition)


def _compare(field: Column, op: str, value: object) -> Column:
    typed = field.cast("double") if isinstance(value, (int, float)) and not isinstance(value, bool) else field
    return {
        "EQ": lambda: typed == value,
        "GT": lambda: typed > value,
        "GTE": lambda: typed >= value,
        "LT": lambda: typed < value,
        "LTE": lambda: typed <= value,
    }[op]()


def metadata_filter(expr: tuple, field: Callable[[str], Column] | None = None) -> Column:
    """Boolean column of a filter tree.

    Leaves are ``(op, field, value)``; groups are ``("AND" | "OR" | "NOT", [children])``.
    NE and NOT_IN also keep rows that lack the key.
    """
    resolve = field or (lambda name: F.element_at("metadata", F.lit(name)))
    op = expr[0]
    if op in ("AND", "OR", "NOT"):
        children = [metadata_filter(child, field) for child in expr[1]]
        if op == "NOT":
            return ~children[0]
        combined = children[0]
        for child in children[1:]:
            combined = (combined & child) if op == "AND" else (combined | child)
        return combined
    _, name, value = expr
    column = resolve(name)
    if op == "NE":
        return column.isNull() | ~_compare(column, "EQ", value)
    if op == "IN":
        return F.coalesce(column.isin(list(value)), F.lit(False))
    if op == "NOT_IN":
        return column.isNull() | ~column.isin(list(value))
    if op == "CONTAINS":
        return F.coalesce(F.array_contains(column, value), F.lit(False))
    return F.coalesce(_compare(column, op, value), F.lit(False))


def recall_excluded(memory_type: str = "memory_type", capture_event_id: str = "capture_event_id") -> Column:
    """Raw or evolved units, and any unit that carries a capture id."""
    return F.coalesce(F.col(memory_type).isin(*RAW_TYPES), F.lit(False)) | (
        F.coalesce(F.col(capture_event_id), F.lit("")) != ""
    )


def recall_eligible(df: DataFrame) -> DataFrame:
    """Drop raw rows before any ranking."""
    if "capture_event_id" not in df.columns:
        df = df.withColumn("capture_event_id", F.lit(None).cast("string"))
    return df.filter(~recall_excluded())


def formal_visible(df: DataFrame, lifecycle: str | None = None) -> DataFrame:
    """Formal units in a visible lifecycle, or in the one asked for."""
    lifecycles = VISIBLE_LIFECYCLES if lifecycle is None else (lifecycle,)
    return df.filter(F.col("memory_type").isin(*FORMAL_TYPES) & F.col("lifecycle").isin(*lifecycles))


def literal_match(df: DataFrame, query: str | Column, name_col: str, alias_col: str) -> DataFrame:
    """Case-insensitive literal substring in the name or an alias; a blank query matches nothing."""
    text = F.lower(F.trim(F.lit(query) if isinstance(query, str) else query))
    return df.filter(
        (text != "")
        & (
            F.contains(F.lower(F.col(name_col)), text)
            | F.exists(F.col(alias_col), lambda alias: F.contains(F.lower(alias), text))
        )
    )


def query_problems() -> Column:
    """Everything wrong with a recall request, in a fixed order."""
    selectors = F.lit(0)
    for name in ("cwd", "library_id", "region_id", "region_ids"):
        selectors = selectors + F.col(name).isNotNull().cast("int")
    regions = F.col("region_ids")
    checks = [
        (selectors != 1, "exactly one selector is required"),
        (regions.isNotNull() & (F.size(regions) == 0), "at least one memory region is required"),
        (F.size(regions) > MAX_QUERY_REGIONS, "too many memory regions"),
        (F.size(F.array_distinct(regions)) < F.size(regions), "memory regions must not contain duplicates"),
        (~F.col("graph_hops").isin(1, 2), "graph hops must be 1 or 2"),
        (F.trim(F.col("query")) == "", "search query must not be empty"),
        (F.col("token_budget") < MIN_TOKEN_BUDGET, "token budget is too small"),
    ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(reason)) for bad, reason in checks]))


def check_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid recall requests, and rejects with their reasons."""
    judged = queries.withColumn("reasons", query_problems())
    return judged.filter(F.size("reasons") == 0).drop("reasons"), judged.filter(F.size("reasons") > 0)
