"""Registry of runnable queries and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from engramlake.sources.domain import DOMAIN_SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}

_MARKER = re.compile(r"\{([a-z_]\w*)\}")


def twin_sql(body: str, extra: dict[str, str] | None = None) -> str:
    """Standalone SQL: every ``{name}`` becomes a view or a preceding CTE.

    ``extra`` maps more CTE names to SQL that may itself use ``{name}`` markers.
    """
    definitions = {name: text for name, (_, text) in DOMAIN_SQL.items()} | (extra or {})
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _MARKER.findall(text):
            if name in definitions and name not in ordered:
                visit(definitions[name])
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    plain = {name: _MARKER.sub(r"\1", definitions[name]) for name in ordered}
    final = _MARKER.sub(r"\1", body)
    if not ordered:
        return final
    ctes = ",\n".join(f"{name} AS ({text})" for name, text in plain.items())
    recursive = "RECURSIVE " if any(re.search(rf"\bFROM\s+{n}\b|\bJOIN\s+{n}\b", t) for n, t in plain.items()) else ""
    return f"WITH {recursive}{ctes}\n{final}"


def query(name: str, sql: str | None = None, **extra: str):
    """Register ``fn(tables)`` under ``name``, with its twin when one is given."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, path: fn(Tables(spark, path))
        if sql is not None:
            TWINS[name] = twin_sql(sql, extra)
        return fn

    return register
