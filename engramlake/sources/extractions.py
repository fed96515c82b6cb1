"""Decoding the JSON a model returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_MEMORIES = 20

_TEXT = T.StringType()
_TEXTS = T.ArrayType(_TEXT)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


MEMORY_ITEM = _struct(
    content=_TEXT,
    memory_type=_TEXT,
    confidence=T.DoubleType(),
    region_hint=_TEXT,
    user_event_id=_TEXT,
    evidence_snippet=_TEXT,
    claim_subject=_TEXT,
    claim_value=_TEXT,
    durability=_TEXT,
)
ENTITY_ITEM = _struct(type=_TEXT, canonical_name=_TEXT, id=_TEXT, aliases=_TEXTS, evidence=_TEXTS)
RELATION_ITEM = _struct(
    type=_TEXT, source=_TEXT, source_type=_TEXT, target=_TEXT, target_type=_TEXT, evidence=_TEXTS
)
SCHEMAS = {
    "memories": _struct(memories=T.ArrayType(MEMORY_ITEM), _corrupt_record=_TEXT),
    "graph": _struct(entities=T.ArrayType(ENTITY_ITEM), relations=T.ArrayType(RELATION_ITEM), _corrupt_record=_TEXT),
}


def parse_extractions(df: DataFrame, json_col: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Decode one JSON object per row as (parsed, rejects).

    ``memories`` needs a list of at most 20 objects. ``graph`` treats an absent list as empty.
    """
    decoded = df.withColumn(
        "parsed",
        F.from_json(json_col, SCHEMAS[kind], {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}),
    )
    broken = (
        F.col("parsed").isNull()
        | F.col("parsed._corrupt_record").isNotNull()
        | ~F.ltrim(F.col(json_col)).startswith("{")
    )
    if kind == "memories":
        reason = (
            F.when(broken, "malformed_json")
            .when(F.col("parsed.memories").isNull(), "malformed_json")
            .when(F.size("parsed.memories") > MAX_MEMORIES, "malformed_memories")
            .when(F.exists("parsed.memories", lambda item: item.isNull()), "malformed_memories")
        )
        fields = ["memories"]
    else:
        reason = F.when(broken, "malformed_json")
        fields = ["entities", "relations"]
    judged = decoded.withColumn("reason", reason)
    parsed = judged.filter(F.col("reason").isNull())
    for name in fields:
        parsed = parsed.withColumn(name, F.coalesce(F.col(f"parsed.{name}"), F.array()))
    return parsed.drop("parsed", "reason"), judged.filter(F.col("reason").isNotNull()).drop("parsed")
