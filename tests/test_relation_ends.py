"""Ends of relations are looked up in one row of their memory, and names are normalized in Arrow batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake.operators import entities as eg

ENTITIES = "region_id string, memory_id string, entity_type string, canonical_name string, aliases array<string>, raw_id string, position int, entity_id string"
RELATIONS = "region_id string, memory_id string, position int, relation_type string, source string, source_type string, target string, target_type string, evidence array<string>"
MEMORIES = "region_id string, memory_id string, texts array<string>, source_references array<string>, lifecycle string, updated_s long"


def _tables(spark):
    entities = [
        ("r", "m", "person", "Ann  Lee", ["ANN", "ﬁona"], None, 0, "old-ann"), ("r", "m", "person", "ann lee", [None, ""], "a1", 1, "ann"),
        ("r", "m", "component", "Spark", [], "", 2, "spark"), ("r", "m", "component", "Lost", [], None, None, "lost"),
        ("r", "m", "component", "Spark", [], "", 2, "spark"), ("r", None, "component", "Spark", [], None, 0, "no-memory"), ("r", "other", "component", "Far", [], None, 0, "far"),
    ]
    text, none = "Ann uses Spark", None
    relations = [
        ("r", "m", n, kind, source, "person", target, "component", evidence)
        for n, (kind, source, target, evidence) in enumerate([
            ("uses", " ann LEE ", "spark", [text, text, " "]), ("uses", "person: fiona", "Spark", ["Ann"]), ("likes", "a1", "Spark", [text]),
            ("uses", "Ann", "Lost", [text]), ("uses", "Ann", "Far", [text]), ("uses", "component:Spark", "Spark", [text]), ("uses", "Ann", "Spark", [" "]),
            ("uses", "Ann", "Spark", ["zzz"]), ("uses", "Ann", "Spark", none), ("uses", none, "Spark", [text]),
        ])
    ] + [("r", None, 20, "uses", "Ann", "person", "Spark", "component", [text])]
    return (
        spark.createDataFrame(relations, RELATIONS), spark.createDataFrame(entities, ENTITIES),
        spark.createDataFrame([("r", "m", [text], ["ref"], "active", 1)], MEMORIES),
    )


def test_ends_and_reasons(spark):
    accepted, rejected = eg.accept_relations(*_tables(spark))
    assert {(x.position, x.source_entity_id, x.target_entity_id, tuple(x.evidence)) for x in accepted.collect()} == {
        (0, "ann", "spark", ("Ann uses Spark",)), (1, "old-ann", "spark", ("Ann",)),
    }
    unresolved, missing = "unresolved end", "missing evidence"
    assert {(x.position, x.reason) for x in rejected.collect()} == {
        (2, "unknown relation type"), (3, unresolved), (4, unresolved), (5, "self relation"), (6, missing), (7, "evidence is not verbatim"), (8, missing), (9, unresolved),
    }


def test_mentions_are_shuffled_once_for_both_ends(spark):
    accepted, _ = eg.accept_relations(*_tables(spark))
    plan = accepted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1


def test_normalized_names(spark):
    rows = spark.createDataFrame([("A  b",), ("ÄB  ｃ",), (None,), ("",), ("ﬁ",)], "name string")
    found = [x.n for x in rows.coalesce(1).select(eg.normalized_name(F.col("name")).alias("n")).collect()]
    assert found == ["a b", "äb c", "", "", "fi"]
