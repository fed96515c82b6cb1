"""Steps of maintenance and of detail queries are written one after the other; a step's shuffles go when it is written."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from engramlake import session
from engramlake.operators import entities as eg

KEYS = "region_id string, memory_id string"


def _graph(spark):
    ids = ["a", "b", "c", "d"]
    supports = [("r", f"m{i}", ids[i % 3], "active", i) for i in range(12)] + [("r", "m1", "b", "active", 1), (None, "m1", "a", "active", 1), ("r", None, "a", "active", 1)]
    relations = [("r", "ab", "a", "b", "uses"), ("r", "aa", "a", "a", "uses"), ("r", "cd", "c", "d", "uses"), ("r", "ax", "a", None, "uses")]
    held = [("r", f"m{i}", key, [f"m{i}"], "active", i) for i in range(8) for key in ("ab", "aa", "cd", "ax")]
    entities = spark.createDataFrame([("r", i, "concept", i.upper(), i) for i in ids], "region_id string, entity_id string, entity_type string, canonical_name string, normalized_name string")
    return eg.EntityGraph(
        entities=entities, aliases=entities.select("region_id", "entity_type", F.col("normalized_name").alias("normalized_alias"), "entity_id"),
        relations=spark.createDataFrame(relations, "region_id string, relation_id string, source_entity_id string, target_entity_id string, relation_type string"),
        memory_entities=spark.createDataFrame(supports, f"{KEYS}, entity_id string, lifecycle string, updated_s long"),
        memory_relations=spark.createDataFrame(held, f"{KEYS}, relation_id string, evidence array<string>, lifecycle string, updated_s long"),
    )


def _rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("some", ["both", "present", "changes"])
def test_maintained_supports_meet_one_verdict(spark, some):
    graph = _graph(spark)
    changes = [("r", "m1", "archived", 50), ("r", "m2", "forgotten", 51), ("r", "m4", "archived", 52), ("r", "m4", "superseded", 53), (None, "m1", "forgotten", 54)]
    present = [("r", f"m{i}") for i in range(5)] + [("r", "m3"), (None, "m1"), ("r", None)]
    kept = eg.maintain(
        graph, spark.createDataFrame(changes, f"{KEYS}, lifecycle string, updated_s long") if some != "present" else None,
        spark.createDataFrame(present, KEYS) if some != "changes" else None,
    )

    def updated(rows):
        for region, memory, key, lifecycle, at in rows:
            if some != "changes" and (None in (region, memory) or (region, memory) not in present):
                continue
            found = [c for c in changes if some != "present" and None not in (region, memory) and c[:2] == (region, memory)]
            for c in found or [(region, memory, lifecycle, at)]:
                if c[2] != "forgotten":
                    yield region, memory, key, c[2], c[3]

    columns = ("lifecycle", "updated_s")
    supports = list(updated([tuple(r) for r in graph.memory_entities.collect()]))
    assert _rows(kept.memory_entities, "region_id", "memory_id", "entity_id", *columns) == sorted(supports, key=str)
    alive = {x[2] for x in supports}
    assert {r.relation_id for r in kept.relations.collect()} == {k for k, ends in {"ab": "ab", "aa": "a", "cd": "cd"}.items() if set(ends) <= alive}
    relations = updated([tuple(r) for r in graph.memory_relations.drop("evidence").collect() if r.relation_id in ("ab", "aa")])
    assert _rows(kept.memory_relations, "region_id", "memory_id", "relation_id", *columns) == sorted(relations, key=str)
    plan = kept.memory_entities._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Join " not in kept.memory_relations._jdf.queryExecution().optimizedPlan().toString()


def test_parts_of_memories_give_the_same_rows(spark, monkeypatch):
    graph = _graph(spark)
    ids = graph.memory_entities.select("region_id", "memory_id")
    whole = [_rows(df, *df.columns) for df in eg.memory_entities(graph, ids)]
    monkeypatch.setattr(session, "PART_ROWS", 4)
    parts = eg.memory_entities(graph, ids)
    assert [_rows(df, *df.columns) for df in parts] == whole and len(whole[0]) == 13 and len(whole[1]) == 32
    assert all("Join " not in df._jdf.queryExecution().optimizedPlan().toString() for df in parts)


def test_details_of_entities_and_relations(spark):
    graph = _graph(spark)
    page, relations = eg.entity_detail(graph, graph.entities, limit=3, offset=1)
    through = {("a", f"m{i}") for i in range(8)} | {(e, f"m{i}") for i in range(8) for e in ("b", "c", "d")}
    supports = through | {(r.entity_id, r.memory_id) for r in graph.memory_entities.collect() if r.region_id}
    for entity in "abcd":
        memories = sorted((m for e, m in supports if e == entity), key=lambda m: m or "")
        found = sorted((r for r in page.collect() if r.entity_id == entity), key=lambda r: r.position)
        assert [(r.memory_id, r.supporting_memory_count) for r in found] == [(m, len(memories)) for m in memories[1:4]]
    assert _rows(relations.filter("entity_id = 'a'"), "relation_id", "position") == [("aa", 1), ("ab", 2), ("ax", 3)]
    detail = eg.relation_detail(graph, graph.relations, limit=2)
    assert _rows(detail.filter("relation_id = 'cd'"), "memory_id", "position", "supporting_memory_count") == [("m0", 1, 8), ("m1", 2, 8)]


def test_written_tables_leave_no_shuffle_files(spark):
    def held():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().size()

    before = held()
    rows = spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count()
    table = session.written(rows, "counts")
    until = time.time() + 20
    while held() > before and time.time() < until:
        time.sleep(0.2)
    assert held() <= before and table.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_details_in_steps(spark):
    page, _ = eg.entity_detail(_graph(spark), _graph(spark).entities)
    assert "Join " not in page._jdf.queryExecution().optimizedPlan().toString()
