"""Ids of the stored entity graph are packed while they are shuffled; views meet relations from the end that fewer queries show."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from engramlake.operators import entities as eg
from engramlake.registry import entities as queries
from engramlake.sources.domain import Tables

PART, SUPPLIER = "component", "organization"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("lines")
    lines = [(o, o % 7 if o % 5 else None, o % 4 if o % 9 else None, o % 3, "F" if o % 2 else "O", "R" if o % 3 else "N") for o in range(60)]
    spark.createDataFrame(
        lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_linestatus string, l_returnflag string"
    ).write.parquet(f"{folder}/lineitem.parquet")
    return Tables(spark, str(folder))


def test_packed_ids_are_spelled_again(spark):
    names = ["part 1", "a:b", "", "é:x", None]
    rows = spark.createDataFrame(
        [(region, s, t, k) for region in ("r", None) for s in names for t in names for k in ("part_of", "depends_on")],
        "region_id string, s string, t string, relation_type string",
    )
    full = rows.select(
        "*", F.lit(PART).alias("sk"), F.lit(SUPPLIER).alias("tk"),
        queries._packed_entity(F.lit(PART), F.col("s")).alias("entity_id"),
        queries._packed_relation(F.col("relation_type"), F.col("s"), F.col("t")).alias("relation_id"),
    ).select(
        "*", eg.entity_key("region_id", "sk", "s").alias("source"), eg.entity_key("region_id", "tk", "t").alias("target")
    ).select("*", eg.relation_key("region_id", "source", "target", "relation_type").alias("relation"), queries.entity_ids().alias("e"), queries.relation_ids().alias("r"))
    out = full.collect()
    assert all(row.e == row.source and row.r == row.relation for row in out)
    assert [row.e for row in sorted(out, key=lambda row: (row.entity_id, row.region_id or ""))] == sorted(row.source for row in out)
    assert len({(row.region_id, bytes(row.relation_id)) for row in out}) == len(out)


def test_graph_holds_no_spelled_ids(tables):
    graph = queries.graph_of(tables)
    longest = graph.relations.agg(F.max(F.length("relation_id") + F.length("source_entity_id") + F.length("target_entity_id"))).first()[0]
    assert longest < 3 * 64
    supports = queries.stored(tables, "entity-supports", lambda: tables.entity_support)
    assert "entity_id" not in supports.columns


def test_memory_lists_leave_evidence_unread(tables):
    entities, _, _ = eg.aggregate_supports(queries.graph_of(tables))
    plan = entities.select("entity_id", "evidence_memory_ids")._jdf.queryExecution().optimizedPlan().toString()
    assert " names " not in plan and " names " in entities._jdf.queryExecution().optimizedPlan().toString()


def test_relations_inside_views(spark):
    nodes = [(q, "r", e) for q in ("q1", "q2", "q3") for e in ("hub", f"of {q}")] + [("q1", "r", "of q1"), ("q2", "s", "hub"), ("q2", None, "hub")]
    pairs = [("r", "hub", f"of {q}") for q in ("q1", "q2", "q3", "q4")] + [("r", "of q1", "hub"), ("r", "hub", "hub"), ("r", "of q1", "of q2"), ("s", "hub", "of q2"), (None, "hub", "hub")]
    found = eg._inside(
        spark.createDataFrame(nodes, "query_id string, region_id string, entity_id string"),
        spark.createDataFrame(
            [(r, f"{s}>{t}", s, t, "uses", 5) for r, s, t in pairs],
            "region_id string, relation_id string, source_entity_id string, target_entity_id string, relation_type string, newest_s long",
        ),
    )
    wanted = [
        (q, r, s, t) for q, r, e in nodes for pr, s, t in pairs if r is not None and (pr, s) == (r, e) and (q, r, t) in nodes
    ]
    assert sorted((x.query_id, x.region_id, x.source_entity_id, x.target_entity_id) for x in found.collect()) == sorted(wanted)
