"""gov11: a round of the provenance closure shuffles its own pairs, never those found before."""

from __future__ import annotations

from engramlake.operators import govern


def plain(links):
    found = {}
    for start in links:
        depth, front, seen = 1, {a for a in links[start] or () if a is not None}, {start}
        while front - seen:
            front -= seen
            found |= {(start, a): depth for a in front}
            seen |= front
            front = {b for a in front for b in links.get(a) or () if b is not None}
            depth += 1
    return found


def units_of(spark, links):
    return spark.createDataFrame([*links.items()], "id string, provenance array<string>")


def test_closure_of_odd_links(spark):
    """Cycles, loops, parents without a row, nulls, repeated parents and units without any."""
    links = {"a": ["b", "b"], "b": ["c", "a"], "c": ["c", None, "gone"], "d": [], "e": None, "f": ["a", "c"], "g": ["f", "g"]}
    got = govern.provenance_closure(units_of(spark, links).unionByName(units_of(spark, {"f": ["a"]}))).collect()
    assert {(r.id, r.ancestor_id): r.depth for r in got} == plain(links) and len(got) == len(plain(links))
    some = govern.provenance_closure(units_of(spark, links), spark.createDataFrame([("g",), ("e",)], "id string")).collect()
    assert {(r.id, r.ancestor_id): r.depth for r in some} == {k: v for k, v in plain(links).items() if k[0] in "ge"}
    assert govern.provenance_closure(units_of(spark, {"d": []})).collect() == []
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("engramlake_")]


def test_found_pairs_are_not_shuffled(spark):
    """The anti join with the pairs found so far reads their buckets, without an exchange above their scan."""
    links = {f"u{k}": [f"u{k // 2}", f"u{k // 3}"] for k in range(400)}
    plans, plain_table = [], govern._dealt

    def watched(df, *rest, **more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain_table(df, *rest, **more)

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    govern._dealt = watched
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = govern.provenance_closure(units_of(spark, links))
    finally:
        govern._dealt = plain_table
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got.count() == len(plain(links))
    rounds = [p for p in plans if "LeftAnti" in p]
    assert rounds and all(p.count("Exchange") == 2 for p in rounds)  # the frontier to its parents, what it leads to to its bucket
