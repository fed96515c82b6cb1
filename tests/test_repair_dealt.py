"""Index repair: units are dealt out by id, so postings are counted where their text lies."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from engramlake.operators import repair, retrieve

COLUMNS = "id string, region_id string, lifecycle string, content string"
ROWS = [(f"u{i}", f"r{i % 2}", "active" if i % 3 else "archived", " ".join(f"w{j % 4}" for j in range(i % 9))) for i in range(60)]
ROWS += [("u1", "r1", "active", "w0"), ("u2", "r0", "active", None), (None, "r0", "active", "w1 w1"), (None, "r0", "active", "w1 w2")]


def _postings(rows):
    found = Counter()
    for unit, region, _, text in rows:
        words = (text or "").split()
        for word in words:
            found[word, unit, len(words), region] += 1
    return found


def test_postings_are_dealt_by_id_and_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(repair, "TASK_UNITS", 10)
    units = spark.createDataFrame(ROWS, COLUMNS)
    dealt = repair.dealt_units(units, len(ROWS))
    assert dealt.rdd.getNumPartitions() == 7
    postings = retrieve.build_text_index(dealt).postings
    assert postings._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert Counter({(x.term, x.id, x.doc_len, x.region_id): x.tf for x in postings.collect()}) == _postings(ROWS)


def test_repaired_index(spark, monkeypatch):
    monkeypatch.setattr(repair, "TASK_UNITS", 10)
    units = spark.createDataFrame(ROWS, COLUMNS)
    old = units.filter("id not in ('u4', 'u5')").unionByName(spark.createDataFrame([("ghost", "r0", "active", "w3")], COLUMNS))
    index = retrieve.build_text_index(repair.dealt_units(old, 60)).postings
    expected = _postings([r for r in ROWS if r[2] == "active" and r[0] is not None])
    found = repair.repair_index(units, index.filter(F.col("id").isNotNull()))
    assert Counter({(x.term, x.id, x.doc_len, x.region_id): x.tf for x in found.collect()}) == expected
