"""Small literal cases with known outcomes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from engramlake.functions.sensitive import is_sensitive
from engramlake.functions.windows import carry_last, running_totals
from engramlake.plans import recall
from engramlake.streaming import captures as capture_stream
from engramlake.operators import capture, distill, entities, govern, promote, related, retrieve

SENSITIVE = [
    "api_key=abcdefghijklmno12345",
    "sk-abcde fghij klmno pqrst uvwxyz",
    "-----BEGIN PRIVATE KEY-----",
    "password: correct-horse-battery-staple",
    'DB_PASSWORD="correct horse battery staple"',
    "password='s3cr3t'",
    '"password": "correct horse battery staple"',
    "'client_secret' = 'real client secret'",
    '"password": "placeholder actual-secret"',
    "'token' = 'sample-abcdefghijklmno'",
    'DB_PASSWORD="generated at deploy time"; CLIENT_SECRET="real client secret"',
    "API_KEY=abc1234",
    "DB_PASS=s3cr3t",
    "AWS_SECRET_ACCESS_KEY=" + "a" * 40,
    "DB_PASS=vault://secret/data/app?token=real#password",
    "DB_PASSWORD=${DATABASE_PASSWORD}\nCLIENT_SECRET=correct-horse-battery-staple",
    "The deployment credential may need rotation.",
]
HARMLESS = [
    "an example password placeholder",
    "# Secret management\n\nRotate deployment credentials.",
    "Passwords are configured by deployment automation.",
    "password: generated-at-deploy-time",
    "password=${DATABASE_PASSWORD}",
    "api_key: managed-by-vault",
    "password='generated at deploy time'",
    '"password": "placeholder"',
    "DB_PASS=${DATABASE_PASSWORD}",
    "AWS_SECRET_ACCESS_KEY=managed-by-vault",
    "DB_PASS=vault://secret/data/app#password",
]


def test_sensitive_samples(spark):
    rows = spark.createDataFrame([(t, True) for t in SENSITIVE] + [(t, False) for t in HARMLESS], "t string, expected boolean")
    wrong = rows.filter(is_sensitive(F.col("t")) != F.col("expected")).collect()
    assert wrong == []


def test_carry_last_and_running_totals_equal_plain_order(spark):
    data = [("k", i * 977 % 20000, f"e{i:04d}", i if i % 7 == 0 else None) for i in range(400)] + [("z", 5, "e", None)]
    rows = spark.createDataFrame(data, "k string, s long, id string, v int")
    got = {r.id: r.last for r in carry_last(rows, ["k"], "s", "id", F.col("v"), "last", bucket_seconds=600).filter("k = 'k'").collect()}
    last, expected = None, {}
    for _, _, event, value in sorted(data[:-1], key=lambda d: (d[1], d[2])):
        last = value if value is not None else last
        expected[event] = last
    assert got == expected
    sums = {r.id: r.n for r in running_totals(rows, ["k"], "s", "id", {"n": F.lit(1)}, descending=True, bucket_seconds=600).filter("k = 'k'").collect()}
    assert [sums[d[2]] for d in sorted(data[:-1], key=lambda d: (d[1], d[2]), reverse=True)] == list(range(1, 401))


def test_han_text_is_found_by_pairs(spark):
    units = spark.createDataFrame(
        [("ml-1", "机器学习模型训练", "a"), ("ml-2", "机器学习部署", "a"), ("sql", "项目使用 SQLite 存储", "a")], "id string, content string, region_id string"
    )
    queries = spark.createDataFrame([("q1", "机器学习"), ("q2", "项目 SQLite"), ("q3", "  ")], "query_id string, query string")
    hits = retrieve.bm25_search(queries, retrieve.build_text_index(units), 5).collect()
    found = {q: [h.id for h in sorted(hits, key=lambda h: h.rank) if h.query_id == q] for q in ("q1", "q2", "q3")}
    assert set(found["q1"]) == {"ml-1", "ml-2"} and found["q2"][0] == "sql" and found["q3"] == []


def test_cosine_edge_cases(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0]), ("d", [1.0, 1.0])], "id string, vector array<float>")
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<float>")
    got = {r.id: r.score for r in retrieve.vector_search(queries, vectors, 10, rows_per_shard=2).collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": -1.0, "d": pytest.approx(0.707107)}


def test_breadth_first_order(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "r") for i in range(4)], "source string, target string, relation string")
    seeds = spark.createDataFrame([("q", "n0", 0), ("q", "n1", 1)], "query_id string, id string, position int")
    rows = sorted(related.graph_expand(seeds, edges, 4).collect(), key=lambda r: r.position)
    assert [(r.id, r.hop, r.origin) for r in rows] == [("n2", 1, "n1"), ("n3", 2, "n1"), ("n4", 3, "n1")]


def test_two_shared_terms_relate_and_frequent_pairs_are_implied(spark):
    data = [("u1", "Graph nodes share alpha beta memory"), ("u2", "Graph expansion shares beta gamma content"), ("u3", "nothing alike")]
    data += [(f"f{i}", f"common phrase {i}") for i in range(30)]
    units = spark.createDataFrame([(i, c, "r") for i, c in data], "id string, content string, region_id string")
    association = related.associate(units)
    edges = association.edges.collect()
    assert [(e.source, e.target, e.shared) for e in edges] == [("u1", "u2", 2)]
    seeds = spark.createDataFrame([("q", "r", "f0"), ("p", "r", "u1")], "query_id string, scope string, id string")
    found = related.related_units(seeds, association).collect()
    assert {r.target for r in found if r.query_id == "q"} == {f"f{i}" for i in range(1, 30)}
    assert {r.target for r in found if r.query_id == "p"} == {"u2"}


def test_rounds_order_and_fingerprint_do_not_depend_on_partitioning(spark):
    events = spark.createDataFrame(
        [("r", "s", "t", f"e{i}", "user" if i % 2 == 0 else "assistant", f"text {i}", 100 - i) for i in range(10)],
        "region_id string, session_id string, turn_id string, event_id string, event_kind string, content string, occurred_s long",
    )
    first, second = capture.build_rounds(events.repartition(1)).first(), capture.build_rounds(events.repartition(7)).first()
    assert first == second
    assert (first.user_message, first.assistant_final) == ("text 8", "text 1")
    late = events.unionByName(events.limit(1).withColumn("event_id", F.lit("late")))
    assert capture.build_rounds(late).first().fingerprint != first.fingerprint


def test_alias_joins_one_entity_and_two_owners_are_refused(spark):
    schema = "region_id string, memory_id string, updated_s long, position int, entity_type string, canonical_name string, aliases array<string>"
    rows = spark.createDataFrame(
        [
            ("r", "m1", 1, 0, "project", "Atlas", ["Project Atlas"]),
            ("r", "m2", 2, 0, "project", "Project  ATLAS", []),
            ("r", "m3", 3, 0, "technology", "Atlas", []),
            ("r", "m4", 4, 0, "project", "Borealis", []),
            ("r", "m5", 5, 0, "project", "Merged", ["Atlas", "Borealis"]),
        ],
        schema,
    )
    known = rows.limit(0).select("region_id", "entity_type", F.lit("").alias("normalized_alias"), F.lit("").alias("entity_id"), F.lit(True).alias("canonical"))
    resolved, refused = entities.resolve_identity(rows, known)
    ids = {r.memory_id: r.entity_id for r in resolved.collect()}
    assert ids["m1"] == ids["m2"] and ids["m3"] != ids["m1"] and len(set(ids.values())) == 3
    assert [r.memory_id for r in refused.collect()] == ["m5"]


def test_unicode_names_are_normalized(spark):
    rows = spark.createDataFrame([("ＡＴＬＡＳ  Ｘ",), ("Straße",), (" Plain\t Name ",)], "n string")
    assert [r.x for r in rows.select(entities.normalized_name(F.col("n")).alias("x")).collect()] == ["atlas x", "strasse", "plain name"]


DECISIONS = "id string, region_id string, content string, outcome string, target_region_id string, claim_subject string, claim_value string, reason string"


def test_evidence_counts_regions_not_copies(spark):
    rows = spark.createDataFrame(
        [("1", "alpha", "c", "needs_evidence", "user", "s", "v", None), ("2", "alpha", "c", "needs_evidence", "user", "s", "v", None),
         ("3", "beta", "c", "needs_evidence", "user", "s", "v", None), ("4", "alpha", "d", "needs_evidence", "user", "t", "v", None),
         ("5", "alpha", "d", "needs_evidence", "user", "t", "v", None)],
        DECISIONS,
    )
    groups, _ = promote.evidence_groups(rows)
    got = {g.claim_subject: (g.n_sources, g.n_regions, g.evidence_kind) for g in groups.collect()}
    assert got == {"s": (3, 2, "multi_source"), "t": (2, 1, None)}


def test_exclusive_values_conflict_and_complements_do_not(spark):
    rows = [(str(i), f"r{i}", v, "promote", "user", s, v, None) for i, (s, v) in enumerate([("theme", "dark"), ("theme", "light"), ("lang", "fast"), ("lang", "memory-safe"), ("build", "npm")])]
    groups, _ = promote.evidence_groups(spark.createDataFrame(rows, DECISIONS))
    existing = spark.createDataFrame([("user", "Build", "pnpm")], "target_region_id string, claim_subject string, claim_value string")
    got = {(g.claim_subject, g.claim_value): g.conflict for g in promote.claim_conflicts(groups, existing).collect()}
    assert got == {("theme", "dark"): True, ("theme", "light"): True, ("lang", "fast"): False, ("lang", "memory-safe"): False, ("build", "npm"): True}


GATES = [
    ("The user prefers dark mode and requires weekly audits.", "preference", "I prefer dark mode", "more than one atomic claim"),
    ("It requires weekly audits.", "constraint", "require weekly audits", "unbound pronoun"),
    ("The API depends on it for caching.", "domain_fact", "x", "unbound pronoun"),
    ("We will deploy the staging build tomorrow.", "decision", "x", "transient or non-semantic output"),
    ("The project supports Windows, Linux, and macOS.", "domain_fact", "x", ""),
    ("The service retries the request when it fails.", "domain_fact", "x", ""),
    ("This project uses PostgreSQL 16.", "domain_fact", "x", ""),
    ("请求头必须包含 trace_id。", "constraint", "请求头必须包含 trace_id", ""),
    ("外部网络访问不使用代理", "constraint", "不用走代理", ""),
]


def test_language_gates(spark):
    rows = spark.createDataFrame([(i, c, t, e, e) for i, (c, t, e, _) in enumerate(GATES)] + [(99, "代码变更不提交", "constraint", "不要提交", "这次不要提交")],
                                 "id int, content string, memory_type string, evidence_snippet string, cited_text string")
    accepted, refused = distill.language_gates(rows)
    reasons = {r.id: "; ".join(r.reasons) for r in refused.collect()} | {r.id: "" for r in accepted.collect()}
    for i, (_, _, _, expected) in enumerate(GATES):
        assert (expected in reasons[i]) if expected else reasons[i] == "", GATES[i]
    assert reasons[99] == "one-off request"


def test_preference_claims_share_a_subject(spark):
    rows = spark.createDataFrame([(c, None, None) for c in ("The user prefers dark mode.", "The user prefers light mode.", "Opaque.")], "content string, claim_subject string, claim_value string")
    found, missing = distill.claims(rows)
    values = {r.claim_value: r.claim_subject for r in found.collect()}
    assert set(values) == {"dark", "light"} and len(set(values.values())) == 1
    assert missing.first().reason == "claim identity is missing"


def test_a_supersede_cycle_is_set_apart(spark):
    for cycle in ([("a", "b"), ("b", "a")], [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], [("a", "a")]):
        rows = spark.createDataFrame(cycle + [("x", None), ("y", "x"), ("z", "gone")], "id string, supersedes string")
        assert {(r.id, r.lineage_id, r.length) for r in govern.version_chains(rows).collect()} == {("x", "x", 2), ("y", "x", 2), ("z", "z", 1)}
        assert {r.id for r in govern.version_cycles(rows).collect()} == {i for i, _ in cycle}


def test_a_refused_operation_stands_in_nobodys_way(spark):
    units = spark.createDataFrame([("r", "u", "text", "active", 1, None, 1.0, 5)], "region_id string, id string, content string, lifecycle string, version int, supersedes string, weight double, updated_s long")
    right = units.select(govern.revision_of().alias("x")).first().x
    ops = spark.createDataFrame(
        [(1, "r", "u", "old", "archive", None, 6), (2, "r", "u", right, "rename", None, 7), (3, "r", "u", right, "archive", None, 8), (4, "r", "u", right, "forget", None, 9)],
        "op_seq long, region_id string, target_id string, expected_revision string, action string, new_content string, at_s long",
    )
    changed, audit, conflicts = govern.apply_mutations(units, ops)
    assert [r.lifecycle for r in changed.collect()] == ["archived"] and [r.op_seq for r in audit.collect()] == [3]
    assert {r.op_seq: r.reason for r in conflicts.collect()} == {1: "stale revision", 2: "unknown action", 4: "concurrent operation"}


def test_a_refused_restore_stands_in_nobodys_way(spark):
    units = spark.createDataFrame(
        [("r", "a", "one", "superseded", 1, None), ("r", "b", "two", "active", 2, "a")], "region_id string, id string, content string, lifecycle string, version int, supersedes string"
    ).withColumn("updated_s", F.lit(1).cast("long"))
    ops = spark.createDataFrame([(1, "r", "b", "b", 5), (2, "r", "b", "a", 6), (3, "r", "b", "a", 7)], "op_seq long, region_id string, current_id string, restore_id string, at_s long")
    created, replaced, rejects = govern.restore_versions(units, ops)
    assert [(r.content, r.version, r.supersedes) for r in created.collect()] == [("one", 3, "b")] and replaced.count() == 1
    assert {r.op_seq: r.reason for r in rejects.collect()} == {1: "already active", 3: "concurrent restore"}


def test_long_words_do_not_stop_the_screening(spark):
    long = ["key = 1 " + "a_" * 32_000, "a-" * 32_000 + "password=s3cr3t", "x=" + "vault://" + "a/" * 32_000, "token: vault://" + "a/" * 30_000 + "b#c", "p_" * 20_000 + "token_" * 5000, "a=1 secret=b; " * 4000]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(long)], "k int, t string")
    assert {r.k: r.x for r in rows.select("k", is_sensitive(F.col("t")).alias("x")).collect()} == {0: False, 1: True, 2: False, 3: False, 4: False, 5: True}


@pytest.mark.parametrize("length", [5, 36])
def test_a_chain_of_aliases_is_one_entity(spark, length):
    schema = "region_id string, memory_id string, updated_s long, position int, entity_type string, canonical_name string, aliases array<string>"
    rows = spark.createDataFrame([("r", f"m{k:03d}", k, 0, "project", f"Name{k}", [f"Name{k - 1}"] if k else []) for k in range(length)], schema)
    known = rows.limit(0).select("region_id", "entity_type", F.lit("").alias("normalized_alias"), F.lit("").alias("entity_id"), F.lit(True).alias("canonical"))
    resolved, refused = entities.resolve_identity(rows, known)
    assert refused.count() == 0 and resolved.select("entity_id").distinct().count() == 1 and resolved.count() == length


def test_recall_never_leaves_its_scope(spark):
    """A foreign unit, vector or edge is not found, however well it fits."""
    units = spark.createDataFrame(
        [(i, r, "decision", "active", c, "s") for i, r, c in [("a1", "A", "alpha beta"), ("a2", "A", "gamma"), ("b1", "B", "alpha beta alpha"), ("b2", "B", "delta")]],
        "id string, region_id string, memory_type string, lifecycle string, content string, source string",
    )
    vectors = spark.createDataFrame([("a1", [1.0, 0.1]), ("b1", [1.0, 0.0])], "id string, vector array<double>")
    edges = spark.createDataFrame([("A", "a1", "a2", "r"), ("B", "a1", "b2", "r")], "scope string, source string, target string, relation string")
    queries = spark.createDataFrame([("q", "alpha beta"), ("none", "alpha")], "query_id string, query string")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>")
    scopes = spark.createDataFrame([("q", "A")], "query_id string, region_id string")
    found = recall.recall_hits(queries, units, vectors=vectors, query_vectors=asked, edges=edges, scopes=scopes).collect()
    assert {(r.query_id, r.id) for r in found} == {("q", "a1"), ("q", "a2")}
    free = recall.recall_hits(queries, units, vectors=vectors, query_vectors=asked, edges=edges.drop("scope")).collect()
    assert {r.id for r in free if r.query_id == "q"} == {"a1", "a2", "b1", "b2"}


def test_captures_of_any_age_are_kept_and_compared(spark, tmp_path):
    """June, then January: nothing is dropped, and an id of June with other content in January is a conflict."""
    import json

    def spool(name, *events):
        lines = [json.dumps({"event_id": e, "session_id": "s", "turn_id": "t", "event_kind": "user", "content": c, "occurred_at": at, "cwd": "/w"}) for e, c, at in events]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(lines))
        paths = [str(tmp_path / n) for n in ("in", "events", "conflicts", "progress")]
        capture_stream.ingest_captures(spark, *paths).awaitTermination()

    spool("1", ("a", "x", "2026-06-01T00:00:00Z"), ("a", "x", "2026-06-01T00:00:00Z"))
    spool("2", ("b", "y", "2026-06-02T00:00:00Z"))
    spool("3", ("c", "z", "2026-01-01T00:00:00Z"), ("a", "other", "2026-01-02T00:00:00Z"), ("b", "y", "2026-06-02T00:00:00Z"))
    events = spark.read.parquet(str(tmp_path / "events")).collect()
    assert sorted((r.event_id, r.content) for r in events) == [("a", "x"), ("b", "y"), ("c", "z")]
    conflicts = spark.read.parquet(str(tmp_path / "conflicts")).collect()
    assert [(r.event_id, r.content) for r in conflicts] == [("a", "other")]


def test_reranking_keeps_every_hit(spark):
    hits = spark.range(600).select(F.lit("q").alias("query_id"), (F.col("id") + 1).cast("int").alias("rank"), F.col("id").cast("string").alias("id"))
    scores = spark.range(600).select(F.lit("q").alias("query_id"), F.col("id").cast("int").alias("index"), F.col("id").cast("double").alias("score"))
    kept, refused = retrieve.apply_rerank(hits, scores)
    assert refused.count() == 0 and kept.count() == 600 and kept.filter("final_rank = 1").first().id == "599"


def test_long_lineage(spark):
    rows = spark.range(1, 301).select(F.col("id").cast("string"), F.when(F.col("id") > 1, (F.col("id") - 1).cast("string")).alias("supersedes"))
    chains = govern.version_chains(rows)
    assert chains.filter("lineage_id = '1' AND latest_id = '300' AND length = 300 AND position = CAST(id AS INT)").count() == 300
